"""Benchmark decontamination: documents that hold a near copy of a benchmark item.

Words are runs of digits, letters and non-ASCII characters after lower-casing A-Z, so punctuation and line ends do
not matter; shingles are five words. A document leaks an item if some window of it, as long as the item, has a
weighted Jaccard similarity of at least ``SIMILARITY`` = 0.8 with the item: shingles are multisets, and a
shingle weighs ln(1 + items / items that have it), so boilerplate common to many items weighs little. Items are counted
over the whole benchmark, however it is cut into chunks.

A window is cut off where the text ends or starts.

Candidates come from SimHash over item-sized windows. A window's features are its shingles, numbered where they repeat, each with
the square root of its weight. The cosine of two such feature vectors is at least 2 J / (1 + J) for a weighted Jaccard
similarity J, so at 0.8 a bit of the fingerprints differs with a probability of about acos(0.889) / pi = 0.151: of ``BITS`` =
128 bits 19.4 are expected to differ, with a deviation of 4.1. ``RADIUS`` = 47 lies 6.8 deviations above. The items of one
size share a multi-index: the bits are cut into ``len(BLOCKS)`` = 12 blocks; two fingerprints within the radius differ in at
most three bits in one block, as 12 times 4 is more than 47. Each item is filed under all values within two bits of each of
its blocks, and each window looks up all values within one bit, so every item within the radius is found. The exact
weighted similarity of the window then decides.

Which windows are fingerprinted follows from the bound, and loses none: a window at or above ``SIMILARITY`` holds at least
0.8 of the item's weight, so at least one of any shingles that weigh more than 0.2 of the item together. Each item's rarest
shingles up to that weight are its anchors, and every place of a text that holds an anchor opens all windows of that
item's size around it.

Items shorter than five words match as one shingle of all their words.

Scale: one pass over whole texts without a shuffle. The benchmark is the stated query set; its index is built and broadcast in
chunks of ``ITEMS`` items and ``ITEM_BYTES`` bytes, about 20 kilobytes an item, and all chunks are searched in that one pass.
Shingles are counted by Spark; those that two items or more have, and their weights, go to the driver and to every worker:
16 bytes each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from govspark.llm.streams import unused_name
from govspark.llm.words import ALPHANUMERIC, Slice, bounded_batches, mix, run_hashes, slices

SHINGLE = 5
SIMILARITY = 0.8
BITS, RADIUS = 128, 47
ITEMS = 512
ITEM_BYTES = 1 << 20
#: Lowest bit and width of the blocks.
BLOCKS = tuple((i * 11 - max(0, i - 8), 11 if i < 8 else 10) for i in range(12))
PRESENT_BITS = 20
#: Whole numbers in place of the square roots of weights, so that sums are exact.
SCALE = 1 << 12
#: Above what running sums may be off; the exact sum decides within it.
MARGIN = 1e-9
#: Pairs of a place and an item, and windows of a text, that are looked at together.
PAIRS, WINDOWS = 1 << 20, 1 << 12

_MATCH = "array<struct<item_id: long, first_word: long, last_word: long, similarity: double>>"


def _flips(width: int, most: int) -> np.ndarray:
    """All masks of ``width`` bits with up to ``most`` bits set."""
    return np.array([sum(1 << i for i in bits) for n in range(most + 1) for bits in combinations(range(width), n)], np.int64)


def _block(prints: np.ndarray, at: int, width: int) -> np.ndarray:
    """The bits ``at`` to ``at + width`` of fingerprints of two words."""
    low = prints[:, 0] >> np.uint64(at) if at < 64 else prints[:, 1] >> np.uint64(at - 64)
    if at < 64 < at + width:
        low = low | prints[:, 1] << np.uint64(64 - at)
    return (low & np.uint64((1 << width) - 1)).astype(np.int64)


def fingerprints(shingles: np.ndarray, weights: np.ndarray, begin: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Fingerprints (two words each) of the windows ``begin`` to ``stop`` of ``shingles``.

    A bit is set if the features with it weigh more than half. The occurrences of a shingle in a window are features of
    their own.
    """
    roots = np.rint(np.sqrt(weights) * SCALE).astype(np.int64)
    if len(np.unique(shingles)) == len(shingles):
        sums = np.zeros((len(shingles) + 1, BITS), dtype=np.int64)
        np.cumsum(_signs(shingles) * roots[:, None], axis=0, out=sums[1:])
        high = sums[stop] > sums[begin]
    else:
        high = np.empty((len(begin), BITS), dtype=bool)
        for i, (a, b) in enumerate(zip(begin.tolist(), stop.tolist(), strict=True)):
            order = np.argsort(shingles[a:b], kind="stable")
            own = shingles[a:b][order]
            first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            number = np.arange(b - a) - np.repeat(first, np.diff(np.append(first, b - a)))
            high[i] = (_signs(own + number.astype(np.uint64) * _ODD) * roots[a:b][order][:, None]).sum(axis=0) > 0
    return np.packbits(high, axis=1, bitorder="little").view(np.uint64)


_ODD = np.uint64(0xD6E8FEB86659FD93)


def _signs(features: np.ndarray) -> np.ndarray:
    """The bits of each feature's hash, as 1 and -1."""
    octets = np.stack([mix(features), mix(features ^ _ODD)], axis=1).view(np.uint8)
    return np.unpackbits(octets, axis=1, bitorder="little").astype(np.int64) * 2 - 1


class SizeClass:
    """Multi-index of the items with one number of words."""

    def __init__(self, items: np.ndarray, prints: np.ndarray):
        self.items, self.prints = items, prints
        self.blocks = []
        for at, width in BLOCKS:
            filed = (_block(prints, at, width)[:, None] ^ _flips(width, 2)).reshape(-1)
            order = np.argsort(filed, kind="stable")
            entries = np.repeat(np.arange(len(items), dtype=np.int32), len(filed) // max(1, len(items)))
            self.blocks.append((at, width, filed[order].astype(np.int16), entries[order]))

    def near(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All pairs (row of ``prints``, row of the class) within ``RADIUS`` bits."""
        found = []
        for at, width, filed, entries in self.blocks:
            asked = (_block(prints, at, width)[:, None] ^ _flips(width, 1)).astype(np.int16)
            low = np.searchsorted(filed, asked, "left").reshape(-1)
            many = np.searchsorted(filed, asked, "right").reshape(-1) - low
            row = np.repeat(np.repeat(np.arange(len(prints)), asked.shape[1]), many)
            entry = entries[np.repeat(low - np.cumsum(many) + many, many) + np.arange(len(row))]
            found.append(np.unique(row * len(self.items) + entry))
        row, own = np.divmod(np.unique(np.concatenate(found)), len(self.items))
        close = np.bitwise_count(prints[row] ^ self.prints[own]).sum(axis=1) <= RADIUS
        return row[close], own[close]


def _common(seen: dict[int, int], total: int) -> tuple[np.ndarray, np.ndarray]:
    """The shingles that two items or more have, in order, and their weights."""
    keys = sorted(s for s, n in seen.items() if n > 1)
    return np.array(keys, np.uint64), np.log1p(total / np.array([seen[s] for s in keys], np.float64))


def _item_shingles(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """Words and shingles of every text."""
    for part in slices(column, ALPHANUMERIC, lower=True):
        words = part.hashes()
        for a, b in zip(part.words[:-1], part.words[1:], strict=True):
            n, k = int(b - a), min(SHINGLE, int(b - a))
            yield n, run_hashes(words[a:b], np.arange(n - k + 1), k) if n else np.zeros(0, np.uint64)


def _multiset(hashes: np.ndarray) -> dict[int, int]:
    values, counts = np.unique(hashes, return_counts=True)
    return dict(zip(values.tolist(), counts.tolist(), strict=True))


@dataclass
class Anchors:
    """Anchor shingles of the items with one shingle length, in order, and the items that have them."""

    keys: np.ndarray
    items: np.ndarray
    present: np.ndarray  #: by the low bits of a shingle: whether an anchor has them

    @classmethod
    def of(cls, pairs: list[tuple[int, int]]) -> Anchors:
        keys, items = np.array([s for s, _ in pairs], np.uint64), np.array([i for _, i in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        present = np.zeros(1 << PRESENT_BITS, dtype=bool)
        present[keys & np.uint64(len(present) - 1)] = True
        return cls(keys[order], items[order], present)

    def places(self, shingles: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """All pairs (place, item) where the place has an anchor of the item, in blocks."""
        hit = np.flatnonzero(self.present[shingles & np.uint64(len(self.present) - 1)])
        low = np.searchsorted(self.keys, shingles[hit], "left")
        many = np.searchsorted(self.keys, shingles[hit], "right") - low
        hit, low, many = hit[many > 0], low[many > 0], many[many > 0]
        ends = np.cumsum(many)
        at = 0
        while at < len(hit):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, "right")))
            some, first = many[at:to], np.cumsum(many[at:to]) - many[at:to]
            within = np.arange(int(some.sum())) - np.repeat(first, some)
            yield np.repeat(hit[at:to], some), self.items[np.repeat(low[at:to], some) + within]
            at = to


class Index:
    """Shingles and anchors of a bounded chunk of items."""

    def __init__(self, items: list[tuple[int | None, str | None]], total: int | None = None,
                 common: tuple[np.ndarray, np.ndarray] | None = None) -> None:
        """``total`` and ``common``: items of the whole benchmark and ``_common`` of it; by default ``items`` are all."""
        own = list(_item_shingles(pa.array([t for _, t in items], pa.large_string())))
        self.ids, self.lengths = [i for i, _ in items], [n for n, _ in own]
        self.shingles = [_multiset(hashes) for _, hashes in own]
        seen: dict[int, int] = {}
        for shingles in self.shingles:
            for s in shingles:
                seen[s] = seen.get(s, 0) + 1
        total = len(items) if total is None else total
        self.rare = float(np.log1p(max(1, total)))
        self.common = _common(seen, total) if common is None else common
        known = np.array(list(seen), np.uint64)
        self.weights = dict(zip(known.tolist(), self._weights(known).tolist(), strict=True))
        self.own = [(np.array(list(m), np.uint64), np.array([self.weights[s] for s in m]),
                     np.array(list(m.values()), np.int64)) for m in self.shingles]
        self.anchors = self._anchors()
        self.sizes: dict[int, SizeClass] = {}
        for n in sorted(set(self.lengths) - {0}):
            members = [i for i, m in enumerate(self.lengths) if m == n]
            prints = [fingerprints(h := own[i][1], self._weights(h), np.array([0]), np.array([len(h)])) for i in members]
            self.sizes[n] = SizeClass(np.array(members), np.concatenate(prints))

    def _anchors(self) -> dict[int, Anchors]:
        """By shingle length: the rarest shingles of each item, until what is left is less than a leak must hold."""
        grouped: dict[int, list[tuple[int, int]]] = {}
        for i, (n, shingles) in enumerate(zip(self.lengths, self.shingles, strict=True)):
            if n:
                left = total = sum(self.weights[s] * c for s, c in shingles.items())
                for s in sorted(shingles, key=lambda s: -self.weights[s]):
                    if left < (SIMILARITY - MARGIN) * total:
                        break
                    grouped.setdefault(min(SHINGLE, n), []).append((s, i))
                    left -= self.weights[s] * shingles[s]
        return {k: Anchors.of(pairs) for k, pairs in grouped.items()}

    def similarity(self, item: int, found: dict[int, int]) -> float:
        own = self.shingles[item]
        both = sum(self.weights[s] * min(n, own[s]) for s, n in found.items() if s in own)
        others = self._weights(np.array(list(found), np.uint64)).tolist()
        total = sum(w * n for w, n in zip(others, found.values(), strict=True))
        total += sum(self.weights[s] * n for s, n in own.items())
        return both / (total - both) if total > both else 1.0

    def matches(self, part: Slice) -> dict[int, dict[int, tuple[float, int, int]]]:
        """Per text of the slice, per item: best similarity and the first and last word of that window."""
        words = part.hashes()
        out: dict[int, dict[int, tuple[float, int, int]]] = {}
        for k, anchors in self.anchors.items():
            starts = part.runs(k)
            shingles = np.zeros(len(words), np.uint64)
            shingles[starts] = run_hashes(words, starts, k)
            inside = np.zeros(len(words), bool)
            inside[starts] = True
            lengths = np.array(self.lengths)
            seen: dict[tuple[int, int], list[np.ndarray]] = {}
            for place, item in anchors.places(shingles):
                place, item = place[inside[place]], item[inside[place]]
                text = np.searchsorted(part.words, place, "right") - 1
                found = np.unique(np.stack([text, lengths[item], place]), axis=1)
                fresh = np.flatnonzero(np.any(found[:2, 1:] != found[:2, :-1], axis=0)) + 1
                for (t, n, _), group in zip(found[:, np.append(0, fresh)].T.tolist() if found.size else (), np.split(found[2], fresh), strict=False):
                    seen.setdefault((t, n), []).append(group)
            for (t, n), groups in seen.items():
                low, high = int(part.words[t]), int(part.words[t + 1])
                for i, best in self._leaks(n, k, shingles[low : high - k + 1], np.concatenate(groups) - low):
                    if best[0] > out.get(t, {}).get(i, (0.0,))[0]:
                        out.setdefault(t, {})[i] = best
        return out

    def _leaks(self, n: int, k: int, shingles: np.ndarray, places: np.ndarray) -> Iterator[tuple[int, tuple[float, int, int]]]:
        """Items of ``n`` words that leak into a text, among its windows around ``places``."""
        size, own = n - k + 1, self.sizes[n]
        opened = np.zeros(len(shingles) + 2 * size, dtype=np.int64)  # by start + size - 1: how many places open a window
        np.add.at(opened, places, 1)
        np.add.at(opened, places + size, -1)
        starts = np.flatnonzero(np.cumsum(opened) > 0) - size + 1
        begin, stop = np.maximum(starts, 0), np.minimum(starts + size, len(shingles))
        row, item = [], []
        for at in range(0, len(starts), WINDOWS):
            a, b = begin[at : at + WINDOWS], stop[at : at + WINDOWS]
            region = shingles[a[0] : b.max()]
            near = own.near(fingerprints(region, self._weights(region), a - a[0], b - a[0]))
            row.append(near[0] + at)
            item.append(near[1])
        rows, items = np.concatenate(row), np.concatenate(item)
        for one in np.unique(items).tolist():
            allowed = starts[rows[items == one]]
            # Windows far apart are scored apart.
            for group in np.split(allowed, np.flatnonzero(np.diff(allowed) > size) + 1):
                i = int(own.items[one])
                if best := self._best(i, k, shingles, group):
                    yield i, best

    def _best(self, item: int, k: int, shingles: np.ndarray, candidates: np.ndarray) -> tuple[float, int, int] | None:
        """The first best of the candidate windows (their starts, in order), if it is a leak."""
        keys, weights, counts = self.own[item]
        size, end = self.lengths[item] - k + 1, len(shingles)
        last = int(candidates[-1])
        starts = np.arange(int(candidates[0]), last + 1)
        allowed = np.zeros(len(starts), dtype=bool)
        allowed[candidates - starts[0]] = True
        low = max(int(starts[0]), 0)
        region = shingles[low : min(last + size, end)]
        at = np.minimum(np.searchsorted(keys, region), len(keys) - 1)
        mine = keys[at] == region
        # An occurrence counts in a window unless as many as the item has lie before it in that window.
        spots, kinds = np.flatnonzero(mine), at[mine]
        order = np.argsort(kinds, kind="stable")
        rank, most = np.arange(len(order)), counts[kinds[order]]
        earlier = np.maximum(rank - most, 0)
        surplus = (rank >= most) & (kinds[order[earlier]] == kinds[order])
        before = np.where(surplus, spots[order[earlier]], -1 - low - size)
        left = np.maximum(np.maximum(spots[order] - size, before) + 1 + low, starts[0]) - starts[0]
        right = np.minimum(spots[order] + low, last) + 1 - starts[0]
        gain = np.where(left < right, weights[kinds[order]], 0.0)
        change = np.bincount(np.minimum(left, right), gain, len(starts) + 1) - np.bincount(right, gain, len(starts) + 1)
        both = np.cumsum(change)[:-1]
        own = float((weights * counts).sum())
        if both.max() < (SIMILARITY - MARGIN) * own:
            return None
        sums = np.concatenate([[0.0], np.cumsum(np.where(mine, weights[at], self._weights(region)))])
        begin, stop = np.maximum(starts, 0), np.minimum(starts + size, end)
        scores = np.where(allowed, both / (sums[stop - low] - sums[begin - low] + own - both), -1.0)
        best = float(scores.max())
        if best < SIMILARITY - MARGIN:
            return None
        near = np.flatnonzero(scores >= best - 4 * MARGIN if best < SIMILARITY + MARGIN else scores >= best - MARGIN / 100)
        exact: tuple[float, int, int] | None = None
        for i in near.tolist():
            a, b = int(begin[i]), int(stop[i])
            score = self.similarity(item, _multiset(shingles[a:b]))
            if score >= SIMILARITY and (exact is None or score > exact[0]):
                exact = (score, a, b + k - 2)
            if exact and best >= SIMILARITY + MARGIN:
                break
        return exact

    def _weights(self, shingles: np.ndarray) -> np.ndarray:
        """Weights of any shingles, also of other chunks' items; one that no item or a single item has is rare."""
        keys, weights = self.common
        if not len(keys):
            return np.full(len(shingles), self.rare)
        at = np.minimum(np.searchsorted(keys, shingles), len(keys) - 1)
        return np.where(keys[at] == shingles, weights[at], self.rare)


def _common_of(items: DataFrame, total: int) -> tuple[np.ndarray, np.ndarray]:
    """``_common`` of a whole benchmark, counted by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, hashes in _item_shingles(batch.column("t")):
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(hashes).view(np.int64))], names=["shingle"])

    counted = items.select("t").mapInArrow(run, "shingle long").groupBy("shingle").count().where("count > 1").toArrow()
    keys = counted["shingle"].to_numpy().view(np.uint64)
    order = np.argsort(keys)
    return keys[order], np.log1p(total / counted["count"].to_numpy()[order].astype(np.float64))


def _chunks(items: DataFrame, n: int, size: int) -> Iterator[list[tuple[int | None, str | None]]]:
    """``n`` items of ``size`` bytes in chunks of at most about ITEMS items and ITEM_BYTES bytes; one at a time is
    collected."""
    parts = max(-(-n // (ITEMS // 2)) if n > ITEMS else 1, -(-size // ITEM_BYTES), 1)
    for part in range(parts):
        mine = items.where(F.pmod(F.xxhash64("i", "t"), F.lit(parts)) == part) if parts > 1 else items
        yield sorted(((r["i"], r["t"]) for r in mine.collect()), key=repr)


def find_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id",
               item_text: str = "text") -> DataFrame:
    """``docs`` with leaks: the items each document holds, with the best window's words and similarity.

    Null and empty texts and items match nothing. Repeated items are reported once each, repeated documents too. Empty
    tables give empty leaks. A column named leaks in ``docs`` is replaced; clashing names in ``benchmark`` are no
    matter, as only its id and text are read.
    """
    bounded_batches(docs.sparkSession)
    context = docs.sparkSession.sparkContext
    found = docs.drop("leaks").withColumn("leaks", F.array().cast(_MATCH))
    items = benchmark.select(F.col(item_id).cast("long").alias("i"), F.col(item_text).alias("t"))
    total, size = items.agg(F.count("*"), F.sum(F.octet_length("t"))).first()
    common = _common_of(items, total)
    shared = context.broadcast(common)
    chunks = []
    for chunk in _chunks(items, total, size or 0):
        index = Index(chunk, total, common)
        index.common = None  # sent once, not with each chunk
        chunks.append(context.broadcast(index))
    return _search(found, chunks, shared, text)


def _search(docs: DataFrame, chunks: list, shared, text: str) -> DataFrame:
    names = docs.columns
    source = docs.select("*", F.col(text).alias(unused_name(names)))
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()),
                               ("similarity", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            before = batch.column(names.index("leaks")).to_pylist()
            for part in slices(batch.column(len(names)), ALPHANUMERIC, lower=True):
                for chunk in chunks:
                    index = chunk.value
                    index.common = shared.value
                    for one, items in index.matches(part).items():
                        before[part.first + one] = [*before[part.first + one], *(
                            {"item_id": index.ids[i], "first_word": a, "last_word": b, "similarity": s}
                            for i, (s, a, b) in sorted(items.items())
                        )]
            columns = list(batch.columns[: len(names)])
            columns[names.index("leaks")] = pa.array(before, kind)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    fields = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return source.mapInArrow(run, fields)


def leaked_pairs(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, first_word, last_word (words from 0), similarity: one row per document and leaked item."""
    found = find_leaks(docs.select("doc_id", "text"), benchmark)
    return found.select("doc_id", F.explode("leaks").alias("leak")).select("doc_id", "leak.*")


def drop_leaky(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no benchmark item, with all their columns."""
    return find_leaks(docs, benchmark).where(F.size("leaks") == 0).select(docs.columns)
