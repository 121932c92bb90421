"""Interpolated modified Kneser-Ney bigram model: counted in Spark, kept as sorted hash arrays, mapped by workers.

Tokens are the words of a text (A-Z lowered) and one end, which is also the context of the first word. Three passes
over whole texts:

1. Words are counted by 64-bit hash. Tasks count what they read and send sorted, delta-packed arrays by hash range;
   each range becomes two files on shared storage, the sorted hashes and their counts. A word's id is its rank.
2. Workers map these files, turn words into ids and count pairs (id, id) likewise, by a hash of the first word; a word
   frequent enough to weigh on one range is dealt by both words. Each range becomes sorted pairs and counts. From the
   distinct pairs follow, per word, its continuation count and the numbers of followers seen once, twice, more often.
3. Workers map all files and score every text: discounted pair probability plus what the discounts freed times the
   discounted continuation probability, down to a uniform share for unknown words.

Scale: shuffles carry each task's distinct counts once, three to five bytes each. Ranges grow in number with the
input (one per ``RANGE_BYTES`` of text), so a range fits a task. Mapped pages are shared by the workers of a machine
and read only where a lookup falls. Files appear under their final name only when complete, so a repeated task
rewrites the same content. The shared folder must be a mounted file system, because files are mapped.

The order is two: all pairs of the corpus are kept, without a count threshold. README.md gives the reason.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from govspark.llm.arrays import (
    hash_range,
    local_folder,
    merged,
    pack,
    pack_sorted,
    read_array,
    unpack,
    unpack_sorted,
    write_array,
)
from govspark.llm.language import held_out
from govspark.llm.words import BLANK_SEPARATED, bounded_batches, mix, slices
from govspark.session import fresh_path

RANGE_BYTES = 16 << 20
FLUSH = 1 << 20  # distinct keys a task holds before it sends them
#: Hash of the end token.
END = np.uint64(0x5BD1E9955BD1E995)

_PACKED = "part int, keys binary, counts binary"


class Tally:
    """Counts of keys within a task, merged now and then, sent as packed ranges."""

    def __init__(self) -> None:
        self.keys: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.held = 0

    def add(self, keys: np.ndarray) -> bool:
        """Count ``keys``; whether so many distinct ones are held that they should be sent."""
        key, count = np.unique(keys, return_counts=True)
        self.keys.append(key)
        self.counts.append(count.astype(np.uint64))
        self.held += len(key)
        if self.held > 2 * FLUSH:
            key, count = merged(self.keys, self.counts)
            self.keys, self.counts, self.held = [key], [count], len(key)
        return self.held > FLUSH

    def send(self, part_of) -> Iterator[pa.RecordBatch]:
        if not self.keys:
            return
        key, count = merged(self.keys, self.counts)
        self.keys, self.counts, self.held = [], [], 0
        part = part_of(key)
        order = np.argsort(part, kind="stable")
        parts, first = np.unique(part[order], return_index=True)
        for p, some in zip(parts, np.split(order, first[1:]), strict=True):
            yield pa.RecordBatch.from_arrays(
                [pa.array([int(p)], pa.int32()), pa.array([pack_sorted(key[some])]), pa.array([pack(count[some])])],
                names=["part", "keys", "counts"],
            )


@dataclass
class Vocabulary:
    """Sorted hashes of the training words, in ranges; the id of a word is its rank."""

    folder: str
    sizes: list[int]  #: words per range
    tokens: int

    def __post_init__(self) -> None:
        self.first = np.concatenate([[0], np.cumsum(self.sizes)]).astype(np.int64)

    @property
    def words(self) -> int:
        return int(self.first[-1])

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        """Id of each of the sorted ``hashes``, or -1."""
        out = np.full(len(hashes), -1, dtype=np.int64)
        part = hash_range(hashes, len(self.sizes))
        for p in np.unique(part):
            a, b = np.searchsorted(part, [p, p + 1])
            known = read_array(self.folder, f"words-{p}", np.uint64)
            if len(known):
                at = np.minimum(np.searchsorted(known, hashes[a:b]), len(known) - 1)
                out[a:b] = np.where(known[at] == hashes[a:b], at + self.first[p], -1)
        return out

    def gather(self, name: str, kind: type, ids: np.ndarray, width: int = 1) -> np.ndarray:
        """Values of sorted known ``ids`` from the arrays ``name``."""
        out = np.zeros((len(ids), width), dtype=kind)
        bounds = np.searchsorted(ids, self.first)
        for p in np.flatnonzero(np.diff(bounds)):
            a, b = bounds[p], bounds[p + 1]
            out[a:b] = read_array(self.folder, f"{name}-{p}", kind).reshape(-1, width)[ids[a:b] - self.first[p]]
        return out if width > 1 else out[:, 0]


def tokens_of(part) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of a slice, ends included, and the token bounds of its texts."""
    bounds = part.words + np.arange(len(part) + 1)
    out = np.full(int(bounds[-1]), END, dtype=np.uint64)
    out[np.arange(len(part.starts)) + part.text_of_word()] = part.hashes()
    return out, bounds


def pairs_of(ids: np.ndarray, bounds: np.ndarray, end: int) -> np.ndarray:
    """Id of the token before each token; the end stands before the first."""
    before = np.empty_like(ids)
    before[1:] = ids[:-1]
    before[bounds[:-1]] = end
    return before


def _count_words(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = Tally()
        for batch in batches:
            for part in slices(batch.column(0), BLANK_SEPARATED, lower=True):
                if tally.add(tokens_of(part)[0]):
                    yield from tally.send(lambda k: hash_range(k, parts))
        yield from tally.send(lambda k: hash_range(k, parts))

    return run


def _write_words(folder: str):
    def run(rows: pa.Table) -> pa.Table:
        part = rows["part"][0].as_py()
        key, count = merged([unpack_sorted(b.as_py()) for b in rows["keys"]], [unpack(b.as_py()) for b in rows["counts"]])
        write_array(folder, f"words-{part}", key)
        write_array(folder, f"tokens-{part}", count.astype(np.int64))
        return pa.table({"part": pa.array([part], pa.int32()), "n": pa.array([len(key)], pa.int64()),
                         "total": pa.array([int(count.sum())], pa.int64())})

    return run


def _count_pairs(vocabulary: Vocabulary, parts: int):
    words = np.uint64(vocabulary.words)
    frequent = vocabulary.tokens / (4 * parts)

    def part_of(keys: np.ndarray) -> np.ndarray:
        first, second = keys // words, keys % words
        distinct, place = np.unique(first, return_inverse=True)
        often = vocabulary.gather("tokens", np.int64, distinct.astype(np.int64))[place] > frequent
        return hash_range(mix(np.where(often, mix(first + np.uint64(1)) ^ second, first + np.uint64(1))), parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = Tally()
        for batch in batches:
            for part in slices(batch.column(0), BLANK_SEPARATED, lower=True):
                hashes, bounds = tokens_of(part)
                distinct, place = np.unique(hashes, return_inverse=True)
                ids = vocabulary.ids(distinct)[place]
                end = int(ids[bounds[1] - 1])
                before = pairs_of(ids, bounds, end)
                if tally.add(before.astype(np.uint64) * words + ids.astype(np.uint64)):
                    yield from tally.send(part_of)
        yield from tally.send(part_of)

    return run


_STATS = "part int, ids binary, counts binary, kind int"


def _write_pairs(folder: str, vocabulary: Vocabulary):
    """Write a range of pairs; send what they say about single words to the words' ranges."""
    words, first = vocabulary.words, vocabulary.first

    def sent(kind: int, ids: np.ndarray) -> Iterator[tuple]:
        distinct, count = np.unique(ids, return_counts=True)
        bounds = np.searchsorted(distinct, first)
        for p in np.flatnonzero(np.diff(bounds)):
            some = slice(bounds[p], bounds[p + 1])
            yield int(p), pack_sorted((distinct[some] - first[p]).astype(np.uint64)), pack(count[some]), kind

    def run(rows: pa.Table) -> pa.Table:
        part = rows["part"][0].as_py()
        key, count = merged([unpack_sorted(b.as_py()) for b in rows["keys"]], [unpack(b.as_py()) for b in rows["counts"]])
        write_array(folder, f"pairs-{part}", key)
        write_array(folder, f"seen-{part}", count.astype(np.min_scalar_type(int(count.max(initial=0)))))
        before, after = (key // np.uint64(words)).astype(np.int64), (key % np.uint64(words)).astype(np.int64)
        out = [*sent(0, after), *(row for k in (1, 2, 3) for row in sent(k, before[np.minimum(count, 3) == k]))]
        counted = np.array([(count == k).sum() for k in (1, 2, 3, 4)], dtype=np.uint64)
        out.append((-1, pack_sorted(np.array([part], np.uint64)), pack(counted), 4))
        return pa.table(dict(zip(("part", "ids", "counts", "kind"), (
            pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.binary(), pa.binary(), pa.int32()),
                                           strict=True)), strict=True)))

    return run


def _write_stats(vocabulary: Vocabulary):
    """Per range of words: continuation counts and numbers of followers seen once, twice, more often."""

    def run(rows: pa.Table) -> pa.Table:
        part = rows["part"][0].as_py()
        if part < 0:  # the numbers of pairs, and the ranges of pairs that were written
            total = np.sum([unpack(b.as_py()) for b in rows["counts"]], axis=0).astype(np.int64)
            total = np.concatenate([total, *(unpack_sorted(b.as_py()).astype(np.int64) for b in rows["ids"])])
        else:
            stats = np.zeros((vocabulary.sizes[part], 4), dtype=np.int64)
            for ids, counts, kind in zip(rows["ids"], rows["counts"], rows["kind"], strict=True):
                stats[unpack_sorted(ids.as_py()).astype(np.int64), kind.as_py()] += unpack(counts.as_py()).astype(np.int64)
            write_array(vocabulary.folder, f"stats-{part}", stats.astype(np.uint32))
            total = np.array([(stats[:, 0] == k).sum() for k in (1, 2, 3, 4)] + [stats[:, 0].sum()], dtype=np.int64)
        return pa.table({"part": pa.array([part], pa.int32()), "total": pa.array([total.tolist()], pa.list_(pa.int64()))})

    return run


def discounts(n1: int, n2: int, n3: int, n4: int) -> np.ndarray:
    """Discounts of counts 0, 1, 2 and 3 or more, from the numbers of n-grams seen one to four times."""
    y = n1 / (n1 + 2 * n2) if n1 + n2 else 0.0
    least = lambda k, here, after: min(max(k - (k + 1) * y * after / here, 0.0), float(k)) if here else 0.0
    return np.array([0.0, least(1, n1, n2), least(2, n2, n3), least(3, n3, n4)])


@dataclass
class Model:
    vocabulary: Vocabulary
    pair_parts: int
    pair_discounts: np.ndarray
    word_discounts: np.ndarray
    pairs: int  #: distinct pairs
    freed: float  #: what the discounts of continuation counts free, for the uniform share

    def pair_counts(self, before: np.ndarray, after: np.ndarray, often: np.ndarray) -> np.ndarray:
        """Training counts of distinct known pairs."""
        words = np.uint64(self.vocabulary.words)
        first, second = before.astype(np.uint64), after.astype(np.uint64)
        key = first * words + second
        part = hash_range(mix(np.where(often, mix(first + np.uint64(1)) ^ second, first + np.uint64(1))), self.pair_parts)
        order = np.argsort(part, kind="stable")
        bounds = np.searchsorted(part[order], np.arange(self.pair_parts + 1))
        out = np.zeros(len(key), dtype=np.int64)
        for p in np.flatnonzero(np.diff(bounds)):
            some = order[bounds[p] : bounds[p + 1]]
            known = read_array(self.vocabulary.folder, f"pairs-{p}", np.uint64)
            if len(known):
                at = np.minimum(np.searchsorted(known, key[some]), len(known) - 1)
                seen = read_array(self.vocabulary.folder, f"seen-{p}", n=len(known))
                out[some] = np.where(known[at] == key[some], seen[at], 0)
        return out

    def score(self, hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per text: known tokens, base score and model score (log10)."""
        vocabulary = self.vocabulary
        distinct, place = np.unique(hashes, return_inverse=True)
        ids = vocabulary.ids(distinct)
        known = np.flatnonzero(ids >= 0)
        count, stats = np.zeros(len(distinct), np.int64), np.zeros((len(distinct), 4), np.int64)
        count[known] = vocabulary.gather("tokens", np.int64, ids[known])
        stats[known] = vocabulary.gather("stats", np.uint32, ids[known], 4)
        base = np.log10((count + 0.1) / (vocabulary.tokens + 0.1 * (vocabulary.words + 1)))
        continued = stats[:, 0]
        unigram = np.maximum(continued - self.word_discounts[np.minimum(continued, 3)], 0) / max(self.pairs, 1)
        unigram += self.freed / (vocabulary.words + 1)
        spared = np.where(count > 0, stats[:, 1:] @ self.pair_discounts[1:] / np.maximum(count, 1), 1.0)

        before = pairs_of(place, bounds, int(place[bounds[1] - 1]) if len(bounds) > 1 else 0)
        pair, where = np.unique(before.astype(np.int64) * len(distinct) + place, return_inverse=True)
        first, second = pair // len(distinct), pair % len(distinct)
        both = np.flatnonzero((ids[first] >= 0) & (ids[second] >= 0))
        seen = np.zeros(len(pair), np.int64)
        often = count[first[both]] > vocabulary.tokens / (4 * self.pair_parts)
        seen[both] = self.pair_counts(ids[first[both]], ids[second[both]], often)
        kept = np.maximum(seen - self.pair_discounts[np.minimum(seen, 3)], 0) / np.maximum(count[first], 1)
        logs = np.log10(kept + spared[first] * unigram[second])
        add = lambda values: np.add.reduceat(values, bounds[:-1])  # noqa: E731  every text has its end
        return add((count[place] > 0).astype(np.int64)), add(base[place]), add(logs[where])


def train(texts: DataFrame, range_bytes: int = RANGE_BYTES) -> Model:
    """Count the texts (one column, null: empty) and write the model to the shared folder."""
    spark = texts.sparkSession
    bounded_batches(spark)
    folder = local_folder(fresh_path(spark, "ngrams"))
    column = texts.columns[0]
    size = texts.agg(F.sum(F.octet_length(column))).first()[0] or 0
    parts = max(1, -(-size // range_bytes))
    counted = texts.mapInArrow(_count_words(parts), _PACKED).groupBy("part").applyInArrow(
        _write_words(folder), "part int, n long, total long"
    ).collect()
    sizes = [0] * parts
    for row in counted:
        sizes[row["part"]] = row["n"]
    vocabulary = Vocabulary(folder, sizes, sum(r["total"] for r in counted))
    if vocabulary.words >= 1 << 32:
        raise ValueError("pairs of word ids need more than 64 bits")
    for p in {*range(parts)} - {r["part"] for r in counted}:
        for name, kind in (("words", np.uint64), ("tokens", np.int64), ("stats", np.uint32)):
            write_array(folder, f"{name}-{p}", np.zeros(0, kind))
    found = texts.mapInArrow(_count_pairs(vocabulary, parts), _PACKED).groupBy("part").applyInArrow(
        _write_pairs(folder, vocabulary), _STATS
    ).groupBy("part").applyInArrow(_write_stats(vocabulary), "part int, total array<long>").collect()
    told = next((r["total"] for r in found if r["part"] < 0), [0] * 4)
    pair_counts, written = told[:4], set(told[4:])
    for p in {*range(parts)} - written:  # only these have no pairs; a missing file of another range raises when it is read
        write_array(folder, f"pairs-{p}", np.zeros(0, np.uint64))
        write_array(folder, f"seen-{p}", np.zeros(0, np.int64))
    word_counts = np.sum([r["total"] for r in found if r["part"] >= 0] or [[0] * 5], axis=0).tolist()
    word_discounts = discounts(*word_counts[:4])
    pairs = word_counts[4]
    more = vocabulary.words - sum(word_counts[:2])
    freed = (word_discounts[1:] @ np.array([word_counts[0], word_counts[1], more])) / pairs if pairs else 1.0
    return Model(vocabulary, parts, discounts(*pair_counts), word_discounts, pairs, float(freed))


def score_documents(docs: DataFrame, training: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score, perplexity of every row of ``docs``.

    ``training``: one column of texts. Null and empty texts are one end token, in training too. base_score sums
    log10((c + 0.1) / (N + 0.1 (V + 1))) over the tokens; score is the model's log10 probability of the text; the
    perplexity is 10 to minus the score per token. Without training texts all tokens are unknown and equally likely.
    Repeated rows count and are scored as often as they occur; a null id is carried through; an empty table gives an
    empty result; other columns are ignored.
    """
    model = train(training)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for part in slices(batch.column("_text"), BLANK_SEPARATED, lower=True):
                hashes, bounds = tokens_of(part)
                found.append((np.diff(bounds), *model.score(hashes, bounds)))
            n, known, base, score = map(np.concatenate, zip(*found, strict=True)) if found else ([], [], [], [])
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array(base, pa.float64()),
                pa.array(score, pa.float64()),
            ], names=["doc_id", "n_tokens", "n_known", "base_score", "score"])

    scored = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("_text")).mapInArrow(
        run, "doc_id long, n_tokens long, n_known long, base_score double, score double"
    )
    return scored.withColumn("train_tokens", F.lit(model.vocabulary.tokens).cast("long")).withColumn(
        "perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens"))
    )


def score_held_out(docs: DataFrame) -> DataFrame:
    """``score_documents`` and held_out (CRC-32 of the id as text divisible by 10), learning from the other rows."""
    held = held_out("doc_id", 10, 0)
    return score_documents(docs, docs.where(~held).select("text")).withColumn("held_out", held)
