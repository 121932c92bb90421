"""Removal of repeated passages by phrase automata.

A window is ``WINDOW`` consecutive words of one document. Every word covered by a window whose words also start
anywhere else, in the same document or another, is removed; windows are judged on the input.

Each window is anchored at its phrase of ``PHRASE`` words with the smallest hash (the leftmost of equal ones), so
equal windows have equal anchors, and consecutive windows mostly share one: a run. About one word in twelve is
an anchor, and only anchors are counted over the whole corpus.

1. Confirm phrases. Tasks send, per bucket of documents, the distinct anchors with their number and the smallest
   and largest hash of the whole run. An anchor that occurs once makes all its windows unique. One whose runs are all
   equal makes all its windows recurring. Only the others need their windows compared.
2. Confirm windows of those others by counting them, and fetch the words of every confirmed phrase, once, from one
   bucket that holds it.
3. Compile and stream. Each bucket of documents gets the words of the confirmed phrases that its documents may hold,
   compiled into an Aho-Corasick automaton over spelt word numbers: the dictionary is sharded by where it is needed, so no
   document meets phrases it cannot hold, and the work stays in proportion to the input. All documents stream
   through their bucket's automaton, which locates every occurrence of a phrase by its words, not by hash. A window
   recurs if its anchor is located and its windows are confirmed.

Scale: the text is staged once with stable row numbers, then only scanned; shuffles carry packed hashes (about six
bytes an anchor, fourteen in the first round). A phrase that a third of all documents share is one row per bucket of
``BUCKET`` documents. What a task keeps is one bucket's phrases and one slice of text. Side files lie in the shared
folder, which must be a mounted file system, and appear under their final name only when complete.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import ahocorasick
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
from govspark.llm.words import BLANK_SEPARATED, Slice, bounded_batches, mix, run_hashes, slices
from govspark.session import fresh_path

WINDOW = 35
PHRASE = 12
BUCKET = 2048
RANGE_BYTES = 16 << 20

_ANCHORS = "part int, bucket long, keys binary, counts binary, low binary, high binary"
_SHARED = "bucket long, keys binary, flags binary"
_WINDOWS = "part int, bucket long, kind int, keys binary, counts binary"
_CONFIRMED = "bucket long, kind int, keys binary, words binary"


def leftmost_least(values: np.ndarray, length: int) -> np.ndarray:
    """Position of the leftmost smallest of ``length`` values from each start (short at the end of the array)."""
    least, at = values, np.arange(len(values))
    size = 1
    out, place, done = None, None, 0
    rest = length
    while True:
        if rest & 1:
            if out is None:
                out, place, done = least, at, size
            else:
                n = min(len(out), len(least) - done)
                left = out[:n] <= least[done : done + n]
                out, place = np.where(left, out[:n], least[done : done + n]), np.where(left, place[:n], at[done : done + n])
                done += size
        rest >>= 1
        if not rest:
            return place
        n = len(least) - size
        if n <= 0:
            return np.zeros(0, np.int64)
        left = least[:n] <= least[size:]
        least, at = np.where(left, least[:n], least[size:]), np.where(left, at[:n], at[size:])
        size *= 2


class Windows:
    """The windows of a slice and their anchors."""

    def __init__(self, part: Slice, window: int, phrase: int) -> None:
        self.hashes = part.hashes()
        self.starts = part.runs(window)
        self.window = window
        n = len(self.hashes)
        if not len(self.starts):
            self.grams, self.anchors = np.zeros(0, np.uint64), np.zeros(0, np.int64)
            return
        self.grams = run_hashes(self.hashes, np.arange(n - phrase + 1), phrase)
        self.anchors = leftmost_least(self.grams, window - phrase + 1)[self.starts]

    def runs(self) -> tuple[np.ndarray, np.ndarray]:
        """Anchor hash and hash of the whole run (its words, and where the anchor stands) of every run."""
        first = np.flatnonzero(np.concatenate([
            [True], (np.diff(self.anchors) != 0) | (np.diff(self.starts) != 1)
        ])) if len(self.starts) else np.zeros(0, np.int64)
        last = np.append(first[1:], len(self.starts))[: len(first)] - 1
        start = self.starts[first]
        whole = run_hashes(self.hashes, start, self.starts[last] - start + self.window)
        anchor = self.anchors[first]
        return self.grams[anchor], mix(whole + (anchor - start).astype(np.uint64))

    def keys(self, some: np.ndarray) -> np.ndarray:
        """Hash of the given windows and their anchors."""
        return mix(run_hashes(self.hashes, self.starts[some], self.window) ^ mix(self.grams[self.anchors[some]]))


def _by_bucket(batches: Iterator[pa.RecordBatch], bucket_rows: int) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Rows of one bucket at a time (a bucket may come in several pieces)."""
    for batch in batches:
        bucket = batch.column("_row").to_numpy() // bucket_rows
        cuts = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(bucket)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if b > a:
                yield int(bucket[a]), batch.slice(a, b - a)


def _runs_of(pieces: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """Merge (key, count, low, high) pieces by key."""
    key, count, low, high = (np.concatenate(c) for c in zip(*pieces, strict=True))
    order = np.argsort(key, kind="stable")
    key, count, low, high = key[order], count[order], low[order], high[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    if not len(first):
        return key, count, low, high
    return (key[first], np.add.reduceat(count, first), np.minimum.reduceat(low, first), np.maximum.reduceat(high, first))


def _split(parts: np.ndarray) -> list[tuple[int, np.ndarray]]:
    order = np.argsort(parts, kind="stable")
    values, first = np.unique(parts[order], return_index=True)
    return list(zip(values.tolist(), np.split(order, first[1:]), strict=True)) if len(values) else []


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    names, types = zip(*(f.split() for f in schema.split(", ")), strict=True)
    columns = zip(*rows, strict=True) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, t in zip(columns, types, strict=True)], names=names)


def _send_anchors(window: int, phrase: int, parts: int, bucket_rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        at = None

        def send() -> pa.RecordBatch:
            nonlocal held
            key, count, low, high = _runs_of(held)
            held = []
            rows = []
            for part, some in _split(hash_range(key, parts)):
                # Equal runs within the bucket need no second hash.
                spread = np.where(low[some] == high[some], np.uint64(0), high[some] - low[some])
                rows.append((part, at, pack_sorted(key[some]), pack(count[some]), pack(low[some]), pack(spread)))
            return _batch(rows, _ANCHORS)

        for bucket, batch in _by_bucket(batches, bucket_rows):
            if bucket != at:
                if held:
                    yield send()
                at = bucket
            for part in slices(batch.column("text"), BLANK_SEPARATED):
                gram, whole = Windows(part, window, phrase).runs()
                held.append(_runs_of([(gram, np.ones(len(gram), np.uint64), whole, whole)]))
        if held:
            yield send()

    return run


def _to_buckets(bucket: np.ndarray, key: np.ndarray, flags: np.ndarray) -> Iterator[tuple]:
    for b, some in _split(bucket):
        order = some[np.argsort(key[some], kind="stable")]
        yield b, pack_sorted(key[order]), pack(flags[order])


def _share_anchors(folder: str):
    """Anchors that occur more than once: to every bucket that holds them, with flags (1: runs differ, 2: this bucket
    tells the words), and their holders to a file for the next round."""

    def run(rows: pa.Table) -> pa.Table:
        part = rows["part"][0].as_py()
        pieces, buckets = [], []
        for bucket, keys, counts, low, spread in zip(*(rows[c] for c in ("bucket", "keys", "counts", "low", "high")),
                                                      strict=True):
            key, least = unpack_sorted(keys.as_py()), unpack(low.as_py())
            pieces.append((key, unpack(counts.as_py()), least, least + unpack(spread.as_py())))
            buckets.append(np.full(len(key), bucket.as_py(), np.int64))
        known, total, low, high = _runs_of(pieces)
        key, bucket = np.concatenate([p[0] for p in pieces]), np.concatenate(buckets)
        at = np.searchsorted(known, key)
        again = total[at] > 1
        key, bucket, at = key[again], bucket[again], at[again]
        order = np.lexsort((bucket, key))
        key, bucket, at = key[order], bucket[order], at[order]
        once = np.ones(len(key), bool)  # a bucket split over two tasks tells an anchor twice
        once[1:] = (key[1:] != key[:-1]) | (bucket[1:] != bucket[:-1])
        key, bucket, at = key[once], bucket[once], at[once]
        first = np.ones(len(key), bool)
        first[1:] = key[1:] != key[:-1]
        write_array(folder, f"held-keys-{part}", key)
        write_array(folder, f"held-buckets-{part}", bucket)
        flags = (low[at] != high[at]).astype(np.uint64) + first * np.uint64(2)
        return pa.Table.from_batches([_batch(list(_to_buckets(bucket, key, flags)), _SHARED)])

    return run


def _write_anchors(folder: str):
    def run(rows: pa.Table) -> pa.Table:
        bucket = rows["bucket"][0].as_py()
        key = np.concatenate([unpack_sorted(k.as_py()) for k in rows["keys"]])
        flags = np.concatenate([unpack(f.as_py()) for f in rows["flags"]]).astype(np.uint8)
        order = np.argsort(key, kind="stable")
        write_array(folder, f"anchors-{bucket}", key[order])
        write_array(folder, f"flags-{bucket}", flags[order])
        return pa.table({"bucket": pa.array([bucket], pa.int64())})

    return run


def _find(known: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Place of each value in the sorted ``known``, or -1."""
    if not len(known):
        return np.full(len(values), -1, dtype=np.int64)
    at = np.minimum(np.searchsorted(known, values), len(known) - 1)
    return np.where(known[at] == values, at, -1)


def _words_at(part: Slice, start: int, length: int) -> bytes:
    return b" ".join(part.data[a:b].tobytes() for a, b in
                     zip(part.starts[start : start + length].tolist(), part.ends[start : start + length].tolist(),
                         strict=True))


def _send_windows(window: int, phrase: int, parts: int, bucket_rows: int, folder: str, filled: Callable[[int], bool]):
    """Windows whose anchors have differing runs, and the words of the phrases this bucket tells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, told = None, set()
        keys: list[np.ndarray] = []
        counts: list[np.ndarray] = []

        def send() -> pa.RecordBatch:
            nonlocal keys, counts
            key, count = merged(keys, counts)
            keys, counts = [], []
            return _batch([(p, at, 0, pack_sorted(key[some]), pack(count[some]))
                           for p, some in _split(hash_range(key, parts))], _WINDOWS)

        for bucket, batch in _by_bucket(batches, bucket_rows):
            if bucket != at:
                if keys:
                    yield send()
                at, told = bucket, set()
            if not filled(bucket):
                continue
            known, flags = read_array(folder, f"anchors-{bucket}", np.uint64), read_array(folder, f"flags-{bucket}", np.uint8)
            for part in slices(batch.column("text"), BLANK_SEPARATED):
                found = Windows(part, window, phrase)
                place = _find(known, found.grams[found.anchors])
                differ = np.flatnonzero((place >= 0) & (flags[place] & 1 > 0))
                key, count = np.unique(found.keys(differ), return_counts=True)
                keys.append(key)
                counts.append(count.astype(np.uint64))
                tell, first = np.unique(np.where((place >= 0) & (flags[place] & 2 > 0), place, -1), return_index=True)
                fresh = [(p, w) for p, w in zip(tell.tolist(), first.tolist(), strict=True) if p >= 0 and p not in told]
                if fresh:
                    told.update(p for p, _ in fresh)
                    own = known[[p for p, _ in fresh]]
                    texts = [_words_at(part, int(found.anchors[w]), phrase) for _, w in fresh]
                    rows = [(p, at, 1, pack_sorted(own[some]), b"\n".join(texts[i] for i in some))
                            for p, some in _split(hash_range(own, parts))]
                    yield _batch(rows, _WINDOWS)
        if keys:
            yield send()

    return run


def _confirm(folder: str):
    """Windows that occur more than once, and the words of each phrase, to every bucket that holds them."""

    def run(rows: pa.Table) -> pa.Table:
        part = rows["part"][0].as_py()
        out: list[tuple] = []
        keys, counts, buckets, told = [], [], [], {}
        for bucket, kind, packed, data in zip(*(rows[c] for c in ("bucket", "kind", "keys", "counts")), strict=True):
            key = unpack_sorted(packed.as_py())
            if kind.as_py():
                told.update(zip(key.tolist(), data.as_py().split(b"\n"), strict=True))
            else:
                keys.append(key)
                counts.append(unpack(data.as_py()))
                buckets.append(np.full(len(key), bucket.as_py(), np.int64))
        if keys:
            known, total = merged(keys, counts)
            key, bucket = np.concatenate(keys), np.concatenate(buckets)
            again = total[np.searchsorted(known, key)] > 1
            out += [(b, 0, k, b"") for b, k, _ in _to_buckets(bucket[again], key[again], np.zeros(again.sum(), np.uint64))]
        if told:
            held, bucket = read_array(folder, f"held-keys-{part}", np.uint64), read_array(folder, f"held-buckets-{part}", np.int64)
            for b, some in _split(np.asarray(bucket)):
                lines = b"\n".join(told[int(k)] for k in held[some])
                out.append((b, 1, pack_sorted(np.asarray(held[some])), pa.compress(lines, "zstd", asbytes=True)
                            + len(lines).to_bytes(8, "little")))
        return pa.Table.from_batches([_batch(out, _CONFIRMED)])

    return run


def _write_confirmed(folder: str):
    def run(rows: pa.Table) -> pa.Table:
        bucket = rows["bucket"][0].as_py()
        windows, phrases, texts = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)], []
        for kind, packed, words in zip(rows["kind"], rows["keys"], rows["words"], strict=True):
            key = unpack_sorted(packed.as_py())
            if kind.as_py():
                data = words.as_py()
                size = int.from_bytes(data[-8:], "little")
                phrases.append(key)
                texts += pa.decompress(data[:-8], size, "zstd", asbytes=True).split(b"\n")
            else:
                windows.append(key)
        order = np.argsort(np.concatenate(phrases), kind="stable")
        write_array(folder, f"windows-{bucket}", np.unique(np.concatenate(windows)))
        write_array(folder, f"phrases-{bucket}", np.concatenate(phrases)[order])
        lines = b"\n".join(texts[i] for i in order)
        write_array(folder, f"words-{bucket}", np.frombuffer(lines, np.uint8))
        return pa.table({"bucket": pa.array([bucket], pa.int64())})

    return run


class Automaton:
    """The confirmed phrases of one bucket. A word is spelt by three letters of its number, each from an alphabet of
    its own, so that no node has many children and a match can only begin at a word; unknown words are number 0."""

    LETTERS = np.array([0x100, 0x4000, 0x8000], dtype=np.uint32)

    def __init__(self, lines: list[bytes]) -> None:
        self.numbers: dict[bytes, int] = {}
        phrases = [[self.numbers.setdefault(w, len(self.numbers) + 1) for w in line.split(b" ")] for line in lines]
        self.length = len(phrases[0]) if phrases else 0
        self.base = max(2, int(np.ceil((len(self.numbers) + 1) ** (1 / 3))) + 1)
        self.machine = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for i, phrase in enumerate(phrases):
            self.machine.add_word(self.spell(np.array(phrase)), i)
        if phrases:
            self.machine.make_automaton()

    def spell(self, numbers: np.ndarray) -> str:
        digits = np.stack([numbers // self.base**2, numbers // self.base % self.base, numbers % self.base], axis=1)
        return (digits.astype(np.uint32) + self.LETTERS).astype("<u4").tobytes().decode("utf-32-le")

    def locate(self, part: Slice, hashes: np.ndarray) -> np.ndarray:
        """For every word of a slice, the phrase that starts there, or -1."""
        out = np.full(len(hashes), -1, dtype=np.int64)
        if not self.length:
            return out
        _, first, place = np.unique(hashes, return_index=True, return_inverse=True)
        number = np.array([self.numbers.get(part.data[a:b].tobytes(), 0) for a, b in
                           zip(part.starts[first].tolist(), part.ends[first].tolist(), strict=True)], dtype=np.int64)[place]
        for a, b in zip(part.words[:-1].tolist(), part.words[1:].tolist(), strict=True):
            if b - a >= self.length:
                found = list(self.machine.iter(self.spell(number[a:b])))
                if found:
                    ends, which = zip(*found, strict=True)
                    out[(np.array(ends) + 1) // 3 + (a - self.length)] = which
        return out


def kept_text(part: Slice, keep: np.ndarray) -> list[str]:
    """The kept words of each text of a slice, joined by one space."""
    lengths = np.where(keep, part.ends - part.starts + 1, 0)
    bounds = np.concatenate([[0], np.cumsum(lengths)])
    out = np.full(int(bounds[-1]), 0x20, dtype=np.uint8)
    inside = np.ones(len(out), bool)
    inside[bounds[1:][keep] - 1] = False
    delta = np.zeros(len(part.data) + 1, dtype=np.int64)
    np.add.at(delta, part.starts[keep], 1)
    np.add.at(delta, part.ends[keep], -1)
    out[inside] = part.data[np.cumsum(delta[:-1]) > 0]
    edges = bounds[part.words]
    whole = out.tobytes()
    return [whole[a : max(a, b - 1)].decode() for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]


def _remove(window: int, phrase: int, bucket_rows: int, folder: str, filled: Callable[[int], bool]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, automaton, differ, confirmed = None, None, np.zeros(0, bool), np.zeros(0, np.uint64)
        for bucket, batch in _by_bucket(batches, bucket_rows):
            if bucket != at:
                at, lines = bucket, []
                if filled(bucket):
                    phrases = read_array(folder, f"phrases-{bucket}", np.uint64)
                    lines = read_array(folder, f"words-{bucket}", np.uint8).tobytes().split(b"\n") if len(phrases) else []
                    known, flags = read_array(folder, f"anchors-{bucket}", np.uint64), read_array(folder, f"flags-{bucket}", np.uint8)
                    differ = flags[np.searchsorted(known, phrases)] & 1 > 0 if len(phrases) else np.zeros(0, bool)
                    confirmed = read_array(folder, f"windows-{bucket}", np.uint64)
                automaton = Automaton(lines)
            n_words, n_removed, texts = [], [], []
            for part in slices(batch.column("text"), BLANK_SEPARATED):
                found = Windows(part, window, phrase)
                located = automaton.locate(part, found.hashes)[found.anchors] if len(found.starts) else np.zeros(0, np.int64)
                recurs = located >= 0
                unsure = np.flatnonzero(recurs & (differ[located] if len(differ) else False))
                recurs[unsure] = _find(confirmed, found.keys(unsure)) >= 0
                covered = np.zeros(len(found.hashes) + 1, dtype=np.int64)
                np.add.at(covered, found.starts[recurs], 1)
                np.add.at(covered, found.starts[recurs] + window, -1)
                keep = np.cumsum(covered[:-1]) == 0
                kept = np.concatenate([[0], np.cumsum(keep)])[part.words]
                n_words.append(np.diff(part.words))
                n_removed.append(np.diff(part.words) - np.diff(kept))
                texts += kept_text(part, keep)
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array(np.concatenate(n_words), pa.int64()),
                pa.array(np.concatenate(n_removed), pa.int64()), pa.array(texts, pa.string()),
            ], names=["doc_id", "n_words", "n_removed", "kept_text"])

    return run


def remove_repeats(docs: DataFrame, window: int = WINDOW, phrase: int = PHRASE, bucket_rows: int = BUCKET,
                   range_bytes: int = RANGE_BYTES, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_words, n_removed, kept_text of every row.

    Words are what stands between blanks and the controls 9 to 13, unchanged; kept words are joined by one space. Null
    and empty texts have no words; a text shorter than a window loses none. Repeated rows repeat each other's
    windows, so all of them lose them. A null id is carried through; an empty table gives an empty result; other
    columns are ignored.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    staged_path, side = fresh_path(spark, "staged"), fresh_path(spark, "phrases")
    folder = local_folder(side)
    docs.select(F.monotonically_increasing_id().alias("_row"), F.col(doc_id).cast("long").alias("doc_id"),
                F.coalesce(F.col(text), F.lit("")).alias("text")).write.option("compression", "zstd").parquet(staged_path)
    staged = spark.read.parquet(staged_path)
    size = staged.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-size // range_bytes))

    shared = staged.mapInArrow(_send_anchors(window, phrase, parts, bucket_rows), _ANCHORS)
    shared = shared.groupBy("part").applyInArrow(_share_anchors(folder), _SHARED)
    shared.groupBy("bucket").applyInArrow(_write_anchors(folder), "bucket long").write.parquet(f"{side}/round-1")
    filled_buckets = spark.read.parquet(f"{side}/round-1").toArrow()["bucket"].to_numpy()  # eight bytes for 2048 rows
    write_array(folder, "buckets", np.sort(filled_buckets.astype(np.int64)))
    filled = _listed(folder)
    windows = staged.mapInArrow(_send_windows(window, phrase, parts, bucket_rows, folder, filled), _WINDOWS)
    confirmed = windows.groupBy("part").applyInArrow(_confirm(folder), _CONFIRMED)
    confirmed.groupBy("bucket").applyInArrow(_write_confirmed(folder), "bucket long").write.parquet(f"{side}/round-2")
    return staged.mapInArrow(_remove(window, phrase, bucket_rows, folder, filled),
                             "doc_id long, n_words long, n_removed long, kept_text string")


def _listed(folder: str) -> Callable[[int], bool]:
    """Whether a bucket holds any shared anchor, by the list of those that do. A file of such a bucket must be there: one that
    is missing raises, it does not count as empty."""

    def filled(bucket: int) -> bool:
        return _find(read_array(folder, "buckets", np.int64), np.array([bucket]))[0] >= 0

    return filled
