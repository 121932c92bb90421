"""Spelling variants: words one edit apart, found in a frequency-vector trie.

A word is described by how many of its letters fall into each letter group: first a few coarse groups, then ``FINE``
groups that refine them. Words are arranged in a trie by these counts, one level per group. One inserted code point
adds one to a single count, one deleted takes one away, one replaced does both or neither. So a depth-first search
from a word may leave its own counts by one surplus and one deficit over the coarse groups, and again over the fine
ones, and every word one edit away lies at a leaf it reaches. The words at the leaves are compared letter by letter.

Scale: the counts of the coarse groups are the shard of a word, so the first levels of the trie are a shuffle. A word
looks into its own shard and into those whose counts are larger in the first group that differs (a pair is found from
one side only). Shards are dealt to buckets of about ``BLOCK`` words; one with more words is spread over several, and
all that look into it visit each of them. A task holds the trie of one bucket and streams the visitors. Only distinct
words travel, never occurrences, and pairs are made of words that are really one edit apart.

Rows: null ids count as empty in the crc, null and empty texts have no words, repeated rows count each time, an empty
table has no words, other columns are ignored. Runs may be of any length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import partial
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from govspark.llm.streams import runs
from govspark.llm.words import LOWER as ASCII_LOWER
from govspark.llm.words import SLICE_BYTES, bounded_batches, text_buffer
from govspark.session import fresh_path

#: Of so many hashes of (document, word), one leaves out a letter.
SLIP = 97
LEAST_LENGTH, LEAST_COUNT = 5, 3
#: Distinct words a task counts up before it hands them on.
TALLY = 400_000
#: A form is at least so many times as frequent as the words it stands for.
DOMINANCE = 2

FINE = 12
#: Coarse groups (a divisor of ``FINE``) by the words they are good for: more groups make more and smaller shards, and
#: each word looks into more of them.
COARSE = ((3, 4_000_000), (4, 40_000_000), (6, 1 << 62))
#: Words of a bucket at most, and the least worth a bucket of its own where tasks are free.
BLOCK, SMALL = 1 << 16, 1 << 12
#: States of the search that are advanced together, and the longest word that is compared in numpy.
STATES, WIDE = 1 << 17, 64
#: Entries of a level's table of children; a level that needs more is searched by bisection.
TABLE = 1 << 23

LOWER = "abcdefghijklmnopqrstuvwxyz"
#: Letters from frequent to rare; the place of a letter modulo the number of groups is its group.
BY_FREQUENCY = "etaoinshrdlcumwfgypbvkjxqz"


def letter_groups(number: int) -> np.ndarray:
    """Group of every code point up to 255: letters by place in ``BY_FREQUENCY``, all others by code point."""
    group = np.arange(256) % number
    for place, letter in enumerate(BY_FREQUENCY):
        group[ord(letter)] = place % number
    return group


FINE_GROUP = letter_groups(FINE)


_CRC = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _CRC = np.where(_CRC & 1, (_CRC >> 1) ^ np.uint32(0xEDB88320), _CRC >> 1).astype(np.uint32)


def crc32_of(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """crc32 of many byte strings at once, each going on from its seed (the crc32 of what stands before it)."""
    order = np.argsort(-lengths, kind="stable")
    at, left = starts[order], lengths[order]
    state = ~seeds[order].astype(np.uint32)
    active = len(order)
    for k in range(int(left[0]) if active else 0):
        active = int(np.searchsorted(-left, -k, side="left"))  # those longer than k
        now = state[:active]
        state[:active] = _CRC[(now ^ data[at[:active] + k]) & np.uint32(255)] ^ (now >> np.uint32(8))
    out = np.empty(len(order), dtype=np.uint32)
    out[order] = ~state
    return out


def slice_words(data: np.ndarray, bounds: np.ndarray, seeds: np.ndarray) -> pa.Array:
    """The words of some texts (bytes ``data``, cut at ``bounds``), letters left out where the crc32 says so."""
    data = ASCII_LOWER[data]
    second = np.zeros(len(data), dtype=bool)
    second[1:] = data[:-1] == 0xC3  # U+00C0 to U+00FF are C3 and one more byte
    inside = np.concatenate([[False], ((data >= 0x61) & (data <= 0x7A)) | (data == 0xC3) | second, [False]])
    begins, ends = inside[1:] & ~inside[:-1], inside[:-1] & ~inside[1:]
    edges = bounds[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    both = edges[inside[edges] & inside[edges + 1]]
    begins[both] = ends[both] = True
    starts, ends = np.flatnonzero(begins), np.flatnonzero(ends)
    extra = np.concatenate([[0], np.cumsum(second)])
    lengths = ends - starts
    points = lengths - (extra[ends] - extra[starts])
    long = np.flatnonzero(points >= LEAST_LENGTH)
    starts, lengths, points = starts[long], lengths[long], points[long]
    text = np.searchsorted(bounds, starts, side="right") - 1
    hashes = crc32_of(data, starts, lengths, seeds[text])
    slips = hashes % np.uint32(SLIP) == 0
    whole = np.flatnonzero(~slips)
    sizes = lengths[whole]
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    letters = data[np.repeat(starts[whole] - offsets[:-1], sizes) + np.arange(offsets[-1])]
    kept = pa.Array.from_buffers(pa.large_string(), len(whole), [None, pa.py_buffer(offsets), pa.py_buffer(letters)])
    cut = []
    for i in np.flatnonzero(slips & (points > LEAST_LENGTH)).tolist():
        word = data[starts[i] : starts[i] + lengths[i]].tobytes().decode()
        at = int(hashes[i]) % len(word)
        cut.append(word[:at] + word[at + 1 :])
    return pa.concat_arrays([kept, pa.array(cut, pa.large_string())])


def _tally(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    summed = pa.Table.from_batches(parts).group_by("word").aggregate([("n", "sum")]).combine_chunks()
    return pa.RecordBatch.from_arrays([summed["word"].combine_chunks(), summed["n_sum"].combine_chunks()], names=["word", "n"])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words and their numbers, summed within the task as far as ``TALLY`` distinct words go."""
    parts, rows = [], 0
    for batch in batches:
        data, bounds = text_buffer(batch.column("_text"))
        seeds = np.array([zlib.crc32(x.encode()) for x in batch.column("_id").to_pylist()], dtype=np.uint32)
        at = 0
        while at < len(seeds):
            to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + SLICE_BYTES, side="right")) - 1)
            found = slice_words(data[bounds[at] : bounds[to]], bounds[at : to + 1] - bounds[at], seeds[at:to])
            counted = found.value_counts()
            parts.append(pa.RecordBatch.from_arrays([counted.field("values").cast(pa.string()), counted.field("counts")], names=["word", "n"]))
            rows += len(counted)
            at = to
            if rows > TALLY:
                parts = [_tally(parts)]
                rows = parts[0].num_rows
                if rows > TALLY // 2:
                    yield from parts
                    parts, rows = [], 0
    if parts:
        yield _tally(parts)


def words(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """word, n: the distinct words of at least ``LEAST_LENGTH`` letters and ``LEAST_COUNT`` occurrences.

    Runs of letters with A-Z lower-cased; where ``SLIP`` divides the crc32 of ``<doc_id>:<run>``, the letter at crc32
    modulo length is left out.
    """
    bounded_batches(docs.sparkSession)
    before = F.concat(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.lit(":"))
    counted = docs.select(before.alias("_id"), F.col(text).alias("_text")).mapInArrow(_count, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


# --- the trie of one block --------------------------------------------------------------------------------------


def letter_counts(latin: list[bytes]) -> np.ndarray:
    """Counts of the fine groups, one row per word (given in Latin-1)."""
    lengths = np.fromiter(map(len, latin), np.int64, len(latin))
    row = np.repeat(np.arange(len(latin)), lengths)
    group = FINE_GROUP[np.frombuffer(b"".join(latin), np.uint8)]
    return np.bincount(row * FINE + group, minlength=len(latin) * FINE).reshape(-1, FINE)


def coarse_counts(counts: np.ndarray, coarse: int) -> np.ndarray:
    """Sums of the fine counts that refine each coarse group."""
    return counts.reshape(len(counts), -1, coarse).sum(axis=1)


class Trie:
    """Words arranged by their counts; level k branches by the count of group k, coarse groups first."""

    def __init__(self, latin: list[bytes], coarse: int):
        counts = letter_counts(latin)
        levels = np.concatenate([coarse_counts(counts, coarse), counts], axis=1)
        order = np.lexsort(levels.T[::-1])
        self.coarse = coarse
        self.latin = [latin[i] for i in order.tolist()]
        self.levels = levels = levels[order]
        self.base = int(levels.max(initial=0)) + 2
        self.edges: list[np.ndarray] = []  # per level: node * base + count of each child, in order
        self.tables: list[np.ndarray | None] = []  # the child of each node * base + count, or -1
        node, nodes = np.zeros(len(levels), dtype=np.int64), 1
        for level in range(levels.shape[1]):
            edge = node * self.base + levels[:, level]
            edges = np.unique(edge)
            table = None
            if nodes * self.base <= TABLE:
                table = np.full(nodes * self.base, -1, dtype=np.int32)
                table[edges] = np.arange(len(edges))
            self.edges.append(edges)
            self.tables.append(table)
            node, nodes = np.searchsorted(edges, edge), len(edges)
        #: Words of leaf x are first[x] to first[x + 1].
        self.first = np.searchsorted(node, np.arange(nodes + 1))

    def children(self, level: int, edge: np.ndarray) -> np.ndarray:
        """The node each edge leads to, or -1."""
        if (table := self.tables[level]) is not None:
            return table[edge]
        edges = self.edges[level]
        child = np.minimum(np.searchsorted(edges, edge), len(edges) - 1)
        return np.where(edges[child] == edge, child, -1)

    def reach(self, levels: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (row of ``levels``, word) whose coarse and whose fine counts differ by a surplus and a deficit of one
        at most; the first coarse count that differs is larger in the trie."""
        ones = np.ones(len(levels), dtype=np.int8)
        stack = [(0, np.arange(len(levels)), np.zeros(len(levels), np.int64), ones, ones)]
        while stack:
            level, row, node, surplus, deficit = stack.pop()
            if len(row) > STATES:
                half = len(row) // 2
                stack += [(level, row[s], node[s], surplus[s], deficit[s]) for s in (slice(half), slice(half, None))]
                continue
            if level == len(self.edges):
                yield from self._leaves(row, node)
                continue
            if level == self.coarse:
                surplus = deficit = np.ones(len(row), dtype=np.int8)
            own, found = levels[row, level], []
            more = (surplus > 0) & (own < self.base - 1)
            less = (deficit > 0) & (own > 0) & (own <= self.base)
            if level < self.coarse:
                less &= surplus == 0
            for step, may in ((0, own < self.base), (1, more), (-1, less)):
                pick = np.flatnonzero(may)
                child = self.children(level, node[pick] * self.base + own[pick] + step)
                hit = child >= 0
                pick = pick[hit]
                found.append((row[pick], child[hit], surplus[pick] - (step > 0), deficit[pick] - (step < 0)))
            states = [np.concatenate(x) for x in zip(*found)]
            if len(states[0]):
                stack.append((level + 1, *states))

    def _leaves(self, row: np.ndarray, leaf: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        size = self.first[leaf + 1] - self.first[leaf]
        ends = np.cumsum(size)
        at = 0
        while at < len(row):  # so many leaves at a time as hold about STATES words
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + STATES, side="right")))
            part = size[at:to]
            inside = np.arange(int(part.sum())) - np.repeat(np.cumsum(part) - part, part)
            yield np.repeat(row[at:to], part), np.repeat(self.first[leaf[at:to]], part) + inside
            at = to


def matrix(latin: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Letters of the words, one row each, cut at ``WIDE`` and filled up with zeros; and the whole lengths."""
    lengths = np.fromiter(map(len, latin), np.int64, len(latin))
    width = int(min(WIDE, max(1, lengths.max(initial=1))))
    cut = np.array([w[:width] for w in latin], dtype=f"S{width}") if latin else np.zeros(0, "S1")
    return cut.view(np.uint8).reshape(len(latin), -1), lengths


def one_edit(a: bytes, b: bytes) -> bool:
    """Whether exactly one inserted, deleted or replaced letter turns a into b."""
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    at = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[at + (len(a) == len(b)) :] == b[at + 1 :]


def verified(a: list[bytes], b: list[bytes], left: np.ndarray, right: np.ndarray,
             forms_a: tuple[np.ndarray, np.ndarray], forms_b: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Which of the pairs a[left], b[right] are exactly one edit apart."""
    (letters_a, long_a), (letters_b, long_b) = forms_a, forms_b
    holds = np.zeros(len(left), dtype=bool)
    size_a, size_b = long_a[left], long_b[right]
    wide = np.flatnonzero((size_a > WIDE) | (size_b > WIDE))
    holds[wide] = [one_edit(a[i], b[j]) for i, j in zip(left[wide].tolist(), right[wide].tolist())]
    narrow = np.maximum(size_a, size_b) <= WIDE
    width = max(letters_a.shape[1], letters_b.shape[1])

    def rows(letters: np.ndarray, picked: np.ndarray) -> np.ndarray:
        out = np.zeros((len(picked), width + 1), dtype=np.uint8)
        out[:, : letters.shape[1]] = letters[picked]
        return out

    same = np.flatnonzero(narrow & (size_a == size_b))
    holds[same] = (rows(letters_a, left[same]) != rows(letters_b, right[same])).sum(axis=1) == 1
    for unequal, shorter, longer in ((size_b - size_a == 1, (letters_a, left), (letters_b, right)),
                                     (size_a - size_b == 1, (letters_b, right), (letters_a, left))):
        pick = np.flatnonzero(narrow & unequal)
        short, long = rows(shorter[0], shorter[1][pick]), rows(longer[0], longer[1][pick])
        # The letters before the first difference agree as they stand, those after it moved by one.
        before = np.logical_and.accumulate(short == long, axis=1).sum(axis=1)
        after = np.logical_and.accumulate((short[:, :-1] == long[:, 1:])[:, ::-1], axis=1).sum(axis=1)
        holds[pick] = before + after >= width
    return holds


# --- shards and buckets -------------------------------------------------------------------------------------------


def _steps(coarse: int) -> list[tuple[int, ...]]:
    """Changes of the coarse counts by one surplus and one deficit at most, without those that are larger the other
    way round: of a change and its opposite only the one whose first entry other than zero is positive."""
    within = (s for s in product((-1, 0, 1), repeat=coarse) if s.count(1) <= 1 and s.count(-1) <= 1)
    return [s for s in within if s >= (0,) * coarse]


def _find(batches: Iterator[pa.RecordBatch], coarse: int) -> Iterator[pa.RecordBatch]:
    """Pairs of each bucket: its own words come first (visit 0), then the visitors, some of them repeatedly."""
    owned: dict[bytes, int] = {}
    trie, open_bucket, last = None, None, None
    for (bucket, visit), piece in runs(batches, "bucket", "visit"):
        if bucket != open_bucket:
            owned, trie, open_bucket, last = {}, None, bucket, None
        latin = [w.encode("latin-1") for w in piece.column("word").to_pylist()]
        n = piece.column("n").to_numpy()
        if visit == 0:
            owned.update(zip(latin, n.tolist()))
            continue
        if not owned:
            continue
        if trie is None:
            trie = Trie(list(owned), coarse)
            forms = matrix(trie.latin)
            weight = np.fromiter((owned[w] for w in trie.latin), np.int64, len(trie.latin))
        new = [i for i, (w, before) in enumerate(zip(latin, [last, *latin])) if w != before]
        last = latin[-1]
        latin, n = [latin[i] for i in new], n[new]
        counts, own_forms, found = letter_counts(latin), matrix(latin), []
        levels = np.concatenate([coarse_counts(counts, coarse), counts], axis=1)
        for left, right in trie.reach(levels):
            good = verified(latin, trie.latin, left, right, own_forms, forms)
            left, right = left[good], right[good]
            # Two words of the same coarse counts find each other: keep the pair once.
            twice = (levels[left, :coarse] == trie.levels[right, :coarse]).all(axis=1)
            twice[twice] = [latin[i] > trie.latin[j] for i, j in zip(left[twice].tolist(), right[twice].tolist())]
            found.append((left[~twice], right[~twice]))
        left, right = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 2
        yield pa.RecordBatch.from_arrays(
            [pa.array([latin[i].decode("latin-1") for i in left.tolist()], pa.string()), pa.array(n[left]),
             pa.array([trie.latin[j].decode("latin-1") for j in right.tolist()], pa.string()), pa.array(weight[right])],
            names=["word", "n", "near", "near_n"],
        )


def near_pairs(vocabulary: DataFrame, block: int = BLOCK, small: int = SMALL) -> DataFrame:
    """word, n, near, near_n: every pair of distinct words one edit apart, once. ``vocabulary``: word, n, stored."""
    tasks = int(vocabulary.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = vocabulary.count()
    buckets = max(1, -(-size // block), min(tasks, -(-size // small)))
    coarse = next(groups for groups, most in COARSE if size <= most)
    group = letter_groups(coarse)
    letters = ["".join(chr(c) for c in range(256) if group[c] == g and (chr(c) in LOWER or c >= 0xC0)) for g in range(coarse)]
    counts = [F.length("word") - F.length(F.translate("word", own, "")) for own in letters]
    counted = vocabulary.select("word", "n", F.array(*counts).alias("c"))
    own = [F.col("c")[g] for g in range(coarse)]
    shard = F.xxhash64(*own)
    spread = counted.groupBy(shard.alias("shard")).agg(
        F.least(F.ceil(F.count("*") / block), F.lit(buckets)).cast("int").alias("spread"))
    looks = F.array(*(F.xxhash64(*(c + d for c, d in zip(own, step))) for step in _steps(coarse)))
    bucket = ((F.pmod("shard", F.lit(buckets)) + F.col("part")) % buckets).cast("int").alias("bucket")
    visits = (
        counted.select("word", "n", F.explode(looks).alias("shard")).join(spread, "shard")
        .withColumn("part", F.explode(F.sequence(F.lit(0), F.col("spread") - 1)))
        .select(bucket, F.lit(1).alias("visit"), "word", "n")
    )
    homes = (
        counted.withColumn("shard", shard).join(spread, "shard")
        .withColumn("part", F.pmod(F.xxhash64("word", F.lit(1)), F.col("spread")))
        .select(bucket, F.lit(0).alias("visit"), "word", "n")
    )
    return (
        homes.unionByName(visits).repartition("bucket").sortWithinPartitions("bucket", "visit", "word")
        .mapInArrow(partial(_find, coarse=coarse), "word string, n long, near string, near_n long")
    )


def _roots(forms: DataFrame) -> DataFrame:
    """word, root: the end of each word's chain of forms. Frequencies at least double along a chain, so it has no
    cycle and the number of rounds grows with the logarithm of its length."""
    spark = forms.sparkSession
    now = forms.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:
        path = fresh_path(spark, "variant-roots")
        onward = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        now.join(onward, "root", "left").select(
            "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")
        ).write.parquet(path)
        stored = spark.read.parquet(path)
        now = stored.select("word", "root")
        if stored.where("moved").isEmpty():
            return now


def spelling_variants(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """word, form, root, n, n_near, form_n for every word of :func:`words`.

    form: the near word of largest n (ties: smallest in code-point order), if that is at least ``DOMINANCE`` times
    the word's n, else null; root: the end of the chain of forms, the word itself without one.
    """
    spark = docs.sparkSession
    path = fresh_path(spark, "variant-words")
    words(docs, text, doc_id).write.parquet(path)
    vocabulary = spark.read.parquet(path)
    pairs = near_pairs(vocabulary)
    sides = F.array(F.struct("word", F.col("near").alias("other"), F.col("near_n").alias("other_n")),
                    F.struct(F.col("near").alias("word"), F.col("word").alias("other"), F.col("n").alias("other_n")))
    best = (
        pairs.select(F.explode(sides).alias("s")).select("s.*").groupBy("word")
        .agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("rank"), "other")).alias("top"))
    )
    wins = -F.col("top.rank") >= DOMINANCE * F.col("n")
    path = fresh_path(spark, "variant-forms")
    vocabulary.join(best, "word", "left").select(
        "word", F.when(wins, F.col("top.other")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(wins, -F.col("top.rank")).alias("form_n"),
    ).write.parquet(path)
    forms = spark.read.parquet(path)
    return forms.join(_roots(forms), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
