"""Near-duplicates by SimHash and pigeonring filtering.

Fingerprint: 64 bits over the XXH64 of all 4-word shingles (see ``fingerprints``). Two fingerprints link at
``RADIUS`` = 4 or fewer differing bits. The 64 bits form a ring of five segments. By the pigeonring principle, every
pair within the radius has a segment from which each chain of l consecutive segments differs in at most
floor(l * 4 / 5) bits: none in the first, at most one in the first two, and so on. So a pair shares a whole segment,
and, as the next one differs in a bit at most, one half of that too: these two make the 19-bit index key (ten rows
per fingerprint). Rows of one key are compared by the whole chain condition, whose last link is the Hamming check.
No pair within the radius is missed.

Scale: only distinct fingerprints are indexed. Keys held by one fingerprint are dropped. Keys with more than
``BLOCK`` rows are cut into blocks, and each pair of blocks is one group of its own, so no task compares more than
2 * BLOCK rows with each other at once, and nothing is capped. A group returns a spanning star of each of its
components instead of all its pairs, so the edges grow with the rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from govspark.llm.graph import components
from govspark.llm.rows import keep_rows, mark_of
from govspark.llm.words import BLANK_SEPARATED, Slice, bounded_batches, slices
from govspark.session import fresh_path

SHINGLE = 4
SEED = 42
RADIUS = 4
SEGMENTS = 5
BLOCK = 1024
#: Lowest bit and width of each segment.
LAYOUT = [(i * 13, min(13, 64 - i * 13)) for i in range(SEGMENTS)]


def joined_words(part: Slice) -> tuple[bytes, np.ndarray, np.ndarray]:
    """All words of a slice with one space behind each, and where each starts and ends."""
    lengths = part.ends - part.starts
    ends = np.cumsum(lengths + 1) - 1
    out = np.full(int(ends[-1]) + 1 if len(ends) else 0, 0x20, dtype=np.uint8)
    place = np.ones(len(out), dtype=bool)
    place[ends] = False
    out[place] = part.data[BLANK_SEPARATED[part.data]]
    return out.tobytes(), ends - lengths, ends


def slice_fingerprints(part: Slice) -> np.ndarray:
    n_words = np.diff(part.words)
    joined, starts, ends = joined_words(part)
    n = np.where(n_words >= SHINGLE, n_words - SHINGLE + 1, np.minimum(n_words, 1))
    first = np.cumsum(n) - n
    total = int(n.sum())
    head = np.arange(total) - np.repeat(first, n) + np.repeat(part.words[:-1], n)
    tail = head + np.repeat(np.minimum(n_words, SHINGLE), n) - 1
    spans = zip(starts[head].tolist(), ends[tail].tolist(), strict=True)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, (joined[a:b] for a, b in spans), repeat(SEED)), np.uint64, total)
    out = np.zeros(len(part), dtype=np.uint64)
    some = np.flatnonzero(n)
    counts = np.zeros((len(some), 64), dtype=np.int64)
    step = 1 << 17  # shingles whose bits are unpacked at a time
    for at in range(0, total, step):
        bits = np.unpackbits(hashes[at : at + step].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        begin = np.clip(first[some] - at, 0, None)
        inside = np.flatnonzero((begin < len(bits)) & (first[some] + n[some] > at))
        counts[inside] += np.add.reduceat(bits, begin[inside], axis=0, dtype=np.int32)
    set_bits = counts * 2 > n[some][:, None]
    out[some] = np.packbits(set_bits, axis=1, bitorder="little").view(np.uint64).reshape(-1)
    return out


def _fingerprint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        codes = batch.column("_text").fill_null("").dictionary_encode()
        parts = [slice_fingerprints(p) for p in slices(codes.dictionary, BLANK_SEPARATED, lower=True)]
        values = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
        found = values[codes.indices.to_numpy(zero_copy_only=False)].view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("_mark"), pa.array(found)], names=["_id", "_mark", "_print"])


def fingerprints(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """_id, _mark (see ``rows``), _print: the 64-bit fingerprint of every row, as a signed long.

    A-Z are lower-cased; words are separated by blanks and the controls 9 to 13; shingles are four words joined by
    one space, repeats included. A bit is set if set in more than half the hashes. Fewer words make one shingle; no
    words (or a null text) make fingerprint zero.
    """
    bounded_batches(docs.sparkSession)
    read = docs.select(F.col(doc_id).cast("long").alias("_id"), mark_of(F.col(text)).alias("_mark"), F.col(text).alias("_text"))
    return read.mapInArrow(_fingerprint, "_id long, _mark long, _print long")


def _bits(at: int, width: int):
    return F.shiftrightunsigned("_print", at).bitwiseAND((1 << width) - 1)


def _keys():
    """Index keys of a fingerprint: start of the chain, its whole segment, and either half of the next one."""
    keys = []
    for i, (at, width) in enumerate(LAYOUT):
        after, wide = LAYOUT[(i + 1) % SEGMENTS]
        low = wide // 2
        for half, (begin, size) in enumerate(((after, low), (after + low, wide - low))):
            tag = F.lit((2 * i + half) << 40)
            keys.append(tag + F.shiftleft(_bits(at, width), 13) + _bits(begin, size))
    return F.array(*keys)


def chain_holds(difference: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Whether each chain of l segments from ``start`` differs in at most floor(l * RADIUS / SEGMENTS) bits."""
    per = np.stack([
        np.bitwise_count((difference >> np.uint64(at)) & np.uint64((1 << width) - 1)) for at, width in LAYOUT
    ])
    total = np.zeros(len(difference), dtype=np.int64)
    holds = np.ones(len(difference), dtype=bool)
    columns = np.arange(len(difference))
    for length in range(1, SEGMENTS + 1):
        total += per[(start + length - 1) % SEGMENTS, columns]
        holds &= total * SEGMENTS <= length * RADIUS
    return holds


def smallest_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For rows 0..n-1 linked by (a, b), the smallest row of each row's component."""
    label = np.arange(n)
    while len(a):
        least = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, a, least)
        np.minimum.at(label, b, least)
        label = label[label]
        if np.array_equal(before, label):
            break
    return label


def linked_stars(groups: np.ndarray, starts: np.ndarray, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Within each run of equal ``groups``, links every fingerprint to the first one of its component."""
    found_a, found_b = [], []
    active, distance = np.arange(len(prints)), 1
    while True:
        active = active[active + distance < len(prints)]
        active = active[groups[active] == groups[active + distance]]
        if not len(active):
            break
        near = chain_holds(prints[active] ^ prints[active + distance], starts[active])
        found_a.append(active[near])
        found_b.append(active[near] + distance)
        distance += 1
    if not found_a:
        return prints[:0], prints[:0]
    label = smallest_labels(len(prints), np.concatenate(found_a), np.concatenate(found_b))
    moved = np.flatnonzero(label != np.arange(len(prints)))
    return prints[moved], prints[label[moved]]


def _link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def linked(block: np.ndarray) -> pa.RecordBatch:
        a, b = linked_stars(block[1], block[0] >> 41, block[2].view(np.uint64))
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    rest = np.zeros((3, 0), dtype=np.int64)
    for batch in batches:
        key, low, high, prints = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64)
                                  for c in ("key", "low", "high", "_print"))
        group = key * np.int64(1_000_003) + low * np.int64(8191) + high  # only ever compared with its neighbours
        rest = np.concatenate([rest, np.stack([key, group, prints])], axis=1)
        if rest.shape[1] >= 20_000:
            changes = np.flatnonzero(rest[1][1:] != rest[1][:-1])
            cut = int(changes[-1]) + 1 if len(changes) else 0
            if cut:
                yield linked(rest[:, :cut])
                rest = rest[:, cut:]
    if rest.shape[1]:
        yield linked(rest)


def link_edges(prints: DataFrame, block: int = BLOCK) -> DataFrame:
    """a, b: links between distinct fingerprints (column _print) whose components are those of all links."""
    keyed = prints.select("_print", F.explode(_keys()).alias("key"))
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    blocks = F.ceil(F.col("n") / block).cast("int")
    own = F.pmod(F.xxhash64("_print"), F.col("blocks")).cast("int")
    spread = (
        keyed.join(sizes, "key")
        .withColumn("blocks", blocks)
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("key", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "_print")
    )
    return (
        spread.repartition("key", "low", "high")
        .sortWithinPartitions("key", "low", "high", "_print")
        .mapInArrow(_link, "a long, b long")
        .distinct()
    )


def _rooted(docs: DataFrame, text: str, doc_id: str) -> tuple[DataFrame, DataFrame]:
    """Rows (_id, _mark, _print), and for each print its node and the root of its component.

    The graph's nodes are the prints, known by the smallest id that has them (nulls last) and ordered by it. So the smallest
    node of a component holds its smallest id, and nothing is ever grouped or joined by component.
    """
    spark = docs.sparkSession
    path = fresh_path(spark, "fingerprints")
    fingerprints(docs, text, doc_id).write.parquet(path)
    rows = spark.read.parquet(path)
    node = F.struct(F.col("_least").isNull().alias("nameless"), "_least", "_print").alias("_node")
    path = fresh_path(spark, "prints")
    rows.groupBy("_print").agg(F.min("_id").alias("_least")).select("_print", node).write.parquet(path)
    nodes = spark.read.parquet(path)
    links = link_edges(nodes.select("_print"))
    for end in ("a", "b"):
        links = links.join(nodes.select(F.col("_print").alias(end), F.col("_node").alias(f"node_{end}")), end)
    roots = components(links.select(F.col("node_a").alias("a"), F.col("node_b").alias("b")))
    rooted = roots.select(F.col("node")["_print"].alias("_print"), F.col("root").alias("_root"))
    path = fresh_path(spark, "rooted")  # stored, so that a print with very many rows can be split where they are joined
    nodes.join(rooted, "_print", "left").withColumn("_root", F.coalesce("_root", "_node")).write.parquet(path)
    return rows, spark.read.parquet(path)


def near_groups(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, fingerprint (16 lowercase hex digits), component_id: the smallest doc_id reachable over links.

    Null and empty texts have fingerprint zero and link like others. A null id is carried through and ignored when
    the smallest is taken; a component of null ids only has a null component_id. Repeated rows stay repeated. An
    empty table gives an empty result.
    """
    rows, rooted = _rooted(docs, text, doc_id)
    named = rooted.select("_print", F.col("_root")["_least"].alias("component_id"))
    return rows.join(named, "_print").select(
        F.col("_id").alias("doc_id"), F.lower(F.lpad(F.hex("_print"), 16, "0")).alias("fingerprint"), "component_id"
    )


def drop_near_copies(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row of every group stays, with all its columns: one with the smallest id (nulls last).

    Of several rows with that id, those with the smallest fingerprint, then with the smallest hash of their text are left,
    and one of these stays.
    """
    rows, rooted = _rooted(docs, text, doc_id)
    first = rooted.where(F.col("_node") == F.col("_root")).select("_print", F.col("_node")["_least"].alias("_least"))
    heads = rows.join(first, "_print").where(F.col("_id").eqNullSafe(F.col("_least")))
    same = heads.groupBy("_print", "_id", "_mark").agg(F.count("*").alias("_n"))
    kept = same.groupBy("_print", "_id").agg(F.min(F.struct("_mark", "_n")).alias("_row")).select("_id", "_row.*")
    return keep_rows(docs, kept, text, doc_id)
