"""Exact deduplication by an extendible-hash index on shared files.

A text's key is the first 64 bits of its SHA-256. The directory maps the leading bits of a key to a bucket: it starts
with one cell, and as long as a bucket holds more than ``capacity`` bytes, that bucket is split by one more bit; when
the bucket already used all bits of the directory, the directory doubles. The directory is planned from byte counts
per key prefix, so each text is written once, into its final bucket.

One owner task per bucket gets the bucket's texts in key order, appends them to the index on shared files, chains
texts that share a key and tells the members of a chain apart by comparing their bytes. A row finds its entry by key
and digest of its own text.

Scale: copies within one Arrow batch are merged before anything is shuffled, so a text that fills a third of the
corpus reaches its owner as one row per batch. An owner keeps one chain in memory, never a bucket. Files are written by Spark's committer in ``spark.checkpoint.dir``: a lost
executor costs its tasks, nothing else. The directory has at most ``2 ** MAX_BITS`` cells, so it can be broadcast; for
larger inputs the capacity grows instead, which only makes an owner's sorted stream longer.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from govspark.llm.rows import keep_rows, mark_of
from govspark.llm.words import bounded_batches
from govspark.session import fresh_path

CAPACITY = 32 << 20
MAX_BITS = 18

_STAMPED = "_id long, _mark long, _key long, _sha binary, _bytes long, _copies long, _largest long, _text binary"
_ENTRY = "bucket int, key long, chain int, sha binary, text binary, copies long, largest long"


def _stamp(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Key and digest of every row; the first row of each text of the batch carries the text, the number of its
    copies in the batch and their largest id."""
    for batch in batches:
        texts = pc.ascii_lower(pc.fill_null(batch.column("_text"), ""))
        ids = batch.column("_id").to_pylist()
        codes = texts.dictionary_encode()
        known = [t.as_buffer() for t in codes.dictionary]
        shas = [hashlib.sha256(t).digest() for t in known]
        keys = [int.from_bytes(s[:8], "big", signed=True) for s in shas]
        place = codes.indices.to_pylist()
        copies, largest, first = [0] * len(known), [None] * len(known), [None] * len(known)
        for row, (code, one) in enumerate(zip(place, ids, strict=True)):
            copies[code] += 1
            if one is not None and (largest[code] is None or one > largest[code]):
                largest[code] = one
            if first[code] is None:
                first[code] = row
        heads = {row: code for code, row in enumerate(first)}
        carried = [heads.get(row) for row in range(len(place))]
        yield pa.RecordBatch.from_arrays([
            pa.array(ids, pa.int64()),
            batch.column("_mark"),
            pa.array([keys[c] for c in place], pa.int64()),
            pa.array([shas[c] for c in place], pa.binary()),
            pa.array([len(known[c]) for c in place], pa.int64()),
            pa.array([None if c is None else copies[c] for c in carried], pa.int64()),
            pa.array([None if c is None else largest[c] for c in carried], pa.int64()),
            pc.take(codes.dictionary, pa.array(carried, pa.int32())).cast(pa.binary()),
        ], names=["_id", "_mark", "_key", "_sha", "_bytes", "_copies", "_largest", "_text"])


def _own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merge the key-ordered texts of a bucket into chains; equal means equal bytes."""
    names = ["bucket", "key", "chain", "sha", "text", "copies", "largest"]
    kinds = [pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64()]
    at, chain, done, held = None, [], [], 0

    def close() -> None:
        nonlocal held
        for place, (sha, text, copies, largest) in enumerate(chain):
            done.append((*at, place, sha, text, copies, largest))
            held += len(text)

    def out() -> pa.RecordBatch:
        nonlocal done, held
        rows, done, held = done, [], 0
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)],
                                          names=names)

    for batch in batches:
        column = {n: batch.column(n) for n in batch.schema.names}
        texts = column["_text"]
        for i, (bucket, key, sha, copies, largest) in enumerate(zip(
            column["bucket"].to_pylist(), column["_key"].to_pylist(), column["_sha"].to_pylist(),
            column["_copies"].to_pylist(), column["_largest"].to_pylist(), strict=True,
        )):
            if (bucket, key) != at:
                if chain:
                    close()
                    if held > 4 << 20 or len(done) > 5000:
                        yield out()
                at, chain = (bucket, key), []
            text = texts[i].as_py()
            for entry in chain:
                if entry[1] == text:
                    entry[2] += copies
                    if entry[3] is None or (largest is not None and largest > entry[3]):
                        entry[3] = largest
                    break
            else:
                chain.append([sha, text, copies, largest])
    if chain:
        close()
    if done:
        yield out()


def plan_directory(sizes: dict[int, int], bits: int, capacity: int) -> tuple[int, list[int]]:
    """Depth of the directory and the bucket of each of its ``2 ** depth`` cells.

    ``sizes``: bytes per prefix of ``bits`` bits. A bucket is split while it is overfull and bits are left.
    """
    weight = [sizes.get(p, 0) for p in range(1 << bits)]
    depth, directory = 0, [0]
    load, local, prefix = [sum(weight)], [0], [0]
    overfull = [0] if load[0] > capacity and bits else []
    while overfull:
        bucket = overfull.pop()
        if local[bucket] == depth:
            directory = [b for b in directory for _ in range(2)]
            depth += 1
        local[bucket] += 1
        prefix[bucket] *= 2
        fresh = len(load)
        local.append(local[bucket])
        prefix.append(prefix[bucket] + 1)
        load.append(0)
        for b in (bucket, fresh):
            width = 1 << (bits - local[b])
            load[b] = sum(weight[prefix[b] * width : (prefix[b] + 1) * width])
            if load[b] > capacity and local[b] < bits:
                overfull.append(b)
        width = 1 << (depth - local[fresh])
        directory[prefix[fresh] * width : (prefix[fresh] + 1) * width] = [fresh] * width
    return depth, directory


def _cell(key: str, depth: int):
    """The leading ``depth`` bits of a key, as a number from 0."""
    return F.shiftrightunsigned(key, 64 - depth) if depth else F.lit(0).cast("long")


def build_index(spark: SparkSession, docs: DataFrame, capacity: int = CAPACITY, text: str = "text",
                doc_id: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """The index of all texts and the stamp of every row, both on shared files.

    Index: bucket, key, chain (place among the texts of one key), sha, text, copies, largest (id).
    Stamps: _id, _mark (see ``rows``), _key, _sha, _bytes.
    """
    bounded_batches(spark)
    read = docs.select(F.col(doc_id).cast("long").alias("_id"), mark_of(F.col(text)).alias("_mark"), F.col(text).alias("_text"))
    stamped = read.mapInArrow(_stamp, _STAMPED)
    stamps_path, index_path = fresh_path(spark, "stamps"), fresh_path(spark, "index")
    stamped.select("_id", "_mark", "_key", "_sha", "_bytes", "_copies").write.parquet(stamps_path)
    stamps = spark.read.parquet(stamps_path)

    heads = stamps.where("_copies is not null")
    total = heads.agg(F.sum("_bytes")).first()[0] or 0
    capacity = max(capacity, total >> (MAX_BITS - 2))
    bits = min(MAX_BITS, (total // capacity).bit_length() + 2) if total > capacity else 0
    sizes = heads.groupBy(_cell("_key", bits).alias("cell")).agg(F.sum("_bytes").alias("size"))
    depth, directory = plan_directory({r["cell"]: r["size"] for r in sizes.collect()}, bits, capacity)
    buckets = max(directory) + 1
    cells = spark.createDataFrame(list(enumerate(directory)), "cell long, bucket int")

    texts = stamped.where("_text is not null").withColumn("cell", _cell("_key", depth)).join(F.broadcast(cells), "cell")
    owned = (
        texts.select("bucket", "_key", "_sha", "_copies", "_largest", "_text")
        .repartition(buckets, "bucket")
        .sortWithinPartitions("bucket", "_key")
        .mapInArrow(_own, _ENTRY)
    )
    owned.write.parquet(index_path)
    return spark.read.parquet(index_path), stamps.drop("_copies")


def exact_groups(docs: DataFrame, capacity: int = CAPACITY, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row.

    Texts are equal when identical after lower-casing A-Z; a null text counts as empty. Of equal texts the row with
    the largest id stays. A null id never stays beside another one; if all ids of a group are null, keep_id is null
    and no row is marked kept. Repeated rows (same id, same text) are all marked kept when their id is the one that
    stays: they are the same document. An empty table gives an empty result; other columns are ignored.
    """
    index, stamps = build_index(docs.sparkSession, docs, capacity, text, doc_id)
    entries = index.select(F.col("key").alias("_key"), F.col("sha").alias("_sha"), "copies", "largest")
    return stamps.join(entries, ["_key", "_sha"]).select(
        F.col("_id").alias("doc_id"),
        F.col("largest").alias("keep_id"),
        F.col("copies").alias("group_size"),
        F.coalesce(F.col("_id") == F.col("largest"), F.lit(False)).alias("kept"),
        F.lower(F.hex("_sha")).alias("text_sha256"),
    )


def drop_exact_copies(docs: DataFrame, capacity: int = CAPACITY, text: str = "text",
                      doc_id: str = "doc_id") -> DataFrame:
    """One row of every group of equal texts, with all its columns: one with the largest id (a null id is smaller than any).

    Of several rows with that id, those with the smallest hash of their text as it stands are left, and one of these stays.
    """
    index, stamps = build_index(docs.sparkSession, docs, capacity, text, doc_id)
    entries = index.select(F.col("key").alias("_key"), F.col("sha").alias("_sha"), "largest")
    last = stamps.join(entries, ["_key", "_sha"]).where(F.col("_id").eqNullSafe(F.col("largest")))
    rows = last.groupBy("_key", "_sha", "_id", "_mark").agg(F.count("*").alias("_n"))
    first = F.min(F.struct("_mark", "_n")).alias("_row")
    return keep_rows(docs, rows.groupBy("_key", "_sha", "_id").agg(first).select("_id", "_row.*"), text, doc_id)
