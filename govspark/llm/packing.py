"""Conflict-constrained best-fit packing of documents into training sequences.

A bin holds at most ``CAPACITY`` tokens (words between blanks), at most one document of a source and at most one
document of a cluster of exact copies. Longer documents are cut into full pieces and a rest; nothing is dropped. Pieces
are taken by falling length. The open bins are kept in order of their residual room; every bin carries a bitmap of
its sources and one of its duplicate clusters. The search starts at the successor of the piece's length, the
smallest residual that holds it, and goes on through larger residuals until a bin without a conflict is found: the
tightest compatible bin. Without one, a new bin opens.

Scale: pieces are spread over shards of about ``SHARD_ROWS`` by a hash of document, row and piece; the row number is written
with the lengths. So neither a hot source nor a group of copies or of repeated rows gathers in one task, and the number of shards grows with the input. A shard is packed by
itself, on four small columns without texts; it leaves a few bins open at its end, which is what splitting costs.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from govspark.llm.words import BLANK_SEPARATED, bounded_batches, slices
from govspark.session import fresh_path

CAPACITY = 2048
SHARD_ROWS = 4096

_PACKED = ("doc_id long, source string, piece long, first_token long, n_tokens long, shard long, bin long, "
           "bin_tokens long")


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = pc.ascii_lower(pc.fill_null(batch.column("_text"), ""))
        counts = [np.diff(p.words) for p in slices(texts, BLANK_SEPARATED)]
        clusters = [xxhash.xxh64_intdigest(t.as_buffer()) - (1 << 63) for t in texts]
        yield pa.RecordBatch.from_arrays([
            batch.column("doc_id"), batch.column("source"),
            pa.array(np.concatenate(counts) if counts else np.zeros(0, np.int64), pa.int64()),
            pa.array(clusters, pa.int64()),
        ], names=["doc_id", "source", "tokens", "cluster"])


class Bins:
    """Open and full bins of one shard, ordered by residual room."""

    def __init__(self, capacity: int) -> None:
        self.capacity = capacity
        self.order: list[tuple[int, int]] = []  # residual, bin
        self.sources: list[int] = []
        self.clusters: list[int] = []

    def place(self, length: int, source: int, cluster: int) -> int:
        """Bin of a piece; ``source`` and ``cluster`` are bitmaps of one bit, or 0 for none."""
        at = bisect_left(self.order, (length, -1))
        while at < len(self.order):
            residual, held = self.order[at]
            if not (self.sources[held] & source or self.clusters[held] & cluster):
                del self.order[at]
                break
            at += 1
        else:
            residual, held = self.capacity, len(self.sources)
            self.sources.append(0)
            self.clusters.append(0)
        self.sources[held] |= source
        self.clusters[held] |= cluster
        insort(self.order, (residual - length, held))
        return held


def pack_shard(pieces: pa.Table, capacity: int) -> pa.Table:
    """The pieces of one shard in the order in which they were placed, with bin and bin_tokens."""
    by = [("n_tokens", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("cluster", "ascending")]
    pieces = pieces.take(pc.sort_indices(pieces, sort_keys=by))
    lengths = pieces["n_tokens"].to_numpy()
    source_codes, _ = pd.factorize(pieces["source"].to_pandas())  # -1: null, which conflicts with nothing
    cluster_codes, found = pd.factorize(pieces["cluster"].to_numpy())
    shared = np.bincount(cluster_codes, minlength=len(found)) > 1
    bit_of = np.cumsum(shared) - 1  # only clusters with several pieces here need a bit
    bins = Bins(capacity)
    placed = [
        bins.place(int(n), 0 if s < 0 else 1 << int(s), 1 << int(bit_of[c]) if shared[c] else 0)
        for n, s, c in zip(lengths, source_codes, cluster_codes, strict=True)
    ]
    fill = np.zeros(len(bins.sources), dtype=np.int64)
    np.add.at(fill, placed, lengths)
    return pieces.append_column("bin", pa.array(placed, pa.int64())).append_column(
        "bin_tokens", pa.array(fill[placed], pa.int64())
    )


def pack(docs: DataFrame, capacity: int = CAPACITY, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """doc_id, source, piece, first_token, n_tokens, shard, bin, bin_tokens: where every piece of ``docs`` lies.

    A bin is (shard, bin). Null and empty texts make one piece of no tokens, so every row is placed. A null source
    conflicts with nothing. Repeated rows are copies of each other and never share a bin. Other columns are ignored;
    an empty table gives an empty result.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    path = fresh_path(spark, "lengths")
    docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
                F.col("text").alias("_text")).mapInArrow(
        _measure, "doc_id long, source string, tokens long, cluster long"
    ).withColumn("row", F.monotonically_increasing_id()).write.parquet(path)
    measured = spark.read.parquet(path)
    many = F.greatest(F.ceil(F.col("tokens") / capacity), F.lit(1)).cast("long")
    pieces = measured.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), many - 1)))
    first = F.col("piece") * capacity
    total = measured.agg(F.sum(many)).first()[0] or 0
    shards = max(1, -(-total // shard_rows))
    spread = pieces.select(
        "doc_id", "source", "cluster", "piece", first.alias("first_token"),
        F.least(F.col("tokens") - first, F.lit(capacity)).cast("long").alias("n_tokens"),
        F.pmod(F.xxhash64("doc_id", "cluster", "row", "piece"), F.lit(shards)).alias("shard"),
    )
    columns = [c.split()[0] for c in _PACKED.split(", ")]

    def run(shard: pa.Table) -> pa.Table:
        return pack_shard(shard, capacity).select(columns)

    return spread.groupBy("shard").applyInArrow(run, _PACKED)
