"""Connected components of a graph given as edges, by alternating large-star and small-star rounds.

A round re-hangs every edge below the smallest neighbour seen, so components turn into stars in a number of rounds
that grows with the logarithm of their size. A round is two aggregates (pre-combined before the shuffle) and two
joins against one row per node; a hub that holds a third of all edges is split by AQE on its join side. Each round
is checkpointed in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from govspark.session import cut_lineage


def _star(arcs: DataFrame, large: bool) -> DataFrame:
    """``arcs``: u, v with every edge in both directions (large) or from the larger to the smaller end (small)."""
    least = arcs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    hung = arcs.join(least, "u")
    if large:
        return hung.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    up = hung.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return up.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v")


def components(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node of its component) of every node of ``edges`` (a, b of one type that has an order).

    Loops, repeated edges and either direction are allowed; an edge with a null end is ignored. No edges, no rows.
    """
    now = cut_lineage(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )
    state = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        hung = _star(both, large=True).distinct()
        now = cut_lineage(_star(hung, large=False).distinct())
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == state:
            break
        state = seen
    return now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
