"""Ordered operations on groups of any size.

A window partitioned by the key alone puts a hot key into one task. These forms cut each key into slices of its
order, run the window inside a slice and carry one small row per slice across the slices of a key. Exact and
deterministic.

By default the slices are ranges of (keys, order) of about ``RANGE_ROWS`` rows, so neither a hot key nor a hot instant
can fill one task. The input is evaluated once, into the shared folder, when the function is called; it is counted there,
sampled for the borders of the ranges, and shuffled once. A caller who
knows that, say, a thousand versions of one contract are little, gives ``slice_by`` instead and stays lazy: an
expression that grows with ``order`` (rows of an earlier slice come before rows of a later slice).

Keys may be null: they are compared as a struct, in which null equals null, so the window and the join share one
hash partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from govspark.session import fresh_path

_GROUP = "_group"

#: Rows that one range should hold, and at least holds where there are cores for more ranges.
RANGE_ROWS = 2_000_000
LEAST_ROWS = 100_000


def _sliced(df: DataFrame, keys: list[str], slice_by: Column | None, order: list[Column],
            range_rows: int = RANGE_ROWS) -> DataFrame:
    if slice_by is not None:
        return df.withColumn(_GROUP, F.struct(F.struct(*keys).alias("key"), slice_by.alias("slice")))
    spark = df.sparkSession
    whole = fresh_path(spark, "sliced")
    df.write.parquet(whole)
    stored = spark.read.schema(df.schema).parquet(whole)
    rows = stored.count()
    ranges = max(1, -(-rows // range_rows), min(spark.sparkContext.defaultParallelism, rows // LEAST_ROWS))
    ranged = stored.repartitionByRange(ranges, *keys, *order)
    # Range borders come from a sample: fix them in storage, so that every use of the slices sees the same ones. As
    # Parquet, so that each use reads its own columns alone.
    path = fresh_path(spark, "slices")
    ranged.withColumn(_GROUP, F.struct(F.struct(*keys).alias("key"), F.spark_partition_id().alias("slice"))).write.parquet(path)
    return spark.read.schema(df.schema.add(_GROUP, spark.read.parquet(path).schema[_GROUP].dataType)).parquet(path)


def _across_slices() -> Window:
    return Window.partitionBy(f"{_GROUP}.key").orderBy(f"{_GROUP}.slice")


def number_rows(df: DataFrame, keys: list[str], order: list[Column], name: str,
                slice_by: Column | None = None) -> DataFrame:
    """Position from 1 of every row within its key."""
    sliced = _sliced(df, keys, slice_by, order)
    sizes = sliced.groupBy(_GROUP).agg(F.count("*").alias("_size"))
    offsets = sizes.select(_GROUP, (F.sum("_size").over(_across_slices()) - F.col("_size")).alias("_before"))
    inside = Window.partitionBy(_GROUP).orderBy(*order)
    local = sliced.withColumn("_local", F.row_number().over(inside))
    numbered = local.join(offsets, _GROUP)
    return numbered.withColumn(name, F.col("_before") + F.col("_local")).drop("_before", "_local", _GROUP)


def previous_value(df: DataFrame, keys: list[str], order: list[Column], value: str, name: str,
                   slice_by: Column | None = None) -> DataFrame:
    """Value of the preceding row of the key, null on the first row."""
    sliced = _sliced(df, keys, slice_by, order)
    last = sliced.groupBy(_GROUP).agg(F.max_by(F.struct(value), F.struct(*order)).alias("_last"))
    carried = last.select(_GROUP, F.lag("_last").over(_across_slices())[value].alias("_carried"))
    inside = Window.partitionBy(_GROUP).orderBy(*order)
    local = sliced.withColumn("_first", F.row_number().over(inside) == 1).withColumn(
        "_lagged", F.lag(value).over(inside)
    )
    picked = F.when(F.col("_first"), F.col("_carried")).otherwise(F.col("_lagged"))
    return local.join(carried, _GROUP).withColumn(name, picked).drop("_first", "_lagged", "_carried", _GROUP)


def running_sum(df: DataFrame, keys: list[str], order: list[Column], amount: Column, name: str,
                slice_by: Column | None = None) -> DataFrame:
    """Sum of ``amount`` over the rows of the key up to and with this one; nulls add nothing."""
    sliced = _sliced(df, keys, slice_by, order).withColumn("_amount", amount)
    sums = sliced.groupBy(_GROUP).agg(F.sum("_amount").alias("_sum"))
    earlier = _across_slices().rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(_GROUP, F.sum("_sum").over(earlier).alias("_before"))
    inside = Window.partitionBy(_GROUP).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = sliced.withColumn("_local", F.sum("_amount").over(inside))
    none = F.lit(0).cast(sliced.schema["_amount"].dataType)
    total = F.coalesce("_before", none) + F.coalesce("_local", none)
    return local.join(offsets, _GROUP).withColumn(name, total).drop("_before", "_local", "_amount", _GROUP)
