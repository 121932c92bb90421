"""Distribution drift: exact two-sample Kolmogorov-Smirnov at any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from govspark.session import fresh_path
from govspark.vocabulary import DRIFT_THRESHOLD

#: Distinct values that one range should hold, and at least holds where there are cores for more ranges.
RANGE_VALUES = 2_000_000
LEAST_VALUES = 100_000
_SERIES_TERMS = 100


def ks_statistic(reference: DataFrame, current: DataFrame, column: str, range_values: int = RANGE_VALUES) -> DataFrame:
    """One row: both sample sizes and the largest distance of the two distribution functions.

    The input is read once: values are counted (combined before the shuffle, so repeated values cost one row each) and
    stored. Counts of more than one range are then dealt into ranges of about equal size, as many as they need, and stored
    by range, because borders come from a sample. Running sums run inside a range and start from the totals of the
    ranges before; one row per range is all that is ever ordered in one place.
    """
    value = F.col(column).cast("double").alias("v")
    sides = (
        reference.select(value, F.lit(1).alias("r")).unionByName(current.select(value, F.lit(0).alias("r")))
    ).where("v IS NOT NULL")
    counts = sides.groupBy("v").agg(F.sum("r").alias("n1"), F.sum(F.lit(1) - F.col("r")).alias("n2"))
    ranged = _ranged(counts, ["v"], range_values)
    totals = ranged.groupBy("bucket").agg(F.sum("n1").alias("t1"), F.sum("n2").alias("t2"))
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    offsets = totals.select(
        "bucket",
        F.coalesce(F.sum("t1").over(before), F.lit(0)).alias("b1"),
        F.coalesce(F.sum("t2").over(before), F.lit(0)).alias("b2"),
        F.sum("t1").over(whole).alias("size1"),
        F.sum("t2").over(whole).alias("size2"),
    )
    inside = Window.partitionBy("bucket").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    steps_up = ranged.select(
        "bucket", F.sum("n1").over(inside).alias("c1"), F.sum("n2").over(inside).alias("c2")
    ).join(offsets, "bucket")  # one row per range: Spark broadcasts it by its size
    gap = F.abs((F.col("b1") + F.col("c1")) / F.col("size1") - (F.col("b2") + F.col("c2")) / F.col("size2"))
    return steps_up.agg(
        F.max("size1").alias("reference_size"), F.max("size2").alias("current_size"), F.max(gap).alias("statistic")
    )


def _ranged(counts: DataFrame, order: list[str], range_values: int) -> DataFrame:
    """The counts, evaluated once and stored, with ``bucket``: ranges of ``order`` of about ``range_values`` rows, in order."""
    spark = counts.sparkSession
    path = fresh_path(spark, "counts")
    counts.withColumn("bucket", F.lit(0)).write.parquet(path)
    stored = spark.read.parquet(path)
    rows = stored.count()
    ranges = max(-(-rows // range_values), min(spark.sparkContext.defaultParallelism, rows // LEAST_VALUES))
    if ranges <= 1:
        return stored
    path = fresh_path(spark, "ranges")
    stored.drop("bucket").repartitionByRange(ranges, *order).withColumn("bucket", F.spark_partition_id()).write.parquet(path)
    return spark.read.parquet(path)


def drift_fleet(rows: DataFrame, is_reference: Column, columns: list[str], keys: Sequence[str] = (),
                threshold: float = DRIFT_THRESHOLD, range_values: int = RANGE_VALUES) -> DataFrame:
    """keys, column, reference_size, current_size, statistic, p_value, has_drift of many columns of many datasets in one scan.

    ``is_reference``: true for rows of the reference, false for current ones, null for neither. ``keys`` name the dataset; null
    keys are datasets like others. All values are counted together by (keys, column, value); the counts are dealt into ranges
    of (keys, column, value), so a column that holds most of them is cut like any other. A column without a value on one
    side has no statistic and no drift.
    """
    # Keys by number and flat, columns by place: the counting then compares no long names and keeps to Spark's fast path.
    cells = F.array(*(F.struct(F.lit(i).alias("place"), F.col(f"`{c}`").cast("double").alias("v")) for i, c in enumerate(columns)))
    flat = [f"_k{i}" for i in range(len(keys))]
    read = rows.select(*(F.col(k).alias(n) for k, n in zip(keys, flat, strict=True)), is_reference.cast("int").alias("_one"),
                       cells.alias("_cells")).where("_one IS NOT NULL")
    sides = read.select(*flat, "_one", F.inline("_cells")).where("v IS NOT NULL")
    counted = sides.groupBy(*flat, "place", "v").agg(F.sum("_one").alias("n1"), F.sum(1 - F.col("_one")).alias("n2"))
    counts = counted.select(F.struct(*flat, "place").alias("series"), "v", "n1", "n2")
    ranged = _ranged(counts, ["series", "v"], range_values)
    totals = ranged.groupBy("series", "bucket").agg(F.sum("n1").alias("t1"), F.sum("n2").alias("t2"))
    ordered = Window.partitionBy("series").orderBy("bucket")
    before, whole = ordered.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("series")
    offsets = totals.select(
        "series", "bucket", F.coalesce(F.sum("t1").over(before), F.lit(0)).alias("b1"), F.coalesce(F.sum("t2").over(before), F.lit(0)).alias("b2"),
        F.sum("t1").over(whole).alias("size1"), F.sum("t2").over(whole).alias("size2"),
    )
    inside = Window.partitionBy("series", "bucket").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    up = ranged.select("series", "bucket", F.sum("n1").over(inside).alias("c1"), F.sum("n2").over(inside).alias("c2"))
    joined = up.join(offsets, ["series", "bucket"])
    both = (F.col("size1") > 0) & (F.col("size2") > 0)
    gap = F.when(both, F.abs((F.col("b1") + F.col("c1")) / F.col("size1") - (F.col("b2") + F.col("c2")) / F.col("size2")))
    tested = joined.groupBy("series").agg(
        F.max("size1").alias("reference_size"), F.max("size2").alias("current_size"), F.max(gap).alias("statistic"))
    p_value = F.when(F.col("statistic").isNotNull(), ks_p_value(F.col("statistic"), F.col("reference_size"), F.col("current_size")))
    column = F.get(F.array(*map(F.lit, columns)), F.col("series.place")).alias("column")
    told = tested.select(*(F.col("series")[n].alias(k) for k, n in zip(keys, flat, strict=True)), column,
                         "reference_size", "current_size", "statistic").withColumn("p_value", p_value)
    return told.withColumn("has_drift", F.coalesce(F.col("p_value") < threshold, F.lit(False)))


def ks_p_value(statistic: Column, size1: Column, size2: Column) -> Column:
    """Asymptotic p-value by the Kolmogorov series with Stephens' correction for finite samples.

    Exact small-sample tables may differ; the statistic does not.
    """
    effective = F.sqrt(size1.cast("double") * size2 / (size1 + size2))
    lam = (effective + F.lit(0.12) + F.lit(0.11) / effective) * statistic
    terms = F.aggregate(
        F.sequence(F.lit(1), F.lit(_SERIES_TERMS)),
        F.lit(0.0),
        lambda total, k: total
        + F.when(k % 2 == 1, F.lit(1.0)).otherwise(F.lit(-1.0)) * F.exp(F.lit(-2.0) * k * k * lam * lam),
    )
    # Below this value the series converges too slowly and the probability is 1 to more than 12 digits.
    return F.when(lam < 0.2, F.lit(1.0)).otherwise(F.least(F.greatest(F.lit(2.0) * terms, F.lit(0.0)), F.lit(1.0)))


def detect_drift(reference: DataFrame, current: DataFrame, column: str, threshold: float = DRIFT_THRESHOLD,
                 range_values: int = RANGE_VALUES) -> DataFrame:
    """Statistic, p-value and the drift flag (``p < threshold``)."""
    tested = ks_statistic(reference, current, column, range_values)
    p_value = ks_p_value(F.col("statistic"), F.col("reference_size"), F.col("current_size"))
    return tested.withColumn("p_value", p_value).withColumn("has_drift", F.col("p_value") < threshold)
