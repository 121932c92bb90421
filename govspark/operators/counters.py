"""Rates of cumulative counters, and quantiles of cumulative histograms.

A counter is exported as samples (labels, time, value so far); it only grows, except that it starts anew at zero when its
process restarts. What it counted between two samples is their difference, or the later value where that is smaller (a
reset). A series is a set of labels; only samples of one series are ever subtracted from each other.

``increases`` cuts every series into time ranges. Inside a range, samples are compared with their predecessors; one row
per range is then stitched to the last value of the range before. So a series that holds a third of all samples is
spread over its ranges, and only one small row per range and series is ever ordered by series alone.

Two ways to treat the borders of a range:

* carried (the default): the step from the last sample before the range belongs to the range of the later sample. Nothing is
  lost or counted twice: the increases of a series sum up to what its samples show. The first sample of a series has no
  predecessor and adds nothing.
* extrapolated: only samples within the range count, and their increase is stretched to the borders of the range, by
  half a sampling interval at most on a side where the next sample would be more than 1.1 intervals away, and to the left
  no further than where the counter would have been zero. Fewer than two samples give no increase. This estimates what a
  monitoring system shows for a window that ends with the range.

Samples with a null or NaN value, a negative value or a null time are left out. Samples of one instant are taken in the
order of their values, so repeated samples change nothing. Null labels are labels like others.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A sample further than so many mean intervals from a border does not speak for the time up to it.
REACH = 1.1


def _growth(value: Column, before: Column) -> Column:
    """What a counter counted since the sample before."""
    return F.when(before.isNull(), 0.0).when(value < before, value).otherwise(value - before)


def increases(samples: DataFrame, series: Sequence[str], time: str, value: str, width: str = "5 minutes",
              extrapolate: bool = False) -> DataFrame:
    """series, start, samples, resets, increase: one row per series and time range that has samples."""
    held = samples.select(*series, F.col(time).cast("timestamp").alias("_at"), F.col(value).cast("double").alias("_value")).where(
        F.col("_at").isNotNull() & (F.col("_value") >= 0) & ~F.isnan("_value")
    )
    ranged = held.withColumn("start", F.window("_at", width)["start"]).withColumn("_end", F.window("_at", width)["end"])
    inside = Window.partitionBy(*series, "start").orderBy("_at", "_value")
    before = ranged.withColumn("_before", F.lag("_value").over(inside))
    order = F.struct("_at", "_value")
    ranges = before.groupBy(*series, "start").agg(
        F.count("*").alias("samples"),
        F.sum(_growth(F.col("_value"), F.col("_before"))).alias("_inner"),
        F.count_if(F.col("_value") < F.col("_before")).alias("_resets"),
        F.min(order).alias("_first"),
        F.max(order).alias("_last"),
        F.first("_end").alias("_end"),
    )
    if extrapolate:
        return ranges.select(*series, "start", "samples", F.col("_resets").alias("resets"), _stretched().alias("increase"))
    carried = F.lag("_last").over(Window.partitionBy(*series).orderBy("start"))["_value"]
    stitched = ranges.withColumn("_before", carried)
    first = F.col("_first")["_value"]
    return stitched.select(
        *series, "start", "samples", (F.col("_resets") + (F.coalesce(first < F.col("_before"), F.lit(False))).cast("long")).alias("resets"),
        (F.col("_inner") + _growth(first, F.col("_before"))).alias("increase"),
    )


def _stretched() -> Column:
    """Increase within the range, stretched to its borders."""
    seconds = lambda later, earlier: (F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(1e6)
    first, last, inner = F.col("_first"), F.col("_last"), F.col("_inner")
    covered = seconds(last["_at"], first["_at"])
    interval = covered / (F.col("samples") - 1)

    def reach(gap: Column) -> Column:
        return F.when(gap >= REACH * interval, interval / 2).otherwise(gap)

    left = reach(seconds(first["_at"], F.col("start")))
    from_zero = F.when(inner > 0, covered * first["_value"] / inner)
    left = F.least(left, from_zero)  # least() ignores a null
    right = reach(seconds(F.col("_end"), last["_at"]))
    return F.when((F.col("samples") > 1) & (covered > 0), inner * (covered + left + right) / covered)


def rate_by(increase: DataFrame, keys: Sequence[str], seconds: int = 300) -> DataFrame:
    """start, keys, increase, rate per second: the sum over all series of each key."""
    summed = increase.groupBy("start", *keys).agg(F.sum("increase").alias("increase"))
    return summed.withColumn("rate", F.col("increase") / F.lit(float(seconds)))


def error_share_by(increase: DataFrame, keys: Sequence[str], is_error: Column) -> DataFrame:
    """start, keys, requests, errors, error_percent from counters that carry the outcome as a label.

    Null where nothing was requested.
    """
    summed = increase.groupBy("start", *keys).agg(
        F.sum("increase").alias("requests"), F.coalesce(F.sum(F.when(is_error, F.col("increase"))), F.lit(0.0)).alias("errors")
    )
    return summed.withColumn("error_percent", F.when(F.col("requests") > 0, 100.0 * F.col("errors") / F.col("requests")))


def upper_bound(label: Column) -> Column:
    """Numeric upper bound of a bucket label; ``+Inf`` is infinite, anything else that is no number is null."""
    text = F.trim(label)
    return F.when(F.lower(text).isin("+inf", "inf"), F.lit(float("inf"))).otherwise(text.try_cast("double"))


def rated_quantile(increase: DataFrame, keys: Sequence[str], quantile: float, le: str = "le") -> DataFrame:
    """start, keys, total, quantile_value from the increases of cumulative bucket counters (label ``le``).

    The buckets of all series of a key are summed by their bound, whatever bounds each series has. A bucket that counts
    less than a smaller one (series that disagree, or a bucket that some of them lack) counts as much as that. The value
    is interpolated in the first bucket that reaches the quantile, from zero in the lowest one if its bound is positive.
    In the unbounded bucket it is the largest finite bound. Null without an unbounded bucket, with it alone, or
    where nothing was counted.
    """
    if not 0 <= quantile <= 1:
        raise ValueError("a quantile lies between 0 and 1")
    buckets = (
        increase.withColumn("_le", upper_bound(F.col(le))).where("_le IS NOT NULL AND NOT isnan(_le)")
        .groupBy("start", *keys, "_le").agg(F.sum("increase").alias("_n"))
    )
    # As many rows per key and range as there are bounds.
    upward = Window.partitionBy("start", *keys).orderBy("_le")
    cumulative = buckets.withColumn("_upto", F.max("_n").over(upward.rowsBetween(Window.unboundedPreceding, 0)))
    ranked = cumulative.withColumns({
        "_lower": F.lag("_le").over(upward),
        "_below": F.coalesce(F.lag("_upto").over(upward), F.lit(0.0)),
        "_total": F.max("_upto").over(Window.partitionBy("start", *keys)),
    })
    rank = F.lit(float(quantile)) * F.col("_total")
    lower = F.coalesce("_lower", F.when(F.col("_le") > 0, 0.0).otherwise(F.col("_le")))
    inside = F.col("_upto") - F.col("_below")
    unbounded = F.col("_le") == float("inf")
    value = (
        F.when(unbounded, F.col("_lower"))
        .when(inside > 0, lower + (F.col("_le") - lower) * (rank - F.col("_below")) / inside)
        .otherwise(lower)
    )
    hit = F.when((F.col("_upto") >= rank) & (F.col("_total") > 0), F.struct("_le", value.alias("value")))
    told = ranked.groupBy("start", *keys).agg(
        F.max("_total").alias("total"), F.min(hit).alias("_hit"), F.bool_or(unbounded).alias("_whole")
    )
    return told.select("start", *keys, "total", F.when(F.col("_whole"), F.col("_hit")["value"]).alias("quantile_value"))
