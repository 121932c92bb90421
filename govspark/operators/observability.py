"""Freshness, volume, rates, error share and latency."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F



def freshness(df: DataFrame, keys: list[str], updated_at: str, as_of: Column) -> DataFrame:
    """Seconds between the newest row and ``as_of``."""
    newest = F.unix_micros(F.max(updated_at).cast("timestamp"))
    age = (F.unix_micros(as_of.cast("timestamp")) - newest) / F.lit(1_000_000.0)
    return df.groupBy(*keys).agg(age.alias("freshness_seconds"))


def volume(df: DataFrame, keys: list[str], load: Column) -> DataFrame:
    """Rows per load and the running total per dataset; the window only sees one row per load."""
    loads = df.groupBy(*keys, load.alias("load")).agg(F.count("*").alias("rows"))
    running = F.sum("rows").over(Window.partitionBy(*keys).orderBy("load"))
    return loads.withColumn("total_rows", running)


def rate(df: DataFrame, keys: list[str], time: str, width: str = "5 minutes", seconds: int = 300,
         amount: Column | None = None) -> DataFrame:
    """Events (or a summed amount) per second in each window."""
    counted = F.count("*") if amount is None else F.sum(amount)
    grouped = df.groupBy(F.window(time, width).alias("w"), *keys).agg(counted.alias("events"))
    return grouped.select("w.start", *keys, "events", (F.col("events") / F.lit(float(seconds))).alias("rate"))


def error_share(df: DataFrame, keys: list[str], time: str, is_error: Column, width: str = "5 minutes") -> DataFrame:
    """Percentage of failed requests in each window."""
    grouped = df.groupBy(F.window(time, width).alias("w"), *keys).agg(
        F.count("*").alias("requests"), F.count_if(is_error).alias("errors")
    )
    return grouped.select("w.start", *keys, "requests", "errors",
                          (F.lit(100.0) * F.col("errors") / F.col("requests")).alias("error_percent"))


def log_matches(df: DataFrame, message: str, words: Sequence[str], time: str, width: str = "5 minutes") -> DataFrame:
    """Lines per window that contain each word."""
    hits = F.filter(
        F.array(*[F.when(F.contains(F.col(message), F.lit(w)), F.lit(w)) for w in words]), lambda w: w.isNotNull()
    )
    lines = df.select(F.col(time).alias("time"), F.explode(hits).alias("word"))
    return lines.groupBy(F.window("time", width).alias("w"), "word").agg(F.count("*").alias("lines")).select(
        "w.start", "word", "lines"
    )


def histogram_quantile(df: DataFrame, keys: list[str], value: str, bounds: Sequence[float], quantile: float) -> DataFrame:
    """Quantile from cumulative bucket counts with linear interpolation inside the bucket.

    The counts are conditional aggregates: constant memory per group, whatever its size. Values above the last
    bound report that bound, as histogram buckets cannot tell more.
    """
    ordered = sorted(float(b) for b in bounds)
    counters = [F.count_if(F.col(value) <= b).alias(f"le{i}") for i, b in enumerate(ordered)]
    counted = df.groupBy(*keys).agg(F.count(value).alias("total"), *counters)
    rank = F.lit(float(quantile)) * F.col("total")
    chain = None
    for i, upper in enumerate(ordered):
        lower = ordered[i - 1] if i else min(0.0, upper)
        below = F.col(f"le{i - 1}") if i else F.lit(0)
        inside = F.col(f"le{i}") - below
        estimate = F.lit(lower) + F.lit(upper - lower) * (rank - below) / inside
        hit = (F.col(f"le{i}") >= rank) & (inside > 0)
        chain = F.when(hit, estimate) if chain is None else chain.when(hit, estimate)
    return counted.select(*keys, "total", chain.otherwise(F.lit(ordered[-1])).alias("quantile_value"))
