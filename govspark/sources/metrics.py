"""Metric points of datasets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

POINT_COLUMNS = ("dataset", "domain", "layer", "metric", "value", "as_of")


def metric_points(df: DataFrame, metric: str, value: str, as_of: Column) -> DataFrame:
    """Rows with dataset, domain and layer as metric points."""
    return df.select(
        "dataset", "domain", "layer", F.lit(metric).alias("metric"), F.col(value).cast("double").alias("value"),
        as_of.alias("as_of"),
    )


def append_points(points: DataFrame, path: str) -> None:
    """Append to the metrics table, one folder per metric."""
    points.write.mode("append").partitionBy("metric").parquet(path)
