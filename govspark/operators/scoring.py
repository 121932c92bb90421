"""Dimension scores, overall score and quality reports."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from govspark.operators.expectations import KINDS
from govspark.vocabulary import DIMENSIONS

DIMENSION_OF = {name: kind.dimension for name, kind in KINDS.items()}


def _dimension(expectation_type: Column, dimension_map: Mapping[str, str]) -> Column:
    pairs = [F.lit(text) for pair in dimension_map.items() for text in pair]
    return F.try_element_at(F.create_map(*pairs), expectation_type)


def dimension_scores(results: DataFrame, keys: list[str], dimension_map: Mapping[str, str] | None = None) -> DataFrame:
    """Score of all six dimensions per group: passed over total, 1.0 where nothing was checked.

    Types outside the map are ignored; a null ``success`` counts as failed. One shuffle: the six counters are
    conditional aggregates, and the rows per dimension come from exploding them, not from a product.
    """
    dimension = _dimension(F.col("expectation_type"), dimension_map or DIMENSION_OF)
    passed = F.coalesce(F.col("success"), F.lit(False))
    counters = []
    for name in DIMENSIONS:
        counters.append(F.count_if(dimension == name).alias(f"total_{name}"))
        counters.append(F.count_if((dimension == name) & passed).alias(f"passed_{name}"))
    scores = [
        F.struct(
            F.lit(name).alias("dimension"),
            F.when(F.col(f"total_{name}") == 0, F.lit(1.0))
            .otherwise(F.col(f"passed_{name}") / F.col(f"total_{name}"))
            .alias("score"),
        )
        for name in DIMENSIONS
    ]
    counted = results.groupBy(*keys).agg(*counters)
    return counted.select(*keys, F.explode(F.array(*scores)).alias("s")).select(*keys, "s.dimension", "s.score")


def overall_score(scores: DataFrame, keys: list[str], datasets: DataFrame | None = None) -> DataFrame:
    """Mean of the dimension scores; 0.0 for a listed dataset without any score."""
    means = scores.groupBy(*keys).agg(F.avg("score").alias("dq_score"))
    if datasets is None:
        return means
    joined = datasets.select(*keys).distinct().join(means, keys, "left")
    return joined.select(*keys, F.coalesce("dq_score", F.lit(0.0)).alias("dq_score"))


def report_name(suite_name: Column, layer: Column) -> Column:
    return F.when(suite_name == "default", F.concat_ws("_", suite_name, layer)).otherwise(suite_name)


def quality_report(results: DataFrame, keys: list[str], dimension_map: Mapping[str, str] | None = None) -> DataFrame:
    """One row per group: score map, overall score, passed, failed and total expectations."""
    dimension = _dimension(F.col("expectation_type"), dimension_map or DIMENSION_OF)
    passed = F.coalesce(F.col("success"), F.lit(False))
    counters = [
        F.count("*").alias("expectations_total"),
        F.count_if(passed).alias("expectations_passed"),
    ]
    for name in DIMENSIONS:
        counters.append(
            F.coalesce(F.avg(F.when(dimension == name, passed.cast("double"))), F.lit(1.0)).alias(name)
        )
    mean = sum((F.col(name) for name in DIMENSIONS), F.lit(0.0)) / F.lit(len(DIMENSIONS))
    pairs = [c for name in DIMENSIONS for c in (F.lit(name), F.col(name))]
    return results.groupBy(*keys).agg(*counters).select(
        *keys,
        F.create_map(*pairs).alias("dimension_scores"),
        mean.alias("dq_score"),
        "expectations_passed",
        (F.col("expectations_total") - F.col("expectations_passed")).alias("expectations_failed"),
        "expectations_total",
    )


def latest_report(reports: DataFrame, keys: list[str], created_at: str = "created_at") -> DataFrame:
    """Newest report per group, by partial aggregation instead of a window."""
    rest = [c for c in reports.columns if c not in keys]
    newest = F.max_by(F.struct(*rest), F.col(created_at)).alias("r")
    return reports.groupBy(*keys).agg(newest).select(*keys, "r.*")
