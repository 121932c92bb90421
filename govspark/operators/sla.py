"""Quality thresholds: defaults per layer, checks, reviews, contract terms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from govspark.vocabulary import DIMENSIONS, LAYER_SLA


def layer_threshold(layer: Column) -> Column:
    """Default threshold of a layer, the same for all dimensions; an unknown layer counts as bronze."""
    chain = None
    for name, threshold in LAYER_SLA.items():
        chain = F.when(layer == name, threshold) if chain is None else chain.when(layer == name, threshold)
    return chain.otherwise(F.lit(LAYER_SLA["bronze"]))


def layer_thresholds(datasets: DataFrame, keys: list[str], layer: str = "layer") -> DataFrame:
    """Six threshold rows per dataset."""
    named = F.explode(F.array(*[F.lit(d) for d in DIMENSIONS]))
    return datasets.select(*keys, layer, named.alias("dimension"), layer_threshold(F.col(layer)).alias("threshold"))


def threshold_table(spark: SparkSession) -> DataFrame:
    rows = [(layer, dimension, value) for layer, value in LAYER_SLA.items() for dimension in DIMENSIONS]
    return spark.createDataFrame(rows, "layer string, dimension string, threshold double")


def check_sla(scores: DataFrame, thresholds: DataFrame, keys: list[str]) -> DataFrame:
    """One row per threshold; a missing score is 0.0, scores without a threshold are left out."""
    joined = thresholds.join(scores, [*keys, "dimension"], "left")
    score = F.coalesce(F.col("score"), F.lit(0.0))
    return joined.select(*keys, "dimension", "threshold", score.alias("score"),
                         (score >= F.col("threshold")).alias("passes"))


def due_for_review(slas: DataFrame, as_of: Column) -> DataFrame:
    """Never reviewed, or the review interval has passed at ``as_of``."""
    due = F.col("last_reviewed_at") + F.make_dt_interval(F.col("review_interval_days"))
    return slas.where(F.col("last_reviewed_at").isNull() | (as_of >= due))


def contract_sla(measured: DataFrame, contracts: DataFrame, keys: list[str]) -> DataFrame:
    """Freshness in hours and completeness against the contract terms; an absent freshness term passes."""
    joined = contracts.join(measured, keys, "left")
    fresh = F.col("freshness_hours").isNull() | (F.col("age_hours") <= F.col("freshness_hours"))
    complete = F.col("completeness") >= F.col("completeness_threshold")
    return joined.select(
        *keys,
        "age_hours",
        "completeness",
        F.coalesce(fresh, F.lit(False)).alias("freshness_met"),
        F.coalesce(complete, F.lit(False)).alias("completeness_met"),
    )
