"""Noisy releases under a privacy budget that refuses.

A release is the value, rounded to a grid, plus discrete Laplace noise in steps of the grid. Rounding moves two values that
are a sensitivity apart by ``ceil(sensitivity / grid)`` steps at most, so noise with rate epsilon / steps makes a release
epsilon-private. The grid is a power of two: products with it are exact.

Every answer, also a refusal, is kept in a ledger. A request that comes again (same ``request_id``) gets the answer it got, so a
retry spends nothing and shows no second draw.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from govspark.functions.noise import discrete_laplace, seeded_uniform
from govspark.operators.slices import running_sum
from govspark.sources import stored

#: Exact sums of epsilons.
EXACT = "decimal(38,12)"
_ANSWER = ("request_id string, dataset_id string, epsilon double, released boolean, reason string, noisy_value double")


def noisy_on_grid(metrics: DataFrame, value: str, epsilon: Column, sensitivity: float = 1.0, grid: float = 1.0,
                  seed: int | None = None, identity: list[str] | None = None) -> DataFrame:
    """Adds ``noisy_value``: the value on the grid plus discrete Laplace noise.

    With ``seed`` the noise is repeatable, from a hash of the seed and the ``identity`` columns; that mode is for tests.
    """
    if grid <= 0 or math.frexp(grid)[0] != 0.5:
        raise ValueError("the grid must be a power of two")
    if sensitivity <= 0:
        raise ValueError("the sensitivity must be positive")
    steps = math.ceil(sensitivity / grid)
    draws: list[Column | None] = [None, None]
    if seed is not None:
        parts = [F.col(c).cast("string") for c in identity or []]
        draws = [seeded_uniform(F.lit(str(seed)), *parts, F.lit(side)) for side in ("up", "down")]
    place = F.floor(F.col(value).cast("double") / grid + 0.5)
    return metrics.withColumn("noisy_value", (place + discrete_laplace(epsilon / F.lit(float(steps)), *draws)) * F.lit(float(grid)))


def release(path: str, requests: DataFrame, budgets: DataFrame, sensitivity: float = 1.0, grid: float = 1.0,
            seed: int | None = None) -> DataFrame:
    """Answers to ``requests`` (``request_id``, ``dataset_id``, ``requested_at``, ``value``, ``epsilon``) under ``budgets`` (``dataset_id``,
    ``budget``), kept in the ledger at ``path``: request_id, dataset_id, epsilon, released, reason, noisy_value.

    Requests are taken in order of time (then id). One is refused where the dataset has no budget, where its epsilon is not
    positive or its value is null, and where what was released before, the valid requests ahead of it and it together exceed
    the budget. Requests ahead count even if refused: one that is too large closes the dataset for the rest of the batch. A
    refusal spends nothing.
    """
    spark = requests.sparkSession
    ledger = stored.read_stored(spark, path, stored_schema(spark))
    asked = requests.select(
        F.col("request_id").cast("string").alias("request_id"), F.col("dataset_id").cast("string").alias("dataset_id"), "requested_at",
        F.col("value").cast("double").alias("value"), F.col("epsilon").cast("double").alias("epsilon"),
    ).dropDuplicates(["request_id"])
    new = asked.join(ledger.select("request_id"), "request_id", "left_anti")
    sound = (F.col("epsilon") > 0) & ~F.isnan("epsilon") & F.col("value").isNotNull() & ~F.isnan("value")
    exact = F.when(sound, F.col("epsilon")).cast(EXACT)
    ahead = running_sum(new, ["dataset_id"], [F.col("requested_at"), F.col("request_id")], exact, "asked")
    spent = ledger.where("released").groupBy("dataset_id").agg(F.sum(F.col("epsilon").cast(EXACT)).alias("spent"))
    limits = budgets.groupBy(F.col("dataset_id").cast("string").alias("dataset_id")).agg(F.sum(F.col("budget").cast(EXACT)).alias("budget"))
    judged = ahead.join(limits, "dataset_id", "left").join(spent, "dataset_id", "left")
    total = F.col("asked") + F.coalesce("spent", F.lit(0).cast(EXACT))
    reason = (
        F.when(F.col("budget").isNull(), "dataset has no budget")
        .when(~F.coalesce(sound, F.lit(False)), "epsilon or value is not valid")
        .when(total > F.col("budget"), "budget exhausted")
    )
    noisy = noisy_on_grid(judged.withColumn("reason", reason), "value", F.col("epsilon"), sensitivity, grid, seed, ["request_id"])
    released = F.col("reason").isNull()
    answers = noisy.select("request_id", "dataset_id", "epsilon", released.alias("released"), "reason",
                           F.when(released, F.col("noisy_value")).alias("noisy_value"))
    stored.upsert(path, answers, ["request_id"])
    known = stored.read_stored(spark, path, stored_schema(spark)).drop(stored.BUCKET)
    return known.join(asked.select("request_id"), "request_id", "left_semi")


def stored_schema(spark):
    """Columns of the ledger as it is stored."""
    return spark.createDataFrame([], f"{_ANSWER}, {stored.BUCKET} int").schema


def remaining_budget(ledger: DataFrame, budgets: DataFrame) -> DataFrame:
    """dataset_id, budget, spent, remaining, refused of every dataset with a budget or a request."""
    spent = ledger.groupBy("dataset_id").agg(
        F.coalesce(F.sum(F.when(F.col("released"), F.col("epsilon").cast(EXACT))), F.lit(0).cast(EXACT)).alias("spent"),
        F.count_if(~F.col("released")).alias("refused"),
    )
    known = budgets.groupBy("dataset_id").agg(F.sum(F.col("budget").cast(EXACT)).alias("budget"))
    both = known.join(spent, "dataset_id", "full").fillna(0, ["spent", "refused", "budget"])
    return both.select("dataset_id", F.col("budget").cast("double").alias("budget"), F.col("spent").cast("double").alias("spent"),
                       (F.col("budget") - F.col("spent")).cast("double").alias("remaining"), "refused")
