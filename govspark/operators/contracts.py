"""Contract validation, schema changes and schema drift over fleets: one row per dataset and column.

Issues and changes come out as rows, not as lists per dataset, so a very wide dataset stays spread out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from govspark.operators.slices import previous_value


# Issue of a row and the name of its counter per dataset.
ISSUES = {"missing_column": "missing_columns", "type_mismatch": "type_mismatches", "extra_column": "extra_columns"}


def contract_issues(expected: DataFrame, actual: DataFrame, keys: list[str]) -> DataFrame:
    """Missing columns, type mismatches (text equality) and extra columns.

    Both tables have ``name`` and ``data_type``. Nullability and keys are not compared.
    """
    left = expected.select(*keys, "name", F.col("data_type").alias("expected_type"), F.lit(True).alias("_e"))
    right = actual.select(*keys, "name", F.coalesce("data_type", F.lit("")).alias("actual_type"),
                          F.lit(True).alias("_a"))
    joined = left.join(right, [*keys, "name"], "full_outer")
    issue = (
        F.when(F.col("_a").isNull(), "missing_column")
        .when(F.col("_e").isNull(), "extra_column")
        .when(F.col("expected_type") != F.col("actual_type"), "type_mismatch")
    )
    return joined.withColumn("issue", issue).where("issue IS NOT NULL").drop("_e", "_a")


def contract_validation(expected: DataFrame, actual: DataFrame, keys: list[str]) -> DataFrame:
    """Per dataset of the contract table: number of issues of each kind; extra columns do not make it invalid."""
    issues = contract_issues(expected, actual, keys)
    counted = issues.groupBy(*keys).agg(
        *[F.count_if(F.col("issue") == issue).alias(counter) for issue, counter in ISSUES.items()]
    )
    all_datasets = expected.select(*keys).distinct()
    joined = all_datasets.join(counted, keys, "left").fillna(0, list(ISSUES.values()))
    return joined.withColumn("valid", (F.col("missing_columns") == 0) & (F.col("type_mismatches") == 0))


def _change(test: Column, kind: str, breaking: bool) -> Column:
    return F.when(test, F.struct(F.lit(kind).alias("change"), F.lit(breaking).alias("breaking")))


def schema_changes(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Classified differences of two versions; a column may yield two. Everything else yields nothing."""
    left = old.select(*keys, "name", F.col("data_type").alias("old_type"), F.col("nullable").alias("_old_null"))
    right = new.select(*keys, "name", F.col("data_type").alias("new_type"), F.col("nullable").alias("_new_null"))
    joined = left.withColumn("_old", F.lit(True)).join(
        right.withColumn("_new", F.lit(True)), [*keys, "name"], "full_outer"
    )
    added, removed = F.col("_old").isNull(), F.col("_new").isNull()
    kept = ~added & ~removed
    found = F.array(
        _change(removed, "column_removed", True),
        _change(added & ~F.col("_new_null"), "non_nullable_column_added", True),
        _change(added & F.col("_new_null"), "nullable_column_added", False),
        _change(kept & (F.col("old_type") != F.col("new_type")), "type_changed", True),
        _change(kept & F.col("_old_null") & ~F.col("_new_null"), "nullable_to_non_nullable", True),
    )
    exploded = joined.withColumn("c", F.explode(F.filter(found, lambda c: c.isNotNull())))
    typed = F.col("c.change") == "type_changed"
    return exploded.select(
        *keys,
        "name",
        "c.change",
        "c.breaking",
        F.when(typed, F.col("old_type")).alias("old_type"),
        F.when(typed, F.col("new_type")).alias("new_type"),
    )


def change_actions(changes: DataFrame, datasets: DataFrame, keys: list[str]) -> DataFrame:
    """Governance action per dataset from its classified changes."""
    counted = changes.groupBy(*keys).agg(
        F.count_if("breaking").alias("breaking_changes"),
        F.count_if(~F.col("breaking")).alias("non_breaking_changes"),
        F.count_if(F.col("change") == "column_removed").alias("_removed"),
    )
    numbers = ["breaking_changes", "non_breaking_changes", "_removed"]
    joined = datasets.select(*keys).distinct().join(counted, keys, "left").fillna(0, numbers)
    action = (
        F.when(F.col("_removed") > 0, "veto_eligible")
        .when(F.col("breaking_changes") > 0, "raci_approval")
        .when(F.col("non_breaking_changes") > 0, "auto_approve")
        .otherwise("no_change")
    )
    return (
        joined.withColumn("governance_action", action)
        .withColumn("requires_approval", F.col("breaking_changes") > 0)
        .drop("_removed")
    )


def latest_versions(snapshots: DataFrame, keys: list[str]) -> DataFrame:
    """Newest snapshot version per contract."""
    return snapshots.groupBy(*keys).agg(F.max("version").alias("version"))


def version_changes(snapshots: DataFrame, keys: list[str], slice_size: int = 1000) -> DataFrame:
    """Changes between each snapshot and its predecessor of the same contract (version numbers may have gaps)."""
    steps = snapshots.select(*keys, "version").distinct()
    # A slice holds at most ``slice_size`` versions of one contract.
    few = F.floor(F.col("version") / slice_size)
    linked = previous_value(steps, keys, [F.col("version")], "version", "previous", few).where("previous IS NOT NULL")
    step = [*keys, "version"]
    new = snapshots.join(linked, step, "left_semi")
    renamed = snapshots.withColumnRenamed("version", "previous")
    old = renamed.join(linked, [*keys, "previous"]).drop("previous")
    return schema_changes(old, new, step)


def schema_drift(fleet: DataFrame, expected: str = "expected", actual: str = "actual") -> DataFrame:
    """Sorted added and removed names of two name arrays, and whether anything differs."""
    added = F.array_sort(F.array_except(F.col(actual), F.col(expected)))
    removed = F.array_sort(F.array_except(F.col(expected), F.col(actual)))
    return (
        fleet.withColumn("added", added)
        .withColumn("removed", removed)
        .withColumn("has_drift", (F.size("added") > 0) | (F.size("removed") > 0))
    )
