"""Contracts of the fleet: validation, changes, history, drift."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from govspark.operators.contracts import (
    change_actions,
    contract_issues,
    contract_validation,
    latest_versions,
    schema_changes,
    schema_drift,
    version_changes,
)
from govspark.plans import derived as d
from govspark.plans.registry import query, table
from govspark.sources.config import contract_columns, parse_contracts

_KEYS = ["dataset_id"]

_ISSUES_SQL = f"""{d.OTHER_COLUMNS_SQL}, issues AS (
  SELECT coalesce(e.dataset_id, a.dataset_id) AS dataset_id, coalesce(e.name, a.name) AS name,
         e.data_type AS expected_type, a.data_type AS actual_type,
         CASE WHEN a.name IS NULL THEN 'missing_column' WHEN e.name IS NULL THEN 'extra_column'
              WHEN e.data_type <> a.data_type THEN 'type_mismatch' END AS issue
  FROM cols e FULL OUTER JOIN other a ON e.dataset_id = a.dataset_id AND e.name = a.name)"""


@query("contract_issues", f"WITH {_ISSUES_SQL} SELECT * FROM issues WHERE issue IS NOT NULL")
def contract_issues_query(spark: SparkSession, folder: str) -> DataFrame:
    return contract_issues(d.columns(spark, folder), d.other_columns(spark, folder), _KEYS)


@query("contract_validation", f"""WITH {_ISSUES_SQL}
SELECT dataset_id, count(*) FILTER (WHERE issue = 'missing_column') AS missing_columns,
       count(*) FILTER (WHERE issue = 'type_mismatch') AS type_mismatches,
       count(*) FILTER (WHERE issue = 'extra_column') AS extra_columns,
       count(*) FILTER (WHERE issue IN ('missing_column', 'type_mismatch')) = 0 AS valid
FROM issues GROUP BY dataset_id""")
def contract_validation_query(spark: SparkSession, folder: str) -> DataFrame:
    return contract_validation(d.columns(spark, folder), d.other_columns(spark, folder), _KEYS)


_CHANGES_SQL = f"""{d.OTHER_COLUMNS_SQL}, paired AS (
  SELECT coalesce(o.dataset_id, n.dataset_id) AS dataset_id, coalesce(o.name, n.name) AS name,
         o.data_type AS old_type, n.data_type AS new_type, o.nullable AS old_null, n.nullable AS new_null,
         o.name IS NULL AS added, n.name IS NULL AS removed
  FROM cols o FULL OUTER JOIN other n ON o.dataset_id = n.dataset_id AND o.name = n.name),
changes AS (
  SELECT dataset_id, name, 'column_removed' AS change, true AS breaking, NULL AS old_type, NULL AS new_type FROM paired WHERE removed
  UNION ALL SELECT dataset_id, name, 'non_nullable_column_added', true, NULL, NULL FROM paired WHERE added AND NOT new_null
  UNION ALL SELECT dataset_id, name, 'nullable_column_added', false, NULL, NULL FROM paired WHERE added AND new_null
  UNION ALL SELECT dataset_id, name, 'type_changed', true, old_type, new_type FROM paired
    WHERE NOT added AND NOT removed AND old_type <> new_type
  UNION ALL SELECT dataset_id, name, 'nullable_to_non_nullable', true, NULL, NULL FROM paired
    WHERE NOT added AND NOT removed AND old_null AND NOT new_null)"""


@query("breaking_changes", f"WITH {_CHANGES_SQL} SELECT * FROM changes")
def breaking_changes(spark: SparkSession, folder: str) -> DataFrame:
    return schema_changes(d.columns(spark, folder), d.other_columns(spark, folder), _KEYS)


@query("contract_action", f"""WITH {_CHANGES_SQL}, counted AS (
  SELECT p.dataset_id, count(*) FILTER (WHERE breaking) AS breaking_changes,
         count(*) FILTER (WHERE NOT breaking) AS non_breaking_changes,
         count(*) FILTER (WHERE change = 'column_removed') AS removed
  FROM datasets p LEFT JOIN changes c ON c.dataset_id = p.dataset_id GROUP BY p.dataset_id)
SELECT dataset_id, breaking_changes, non_breaking_changes, breaking_changes > 0 AS requires_approval,
       CASE WHEN removed > 0 THEN 'veto_eligible' WHEN breaking_changes > 0 THEN 'raci_approval'
            WHEN non_breaking_changes > 0 THEN 'auto_approve' ELSE 'no_change' END AS governance_action
FROM counted""")
def contract_action(spark: SparkSession, folder: str) -> DataFrame:
    changes = schema_changes(d.columns(spark, folder), d.other_columns(spark, folder), _KEYS)
    return change_actions(changes, d.datasets(spark, folder), _KEYS)


def snapshots(spark: SparkSession, folder: str) -> DataFrame:
    """Contract per order priority and customer, a version per order; columns from the order's fields."""
    orders = table(spark, folder, "orders").select(
        F.concat_ws("-", F.lit("c"), "o_custkey").alias("contract_id"),
        F.col("o_orderkey").alias("version"),
        F.col("o_orderstatus").alias("status"),
        F.left("o_orderpriority", F.lit(1)).cast("int").alias("p"),
    )
    fields = F.array(
        F.struct(F.lit("id").alias("name"), F.lit("integer").alias("data_type"), F.lit(False).alias("nullable")),
        F.struct(F.lit("amount").alias("name"), F.when(F.col("status") == "O", "float").otherwise("string")
                 .alias("data_type"), (F.col("p") % 2 == 0).alias("nullable")),
        F.struct(F.concat(F.lit("extra_"), F.col("p")).alias("name"), F.lit("string").alias("data_type"),
                 (F.col("status") == "F").alias("nullable")),
    )
    return orders.select("contract_id", "version", F.explode(fields).alias("f")).select("contract_id", "version", "f.*")


_SNAPSHOT_SQL = """snap AS (
  SELECT 'c-' || o_custkey AS contract_id, o_orderkey AS version, f.name, f.data_type, f.nullable
  FROM (SELECT o_custkey, o_orderkey, unnest([
      {'name': 'id', 'data_type': 'integer', 'nullable': false},
      {'name': 'amount', 'data_type': CASE WHEN o_orderstatus = 'O' THEN 'float' ELSE 'string' END,
       'nullable': CAST(left(o_orderpriority, 1) AS INTEGER) % 2 = 0},
      {'name': 'extra_' || left(o_orderpriority, 1), 'data_type': 'string', 'nullable': o_orderstatus = 'F'}]) AS f
    FROM orders))"""


@query("contract_history", f"""WITH {_SNAPSHOT_SQL}, steps AS (
  SELECT contract_id, version, lag(version) OVER (PARTITION BY contract_id ORDER BY version) AS previous
  FROM (SELECT DISTINCT contract_id, version FROM snap)),
news AS (SELECT s.contract_id, s.version, n.name, n.data_type, n.nullable FROM steps s
  JOIN snap n ON n.contract_id = s.contract_id AND n.version = s.version WHERE s.previous IS NOT NULL),
olds AS (SELECT s.contract_id, s.version, o.name, o.data_type, o.nullable FROM steps s
  JOIN snap o ON o.contract_id = s.contract_id AND o.version = s.previous),
paired AS (
  SELECT coalesce(o.contract_id, n.contract_id) AS contract_id, coalesce(o.version, n.version) AS version,
         coalesce(o.name, n.name) AS name, o.data_type AS old_type, n.data_type AS new_type,
         o.nullable AS old_null, n.nullable AS new_null, o.name IS NULL AS added, n.name IS NULL AS removed
  FROM olds o FULL OUTER JOIN news n ON o.contract_id = n.contract_id AND o.version = n.version AND o.name = n.name)
SELECT contract_id, version, name, 'column_removed' AS change, true AS breaking, NULL AS old_type, NULL AS new_type FROM paired WHERE removed
UNION ALL SELECT contract_id, version, name, 'non_nullable_column_added', true, NULL, NULL FROM paired WHERE added AND NOT new_null
UNION ALL SELECT contract_id, version, name, 'nullable_column_added', false, NULL, NULL FROM paired WHERE added AND new_null
UNION ALL SELECT contract_id, version, name, 'type_changed', true, old_type, new_type FROM paired
  WHERE NOT added AND NOT removed AND old_type <> new_type
UNION ALL SELECT contract_id, version, name, 'nullable_to_non_nullable', true, NULL, NULL FROM paired
  WHERE NOT added AND NOT removed AND old_null AND NOT new_null""")
def contract_history(spark: SparkSession, folder: str) -> DataFrame:
    return version_changes(snapshots(spark, folder), ["contract_id"])


@query("contract_latest", f"""WITH {_SNAPSHOT_SQL}
SELECT contract_id, max(version) AS version FROM snap GROUP BY 1""")
def contract_latest(spark: SparkSession, folder: str) -> DataFrame:
    return latest_versions(snapshots(spark, folder), ["contract_id"])


@query("schema_drift", f"""WITH {d.DATASETS_SQL}, fleet AS (
  SELECT dataset_id, ['id', 'name', string_split(name, ' ')[1]] AS expected, ['id', string_split(name, ' ')[2], owner_id] AS actual
  FROM datasets)
SELECT dataset_id,
       array_to_string(list_sort(list_filter(actual, lambda x: NOT list_contains(expected, x))), ',') AS added,
       array_to_string(list_sort(list_filter(expected, lambda x: NOT list_contains(actual, x))), ',') AS removed,
       len(list_filter(actual, lambda x: NOT list_contains(expected, x)))
       + len(list_filter(expected, lambda x: NOT list_contains(actual, x))) > 0 AS has_drift
FROM fleet""")
def schema_drift_query(spark: SparkSession, folder: str) -> DataFrame:
    first, second = F.split("name", " ")[0], F.split("name", " ")[1]
    fleet = d.datasets(spark, folder).select(
        "dataset_id",
        F.array(F.lit("id"), F.lit("name"), first).alias("expected"),
        F.array(F.lit("id"), second, F.col("owner_id")).alias("actual"),
    )
    return schema_drift(fleet).select(
        "dataset_id", F.array_join("added", ",").alias("added"), F.array_join("removed", ",").alias("removed"), "has_drift"
    )


def contract_texts(spark: SparkSession, folder: str) -> DataFrame:
    """A YAML contract per supplier; every third has no terms, every fifth one column less."""
    lines = F.concat_ws(
        "\n",
        F.concat(F.lit("dataset_id: sales/"), "s_suppkey"),
        F.concat(F.lit("domain_id: nation_"), "s_nationkey"),
        F.lit("owner_id: team"),
        F.lit("schema:\n  columns:\n  - {name: id, data_type: string, nullable: false, description: 'Key: unique'}"),
        F.when(F.col("s_suppkey") % 5 != 0, "  - name: tax_id\n    data_type: string\n    pii: true"),
        F.lit("  primary_key: [id]"),
        F.when(F.col("s_suppkey") % 3 != 0, F.concat(F.lit("sla:\n  freshness_hours: "), F.col("s_nationkey") + 1)),
    )
    path = F.concat(F.lit("contract_"), "s_suppkey", F.lit(".yaml"))
    return table(spark, folder, "supplier").select(path.alias("path"), lines.alias("value"))


@query("contract_columns", """
WITH parsed AS (SELECT 'sales/' || s_suppkey AS dataset_id, s_suppkey FROM supplier)
SELECT dataset_id, CAST(0 AS INTEGER) AS position, 'id' AS name, 'string' AS data_type, false AS nullable,
       'Key: unique' AS description, false AS pii FROM parsed
UNION ALL
SELECT dataset_id, CAST(1 AS INTEGER), 'tax_id', 'string', true, '', true FROM parsed WHERE s_suppkey % 5 <> 0""")
def contract_columns_query(spark: SparkSession, folder: str) -> DataFrame:
    return contract_columns(parse_contracts(contract_texts(spark, folder)))


@query("contract_terms", """
SELECT 'contract_' || s_suppkey AS name, 'sales/' || s_suppkey AS dataset_id, 'nation_' || s_nationkey AS domain_id,
       CASE WHEN s_suppkey % 3 <> 0 THEN CAST(s_nationkey + 1 AS DOUBLE) END AS freshness_hours,
       0.95::DOUBLE AS completeness_threshold, 99.0::DOUBLE AS availability_percent, 'id' AS primary_key
FROM supplier""")
def contract_terms(spark: SparkSession, folder: str) -> DataFrame:
    contracts = parse_contracts(contract_texts(spark, folder))
    return contracts.select(
        "name", "dataset_id", "domain_id", "freshness_hours", "completeness_threshold", "availability_percent",
        F.array_join("primary_key", ",").alias("primary_key"),
    )
