"""Personal data, masks, noise and access policies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from govspark.functions import masking as m
from govspark.functions.pii import FLAG_PATTERNS, TYPE_PATTERNS
from govspark.operators import access as a
from govspark.operators.privacy import (
    classify_columns,
    detect_pii,
    mask_table,
    noisy_metrics,
    policy_for,
    policy_from_contract,
    spent_budget,
)
from govspark.operators.releases import noisy_on_grid, release, remaining_budget
from govspark.plans import derived as d
from govspark.plans.registry import query, table
from govspark.session import fresh_path
from govspark.vocabulary import CLASSIFICATIONS, CONTROLS, EPSILON, REQUIRED_CONTROLS, ROLE_PERMISSIONS

_TYPE_CASE = "CASE " + " ".join(f"WHEN regexp_matches(name, '{p}', 'i') THEN '{t}'" for t, p in TYPE_PATTERNS) + " END"
_FLAG = " OR ".join(f"regexp_matches(name, '{p}', 'i')" for p in FLAG_PATTERNS)


@query("pii_detect", f"""WITH {d.COLUMNS_SQL}
SELECT dataset_id, name, {_TYPE_CASE} AS pii_type FROM cols WHERE {_TYPE_CASE} IS NOT NULL""")
def pii_detect(spark: SparkSession, folder: str) -> DataFrame:
    return detect_pii(d.columns(spark, folder).select("dataset_id", "name"))


@query("pii_classify", f"""WITH {d.COLUMNS_SQL}
SELECT dataset_id, name, {_FLAG} AS is_pii, CASE WHEN {_FLAG} THEN 'pii' END AS suggested_tag FROM cols""")
def pii_classify(spark: SparkSession, folder: str) -> DataFrame:
    return classify_columns(d.columns(spark, folder).select("dataset_id", "name"))


def _masked(spark: SparkSession, folder: str, mask) -> DataFrame:
    return table(spark, folder, "customer").select("c_custkey", mask(F.col("c_name")).alias("masked"))


@query("mask_hash", "SELECT c_custkey, substr(sha256('pepper' || c_name), 1, 16) AS masked FROM customer")
def mask_hash(spark: SparkSession, folder: str) -> DataFrame:
    return _masked(spark, folder, lambda v: m.hash_mask(v, "pepper"))


@query("mask_redact", "SELECT c_custkey, '[REDACTED]' AS masked FROM customer")
def mask_redact(spark: SparkSession, folder: str) -> DataFrame:
    return _masked(spark, folder, m.redact)


@query("mask_partial", """
SELECT c_custkey, left(c_name, 2) || repeat('*', length(c_name) - 5) || right(c_name, 3) AS masked FROM customer
UNION ALL
SELECT -1 - c_custkey, CASE WHEN length(v) <= 5 THEN repeat('*', length(v))
       ELSE left(v, 2) || repeat('*', length(v) - 5) || right(v, 3) END
FROM (SELECT c_custkey, left(c_name, CAST(c_custkey % 9 AS INTEGER)) AS v FROM customer)""")
def mask_partial(spark: SparkSession, folder: str) -> DataFrame:
    """Whole names, and prefixes of 0 to 8 characters for the short branch."""
    customers = table(spark, folder, "customer")
    short = customers.select((-1 - F.col("c_custkey")).alias("c_custkey"),
                             F.left("c_name", (F.col("c_custkey") % 9).cast("int")).alias("c_name"))
    names = customers.select("c_custkey", "c_name").unionByName(short)
    return names.select("c_custkey", m.partial_mask(F.col("c_name"), 2, 3).alias("masked"))


@query("mask_tax_id", """
SELECT c_custkey, CASE WHEN length(v) <= 4 THEN repeat('*', length(v))
       ELSE repeat('*', length(v) - 4) || right(v, 4) END AS masked
FROM (SELECT c_custkey, CAST(c_custkey * 7 AS VARCHAR) AS v FROM customer)""")
def mask_tax_id(spark: SparkSession, folder: str) -> DataFrame:
    numbers = table(spark, folder, "customer").select("c_custkey", (F.col("c_custkey") * 7).cast("string").alias("v"))
    return numbers.select("c_custkey", m.tax_id_mask(F.col("v")).alias("masked"))


_EMAIL = "[A-Za-z0-9._]+@[A-Za-z0-9.]+"


@query("mask_email", f"""
WITH found AS (
  SELECT doc_id, unnest(list_concat(regexp_extract_all(text, '{_EMAIL}'),
         ['a@b@' || source || '.org', '@' || source, source || '-without-sign'])) AS v
  FROM documents)
SELECT doc_id, v AS address, CASE WHEN contains(v, '@')
       THEN substr(sha256(left(v, length(v) - length(list_last(string_split(v, '@'))) - 1)), 1, 8) || '@'
            || list_last(string_split(v, '@'))
       ELSE substr(sha256(v), 1, 16) END AS masked
FROM found""")
def mask_email(spark: SparkSession, folder: str) -> DataFrame:
    """Addresses in the texts, and three odd ones per document."""
    odd = F.array(
        F.concat(F.lit("a@b@"), "source", F.lit(".org")),
        F.concat(F.lit("@"), "source"),
        F.concat("source", F.lit("-without-sign")),
    )
    found = F.concat(F.regexp_extract_all("text", F.lit(_EMAIL), F.lit(0)), odd)
    values = table(spark, folder, "documents").select("doc_id", F.explode(found).alias("address"))
    return values.withColumn("masked", m.email_mask(F.col("address")))


@query("mask_table", """
SELECT c_custkey, substr(sha256(c_name), 1, 16) AS c_name, c_nationkey, c_acctbal, '[REDACTED]' AS c_mktsegment,
       CASE WHEN length(phone) <= 4 THEN repeat('*', length(phone)) ELSE repeat('*', length(phone) - 4) || right(phone, 4) END AS phone
FROM (SELECT *, '+' || c_nationkey || '-' || c_custkey AS phone FROM customer)""")
def mask_table_query(spark: SparkSession, folder: str) -> DataFrame:
    customers = table(spark, folder, "customer").withColumn(
        "phone", F.concat(F.lit("+"), "c_nationkey", F.lit("-"), "c_custkey")
    )
    return mask_table(customers, policy_for({"c_name": "flag", "c_mktsegment": "address", "phone": "phone"}))


_CLASS = f"{d.sql_list((*CLASSIFICATIONS, 'unlabelled'))}[CAST(left(o_orderpriority, 1) AS INTEGER)]"
_EPS = "CASE class " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in EPSILON.items()) + " ELSE 1.0 END"


@query("dp_aggregates", f"""
WITH metrics AS (
  SELECT o_orderpriority, o_orderstatus, count(*) AS n, {_CLASS} AS class FROM orders GROUP BY 1, 2),
drawn AS (
  SELECT *, ({_EPS})::DOUBLE AS eps, (CAST('0x' || substr(sha256('7|' || o_orderpriority || '|' || o_orderstatus), 1, 13) AS BIGINT)
         + 0.5) / 4503599627370496.0 - 0.5 AS u FROM metrics)
SELECT o_orderpriority, o_orderstatus, class AS classification, eps AS epsilon, 'laplace' AS mechanism,
       round(n - (2.0 / eps) * sign(u) * ln(greatest(1 - 2 * abs(u), 1 / 4503599627370496.0)), 4)::DOUBLE AS noisy_value
FROM drawn""")
def dp_aggregates(spark: SparkSession, folder: str) -> DataFrame:
    """Order counts with repeatable noise (seed 7)."""
    metrics = table(spark, folder, "orders").groupBy("o_orderpriority", "o_orderstatus").agg(
        F.count("*").cast("double").alias("n")
    )
    label = d.pick((*CLASSIFICATIONS, "unlabelled"), F.left("o_orderpriority", F.lit(1)).cast("int") - 1)
    noisy = noisy_metrics(metrics, "n", 2.0, label, seed=7, identity=["o_orderpriority", "o_orderstatus"])
    return noisy.select(
        "o_orderpriority", "o_orderstatus", "classification", "epsilon", "mechanism",
        F.round("noisy_value", 4).alias("noisy_value"),
    )


@query("dp_budget", f"""
WITH metrics AS (SELECT o_orderpriority, o_orderstatus, {_CLASS} AS class FROM orders GROUP BY 1, 2, 3)
SELECT class AS classification, count(*) AS metrics, round(sum(({_EPS})::DOUBLE), 6)::DOUBLE AS epsilon_total
FROM metrics GROUP BY 1""")
def dp_budget(spark: SparkSession, folder: str) -> DataFrame:
    budget = spent_budget(dp_aggregates(spark, folder), ["classification"])
    return budget.withColumn("epsilon_total", F.round("epsilon_total", 6))


def _draw(seed: int, identity: str, side: str) -> str:
    """Repeatable uniform value of the SQL form."""
    return f"((CAST('0x' || substr(sha256('{seed}|' || {identity} || '|{side}'), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0)"


def _discrete(seed: int, identity: str, rate: str) -> str:
    return f"(floor(-ln({_draw(seed, identity, 'up')}) / ({rate})) - floor(-ln({_draw(seed, identity, 'down')}) / ({rate})))"


@query("dp_grid_aggregates", f"""
WITH metrics AS (SELECT o_orderpriority, o_orderstatus, sum(o_totalprice) AS total FROM orders GROUP BY 1, 2)
SELECT o_orderpriority, o_orderstatus,
       ((floor(total / 0.25 + 0.5) + {_discrete(3, "o_orderpriority || '|' || o_orderstatus", "0.5 / 400")}) * 0.25)::DOUBLE AS noisy_value
FROM metrics""")
def dp_grid_aggregates(spark: SparkSession, folder: str) -> DataFrame:
    """Sums of prices (a customer changes them by 100 at most) on a grid of quarters."""
    metrics = table(spark, folder, "orders").groupBy("o_orderpriority", "o_orderstatus").agg(F.sum("o_totalprice").alias("total"))
    noisy = noisy_on_grid(metrics, "total", F.lit(0.5), 100.0, 0.25, seed=3, identity=["o_orderpriority", "o_orderstatus"])
    return noisy.select("o_orderpriority", "o_orderstatus", "noisy_value")


# Seven line numbers ask for each of twenty datasets, the first four in a first batch; the second batch repeats them. One has
# no budget.
_RELEASES_SQL = f"""asked AS (
  SELECT 's' || l_suppkey % 20 || '-' || l_linenumber AS request_id, 's' || l_suppkey % 20 AS dataset_id, l_linenumber AS n, 0.1 * (1 + l_linenumber % 4) AS epsilon,
         count(*) AS value, CASE WHEN l_linenumber <= 4 THEN 0 ELSE 1 END AS batch
  FROM lineitem GROUP BY ALL),
ahead AS (SELECT *, sum(epsilon::DECIMAL(38,12)) OVER (PARTITION BY dataset_id, batch ORDER BY n) AS so_far FROM asked),
first AS (SELECT dataset_id, sum(epsilon::DECIMAL(38,12)) AS spent FROM ahead WHERE batch = 0 AND so_far <= 0.95 AND dataset_id <> 's7' GROUP BY 1),
judged AS (
  SELECT ahead.*, CASE WHEN dataset_id = 's7' THEN 'dataset has no budget'
         WHEN so_far + CASE WHEN batch = 1 THEN coalesce(spent, 0) ELSE 0 END > 0.95 THEN 'budget exhausted' END AS reason
  FROM ahead LEFT JOIN first USING (dataset_id)),
answers AS (
  SELECT request_id, dataset_id, epsilon::DOUBLE AS epsilon, reason IS NULL AS released, reason,
         CASE WHEN reason IS NULL THEN (floor(value + 0.5) + {_discrete(5, "request_id", "epsilon::DOUBLE")})::DOUBLE END AS noisy_value
  FROM judged)"""


def _released(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    dataset = F.concat(F.lit("s"), F.col("l_suppkey") % 20).alias("dataset_id")
    asked = table(spark, folder, "lineitem").groupBy(dataset, "l_linenumber").agg(F.count("*").alias("value")).select(
        F.concat_ws("-", "dataset_id", "l_linenumber").alias("request_id"), "dataset_id",
        F.col("l_linenumber").alias("requested_at"), "value", (F.lit(0.1) * (1 + F.col("l_linenumber") % 4)).alias("epsilon"),
    )
    budgets = asked.select("dataset_id").distinct().where("dataset_id <> 's7'").withColumn("budget", F.lit(0.95))
    path = fresh_path(spark, "ledger")
    release(path, asked.where("requested_at <= 4"), budgets, seed=5)
    return release(path, asked, budgets, seed=5), budgets


@query("dp_releases", f"WITH {_RELEASES_SQL} SELECT request_id, dataset_id, round(epsilon, 6)::DOUBLE AS epsilon, released, reason, noisy_value FROM answers")
def dp_releases(spark: SparkSession, folder: str) -> DataFrame:
    """Counts released until the budget of their dataset is spent; what was answered before is answered the same."""
    answers, _ = _released(spark, folder)
    return answers.withColumn("epsilon", F.round("epsilon", 6))


@query("dp_remaining", f"""WITH {_RELEASES_SQL},
spent AS (SELECT dataset_id, coalesce(sum(epsilon) FILTER (WHERE released), 0) AS spent, count(*) FILTER (WHERE NOT released) AS refused FROM answers GROUP BY 1)
SELECT dataset_id, CASE WHEN dataset_id = 's7' THEN 0.0 ELSE 0.95 END::DOUBLE AS budget, round(spent, 6)::DOUBLE AS spent,
       round(CASE WHEN dataset_id = 's7' THEN 0.0 ELSE 0.95 END - spent, 6)::DOUBLE AS remaining, refused
FROM spent""")
def dp_remaining(spark: SparkSession, folder: str) -> DataFrame:
    ledger, budgets = _released(spark, folder)
    return remaining_budget(ledger, budgets).withColumns({"spent": F.round("spent", 6), "remaining": F.round("remaining", 6)})


_REQUIRED = "CASE classification " + " ".join(
    f"WHEN '{k}' THEN {d.sql_list(v)}" for k, v in REQUIRED_CONTROLS.items()
) + f" ELSE {d.sql_list(REQUIRED_CONTROLS['internal'])} END"


@query("control_gaps", f"""WITH {d.DATASETS_SQL}
SELECT dataset_id, classification, missing_control FROM (
  SELECT dataset_id, classification, k, unnest({_REQUIRED}) AS missing_control FROM datasets)
WHERE NOT list_contains([{d.sql_list(CONTROLS)}[CAST(k % 7 AS INTEGER) + 1], 'rbac'], missing_control)""")
def control_gaps(spark: SparkSession, folder: str) -> DataFrame:
    """Every dataset has access control and one more measure."""
    present = F.array(d.pick(CONTROLS, F.col("k") % 7), F.lit("rbac"))
    fleet = d.datasets(spark, folder).select("dataset_id", "classification", present.alias("controls"))
    return a.control_gaps(fleet)


@query("control_matrix", f"""WITH {d.DATASETS_SQL}
SELECT dataset_id, classification, {", ".join(f"list_contains({_REQUIRED}, '{name}') AS {name}" for name in CONTROLS)}
FROM datasets""")
def control_matrix(spark: SparkSession, folder: str) -> DataFrame:
    return a.control_matrix(d.datasets(spark, folder).select("dataset_id", "classification"))


_JURISDICTIONS = ("br", "eu", "us", "global", "jp")


@query("jurisdiction_policy", f"""
SELECT n_nationkey, jurisdiction,
       CASE jurisdiction WHEN 'br' THEN 'lgpd,dama_dmbok' WHEN 'eu' THEN 'gdpr,eu_ai_act,dama_dmbok'
            WHEN 'us' THEN 'sox,nist_ai_rmf,dama_dmbok' WHEN 'global' THEN 'iso_42001,dama_dmbok' ELSE '' END AS frameworks,
       jurisdiction IN ('eu', 'br') AS transfer_restricted
FROM (SELECT n_nationkey, {d.sql_list(_JURISDICTIONS)}[n_regionkey + 1] AS jurisdiction FROM nation)""")
def jurisdiction_policy(spark: SparkSession, folder: str) -> DataFrame:
    nations = table(spark, folder, "nation").select(
        "n_nationkey", d.pick(_JURISDICTIONS, F.col("n_regionkey")).alias("jurisdiction")
    )
    return a.jurisdiction_policy(nations).withColumn("frameworks", F.array_join("frameworks", ","))


@query("transfer_check", f"""
SELECT o_orderkey, source, target, source = target OR source NOT IN ('eu', 'br') AS allowed FROM (
  SELECT o_orderkey, {d.sql_list(_JURISDICTIONS)}[n_regionkey + 1] AS source,
         {d.sql_list(_JURISDICTIONS)}[CAST(o_orderkey % 5 AS INTEGER) + 1] AS target
  FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey)""")
def transfer_check(spark: SparkSession, folder: str) -> DataFrame:
    customers = table(spark, folder, "customer").select("c_custkey", "c_nationkey")
    nations = table(spark, folder, "nation").select("n_nationkey", "n_regionkey")
    log = (
        table(spark, folder, "orders")
        .select("o_orderkey", "o_custkey")
        .join(customers, F.col("o_custkey") == F.col("c_custkey"))
        .join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    )
    return log.select(
        "o_orderkey",
        d.pick(_JURISDICTIONS, F.col("n_regionkey")).alias("source"),
        d.pick(_JURISDICTIONS, F.col("o_orderkey") % 5).alias("target"),
    ).withColumn("allowed", a.transfer_allowed(F.col("source"), F.col("target")))


_ROLES = ("data_steward", "admin", "responsible", "accountable", "consulted", "informed")


@query("column_access", f"""WITH {d.COLUMNS_SQL}
SELECT c.dataset_id, c.name, NOT ({_FLAG.replace("name", "c.name")}) OR list_contains(['data_steward', 'admin'],
       {d.sql_list(_ROLES)}[CAST((c.k + c.i) % 6 AS INTEGER) + 1]) OR t.classification = 'public' AS visible
FROM cols c JOIN datasets t USING (dataset_id)""")
def column_access(spark: SparkSession, folder: str) -> DataFrame:
    classes = d.datasets(spark, folder).select("dataset_id", "classification")
    columns = d.columns(spark, folder).join(classes, "dataset_id")
    flagged = classify_columns(columns)
    role = F.array(d.pick(_ROLES, (F.col("k") + F.col("i")) % 6))
    visible = a.column_visible(F.col("is_pii"), role, F.col("classification"))
    return flagged.select("dataset_id", "name", visible.alias("visible"))


_REQUEST_ROLES_SQL = f"""CASE WHEN event_id % 4 = 0 THEN CAST([] AS VARCHAR[]) WHEN event_id % 4 = 3 THEN NULL
  ELSE [{d.sql_list(_ROLES)}[CAST(event_id % 6 AS INTEGER) + 1], {d.sql_list(_ROLES)}[CAST(user_id % 6 AS INTEGER) + 1]] END"""


@query("access_decisions", f"""
WITH log AS (
  SELECT event_id, CASE WHEN event_type IN ('view', 'click') THEN 'read' WHEN event_type = 'purchase' THEN 'write' ELSE 'drop' END AS action,
         {_REQUEST_ROLES_SQL} AS roles FROM events)
SELECT event_id, action, coalesce(list_contains(roles, 'admin') OR (action = 'read' AND len(roles) > 0)
       OR (action = 'write' AND list_has_any(roles, ['responsible', 'accountable'])), false) AS allowed
FROM log""")
def access_decisions(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("event_id")
    held = F.array(d.pick(_ROLES, key % 6), d.pick(_ROLES, F.col("user_id") % 6))
    log = table(spark, folder, "events").select(
        "event_id",
        F.when(F.col("event_type").isin("view", "click"), "read")
        .when(F.col("event_type") == "purchase", "write")
        .otherwise("drop")
        .alias("action"),
        F.when(key % 4 == 0, F.array().cast("array<string>")).when(key % 4 != 3, held).alias("roles"),
    )
    return log.select("event_id", "action", a.access_allowed(F.col("action"), F.col("roles")).alias("allowed"))


@query("role_permissions", f"""WITH {d.ASSIGNMENTS_SQL}
SELECT id, role, unnest(CASE role {" ".join(f"WHEN '{k}' THEN {d.sql_list(v)}" for k, v in ROLE_PERMISSIONS.items())} END) AS permission
FROM assignments""")
def role_permissions(spark: SparkSession, folder: str) -> DataFrame:
    return a.role_permissions(d.assignments(spark, folder).select("id", "role"))


@query("permission_check", f"""WITH {d.ASSIGNMENTS_SQL}
SELECT event_id FROM events WHERE EXISTS (
  SELECT 1 FROM assignments a WHERE a.user_id = 'c' || events.user_id AND a.role = 'accountable')""")
def permission_check(spark: SparkSession, folder: str) -> DataFrame:
    """Events by users whose role includes the veto permission."""
    holders = a.role_permissions(d.assignments(spark, folder)).where("permission = 'veto'").select("user_id").distinct()
    events = table(spark, folder, "events").select("event_id", F.concat(F.lit("c"), "user_id").alias("user_id"))
    return events.join(holders, "user_id", "left_semi").select("event_id")


@query("visible_projection", "SELECT c_custkey, c_nationkey, c_mktsegment FROM customer")
def visible_projection(spark: SparkSession, folder: str) -> DataFrame:
    """What a consulted user may read of the customers."""
    customers = table(spark, folder, "customer")
    return a.visible_columns(customers, {"c_name": True, "c_acctbal": True}, ["consulted"], "confidential")


@query("mask_by_contract", """
SELECT c_custkey, substr(sha256(c_name), 1, 16) AS c_name, c_mktsegment,
       CASE WHEN length(tax_id) <= 4 THEN repeat('*', length(tax_id)) ELSE repeat('*', length(tax_id) - 4) || right(tax_id, 4) END AS tax_id
FROM (SELECT *, CAST(c_custkey * 13 AS VARCHAR) AS tax_id FROM customer)""")
def mask_by_contract(spark: SparkSession, folder: str) -> DataFrame:
    """The contract marks the name and the tax id as personal data."""
    customers = table(spark, folder, "customer").select(
        "c_custkey", "c_name", "c_mktsegment", (F.col("c_custkey") * 13).cast("string").alias("tax_id")
    )
    contract = spark.createDataFrame(
        [("c_custkey", False), ("c_name", True), ("c_mktsegment", False), ("tax_id", True)], "name string, pii boolean"
    )
    return mask_table(customers, policy_from_contract(contract))
