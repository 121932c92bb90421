"""Governance tables derived from the supplied tables, as DataFrames and as the same SQL.

Each ``*_SQL`` text is one common table expression for the oracle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from govspark.operators.expectations import KINDS
from govspark.plans.registry import table


def words(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def sql_list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def pick(values, index: Column) -> Column:
    return F.get(words(values), index.cast("int"))


# --- expectation results: one per line item, a dataset per supplier ----------------------------------------------

RESULT_TYPES = [*KINDS, "expect_something_unmapped"]


def results(spark: SparkSession, folder: str) -> DataFrame:
    kind = pick(RESULT_TYPES, (F.col("l_linenumber") * 2 + F.col("l_suppkey")) % len(RESULT_TYPES))
    success = F.when(F.col("l_returnflag") != "N", F.col("l_returnflag") == "A").when(F.col("l_quantity") < 45, True)
    return table(spark, folder, "lineitem").select(
        F.concat(F.lit("ds_"), F.col("l_suppkey")).alias("dataset_id"),
        kind.alias("expectation_type"),
        success.alias("success"),
    )


RESULTS_SQL = f"""results AS (
  SELECT 'ds_' || l_suppkey AS dataset_id,
         {sql_list(RESULT_TYPES)}[CAST((l_linenumber * 2 + l_suppkey) % {len(RESULT_TYPES)} AS INTEGER) + 1] AS expectation_type,
         CASE WHEN l_returnflag <> 'N' THEN l_returnflag = 'A' WHEN l_quantity < 45 THEN true END AS success
  FROM lineitem)"""

DIMENSION_SQL = "dimension_map(expectation_type, dimension) AS (VALUES " + ", ".join(
    f"('{name}', '{kind.dimension}')" for name, kind in KINDS.items()
) + """), dims(dimension) AS (VALUES ('completeness'), ('accuracy'), ('consistency'), ('timeliness'), ('uniqueness'),
  ('validity'))"""

SCORES_SQL = f"""{RESULTS_SQL}, {DIMENSION_SQL}, scored AS (
  SELECT dataset_id, dimension, avg(CASE WHEN success THEN 1.0 ELSE 0.0 END) AS score
  FROM results JOIN dimension_map USING (expectation_type) GROUP BY ALL),
scores AS (
  SELECT d.dataset_id, dims.dimension, coalesce(s.score, 1.0) AS score
  FROM (SELECT DISTINCT dataset_id FROM results) d CROSS JOIN dims
  LEFT JOIN scored s ON s.dataset_id = d.dataset_id AND s.dimension = dims.dimension)"""

# --- fleet: a dataset per part, eight columns each -----------------------------------------------------------------

COLUMN_NAMES = (
    "customer_cpf", "cpf", "cnpj_empresa", "tax_id", "e_mail", "email_address", "charge", "zip_code", "postal_code",
    "phone_home", "mobile_no", "telefone", "full_name", "last_name", "user_full_name", "birth_date", "dob",
    "credit_card_no", "card_number", "account_number", "iban", "passport_no", "rg_number", "driver_license",
    "identity_doc", "social.security", "id", "amount", "price", "cost_center", "created_at", "updated_at",
    "order_date", "status", "region", "quantity", "street", "revenue", "comment", "target",
)
COLUMN_TYPES = ("string", "integer", "float", "timestamp", "boolean")
FLEET_LAYERS = ("bronze", "silver", "gold", "platinum", "landing")
FLEET_CLASSES = ("public", "internal", "confidential", "restricted", "top_secret", "unlabelled")
FLEET_SUITES = ("default", "finance", "default_gold", "empty", "ghost")


def datasets(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("p_partkey")
    return table(spark, folder, "part").select(
        F.concat(F.lit("ds_"), key).alias("dataset_id"),
        F.col("p_brand").alias("domain_id"),
        F.col("p_name").alias("name"),
        F.col("p_type").alias("owner_id"),
        pick(FLEET_LAYERS, key % 5).alias("layer"),
        pick(FLEET_CLASSES, key % 6).alias("classification"),
        pick(FLEET_SUITES, key % 7).alias("suite"),
        (F.col("p_size") / 50.0).alias("quality_score"),
        key.alias("k"),
    )


DATASETS_SQL = f"""datasets AS (
  SELECT 'ds_' || p_partkey AS dataset_id, p_brand AS domain_id, p_name AS name, p_type AS owner_id,
         {sql_list(FLEET_LAYERS)}[CAST(p_partkey % 5 AS INTEGER) + 1] AS layer,
         {sql_list(FLEET_CLASSES)}[CAST(p_partkey % 6 AS INTEGER) + 1] AS classification,
         {sql_list(FLEET_SUITES)}[CAST(p_partkey % 7 AS INTEGER) + 1] AS suite,
         p_size / 50.0 AS quality_score, p_partkey AS k
  FROM part)"""


def columns(spark: SparkSession, folder: str, count: int = 8) -> DataFrame:
    """Columns of every dataset; ``i`` is the position."""
    spread = datasets(spark, folder).select(
        "dataset_id", "k", F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("i")
    )
    return spread.select(
        "dataset_id",
        "k",
        "i",
        pick(COLUMN_NAMES, (F.col("k") * 7 + F.col("i") * 5) % len(COLUMN_NAMES)).alias("name"),
        pick(COLUMN_TYPES, (F.col("k") + F.col("i")) % 5).alias("data_type"),
        ((F.col("k") + F.col("i")) % 2 == 0).alias("nullable"),
    )


COLUMNS_SQL = f"""{DATASETS_SQL}, cols AS (
  SELECT dataset_id, k, i,
         {sql_list(COLUMN_NAMES)}[CAST((k * 7 + i * 5) % {len(COLUMN_NAMES)} AS INTEGER) + 1] AS name,
         {sql_list(COLUMN_TYPES)}[CAST((k + i) % 5 AS INTEGER) + 1] AS data_type,
         (k + i) % 2 = 0 AS nullable
  FROM datasets, (SELECT unnest(range(8)) AS i))"""


def other_columns(spark: SparkSession, folder: str) -> DataFrame:
    """The same fleet in another state: some columns renamed, retyped or with other nullability."""
    k, i = F.col("k"), F.col("i")
    return columns(spark, folder).select(
        "dataset_id",
        F.when((k + i) % 11 == 0, F.concat(F.lit("new_"), "name")).otherwise(F.col("name")).alias("name"),
        F.when((k * 3 + i) % 13 == 0, "string").otherwise(F.col("data_type")).alias("data_type"),
        F.when((k + 2 * i) % 7 == 0, ~F.col("nullable")).otherwise(F.col("nullable")).alias("nullable"),
    )


OTHER_COLUMNS_SQL = f"""{COLUMNS_SQL}, other AS (
  SELECT dataset_id, CASE WHEN (k + i) % 11 = 0 THEN 'new_' || name ELSE name END AS name,
         CASE WHEN (k * 3 + i) % 13 = 0 THEN 'string' ELSE data_type END AS data_type,
         CASE WHEN (k + 2 * i) % 7 = 0 THEN NOT nullable ELSE nullable END AS nullable
  FROM cols)"""

# --- decisions, votes, vetoes, roles -----------------------------------------------------------------------------


def decisions(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("o_orderkey")
    return table(spark, folder, "orders").select(
        key.alias("id"),
        F.when(key % 10 == 0, "emergency").when(key % 3 == 0, "data_promotion").otherwise("schema_change").alias(
            "decision_type"
        ),
        F.concat(F.lit("order "), key).alias("title"),
        F.when(key % 20 == 7, "pending").otherwise("awaiting_approval").alias("status"),
        F.col("o_orderpriority").alias("domain_id"),
        F.concat(F.lit("c"), F.col("o_custkey")).alias("created_by"),
        F.col("o_orderdate").alias("created_at"),
    )


DECISIONS_SQL = """decisions AS (
  SELECT o_orderkey AS id,
         CASE WHEN o_orderkey % 10 = 0 THEN 'emergency' WHEN o_orderkey % 3 = 0 THEN 'data_promotion'
              ELSE 'schema_change' END AS decision_type,
         'order ' || o_orderkey AS title,
         CASE WHEN o_orderkey % 20 = 7 THEN 'pending' ELSE 'awaiting_approval' END AS status,
         o_orderpriority AS domain_id, 'c' || o_custkey AS created_by, o_orderdate AS created_at
  FROM orders)"""


def _line_id() -> Column:
    parts = (("l_partkey", 10), ("l_suppkey", 8), ("l_quantity", 3))
    return F.concat_ws("-", *[F.lpad(F.col(c).cast("bigint").cast("string"), n, "0") for c, n in parts])


_LINE_ID_SQL = """lpad(CAST(l_partkey AS VARCHAR), 10, '0') || '-' || lpad(CAST(l_suppkey AS VARCHAR), 8, '0')
         || '-' || lpad(CAST(CAST(l_quantity AS BIGINT) AS VARCHAR), 3, '0')"""


def votes(spark: SparkSession, folder: str) -> DataFrame:
    vote = F.col("l_returnflag")
    return table(spark, folder, "lineitem").select(
        _line_id().alias("id"),
        F.col("l_orderkey").alias("decision_id"),
        F.concat(F.lit("u"), F.col("l_linenumber")).alias("voter_id"),
        F.when(vote == "A", "approve").when(vote == "R", "reject").otherwise("abstain").alias("vote"),
        F.col("l_shipdate").alias("voted_at"),
    )


VOTES_SQL = f"""votes AS (
  SELECT {_LINE_ID_SQL} AS id, l_orderkey AS decision_id, 'u' || l_linenumber AS voter_id,
         CASE l_returnflag WHEN 'A' THEN 'approve' WHEN 'R' THEN 'reject' ELSE 'abstain' END AS vote,
         l_shipdate AS voted_at
  FROM lineitem)"""


def roles(spark: SparkSession, folder: str) -> DataFrame:
    """Seven users in every domain that occurs; user 7 has no role in the domains 3 to 5."""
    domains = table(spark, folder, "orders").select(F.col("o_orderpriority").alias("domain_id")).distinct()
    spread = domains.select("domain_id", F.explode(F.sequence(F.lit(1), F.lit(7))).alias("u"))
    k = F.left("domain_id", F.lit(1)).cast("int")
    role = (
        F.when(F.col("u") % 7 == k % 7, "accountable")
        .when(F.col("u") % 7 == (k + 3) % 7, "responsible")
        .when(F.col("u") % 2 == 0, "consulted")
        .otherwise("informed")
    )
    return spread.where((F.col("u") < 7) | (k < 3)).select(
        F.concat(F.lit("u"), F.col("u")).alias("user_id"), "domain_id", role.alias("role")
    )


ROLES_SQL = """roles AS (
  SELECT 'u' || u AS user_id, domain_id,
         CASE WHEN u % 7 = k % 7 THEN 'accountable' WHEN u % 7 = (k + 3) % 7 THEN 'responsible'
              WHEN u % 2 = 0 THEN 'consulted' ELSE 'informed' END AS role
  FROM (SELECT DISTINCT o_orderpriority AS domain_id, CAST(left(o_orderpriority, 1) AS INTEGER) AS k FROM orders),
       (SELECT unnest(range(1, 8)) AS u)
  WHERE u < 7 OR k < 3)"""


def vetoes(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem").where("l_quantity >= 49").select(
        F.concat_ws("-", F.lit("v"), F.col("l_orderkey"), F.col("l_linenumber"), _line_id()).alias("id"),
        F.col("l_orderkey").alias("decision_id"),
        F.concat(F.lit("u"), F.col("l_linenumber") % 7 + 1).alias("vetoed_by"),
        (F.col("l_shipdate") - F.expr("INTERVAL 60 DAYS")).alias("vetoed_at"),
    )


VETOES_SQL = f"""vetoes AS (
  SELECT 'v-' || l_orderkey || '-' || l_linenumber || '-' || {_LINE_ID_SQL} AS id, l_orderkey AS decision_id,
         'u' || (l_linenumber % 7 + 1) AS vetoed_by, l_shipdate - INTERVAL 60 DAY AS vetoed_at
  FROM lineitem WHERE l_quantity >= 49)"""

GOVERNANCE_SQL = f"{DECISIONS_SQL}, {VOTES_SQL}, {ROLES_SQL}, {VETOES_SQL}"

#: What a veto needs: an awaiting decision, no closing vote up to its instant, no stored veto before, an eligible role.
#: ``closed`` holds the sequence numbers of the closing votes (see plans/decisions.py), ``ordered`` the votes by number.
JUDGED_VETOES_SQL = """veto_candidates AS (
  SELECT v.*, d.id AS known_decision, d.status, d.domain_id, r.role AS vetoed_by_role,
         v.vetoed_at + CASE WHEN d.decision_type = 'emergency' THEN INTERVAL 1 HOUR ELSE INTERVAL 24 HOUR END AS expires_at,
         (SELECT min(o.voted_at) FROM closed c JOIN ordered o ON o.seq = least(c.reject_seq, c.approve_seq)
          WHERE c.decision_id = v.decision_id) AS vote_closed_at
  FROM vetoes v LEFT JOIN decisions d ON d.id = v.decision_id
  LEFT JOIN roles r ON r.user_id = v.vetoed_by AND r.domain_id = d.domain_id),
veto_order AS (
  SELECT *, sum(CASE WHEN status = 'awaiting_approval' AND vetoed_by_role IN ('accountable', 'responsible') THEN 1 ELSE 0 END)
            OVER (PARTITION BY decision_id ORDER BY vetoed_at, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS eligible_before
  FROM veto_candidates),
judged_vetoes AS (
  SELECT *, CASE WHEN known_decision IS NULL THEN 'unknown decision'
                 WHEN status <> 'awaiting_approval' THEN 'not awaiting approval'
                 WHEN vote_closed_at <= vetoed_at OR eligible_before > 0 THEN 'decision closed'
                 WHEN vetoed_by_role IS NULL THEN 'no role in domain'
                 WHEN vetoed_by_role NOT IN ('accountable', 'responsible') THEN 'role not eligible' END AS refused_because
  FROM veto_order),
stored AS (SELECT * EXCLUDE (status) FROM judged_vetoes WHERE refused_because IS NULL)"""


def assignments(spark: SparkSession, folder: str) -> DataFrame:
    """Role assignments over time: one per order, so that users collect several in a domain."""
    return table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.concat(F.lit("c"), F.col("o_custkey")).alias("user_id"),
        F.col("o_orderpriority").alias("domain_id"),
        pick(("responsible", "accountable", "consulted", "informed"), F.col("o_orderkey") % 4).alias("role"),
        F.col("o_orderdate").alias("assigned_at"),
    )


ASSIGNMENTS_SQL = """assignments AS (
  SELECT o_orderkey AS id, 'c' || o_custkey AS user_id, o_orderpriority AS domain_id,
         ['responsible', 'accountable', 'consulted', 'informed'][CAST(o_orderkey % 4 AS INTEGER) + 1] AS role,
         o_orderdate AS assigned_at
  FROM orders)"""

# --- audit events ---------------------------------------------------------------------------------------------------


def audit_events(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select(
        F.col("event_id").alias("id"),
        F.col("user_id").alias("chain_id"),
        F.col("event_type"),
        F.lit("user").alias("entity_type"),
        F.concat(F.lit("user-"), F.col("user_id")).alias("entity_id"),
        F.concat(F.lit("svc-"), F.col("event_type")).alias("actor_id"),
        F.concat(F.col("event_type"), F.lit(" by "), F.col("user_id")).alias("description"),
        F.create_map(F.lit("value"), F.col("value").cast("string"), F.lit("props"), F.col("props")).alias("details"),
        F.col("ts").alias("occurred_at"),
    )


ISO_SQL = "strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN microsecond(ts) % 1000000 = 0 THEN '' ELSE '.' || strftime(ts, '%f') END || '+00:00'"

AUDIT_SQL = f"""audit AS (
  SELECT event_id AS id, user_id AS chain_id, event_type, 'user-' || user_id AS entity_id, ts,
         '{{"actor_id":"svc-' || event_type || '","description":"' || event_type || ' by ' || user_id
         || '","details":{{"props":"' || replace(props, '"', '\\"') || '","value":"' || CAST(value AS VARCHAR)
         || '"}},"entity_id":"user-' || user_id || '","entity_type":"user","event_type":"' || event_type
         || '","occurred_at":"' || {ISO_SQL} || '","previous_hash":"' AS body
  FROM events)"""

ZEROS = "0" * 64

def _chain_sql(key: str) -> str:
    """DuckDB text of one unbroken chain per ``key`` of the audit events."""
    return f"""{AUDIT_SQL}, numbered AS (
  SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY ts, id) AS rn FROM audit),
chained AS (
  SELECT id, chain_id, event_type, entity_id, ts, body, rn, '{ZEROS}' AS previous_hash,
         sha256(body || '{ZEROS}' || '"}}') AS event_hash
  FROM numbered WHERE rn = 1
  UNION ALL
  SELECT n.id, n.chain_id, n.event_type, n.entity_id, n.ts, n.body, n.rn, c.event_hash,
         sha256(n.body || c.event_hash || '"}}')
  FROM chained c JOIN numbered n ON n.{key} = c.{key} AND n.rn = c.rn + 1)"""


CHAIN_SQL = _chain_sql("chain_id")
LONG_CHAIN_SQL = _chain_sql("event_type")
