"""Expectations, scores, thresholds, promotion, profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from govspark.operators.expectations import Expectation, broken_values, evaluate_suite
from govspark.operators.gate import keep_first, promote, promotion_verdicts, with_decision_id
from govspark.operators.profile import infer_types, key_candidates, profile_summary, profile_table
from govspark.operators.scoring import (
    DIMENSION_OF,
    dimension_scores,
    latest_report,
    overall_score,
    quality_report,
    report_name,
)
from govspark.operators.sla import check_sla, contract_sla, due_for_review, layer_thresholds
from govspark.plans import derived as d
from govspark.plans.registry import ORACLE, query, table
from govspark.session import fresh_path
from govspark.sources.layers import read_dataset, write_dataset

# --- single expectations: one row with the observed value and the verdict ---------------------------------------


def _checks(df: DataFrame, *items: tuple[str, dict]) -> DataFrame:
    return evaluate_suite(df, [Expectation(kind, kwargs) for kind, kwargs in items])


def _expected(source: str, *checks: tuple[str, str, str, str]) -> str:
    """SQL for checks given as (type, target, observed, success)."""
    rows = [
        f"SELECT CAST({i} AS INTEGER) AS position, '{kind}' AS expectation_type, '{target}' AS target,\n"
        f"  CAST({observed} AS DOUBLE) AS observed, {success} AS success FROM {source}"
        for i, (kind, target, observed, success) in enumerate(checks)
    ]
    return "\nUNION ALL\n".join(rows)


def _violations(test: str) -> str:
    return f"count(*) FILTER (WHERE NOT ({test}))"


def _rounded(results: DataFrame) -> DataFrame:
    return results.withColumn("observed", F.round("observed", 6))


_ROW_COUNT = "expect_table_row_count_to_be_between"
_NOT_NULL = "expect_column_values_to_not_be_null"
_BETWEEN = "expect_column_values_to_be_between"
_MEAN = "expect_column_mean_to_be_between"
_REGEX = "expect_column_values_to_match_regex"
_IN_SET = "expect_column_values_to_be_in_set"
_OF_TYPE = "expect_column_values_to_be_of_type"
_UNIQUE = "expect_column_values_to_be_unique"
_COMPOUND = "expect_compound_columns_to_be_unique"
_PAIR = "expect_column_pair_values_to_be_equal"
_STRFTIME = "expect_column_values_to_match_strftime_format"


@query("expect_row_count", _expected(
    "lineitem",
    (_ROW_COUNT, "", "count(*)", "count(*) >= 1"),
    (_ROW_COUNT, "", "count(*)", "count(*) BETWEEN 1 AND 100"),
))
def expect_row_count(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "lineitem")
    return _checks(lines, (_ROW_COUNT, {"min_value": 1}), (_ROW_COUNT, {"min_value": 1, "max_value": 100}))


@query("expect_not_null", _expected(
    "(SELECT *, CASE WHEN l_linenumber <> 7 THEN l_partkey END AS part FROM lineitem)",
    (_NOT_NULL, "l_orderkey", "count(*) FILTER (WHERE l_orderkey IS NULL)", "count(l_orderkey) = count(*)"),
    (_NOT_NULL, "part", "count(*) FILTER (WHERE part IS NULL)", "count(part) = count(*)"),
))
def expect_not_null(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "lineitem").withColumn("part", F.when(F.col("l_linenumber") != 7, F.col("l_partkey")))
    return _checks(lines, (_NOT_NULL, {"column": "l_orderkey"}), (_NOT_NULL, {"column": "part"}))


@query("expect_between", _expected(
    "lineitem",
    (_BETWEEN, "l_discount", _violations("l_discount BETWEEN 0 AND 0.1"), "bool_and(l_discount BETWEEN 0 AND 0.1)"),
    (_BETWEEN, "l_quantity", _violations("l_quantity <= 40"), "bool_and(l_quantity <= 40)"),
))
def expect_between(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "lineitem")
    return _checks(
        lines,
        (_BETWEEN, {"column": "l_discount", "min_value": 0.0, "max_value": 0.1}),
        (_BETWEEN, {"column": "l_quantity", "max_value": 40.0}),
    )


@query("expect_mean_between", _expected(
    "lineitem",
    (_MEAN, "l_quantity", "round(avg(l_quantity), 6)", "avg(l_quantity) BETWEEN 20 AND 30"),
    (_MEAN, "l_linenumber", "round(avg(l_linenumber), 6)", "avg(l_linenumber) BETWEEN 5 AND 7"),
))
def expect_mean_between(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "lineitem")
    return _rounded(_checks(
        lines,
        (_MEAN, {"column": "l_quantity", "min_value": 20, "max_value": 30}),
        (_MEAN, {"column": "l_linenumber", "min_value": 5, "max_value": 7}),
    ))


@query("expect_regex", _expected(
    "customer",
    (_REGEX, "c_name", _violations("regexp_matches(c_name, '^Customer#[0-9]{9}$')"),
     "bool_and(regexp_matches(c_name, '^Customer#[0-9]{9}$'))"),
    (_REGEX, "c_mktsegment", _violations("regexp_matches(c_mktsegment, 'E$')"),
     "bool_and(regexp_matches(c_mktsegment, 'E$'))"),
))
def expect_regex(spark: SparkSession, folder: str) -> DataFrame:
    return _checks(
        table(spark, folder, "customer"),
        (_REGEX, {"column": "c_name", "regex": "^Customer#[0-9]{9}$"}),
        (_REGEX, {"column": "c_mktsegment", "regex": "E$"}),
    )


@query("expect_in_set", _expected(
    "orders",
    (_IN_SET, "o_orderstatus", _violations("o_orderstatus IN ('O', 'F', 'P')"),
     "bool_and(o_orderstatus IN ('O', 'F', 'P'))"),
    (_IN_SET, "o_orderpriority", _violations("o_orderpriority IN ('1-URGENT', '2-HIGH')"),
     "bool_and(o_orderpriority IN ('1-URGENT', '2-HIGH'))"),
))
def expect_in_set(spark: SparkSession, folder: str) -> DataFrame:
    return _checks(
        table(spark, folder, "orders"),
        (_IN_SET, {"column": "o_orderstatus", "value_set": ["O", "F", "P"]}),
        (_IN_SET, {"column": "o_orderpriority", "value_set": ["1-URGENT", "2-HIGH"]}),
    )


@query("expect_in_table", """
SELECT count(*) AS rows, count(DISTINCT l_partkey) AS parts
FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 10)""")
def expect_in_table(spark: SparkSession, folder: str) -> DataFrame:
    """Membership in a set that is too large for a literal list."""
    allowed = table(spark, folder, "part").where("p_size > 10").select("p_partkey")
    broken = broken_values(table(spark, folder, "lineitem"), "l_partkey", allowed)
    per_part = broken.groupBy("l_partkey").agg(F.count("*").alias("n"))
    return per_part.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count("*").alias("parts"))


@query("expect_of_type", _expected(
    "(SELECT *, regexp_extract(props, '[0-9]+', 0) AS k FROM events)",
    (_OF_TYPE, "k", "count(*) FILTER (WHERE TRY_CAST(k AS BIGINT) IS NULL AND k IS NOT NULL)",
     "bool_and(TRY_CAST(k AS BIGINT) IS NOT NULL)"),
    (_OF_TYPE, "props", "count(*) FILTER (WHERE TRY_CAST(props AS DOUBLE) IS NULL AND props IS NOT NULL)",
     "bool_and(TRY_CAST(props AS DOUBLE) IS NOT NULL)"),
    (_OF_TYPE, "value", "0 * count(*)", "count(*) >= 0"),
    (_OF_TYPE, "ts", "count(ts)", "count(ts) = 0"),
))
def expect_of_type(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events").withColumn("k", F.regexp_extract("props", "[0-9]+", 0))
    return _checks(
        events,
        (_OF_TYPE, {"column": "k", "type_": "integer"}),
        (_OF_TYPE, {"column": "props", "type_": "float"}),
        (_OF_TYPE, {"column": "value", "type_": "float"}),
        (_OF_TYPE, {"column": "ts", "type_": "integer"}),
    )


def _repeated(source: str, *keys: str) -> str:
    names = ", ".join(keys)
    return f"(SELECT coalesce(sum(n), 0) AS r FROM (SELECT count(*) AS n FROM {source} GROUP BY {names}) WHERE n > 1)"


@query("expect_unique", f"""
SELECT CAST(0 AS INTEGER) AS position, '{_UNIQUE}' AS expectation_type, 'o_orderkey' AS target,
       CAST(r AS DOUBLE) AS observed, r = 0 AS success FROM {_repeated("orders", "o_orderkey")}
UNION ALL
SELECT CAST(1 AS INTEGER), '{_UNIQUE}', 'o_custkey', CAST(r AS DOUBLE), r = 0 FROM {_repeated("orders", "o_custkey")}""")
def expect_unique(spark: SparkSession, folder: str) -> DataFrame:
    return _checks(
        table(spark, folder, "orders"), (_UNIQUE, {"column": "o_orderkey"}), (_UNIQUE, {"column": "o_custkey"})
    )


@query("expect_compound_unique", f"""
SELECT CAST(0 AS INTEGER) AS position, '{_COMPOUND}' AS expectation_type, 'l_orderkey,l_linenumber' AS target,
       CAST(r AS DOUBLE) AS observed, r = 0 AS success FROM {_repeated("lineitem", "l_orderkey", "l_linenumber")}""")
def expect_compound_unique(spark: SparkSession, folder: str) -> DataFrame:
    return _checks(table(spark, folder, "lineitem"), (_COMPOUND, {"column_list": ["l_orderkey", "l_linenumber"]}))


@query("expect_pair_equal", _expected(
    "(SELECT n_chars, length(text) AS size, length(text) + CASE WHEN lang = 'fr' THEN 1 ELSE 0 END AS shifted FROM documents)",
    (_PAIR, "n_chars,size", "count(*) FILTER (WHERE n_chars IS DISTINCT FROM size)",
     "bool_and(n_chars IS NOT DISTINCT FROM size)"),
    (_PAIR, "n_chars,shifted", "count(*) FILTER (WHERE n_chars IS DISTINCT FROM shifted)",
     "bool_and(n_chars IS NOT DISTINCT FROM shifted)"),
))
def expect_pair_equal(spark: SparkSession, folder: str) -> DataFrame:
    size = F.length("text").cast("bigint")
    documents = table(spark, folder, "documents").select(
        "n_chars", size.alias("size"), (size + F.when(F.col("lang") == "fr", 1).otherwise(0)).alias("shifted")
    )
    return _checks(
        documents,
        (_PAIR, {"column_A": "n_chars", "column_B": "size"}),
        (_PAIR, {"column_A": "n_chars", "column_B": "shifted"}),
    )


@query("expect_strftime", _expected(
    """(SELECT strftime(ts, '%Y-%m-%dT%H:%M:%S') AS good,
        CASE WHEN event_id % 10 = 0 THEN strftime(ts, '%Y-%m-%d') ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S') END AS mixed
        FROM events)""",
    (_STRFTIME, "good", "count(*) FILTER (WHERE try_strptime(good, '%Y-%m-%dT%H:%M:%S') IS NULL)",
     "bool_and(try_strptime(good, '%Y-%m-%dT%H:%M:%S') IS NOT NULL)"),
    (_STRFTIME, "mixed", "count(*) FILTER (WHERE try_strptime(mixed, '%Y-%m-%dT%H:%M:%S') IS NULL)",
     "bool_and(try_strptime(mixed, '%Y-%m-%dT%H:%M:%S') IS NOT NULL)"),
))
def expect_strftime(spark: SparkSession, folder: str) -> DataFrame:
    full, short = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.date_format("ts", "yyyy-MM-dd")
    texts = table(spark, folder, "events").select(
        full.alias("good"), F.when(F.col("event_id") % 10 == 0, short).otherwise(full).alias("mixed")
    )
    kwargs = {"strftime_format": "%Y-%m-%dT%H:%M:%S"}
    return _checks(texts, (_STRFTIME, {"column": "good", **kwargs}), (_STRFTIME, {"column": "mixed", **kwargs}))


# --- a whole suite ------------------------------------------------------------------------------------------------

LINEITEM_SUITE = [
    Expectation(_ROW_COUNT, {"min_value": 1}),
    Expectation(_NOT_NULL, {"column": "l_orderkey"}),
    Expectation(_NOT_NULL, {"column": "l_shipdate"}),
    Expectation(_BETWEEN, {"column": "l_discount", "min_value": 0.0, "max_value": 0.1}),
    Expectation(_BETWEEN, {"column": "l_quantity", "min_value": 1.0, "max_value": 40.0}),
    Expectation(_MEAN, {"column": "l_quantity", "min_value": 20, "max_value": 30}),
    Expectation(_IN_SET, {"column": "l_returnflag", "value_set": ["A", "N", "R"]}),
    Expectation(_REGEX, {"column": "l_linestatus", "regex": "^[OF]$"}),
    Expectation(_OF_TYPE, {"column": "l_orderkey", "type_": "integer"}),
    Expectation(_COMPOUND, {"column_list": ["l_orderkey", "l_linenumber"]}),
    Expectation(_PAIR, {"column_A": "l_discount", "column_B": "l_tax"}),
]

INGEST_SUITE = [
    Expectation(_ROW_COUNT, {"min_value": 1}),
    Expectation(_NOT_NULL, {"column": "l_orderkey"}),
    Expectation(_OF_TYPE, {"column": "l_orderkey", "type_": "integer"}),
    Expectation(_COMPOUND, {"column_list": ["l_orderkey", "l_linenumber"]}),
]

SUITE_SQL = f"""checked AS (
  SELECT (SELECT coalesce(sum(n), 0) FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber)
          WHERE n > 1) = 0 AS unique_ok,
         count(*) >= 1 AS rows_ok, count(l_orderkey) = count(*) AS key_ok, count(l_shipdate) = count(*) AS date_ok,
         bool_and(l_discount BETWEEN 0 AND 0.1) AS discount_ok, bool_and(l_quantity BETWEEN 1 AND 40) AS quantity_ok,
         avg(l_quantity) BETWEEN 20 AND 30 AS mean_ok, bool_and(l_returnflag IN ('A', 'N', 'R')) AS flag_ok,
         bool_and(regexp_matches(l_linestatus, '^[OF]$')) AS status_ok,
         bool_and(l_discount IS NOT DISTINCT FROM l_tax) AS pair_ok
  FROM lineitem),
suite AS (
  SELECT (rows_ok::INT + key_ok::INT + date_ok::INT) / 3.0 AS completeness,
         (discount_ok::INT + quantity_ok::INT + mean_ok::INT) / 3.0 AS accuracy, pair_ok::INT / 1.0 AS consistency,
         1.0 AS timeliness, unique_ok::INT / 1.0 AS uniqueness, (flag_ok::INT + status_ok::INT + 1) / 3.0 AS validity,
         rows_ok::INT + key_ok::INT + date_ok::INT + discount_ok::INT + quantity_ok::INT + mean_ok::INT + pair_ok::INT
         + unique_ok::INT + flag_ok::INT + status_ok::INT + 1 AS passed
  FROM checked)"""


def lineitem_report(spark: SparkSession, folder: str) -> DataFrame:
    results = evaluate_suite(table(spark, folder, "lineitem"), LINEITEM_SUITE)
    return quality_report(results.withColumn("dataset_id", F.lit("lineitem")), ["dataset_id"])


@query("quality_report", f"""WITH {SUITE_SQL}
SELECT 'lineitem' AS dataset_id, 'default_bronze' AS suite_name, round(completeness, 6)::DOUBLE AS completeness,
       round(accuracy, 6)::DOUBLE AS accuracy, round(consistency, 6)::DOUBLE AS consistency,
       round(timeliness, 6)::DOUBLE AS timeliness, round(uniqueness, 6)::DOUBLE AS uniqueness,
       round(validity, 6)::DOUBLE AS validity,
       round((completeness + accuracy + consistency + timeliness + uniqueness + validity) / 6, 6)::DOUBLE AS dq_score,
       passed::BIGINT AS expectations_passed, (11 - passed)::BIGINT AS expectations_failed,
       11::BIGINT AS expectations_total
FROM suite""")
def quality_report_query(spark: SparkSession, folder: str) -> DataFrame:
    report = lineitem_report(spark, folder)
    dimensions = ("completeness", "accuracy", "consistency", "timeliness", "uniqueness", "validity")
    return report.select(
        "dataset_id",
        report_name(F.lit("default"), F.lit("bronze")).alias("suite_name"),
        *[F.round(F.col("dimension_scores")[name], 6).alias(name) for name in dimensions],
        F.round("dq_score", 6).alias("dq_score"),
        "expectations_passed",
        "expectations_failed",
        "expectations_total",
    )


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    """Suite, scores and the promotion verdict towards every layer, from one scan and one uniqueness pass."""
    moves = [("bronze", "silver"), ("silver", "gold"), ("gold", "platinum")]
    request = lineitem_report(spark, folder).select(
        "dataset_id",
        "dq_score",
        "expectations_total",
        F.explode(
            F.array(*[F.struct(F.lit(s).alias("source_layer"), F.lit(t).alias("target_layer")) for s, t in moves])
        ).alias("m"),
    )
    return promotion_verdicts(request.select("*", "m.*").drop("m")).select(
        "dataset_id", "source_layer", "target_layer", F.round("dq_score", 6).alias("dq_score"), "threshold", "verdict"
    )


query("flagship_gate", f"""WITH {SUITE_SQL},
score AS (SELECT (completeness + accuracy + consistency + timeliness + uniqueness + validity) / 6 AS s FROM suite),
moves(source_layer, target_layer, threshold) AS (
  VALUES ('bronze', 'silver', 0.7), ('silver', 'gold', 0.85), ('gold', 'platinum', 0.95))
SELECT 'lineitem' AS dataset_id, source_layer, target_layer, round(s, 6)::DOUBLE AS dq_score,
       threshold::DOUBLE AS threshold,
       CASE WHEN s < threshold THEN 'refused' WHEN source_layer = 'bronze' THEN 'promoted'
            ELSE 'decision_required' END AS verdict
FROM score, moves""")(flagship)


# --- scores and thresholds over many datasets -------------------------------------------------------------------


@query("dimension_scores", f"""WITH {d.SCORES_SQL}
SELECT dataset_id, dimension, round(score, 6)::DOUBLE AS score FROM scores""")
def dimension_scores_query(spark: SparkSession, folder: str) -> DataFrame:
    return dimension_scores(d.results(spark, folder), ["dataset_id"]).withColumn("score", F.round("score", 6))


CUSTOM_DIMENSIONS = {
    "expect_something_unmapped": "timeliness",
    "expect_table_row_count_to_be_between": "validity",
    "expect_column_values_to_be_unique": "uniqueness",
}


@query("dimension_scores_custom", f"""WITH {d.RESULTS_SQL}, {d.DIMENSION_SQL},
custom(expectation_type, dimension) AS (VALUES {", ".join(f"('{k}', '{v}')" for k, v in CUSTOM_DIMENSIONS.items())}),
scored AS (
  SELECT dataset_id, dimension, avg(CASE WHEN success THEN 1.0 ELSE 0.0 END) AS score
  FROM results JOIN custom USING (expectation_type) GROUP BY ALL)
SELECT a.dataset_id, a.dimension, round(coalesce(s.score, 1.0), 6)::DOUBLE AS score
FROM (SELECT dataset_id, dimension FROM (SELECT DISTINCT dataset_id FROM results) CROSS JOIN dims) a
LEFT JOIN scored s USING (dataset_id, dimension)""")
def dimension_scores_custom(spark: SparkSession, folder: str) -> DataFrame:
    scored = dimension_scores(d.results(spark, folder), ["dataset_id"], CUSTOM_DIMENSIONS)
    return scored.withColumn("score", F.round("score", 6))


@query("overall_score", f"""WITH {d.SCORES_SQL}
SELECT 'ds_' || s_suppkey AS dataset_id, round(coalesce(avg(score), 0.0), 6)::DOUBLE AS dq_score
FROM (SELECT s_suppkey FROM supplier UNION ALL SELECT -1 - s_suppkey FROM supplier)
LEFT JOIN scores ON scores.dataset_id = 'ds_' || s_suppkey GROUP BY ALL""")
def overall_score_query(spark: SparkSession, folder: str) -> DataFrame:
    """The suppliers and as many datasets without results."""
    keys = table(spark, folder, "supplier").select(F.explode(F.array("s_suppkey", -1 - F.col("s_suppkey"))).alias("k"))
    listed = keys.select(F.concat(F.lit("ds_"), "k").alias("dataset_id"))
    scores = dimension_scores(d.results(spark, folder), ["dataset_id"])
    return overall_score(scores, ["dataset_id"], listed).withColumn("dq_score", F.round("dq_score", 6))


@query("sla_check", f"""WITH {d.SCORES_SQL}
SELECT l.dataset_id, l.dimension, l.threshold::DOUBLE AS threshold, round(coalesce(s.score, 0.0), 6)::DOUBLE AS score,
       coalesce(s.score, 0.0) >= l.threshold AS passes
FROM (SELECT 'ds_' || (s_suppkey * 2) AS dataset_id, dimension, 0.25 + s_nationkey / 50.0 AS threshold
      FROM supplier CROSS JOIN dims) l
LEFT JOIN scores s USING (dataset_id, dimension)""")
def sla_check(spark: SparkSession, folder: str) -> DataFrame:
    """Thresholds by supplier, half of them for datasets without scores."""
    thresholds = table(spark, folder, "supplier").select(
        F.concat(F.lit("ds_"), F.col("s_suppkey") * 2).alias("dataset_id"),
        F.explode(d.words(dict.fromkeys(DIMENSION_OF.values()))).alias("dimension"),
        (F.lit(0.25) + F.col("s_nationkey") / 50.0).alias("threshold"),
    )
    scores = dimension_scores(d.results(spark, folder), ["dataset_id"])
    return check_sla(scores, thresholds, ["dataset_id"]).withColumn("score", F.round("score", 6))


@query("layer_thresholds", f"""WITH {d.DATASETS_SQL}, {d.DIMENSION_SQL}
SELECT dataset_id, layer, dimension,
       (CASE layer WHEN 'silver' THEN 0.85 WHEN 'gold' THEN 0.95 WHEN 'platinum' THEN 0.98 ELSE 0.70 END)::DOUBLE
       AS threshold
FROM datasets CROSS JOIN dims""")
def layer_thresholds_query(spark: SparkSession, folder: str) -> DataFrame:
    return layer_thresholds(d.datasets(spark, folder), ["dataset_id"])


@query("sla_due_for_review", """
SELECT s_suppkey AS id, CAST(30 + s_nationkey * 10 AS INTEGER) AS review_interval_days
FROM supplier
WHERE s_suppkey % 11 = 0
   OR TIMESTAMP '2024-06-01' >= TIMESTAMP '2024-01-01' + INTERVAL 1 DAY * CAST(s_suppkey % 100 AS INTEGER)
      + INTERVAL 1 DAY * (30 + s_nationkey * 10)""")
def sla_due_for_review(spark: SparkSession, folder: str) -> DataFrame:
    reviewed = F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval((F.col("s_suppkey") % 100).cast("int"))
    slas = table(spark, folder, "supplier").select(
        F.col("s_suppkey").alias("id"),
        (F.lit(30) + F.col("s_nationkey") * 10).alias("review_interval_days"),
        F.when(F.col("s_suppkey") % 11 != 0, reviewed).alias("last_reviewed_at"),
    )
    return due_for_review(slas, F.lit("2024-06-01").cast("timestamp_ntz")).select("id", "review_interval_days")


def requests(spark: SparkSession, folder: str) -> DataFrame:
    """One promotion request per order."""
    key = F.col("o_orderkey")
    layers = ("bronze", "silver", "gold", "platinum", "landing")
    return table(spark, folder, "orders").select(
        F.concat(F.lit("ds_"), key).alias("dataset_id"),
        F.col("o_orderpriority").alias("domain_id"),
        d.pick(layers, key % 5).alias("source_layer"),
        d.pick(layers, F.floor(key / 2) % 5).alias("target_layer"),
        (F.floor(F.col("o_totalprice")) % 101 / 100.0).alias("dq_score"),
    )


VERDICT_SQL = """requests AS (
  SELECT 'ds_' || o_orderkey AS dataset_id, o_orderpriority AS domain_id,
         ['bronze', 'silver', 'gold', 'platinum', 'landing'][CAST(o_orderkey % 5 AS INTEGER) + 1] AS source_layer,
         ['bronze', 'silver', 'gold', 'platinum', 'landing'][CAST((o_orderkey // 2) % 5 AS INTEGER) + 1] AS target_layer,
         CAST(floor(o_totalprice) AS BIGINT) % 101 / 100.0 AS dq_score
  FROM orders),
verdicts AS (
  SELECT r.*, m.threshold,
         CASE WHEN m.threshold IS NULL THEN 'invalid' WHEN dq_score < m.threshold THEN 'refused'
              WHEN r.source_layer = 'bronze' THEN 'promoted' ELSE 'decision_required' END AS verdict
  FROM requests r LEFT JOIN (VALUES ('bronze', 'silver', 0.7::DOUBLE), ('silver', 'gold', 0.85::DOUBLE),
    ('gold', 'platinum', 0.95::DOUBLE)) m(s, t, threshold) ON m.s = r.source_layer AND m.t = r.target_layer)"""


@query("promotion_gate", f"""WITH {VERDICT_SQL}
SELECT dataset_id, source_layer, target_layer, dq_score::DOUBLE AS dq_score, verdict, verdict = 'promoted' AS promoted
FROM verdicts""")
def promotion_gate(spark: SparkSession, folder: str) -> DataFrame:
    return promotion_verdicts(requests(spark, folder)).select(
        "dataset_id", "source_layer", "target_layer", "dq_score", "verdict", "promoted"
    )


@query("promotion_decisions", f"""WITH {VERDICT_SQL}, hashed AS (
  SELECT *, sha256(domain_id || '|' || dataset_id || '|' || source_layer || '|' || target_layer) AS h FROM verdicts
  WHERE verdict = 'decision_required')
SELECT dataset_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4)
       || '-' || substr(h, 21, 12) AS governance_decision_id
FROM hashed""")
def promotion_decisions(spark: SparkSession, folder: str) -> DataFrame:
    decided = with_decision_id(promotion_verdicts(requests(spark, folder)))
    return decided.where("governance_decision_id IS NOT NULL").select("dataset_id", "governance_decision_id")


LINE_SUMMARY = """count(*) AS rows, sum(l_orderkey)::BIGINT AS keys,
       CAST(sum(CAST(l_extendedprice AS DECIMAL(18, 2))) AS DOUBLE) AS price"""


def _line_summary(lines: DataFrame) -> DataFrame:
    return lines.agg(
        F.count("*").alias("rows"),
        F.sum("l_orderkey").alias("keys"),
        F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double").alias("price"),
    )


@query("layer_write_roundtrip", f"SELECT {LINE_SUMMARY}, 2 AS versions FROM lineitem")
def layer_write_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """Write a table twice and read the latest version."""
    root = fresh_path(spark, "layers")
    lines = table(spark, folder, "lineitem")
    write_dataset(lines.select("l_orderkey"), root, "bronze", "sales", "lineitem")
    latest = write_dataset(lines, root, "bronze", "sales", "lineitem")
    return _line_summary(read_dataset(spark, root, "bronze", "sales", "lineitem")).withColumn("versions", F.lit(latest))


@query("promote_bronze_silver", f"SELECT 'silver' AS layer, {LINE_SUMMARY} FROM lineitem")
def promote_bronze_silver(spark: SparkSession, folder: str) -> DataFrame:
    """Score a bronze dataset, promote it and read the silver copy."""
    root = fresh_path(spark, "layers")
    write_dataset(table(spark, folder, "lineitem"), root, "bronze", "sales", "lineitem")
    bronze = read_dataset(spark, root, "bronze", "sales", "lineitem")
    results = evaluate_suite(bronze, INGEST_SUITE).withColumn("dataset_id", F.lit("lineitem"))
    scored = quality_report(results, ["dataset_id"]).select(
        "dataset_id",
        "dq_score",
        F.lit("sales").alias("domain_id"),
        F.lit("bronze").alias("source_layer"),
        F.lit("silver").alias("target_layer"),
    )
    promote(root, promotion_verdicts(scored))
    return _line_summary(read_dataset(spark, root, "silver", "sales", "lineitem")).select(
        F.lit("silver").alias("layer"), "*"
    )


@query("silver_dedup", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice
FROM lineitem
QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber
                           ORDER BY l_shipdate, l_partkey, l_suppkey, l_quantity) = 1""")
def silver_dedup(spark: SparkSession, folder: str) -> DataFrame:
    kept = keep_first(
        table(spark, folder, "lineitem"),
        ["l_orderkey", "l_linenumber"],
        ["l_shipdate", "l_partkey", "l_suppkey", "l_quantity"],
    )
    return kept.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")


@query("latest_report", """
SELECT 'cust_' || o_custkey AS dataset_id, o_orderstatus AS layer, o_orderkey AS id, o_totalprice AS dq_score
FROM orders
QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderdate DESC, o_orderkey DESC) = 1""")
def latest_report_query(spark: SparkSession, folder: str) -> DataFrame:
    reports = table(spark, folder, "orders").select(
        F.concat(F.lit("cust_"), "o_custkey").alias("dataset_id"),
        F.col("o_orderstatus").alias("layer"),
        F.col("o_orderkey").alias("id"),
        F.col("o_totalprice").alias("dq_score"),
        F.struct("o_orderdate", "o_orderkey").alias("created_at"),
    )
    return latest_report(reports, ["dataset_id", "layer"]).drop("created_at")


@query("contract_sla", """
WITH measured AS (
  SELECT event_type, (epoch_us(TIMESTAMP '2024-02-01') - epoch_us(max(ts))) / 3600000000.0 AS age_hours,
         count(CASE WHEN value >= 5 THEN value END) / count(*)::DOUBLE AS completeness
  FROM events GROUP BY event_type),
contracts AS (
  SELECT event_type, CASE WHEN event_type <> 'click' THEN 20.0 + length(event_type) END AS freshness_hours,
         0.9 + length(event_type) / 1000.0 AS completeness_threshold
  FROM (SELECT DISTINCT event_type FROM events))
SELECT event_type AS dataset_id, round(age_hours, 6)::DOUBLE AS age_hours, round(completeness, 6)::DOUBLE AS completeness,
       coalesce(freshness_hours IS NULL OR age_hours <= freshness_hours, false) AS freshness_met,
       completeness >= completeness_threshold AS completeness_met
FROM measured JOIN contracts USING (event_type)""")
def contract_sla_query(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events").select(
        F.col("event_type").alias("dataset_id"), "ts", F.when(F.col("value") >= 5, F.col("value")).alias("value")
    )
    newest = F.unix_micros(F.max("ts").cast("timestamp"))
    as_of = F.unix_micros(F.lit("2024-02-01").cast("timestamp"))
    measured = events.groupBy("dataset_id").agg(
        ((as_of - newest) / F.lit(3_600_000_000.0)).alias("age_hours"),
        (F.count("value") / F.count("*")).alias("completeness"),
    )
    size = F.length("dataset_id")
    contracts = events.select("dataset_id").distinct().select(
        "dataset_id",
        F.when(F.col("dataset_id") != "click", F.lit(20.0) + size).alias("freshness_hours"),
        (F.lit(0.9) + size / 1000.0).alias("completeness_threshold"),
    )
    return contract_sla(measured, contracts, ["dataset_id"]).withColumns(
        {"age_hours": F.round("age_hours", 6), "completeness": F.round("completeness", 6)}
    )


_PROFILED = ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment", "debt")


def _profile_sql(name: str) -> str:
    numeric = name in ("c_custkey", "c_nationkey", "c_acctbal", "debt")
    mean = f"round(avg({name}), 4)" if numeric else "NULL"
    return (
        f"SELECT '{name}' AS \"column\", count(*) AS rows, count({name}) AS non_null, "
        f"count(DISTINCT {name}) AS distinct_values, CAST({mean} AS DOUBLE) AS mean, "
        f"CAST(min({name}) AS VARCHAR) AS minimum, CAST(max({name}) AS VARCHAR) AS maximum, "
        f"CAST({f'round(stddev_samp({name}), 4)' if numeric else 'NULL'} AS DOUBLE) AS deviation, 1.0::DOUBLE AS consistency, "
        f"round(count({name}) / count(*)::DOUBLE, 6) AS completeness, "
        f"round(count(DISTINCT {name}) / count({name})::DOUBLE, 6) AS uniqueness, "
        f"(count(*) - count({name})) * 20 > count(*) AS above_five_percent_null FROM t"
    )


@query("profile_table", "WITH t AS (SELECT *, CASE WHEN c_acctbal < 0 THEN c_acctbal END AS debt FROM customer)\n"
       + "\nUNION ALL\n".join(_profile_sql(name) for name in _PROFILED))
def profile_table_query(spark: SparkSession, folder: str) -> DataFrame:
    customers = table(spark, folder, "customer").withColumn(
        "debt", F.when(F.col("c_acctbal") < 0, F.col("c_acctbal"))
    )
    return profile_table(customers, exact=True).select(
        "column",
        "rows",
        "non_null",
        "distinct_values",
        F.round("mean", 4).alias("mean"),
        "minimum",
        "maximum",
        F.round("deviation", 4).alias("deviation"),
        "consistency",
        F.round("completeness", 6).alias("completeness"),
        F.round("uniqueness", 6).alias("uniqueness"),
        "above_five_percent_null",
    )


@query("profile_summary", """
WITH t AS (SELECT event_type, CASE WHEN event_id % 4 = 0 THEN CAST(value AS VARCHAR) WHEN event_id % 4 <> 1 THEN props END AS mixed
  FROM events)
SELECT count(*) AS rows, CAST(2 AS BIGINT) AS columns, CAST(1 AS BIGINT) AS columns_above_five_percent_null,
       round((1 + count(mixed) / count(*)::DOUBLE) / 2, 6)::DOUBLE AS completeness,
       round((count(DISTINCT event_type) / count(*)::DOUBLE + count(DISTINCT mixed) / count(mixed)::DOUBLE) / 2, 6)::DOUBLE AS uniqueness,
       round((1 + count(*) FILTER (WHERE mixed LIKE '{%') / count(mixed)::DOUBLE) / 2, 6)::DOUBLE AS consistency
FROM t""")
def profile_summary_query(spark: SparkSession, folder: str) -> DataFrame:
    """A clean column, and one that mixes JSON text, numbers and nulls."""
    key = F.col("event_id") % 4
    mixed = F.when(key == 0, F.col("value").cast("string")).when(key != 1, F.col("props"))
    summary = profile_summary(profile_table(table(spark, folder, "events").select("event_type", mixed.alias("mixed")), True))
    return summary.select(
        "rows", "columns", "columns_above_five_percent_null",
        *[F.round(m, 6).alias(m) for m in ("completeness", "uniqueness", "consistency")],
    )


@query("infer_types", """
WITH t AS (
  SELECT props, regexp_extract(props, '[0-9]+', 0) AS k, CAST(value AS VARCHAR) AS v, CAST(value > 1 AS VARCHAR) AS b,
         strftime(ts, '%Y-%m-%d %H:%M:%S') AS t, CAST(event_id AS VARCHAR) AS id FROM events)
SELECT c AS "column", n AS rows, dv AS distinct_values, kind AS inferred_type, dv = n AS key_candidate FROM (
  SELECT 'props' AS c, count(*) AS n, count(DISTINCT props) AS dv, 'text' AS kind FROM t
  UNION ALL SELECT 'k', count(*), count(DISTINCT k), CASE WHEN bool_and(TRY_CAST(k AS BIGINT) IS NOT NULL) THEN 'integer' ELSE 'text' END FROM t
  UNION ALL SELECT 'v', count(*), count(DISTINCT v), CASE WHEN bool_and(TRY_CAST(v AS DOUBLE) IS NOT NULL) THEN 'float' ELSE 'text' END FROM t
  UNION ALL SELECT 'b', count(*), count(DISTINCT b), CASE WHEN bool_and(b IN ('true', 'false')) THEN 'boolean' ELSE 'text' END FROM t
  UNION ALL SELECT 't', count(*), count(DISTINCT t), CASE WHEN bool_and(TRY_CAST(t AS TIMESTAMP) IS NOT NULL) THEN 'timestamp' ELSE 'text' END FROM t
  UNION ALL SELECT 'id', count(*), count(DISTINCT id), CASE WHEN bool_and(TRY_CAST(id AS BIGINT) IS NOT NULL) THEN 'integer' ELSE 'text' END FROM t)""")
def infer_types_query(spark: SparkSession, folder: str) -> DataFrame:
    inferred = infer_types(texts := _event_texts(spark, folder), texts.columns)
    return inferred.select("column", "rows", "distinct_values", "inferred_type", "key_candidate")


def _event_texts(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select(
        "props",
        F.regexp_extract("props", "[0-9]+", 0).alias("k"),
        F.col("value").cast("string").alias("v"),
        (F.col("value") > 1).cast("string").alias("b"),
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("t"),
        F.col("event_id").cast("string").alias("id"),
    )


@query("infer_types_sketched", f"""
SELECT "column", rows, inferred_type, key_candidate FROM ({ORACLE["infer_types"]})""")
def infer_types_sketched(spark: SparkSession, folder: str) -> DataFrame:
    """The same with exact counts for likely keys alone."""
    inferred = infer_types(texts := _event_texts(spark, folder), texts.columns, exact=False)
    return inferred.select("column", "rows", "inferred_type", "key_candidate")


_KEYED = ["l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_shipdate", "l_returnflag"]


@query("key_candidates", "\nUNION ALL\n".join(
    f"""SELECT '{c}' AS "column", count(*) AS rows, count(DISTINCT {c}) = count(*) AS key_candidate FROM {t}"""
    for t, names in (("lineitem", _KEYED), ("orders", ["o_orderkey", "o_custkey", "o_totalprice"])) for c in names))
def key_candidates_query(spark: SparkSession, folder: str) -> DataFrame:
    """Single-column keys of two tables; most columns are ruled out by their sketch."""
    lines = key_candidates(table(spark, folder, "lineitem"), _KEYED)
    orders = key_candidates(table(spark, folder, "orders"), ["o_orderkey", "o_custkey", "o_totalprice"])
    return lines.unionByName(orders).select("column", "rows", "key_candidate")
