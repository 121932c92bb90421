"""Freshness, volume, rates, latency and drift."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from govspark.operators import observability as o
from govspark.operators.drift import detect_drift, drift_fleet
from govspark.plans.registry import query, table
from govspark.session import fresh_path
from govspark.sources.metrics import append_points, metric_points


def _events(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").withColumnRenamed("event_type", "service")


def _start(df: DataFrame) -> DataFrame:
    """Window starts as text."""
    return df.withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss"))


_BIN = "strftime(time_bucket(INTERVAL 5 MINUTE, ts), '%Y-%m-%d %H:%M:%S')"


@query("freshness", """
SELECT event_type AS service, round((epoch_us(TIMESTAMP '2024-02-01') - epoch_us(max(ts))) / 1000000.0, 6)::DOUBLE AS freshness_seconds
FROM events GROUP BY 1""")
def freshness(spark: SparkSession, folder: str) -> DataFrame:
    ages = o.freshness(_events(spark, folder), ["service"], "ts", F.lit("2024-02-01").cast("timestamp"))
    return ages.withColumn("freshness_seconds", F.round("freshness_seconds", 6))


@query("volume", """
SELECT service, load, rows, CAST(sum(rows) OVER (PARTITION BY service ORDER BY load) AS BIGINT) AS total_rows
FROM (SELECT event_type AS service, strftime(ts, '%Y-%m-%d') AS load, count(*) AS rows FROM events GROUP BY 1, 2)""")
def volume(spark: SparkSession, folder: str) -> DataFrame:
    return o.volume(_events(spark, folder), ["service"], F.date_format("ts", "yyyy-MM-dd"))


@query("row_rate_5m", f"""
SELECT event_type AS service, {_BIN} AS start, CAST(sum(user_id) AS BIGINT) AS events, round(sum(user_id) / 300.0, 6)::DOUBLE AS rate
FROM events GROUP BY 1, 2""")
def row_rate_5m(spark: SparkSession, folder: str) -> DataFrame:
    """Rows per second where every event reports a number of rows."""
    rates = o.rate(_events(spark, folder), ["service"], "ts", amount=F.col("user_id"))
    return _start(rates).withColumn("rate", F.round("rate", 6))


def _counted(label: str) -> str:
    return f"""
SELECT {label} AS service, {_BIN} AS start, count(*) AS events, round(count(*) / 300.0, 6)::DOUBLE AS rate
FROM events GROUP BY 1, 2"""


@query("request_rate", _counted("event_type"))
def request_rate(spark: SparkSession, folder: str) -> DataFrame:
    return _start(o.rate(_events(spark, folder), ["service"], "ts")).withColumn("rate", F.round("rate", 6))


@query("span_rate", _counted("'svc' || user_id % 10"))
def span_rate(spark: SparkSession, folder: str) -> DataFrame:
    spans = table(spark, folder, "events").select("ts", F.concat(F.lit("svc"), F.col("user_id") % 10).alias("service"))
    return _start(o.rate(spans, ["service"], "ts")).withColumn("rate", F.round("rate", 6))


@query("error_rate", f"""
SELECT 'svc' || user_id % 10 AS service, {_BIN} AS start, count(*) AS requests,
       count(*) FILTER (WHERE event_type = 'error') AS errors,
       round(100.0 * count(*) FILTER (WHERE event_type = 'error') / count(*), 6)::DOUBLE AS error_percent
FROM events GROUP BY 1, 2""")
def error_rate(spark: SparkSession, folder: str) -> DataFrame:
    log = table(spark, folder, "events").select(
        "ts", "event_type", F.concat(F.lit("svc"), F.col("user_id") % 10).alias("service")
    )
    shares = o.error_share(log, ["service"], "ts", F.col("event_type") == "error")
    return _start(shares).withColumn("error_percent", F.round("error_percent", 6))


LATENCY_BOUNDS = (5.0, 10.0, 25.0, 50.0, 75.0, 100.0, 250.0, 500.0)


@query("latency_p95", f"""
WITH bounds AS (SELECT unnest({list(LATENCY_BOUNDS)}) AS le, unnest({[0.0, *LATENCY_BOUNDS[:-1]]}) AS lower),
cumulative AS (
  SELECT e.event_type AS service, b.le, b.lower, count(*) FILTER (WHERE e.value <= b.le) AS n,
         count(*) FILTER (WHERE e.value <= b.lower) AS below, count(*) AS total
  FROM events e CROSS JOIN bounds b GROUP BY ALL)
SELECT service, total, round(lower + (le - lower) * (0.95 * total - below) / (n - below), 6)::DOUBLE AS quantile_value
FROM cumulative WHERE n >= 0.95 * total
QUALIFY row_number() OVER (PARTITION BY service ORDER BY le) = 1""")
def latency_p95(spark: SparkSession, folder: str) -> DataFrame:
    quantiles = o.histogram_quantile(_events(spark, folder), ["service"], "value", LATENCY_BOUNDS, 0.95)
    return quantiles.withColumn("quantile_value", F.round("quantile_value", 6))


@query("drift_events", f"""
WITH log AS (SELECT ts, CASE WHEN value > 100 THEN 'WARN schema_drift in ' || event_type
  WHEN event_type = 'error' THEN 'WARN distribution_drift and schema_drift' ELSE 'ok' END AS message FROM events),
words(word) AS (VALUES ('schema_drift'), ('distribution_drift'))
SELECT {_BIN} AS start, word, count(*) AS lines FROM log JOIN words ON contains(message, word) GROUP BY 1, 2""")
def drift_events(spark: SparkSession, folder: str) -> DataFrame:
    message = (
        F.when(F.col("value") > 100, F.concat(F.lit("WARN schema_drift in "), "event_type"))
        .when(F.col("event_type") == "error", "WARN distribution_drift and schema_drift")
        .otherwise("ok")
    )
    log = table(spark, folder, "events").select("ts", message.alias("message"))
    return _start(o.log_matches(log, "message", ["schema_drift", "distribution_drift"], "ts"))


@query("metric_points", """
SELECT service AS dataset, 'app' AS domain, 'bronze' AS layer, metric, value FROM (
  SELECT event_type AS service, 'row_count' AS metric, count(*)::DOUBLE AS value FROM events GROUP BY 1
  UNION ALL
  SELECT event_type, 'freshness_seconds', round((epoch_us(TIMESTAMP '2024-02-01') - epoch_us(max(ts))) / 1000000.0, 6)::DOUBLE
  FROM events GROUP BY 1)""")
def metric_points_query(spark: SparkSession, folder: str) -> DataFrame:
    """Append both metrics to a metrics table and read it."""
    path = fresh_path(spark, "metrics")
    as_of = F.lit("2024-02-01").cast("timestamp")
    named = [F.col("service").alias("dataset"), F.lit("app").alias("domain"), F.lit("bronze").alias("layer")]
    events = _events(spark, folder)
    ages = o.freshness(events, ["service"], "ts", as_of).select(*named, "freshness_seconds")
    counts = events.groupBy("service").agg(F.count("*").alias("rows")).select(*named, "rows")
    append_points(metric_points(ages, "freshness_seconds", "freshness_seconds", as_of), path)
    append_points(metric_points(counts, "row_count", "rows", as_of), path)
    return spark.read.parquet(path).select("dataset", "domain", "layer", "metric", F.round("value", 6).alias("value"))


def _ks_sql(reference: str, current: str) -> str:
    return f"""
WITH sides AS ({reference} UNION ALL {current}),
sizes AS (SELECT CAST(sum(r) AS BIGINT) AS n1, CAST(count(*) - sum(r) AS BIGINT) AS n2 FROM sides),
steps AS (
  SELECT v, sum(sum(r)) OVER (ORDER BY v) AS c1, sum(count(*) - sum(r)) OVER (ORDER BY v) AS c2 FROM sides GROUP BY v),
tested AS (SELECT n1, n2, max(abs(c1 / n1::DOUBLE - c2 / n2::DOUBLE)) AS s FROM steps, sizes GROUP BY ALL),
scaled AS (
  SELECT *, (sqrt(n1::DOUBLE * n2 / (n1 + n2)) + 0.12 + 0.11 / sqrt(n1::DOUBLE * n2 / (n1 + n2))) * s AS lam FROM tested),
p AS (
  SELECT *, CASE WHEN lam < 0.2 THEN 1.0 ELSE least(greatest(2 * list_sum(list_transform(range(1, 101),
    lambda k: CASE WHEN k % 2 = 1 THEN 1.0 ELSE -1.0 END * exp(-2.0 * k * k * lam * lam))), 0.0), 1.0) END AS p FROM scaled)
SELECT n1 AS reference_size, n2 AS current_size, round(s, 9)::DOUBLE AS statistic, round(p, 6)::DOUBLE AS p_value,
       p < 0.05 AS has_drift
FROM p"""


def _rounded(drift: DataFrame) -> DataFrame:
    return drift.withColumns({"statistic": F.round("statistic", 9), "p_value": F.round("p_value", 6)})


@query("ks_drift", _ks_sql("SELECT l_extendedprice AS v, 1 AS r FROM lineitem WHERE l_linestatus = 'O'",
                           "SELECT l_extendedprice, 0 FROM lineitem WHERE l_linestatus = 'F'"))
def ks_drift(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "lineitem")
    return _rounded(detect_drift(lines.where("l_linestatus = 'O'"), lines.where("l_linestatus = 'F'"), "l_extendedprice"))


@query("ks_drift_scaled", _ks_sql("SELECT l_extendedprice AS v, 1 AS r FROM lineitem WHERE l_linestatus = 'O'",
                                  "SELECT l_extendedprice * 1.1, 0 FROM lineitem WHERE l_linestatus = 'F'"))
def ks_drift_scaled(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "lineitem").select("l_linestatus", "l_extendedprice")
    scaled = lines.where("l_linestatus = 'F'").withColumn("l_extendedprice", F.col("l_extendedprice") * 1.1)
    return _rounded(detect_drift(lines.where("l_linestatus = 'O'"), scaled, "l_extendedprice"))


@query("ks_drift_ties", _ks_sql("SELECT l_quantity AS v, 1 AS r FROM lineitem WHERE l_returnflag = 'A'",
                                "SELECT l_quantity, 0 FROM lineitem WHERE l_returnflag <> 'A'"))
def ks_drift_ties(spark: SparkSession, folder: str) -> DataFrame:
    """Fifty distinct values: nearly everything is tied."""
    lines = table(spark, folder, "lineitem")
    return _rounded(detect_drift(lines.where("l_returnflag = 'A'"), lines.where("l_returnflag <> 'A'"), "l_quantity"))


_FLEET = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("ks_drift_fleet", f"""
WITH sides AS (
  SELECT l_returnflag AS dataset, unnest({_FLEET}) AS col, unnest([{", ".join(f"{c}::DOUBLE" for c in _FLEET)}]) AS v,
         (l_shipdate < DATE '1995-06-17')::INT AS r FROM lineitem WHERE l_suppkey % 7 <> 0),
sizes AS (SELECT dataset, col, sum(r)::BIGINT AS n1, (count(*) - sum(r))::BIGINT AS n2 FROM sides GROUP BY 1, 2),
steps AS (
  SELECT dataset, col, sum(sum(r)) OVER (PARTITION BY dataset, col ORDER BY v) AS c1,
         sum(count(*) - sum(r)) OVER (PARTITION BY dataset, col ORDER BY v) AS c2
  FROM sides GROUP BY dataset, col, v),
tested AS (
  SELECT dataset, col, n1, n2, max(CASE WHEN n1 > 0 AND n2 > 0 THEN abs(c1 / n1::DOUBLE - c2 / n2::DOUBLE) END) AS s
  FROM steps JOIN sizes USING (dataset, col) GROUP BY dataset, col, n1, n2),
scaled AS (
  SELECT *, (sqrt(n1::DOUBLE * n2 / (n1 + n2)) + 0.12 + 0.11 / sqrt(n1::DOUBLE * n2 / (n1 + n2))) * s AS lam FROM tested),
p AS (
  SELECT *, CASE WHEN lam IS NULL THEN NULL WHEN lam < 0.2 THEN 1.0 ELSE least(greatest(2 * list_sum(list_transform(range(1, 101),
    lambda k: CASE WHEN k % 2 = 1 THEN 1.0 ELSE -1.0 END * exp(-2.0 * k * k * lam * lam))), 0.0), 1.0) END AS p FROM scaled)
SELECT dataset, col AS "column", n1 AS reference_size, n2 AS current_size, round(s, 9)::DOUBLE AS statistic, round(p, 6)::DOUBLE AS p_value,
       coalesce(p < 0.05, false) AS has_drift
FROM p""")
def ks_drift_fleet(spark: SparkSession, folder: str) -> DataFrame:
    """All numeric columns of three datasets, earlier lines against later ones, from one scan; some rows belong to neither side."""
    lines = table(spark, folder, "lineitem").withColumnRenamed("l_returnflag", "dataset")
    earlier = F.when(F.col("l_suppkey") % 7 != 0, F.col("l_shipdate") < F.lit("1995-06-17").cast("date"))
    return _rounded(drift_fleet(lines, earlier, _FLEET, ["dataset"]))
