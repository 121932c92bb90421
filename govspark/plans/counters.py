"""Rates of counters and quantiles of histograms, exported by instances that restart once a day, each at its own hour."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from govspark.operators import counters as c
from govspark.plans.observability import LATENCY_BOUNDS, _start
from govspark.plans.registry import query, table

_RESTART_SQL = "(epoch(ts)::BIGINT + 7200 * (user_id % 4)) // 86400"
_LABELS = [*(f"{b:g}" for b in LATENCY_BOUNDS), "+Inf"]


def _exported(events: DataFrame, labels: list[str], amount: Column) -> DataFrame:
    """One sample per event: the running total of its series since the last restart of its instance."""
    restart = F.floor((F.unix_seconds(F.col("ts").cast("timestamp")) + 7200 * (F.col("user_id") % 4)) / 86400)
    running = Window.partitionBy(*labels, "restart").orderBy("ts", "event_id")
    return events.withColumn("restart", restart).withColumn("value", F.sum(amount).over(running)).select(*labels, "ts", "value")


def _exported_sql(labels: dict[str, str], amount: str, source: str = "events") -> str:
    names = ", ".join(labels)
    chosen = ", ".join(f"{expression} AS {name}" for name, expression in labels.items())
    return f"""
labelled AS (SELECT {chosen}, ts, event_id, {amount} AS amount, {_RESTART_SQL} AS restart FROM {source}),
samples AS (
  SELECT {names}, ts, sum(amount) OVER (PARTITION BY {names}, restart ORDER BY ts, event_id)::DOUBLE AS value FROM labelled)"""


def _increase_sql(labels: dict[str, str], amount: str, source: str = "events") -> str:
    names = ", ".join(labels)
    return f"""{_exported_sql(labels, amount, source)},
steps AS (
  SELECT *, time_bucket(INTERVAL 5 MINUTE, ts) AS bin, lag(value) OVER (PARTITION BY {names} ORDER BY ts, value) AS before FROM samples),
increases AS (
  SELECT {names}, bin, count(*) AS samples, count(*) FILTER (WHERE value < before) AS resets,
         sum(CASE WHEN before IS NULL THEN 0 WHEN value < before THEN value ELSE value - before END) AS increase
  FROM steps GROUP BY {names}, bin)"""


def _events(spark: SparkSession, folder: str, labels: dict[str, str]) -> DataFrame:
    """Events with the labels of their series; the same expressions serve both engines."""
    return table(spark, folder, "events").select("event_id", "ts", "user_id", "event_type", F.col("value").alias("amount"),
                                                 *(F.expr(v).alias(k) for k, v in labels.items()))


def _told(df: DataFrame, *rounded: str) -> DataFrame:
    return _start(df).withColumns({name: F.round(name, 6) for name in rounded})


_BIN = "strftime(bin, '%Y-%m-%d %H:%M:%S')"
_INSTANCE = "'i' || user_id % 4"
_ROWS = {"dataset": "event_type", "layer": "CASE WHEN user_id % 3 = 0 THEN 'bronze' ELSE 'silver' END", "instance": _INSTANCE}
_REQUESTS = {"service": "'svc' || user_id % 10", "instance": _INSTANCE, "status": "CASE WHEN event_type = 'error' THEN '503' ELSE '200' END"}
_SPANS = {"service": "event_type", "instance": _INSTANCE}


def _row_samples(spark: SparkSession, folder: str) -> DataFrame:
    return _exported(_events(spark, folder, _ROWS), list(_ROWS), F.col("user_id"))


@query("counter_increases", f"""WITH {_increase_sql(_ROWS, 'user_id')}
SELECT dataset, layer, instance, {_BIN} AS start, samples, resets, round(increase, 6)::DOUBLE AS increase FROM increases""")
def counter_increases(spark: SparkSession, folder: str) -> DataFrame:
    """What every series counted in every range, and how often it started anew."""
    return _told(c.increases(_row_samples(spark, folder), ["dataset", "layer", "instance"], "ts", "value"), "increase")


@query("row_rate_counter", f"""WITH {_increase_sql(_ROWS, 'user_id')}
SELECT dataset, layer, {_BIN} AS start, round(sum(increase), 6)::DOUBLE AS increase, round(sum(increase) / 300, 6)::DOUBLE AS rate
FROM increases GROUP BY ALL""")
def row_rate_counter(spark: SparkSession, folder: str) -> DataFrame:
    """Rows per second by dataset and layer, from the row counters."""
    grown = c.increases(_row_samples(spark, folder), ["dataset", "layer", "instance"], "ts", "value")
    return _told(c.rate_by(grown, ["dataset", "layer"]), "increase", "rate")


def _request_increases(spark: SparkSession, folder: str) -> DataFrame:
    return c.increases(_exported(_events(spark, folder, _REQUESTS), list(_REQUESTS), F.lit(1)), list(_REQUESTS), "ts", "value")


@query("request_rate_counter", f"""WITH {_increase_sql(_REQUESTS, '1')}
SELECT service, {_BIN} AS start, round(sum(increase), 6)::DOUBLE AS increase, round(sum(increase) / 300, 6)::DOUBLE AS rate
FROM increases GROUP BY ALL""")
def request_rate_counter(spark: SparkSession, folder: str) -> DataFrame:
    return _told(c.rate_by(_request_increases(spark, folder), ["service"]), "increase", "rate")


@query("error_rate_counter", f"""WITH {_increase_sql(_REQUESTS, '1')},
summed AS (
  SELECT service, bin, sum(increase) AS requests, coalesce(sum(increase) FILTER (WHERE status[1] = '5'), 0) AS errors
  FROM increases GROUP BY ALL)
SELECT service, {_BIN} AS start, requests::DOUBLE AS requests, errors::DOUBLE AS errors,
       CASE WHEN requests > 0 THEN round(100 * errors / requests, 6)::DOUBLE END AS error_percent
FROM summed""")
def error_rate_counter(spark: SparkSession, folder: str) -> DataFrame:
    """Percentage of requests that were answered with a status of 500 or more."""
    shares = c.error_share_by(_request_increases(spark, folder), ["service"], F.col("status").startswith("5"))
    return _told(shares, "error_percent")


@query("span_rate_counter", f"""WITH {_increase_sql(_SPANS, '1')}
SELECT service, {_BIN} AS start, round(sum(increase), 6)::DOUBLE AS increase, round(sum(increase) / 300, 6)::DOUBLE AS rate
FROM increases GROUP BY ALL""")
def span_rate_counter(spark: SparkSession, folder: str) -> DataFrame:
    grown = c.increases(_exported(_events(spark, folder, _SPANS), list(_SPANS), F.lit(1)), list(_SPANS), "ts", "value")
    return _told(c.rate_by(grown, ["service"]), "increase", "rate")


@query("row_rate_extrapolated", f"""WITH {_exported_sql(_ROWS, 'user_id')},
binned AS (SELECT *, time_bucket(INTERVAL 6 HOUR, ts) AS bin FROM samples),
steps AS (SELECT *, lag(value) OVER (PARTITION BY dataset, layer, instance, bin ORDER BY ts, value) AS before FROM binned),
ranges AS (
  SELECT dataset, layer, instance, bin, count(*) AS n,
         sum(CASE WHEN before IS NULL THEN 0 WHEN value < before THEN value ELSE value - before END) AS inner_increase,
         arg_min(value, (ts, value)) AS first_value, epoch_us(min(ts)) / 1e6 AS t1, epoch_us(max(ts)) / 1e6 AS t2, epoch_us(bin) / 1e6 AS t0
  FROM steps GROUP BY ALL),
gaps AS (SELECT *, t2 - t1 AS covered, (t2 - t1) / (n - 1) AS apart, t1 - t0 AS l, t0 + 21600 - t2 AS r FROM ranges WHERE n > 1 AND t2 > t1),
reached AS (
  SELECT *, CASE WHEN l >= 1.1 * apart THEN apart / 2 ELSE l END AS l1, CASE WHEN r >= 1.1 * apart THEN apart / 2 ELSE r END AS r1 FROM gaps),
stretched AS (
  SELECT dataset, layer, bin, inner_increase * (covered + r1
         + CASE WHEN inner_increase > 0 THEN least(l1, covered * first_value / inner_increase) ELSE l1 END) / covered AS increase
  FROM reached)
SELECT dataset, layer, {_BIN} AS start, round(sum(increase), 4)::DOUBLE AS increase, round(sum(increase) / 21600, 6)::DOUBLE AS rate
FROM stretched GROUP BY ALL""")
def row_rate_extrapolated(spark: SparkSession, folder: str) -> DataFrame:
    """Rows per second over six hours, stretched to the borders of the range."""
    grown = c.increases(_row_samples(spark, folder), ["dataset", "layer", "instance"], "ts", "value", "6 hours", extrapolate=True)
    rates = c.rate_by(grown.where("increase IS NOT NULL"), ["dataset", "layer"], 21600)
    return _start(rates).withColumns({"increase": F.round("increase", 4), "rate": F.round("rate", 6)})


_BUCKETS_SQL = (f"(SELECT * FROM events, (SELECT unnest({_LABELS}) AS le) WHERE NOT (user_id % 4 = 3 AND le = '75'))")
_HISTOGRAM = {**_SPANS, "le": "le"}


@query("latency_p95_rated", f"""WITH {_increase_sql(_HISTOGRAM, "(le = '+Inf' OR value <= try_cast(le AS DOUBLE))::INT", _BUCKETS_SQL)},
buckets AS (
  SELECT service, bin, CASE WHEN le = '+Inf' THEN 'Infinity'::DOUBLE ELSE le::DOUBLE END AS le, sum(increase) AS n
  FROM increases GROUP BY ALL),
upward AS (SELECT *, max(n) OVER (PARTITION BY service, bin ORDER BY le) AS upto FROM buckets),
ranked AS (
  SELECT *, lag(le) OVER w AS lower, coalesce(lag(upto) OVER w, 0) AS below, max(upto) OVER (PARTITION BY service, bin) AS total
  FROM upward WINDOW w AS (PARTITION BY service, bin ORDER BY le)),
valued AS (
  SELECT service, bin, le, total, upto, CASE WHEN isinf(le) THEN lower
         WHEN upto > below THEN coalesce(lower, 0) + (le - coalesce(lower, 0)) * (0.95 * total - below) / (upto - below)
         ELSE coalesce(lower, 0) END AS value
  FROM ranked)
SELECT service, {_BIN} AS start, total::DOUBLE AS total,
       round(arg_min(value, le) FILTER (WHERE total > 0 AND upto >= 0.95 * total), 6)::DOUBLE AS quantile_value
FROM valued GROUP BY service, bin, total""")
def latency_p95_rated(spark: SparkSession, folder: str) -> DataFrame:
    """95th percentile of the latency in every range, from bucket counters; one instance lacks a bucket."""
    le = F.explode(F.array(*map(F.lit, _LABELS))).alias("le")
    buckets = _events(spark, folder, _SPANS).select("*", le).where("NOT (user_id % 4 = 3 AND le = '75')")
    labels = list(_HISTOGRAM)
    within = (F.col("amount") <= c.upper_bound(F.col("le"))).cast("int")
    grown = c.increases(_exported(buckets, labels, within), labels, "ts", "value")
    return _told(c.rated_quantile(grown, ["service"], 0.95), "quantile_value")
