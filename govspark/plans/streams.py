"""Structured Streaming forms, fed with the supplied tables and run until all input is processed."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from govspark.operators.expectations import Expectation
from govspark.operators.lineage import lineage_edges, merge_edges
from govspark.plans import derived as d
from govspark.plans.audit import topic_messages
from govspark.plans.decisions import _FIRST_SQL, stored_vetoes
from govspark.plans.lineage import EVENTS_SQL, run_events
from govspark.plans.observability import _BIN
from govspark.plans.registry import query, table
from govspark.plans.topics import ENVELOPE_SQL, flat_envelopes, messages
from govspark.session import fresh_path
from govspark.sources.topics import read_json_lines
from govspark.streaming import queries as s
from govspark.streaming.chain import stream_hash_chain


def stream_of(spark: SparkSession, batch: DataFrame, name: str) -> DataFrame:
    """Land a table as files in the shared folder and open them as a stream."""
    path = fresh_path(spark, name)
    batch.write.parquet(path)
    return spark.readStream.schema(batch.schema).parquet(path)


def evaluated(batch: DataFrame, name: str) -> DataFrame:
    """``batch`` as a table in the shared folder, so that what is read from it step by step is worked out once."""
    path = fresh_path(batch.sparkSession, f"{name}-evaluated")
    batch.write.parquet(path)
    return batch.sparkSession.read.schema(batch.schema).parquet(path)


def replay(spark: SparkSession, batch: DataFrame, name: str, order: Column, build: Callable[[DataFrame], DataFrame],
           steps: int = 4) -> DataFrame:
    """Let a table arrive in steps along ``order``, with a restart of the streaming query after each step."""
    source, sink = fresh_path(spark, name), fresh_path(spark, f"{name}-out")
    keyed = evaluated(batch.withColumn("_order", order.cast("double")), name)
    cuts = keyed.approxQuantile("_order", [i / steps for i in range(1, steps)], 0.01)
    bounds = [-math.inf, *cuts, math.inf]
    for low, high in zip(bounds, bounds[1:]):
        arrived = keyed.where((F.col("_order") >= low) & (F.col("_order") < high)).drop("_order")
        arrived.write.mode("append").parquet(source)
        stream = build(spark.readStream.schema(batch.schema).parquet(source))
        s.run_available(stream, f"{sink}/data", f"{sink}/checkpoint")
    return spark.read.schema(stream.schema).parquet(f"{sink}/data")


def landed(spark: SparkSession, batch: DataFrame, name: str, build: Callable[[DataFrame], DataFrame], mark: Column,
           steps: int = 4) -> DataFrame:
    """Let a table arrive in ``steps`` batches out of time order (by a hash of ``mark``), with a restart after each."""
    source, sink = fresh_path(spark, name), fresh_path(spark, f"{name}-out")
    stepped = evaluated(batch.withColumn("_step", F.pmod(F.xxhash64(mark), F.lit(steps))), name)
    for step in range(steps):
        stepped.where(F.col("_step") == step).drop("_step").write.mode("append").parquet(source)
        stream = spark.readStream.schema(batch.schema).parquet(source)
        s.land(stream, build, f"{sink}/data", f"{sink}/checkpoint")
    return spark.read.parquet(f"{sink}/data").drop("batch")


def table_stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of the supplied tables as a stream."""
    schema = table(spark, folder, name).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(folder)


def _finish(spark: SparkSession, stream: DataFrame, name: str) -> DataFrame:
    sink = fresh_path(spark, name)
    s.run_available(stream, f"{sink}/data", f"{sink}/checkpoint")
    return spark.read.schema(stream.schema).parquet(f"{sink}/data")


@query("audit_ingest", ENVELOPE_SQL.replace('event_id AS "offset", ', ""))
def audit_ingest(spark: SparkSession, folder: str) -> DataFrame:
    """Topic messages as JSON lines, read as a text stream."""
    path = fresh_path(spark, "topic")
    messages(spark, folder).select("value").repartition(4).write.text(path)
    ingested = s.audit_ingest(read_json_lines(spark, path, 2), F.lit("2024-02-01").cast("timestamp"))
    return flat_envelopes(_finish(spark, ingested, "ingest").withColumn("offset", F.lit(0))).drop("offset")


@query("stream_audit_ingest", ENVELOPE_SQL)
def stream_audit_ingest(spark: SparkSession, folder: str) -> DataFrame:
    """Messages with their offsets in several micro-batches."""
    now = F.lit("2024-02-01").cast("timestamp")
    arrived = messages(spark, folder)
    return flat_envelopes(replay(spark, arrived, "topic", F.col("offset"), lambda m: s.audit_ingest(m, now)))


@query("stream_hash_chain", """WITH RECURSIVE messages AS (
  SELECT event_id, user_id, ts, '{"actor_id": "u' || user_id || '", "event_type": "' || event_type || '", "timestamp": "'
         || """ + d.ISO_SQL + """ || '"}' AS body FROM events),
numbered AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM messages),
chained AS (
  SELECT event_id, user_id, rn, sha256('genesis:' || body) AS event_hash FROM numbered WHERE rn = 1
  UNION ALL
  SELECT n.event_id, n.user_id, n.rn, sha256(c.event_hash || ':' || n.body)
  FROM chained c JOIN numbered n ON n.user_id = c.user_id AND n.rn = c.rn + 1)
SELECT event_id AS sequence, CAST(user_id AS VARCHAR) AS chain_id, event_hash FROM chained""")
def stream_hash_chain_query(spark: SparkSession, folder: str) -> DataFrame:
    """One unbroken chain per user over several micro-batches."""
    rows = topic_messages(spark, folder).select(
        F.col("chain_id").cast("string").alias("chain_id"), F.col("id").alias("sequence"), "value"
    )
    chained = replay(spark, rows, "chain", F.col("sequence"), stream_hash_chain)
    return chained.select("sequence", "chain_id", "event_hash")


@query("stream_rates", f"""
SELECT event_type, {_BIN} AS window_start, count(*) AS requests, round(count(*) / 300.0, 6)::DOUBLE AS rate,
       round(100.0 * count(*) FILTER (WHERE value > 100) / count(*), 6)::DOUBLE AS error_percent
FROM events GROUP BY 1, 2""")
def stream_rates(spark: SparkSession, folder: str) -> DataFrame:
    """All five-minute windows of events that arrive out of order, days late."""
    events = table(spark, folder, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    partials = landed(spark, events, "rates", lambda b: s.rate_partials(b, "ts", ["event_type"], F.col("value") > 100),
                      F.col("event_id"))
    done = s.merge_rates(partials, ["event_type"])
    return done.select(
        "event_type", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "requests",
        F.round("rate", 6).alias("rate"), F.round("error_percent", 6).alias("error_percent"),
    )


@query("stream_rates_sliding", """
WITH spread AS (
  SELECT time_bucket(INTERVAL 1 MINUTE, ts) - INTERVAL 1 MINUTE * back AS start, value
  FROM events, (SELECT unnest(range(5)) AS back))
SELECT strftime(start, '%Y-%m-%d %H:%M:%S') AS window_start, count(*) AS requests, round(count(*) / 300.0, 6)::DOUBLE AS rate,
       round(100.0 * count(*) FILTER (WHERE value > 100) / count(*), 6)::DOUBLE AS error_percent
FROM spread GROUP BY start""")
def stream_rates_sliding(spark: SparkSession, folder: str) -> DataFrame:
    """The same over five minutes, every minute, for all services together."""
    events = table(spark, folder, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    partials = landed(spark, events, "sliding", lambda b: s.rate_partials(b, "ts", [], F.col("value") > 100, slide="1 minute"),
                      F.col("event_id"))
    done = s.merge_rates(partials, [])
    return done.select(
        F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "requests",
        F.round("rate", 6).alias("rate"), F.round("error_percent", 6).alias("error_percent"),
    )


@query("stream_lineage", f"WITH {EVENTS_SQL} SELECT source_urn, target_urn, job_urn FROM edges")
def stream_lineage(spark: SparkSession, folder: str) -> DataFrame:
    """Every run event is delivered twice."""
    runs = run_events(spark, folder).withColumn("event_time", F.lit("2024-01-01").cast("timestamp"))
    stream = stream_of(spark, runs.unionByName(runs), "runs")
    return _finish(spark, s.stream_edges(stream), "edges").select("source_urn", "target_urn", "job_urn")


@query("stream_rates_closed", f"""
SELECT event_type, {_BIN} AS window_start, count(*) AS requests
FROM events GROUP BY 1, 2
HAVING time_bucket(INTERVAL 5 MINUTE, min(ts)) + INTERVAL 5 MINUTE <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)""")
def stream_rates_closed(spark: SparkSession, folder: str) -> DataFrame:
    """The form with a watermark: a window appears once, when the watermark (here ten minutes) has passed it."""
    events = table_stream(spark, folder, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    done = _finish(spark, s.stream_rates(events, "ts", ["event_type"], F.col("value") > 100), "closed")
    return done.select("event_type", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "requests")


@query("stream_lineage_upsert", f"WITH {EVENTS_SQL} SELECT DISTINCT source_urn, target_urn, job_urn FROM edges")
def stream_lineage_upsert(spark: SparkSession, folder: str) -> DataFrame:
    """Edges of run events that arrive out of order; no edge is dropped for being late."""
    runs = run_events(spark, folder)
    edges = landed(spark, runs, "late-runs", lambda b: lineage_edges(b).distinct(), F.col("run")["runId"])
    return merge_edges(edges.limit(0), edges).select("source_urn", "target_urn", "job_urn")


_VETO_SQL = f"""{_FIRST_SQL}, {d.JUDGED_VETOES_SQL}"""


@query("stream_veto_expiry", f"""WITH {_VETO_SQL}
SELECT id AS veto_id, CAST(decision_id AS VARCHAR) AS decision_id FROM stored
WHERE decision_id % 9 <> 0 AND (SELECT max(vetoed_at) - INTERVAL 10 MINUTE FROM stored) > expires_at""")
def stream_veto_expiry(spark: SparkSession, folder: str) -> DataFrame:
    """Active vetoes whose expiry event time has passed when the input ends."""
    vetoes = stored_vetoes(spark, folder).select(
        F.col("id").alias("veto_id"), F.col("decision_id").cast("string").alias("decision_id"), "status",
        F.col("vetoed_at").cast("timestamp").alias("event_time"), F.col("expires_at").cast("timestamp").alias("expires_at"),
    )
    expired = replay(spark, vetoes, "vetoes", F.unix_micros("event_time"), s.stream_veto_expiry)
    return expired.select("veto_id", "decision_id")


@query("stream_late_vetoes", f"""WITH {_VETO_SQL}
SELECT id AS veto_id, CAST(decision_id AS VARCHAR) AS decision_id FROM stored
WHERE decision_id % 9 <> 0 AND (SELECT max(vetoed_at) FROM stored) > expires_at""")
def stream_late_vetoes(spark: SparkSession, folder: str) -> DataFrame:
    """Vetoes that arrive out of order, years late: all that expired are found."""
    vetoes = stored_vetoes(spark, folder).select(
        F.col("id").alias("veto_id"), F.col("decision_id").cast("string").alias("decision_id"), "status",
        F.col("vetoed_at").cast("timestamp").alias("event_time"), F.col("expires_at").cast("timestamp").alias("expires_at"),
    )
    rows = landed(spark, vetoes, "late-vetoes", lambda b: b, F.col("veto_id"))
    return s.expired_so_far(rows).select("veto_id", "decision_id")


_GATE_SUITE = [
    Expectation("expect_table_row_count_to_be_between", {"min_value": 1}),
    Expectation("expect_column_values_to_not_be_null", {"column": "event_id"}),
    Expectation("expect_column_values_to_be_between", {"column": "value", "min_value": 0.0, "max_value": 300.0}),
    Expectation("expect_column_values_to_be_unique", {"column": "event_id"}),
]


@query("stream_quality_gate", """
WITH checked AS (SELECT event_id % 3 AS b, (count(*) >= 1)::INT AS rows_ok, (count(event_id) = count(*))::INT AS key_ok,
  bool_and(value BETWEEN 0 AND 300)::INT AS value_ok, (count(DISTINCT event_id) = count(*))::INT AS unique_ok FROM events GROUP BY 1),
scored AS (SELECT *, ((rows_ok + key_ok) / 2.0 + value_ok + unique_ok + 3) / 6.0 AS s FROM checked)
SELECT CAST(b AS INTEGER) AS batch, 'events' AS dataset_id, round(s, 6)::DOUBLE AS dq_score, (rows_ok + key_ok + value_ok + unique_ok)::BIGINT AS expectations_passed,
       CASE WHEN s < 0.7 THEN 'refused' ELSE 'promoted' END AS verdict FROM scored""")
def stream_quality_gate(spark: SparkSession, folder: str) -> DataFrame:
    """The events table arrives in three micro-batches, each with a verdict."""
    source, sink = fresh_path(spark, "gate-in"), fresh_path(spark, "gate")
    events = table(spark, folder, "events")
    for step in range(3):
        events.where(F.col("event_id") % 3 == step).write.mode("append").parquet(source)
        stream = spark.readStream.schema(events.schema).parquet(source)
        s.stream_quality_gate(stream, "events", "app", "bronze", "silver", _GATE_SUITE, f"{sink}/verdicts", f"{sink}/checkpoint")
    verdicts = spark.read.parquet(f"{sink}/verdicts")
    return verdicts.select("batch", "dataset_id", F.round("dq_score", 6).alias("dq_score"), "expectations_passed", "verdict")
