"""Audit topic messages in batch: envelopes, publishing, routing, retention."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from govspark.plans import derived as d
from govspark.plans.registry import query, table
from govspark.session import fresh_path
from govspark.sources import topics as t
from govspark.vocabulary import EVENT_SUBJECTS


def messages(spark: SparkSession, folder: str) -> DataFrame:
    """Envelopes as topic messages: most fields are absent in some of them."""
    event = F.col("event_id")
    envelope = F.struct(
        F.col("event_type"),
        F.when(event % 5 != 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")).alias("timestamp"),
        F.when(event % 4 != 0, F.concat(F.lit("u"), "user_id")).alias("actor_id"),
        F.when(event % 3 != 0, F.lit("user")).alias("resource_type"),
        F.col("user_id").cast("string").alias("resource_id"),
        F.when(event % 2 != 0, F.create_map(F.lit("props"), F.col("props"))).alias("details"),
    )
    return table(spark, folder, "events").select(F.to_json(envelope).alias("value"), event.alias("offset"))


ENVELOPE_SQL = """
SELECT event_id AS "offset", event_type, CASE WHEN event_id % 5 <> 0 THEN strftime(ts, '%Y-%m-%d %H:%M:%S')
       ELSE '2024-02-01 00:00:00' END AS timestamp,
       CASE WHEN event_id % 4 <> 0 THEN 'u' || user_id ELSE '' END AS actor_id,
       CASE WHEN event_id % 3 <> 0 THEN 'user' ELSE '' END AS resource_type, CAST(user_id AS VARCHAR) AS resource_id,
       '' AS action, CASE WHEN event_id % 2 <> 0 THEN props ELSE '' END AS details, '' AS trace_id, '' AS span_id
FROM events"""


def flat_envelopes(envelopes: DataFrame) -> DataFrame:
    return envelopes.select(
        "offset", "event_type", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("timestamp"), "actor_id",
        "resource_type", "resource_id", "action",
        F.coalesce(F.try_element_at("details", F.lit("props")), F.lit("")).alias("details"), "trace_id", "span_id",
    )


@query("audit_envelope", ENVELOPE_SQL)
def audit_envelope(spark: SparkSession, folder: str) -> DataFrame:
    now = F.lit("2024-02-01").cast("timestamp")
    return flat_envelopes(t.normalise(t.parse_envelopes(messages(spark, folder)), now))


@query("audit_publish", """
SELECT '{"event_id":' || event_id || ',"event_type":"' || event_type || '","user_id":' || user_id || ',"_trace":"'
       || CASE WHEN event_id % 3 = 0 THEN 'own-' || event_id ELSE 'trace-1' END || '"}' AS value FROM events""")
def audit_publish(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events").select(
        "event_id", "event_type", "user_id",
        F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("own-"), "event_id")).alias("_trace"),
    )
    return t.as_messages(events, F.lit("trace-1"))


_KEYS = (*EVENT_SUBJECTS, "something_else")


@query("event_routing", f"""
SELECT event_id, subject_key, CASE subject_key {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in EVENT_SUBJECTS.items())} END AS subject
FROM (SELECT event_id, {d.sql_list(_KEYS)}[CAST(event_id % 7 AS INTEGER) + 1] AS subject_key FROM events)
WHERE subject_key <> 'something_else'""")
def event_routing(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events").select("event_id", d.pick(_KEYS, F.col("event_id") % 7).alias("subject_key"))
    return t.route(events)


@query("routed_messages", f"""
SELECT CASE subject_key {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in EVENT_SUBJECTS.items())} END AS topic,
       '{{"event_id":' || event_id || '}}' AS value
FROM (SELECT event_id, {d.sql_list(_KEYS)}[CAST(event_id % 7 AS INTEGER) + 1] AS subject_key FROM events)
WHERE subject_key <> 'something_else'""")
def routed_messages(spark: SparkSession, folder: str) -> DataFrame:
    """Write the routed messages by subject and read them."""
    path = fresh_path(spark, "subjects")
    events = table(spark, folder, "events").select("event_id", d.pick(_KEYS, F.col("event_id") % 7).alias("subject_key"))
    t.write_routed(events, path)
    return spark.read.schema("value string, topic string").text(path).select("topic", "value")


@query("event_retention", """
SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-31' - INTERVAL 7 DAY ORDER BY ts DESC, event_id DESC LIMIT 1500""")
def event_retention(spark: SparkSession, folder: str) -> DataFrame:
    """The newest 1500 messages of the last seven days."""
    kept = t.retain(table(spark, folder, "events"), "ts", "event_id", F.lit("2024-01-31").cast("timestamp_ntz"), 7, 1500)
    return kept.select("event_id")


@query("event_retention_default", """
SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-31' - INTERVAL 7 DAY ORDER BY ts DESC, event_id DESC LIMIT 100000""")
def event_retention_default(spark: SparkSession, folder: str) -> DataFrame:
    """The stated limits: 100 000 messages and seven days."""
    kept = t.retain(table(spark, folder, "events"), "ts", "event_id", F.lit("2024-01-31").cast("timestamp_ntz"))
    return kept.select("event_id")


@query("broken_messages", """
SELECT event_id AS "offset", CASE event_id % 3 WHEN 0 THEN 'no json' WHEN 1 THEN '[1]' ELSE '{"actor_id": ' END AS value
FROM events WHERE event_id % 50 = 0""")
def broken_messages(spark: SparkSession, folder: str) -> DataFrame:
    """Every fiftieth message is broken in one of three ways; all others stay readable."""
    bad = F.element_at(F.array(F.lit("no json"), F.lit("[1]"), F.lit('{"actor_id": ')), (F.col("offset") % 3 + 1).cast("int"))
    mixed = messages(spark, folder).withColumn("value", F.when(F.col("offset") % 50 == 0, bad).otherwise(F.col("value")))
    return t.broken_envelopes(mixed).select("offset", "value")
