"""Audit topic and governance event subjects: reading, normalising, publishing, retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from govspark.vocabulary import EVENT_SUBJECTS, RETENTION_DAYS, RETENTION_MESSAGES

ENVELOPE_SCHEMA = (
    "event_type string, timestamp timestamp, actor_id string, resource_type string, resource_id string, "
    "action string, details map<string,string>, trace_id string, span_id string"
)
_TEXT_FIELDS = ("actor_id", "resource_type", "resource_id", "action", "trace_id", "span_id")


def read_topic(spark: SparkSession, servers: str, topic: str, per_trigger: int | None = None) -> DataFrame:
    """Stream of a Kafka topic from its start (needs the public Kafka connector package on the classpath)."""
    reader = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .option("startingOffsets", "earliest")
        .option("failOnDataLoss", "true")
    )
    if per_trigger:
        reader = reader.option("maxOffsetsPerTrigger", per_trigger)
    return reader.load().select(F.col("value").cast("string").alias("value"), "partition", "offset")


def read_json_lines(spark: SparkSession, folder: str, per_trigger: int | None = None) -> DataFrame:
    """The same stream from a folder of files with one JSON message per line."""
    reader = spark.readStream.format("text")
    if per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    return reader.load(folder)


def _parsed(messages: DataFrame, value: str) -> DataFrame:
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"}
    return messages.withColumn("_m", F.from_json(value, f"{ENVELOPE_SCHEMA}, _broken string", options))


def _is_broken(value: str) -> Column:
    is_object = F.coalesce(F.col(value).rlike(r"^\s*\{"), F.lit(False))
    return F.col("_m").isNull() | F.col("_m._broken").isNotNull() | ~is_object


def parse_envelopes(messages: DataFrame, value: str = "value") -> DataFrame:
    """Message text to envelope columns; text that is no JSON object of this form goes to ``broken_envelopes``."""
    kept = _parsed(messages, value).where(~_is_broken(value))
    return kept.select(*[c for c in messages.columns if c != value], "_m.*").drop("_broken")


def broken_envelopes(messages: DataFrame, value: str = "value") -> DataFrame:
    """The other messages, unchanged (text, and offset where there is one), for a side table."""
    return _parsed(messages, value).where(_is_broken(value)).select(messages.columns)


def normalise(envelopes: DataFrame, now: Column | None = None) -> DataFrame:
    """Defaults for absent fields: empty texts, empty map, the given (or current) time."""
    time = F.current_timestamp() if now is None else now
    filled = envelopes.withColumn("timestamp", F.coalesce("timestamp", time))
    for name in _TEXT_FIELDS:
        filled = filled.withColumn(name, F.coalesce(name, F.lit("")))
    return filled.withColumn("details", F.coalesce("details", F.create_map().cast("map<string,string>")))


def as_messages(events: DataFrame, trace: Column | None = None) -> DataFrame:
    """Each event as one JSON ``value``; ``_trace`` is added where the event has none."""
    columns = events
    if trace is not None:
        present = "_trace" in events.columns
        columns = events.withColumn("_trace", F.coalesce("_trace", trace) if present else trace)
    return columns.select(F.to_json(F.struct("*")).alias("value"))


def publish_topic(messages: DataFrame, servers: str, topic: str, checkpoint: str) -> DataStreamWriter:
    """Writer to a Kafka topic that waits for all replicas."""
    return (
        messages.writeStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("kafka.acks", "all")
        .option("topic", topic)
        .option("checkpointLocation", checkpoint)
    )


def route(events: DataFrame, subject_key: str = "subject_key") -> DataFrame:
    """Add the subject of each governance event; events with an unknown key are dropped."""
    pairs = [F.lit(text) for pair in EVENT_SUBJECTS.items() for text in pair]
    subject = F.try_element_at(F.create_map(*pairs), F.col(subject_key))
    return events.withColumn("subject", subject).where("subject IS NOT NULL")


def routed_messages(events: DataFrame, subject_key: str = "subject_key") -> DataFrame:
    """Routed events as ``topic`` and JSON ``value``, as the Kafka sink takes them."""
    routed = route(events, subject_key)
    payload = F.struct(*[c for c in events.columns if c != subject_key])
    return routed.select(F.col("subject").alias("topic"), F.to_json(payload).alias("value"))


def write_routed(events: DataFrame, path: str, subject_key: str = "subject_key") -> None:
    """Append routed events as JSON lines, one folder per subject."""
    routed_messages(events, subject_key).write.mode("append").partitionBy("topic").text(path)


def retain(events: DataFrame, time: str, tie: str, as_of: Column, days: int = RETENTION_DAYS,
           messages: int = RETENTION_MESSAGES) -> DataFrame:
    """Messages that retention keeps: at most ``days`` old, and of those the newest ``messages``.

    Minute counts (at most 1440 per day) give the minute that holds the last message to keep; everything older is
    dropped before the ordering, so the ordering sees the kept rows and one minute more, whatever the stream's size.
    """
    recent = events.where(F.col(time) >= as_of - F.make_dt_interval(F.lit(days)))
    minute = F.date_trunc("minute", F.col(time).cast("timestamp"))
    counts = recent.groupBy(minute.alias("minute")).agg(F.count("*").alias("n"))
    newer = F.sum("n").over(Window.orderBy(F.desc("minute")).rowsBetween(Window.unboundedPreceding, -1))
    needed = counts.withColumn("newer", F.coalesce(newer, F.lit(0))).where(F.col("newer") < messages)
    first = needed.agg(F.min("minute")).scalar()
    return recent.where(F.col(time) >= first).orderBy(F.desc(time), F.desc(tie)).limit(messages)
