"""Streams that keep their result in a stored table: nothing is dropped for being late, and nothing old is read again.

Each micro-batch rewrites only the partitions its rows fall into, whatever their age (see ``sources.stored``). What was
rewritten is noted per batch beside the table, in ``<path>-log``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from govspark.sources import stored
from govspark.streaming.queries import finish, merge_rates, rate_partials


def each_batch(stream: DataFrame, update: Callable[[DataFrame, int], DataFrame], path: str, checkpoint: str) -> None:
    """Apply ``update`` to every micro-batch until all input is processed, and note what it returns."""

    def put(batch: DataFrame, number: int) -> None:
        update(batch, number).write.mode("overwrite").parquet(f"{path}-log/batch={number}")

    finish(stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def upsert_stream(stream: DataFrame, build: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, keys: list[str],
                  order: list[str] | None = None, buckets: int = stored.BUCKETS) -> None:
    """Upsert ``build`` of every micro-batch into the keyed table at ``path``."""
    each_batch(stream, lambda batch, _: stored.upsert(path, build(batch), keys, order, buckets), path, checkpoint)


def store_rates(stream: DataFrame, time: str, keys: list[str], is_error: Column, path: str, checkpoint: str,
                width: str = "5 minutes", slide: str | None = None) -> None:
    """Keep requests and errors per window in a table cut by hour."""

    def update(batch: DataFrame, number: int) -> DataFrame:
        partials = rate_partials(batch, time, keys, is_error, width, slide)
        return stored.add_partials(path, partials, number, ["window_start", *keys], ["requests", "errors"],
                                   stored.span_of(F.col("window_start")))

    each_batch(stream, update, path, checkpoint)


def stored_rates(spark: SparkSession, path: str, keys: list[str], seconds: int = 300) -> DataFrame:
    """Request rate and error share per window; one stored row each, nothing is aggregated again."""
    return merge_rates(spark.read.parquet(path), keys, seconds, merge=False)


def store_vetoes(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Keep the latest row of every veto (``veto_id``, ``decision_id``, ``status``, ``event_time``, ``expires_at``) in a table cut by
    the hour of its expiry, and the latest event time in ``<path>-clock``.

    A veto's expiry is fixed when it is cast: all its rows carry the same.
    """

    def update(batch: DataFrame, _: int) -> DataFrame:
        kept = stored.keep_latest(path, batch, ["veto_id"], "event_time", stored.span_of(F.col("expires_at")))
        clock = batch.agg(F.max("event_time").alias("now")).where("now IS NOT NULL").withColumn("name", F.lit("event_time"))
        stored.upsert(f"{path}-clock", clock, ["name"], ["now"], buckets=1)
        return kept

    each_batch(stream, update, path, checkpoint)


def expired_vetoes(spark: SparkSession, path: str, since: str | None = None) -> DataFrame:
    """Active vetoes whose expiry event time has passed; with ``since`` (a time) only those that expired from then on.

    Reads the hours of expiry between ``since`` and the clock. The clock is one row.
    """
    latest = spark.read.parquet(f"{path}-clock").first()
    now = F.lit(latest["now"]) if latest else F.lit(None).cast("timestamp")
    due = spark.read.parquet(path).where((F.col(stored.SPAN) <= stored.span_of(now)) & (F.col("expires_at") < now))
    if since is not None:
        begin = F.lit(since).cast("timestamp")
        due = due.where((F.col(stored.SPAN) >= stored.span_of(begin)) & (F.col("expires_at") >= begin))
    return due.where("status = 'active'").select("veto_id", "decision_id", "expires_at")
