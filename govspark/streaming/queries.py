"""Streaming forms: audit ingest, rates, lineage edges, veto expiry, quality gate."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from govspark.operators.expectations import Expectation, evaluate_suite
from govspark.operators.gate import promotion_verdicts
from govspark.operators.lineage import lineage_edges
from govspark.operators.scoring import quality_report
from govspark.sources.topics import normalise, parse_envelopes

WATERMARK = "10 minutes"


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Process all input that is there now into a Parquet table, exactly once per checkpoint."""
    query = (
        stream.writeStream.format("parquet")
        .outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(path)
    )
    finish(query)


def finish(query: StreamingQuery) -> None:
    query.awaitTermination()
    failure = query.exception()
    if failure:
        raise failure


def land(stream: DataFrame, build: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> None:
    """Write ``build`` of every micro-batch into a folder of its own and stop when all input is processed.

    Nothing is kept between batches and no watermark drops anything: what ``build`` returns must be mergeable, and
    the reader merges. A repeated batch overwrites its own folder, so the table is the same after a restart.
    """

    def put(batch: DataFrame, number: int) -> None:
        build(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    finish(
        stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def audit_ingest(messages: DataFrame, now: Column | None = None) -> DataFrame:
    """Topic messages as normalised envelopes. No watermark: the audit log never drops a late event."""
    return normalise(parse_envelopes(messages), now)


def stream_rates(events: DataFrame, time: str, keys: list[str], is_error: Column, width: str = "5 minutes",
                 seconds: int = 300, slide: str | None = None, watermark: str = WATERMARK) -> DataFrame:
    """Request rate and error share per window, once, when the watermark has passed it.

    A row later than ``watermark`` is dropped; where that must not be, use ``rate_partials`` and ``merge_rates``.
    """
    return merge_rates(rate_partials(events.withWatermark(time, watermark), time, keys, is_error, width, slide), keys,
                       seconds, merge=False)


def rate_partials(events: DataFrame, time: str, keys: list[str], is_error: Column, width: str = "5 minutes",
                  slide: str | None = None) -> DataFrame:
    """Requests and errors per window, of a table or of one micro-batch (see ``land``)."""
    window = F.window(time, width, slide) if slide else F.window(time, width)
    grouped = events.groupBy(window.alias("w"), *keys).agg(
        F.count("*").alias("requests"), F.count_if(is_error).alias("errors")
    )
    return grouped.select(F.col("w.start").alias("window_start"), *keys, "requests", "errors")


def merge_rates(partials: DataFrame, keys: list[str], seconds: int = 300, merge: bool = True) -> DataFrame:
    """Request rate and error share per window over all partial counts, however late they came."""
    if merge:
        partials = partials.groupBy("window_start", *keys).agg(F.sum("requests").alias("requests"), F.sum("errors").alias("errors"))
    return partials.select(
        "window_start",
        *keys,
        "requests",
        (F.col("requests") / F.lit(float(seconds))).alias("rate"),
        (F.lit(100.0) * F.col("errors") / F.col("requests")).alias("error_percent"),
    )


def stream_edges(events: DataFrame, time: str = "event_time", watermark: str = WATERMARK) -> DataFrame:
    """Lineage edges of a run event stream; an event that is delivered again within the watermark counts once.

    A run sends several events (start, complete), so an event is known by run, type and time. A later one is
    dropped; where no edge may be lost, ``land`` the edges of each batch and merge them with ``merge_edges``.
    """
    identified = events.withColumn("_run", F.col("run")["runId"])
    fresh = identified.withWatermark(time, watermark).dropDuplicatesWithinWatermark(["_run", "event_type", time])
    return lineage_edges(fresh)


EXPIRY_SCHEMA = "veto_id string, decision_id string, expires_at timestamp"


def _expire(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Hold a veto until event time passes its expiry, then emit it; an ended one is forgotten."""
    if state.hasTimedOut:
        decision_id, micros = state.get
        state.remove()
        yield _expired(key[0], decision_id, micros)
        return
    for rows in batches:
        last = rows.sort_values("event_time").iloc[-1]
        if last["status"] != "active":
            if state.exists:
                state.remove()
            return
        state.update((last["decision_id"], int(last["expires_micros"])))
    if not state.exists:
        return
    decision_id, micros = state.get
    due = micros // 1000  # times out when the watermark (milliseconds) is greater, thus strictly after the expiry
    if due < state.getCurrentWatermarkMs():
        state.remove()
        yield _expired(key[0], decision_id, micros)
    else:
        state.setTimeoutTimestamp(due)


def _expired(veto_id: str, decision_id: str, micros: int) -> pd.DataFrame:
    expires_at = pd.Timestamp(micros, unit="us", tz="UTC")
    return pd.DataFrame({"veto_id": [veto_id], "decision_id": [decision_id], "expires_at": [expires_at]})


def expired_so_far(landed: DataFrame) -> DataFrame:
    """Vetoes whose expiry event time has passed, over all veto rows landed so far (``veto_id``, ``decision_id``,
    ``status``, ``event_time``, ``expires_at``). A veto that arrives late expires like any other."""
    rest = ["decision_id", "status", "expires_at"]
    latest = landed.groupBy("veto_id").agg(F.max_by(F.struct(*rest), "event_time").alias("r")).select("veto_id", "r.*")
    now = landed.agg(F.max("event_time").alias("now"))
    return latest.join(now, F.col("expires_at") < F.col("now")).where("status = 'active'").select(
        "veto_id", "decision_id", "expires_at"
    )


def stream_veto_expiry(vetoes: DataFrame, watermark: str = WATERMARK) -> DataFrame:
    """Vetoes at the moment event time passes their expiry (``veto_id``, ``event_time``, ``status``, ...).

    One small state per open veto; vetoes are spread by their id. A row later than ``watermark`` is dropped; where
    that must not be, ``land`` the rows and ask ``expired_so_far``.
    """
    prepared = vetoes.withWatermark("event_time", watermark).select(
        "veto_id", "decision_id", "status", "event_time", F.unix_micros("expires_at").alias("expires_micros")
    )
    return prepared.groupBy("veto_id").applyInPandasWithState(
        _expire, EXPIRY_SCHEMA, "decision_id string, micros long", "append", GroupStateTimeout.EventTimeTimeout
    )


def stream_quality_gate(batches: DataFrame, dataset_id: str, domain_id: str, source_layer: str, target_layer: str,
                        suite: list[Expectation], path: str, checkpoint: str,
                        after: Callable[[DataFrame, int], None] | None = None) -> None:
    """Score every arriving batch and write its promotion verdict, one folder per batch.

    A repeated batch overwrites its own folder, so the result is the same after a restart.
    """

    def gate(batch: DataFrame, number: int) -> None:
        batch.persist()
        request = evaluate_suite(batch, suite).select(
            F.lit(dataset_id).alias("dataset_id"), F.lit(domain_id).alias("domain_id"), "expectation_type", "success"
        )
        scored = quality_report(request, ["dataset_id", "domain_id"]).select(
            "*", F.lit(source_layer).alias("source_layer"), F.lit(target_layer).alias("target_layer"),
        )
        promotion_verdicts(scored).write.mode("overwrite").parquet(f"{path}/batch={number}")
        if after:
            after(batch, number)
        batch.unpersist()

    finish(
        batches.writeStream.foreachBatch(gate)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
