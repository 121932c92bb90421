"""Stateful hash chain over a message stream.

``store_chain`` folds every micro-batch in constant memory per task and keeps the heads of all chains in a stored table.
``stream_hash_chain`` keeps them in Spark's state store, and orders the part of a micro-batch that belongs to one chain in
memory; it is for many short chains and small micro-batches.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import LongType, StringType, StructType

from govspark.operators.audit import build_topic_chain, last_links
from govspark.sources import stored
from govspark.streaming.queries import finish
from govspark.vocabulary import TOPIC_GENESIS

CHAIN_SCHEMA = "chain_id string, sequence long, value string, previous_hash string, event_hash string"


def _extend(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    previous = state.get[0] if state.exists else TOPIC_GENESIS
    arrived = pd.concat(list(batches)).sort_values("sequence")
    before, after = [], []
    for text in arrived["value"]:
        before.append(previous)
        previous = hashlib.sha256(f"{previous}:{text}".encode()).hexdigest()
        after.append(previous)
    state.update((previous,))
    yield pd.DataFrame({
        "chain_id": key[0], "sequence": arrived["sequence"].to_numpy(), "value": arrived["value"].to_numpy(),
        "previous_hash": before, "event_hash": after,
    })


def stream_hash_chain(messages: DataFrame) -> DataFrame:
    """Chain messages (``chain_id``, ``sequence``, ``value``) in the topic format; the last hash is the state.

    The state is checkpointed, so a restart continues the chain. A chain is sequential: use one per topic
    partition, and bound a micro-batch (``maxOffsetsPerTrigger``, ``maxFilesPerTrigger``), because the part of it
    that belongs to one chain is ordered in memory. ``value`` must already be in the canonical spaced form.
    """
    return messages.select("chain_id", "sequence", "value").groupBy("chain_id").applyInPandasWithState(
        _extend, CHAIN_SCHEMA, "last_hash string", "append", GroupStateTimeout.NoTimeout
    )


_HEADS = (
    StructType().add("chain_id", StringType()).add("head_hash", StringType()).add("position", LongType())
    .add("before_hash", StringType()).add("before_position", LongType()).add("batch", LongType()).add(stored.BUCKET, "integer")
)


def store_chain(messages: DataFrame, path: str, checkpoint: str) -> None:
    """Chain messages (``chain_id``, ``sequence``, ``value``) in the topic format into a table, one folder per micro-batch.

    A micro-batch is shuffled by chain, sorted by Spark (which spills) and folded row by row, so a task holds one hash however
    many messages a chain has; a chain is sequential, so one task reads its messages. The heads, in ``<path>-heads``, remember
    what they were before the batch that moved them last: a batch that is repeated after a failure starts where
    it did the first time and writes the same rows. A null ``chain_id`` is a chain like others.
    """

    def extend(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        heads = stored.read_stored(spark, f"{path}-heads", _HEADS)
        again = F.col("batch") == number
        start = heads.select(
            F.struct("chain_id").alias("_chain"), F.when(again, F.col("before_hash")).otherwise(F.col("head_hash")).alias("head_hash"),
            F.when(again, F.col("before_position")).otherwise(F.col("position")).alias("position"),
        ).where("head_hash IS NOT NULL")
        keyed = batch.select("chain_id", "sequence", "value", F.struct("chain_id").alias("_chain"))
        chained = build_topic_chain(keyed, ["_chain"], F.col("value"), [F.col("sequence"), F.col("value")], start)
        out = f"{path}/batch={number}"
        chained.select("chain_id", "sequence", "value", "position", "previous_hash", "event_hash").write.mode("overwrite").parquet(out)
        written = spark.read.parquet(out).select(F.struct("chain_id").alias("_chain"), "event_hash", "position")
        before = start.select(F.col("_chain"), F.col("head_hash").alias("before_hash"), F.col("position").alias("before_position"))
        moved = last_links(written, ["_chain"]).join(before, "_chain", "left").select(
            F.col("_chain")["chain_id"].alias("chain_id"), "head_hash", "position", "before_hash", "before_position",
            F.lit(number).cast("long").alias("batch"),
        )
        stored.upsert(f"{path}-heads", moved, ["chain_id"], ["batch"])

    finish(messages.writeStream.foreachBatch(extend).option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
