"""Hash-chained audit logs: digests, building, verification, listings, append-only check.

A hash chain is sequential: each digest covers the one before. A chain of any length is built by one task that reads
its events in order and keeps nothing but the last hash; the sort before it spills to disk, the texts under the
digests are made in parallel, and different chains are built by different tasks. Verification needs no order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from govspark.functions.canonical import ascii_json, iso_timestamp, quoted, quoted_map
from govspark.vocabulary import GENESIS_HASH, TOPIC_GENESIS


def digest(previous_hash: Column, details: Column | None = None) -> Column:
    """SHA-256 of the canonical JSON of the eight covered fields of an event.

    ``details`` is canonical JSON text; by default it is built from the ``details`` map of texts. For details
    with numbers or nesting pass ``canonical_json`` of their JSON text.
    """
    return F.sha2(ascii_json(F.concat(_payload(details), quoted(previous_hash), F.lit("}"))), 256)


def _payload(details: Column | None = None) -> Column:
    """JSON text of an event up to its previous hash, which is the last of the sorted keys (see ``quoted``)."""
    if details is None:
        details = quoted_map(F.coalesce("details", F.create_map().cast("map<string,string>")))
    return F.concat(
        F.lit('{"actor_id":'), quoted(F.col("actor_id")),
        F.lit(',"description":'), quoted(F.coalesce("description", F.lit(""))),
        F.lit(',"details":'), details,
        F.lit(',"entity_id":'), quoted(F.col("entity_id")),
        F.lit(',"entity_type":'), quoted(F.col("entity_type")),
        F.lit(',"event_type":'), quoted(F.col("event_type")),
        F.lit(',"occurred_at":'), quoted(iso_timestamp(F.col("occurred_at"))),
        F.lit(',"previous_hash":'),
    )


def with_digest_check(events: DataFrame, details: Column | None = None) -> DataFrame:
    """Add ``intact``: the stored hash equals the recomputed one. No shuffle."""
    return events.withColumn("intact", F.col("event_hash").eqNullSafe(digest(F.col("previous_hash"), details)))


def _chain(events: DataFrame, keys: list[str], link: Callable[[str, str], bytes], genesis: str, order: list[Column],
           heads: DataFrame | None) -> DataFrame:
    """Fold the events of each key in ``order``; ``link`` gives what the digest covers, from last hash and ``_body``.

    With ``heads`` positions and hashes go on where the stored chain ends, so the result does not depend on how
    the events were split into batches.
    """
    kept = [f for f in events.schema.fields if f.name != "_body"]
    added = [T.StructField("position", T.LongType()), T.StructField("previous_hash", T.StringType()),
             T.StructField("event_hash", T.StringType())]
    names = [f.name for f in kept]
    # A stored head is a row before the first event of its chain; the events have no ``_done``.
    if heads is None:
        events = events.withColumns({"_head": F.lit(None).cast("string"), "_done": F.lit(None).cast("long")})
    else:
        known = heads.select(*keys, F.col("head_hash").alias("_head"), F.col("position").cast("long").alias("_done"))
        events = events.unionByName(known, allowMissingColumns=True)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        started, chain, last, position = False, None, genesis, 0
        for batch in batches:
            before, after, places = [], [], []
            owners = zip(*(batch.column(k).to_pylist() for k in keys), strict=True) if keys else [()] * batch.num_rows
            bodies, heads_, done = (batch.column(c).to_pylist() for c in ("_body", "_head", "_done"))
            for owner, body, head, passed in zip(owners, bodies, heads_, done, strict=True):
                if not started or owner != chain:
                    started, chain, last, position = True, owner, genesis, 0
                if passed is not None:
                    last, position = head, passed
                    continue
                position += 1
                places.append(position)
                before.append(last)
                last = hashlib.sha256(link(last, body)).hexdigest()
                after.append(last)
            told = batch.filter(batch.column("_done").is_null())
            yield pa.RecordBatch.from_arrays(
                [*(told.column(n) for n in names), pa.array(places, pa.int64()), pa.array(before, pa.string()),
                 pa.array(after, pa.string())],
                names=[*names, "position", "previous_hash", "event_hash"],
            )

    # By a hash of the keys: a shuffle by the keys themselves is left out above a join or an aggregate by them, and adaptive
    # execution, which then sees nothing that needs whole chains, may spread a chain over several tasks.
    dealt = events.repartition(F.xxhash64(*keys)) if keys else events.repartition(1)
    return dealt.sortWithinPartitions(*keys, F.col("_done").isNull(), *order).mapInArrow(fold, T.StructType(kept + added))


def build_chain(events: DataFrame, keys: list[str], order: list[Column], heads: DataFrame | None = None,
                details: Column | None = None, keep: list[str] | None = None) -> DataFrame:
    """Chain the events of each key in ``order``; adds position, previous_hash and event_hash.

    ``heads`` (see ``last_links``) appends to stored chains. Keys must not be null then. A chain is sorted by one task: ``keep``
    names the columns to carry there, with keys and those in ``order``, where not all are wanted.
    """
    kept = [c for c in events.columns if c not in ("position", "previous_hash", "event_hash") and (keep is None or c in keep)]
    prepared = events.select(*kept, ascii_json(_payload(details)).alias("_body"))
    return _chain(prepared, keys, lambda last, body: f'{body}"{last}"}}'.encode(), GENESIS_HASH, order, heads)


def last_links(chained: DataFrame, keys: list[str]) -> DataFrame:
    """Last hash and position of each chain, to append a batch after it."""
    return chained.groupBy(*keys).agg(
        F.max_by("event_hash", "position").alias("head_hash"), F.max("position").alias("position")
    )


def build_topic_chain(messages: DataFrame, keys: list[str], json_text: Column, order: list[Column],
                      heads: DataFrame | None = None) -> DataFrame:
    """Chain in the topic format: SHA-256 of ``previous:json``, starting at the text ``genesis``."""
    prepared = messages.withColumn("_body", json_text)
    return _chain(prepared, keys, lambda last, body: f"{last}:{body}".encode(), TOPIC_GENESIS, order, heads)


def chain_anchors(chained: DataFrame, keys: list[str], every: int) -> DataFrame:
    """Events that record the head of each unbroken chain after every ``every`` of its events, to be kept elsewhere."""
    tops = chained.groupBy(*keys, F.floor((F.col("position") - 1) / every).alias("segment")).agg(
        F.max_by("event_hash", "position").alias("head"),
        F.max("occurred_at").alias("occurred_at"),
        F.max("position").alias("size"),
    )
    return tops.select(
        *keys,
        "segment",
        F.lit("chain_anchored").alias("event_type"),
        F.lit("chain").alias("entity_type"),
        F.concat_ws("/", *keys).alias("entity_id"),
        F.lit("system").alias("actor_id"),
        F.lit("").alias("description"),
        F.create_map(F.lit("head"), "head", F.lit("size"), F.col("size").cast("string")).alias("details"),
        "occurred_at",
    )


def chain_links(events: DataFrame, keys: list[str], time: str = "occurred_at", broken: Column | None = None) -> DataFrame:
    """Per chain and hash: how many events carry it, how many name it as predecessor, their times, broken digests.

    Every event contributes two rows, one for its own hash and one for the hash it points to, so one
    aggregation replaces the self join of children to parents. Partial aggregation absorbs a hash that very many
    events point to.
    """
    empty = F.lit(None).cast("timestamp")
    at = F.col(time).cast("timestamp")
    wrong = F.lit(0) if broken is None else broken.cast("int")
    ends = F.array(
        F.struct(F.col("event_hash").alias("hash"), F.lit(1).alias("own"), wrong.alias("wrong"), at.alias("t"),
                 empty.alias("next_t")),
        F.struct(F.col("previous_hash").alias("hash"), F.lit(0).alias("own"), F.lit(0).alias("wrong"),
                 empty.alias("t"), at.alias("next_t")),
    )
    rows = events.select(*keys, F.explode(ends).alias("e")).select(*keys, "e.*")
    return rows.groupBy(*keys, "hash").agg(
        F.sum("own").alias("carriers"),
        F.sum(F.lit(1) - F.col("own")).alias("successors"),
        F.sum("wrong").alias("broken"),
        F.max("t").alias("at"),
        F.min("next_t").alias("next_at"),
    )


def verify_chain(events: DataFrame, keys: list[str], time: str = "occurred_at",
                 details: Column | None = None) -> DataFrame:
    """One verdict per chain, with the number of defects of each kind. One scan, no join.

    Sound: every digest is right, one event starts at the genesis hash, every other event has exactly one
    predecessor and at most one successor, and times do not run backwards. These make a single path in time
    order; a cycle would need a SHA-256 collision, because each digest covers its predecessor's.
    A chain whose end was cut off passes, as it does when read in order: compare ``head`` with a kept copy.
    """
    checked = with_digest_check(events, details)
    links = chain_links(checked, keys, time, ~F.col("intact"))
    root = F.col("hash").eqNullSafe(F.lit(GENESIS_HASH))
    inner = ~root
    verdicts = links.groupBy(*keys).agg(
        F.sum("carriers").alias("events"),
        F.sum("broken").alias("broken_digests"),
        F.coalesce(F.sum(F.when(root, F.col("successors"))), F.lit(0)).alias("roots"),
        F.coalesce(F.sum(F.when(inner & (F.col("carriers") == 0), F.col("successors"))), F.lit(0)).alias("orphans"),
        F.count_if(inner & (F.col("successors") > 1)).alias("forks"),
        F.count_if(F.col("carriers") > F.when(inner, 1).otherwise(0)).alias("repeated"),
        F.count_if(inner & (F.col("next_at") < F.col("at"))).alias("backwards"),
        F.max(F.when(inner & (F.col("successors") == 0), F.col("hash"))).alias("head"),
    )
    defects = ["broken_digests", "orphans", "forks", "repeated", "backwards"]
    sound = (F.col("roots") == 1) & (sum((F.col(d) for d in defects), F.lit(0)) == 0)
    return verdicts.withColumn("valid", sound)


def chain_defects(events: DataFrame, keys: list[str], time: str = "occurred_at") -> DataFrame:
    """Events that break their chain, with the reasons (digest, orphan, backwards, fork, repeated)."""
    checked = with_digest_check(events)
    parents = events.groupBy(*keys, F.col("event_hash").alias("previous_hash")).agg(
        F.max(time).alias("_parent_time")
    )
    shared = events.groupBy(*keys, "previous_hash").agg(F.count("*").alias("_siblings"))
    copies = events.groupBy(*keys, "event_hash").agg(F.count("*").alias("_copies"))
    joined = (
        checked.join(parents, [*keys, "previous_hash"], "left")
        .join(shared, [*keys, "previous_hash"], "left")
        .join(copies, [*keys, "event_hash"], "left")
    )
    inner = F.col("previous_hash") != GENESIS_HASH
    reasons = F.array(
        F.when(~F.col("intact"), "digest"),
        F.when(inner & F.col("_parent_time").isNull(), "orphan"),
        F.when(inner & (F.col("_parent_time") > F.col(time)), "backwards"),
        F.when(F.col("_siblings") > 1, "fork"),
        F.when(F.col("_copies") > 1, "repeated"),
    )
    found = joined.withColumn("reasons", F.filter(reasons, lambda r: r.isNotNull()))
    return found.where(F.size("reasons") > 0).select(*events.columns, "reasons")


def oldest(events: DataFrame, limit: int = 1000, time: str = "occurred_at", tie: str = "id") -> DataFrame:
    """The verification window: the oldest events by time."""
    return events.orderBy(time, tie).limit(limit)


def chain_heads(events: DataFrame, keys: list[str]) -> DataFrame:
    """Hash that no event of the chain names as its predecessor (one row per sound chain)."""
    links = chain_links(events, keys)
    return links.where((F.col("carriers") > 0) & (F.col("successors") == 0)).select(
        *keys, F.col("hash").alias("head_hash")
    )


def list_events(events: DataFrame, event_type: str | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    """Page of events, newest first."""
    chosen = events if event_type is None else events.where(F.col("event_type") == event_type)
    return chosen.orderBy(F.desc("occurred_at"), "id").offset(offset).limit(limit)


def entity_trail(events: DataFrame, entity_id: str, limit: int = 50) -> DataFrame:
    """Oldest events of one entity."""
    return events.where(F.col("entity_id") == entity_id).orderBy("occurred_at", "id").limit(limit)


def entity_trails(events: DataFrame, limit: int = 50) -> DataFrame:
    """Oldest events of every entity. Spark cuts each map task to ``limit`` rows per entity before the shuffle."""
    order = Window.partitionBy("entity_id").orderBy("occurred_at", "id")
    return events.withColumn("position", F.row_number().over(order)).where(F.col("position") <= limit)


def lost_rows(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows of an append-only table that a later state no longer holds (changed or deleted); empty if sound.

    Compares counts per row, so that one of two equal rows cannot go missing unseen.
    """
    columns = before.columns
    marked = before.select(*columns, F.lit(1).alias("_n")).unionByName(after.select(*columns, F.lit(-1).alias("_n")))
    balance = marked.groupBy(*columns).agg(F.sum("_n").alias("missing"))
    return balance.where("missing > 0")
