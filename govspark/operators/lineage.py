"""Lineage: run events to edges and job records, neighbours and reach."""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from govspark.functions.urns import DEFAULT_PLATFORM, dataset_urn, job_urn
from govspark.session import cut_lineage

EVENT_TYPES = ("START", "RUNNING", "COMPLETE", "FAIL", "ABORT")


def _urn(dataset: Column, platform: str) -> Column:
    return dataset_urn(dataset["name"], dataset["namespace"], platform)


def lineage_edges(events: DataFrame, platform: str = DEFAULT_PLATFORM) -> DataFrame:
    """Every output of a run event with every input of the same event. Row by row, no shuffle."""
    pairs = events.select("job", "inputs", F.explode("outputs").alias("output")).select(
        "job", "output", F.explode("inputs").alias("input")
    )
    return pairs.select(
        _urn(F.col("input"), platform).alias("source_urn"),
        _urn(F.col("output"), platform).alias("target_urn"),
        F.lit("TRANSFORMED").alias("edge_type"),
        job_urn(F.col("job.name"), platform).alias("job_urn"),
    )


def job_records(events: DataFrame, platform: str = DEFAULT_PLATFORM) -> DataFrame:
    """Job input/output change record per run event."""
    urns = lambda column: F.coalesce(
        F.transform(column, lambda d: _urn(d, platform)), F.array().cast("array<string>")
    )
    aspect = F.struct(urns("inputs").alias("inputDatasets"), urns("outputs").alias("outputDatasets"))
    urn = job_urn(F.col("job.name"), platform)
    record = F.struct(
        F.lit("dataJob").alias("entityType"),
        urn.alias("entityUrn"),
        F.lit("dataJobInputOutput").alias("aspectName"),
        aspect.alias("aspect"),
        F.lit("UPSERT").alias("changeType"),
    )
    return events.select(urn.alias("job_urn"), F.to_json(record).alias("record"))


def run_events(jobs: DataFrame, producer: str = DEFAULT_PLATFORM, event_type: str = "COMPLETE",
               run_id: Column | None = None, event_time: Column | None = None) -> DataFrame:
    """Run events for rows with ``job_name``, ``inputs``, ``outputs``.

    Without ``run_id`` and ``event_time`` the run gets a random id and the time of the query.
    """
    if event_type not in EVENT_TYPES:
        raise ValueError(f"unknown run event type {event_type!r}")
    return jobs.select(
        F.lit(event_type).alias("event_type"),
        (F.current_timestamp() if event_time is None else event_time).alias("event_time"),
        F.create_map(F.lit("runId"), F.uuid() if run_id is None else run_id).alias("run"),
        F.struct(F.lit(producer).alias("namespace"), F.col("job_name").alias("name")).alias("job"),
        "inputs",
        "outputs",
        F.lit(producer).alias("producer"),
        F.lit(_SCHEMA_URL).alias("schema_url"),
    )


# Fixed value: public address of the run event schema.
_SCHEMA_URL = "https://openlineage.io/spec/1-0-5/OpenLineage.json#/definitions/RunEvent"


def emit_events(events: DataFrame, path: str) -> None:
    """Append run events to the event table, by type."""
    events.write.mode("append").partitionBy("event_type").parquet(path)


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """The event table; a run event that was appended again counts once (run, type and time name an event)."""
    stored = spark.read.parquet(path).withColumn("_run", F.col("run")["runId"])
    return stored.dropDuplicates(["_run", "event_type", "event_time"]).drop("_run")


def edges_by(edges: DataFrame, source: str | None = None, target: str | None = None, job: str | None = None) -> DataFrame:
    """Edges with the given source, target and job; what is None is free."""
    for name, value in (("source_urn", source), ("target_urn", target), ("job_urn", job)):
        if value is not None:
            edges = edges.where(F.col(name) == value)
    return edges


def merge_edges(known: DataFrame, arrived: DataFrame) -> DataFrame:
    """Edge table after an upsert by source, target and job.

    Dealt out by edge first, over all shuffle partitions: a small file of runs spreads into very many edges, which one map task would
    sort, and names compress so well that partitions joined by their stored size would hold too many.
    """
    keys = ["source_urn", "target_urn", "job_urn"]
    parts = int(known.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return known.unionByName(arrived).repartition(parts, *keys).dropDuplicates(keys)


def neighbours(edges: DataFrame) -> DataFrame:
    """Per dataset the number of distinct direct sources and targets (two-step counts, no set per hub)."""
    pairs = edges.select("source_urn", "target_urn").distinct()
    up = pairs.groupBy(F.col("target_urn").alias("urn")).agg(F.count("*").alias("sources"))
    down = pairs.groupBy(F.col("source_urn").alias("urn")).agg(F.count("*").alias("targets"))
    return up.join(down, "urn", "full_outer").fillna(0, ["sources", "targets"])


def ancestors(edges: DataFrame, start: DataFrame | None = None) -> DataFrame:
    """All datasets upstream (``urn``, ``ancestor``, shortest ``depth``) of the datasets in ``start`` (column ``urn``).

    Without ``start`` of every dataset, which is the whole closure: give ``start`` on a large graph.

    Breadth-first: a round joins only the pairs found last with the edges and drops known pairs. Each round writes its
    new pairs to the shared checkpoint folder, so the plan stays short and a lost executor does not undo it.
    Rounds end when nothing is new, however deep the lineage is.
    """
    pairs = edges.select(F.col("source_urn").alias("parent"), F.col("target_urn").alias("child")).distinct()
    pairs = cut_lineage(pairs)
    seeds = pairs if start is None else pairs.join(start.select(F.col("urn").alias("child")).distinct(), "child")
    frontier = cut_lineage(seeds.select(F.col("child").alias("urn"), F.col("parent").alias("ancestor"),
                                        F.lit(1).alias("depth")))
    found = frontier
    for depth in count(2):
        step = (
            frontier.join(pairs, F.col("ancestor") == F.col("child"))
            .select("urn", F.col("parent").alias("ancestor"))
            .distinct()
            .join(found.select("urn", "ancestor"), ["urn", "ancestor"], "left_anti")
        )
        frontier = cut_lineage(step.withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            return found
        found = found.unionByName(frontier)
        if depth % 10 == 0:  # keeps the union short on deep lineage
            found = cut_lineage(found)
