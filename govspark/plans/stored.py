"""Tables that are updated in place: edges, a catalog, late rates and vetoes, in batches out of order."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from govspark.operators import lineage as ln
from govspark.plans.decisions import stored_vetoes
from govspark.plans.lineage import EVENTS_SQL, run_events
from govspark.plans.observability import _BIN
from govspark.plans.registry import query, table
from govspark.plans.streams import _VETO_SQL, evaluated
from govspark.session import fresh_path
from govspark.sources import stored
from govspark.streaming import state
from govspark.streaming.chain import store_chain

_EDGE = ["source_urn", "target_urn", "job_urn"]


def arriving(spark: SparkSession, batch: DataFrame, name: str, step: Column, run: Callable[[DataFrame, str], None],
             steps: int = 3) -> str:
    """Let a table arrive in ``steps`` batches, each row in batch ``step`` (null: the first), with a restart after each."""
    source, checkpoint = fresh_path(spark, name), fresh_path(spark, f"{name}-checkpoint")
    stepped = evaluated(batch.withColumn("_step", F.coalesce(step, F.lit(0))), name)
    for number in range(steps):
        stepped.where(F.col("_step") == number).drop("_step").write.mode("append").parquet(source)
        run(spark.readStream.schema(batch.schema).parquet(source), checkpoint)
    return checkpoint


# A mart's edges come in the first batch, those of parts in the second; the third repeats both and brings nothing new.
_BATCH_SQL = "CASE WHEN contains(target_urn, 'size_') THEN 0 ELSE 1 END"
_BUCKET_SQL = "('0x' || substr(md5('=' || source_urn || chr(31) || '=' || target_urn || chr(31) || '=' || job_urn), 1, 8))::BIGINT % 16"


def _upserted_edges(spark: SparkSession, folder: str) -> tuple[str, list[DataFrame]]:
    edges = ln.lineage_edges(run_events(spark, folder)).select(*_EDGE)
    first = edges.where(F.contains("target_urn", F.lit("size_")))
    path = fresh_path(spark, "edges")
    rest = edges.where(~F.contains("target_urn", F.lit("size_")))
    reports = [stored.upsert(path, batch, _EDGE, buckets=16).withColumn("batch", F.lit(number))
               for number, batch in enumerate((first, rest, edges))]
    return path, reports


@query("edge_table", f"WITH {EVENTS_SQL} SELECT DISTINCT source_urn, target_urn, job_urn FROM edges")
def edge_table(spark: SparkSession, folder: str) -> DataFrame:
    """The stored edges after three batches, the last of them a repetition."""
    path, _ = _upserted_edges(spark, folder)
    return spark.read.parquet(path).select(*_EDGE)


@query("edge_table_rewrites", f"""WITH {EVENTS_SQL},
arrived AS (SELECT DISTINCT source_urn, target_urn, job_urn, {_BATCH_SQL} AS batch, {_BUCKET_SQL} AS bucket FROM edges),
sizes AS (SELECT batch, bucket, count(*) AS inserted FROM arrived GROUP BY 1, 2)
SELECT batch::INTEGER AS batch, bucket::INTEGER AS bucket, inserted, 0::BIGINT AS updated,
       (SELECT sum(inserted) FROM sizes e WHERE e.bucket = s.bucket AND e.batch <= s.batch)::BIGINT AS rows
FROM sizes s""")
def edge_table_rewrites(spark: SparkSession, folder: str) -> DataFrame:
    """The buckets each batch rewrote; the repetition rewrote none."""
    _, reports = _upserted_edges(spark, folder)
    return reports[0].unionByName(reports[1]).unionByName(reports[2]).select("batch", "bucket", "inserted", "updated", "rows")


@query("edge_table_lookup", f"""WITH {EVENTS_SQL}
SELECT DISTINCT source_urn, target_urn, job_urn FROM edges WHERE contains(target_urn, ',part_17,') AND contains(source_urn, ':raw,')""")
def edge_table_lookup(spark: SparkSession, folder: str) -> DataFrame:
    """One edge by its whole key, from the bucket that holds it."""
    path, _ = _upserted_edges(spark, folder)
    known = ln.lineage_edges(run_events(spark, folder)).where("contains(target_urn, ',part_17,') AND contains(source_urn, ':raw,')")
    key = known.select(*_EDGE).first()
    return stored.lookup(spark.read.parquet(path), 16, **key.asDict()).select(*_EDGE)


_CHANGES_SQL = """changes AS (
  SELECT o_custkey, o_orderpriority, o_totalprice, o_orderdate, o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 0 WHEN o_orderstatus = 'O' THEN 1 ELSE 2 END AS batch
  FROM orders)"""


def _catalog(spark: SparkSession, folder: str) -> tuple[str, list[DataFrame]]:
    """Orders as catalog rows of their customer: finished ones first, then open ones, pending ones last."""
    orders = table(spark, folder, "orders").select(
        F.concat(F.lit("cust_"), "o_custkey").alias("dataset_id"), F.col("o_orderpriority").alias("domain_id"),
        F.col("o_totalprice").alias("quality_score"), F.col("o_orderdate").alias("updated_at"), F.col("o_orderkey").alias("version"),
        F.col("o_orderstatus").alias("status"),
    )
    path = fresh_path(spark, "catalog")
    batches = [orders.where(F.col("status") == s).drop("status") for s in "FOP"]
    reports = [stored.upsert(path, b, ["dataset_id"], ["updated_at", "version"]).withColumn("batch", F.lit(n))
               for n, b in enumerate([*batches, orders.drop("status")])]
    return path, reports


@query("catalog_table", """
SELECT 'cust_' || o_custkey AS dataset_id, o_orderpriority AS domain_id, o_totalprice AS quality_score
FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1""")
def catalog_table(spark: SparkSession, folder: str) -> DataFrame:
    """The stored catalog after three batches out of time order and a repetition of all."""
    path, _ = _catalog(spark, folder)
    return spark.read.parquet(path).select("dataset_id", "domain_id", "quality_score")


@query("catalog_table_changes", f"""WITH {_CHANGES_SQL},
best AS (
  SELECT o_custkey, batch, max((o_orderdate, o_orderkey)) AS stamp FROM changes GROUP BY 1, 2),
seen AS (
  SELECT *, max(stamp) OVER (PARTITION BY o_custkey ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM best)
SELECT batch::INTEGER AS batch, count(*) FILTER (WHERE before IS NULL)::BIGINT AS inserted, count(*) FILTER (WHERE stamp > before)::BIGINT AS updated
FROM seen GROUP BY 1""")
def catalog_table_changes(spark: SparkSession, folder: str) -> DataFrame:
    """Rows each batch inserted and replaced; the repetition did neither."""
    _, reports = _catalog(spark, folder)
    summed = [r.groupBy("batch").agg(F.sum("inserted").alias("inserted"), F.sum("updated").alias("updated")) for r in reports]
    return summed[0].unionByName(summed[1]).unionByName(summed[2]).unionByName(summed[3])


@query("stream_edge_table", f"WITH {EVENTS_SQL} SELECT DISTINCT source_urn, target_urn, job_urn FROM edges")
def stream_edge_table(spark: SparkSession, folder: str) -> DataFrame:
    """Run events out of order, each delivered twice, into the stored edge table."""
    runs = run_events(spark, folder)
    path = fresh_path(spark, "stream-edges")
    step = F.pmod(F.crc32(F.col("run")["runId"]), F.lit(3))
    arriving(spark, runs.unionByName(runs), "runs", step, lambda stream, checkpoint: state.upsert_stream(
        stream, lambda b: ln.lineage_edges(b).select(*_EDGE), path, checkpoint, _EDGE, buckets=16))
    return spark.read.parquet(path).select(*_EDGE)


def _stored_rates(spark: SparkSession, folder: str) -> str:
    events = table(spark, folder, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    path = fresh_path(spark, "rates")
    arriving(spark, events, "rates-in", F.pmod("event_id", F.lit(3)), lambda stream, checkpoint: state.store_rates(
        stream, "ts", ["event_type"], F.col("value") > 100, path, checkpoint))
    return path


@query("stream_rates_stored", f"""
SELECT event_type, {_BIN} AS window_start, count(*) AS requests, round(count(*) / 300.0, 6)::DOUBLE AS rate,
       round(100.0 * count(*) FILTER (WHERE value > 100) / count(*), 6)::DOUBLE AS error_percent
FROM events GROUP BY 1, 2""")
def stream_rates_stored(spark: SparkSession, folder: str) -> DataFrame:
    """Every window once, after three batches that each span all the time there is."""
    done = state.stored_rates(spark, _stored_rates(spark, folder), ["event_type"])
    return done.select(
        "event_type", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "requests",
        F.round("rate", 6).alias("rate"), F.round("error_percent", 6).alias("error_percent"),
    )


@query("stream_rates_rewrites", """
WITH hours AS (SELECT DISTINCT coalesce(event_id % 3, 0) AS batch, strftime(ts, '%Y-%m-%dT%H') AS span FROM events),
windows AS (
  SELECT DISTINCT event_type, time_bucket(INTERVAL 5 MINUTE, ts) AS w, coalesce(event_id % 3, 0) AS batch FROM events)
SELECT batch::INTEGER AS batch, span,
       (SELECT count(*) FROM (SELECT DISTINCT event_type, w FROM windows x WHERE strftime(w, '%Y-%m-%dT%H') = span AND x.batch <= hours.batch)) AS rows
FROM hours""")
def stream_rates_rewrites(spark: SparkSession, folder: str) -> DataFrame:
    """The hours each batch rewrote, and how many windows they hold after it."""
    log = spark.read.parquet(f"{_stored_rates(spark, folder)}-log")
    return log.select(F.col("batch").cast("int").alias("batch"), "span", "rows")


@query("stream_vetoes_stored", f"""WITH {_VETO_SQL}
SELECT id AS veto_id, CAST(decision_id AS VARCHAR) AS decision_id FROM stored
WHERE decision_id % 9 <> 0 AND (SELECT max(vetoed_at) FROM stored) > expires_at""")
def stream_vetoes_stored(spark: SparkSession, folder: str) -> DataFrame:
    """Vetoes in three batches out of time order: all that expired are found, in the hours that are due."""
    vetoes = stored_vetoes(spark, folder).select(
        F.col("id").alias("veto_id"), F.col("decision_id").cast("string").alias("decision_id"), "status",
        F.col("vetoed_at").cast("timestamp").alias("event_time"), F.col("expires_at").cast("timestamp").alias("expires_at"),
    )
    path = fresh_path(spark, "vetoes")
    arriving(spark, vetoes, "vetoes-in", F.pmod(F.crc32(F.col("veto_id").cast("string")), F.lit(3)),
             lambda stream, checkpoint: state.store_vetoes(stream, path, checkpoint))
    return state.expired_vetoes(spark, path).select("veto_id", "decision_id")


@query("stream_hash_chain_stored", """WITH RECURSIVE messages AS (
  SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'hot' ELSE 'u' || user_id END AS chain_id,
         '{"id": ' || event_id || ', "type": "' || event_type || '"}' AS body FROM events),
numbered AS (SELECT *, row_number() OVER (PARTITION BY chain_id ORDER BY event_id) AS rn FROM messages),
chained AS (
  SELECT event_id, chain_id, rn, sha256('genesis:' || body) AS event_hash FROM numbered WHERE rn = 1
  UNION ALL
  SELECT n.event_id, n.chain_id, n.rn, sha256(c.event_hash || ':' || n.body)
  FROM chained c JOIN numbered n ON n.chain_id = c.chain_id AND n.rn = c.rn + 1)
SELECT event_id AS sequence, chain_id, rn AS position, event_hash FROM chained""")
def stream_hash_chain_stored(spark: SparkSession, folder: str) -> DataFrame:
    """One chain holds a third of all messages; three micro-batches continue every chain."""
    rows = table(spark, folder, "events").select(
        F.when(F.col("event_id") % 3 == 0, "hot").otherwise(F.concat(F.lit("u"), "user_id")).alias("chain_id"),
        F.col("event_id").alias("sequence"),
        F.concat(F.lit('{"id": '), "event_id", F.lit(', "type": "'), "event_type", F.lit('"}')).alias("value"),
    )
    low, high = rows.approxQuantile("sequence", [0.33, 0.66], 0.01)
    step = F.when(F.col("sequence") < low, 0).when(F.col("sequence") < high, 1).otherwise(2)
    path = fresh_path(spark, "chains")
    arriving(spark, rows, "chains-in", step, lambda stream, checkpoint: store_chain(stream, path, checkpoint))
    return spark.read.parquet(path).select("sequence", "chain_id", "position", "event_hash")
