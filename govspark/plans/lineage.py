"""Lineage events derived from parts and orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from govspark.functions.urns import DEFAULT_PLATFORM
from govspark.operators import lineage as ln
from govspark.operators.reach import reachable
from govspark.plans.registry import query, table
from govspark.session import fresh_path


def _dataset(namespace: Column, name: Column) -> Column:
    return F.struct(namespace.alias("namespace"), name.alias("name"))


def run_events(spark: SparkSession, folder: str) -> DataFrame:
    """One run per part: brand and type feed the part's dataset, every third part also its size mart.

    Namespaces are absent for brands, names for parts of size 1, to exercise the defaults.
    """
    nothing = F.lit(None).cast("string")
    inputs = F.array(
        _dataset(nothing, F.col("p_brand")),
        _dataset(F.lit("raw"), F.when(F.col("p_size") > 1, F.col("p_type"))),
    )
    item = _dataset(F.lit("mart"), F.concat(F.lit("part_"), "p_partkey"))
    mart = _dataset(F.lit("mart"), F.concat(F.lit("size_"), "p_size"))
    return table(spark, folder, "part").select(
        F.lit("COMPLETE").alias("event_type"),
        F.create_map(F.lit("runId"), F.concat(F.lit("run-"), "p_partkey")).alias("run"),
        F.struct(F.when(F.col("p_size") != 2, F.concat(F.lit("load_"), "p_brand")).alias("name")).alias("job"),
        inputs.alias("inputs"),
        F.when(F.col("p_partkey") % 3 == 0, F.array(item, mart)).otherwise(F.array(item)).alias("outputs"),
    )


def _urn(namespace: str, name: str) -> str:
    return f"'urn:li:dataset:(urn:li:dataPlatform:' || {namespace} || ',' || {name} || ',PROD)'"


EVENTS_SQL = f"""runs AS (
  SELECT p_partkey, [{_urn(f"'{DEFAULT_PLATFORM}'", "p_brand")},
          {_urn("'raw'", "CASE WHEN p_size > 1 THEN p_type ELSE 'unknown' END")}] AS inputs,
         CASE WHEN p_partkey % 3 = 0 THEN [{_urn("'mart'", "'part_' || p_partkey")}, {_urn("'mart'", "'size_' || p_size")}]
              ELSE [{_urn("'mart'", "'part_' || p_partkey")}] END AS outputs,
         'urn:li:dataJob:(urn:li:dataFlow:({DEFAULT_PLATFORM},' || job || ',PROD),' || job || ')' AS job_urn
  FROM (SELECT *, CASE WHEN p_size <> 2 THEN 'load_' || p_brand ELSE 'unknown' END AS job FROM part)),
edges AS (
  SELECT i AS source_urn, unnest(outputs) AS target_urn, 'TRANSFORMED' AS edge_type, job_urn
  FROM (SELECT unnest(inputs) AS i, outputs, job_urn FROM runs))"""


@query("lineage_edges", f"WITH {EVENTS_SQL} SELECT * FROM edges")
def lineage_edges(spark: SparkSession, folder: str) -> DataFrame:
    return ln.lineage_edges(run_events(spark, folder))


@query("lineage_job_io", f"""WITH {EVENTS_SQL}
SELECT job_urn, '{{"entityType":"dataJob","entityUrn":"' || job_urn
  || '","aspectName":"dataJobInputOutput","aspect":{{"inputDatasets":["' || array_to_string(inputs, '","')
  || '"],"outputDatasets":["' || array_to_string(outputs, '","') || '"]}},"changeType":"UPSERT"}}' AS record
FROM runs""")
def lineage_job_io(spark: SparkSession, folder: str) -> DataFrame:
    return ln.job_records(run_events(spark, folder))


@query("lineage_events", f"""
SELECT kind AS event_type, md5('run-' || p_partkey) AS run_id, '2024-01-01 00:0' || step || ':00' AS event_time,
       '{DEFAULT_PLATFORM}' AS job_namespace, CASE WHEN p_size <> 2 THEN 'load_' || p_brand END AS job_name,
       CAST(2 AS INTEGER) AS inputs, CAST(CASE WHEN p_partkey % 3 = 0 THEN 2 ELSE 1 END AS INTEGER) AS outputs,
       '{DEFAULT_PLATFORM}' AS producer
FROM part, (VALUES ('START', 0), ('COMPLETE', 1)) AS kinds(kind, step)""")
def lineage_events(spark: SparkSession, folder: str) -> DataFrame:
    """Start and completion of one job per part, appended to the event table and read back; one append is repeated."""
    path = fresh_path(spark, "run-events")
    jobs = run_events(spark, folder).select(
        F.col("job.name").alias("job_name"), "inputs", "outputs", F.md5(F.col("run")["runId"]).alias("run_id")
    )
    for kind, time in (("START", "2024-01-01 00:00:00"), ("COMPLETE", "2024-01-01 00:01:00"), ("COMPLETE", "2024-01-01 00:01:00")):
        emitted = ln.run_events(jobs, event_type=kind, run_id=F.col("run_id"), event_time=F.lit(time).cast("timestamp"))
        ln.emit_events(emitted, path)
    return ln.read_events(spark, path).select(
        "event_type", F.col("run")["runId"].alias("run_id"), F.date_format("event_time", "yyyy-MM-dd HH:mm:ss").alias("event_time"), F.col("job.namespace").alias("job_namespace"),
        F.col("job.name").alias("job_name"), F.size("inputs").alias("inputs"), F.size("outputs").alias("outputs"),
        "producer",
    )


@query("lineage_upsert", f"""WITH {EVENTS_SQL}
SELECT DISTINCT source_urn, target_urn, job_urn FROM edges""")
def lineage_upsert(spark: SparkSession, folder: str) -> DataFrame:
    """The same edges arrive twice."""
    edges = ln.lineage_edges(run_events(spark, folder))
    return ln.merge_edges(edges, edges).select("source_urn", "target_urn", "job_urn")


_MART = "urn:li:dataset:(urn:li:dataPlatform:mart,size_7,PROD)"
_JOB = f"urn:li:dataJob:(urn:li:dataFlow:({DEFAULT_PLATFORM},unknown,PROD),unknown)"
_RAW = "urn:li:dataset:(urn:li:dataPlatform:raw,unknown,PROD)"


@query("lineage_lookup", f"""WITH {EVENTS_SQL}
SELECT 'source' AS known, source_urn, target_urn, job_urn FROM edges WHERE source_urn = '{_RAW}'
UNION ALL SELECT 'target', source_urn, target_urn, job_urn FROM edges WHERE target_urn = '{_MART}'
UNION ALL SELECT 'job', source_urn, target_urn, job_urn FROM edges WHERE job_urn = '{_JOB}'""")
def lineage_lookup(spark: SparkSession, folder: str) -> DataFrame:
    """Edges by source, by target and by job."""
    edges = ln.lineage_edges(run_events(spark, folder)).select("source_urn", "target_urn", "job_urn")
    found = [ln.edges_by(edges, **{kind: urn}).select(F.lit(kind).alias("known"), "*")
             for kind, urn in (("source", _RAW), ("target", _MART), ("job", _JOB))]
    return found[0].unionByName(found[1]).unionByName(found[2])


@query("lineage_neighbours", f"""WITH {EVENTS_SQL},
up AS (SELECT target_urn AS urn, count(DISTINCT source_urn) AS sources FROM edges GROUP BY 1),
down AS (SELECT source_urn AS urn, count(DISTINCT target_urn) AS targets FROM edges GROUP BY 1)
SELECT coalesce(up.urn, down.urn) AS urn, coalesce(sources, 0) AS sources, coalesce(targets, 0) AS targets
FROM up FULL OUTER JOIN down ON up.urn = down.urn""")
def lineage_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return ln.neighbours(ln.lineage_edges(run_events(spark, folder)))


def order_edges(spark: SparkSession, folder: str) -> DataFrame:
    """region -> nation -> customer -> order."""

    def named(kind: str, key: str) -> Column:
        return F.concat(F.lit(f"{kind}:"), key)

    nations = table(spark, folder, "nation").select(
        named("region", "n_regionkey").alias("source_urn"), named("nation", "n_nationkey").alias("target_urn")
    )
    customers = table(spark, folder, "customer").select(
        named("nation", "c_nationkey").alias("source_urn"), named("customer", "c_custkey").alias("target_urn")
    )
    orders = table(spark, folder, "orders").select(
        named("customer", "o_custkey").alias("source_urn"), named("order", "o_orderkey").alias("target_urn")
    )
    return nations.unionByName(customers).unionByName(orders)


@query("lineage_reach", """WITH RECURSIVE edges AS (
  SELECT 'region:' || n_regionkey AS s, 'nation:' || n_nationkey AS t FROM nation
  UNION ALL SELECT 'nation:' || c_nationkey, 'customer:' || c_custkey FROM customer
  UNION ALL SELECT 'customer:' || o_custkey, 'order:' || o_orderkey FROM orders),
reach AS (
  SELECT t AS urn, s AS ancestor, 1 AS depth FROM edges
  UNION SELECT r.urn, e.s, r.depth + 1 FROM reach r JOIN edges e ON e.t = r.ancestor)
SELECT urn, ancestor, CAST(min(depth) AS INTEGER) AS depth FROM reach GROUP BY 1, 2""")
def lineage_reach(spark: SparkSession, folder: str) -> DataFrame:
    return ln.ancestors(order_edges(spark, folder))


@query("lineage_reach_of", """WITH RECURSIVE edges AS (
  SELECT 'region:' || n_regionkey AS s, 'nation:' || n_nationkey AS t FROM nation
  UNION ALL SELECT 'nation:' || c_nationkey, 'customer:' || c_custkey FROM customer
  UNION ALL SELECT 'customer:' || o_custkey, 'order:' || o_orderkey FROM orders),
reach AS (
  SELECT t AS urn, s AS ancestor, 1 AS depth FROM edges
  WHERE t IN (SELECT 'order:' || o_orderkey FROM orders WHERE o_orderkey % 100 = 0)
  UNION SELECT r.urn, e.s, r.depth + 1 FROM reach r JOIN edges e ON e.t = r.ancestor)
SELECT urn, ancestor, CAST(min(depth) AS INTEGER) AS depth FROM reach GROUP BY 1, 2""")
def lineage_reach_of(spark: SparkSession, folder: str) -> DataFrame:
    """Searched for: every order whose key is divisible by 100, against all edges."""
    asked = table(spark, folder, "orders").where("o_orderkey % 100 = 0").select(
        F.concat(F.lit("order:"), "o_orderkey").alias("urn")
    )
    return ln.ancestors(order_edges(spark, folder), asked)


# Every seventh nation feeds its region back, so that regions and these nations form cycles.
_CYCLIC_SQL = """WITH RECURSIVE edges AS (
  SELECT 'region:' || n_regionkey AS s, 'nation:' || n_nationkey AS t FROM nation
  UNION ALL SELECT 'nation:' || n_nationkey, 'region:' || n_regionkey FROM nation WHERE n_nationkey % 7 = 0
  UNION ALL SELECT 'nation:' || c_nationkey, 'customer:' || c_custkey FROM customer
  UNION ALL SELECT 'customer:' || o_custkey, 'order:' || o_orderkey FROM orders),
asked AS (
  SELECT DISTINCT above, 'order:' || o_orderkey AS below FROM orders, (
    SELECT 'region:' || r_regionkey AS above FROM region UNION ALL SELECT 'nation:' || n_nationkey FROM nation WHERE n_nationkey < 6)
  WHERE o_orderkey % 100 = 0
  UNION SELECT 'nation:' || n_nationkey, 'region:' || r_regionkey FROM nation, region),
reach AS (
  SELECT DISTINCT below AS urn, s AS ancestor FROM asked JOIN edges ON t = below
  UNION SELECT r.urn, e.s FROM reach r JOIN edges e ON e.t = r.ancestor)"""


@query("lineage_reachable", f"""{_CYCLIC_SQL}
SELECT above, below, EXISTS (SELECT 1 FROM reach WHERE urn = below AND ancestor = above) AS reachable FROM asked""")
def lineage_reachable(spark: SparkSession, folder: str) -> DataFrame:
    """Whether regions and some nations are above every hundredth order, and nations above regions."""
    nations, orders = table(spark, folder, "nation"), table(spark, folder, "orders")
    name = lambda kind, key: F.concat(F.lit(f"{kind}:"), key)
    back = nations.where("n_nationkey % 7 = 0").select(name("nation", "n_nationkey").alias("source_urn"), name("region", "n_regionkey").alias("target_urn"))
    regions = table(spark, folder, "region").select(name("region", "r_regionkey").alias("above"))
    # Regions and six nations, a fixed few, are spread over the orders asked for.
    few = [f"region:{i}" for i in range(5)] + [f"nation:{i}" for i in range(6)]
    low = orders.where("o_orderkey % 100 = 0").select(F.explode(F.array(*map(F.lit, few))).alias("above"), name("order", "o_orderkey").alias("below"))
    high = nations.select(name("nation", "n_nationkey").alias("above"), F.explode(F.array(*map(F.lit, few[:5]))).alias("below"))
    asked = low.join(regions.unionByName(nations.where("n_nationkey < 6").select(name("nation", "n_nationkey").alias("above"))), "above", "left_semi")
    return reachable(order_edges(spark, folder).unionByName(back), asked.unionByName(high))
