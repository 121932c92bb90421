"""Stored tables that are updated in place, a few partitions at a time.

A table is Parquet under one folder, cut into partitions by one column: a bucket of the key (``upsert``) or a span of time
(``add_partials``, ``keep_latest``). An update reads the partitions its rows fall into, merges, writes the result to a fresh
folder, and only then replaces these partitions (dynamic partition overwrite). So the cost follows the partitions that are
touched, a failure before the last step changes nothing, and since every merge gives the same result when it
is repeated, a failed update is simply repeated. One writer at a time; readers in between may see some partitions
of an update before others.

The partitions an update touches are the only thing that goes to the driver: as many values as there are buckets, or spans of
time with new rows.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DataType, IntegerType, StringType, StructType

from govspark.session import fresh_path

BUCKETS = 64
#: Partition column of keyed tables, and of tables cut by time.
BUCKET, SPAN = "bucket", "span"


def read_stored(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The table, empty where nothing has been written yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def replace_partitions(rows: DataFrame, path: str, part: str) -> DataFrame:
    """Replace the partitions that ``rows`` fall into; what ``rows`` reads may be the table itself. Returns the staged rows."""
    spark = rows.sparkSession
    staged = fresh_path(spark, "staged")
    # Rows of a partition come together, and AQE cuts a partition that is too large for one task.
    rows.hint("rebalance", part).write.parquet(staged)
    kept = spark.read.schema(rows.schema).parquet(staged)
    kept.write.option("partitionOverwriteMode", "dynamic").partitionBy(part).mode("overwrite").parquet(path)
    return kept


def _values(rows: DataFrame, part: str) -> list:
    return [r[0] for r in rows.select(part).distinct().collect()]


def _with(schema: StructType, part: str, kind: DataType) -> StructType:
    """Schema of the stored table: the partition column stands last."""
    return StructType([f for f in schema.fields if f.name != part]).add(part, kind)


# --- rows by key --------------------------------------------------------------------------------------------------


def bucket_of(keys: list[Column], buckets: int = BUCKETS) -> Column:
    """Bucket of a key, from the MD5 of its parts; null parts count as such."""
    parts = [F.coalesce(F.concat(F.lit("="), k.cast("string")), F.lit("")) for k in keys]
    return F.pmod(F.conv(F.substring(F.md5(F.concat_ws("\x1f", *parts)), 1, 8), 16, 10).cast("long"), F.lit(buckets)).cast("int")


def upsert(path: str, changes: DataFrame, keys: list[str], order: list[str] | None = None, buckets: int = BUCKETS) -> DataFrame:
    """Insert or replace rows by key; returns bucket, inserted, updated, rows of every bucket that was rewritten.

    Of several changes of one key the last by ``order`` counts, without ``order`` any one. A stored row is replaced by a
    change that is later, or as late and different; without ``order`` it stays. Changes without effect touch nothing,
    so a repeated batch rewrites no bucket. ``buckets`` belongs to the table: give the same number every time.
    """
    spark = changes.sparkSession
    schema = _with(changes.schema, BUCKET, IntegerType())
    names = [f.name for f in schema.fields]
    rest = [n for n in names if n not in (*keys, BUCKET)]
    cut = changes.withColumn(BUCKET, bucket_of([F.col(k) for k in keys], buckets)).select(*names)
    if order:
        last = F.max_by(F.struct(*rest), F.struct(*order, F.xxhash64(*rest))).alias("_row")
        single = cut.groupBy(*keys, BUCKET).agg(last).select(*keys, "_row.*", BUCKET).select(*names)
    else:
        single = cut.dropDuplicates(keys)
    arrived = fresh_path(spark, "changes")
    single.write.parquet(arrived)
    single = spark.read.schema(schema).parquet(arrived)
    touched = read_stored(spark, path, schema).where(F.col(BUCKET).isin(_values(single, BUCKET)))

    key = F.struct(*[F.col(k) for k in keys])
    known = touched.select(key.alias("_key"), F.struct(*rest).alias("_stored") if rest else F.lit(True).alias("_stored"))
    compared = single.join(known, key.eqNullSafe(F.col("_key")), "left")
    new = F.col("_key").isNull()
    effect = new
    if order:
        now, before = F.struct(*order), F.struct(*[F.col("_stored")[c] for c in order])
        effect = new | (now > before) | (now.eqNullSafe(before) & ~F.struct(*rest).eqNullSafe(F.col("_stored")))
    effective = fresh_path(spark, "effective")
    compared.where(effect).select(*names, new.alias("_new")).write.parquet(effective)
    changed = spark.read.schema(StructType(schema.fields).add("_new", BooleanType())).parquet(effective)

    report = changed.groupBy(BUCKET).agg(F.count_if("_new").alias("inserted"), F.count_if(~F.col("_new")).alias("updated"))
    rewritten = _values(changed, BUCKET)
    if not rewritten:
        return report.withColumn("rows", F.lit(0).cast("long"))
    replacing = changed.select(key.alias("_key"))
    stays = touched.where(F.col(BUCKET).isin(rewritten)).join(replacing, key.eqNullSafe(F.col("_key")), "left_anti")
    staged = replace_partitions(stays.unionByName(changed.drop("_new")), path, BUCKET)
    return report.join(staged.groupBy(BUCKET).agg(F.count("*").alias("rows")), BUCKET)


def lookup(table: DataFrame, buckets: int = BUCKETS, **key: str | int | None) -> DataFrame:
    """Rows of one whole key of a keyed table; reads one bucket. Name the key in the order of the table's keys."""
    literals = [F.lit(v) for v in key.values()]
    found = table.where(F.col(BUCKET) == bucket_of(literals, buckets))
    for name, value in key.items():
        found = found.where(F.col(name).eqNullSafe(F.lit(value)))
    return found


# --- state by time ------------------------------------------------------------------------------------------------


def span_of(time: Column, pattern: str = "yyyy-MM-dd'T'HH") -> Column:
    """Partition of an instant: its hour (or what ``pattern`` keeps) as text that sorts by time; null for none."""
    return F.coalesce(F.date_format(time, pattern), F.lit("none"))


def add_partials(path: str, partials: DataFrame, batch: int, keys: list[str], sums: list[str], span: Column) -> DataFrame:
    """Add partial sums of one micro-batch to the stored ones; returns span, rows of every partition that was rewritten.

    Every row remembers the micro-batch that changed it last and the sums before that, so a batch that is repeated after a
    failure is added once. A table belongs to one streaming query: its batches are numbered from 0 and come in order.
    """
    spark = partials.sparkSession
    before = [f"before_{s}" for s in sums]
    arriving = partials.select(*keys, *sums, *(F.lit(0).cast("long").alias(b) for b in before), F.lit(batch).cast("long").alias("batch"),
                               span.alias(SPAN), F.lit(True).alias("_arrives"))
    schema = StructType([f for f in arriving.schema.fields if f.name != "_arrives"])
    arrived = fresh_path(spark, "partials")
    arriving.write.parquet(arrived)
    arriving = spark.read.schema(arriving.schema).parquet(arrived)
    touched = read_stored(spark, path, schema).where(F.col(SPAN).isin(_values(arriving, SPAN)))
    again = ~F.col("_arrives") & (F.col("batch") == batch)  # this batch was added before and is repeated
    both = touched.withColumn("_arrives", F.lit(False)).unionByName(arriving)
    base = {s: F.sum(F.when(F.col("_arrives"), 0).when(again, F.col(b)).otherwise(F.col(s))) for s, b in zip(sums, before)}
    added = {s: F.sum(F.when(F.col("_arrives"), F.col(s)).otherwise(0)) for s in sums}
    earlier = {b: F.sum(F.when(F.col("_arrives"), 0).otherwise(F.col(b))) for b in before}
    merged = both.groupBy(*keys, SPAN).agg(
        *(v.alias(f"_base_{k}") for k, v in base.items()), *(v.alias(f"_added_{k}") for k, v in added.items()),
        *(v.alias(f"_earlier_{k}") for k, v in earlier.items()), F.max("batch").alias("batch"),
    )
    current = F.col("batch") == batch
    result = merged.select(
        *keys, *((F.col(f"_base_{s}") + F.col(f"_added_{s}")).alias(s) for s in sums),
        *(F.when(current, F.col(f"_base_{s}")).otherwise(F.col(f"_earlier_{b}")).alias(b) for s, b in zip(sums, before)),
        "batch", SPAN,
    )
    return replace_partitions(result, path, SPAN).groupBy(SPAN).agg(F.count("*").alias("rows"))


def keep_latest(path: str, rows: DataFrame, keys: list[str], order: str, span: Column) -> DataFrame:
    """Keep the latest row of each key within its span; returns span, rows of every partition that was rewritten.

    ``span`` must be the same for all rows of a key. Rows of one key and instant are told apart by their values.
    """
    spark = rows.sparkSession
    arriving = rows.withColumn(SPAN, span)
    schema = _with(arriving.schema, SPAN, StringType())
    names = [f.name for f in schema.fields]
    rest = [n for n in names if n not in (*keys, SPAN)]
    arrived = fresh_path(spark, "rows")
    arriving.select(*names).write.parquet(arrived)
    arriving = spark.read.schema(schema).parquet(arrived)
    touched = read_stored(spark, path, schema).where(F.col(SPAN).isin(_values(arriving, SPAN)))
    latest = F.max_by(F.struct(*rest), F.struct(order, F.xxhash64(*rest))).alias("_row")
    merged = touched.unionByName(arriving).groupBy(*keys, SPAN).agg(latest).select(*keys, "_row.*", SPAN).select(*names)
    return replace_partitions(merged, path, SPAN).groupBy(SPAN).agg(F.count("*").alias("rows"))
