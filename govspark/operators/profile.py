"""Column profiles and type inference."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from govspark.operators.expectations import read_as, type_family


def profile_table(df: DataFrame, exact: bool = False) -> DataFrame:
    """One row per column: rows, null share, distinct values, completeness, uniqueness, consistency, extremes, mean.

    Consistency is the share of values of the column's most frequent kind (number, boolean, time, other text), 1.0
    for typed columns. The sketch form reads the table once. The exact form adds one pre-aggregated pass over (column, value).
    """
    aggregates = [F.count(F.lit(1)).alias("rows")]
    shapes = []
    for i, field in enumerate(df.schema.fields):
        value = F.col(f"`{field.name}`")
        numeric = type_family(field.dataType.simpleString()) in ("integer", "float")
        aggregates += [
            F.count(value).alias(f"n{i}"),
            F.min(value).cast("string").alias(f"lo{i}"),
            F.max(value).cast("string").alias(f"hi{i}"),
            (F.avg(value) if numeric else F.lit(None).cast("double")).alias(f"mean{i}"),
            (F.stddev(value) if numeric else F.lit(None).cast("double")).alias(f"dev{i}"),
        ]
        kinds = [F.lit(0)]
        if field.dataType == StringType():
            kind = _kind(value)
            kinds = [F.col(f"kind{i}_{k}") for k in _KINDS]
            aggregates += [F.count_if(kind == k).alias(f"kind{i}_{k}") for k in _KINDS]
        if not exact:
            aggregates.append(F.approx_count_distinct(value).alias(f"d{i}"))
        shapes.append(
            F.struct(
                F.lit(field.name).alias("column"),
                F.col("rows"),
                F.col(f"n{i}").alias("non_null"),
                F.col(f"lo{i}").alias("minimum"),
                F.col(f"hi{i}").alias("maximum"),
                F.col(f"mean{i}").alias("mean"),
                F.col(f"dev{i}").alias("deviation"),
                (F.greatest(*kinds) if len(kinds) > 1 else F.col(f"n{i}")).alias("majority"),
                (F.lit(None).cast("bigint") if exact else F.col(f"d{i}")).alias("distinct_values"),
            )
        )
    spread = df.agg(*aggregates).select(F.explode(F.array(*shapes)).alias("p")).select("p.*")
    if exact:
        spread = spread.drop("distinct_values").join(distinct_counts(df), "column", "left").fillna(
            0, ["distinct_values"]
        )
    share = F.col("non_null") / F.col("rows")
    unique = F.when(F.col("non_null") > 0, F.col("distinct_values") / F.col("non_null")).otherwise(F.lit(0.0))
    null_share = F.lit(1.0) - share
    return (
        spread.withColumn("completeness", share)
        .withColumn("null_share", null_share)
        .withColumn("above_five_percent_null", (F.col("rows") - F.col("non_null")) * 20 > F.col("rows"))
        .withColumn("uniqueness", F.least(unique, F.lit(1.0)))
        .withColumn("consistency", F.when(F.col("non_null") > 0, F.col("majority") / F.col("non_null")).otherwise(1.0))
        .drop("majority")
    )


_KINDS = ("number", "boolean", "time", "text")


def _kind(value: Column) -> Column:
    """Narrowest kind a text can be read as; null for null."""
    return (
        F.when(value.isNull(), F.lit(None))
        .when(read_as(value, "float").isNotNull(), "number")
        .when(read_as(value, "boolean").isNotNull(), "boolean")
        .when(read_as(value, "timestamp").isNotNull(), "time")
        .otherwise("text")
    )


def profile_summary(profile: DataFrame) -> DataFrame:
    """One row for the table: rows, columns, columns above five percent null, and the mean of each measure."""
    return profile.agg(
        F.coalesce(F.max("rows"), F.lit(0)).alias("rows"),
        F.count("*").alias("columns"),
        F.count_if("above_five_percent_null").alias("columns_above_five_percent_null"),
        *[F.avg(m).alias(m) for m in ("completeness", "uniqueness", "consistency")],
    )


def distinct_counts(df: DataFrame) -> DataFrame:
    """Exact distinct values per column from one pass: (column, value) pairs are combined before the shuffle."""
    cells = F.explode(
        F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("v")) for c in df.columns])
    )
    pairs = df.select(cells.alias("c")).select("c.*").where("v IS NOT NULL").distinct()
    return pairs.groupBy("column").agg(F.count("*").alias("distinct_values"))


#: Standard error of the sketches, and how many of them a key's sketch may lie below the number of rows.
SKETCH_ERROR, SKETCH_REACH = 0.02, 6


def likely_keys(df: DataFrame, columns: list[str]) -> list[str]:
    """Columns without a null whose distinct values may be as many as the rows, by one scan with a sketch per column."""
    found = [F.count(F.lit(1)).alias("rows")]
    for i, name in enumerate(columns):
        value = F.col(f"`{name}`")
        found += [F.count(value).alias(f"n{i}"), F.approx_count_distinct(value, SKETCH_ERROR).alias(f"d{i}")]
    row = df.agg(*found).first()
    least = row["rows"] * (1 - SKETCH_REACH * SKETCH_ERROR)
    return [c for i, c in enumerate(columns) if row["rows"] and row[f"n{i}"] == row["rows"] and row[f"d{i}"] >= least]


def key_candidates(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, rows, distinct_values, key_candidate: whether a column holds another value in every row.

    Only the values of ``likely_keys`` are counted exactly, which takes a shuffle; for others distinct_values is null. The sketches
    are read when the function is called.
    """
    likely = likely_keys(df, columns)
    named = [F.struct(F.lit(c).alias("column"), F.col("rows")) for c in columns]
    rows = df.agg(F.count(F.lit(1)).alias("rows")).select(F.explode(F.array(*named)).alias("t")).select("t.*")
    if not likely:
        return rows.select("*", F.lit(None).cast("long").alias("distinct_values"), F.lit(False).alias("key_candidate"))
    counted = rows.join(distinct_counts(df.select(*[f"`{c}`" for c in likely])), "column", "left")
    return counted.withColumn("key_candidate", F.coalesce(F.col("distinct_values") == F.col("rows"), F.lit(False)))


def infer_types(df: DataFrame, columns: list[str], exact: bool = True) -> DataFrame:
    """Narrowest type of each text column (integer, float, boolean, timestamp, text) and key candidates.

    With ``exact`` every column's distinct values are counted, a shuffle of every cell; without, those of the likely keys alone
    (see ``key_candidates``), and distinct_values is null for the others.
    """
    order = ("integer", "float", "boolean", "timestamp")
    aggregates = [F.count(F.lit(1)).alias("rows")]
    shapes = []
    for i, name in enumerate(columns):
        value = F.col(f"`{name}`")
        aggregates.append(F.count(value).alias(f"n{i}"))
        for kind in order:
            aggregates.append(F.count(read_as(value, kind)).alias(f"{kind}{i}"))
        shapes.append(
            F.struct(
                F.lit(name).alias("column"),
                F.col("rows"),
                F.col(f"n{i}").alias("non_null"),
                _narrowest(F.col(f"n{i}"), [(k, F.col(f"{k}{i}")) for k in order]).alias("inferred_type"),
            )
        )
    spread = df.agg(*aggregates).select(F.explode(F.array(*shapes)).alias("t")).select("t.*")
    if not exact:
        return spread.join(key_candidates(df, columns).drop("rows"), "column")
    distinct = distinct_counts(df.select(*columns))
    joined = spread.join(distinct, "column", "left").fillna(0, ["distinct_values"])
    is_key = (F.col("rows") > 0) & (F.col("distinct_values") == F.col("rows"))
    return joined.withColumn("key_candidate", is_key)


def _narrowest(non_null: Column, successes: list[tuple[str, Column]]) -> Column:
    chain = F.when(non_null == 0, "text")
    for kind, count in successes:
        chain = chain.when(count == non_null, kind)
    return chain.otherwise("text")
