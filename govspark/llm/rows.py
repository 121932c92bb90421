"""Keeping single rows of a table, known by their id and a hash of their text.

Ids may repeat or be null, and tables need not have a row number that is the same whenever they are read. A row is told from
others by id and the 64-bit hash of its text, both computed from its content; rows that agree in both are the same document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from govspark.llm.streams import unused_name
from govspark.session import fresh_path


def mark_of(text: Column) -> Column:
    """Hash of a text; null has one of its own."""
    return F.xxhash64(text)


def keep_rows(docs: DataFrame, kept: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row of ``docs`` for every row of ``kept`` (``_id``, ``_mark``, ``_n``: how many rows of ``docs`` agree in both).

    Only rows that repeat are compared with each other; which of them stays is not told by their other columns.
    """
    spark = docs.sparkSession
    path = fresh_path(spark, "kept")
    kept.select("_id", "_mark", "_n").write.parquet(path)
    stored = spark.read.parquet(path)
    mark = unused_name(docs.columns, "_mark")
    marked = docs.withColumn(mark, mark_of(F.col(text)))
    same = marked[mark].eqNullSafe(stored["_mark"]) & marked[doc_id].cast("long").eqNullSafe(stored["_id"])
    rows = marked.join(stored.where("_n = 1"), same, "left_semi").drop(mark)
    if stored.where("_n > 1").isEmpty():
        return rows
    repeated = marked.join(stored.where("_n > 1"), same, "left_semi")
    key = unused_name(docs.columns, "_key")
    single = repeated.withColumn(key, F.struct(F.col(doc_id).cast("long"), mark)).dropDuplicates([key]).drop(key, mark)
    return rows.unionByName(single)
