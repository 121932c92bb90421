"""Expectation suites: every single-pass check of a suite in one scan, one more pass per uniqueness key.

Null rule: value checks skip nulls, the not-null check counts them, pair equality is null-safe. A check over
a column that does not exist fails; an empty table passes the value checks.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

# The directives of the C library's time format and Spark's letters for them.
STRFTIME = {
    "%Y": "yyyy", "%y": "yy", "%m": "MM", "%d": "dd", "%H": "HH", "%I": "hh", "%M": "mm", "%S": "ss",
    "%f": "SSSSSS", "%j": "DDD", "%b": "MMM", "%B": "MMMM", "%p": "a", "%z": "xx", "%%": "%",
}

# One name per family of Spark types, so that contracts and suites need not know widths.
TYPE_FAMILIES = {
    "string": "string", "varchar": "string", "char": "string",
    "tinyint": "integer", "smallint": "integer", "int": "integer", "bigint": "integer",
    "float": "float", "double": "float", "decimal": "float",
    "boolean": "boolean", "date": "date", "timestamp": "timestamp", "timestamp_ntz": "timestamp",
}
CAST_TARGETS = {"integer": "bigint", "float": "double", "boolean": "boolean", "date": "date",
                "timestamp": "timestamp"}


# Text forms of the families whose failed casts are costly (a caught exception per row), tested by pattern first.
_TEXT_FORMS = {
    "integer": r"^\s*[+-]?\d+\s*$",
    "float": r"(?i)^\s*[+-]?(\d+\.?\d*(e[+-]?\d+)?|\.\d+(e[+-]?\d+)?|nan|inf|infinity)\s*$",
    "boolean": r"(?i)^\s*(t|true|y|yes|1|f|false|n|no|0)\s*$",
}


def read_as(value: Column, family: str) -> Column:
    """Text read as a type family, null where it cannot be read."""
    cast = value.try_cast(CAST_TARGETS[family])
    return F.when(value.rlike(_TEXT_FORMS[family]), cast) if family in _TEXT_FORMS else cast


def type_family(spark_type: str) -> str:
    base = spark_type.split("(")[0].lower()
    return TYPE_FAMILIES.get(base, base)


def spark_time_pattern(strftime_format: str) -> str:
    """Spark date pattern for a strftime format; literal letters are quoted."""
    out = []
    for piece in re.findall(r"%.|[^%]+|%$", strftime_format):
        if piece.startswith("%"):
            if piece not in STRFTIME:
                raise ValueError(f"no Spark pattern for {piece!r} in {strftime_format!r}")
            out.append(STRFTIME[piece])
        else:
            out.append(re.sub(r"[A-Za-z]+", lambda m: f"'{m.group()}'", piece.replace("'", "''")))
    return "".join(out)


@dataclass(frozen=True)
class Expectation:
    kind: str
    kwargs: Mapping[str, Any] = field(default_factory=dict)

    @staticmethod
    def of(record: Mapping[str, Any]) -> Expectation:
        return Expectation(record.get("expectation_type", ""), record.get("kwargs") or {})


@dataclass(frozen=True)
class Kind:
    """How to evaluate one expectation type.

    ``needs`` lists the columns it reads. A single-pass kind gives ``observe`` (an aggregate); a uniqueness
    kind leaves it empty and the columns are the key. ``judge`` turns the observed value into success.
    """

    dimension: str
    needs: Callable[[Mapping[str, Any]], list[str]]
    observe: Callable[[Mapping[str, Any], StructType], Column] | None
    judge: Callable[[Column, Mapping[str, Any]], Column]


def _one(kwargs: Mapping[str, Any]) -> list[str]:
    return [kwargs["column"]]


def _within(value: Column, kwargs: Mapping[str, Any]) -> Column:
    test = F.lit(True)
    if kwargs.get("min_value") is not None:
        test = test & (value >= F.lit(kwargs["min_value"]))
    if kwargs.get("max_value") is not None:
        test = test & (value <= F.lit(kwargs["max_value"]))
    return test


def _violations(test: Column) -> Column:
    """Number of rows where the test is false (nulls are skipped)."""
    return F.count_if(~test)


def _none_violate(observed: Column, _: Mapping[str, Any]) -> Column:
    return observed == 0


def _in_set(kwargs: Mapping[str, Any], _: StructType) -> Column:
    return _violations(F.col(kwargs["column"]).isin(*kwargs["value_set"]))


def _of_type(kwargs: Mapping[str, Any], schema: StructType) -> Column:
    column, wanted = kwargs["column"], type_family(kwargs["type_"])
    actual = schema[column].dataType
    if type_family(actual.simpleString()) == wanted:
        return F.count_if(F.lit(False))
    if isinstance(actual, StringType) and wanted in CAST_TARGETS:
        value = F.col(column)
        return F.count_if(value.isNotNull() & read_as(value, wanted).isNull())
    return F.count(F.col(column))


def _strftime(kwargs: Mapping[str, Any], schema: StructType) -> Column:
    column = kwargs["column"]
    if not isinstance(schema[column].dataType, StringType):
        typed = type_family(schema[column].dataType.simpleString()) in ("timestamp", "date")
        return F.count_if(F.lit(False)) if typed else F.count(F.col(column))
    pattern = F.lit(spark_time_pattern(kwargs["strftime_format"]))
    return F.count_if(F.col(column).isNotNull() & F.try_to_timestamp(F.col(column), pattern).isNull())


KINDS: dict[str, Kind] = {
    "expect_table_row_count_to_be_between": Kind(
        "completeness", lambda k: [], lambda k, s: F.count(F.lit(1)), _within
    ),
    "expect_column_values_to_not_be_null": Kind(
        "completeness", _one, lambda k, s: F.count_if(F.col(k["column"]).isNull()), _none_violate
    ),
    "expect_column_values_to_be_between": Kind(
        "accuracy", _one, lambda k, s: _violations(_within(F.col(k["column"]), k)), _none_violate
    ),
    "expect_column_mean_to_be_between": Kind(
        "accuracy", _one, lambda k, s: F.avg(k["column"]), lambda o, k: F.coalesce(_within(o, k), F.lit(True))
    ),
    "expect_column_values_to_match_regex": Kind(
        "validity", _one, lambda k, s: _violations(F.col(k["column"]).rlike(k["regex"])), _none_violate
    ),
    "expect_column_values_to_be_in_set": Kind("validity", _one, _in_set, _none_violate),
    "expect_column_values_to_be_of_type": Kind("validity", _one, _of_type, _none_violate),
    "expect_column_values_to_be_unique": Kind("uniqueness", _one, None, _none_violate),
    "expect_compound_columns_to_be_unique": Kind(
        "uniqueness", lambda k: list(k["column_list"]), None, _none_violate
    ),
    "expect_column_pair_values_to_be_equal": Kind(
        "consistency",
        lambda k: [k["column_A"], k["column_B"]],
        lambda k, s: F.count_if(~F.col(k["column_A"]).eqNullSafe(F.col(k["column_B"]))),
        _none_violate,
    ),
    "expect_column_values_to_match_strftime_format": Kind("timeliness", _one, _strftime, _none_violate),
}

RESULT_COLUMNS = ("position", "expectation_type", "target", "observed", "success")


def evaluate_suite(df: DataFrame, suite: list[Expectation], kinds: Mapping[str, Kind] = KINDS) -> DataFrame:
    """One row per expectation: position, type, target columns, observed value, success.

    Nothing is collected: the fused aggregate yields one row, which is exploded into the results.
    """
    fixed, fused, keyed = [], [], {}
    for position, item in enumerate(suite):
        kind = kinds.get(item.kind)
        needed = kind.needs(item.kwargs) if kind else []
        if kind is None or any(name not in df.columns for name in needed):
            fixed.append(_result(position, item, needed, F.lit(None), F.lit(kind is None and None)))
        elif kind.observe is None:
            keyed.setdefault(tuple(needed), []).append((position, item, kind))
        else:
            fused.append((position, item, kind, needed))

    parts = []
    if fused or fixed or not suite:
        aggregates = [
            kind.observe(item.kwargs, df.schema).cast("double").alias(f"o{position}")
            for position, item, kind, _ in fused
        ] or [F.lit(1).alias("o")]
        checks = fixed + [
            _result(position, item, needed, F.col(f"o{position}"), kind.judge(F.col(f"o{position}"), item.kwargs))
            for position, item, kind, needed in fused
        ]
        row = df.agg(*aggregates) if fused else df.sparkSession.range(1)
        parts.append(_spread(row, checks))
    for key, items in keyed.items():
        row = df.transform(repeated_rows, list(key))
        checks = [
            _result(position, item, list(key), F.col("repeated"), kind.judge(F.col("repeated"), item.kwargs))
            for position, item, kind in items
        ]
        parts.append(_spread(row, checks))
    return reduce(DataFrame.unionByName, parts)


def repeated_rows(df: DataFrame, key: list[str]) -> DataFrame:
    """One row: how many rows share their key with another row (null keys are skipped).

    Partial aggregation runs before the shuffle, so a hot key costs one row per map task.
    """
    complete = reduce(Column.__and__, [F.col(c).isNotNull() for c in key])
    sizes = df.where(complete).groupBy(*key).agg(F.count("*").alias("size"))
    repeated = F.sum(F.when(F.col("size") > 1, F.col("size")))
    return sizes.agg(F.coalesce(repeated, F.lit(0)).cast("double").alias("repeated"))


def _result(position: int, item: Expectation, target: list[str], observed: Column, success: Column) -> Column:
    return F.struct(
        F.lit(position).alias("position"),
        F.lit(item.kind).alias("expectation_type"),
        F.lit(",".join(target)).alias("target"),
        observed.cast("double").alias("observed"),
        success.cast("boolean").alias("success"),
    )


def _spread(row: DataFrame, checks: list[Column]) -> DataFrame:
    empty = "array<struct<position:int,expectation_type:string,target:string,observed:double,success:boolean>>"
    items = F.array(*checks) if checks else F.array().cast(empty)
    return row.select(F.explode(items).alias("r")).select("r.*")


def broken_values(df: DataFrame, column: str, allowed: DataFrame) -> DataFrame:
    """Rows whose value is not in a (large) allowed table; nulls are skipped.

    No broadcast hint: Spark compares the size of ``allowed`` with its threshold and shuffles otherwise.
    """
    values = allowed.select(F.col(allowed.columns[0]).alias("_allowed")).distinct()
    return df.where(F.col(column).isNotNull()).join(values, F.col(column) == F.col("_allowed"), "left_anti")
