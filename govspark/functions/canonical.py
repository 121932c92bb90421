"""Canonical JSON text for digests: sorted keys, ASCII only, the same bytes in every language."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def _escape_unit(unit: Column) -> Column:
    return F.concat(F.lit("\\u"), F.lower(F.lpad(F.hex(unit), 4, "0")))


def _escape_character(char: Column) -> Column:
    code = F.ascii(char)
    above = code - F.lit(0x10000)
    pair = F.concat(
        _escape_unit((F.lit(0xD800) + F.shiftright(above, 10)).cast("long")),
        _escape_unit((F.lit(0xDC00) + above.bitwiseAND(F.lit(0x3FF))).cast("long")),
    )
    return (
        F.when(char == "\n", F.lit("\\n"))
        .when(char == "\r", F.lit("\\r"))
        .when(char == "\t", F.lit("\\t"))
        .when(char == "\b", F.lit("\\b"))
        .when(char == "\f", F.lit("\\f"))
        .when(code > 0xFFFF, pair)
        .when((code < 0x20) | (code > 0x7E), _escape_unit(code.cast("long")))
        .otherwise(char)
    )


def quoted(value: Column) -> Column:
    """JSON string literal in which other characters than quotes and backslashes are still to be escaped."""
    slashes = F.replace(value, F.lit("\\"), F.lit("\\\\"))
    return F.concat(F.lit('"'), F.replace(slashes, F.lit('"'), F.lit('\\"')), F.lit('"'))


def ascii_json(text: Column) -> Column:
    """Escape everything outside printable ASCII in JSON text without blanks outside its strings.

    Such characters only occur inside strings, so one pass over the whole text does; plain text skips it.
    """
    escaped = F.array_join(F.transform(F.split(text, ""), _escape_character), "")
    return F.when(text.rlike(r"^[ -~]*\z"), text).otherwise(escaped)


def json_string(value: Column) -> Column:
    return ascii_json(quoted(value))


def quoted_map(value: Column) -> Column:
    """JSON object of a ``map<string,string>`` with sorted keys; null values become ``null``. See ``quoted``."""
    entries = F.transform(
        F.array_sort(F.map_keys(value)),
        lambda key: F.concat(quoted(key), F.lit(":"), F.coalesce(quoted(F.element_at(value, key)), F.lit("null"))),
    )
    return F.concat(F.lit("{"), F.array_join(entries, ","), F.lit("}"))


def iso_timestamp(value: Column) -> Column:
    """ISO-8601 text in UTC: ``+00:00``, and a fraction only when the microseconds are not zero."""
    micros = F.date_format(value, "SSSSSS")
    fraction = F.when(micros == "000000", F.lit("")).otherwise(F.concat(F.lit("."), micros))
    return F.concat(F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss"), fraction, F.lit("+00:00"))


def _recode(text: str, separators: tuple[str, str]) -> str:
    return json.dumps(json.loads(text), sort_keys=True, separators=separators)


@F.pandas_udf(StringType())
def canonical_json(texts: pd.Series) -> pd.Series:
    """Recode JSON text of unknown origin (numbers, nesting) without blanks."""
    return texts.map(lambda text: _recode(text, (",", ":")), na_action="ignore")


@F.pandas_udf(StringType())
def spaced_json(texts: pd.Series) -> pd.Series:
    """Recode JSON text with the default separators of the topic chain."""
    return texts.map(lambda text: _recode(text, (", ", ": ")), na_action="ignore")
