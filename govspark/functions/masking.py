"""Masks for personal data. Every mask is ``Column -> Column`` and leaves nulls null."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

Mask = Callable[[Column], Column]


def hash_mask(value: Column, salt: str = "") -> Column:
    """First 16 hex digits of SHA-256 over salt and value."""
    return F.substring(F.sha2(F.concat(F.lit(salt), value), 256), 1, 16)


def redact(value: Column, replacement: str = "[REDACTED]") -> Column:
    return F.when(value.isNotNull(), F.lit(replacement))


def partial_mask(value: Column, show_first: int = 0, show_last: int = 4) -> Column:
    """Keep the first and last characters, star the rest; short values become stars only."""
    size = F.length(value)
    hidden = size - F.lit(show_first + show_last)
    kept_end = F.right(value, F.lit(show_last)) if show_last else F.lit("")
    return F.when(hidden <= 0, F.repeat(F.lit("*"), size)).otherwise(
        F.concat(F.left(value, F.lit(show_first)), F.repeat(F.lit("*"), hidden), kept_end)
    )


def tax_id_mask(value: Column) -> Column:
    return partial_mask(value, 0, 4)


def email_mask(value: Column) -> Column:
    """Hash the part before the last ``@`` and keep the domain; without ``@`` hash everything."""
    domain = F.substring_index(value, "@", -1)
    local = F.left(value, F.length(value) - F.length(domain) - F.lit(1))
    hashed = F.concat(F.substring(F.sha2(local, 256), 1, 8), F.lit("@"), domain)
    return F.when(F.contains(value, F.lit("@")), hashed).otherwise(hash_mask(value))


def python_mask(function: Callable[[str], str]) -> Mask:
    """Wrap a plain ``str -> str`` mask; Arrow batches, for masks that Spark expressions cannot state."""

    @F.pandas_udf(StringType())
    def masked(values: pd.Series) -> pd.Series:
        return values.map(function, na_action="ignore")

    return masked
