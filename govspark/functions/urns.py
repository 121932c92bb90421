"""Dataset and job names in the catalog's URN form."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DEFAULT_PLATFORM = "govspark"
PII_TAG = "urn:li:tag:PII"


def dataset_urn(name: Column, namespace: Column | None = None, platform: str = DEFAULT_PLATFORM) -> Column:
    """URN with the platform as namespace and ``unknown`` as name where they are absent."""
    space = F.lit(platform) if namespace is None else F.coalesce(namespace, F.lit(platform))
    return F.concat(
        F.lit("urn:li:dataset:(urn:li:dataPlatform:"),
        space,
        F.lit(","),
        F.coalesce(name, F.lit("unknown")),
        F.lit(",PROD)"),
    )


def job_urn(name: Column, platform: str = DEFAULT_PLATFORM) -> Column:
    job = F.coalesce(name, F.lit("unknown"))
    return F.concat(
        F.lit(f"urn:li:dataJob:(urn:li:dataFlow:({platform},"), job, F.lit(",PROD),"), job, F.lit(")")
    )


def dataset_of_urn(urn: Column) -> Column:
    """Second comma part of the URN, or the whole text when it has no comma."""
    return F.when(F.contains(urn, F.lit(",")), F.split(urn, ",")[1]).otherwise(urn)
