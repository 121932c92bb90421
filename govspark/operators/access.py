"""Access, transfer and control policies over request logs and fleets. The rule tables are small constants that become
expressions, so no policy check joins or shuffles."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from govspark.vocabulary import (
    CONTROLS,
    JURISDICTION_FRAMEWORKS,
    REQUIRED_CONTROLS,
    RESTRICTED_JURISDICTIONS,
    ROLE_PERMISSIONS,
)


def _lookup(table: Mapping[str, tuple[str, ...]], key: Column, otherwise: tuple[str, ...] = ()) -> Column:
    """Array of the table row for ``key``."""
    as_array = lambda words: F.array(*[F.lit(w) for w in words]).cast("array<string>")
    pairs = [c for name, words in table.items() for c in (F.lit(name), as_array(words))]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), key), as_array(otherwise))


def required_controls(classification: Column) -> Column:
    """Controls a class needs, in table order; an unknown class counts as internal."""
    return _lookup(REQUIRED_CONTROLS, classification, REQUIRED_CONTROLS["internal"])


def control_gaps(datasets: DataFrame, present: str = "controls", classification: str = "classification") -> DataFrame:
    """One row per dataset and control that is required and absent."""
    gaps = F.array_except(required_controls(F.col(classification)), F.coalesce(present, F.array().cast("array<string>")))
    return datasets.withColumn("missing_control", F.explode(gaps)).drop(present)


def control_matrix(datasets: DataFrame, classification: str = "classification") -> DataFrame:
    """One boolean column per control."""
    needed = required_controls(F.col(classification))
    return datasets.select("*", *[F.array_contains(needed, control).alias(control) for control in CONTROLS])


def jurisdiction_policy(df: DataFrame, jurisdiction: str = "jurisdiction") -> DataFrame:
    """Applicable frameworks and whether transfers are restricted."""
    key = F.col(jurisdiction)
    restricted = F.coalesce(key.isin(*RESTRICTED_JURISDICTIONS), F.lit(False))
    return df.withColumn("frameworks", _lookup(JURISDICTION_FRAMEWORKS, key)).withColumn(
        "transfer_restricted", restricted
    )


def transfer_allowed(source: Column, target: Column) -> Column:
    """Same jurisdiction, or a source that is not restricted (which includes global)."""
    same = F.coalesce(source == target, F.lit(False))
    return same | ~F.coalesce(source.isin(*RESTRICTED_JURISDICTIONS), F.lit(False))


def column_visible(is_pii: Column, roles: Column, classification: Column) -> Column:
    """Personal data needs a data steward, an administrator or a public dataset."""
    privileged = F.arrays_overlap(roles, F.array(F.lit("data_steward"), F.lit("admin")))
    return (
        ~F.coalesce(is_pii, F.lit(False))
        | F.coalesce(privileged, F.lit(False))
        | F.coalesce(classification == "public", F.lit(False))
    )


def access_allowed(action: Column, roles: Column) -> Column:
    """Administrators always; reading with any role; writing as responsible or accountable; otherwise no."""
    writer = F.arrays_overlap(roles, F.array(F.lit("responsible"), F.lit("accountable")))
    allowed = (
        F.array_contains(roles, "admin")
        | ((action == "read") & (F.size(roles) > 0))
        | ((action == "write") & writer)
    )
    return F.coalesce(allowed, F.lit(False))


def visible_columns(df: DataFrame, pii: Mapping[str, bool], roles: list[str], classification: str) -> DataFrame:
    """Projection of ``df`` to what the caller may see; hidden columns are never read."""
    privileged = classification == "public" or bool({"data_steward", "admin"} & set(roles))
    return df.select(*[f"`{c}`" for c in df.columns if privileged or not pii.get(c, False)])


def role_permissions(assignments: DataFrame, role: str = "role") -> DataFrame:
    """One row per assignment and permission."""
    return assignments.withColumn("permission", F.explode(_lookup(ROLE_PERMISSIONS, F.col(role))))
