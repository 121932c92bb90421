"""Constraints of the governance records, checked over whole tables."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from govspark.vocabulary import (
    AUDIT_EVENT_TYPES,
    CLASSIFICATIONS,
    DECISION_STATUSES,
    DECISION_TYPES,
    LAYERS,
    ROLE_RANK,
    VETO_STATUSES,
    VOTES,
)


@dataclass(frozen=True)
class Length:
    """Number of characters; without ``high`` there is no upper limit."""

    low: int
    high: int | None = None

    def test(self, value: Column) -> Column:
        size = F.length(value)
        return size >= self.low if self.high is None else size.between(self.low, self.high)


@dataclass(frozen=True)
class Range:
    low: float
    high: float | None = None

    def test(self, value: Column) -> Column:
        return value >= self.low if self.high is None else value.between(self.low, self.high)


@dataclass(frozen=True)
class OneOf:
    words: tuple[str, ...]
    optional: bool = False

    def test(self, value: Column) -> Column:
        member = value.isin(*self.words)
        return value.isNull() | member if self.optional else member


_ROLES = tuple(ROLE_RANK)

# Lengths, bounds and words that each record allows.
RECORDS: dict[str, dict[str, Length | Range | OneOf]] = {
    "decision": {
        "decision_type": OneOf(DECISION_TYPES),
        "title": Length(1, 500),
        "status": OneOf(DECISION_STATUSES),
        "domain_id": Length(1, 100),
        "created_by": Length(1, 200),
        "source_layer": OneOf(LAYERS, optional=True),
        "target_layer": OneOf(LAYERS, optional=True),
        "data_classification": OneOf(CLASSIFICATIONS, optional=True),
    },
    "vote": {"voter_id": Length(1, 200), "voter_role": OneOf(_ROLES), "vote": OneOf(VOTES)},
    "veto": {
        "vetoed_by": Length(1, 200),
        "vetoed_by_role": OneOf(_ROLES),
        "reason": Length(1),
        "status": OneOf(VETO_STATUSES),
    },
    "role": {
        "user_id": Length(1, 200),
        "domain_id": Length(1, 100),
        "role": OneOf(_ROLES),
        "assigned_by": Length(1, 200),
    },
    "audit_event": {
        "event_type": OneOf(AUDIT_EVENT_TYPES),
        "entity_type": Length(1, 100),
        "entity_id": Length(1, 200),
        "actor_id": Length(1, 200),
        "previous_hash": Length(0, 64),
        "event_hash": Length(0, 64),
    },
    "quality_report": {
        "dataset_id": Length(1, 200),
        "domain_id": Length(1, 100),
        "layer": Length(1, 20),
        "suite_name": Length(1, 200),
        "dq_score": Range(0.0, 1.0),
        "expectations_passed": Range(0),
        "expectations_failed": Range(0),
        "expectations_total": Range(0),
    },
    "quality_sla": {
        "dataset_id": Length(1, 200),
        "domain_id": Length(1, 100),
        "dimension": Length(1, 30),
        "threshold": Range(0.0, 1.0),
        "owner_id": Length(1, 200),
        "review_interval_days": Range(1),
    },
    "contract": {
        "name": Length(1, 200),
        "dataset_id": Length(1, 200),
        "domain_id": Length(1, 100),
        "owner_id": Length(1, 200),
        "version": Range(1),
        "completeness_threshold": Range(0.0, 1.0),
        "availability_percent": Range(0.0, 100.0),
    },
    "contract_column": {"name": Length(1, 200), "data_type": Length(1, 50)},
    "dataset": {
        "dataset_id": Length(1, 200),
        "name": Length(1, 200),
        "domain_id": Length(1, 100),
        "owner_id": Length(1, 200),
        "layer": OneOf(LAYERS),
        "classification": OneOf(CLASSIFICATIONS),
    },
}


def record_tests(df: DataFrame, record: str) -> dict[str, Column]:
    """Tests of a record type for the fields that the table has."""
    return {name: rule.test(F.col(name)) for name, rule in RECORDS[record].items() if name in df.columns}


def check_records(df: DataFrame, tests: Mapping[str, Column]) -> DataFrame:
    """Add ``violations``: names of the tests a row fails (a null result counts as failed)."""
    broken = F.array(*[F.when(~F.coalesce(test, F.lit(False)), F.lit(name)) for name, test in tests.items()])
    return df.withColumn("violations", F.filter(broken, lambda v: v.isNotNull()))


def split_records(df: DataFrame, tests: Mapping[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Valid rows, and the quarantine with the reasons."""
    checked = check_records(df, tests)
    return checked.where(F.size("violations") == 0).drop("violations"), checked.where(F.size("violations") > 0)
