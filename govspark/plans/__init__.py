"""Queries over the supplied tables, one module per area."""

from govspark.plans import (  # noqa: F401
    audit,
    catalog,
    compliance,
    contracts,
    counters,
    decisions,
    lineage,
    observability,
    privacy,
    quality,
    stored,
    streams,
    topics,
)
from govspark.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
