"""Every registered query against its SQL on DuckDB, on the smallest scale."""

from __future__ import annotations

import pytest

from govspark.plans import ORACLE, QUERIES
from tools.check_oracle import compare, duck


@pytest.fixture(scope="module")
def connection(sf):
    return duck(sf)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_equals_sql(spark, sf, connection, name):
    got = QUERIES[name](spark, sf).toPandas()
    assert compare(got, connection.execute(ORACLE[name]).df()) == ""


def test_entry(spark):
    import __spark_entry__ as entry

    result = entry.entry(spark)
    assert result.count() == 3 and set(entry.oracle_sql()) <= set(entry.queries())


def test_run_events_are_told_apart(spark, sf):
    """A start and a completion per run, although the completion was appended twice."""
    events = QUERIES["lineage_events"](spark, sf)
    assert events.count() == 400 and events.select("run_id").distinct().count() == 200
