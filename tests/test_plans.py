"""Plans that must hold at any size: no products, no unbounded single task, pushdown, no Python on the hot path."""

from __future__ import annotations

import re

import pytest

from govspark.operators.audit import verify_chain
from govspark.plans import ORACLE, QUERIES
from govspark.plans.audit import stored_log
from govspark.plans.registry import table

EAGER = {n for n in QUERIES if n.startswith("stream_")} | {"audit_ingest"}
# Queries that end in one row, or that order one small row per range or minute.
ONE_ROW = {"one_decision_votes", "ks_drift", "ks_drift_scaled", "ks_drift_ties", "event_retention",
           "event_retention_default", "quality_report", "flagship_gate", "layer_write_roundtrip",
           "promote_bronze_silver", "profile_table", "profile_summary", "infer_types", "infer_types_sketched", "key_candidates",
           "valid_reports"}
# Foreign JSON and YAML text have no Spark expression; a hash chain is folded in order.
PYTHON = {"foreign_digest", "kafka_chain", "contract_columns", "contract_terms", "build_chain", "append_chain", "build_long_chain"}


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - EAGER))
def test_plan_scales(spark, sf, name):
    text = plan(QUERIES[name](spark, sf))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    if name not in ONE_ROW and not name.startswith("expect_"):
        assert "SinglePartition" not in text
    if name not in PYTHON:
        assert not re.search(r"EvalPython|InPandas|MapInArrow", text)


def test_suite_reads_the_table_once_besides_uniqueness(spark, sf):
    text = plan(QUERIES["quality_report"](spark, sf))
    assert text.count("FileScan") == 2  # the fused checks and the one compound key
    unique = re.findall(r"ReadSchema: struct<l_orderkey:bigint,l_linenumber:int>", text)
    assert len(unique) == 1


def test_filters_reach_the_scan(spark, sf):
    text = plan(QUERIES["expired_vetoes"](spark, sf))
    assert re.search(r"PushedFilters: \[[^]]*GreaterThanOrEqual\(l_quantity,49.0\)", text)
    assert "ReadSchema: struct<c_custkey:bigint,c_nationkey:int,c_mktsegment:string>" in plan(
        QUERIES["visible_projection"](spark, sf)
    )
    assert "EqualTo(event_type,error)" in plan(QUERIES["list_audit_events"](spark, sf))


def test_first_rows_are_cut_before_the_shuffle(spark, sf):
    text = plan(QUERIES["entity_trail"](spark, sf))
    assert re.search(r"WindowGroupLimit .*Partial", text)


def test_verification_is_one_scan_and_no_join(spark, sf):
    text = plan(verify_chain(stored_log(spark, sf), ["chain_id"]))
    assert text.count("FileScan") == 1 and "Join" not in text and text.count("Exchange") == 2


def test_compliance_is_one_projection(spark, sf):
    text = plan(QUERIES["compliance_all"](spark, sf))
    assert text.count("FileScan") == 1 and "Exchange" not in text


def test_no_broadcast_beyond_the_threshold(spark, sf):
    """With a threshold that every table exceeds, the joins shuffle instead."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for name in ("decision_outcomes", "valid_votes", "contract_validation", "transfer_check", "suite_resolution"):
            assert "BroadcastExchange" not in plan(QUERIES[name](spark, sf))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_registry_is_complete(spark, sf):
    assert set(ORACLE) <= set(QUERIES)
    assert set(QUERIES) == set(ORACLE)
    assert table(spark, sf, "lineitem").count() > 0
