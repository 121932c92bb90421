from __future__ import annotations

import json

import pytest

from govspark.operators import lineage as ln
from tests.conftest import rows

DATASETS = "array<struct<namespace:string,name:string>>"
EVENT = f"job struct<namespace:string,name:string>, inputs {DATASETS}, outputs {DATASETS}"


def urn(space, name):
    return f"urn:li:dataset:(urn:li:dataPlatform:{space},{name},PROD)"


def test_edges_and_records(spark):
    events = spark.createDataFrame([
        (("n", "job"), [("a", "x"), (None, "y")], [("b", "z"), ("b", None)]),
        (None, [], [("b", "z")]),
        (("n", "sink"), [("a", "x")], None),
    ], EVENT)
    edges = rows(ln.lineage_edges(events, "lake"), "source_urn", "target_urn", "edge_type")
    assert edges == sorted((urn(*s), urn(*t), "TRANSFORMED") for s in (("a", "x"), ("lake", "y"))
                           for t in (("b", "z"), ("b", "unknown")))
    records = {r.job_urn: json.loads(r.record) for r in ln.job_records(events, "lake").collect()}
    first = records["urn:li:dataJob:(urn:li:dataFlow:(lake,job,PROD),job)"]
    assert first["aspect"]["inputDatasets"] == [urn("a", "x"), urn("lake", "y")]
    assert records["urn:li:dataJob:(urn:li:dataFlow:(lake,unknown,PROD),unknown)"]["aspect"]["inputDatasets"] == []
    assert records["urn:li:dataJob:(urn:li:dataFlow:(lake,sink,PROD),sink)"]["aspect"]["outputDatasets"] == []


def test_run_events(spark):
    jobs = spark.createDataFrame([("load", [("a", "x")], [("b", "z")])] * 2, f"job_name string, inputs {DATASETS}, outputs {DATASETS}")
    got = ln.run_events(jobs, "lake").collect()
    assert {r.event_type for r in got} == {"COMPLETE"} and got[0].job.namespace == "lake"
    assert len({r.run["runId"] for r in got}) == 2 and all(len(r.run["runId"]) == 36 for r in got)
    with pytest.raises(ValueError, match="PAUSED"):
        ln.run_events(jobs, event_type="PAUSED")


def graph(spark, *pairs):
    return spark.createDataFrame([(s, t, "j") for s, t in pairs], "source_urn string, target_urn string, job_urn string")


def test_merge_and_neighbours(spark):
    known, arrived = graph(spark, ("a", "b"), ("a", "c")), graph(spark, ("a", "b"), ("b", "c"))
    merged = ln.merge_edges(known, arrived)
    assert rows(merged, "source_urn", "target_urn") == [("a", "b"), ("a", "c"), ("b", "c")]
    assert rows(ln.neighbours(merged)) == [("a", 0, 2), ("b", 1, 1), ("c", 2, 0)]


def test_ancestors_with_diamond_and_cycle(spark):
    edges = graph(spark, ("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("d", "e"), ("x", "y"), ("y", "x"))
    got = rows(ln.ancestors(edges))
    assert got == [("b", "a", 1), ("c", "a", 1), ("d", "a", 2), ("d", "b", 1), ("d", "c", 1), ("e", "a", 3), ("e", "b", 2),
                   ("e", "c", 2), ("e", "d", 1), ("x", "x", 2), ("x", "y", 1), ("y", "x", 1), ("y", "y", 2)]
    start = spark.createDataFrame([("e",), ("nothing",)], "urn string")
    assert {r.ancestor for r in ln.ancestors(edges, start).collect()} == set("abcd")


def test_deep_lineage(spark):
    edges = graph(spark, *[(str(i), str(i + 1)) for i in range(50)])
    start = spark.createDataFrame([("50",)], "urn string")
    assert rows(ln.ancestors(edges, start), "depth") == sorted(((i,) for i in range(1, 51)), key=repr)


def test_emitted_events_and_lookup(spark, tmp_path):
    jobs = spark.createDataFrame([("load", [("a", "x")], [("b", "z")])], f"job_name string, inputs {DATASETS}, outputs {DATASETS}")
    from pyspark.sql import functions as F

    path = str(tmp_path / "events")
    events = ln.run_events(jobs, run_id=F.lit("r1"), event_time=F.lit("2024-01-01").cast("timestamp"))
    for _ in range(2):
        ln.emit_events(events, path)
    ln.emit_events(ln.run_events(jobs, event_type="FAIL"), path)
    stored = ln.read_events(spark, path)
    assert sorted(r.event_type for r in stored.collect()) == ["COMPLETE", "FAIL"]
    edges = graph(spark, ("a", "b"), ("a", "c"), ("b", "c"))
    assert rows(ln.edges_by(edges, source="a"), "target_urn") == [("b",), ("c",)]
    assert rows(ln.edges_by(edges, target="c", job="j"), "source_urn") == [("a",), ("b",)]
    assert ln.edges_by(edges, source="a", job="k").isEmpty()


def test_merged_edges_are_dealt_out_before_they_are_sorted(spark):
    edge = "source_urn string, target_urn string, job_urn string, edge_type string"
    known = spark.createDataFrame([("a", "b", "j", "T"), ("a", "b", None, "T")], edge)
    merged = ln.merge_edges(known, known.unionByName(spark.createDataFrame([("a", "c", "j", "T")], edge)))
    assert rows(merged, "source_urn", "target_urn", "job_urn") == sorted([("a", "b", "j"), ("a", "b", None), ("a", "c", "j")], key=repr)
    text = merged._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange") == 1 and "REPARTITION_BY_NUM" in text and text.rindex("Aggregate") < text.index("Exchange")
