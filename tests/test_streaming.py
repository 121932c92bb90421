from __future__ import annotations

import datetime as dt
import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from govspark.operators.expectations import Expectation
from govspark.plans import stored, streams
from govspark.sources import topics as t
from govspark.streaming import queries as s
from govspark.streaming.chain import stream_hash_chain
from govspark.vocabulary import EVENT_SUBJECTS
from tests.conftest import rows


def at(minute: float) -> dt.datetime:
    return dt.datetime(2024, 1, 1, tzinfo=dt.UTC) + dt.timedelta(minutes=minute)


class Feed:
    """A folder that receives batches, a stream over it and a sink that survives restarts."""

    def __init__(self, spark, folder, schema):
        self.spark, self.folder, self.schema = spark, str(folder), schema

    def put(self, data):
        self.spark.createDataFrame(data, self.schema).coalesce(1).write.mode("append").parquet(f"{self.folder}/in")

    def run(self, build):
        stream = build(self.spark.readStream.schema(self.schema).parquet(f"{self.folder}/in"))
        s.run_available(stream, f"{self.folder}/out", f"{self.folder}/checkpoint")
        return self.spark.read.schema(stream.schema).parquet(f"{self.folder}/out")


def test_hash_chain_continues_after_restart(spark, tmp_path):
    feed = Feed(spark, tmp_path, "chain_id string, sequence long, value string")
    texts = [json.dumps({"n": i}) for i in range(9)]
    for part in ([2, 0, 1], [5, 4, 3], [6, 7, 8]):
        feed.put([("p0", i, texts[i]) for i in part] + [("p1", i, texts[i]) for i in part])
        out = feed.run(stream_hash_chain)
    for chain in ("p0", "p1"):
        previous = "genesis"
        for row in out.where(F.col("chain_id") == chain).orderBy("sequence").collect():
            assert row.previous_hash == previous
            previous = hashlib.sha256(f"{previous}:{texts[row.sequence]}".encode()).hexdigest()
            assert row.event_hash == previous
    assert out.count() == 18


def test_veto_expiry_over_time(spark, tmp_path):
    feed = Feed(spark, tmp_path, "veto_id string, decision_id string, status string, event_time timestamp, expires_at timestamp")
    feed.put([("a", "x", "active", at(0), at(60)), ("b", "x", "active", at(0), at(600)), ("c", "x", "active", at(0), at(60))])
    assert feed.run(s.stream_veto_expiry).isEmpty()
    feed.put([("c", "x", "overridden", at(30), at(60)), ("d", "y", "active", at(69), at(500))])
    assert feed.run(s.stream_veto_expiry).isEmpty()  # the watermark is at minute 59
    feed.put([("e", "y", "active", at(70.5), at(900))])
    assert rows(feed.run(s.stream_veto_expiry), "veto_id", "expires_at") == [("a", dt.datetime(2024, 1, 1, 1))]
    feed.put([("f", "y", "active", at(2000), at(2001))])
    assert rows(feed.run(s.stream_veto_expiry), "veto_id") == [("a",), ("b",), ("d",), ("e",)]


def test_rates_equal_batch(spark, tmp_path):
    feed = Feed(spark, tmp_path, "ts timestamp, service string, bad boolean")
    build = lambda e: s.stream_rates(e, "ts", ["service"], F.col("bad"))
    feed.put([(at(0), "a", True), (at(4), "a", False), (at(6), "a", False)])
    feed.run(build)
    feed.put([(at(3), "a", False), (at(7), "b", True)])  # late, but within the watermark
    feed.run(build)
    feed.put([(at(60), "a", False)])
    done = rows(feed.run(build), "service", "requests", "error_percent")
    assert done == [("a", 1, 0.0), ("a", 3, pytest.approx(100 / 3)), ("b", 1, 100.0)]


def test_sliding_rates(spark, tmp_path):
    feed = Feed(spark, tmp_path, "ts timestamp, service string, bad boolean")
    feed.put([(at(2), "a", False), (at(60), "a", False)])
    out = feed.run(lambda e: s.stream_rates(e, "ts", ["service"], F.col("bad"), slide="1 minute"))
    assert out.count() == 5


def test_edges_count_redelivered_runs_once(spark, tmp_path):
    datasets = "array<struct<namespace:string,name:string>>"
    feed = Feed(spark, tmp_path,
                f"event_type string, run map<string,string>, event_time timestamp, job struct<name:string>, "
                f"inputs {datasets}, outputs {datasets}")  # fmt: skip
    run = ("START", {"runId": "r1"}, at(0), ("j",), [("a", "x")], [("b", "y"), ("b", "z")])
    feed.put([run])
    feed.run(s.stream_edges)
    feed.put([run, ("COMPLETE", *run[1:]), ("START", {"runId": "r2"}, at(1), ("j",), [("a", "x")], [("b", "y")])])
    assert feed.run(s.stream_edges).count() == 5


def test_ingest_defaults_and_bad_messages(spark, tmp_path):
    feed = Feed(spark, tmp_path, "value string")
    feed.put([('{"event_type": "e", "details": {"a": "1"}, "timestamp": "2024-01-01T00:00:00Z"}',), ("{}",)])
    got = feed.run(lambda m: s.audit_ingest(m, F.lit(at(9)))).orderBy("timestamp").collect()
    assert [(r.event_type, r.actor_id, r.details, r.timestamp.minute) for r in got] == [("e", "", {"a": "1"}, 0), (None, "", {}, 9)]
    bad = [("not json",), ("[1]",), ('{"event_type": ',), (None,)]
    feed.put([*bad, ('{"event_type": "later"}',)])
    assert feed.run(lambda m: s.audit_ingest(m, F.lit(at(9)))).count() == 3
    aside = t.broken_envelopes(spark.createDataFrame([*bad, ("{}",)], "value string"))
    assert rows(aside) == sorted(bad, key=repr)


def test_nothing_late_is_lost(spark, tmp_path):
    """Batches out of order, far beyond any watermark, and a restart between them."""
    feed = Feed(spark, tmp_path, "ts timestamp, service string, bad boolean")
    where = (f"{tmp_path}/landed", f"{tmp_path}/landing")
    for data in ([(at(5000), "a", True)], [(at(0), "a", False), (at(5001), "a", False)], [(at(1), "a", True)]):
        feed.put(data)
        stream = spark.readStream.schema(feed.schema).parquet(f"{feed.folder}/in")
        s.land(stream, lambda b: s.rate_partials(b, "ts", ["service"], F.col("bad")), *where)
    done = s.merge_rates(spark.read.parquet(where[0]), ["service"])
    assert rows(done, "requests", "error_percent") == [(2, 50.0), (2, 50.0)]
    vetoes = spark.createDataFrame(
        [("a", "x", "active", at(900), at(950)), ("b", "x", "active", at(0), at(60)), ("c", "x", "active", at(0), at(60)),
         ("c", "x", "overridden", at(30), at(60))],
        "veto_id string, decision_id string, status string, event_time timestamp, expires_at timestamp")
    assert rows(s.expired_so_far(vetoes), "veto_id") == [("b",)]


def test_quality_gate_per_batch(spark, tmp_path):
    folder = str(tmp_path)
    suite = [Expectation("expect_column_values_to_not_be_null", {"column": "x"}),
             Expectation("expect_column_values_to_be_between", {"column": "x", "min_value": 0}),
             Expectation("expect_column_values_to_be_unique", {"column": "x"}),
             Expectation("expect_column_values_to_match_regex", {"column": "x", "regex": "^[0-9]*$"})]
    for number, data in enumerate(([(1,), (2,)], [(-1,), (-1,), (None,)])):
        spark.createDataFrame(data, "x int").coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema("x int").parquet(f"{folder}/in")
        s.stream_quality_gate(stream, "d", "dom", "bronze", "silver", suite, f"{folder}/out", f"{folder}/checkpoint")
        assert spark.read.parquet(f"{folder}/out").count() == number + 1
    verdicts = rows(spark.read.parquet(f"{folder}/out"), "batch", "verdict", "expectations_passed")
    assert verdicts == [(0, "promoted", 4), (1, "refused", 0)]


def test_messages_routing_retention(spark):
    events = spark.createDataFrame([(1, None), (2, "own")], "id int, _trace string")
    values = [json.loads(r.value) for r in t.as_messages(events, F.lit("t")).collect()]
    assert values == [{"id": 1, "_trace": "t"}, {"id": 2, "_trace": "own"}]
    assert json.loads(t.as_messages(events.drop("_trace")).first().value) == {"id": 1}
    keys = spark.createDataFrame([(k,) for k in [*EVENT_SUBJECTS, "other", None]], "subject_key string")
    assert dict(rows(t.route(keys))) == EVENT_SUBJECTS
    log = spark.createDataFrame([(i, at(-i / 2)) for i in range(40000)], "id int, ts timestamp")
    kept = t.retain(log, "ts", "id", F.lit(at(0)), 7, 25)
    assert rows(kept, "id") == sorted(((i,) for i in range(25)), key=repr)
    assert t.retain(log, "ts", "id", F.lit(at(0)), 1).count() == 2881
    assert t.retain(log, "ts", "id", F.lit(at(0)), 7).count() == 20161
    assert t.retain(log.where("id < 0"), "ts", "id", F.lit(at(0))).count() == 0


@pytest.mark.parametrize("kind", ["landed", "replay", "arriving"])
def test_arriving_tables_are_evaluated_once(spark, tmp_path, kind):
    """Values that differ with every evaluation: each row arrives exactly once if there is only one."""
    drawn = F.udf(lambda: random.random(), "double").asNondeterministic()
    batch = spark.range(200).withColumn("v", drawn())
    if kind == "landed":
        got = streams.landed(spark, batch, "drawn", lambda b: b, F.col("v"))
    elif kind == "replay":
        got = streams.replay(spark, batch, "drawn", F.col("v"), lambda b: b)
    else:
        def run(stream, checkpoint):
            s.run_available(stream, f"{tmp_path}/out", checkpoint)

        stored.arriving(spark, batch, "drawn", F.floor(F.col("v") * 3), run)
        got = spark.read.parquet(f"{tmp_path}/out")
    assert rows(got, "id") == sorted([(i,) for i in range(200)], key=repr)
