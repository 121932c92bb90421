"""Tables that are updated in place: repeated, late and failed batches, hot keys, and what an update touches."""

from __future__ import annotations

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from govspark.sources import stored
from govspark.streaming import state
from tests.conftest import rows

ROW = "id long, name string, tags array<string>, at int"


def files(path: str, part: str) -> dict[str, set[str]]:
    """Data files of every partition."""
    return {d: {f for f in os.listdir(f"{path}/{d}") if f.endswith(".parquet")} for d in os.listdir(path) if d.startswith(f"{part}=")}


def put(spark, path, data, order=("at",), buckets=8):
    changes = spark.createDataFrame(data, ROW)
    return {r.bucket: (r.inserted, r.updated, r.rows) for r in stored.upsert(path, changes, ["id"], list(order) if order else None, buckets).collect()}


def told(spark, path):
    return rows(spark.read.parquet(path), "id", "name", "tags", "at")


def test_upsert_equals_a_dictionary(spark, tmp_path):
    """Random batches with repeated keys, null keys, null values and late rows."""
    random.seed(2)
    path, known = str(tmp_path / "t"), {}
    for number in range(4):
        batch = [(random.choice([None, *range(25)]), random.choice(["x", "y", None]), random.choice([None, ["a"], []]), number * 3 + random.randint(0, 9))
                 for _ in range(30)]
        batch = list({(r[0], r[3]): r for r in batch}.values())  # one row per key and time
        before = dict(known)
        for row in batch:
            if row[0] not in known or row[3] >= known[row[0]][3]:
                known[row[0]] = row
        report = put(spark, path, batch + batch[:5])
        assert told(spark, path) == sorted(known.values(), key=repr)
        assert sum(r[0] for r in report.values()) == len(known.keys() - before.keys())
        assert sum(r[1] for r in report.values()) == sum(known[k] != v for k, v in before.items())


def test_only_touched_buckets_are_rewritten(spark, tmp_path):
    path = str(tmp_path / "t")
    put(spark, path, [(i, "a", None, 0) for i in range(200)])
    before = files(path, "bucket")
    assert len(before) == 8
    report = put(spark, path, [(7, "b", None, 1), (7, "c", None, 2), (9, "late", None, -1)])
    after = files(path, "bucket")
    changed = {d for d in after if after[d] != before[d]}
    assert changed == {f"bucket={b}" for b in report} and len(changed) == 1
    assert list(report.values())[0][:2] == (0, 1)
    assert put(spark, path, [(7, "c", None, 2), (9, "late", None, -1), (3, "a", None, 0)]) == {}
    assert files(path, "bucket") == after


def test_without_order_stored_rows_stay(spark, tmp_path):
    path = str(tmp_path / "t")
    put(spark, path, [(1, "a", None, 0)], order=None)
    assert put(spark, path, [(1, "b", None, 9), (2, "c", None, 0)], order=None) != {}
    assert told(spark, path) == [(1, "a", None, 0), (2, "c", None, 0)]
    assert put(spark, path, [], order=None) == {}


def test_lookup_reads_one_bucket(spark, tmp_path):
    path = str(tmp_path / "t")
    put(spark, path, [(i, str(i), None, 0) for i in [*range(50), None]])
    found = stored.lookup(spark.read.parquet(path), 8, id=17)
    assert [r.name for r in found.collect()] == ["17"]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "(bucket#" in plan
    assert [r.at for r in stored.lookup(spark.read.parquet(path), 8, id=None).collect()] == [0]


def test_a_failure_before_the_last_step_changes_nothing(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    put(spark, path, [(i, "a", None, 0) for i in range(20)])
    before = told(spark, path)

    def fails(*_):
        raise RuntimeError("lost")

    monkeypatch.setattr(stored, "replace_partitions", fails)
    with pytest.raises(RuntimeError):
        put(spark, path, [(1, "b", None, 1)])
    assert told(spark, path) == before
    monkeypatch.undo()
    assert sum(r[1] for r in put(spark, path, [(1, "b", None, 1)]).values()) == 1


def partials(spark, data):
    return spark.createDataFrame([(dt.datetime(2024, 1, 1, h), k, n) for h, k, n in data], "w timestamp, k string, n long")


def add(spark, path, data, batch):
    kept = stored.add_partials(path, partials(spark, data), batch, ["w", "k"], ["n"], stored.span_of(F.col("w")))
    return {r.span: r.rows for r in kept.collect()}


def test_partials_add_up_and_a_repeated_batch_counts_once(spark, tmp_path):
    path = str(tmp_path / "t")
    assert add(spark, path, [(0, "a", 1), (0, "b", 2), (5, None, 3)], 0) == {"2024-01-01T00": 2, "2024-01-01T05": 1}
    before = files(path, "span")
    late = [(0, "a", 10), (0, "c", 1), (0, "a", 100)]
    want = [("a", 111), ("b", 2), ("c", 1), (None, 3)]
    for _ in range(3):  # the same batch after two failures
        assert add(spark, path, late, 1) == {"2024-01-01T00": 3}
        assert rows(spark.read.parquet(path), "k", "n") == sorted(want, key=repr)
    assert files(path, "span")["span=2024-01-01T05"] == before["span=2024-01-01T05"]
    add(spark, path, [(0, "a", 1000)], 2)
    add(spark, path, [(0, "a", 1000)], 2)
    assert ("a", 1111) in rows(spark.read.parquet(path), "k", "n")


EVENT = "event_id long, ts timestamp, kind string, bad boolean"


class Feed:
    def __init__(self, spark, folder, schema):
        self.spark, self.folder, self.schema = spark, str(folder), schema

    def put(self, data):
        self.spark.createDataFrame(data, self.schema).coalesce(1).write.mode("append").parquet(f"{self.folder}/in")
        return self.spark.readStream.schema(self.schema).parquet(f"{self.folder}/in")

    @property
    def path(self):
        return f"{self.folder}/table"

    @property
    def checkpoint(self):
        return f"{self.folder}/checkpoint"


def test_late_rates_touch_their_hours_alone(spark, tmp_path):
    feed = Feed(spark, tmp_path, EVENT)
    at = lambda hour, minute=0: dt.datetime(2024, 1, 1, hour, minute)
    for data in ([(1, at(9), "a", False), (2, at(3), "a", True)], [(3, at(3, 1), "a", False), (4, at(3, 6), "b", False)], [(5, at(9), "a", True)]):
        state.store_rates(feed.put(data), "ts", ["kind"], F.col("bad"), feed.path, feed.checkpoint)
    done = state.stored_rates(spark, feed.path, ["kind"])
    assert rows(done, "window_start", "kind", "requests", "error_percent") == [
        (at(3), "a", 2, 50.0), (at(3, 5), "b", 1, 0.0), (at(9), "a", 2, 50.0)]
    log = rows(spark.read.parquet(f"{feed.path}-log"), "batch", "span")
    assert log == [(0, "2024-01-01T03"), (0, "2024-01-01T09"), (1, "2024-01-01T03"), (2, "2024-01-01T09")]


def test_vetoes_expire_whatever_their_order(spark, tmp_path):
    feed = Feed(spark, tmp_path, "veto_id string, decision_id string, status string, event_time timestamp, expires_at timestamp")
    at = lambda hour: dt.datetime(2024, 1, 1, hour)
    run = lambda data: state.store_vetoes(feed.put(data), feed.path, feed.checkpoint)
    run([("b", "x", "active", at(1), at(20)), ("c", "x", "overridden", at(4), at(6))])
    assert rows(state.expired_vetoes(spark, feed.path), "veto_id") == []
    run([("c", "x", "active", at(1), at(6)), ("a", "x", "active", at(0), at(2)), ("d", "y", "active", at(7), at(23))])
    assert rows(state.expired_vetoes(spark, feed.path), "veto_id") == [("a",)]  # c was overridden later than it was cast
    run([("e", "y", "active", at(22), at(23))])
    assert rows(state.expired_vetoes(spark, feed.path), "veto_id") == [("a",), ("b",)]
    assert rows(state.expired_vetoes(spark, feed.path, "2024-01-01 03:00:00"), "veto_id") == [("b",)]
    plan = state.expired_vetoes(spark, feed.path, "2024-01-01 03:00:00")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(span" in plan
    log = rows(spark.read.parquet(f"{feed.path}-log").where("batch = 2"), "span")
    assert log == [("2024-01-01T23",)]


def test_stored_chains_go_on_and_a_repeated_batch_writes_the_same(spark, tmp_path):
    """Null chain, a hot chain, rows out of order within a batch, and a batch that is processed again after its heads moved."""
    import hashlib

    from govspark.streaming.chain import store_chain

    feed = Feed(spark, tmp_path, "chain_id string, sequence long, value string")
    want, last = {}, {}
    for part in ([2, 0, 1], [5, 4, 3], [6, 7]):
        data = [(c, i, f"{c}-{i}") for c in ("hot", None) for i in part] + [(f"c{part[0]}", 0, "x")]
        stream = feed.put(data)
        for attempt in range(2):
            store_chain(stream, feed.path, feed.checkpoint)
            if attempt == 0:  # forget that the batch was finished
                number = max(int(f) for f in os.listdir(f"{feed.checkpoint}/commits") if f.isdigit())
                for name in (f"{number}", f".{number}.crc"):
                    if os.path.exists(f"{feed.checkpoint}/commits/{name}"):
                        os.remove(f"{feed.checkpoint}/commits/{name}")
        for c, i, value in sorted(data, key=lambda r: r[1]):
            before = last.get(c, "genesis")
            last[c] = hashlib.sha256(f"{before}:{value}".encode()).hexdigest()
            want[c, i] = (before, last[c])
        got = {(r.chain_id, r.sequence): (r.previous_hash, r.event_hash) for r in spark.read.parquet(feed.path).collect()}
        assert got == want and spark.read.parquet(feed.path).count() == len(want)
    heads = spark.read.parquet(f"{feed.path}-heads")
    assert {r.chain_id: r.head_hash for r in heads.collect()} == last
