from __future__ import annotations

import datetime as dt
import hashlib
import json
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from govspark.functions.canonical import canonical_json, iso_timestamp, json_string, spaced_json
from govspark.operators import audit as a
from govspark.operators.slices import _sliced, number_rows, previous_value
from govspark.vocabulary import GENESIS_HASH
from tests.conftest import rows

SETTINGS = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
TEXT = st.text(alphabet=st.characters(blacklist_categories=("Cs",), blacklist_characters="\x00"), max_size=15)
EVENT = ("chain string, id long, event_type string, entity_type string, entity_id string, actor_id string, "
         "description string, details map<string,string>, occurred_at timestamp")  # fmt: skip


def canonical(event: dict, previous: str) -> str:
    fields = ("event_type", "entity_type", "entity_id", "actor_id", "description", "details")
    payload = {f: event[f] for f in fields}
    payload["occurred_at"] = event["occurred_at"].isoformat()
    payload["previous_hash"] = previous
    return hashlib.sha256(json.dumps(payload, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def event(number: int, chain: str = "c", **other) -> dict:
    at = dt.datetime(2024, 1, 1, tzinfo=dt.UTC) + dt.timedelta(hours=number, microseconds=number % 3)
    return {"chain": chain, "id": number, "event_type": "data_promoted", "entity_type": "dataset",
            "entity_id": f"é{number}", "actor_id": "ann", "description": 'a "b" \\ \n', "details": {"z": "1", "a": "ü"},
            "occurred_at": at, **other}


def frame(spark, events):
    names = [f.split()[0] for f in EVENT.split(", ")]
    return spark.createDataFrame([tuple(e[n] for n in names) for e in events], EVENT)


def build(spark, events, **kwargs):
    return a.build_chain(frame(spark, events), ["chain"], [F.col("occurred_at"), F.col("id")], **kwargs)


@SETTINGS
@given(st.lists(TEXT, min_size=1, max_size=20))
def test_json_strings_equal_python(spark, texts):
    data = spark.createDataFrame(list(enumerate(texts)), "i int, v string")
    got = [r.j for r in data.select("i", json_string(F.col("v")).alias("j")).orderBy("i").collect()]
    assert got == [json.dumps(t) for t in texts]


def test_iso_timestamps(spark):
    times = [dt.datetime(2024, 1, 2, 3, 4, 5, micro, tzinfo=dt.UTC) for micro in (0, 1, 500000)]
    data = spark.createDataFrame([(t,) for t in times], "t timestamp")
    assert [r.x for r in data.select(iso_timestamp(F.col("t")).alias("x")).collect()] == [t.isoformat() for t in times]


def test_foreign_json(spark):
    text = '{"b": [1, 2.50, 1e20], "a": {"y": null, "x": "é"}}'
    data = spark.createDataFrame([(text,), (None,)], "t string")
    got = data.select(canonical_json("t").alias("c"), spaced_json("t").alias("s")).collect()
    value = json.loads(text)
    assert got[0].c == json.dumps(value, sort_keys=True, separators=(",", ":"))
    assert got[0].s == json.dumps(value, sort_keys=True) and got[1].c is None


@SETTINGS
@given(st.lists(st.tuples(TEXT, st.dictionaries(TEXT, st.one_of(st.none(), TEXT), max_size=3)), min_size=1, max_size=10))
def test_chain_equals_python_fold(spark, contents):
    events = [event(i, description=text, details=details) for i, (text, details) in enumerate(contents)]
    previous, expected = GENESIS_HASH, []
    for e in events:
        expected.append((previous, canonical(e, previous)))
        previous = expected[-1][1]
    got = build(spark, events).orderBy("position").collect()
    assert [(r.previous_hash, r.event_hash) for r in got] == expected


def test_long_chain_is_unbroken(spark):
    """No event count restarts a chain, and a thousand deleted events are noticed."""
    events = [event(i) for i in range(2600)]
    chained = build(spark, events)
    assert chained.where(F.col("previous_hash") == GENESIS_HASH).count() == 1
    assert a.verify_chain(chained, ["chain"]).first().valid
    cut = a.verify_chain(chained.where("position <= 900 OR position > 1900"), ["chain"]).first()
    assert not cut.valid and cut.orphans == 1 and cut.events == 1600
    anchors = a.chain_anchors(chained, ["chain"], 1000).orderBy("segment").collect()
    assert [r.details["size"] for r in anchors] == ["1000", "2000", "2600"]
    heads = {str(r.position): r.event_hash for r in chained.where("position in (1000, 2000, 2600)").collect()}
    assert {r.details["size"]: r.details["head"] for r in anchors} == heads


@pytest.mark.parametrize("cut", [1, 2, 3, 5, 6])
def test_appending_equals_building_at_once(spark, tmp_path, cut):
    events = [event(i, chain) for chain in "xy" for i in range(7) if chain == "x" or i > 2]
    whole = build(spark, events)
    path = str(tmp_path / "log")
    build(spark, [e for e in events if e["id"] < cut]).write.parquet(path)
    stored = spark.read.parquet(path)
    later = build(spark, [e for e in events if e["id"] >= cut], heads=a.last_links(stored, ["chain"]))
    columns = ("chain", "position", "previous_hash", "event_hash")
    assert rows(stored.unionByName(later), *columns) == rows(whole, *columns)


@pytest.mark.parametrize("joined_before", [False, True])
def test_chains_stay_whole_where_joins_turn_into_broadcasts(spark, tmp_path, joined_before):
    """Adaptive execution reads a join's shuffle per map task once the other side is small; chains must not follow."""
    events = [event(i, chain=f"c{i % 3}") for i in range(300)]
    want = rows(build(spark, events), "id", "position", "event_hash")
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "10MB",
            "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    for key, value in conf.items():
        spark.conf.set(key, value)
    try:
        order = [F.col("occurred_at"), F.col("id")]
        spread = frame(spark, events).repartition(5)
        if joined_before:
            few = spark.createDataFrame([(f"c{i}",) for i in range(3)], "chain string")
            got = rows(a.build_chain(spread.join(few, "chain"), ["chain"], order), "id", "position", "event_hash")
        else:
            a.build_chain(spread.where("id < 100"), ["chain"], order).write.parquet(f"{tmp_path}/first")
            first = spark.read.parquet(f"{tmp_path}/first")
            later = a.build_chain(spread.where("id >= 100"), ["chain"], order, heads=a.last_links(first, ["chain"]))
            got = rows(first.unionByName(later), "id", "position", "event_hash")
    finally:
        for key in conf:
            spark.conf.unset(key)
    assert got == want


def test_topic_chain(spark):
    data = spark.createDataFrame([("p", i, json.dumps({"n": i})) for i in range(5)], "chain string, n long, value string")
    built = a.build_topic_chain(data, ["chain"], F.col("value"), [F.col("n")]).orderBy("n").collect()
    previous = "genesis"
    for row in built:
        assert row.previous_hash == previous
        previous = hashlib.sha256(f"{previous}:{row.value}".encode()).hexdigest()
        assert row.event_hash == previous


def sound(spark, count=12):
    return [r.asDict() for r in build(spark, [event(i) for i in range(count)]).orderBy("position").collect()]


def verdict(spark, events):
    ddl = EVENT + ", previous_hash string, event_hash string"
    names = [f.split()[0] for f in ddl.split(", ")]
    stored = spark.createDataFrame([tuple(e[n] for n in names) for e in events], ddl)
    return a.verify_chain(stored, ["chain"]).collect(), stored


def in_order(events):
    """Verification as one reads it: in time order, from the genesis hash."""
    before = GENESIS_HASH
    for e in sorted(events, key=lambda e: (e["occurred_at"], e["id"])):
        if e["previous_hash"] != before or canonical(e, e["previous_hash"]) != e["event_hash"]:
            return False
        before = e["event_hash"]
    return True


def reseal(e, **changes):
    changed = {**e, **changes}
    return {**changed, "event_hash": canonical(changed, changed["previous_hash"])}


MUTATIONS = {
    "sound": lambda e: e,
    "cut end": lambda e: e[:-2],
    "edited": lambda e: [*e[:4], {**e[4], "description": "x"}, *e[5:]],
    "edited and resealed": lambda e: [*e[:4], reseal(e[4], description="x"), *e[5:]],
    "deleted inside": lambda e: [*e[:4], *e[5:]],
    "deleted first": lambda e: e[1:],
    "wrong genesis": lambda e: [reseal(e[0], previous_hash="1" * 64), *e[1:]],
    "fork": lambda e: [*e, reseal(e[5], id=99, description="fork")],
    "copy": lambda e: [*e, e[3]],
    "second root": lambda e: [*e, reseal(e[0], id=98, description="root")],
    "times swapped": lambda e: [*e[:4], {**e[4], "occurred_at": e[5]["occurred_at"]},
                                {**e[5], "occurred_at": e[4]["occurred_at"]}, *e[6:]],
    "resealed in the past": lambda e: [*e[:-1], reseal(e[-1], occurred_at=dt.datetime(2020, 1, 1, tzinfo=dt.UTC))],
}


@pytest.mark.parametrize("name", MUTATIONS)
def test_tampering(spark, name):
    events = MUTATIONS[name](sound(spark))
    (result,), stored = verdict(spark, [{**e, "occurred_at": e["occurred_at"].replace(tzinfo=dt.UTC)} for e in events])
    expected = in_order([{**e, "occurred_at": e["occurred_at"].replace(tzinfo=dt.UTC)} for e in events])
    assert result.valid is expected is (name in ("sound", "cut end"))
    if name in ("sound", "cut end"):
        assert result.head == events[-1]["event_hash"]
        assert rows(a.chain_heads(stored, ["chain"]), "head_hash") == [(events[-1]["event_hash"],)]
    assert a.chain_defects(stored, ["chain"]).isEmpty() is (name in ("sound", "cut end"))


def test_equal_times_are_sound(spark):
    same = dt.datetime(2024, 1, 1, tzinfo=dt.UTC)
    built = build(spark, [event(i, occurred_at=same) for i in range(9)])
    assert a.verify_chain(built, ["chain"]).first().valid


def test_empty_chain_has_no_defect(spark):
    stored = frame(spark, []).withColumns({"previous_hash": F.lit(""), "event_hash": F.lit("")})
    assert a.verify_chain(stored, ["chain"]).where("NOT valid").isEmpty()


def test_hot_chain(spark):
    """One chain holds most events, and half of those one instant; positions and links still form one order."""
    data = spark.range(6000).select(
        F.when(F.col("id") % 3 != 0, "hot").otherwise(F.concat(F.lit("c"), F.col("id") % 50)).alias("chain"), "id",
        F.concat(F.lit("m"), "id").alias("value"),
    )
    order = [F.greatest("id", F.lit(3000)), F.col("id")]
    built = a.build_topic_chain(data, ["chain"], F.col("value"), order)
    hot = [r.asDict() for r in built.where("chain = 'hot'").orderBy("position").collect()]
    assert [r["position"] for r in hot] == list(range(1, 4001))
    for number, row in enumerate(hot):
        previous = hot[number - 1]["event_hash"] if number else "genesis"
        assert row["event_hash"] == hashlib.sha256(f"{previous}:{row['value']}".encode()).hexdigest()


@pytest.mark.parametrize("given_slices", [True, False])
def test_sliced_windows_equal_plain_windows(spark, given_slices):
    random.seed(1)
    data = [(random.choice(["a", "a", "a", "b", None]), random.randrange(200), i, random.choice("xyz")) for i in range(500)]
    table = spark.createDataFrame(data, "k string, t int, i int, v string")
    order = [F.col("t"), F.col("i")]
    slices = F.floor(F.col("t") / 7) if given_slices else None
    got = number_rows(table, ["k"], order, "n", slices)
    got = previous_value(got, ["k"], order, "v", "p", slices)
    expected, last, count = [], {}, {}
    for key, t, i, v in sorted(data, key=lambda r: (r[1], r[2])):
        count[key] = count.get(key, 0) + 1
        expected.append((i, count[key], last.get(key)))
        last[key] = v
    assert [tuple(r) for r in got.select("i", "n", "p").orderBy("i").collect()] == sorted(expected)


def test_ranges_split_a_hot_key(spark):
    """No task of the window gets more than a range of the hot key, although all its rows share one instant."""
    hot = spark.range(4000).select(F.lit("hot").alias("k"), F.lit(1).alias("t"), "id")
    sliced = _sliced(hot, ["k"], None, [F.col("t"), F.col("id")], 1000)
    sizes = [r["count"] for r in sliced.groupBy("_group").count().collect()]
    assert sum(sizes) == 4000 and len(sizes) == 4 and max(sizes) < 2000


def test_listings(spark):
    events = frame(spark, [event(i, entity_id=f"e{i % 2}", event_type="xy"[i % 3 == 0]) for i in range(10)])
    assert [r.id for r in a.list_events(events, limit=3, offset=1).collect()] == [8, 7, 6]
    assert [r.id for r in a.list_events(events, "y").collect()] == [9, 6, 3, 0]
    assert [r.id for r in a.entity_trail(events, "e1", 2).collect()] == [1, 3]
    assert rows(a.entity_trails(events, 2), "id") == [(0,), (1,), (2,), (3,)]
    assert rows(a.oldest(events, 2), "id") == [(0,), (1,)]


def test_lost_rows(spark):
    before = spark.createDataFrame([(1, "a"), (1, "a"), (2, None), (3, "c")], "i int, v string")
    after = spark.createDataFrame([(1, "a"), (2, None), (3, "d"), (4, "e")], "i int, v string")
    assert rows(a.lost_rows(before, after)) == [(1, "a", 1), (3, "c", 1)]
    assert a.lost_rows(before, before.unionByName(after)).isEmpty()


def test_chain_carries_what_is_kept(spark, sf):
    """Columns that nobody asked for are not sorted with the chain, and the hashes are the same."""
    from govspark.plans import derived as d

    events, order = d.audit_events(spark, sf), [F.col("occurred_at"), F.col("id")]
    lean = a.build_chain(events, ["event_type"], order, keep=["id", "event_type", "occurred_at"])
    assert set(lean.columns) == {"id", "event_type", "occurred_at", "position", "previous_hash", "event_hash"}
    assert rows(lean, "id", "event_hash") == rows(a.build_chain(events, ["event_type"], order), "id", "event_hash")


def test_long_chains_are_verified_in_parallel(spark, sf):
    """The chains are chosen after the links are grouped, not by a join that lays every chain into one task."""
    from govspark.plans import QUERIES

    text = QUERIES["verify_long_chain"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert text.index("LeftSemi") < text.index("Generate")
