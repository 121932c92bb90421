"""Reachability against a plain search, on random graphs with cycles, loops and unknown names."""

from __future__ import annotations

import random

import pytest

from govspark.operators import reach
from tests.conftest import rows

EDGE = "source_urn string, target_urn string"


def plain(edges: list[tuple]) -> dict[str, set[str]]:
    below: dict[str, set[str]] = {}
    for a, b in edges:
        if a is not None and b is not None:
            below.setdefault(a, set()).add(b)
    out = {}
    for start in below:
        found, todo = set(), list(below[start])
        while todo:
            node = todo.pop()
            if node not in found:
                found.add(node)
                todo += below.get(node, ())
        out[start] = found
    return out


@pytest.mark.parametrize("seed, nodes, edges", [(1, 12, 14), (2, 9, 20)])
def test_random_graphs(spark, seed, nodes, edges):
    rng = random.Random(seed)
    name = lambda: f"n{rng.randrange(nodes)}"
    data = [(name(), name()) for _ in range(edges)] + [("x", None), (None, "x"), ("loop", "loop"), ("loop", "end")]
    want = plain(data)
    every = [*(f"n{i}" for i in range(nodes)), "loop", "end", "unknown"]
    questions = [(a, b) for a in every for b in every] + [("n1", None)]
    frame = spark.createDataFrame(data + data[:3], EDGE).coalesce(1)
    got = reach.reachable(frame, spark.createDataFrame(questions + questions[:5], "above string, below string").coalesce(1))
    assert rows(got, "above", "below", "reachable") == sorted(((a, b, b in want.get(a, ())) for a, b in questions if b), key=repr)


def test_cycles_that_share_nodes_and_follow_each_other(spark):
    data = [("a", "b"), ("b", "a"), ("b", "c"), ("c", "d"), ("d", "e"), ("e", "c"), ("e", "f"), ("f", "d"), ("g", "a"), ("f", "h")]
    got = reach.cycles(spark.createDataFrame(data, "a string, b string").coalesce(1))
    assert rows(got, "node", "cycle") == [("a", "a"), ("b", "a"), ("c", "c"), ("d", "c"), ("e", "c"), ("f", "c")]


def test_labels_nest(spark):
    """Whoever is above has the higher level and the wider intervals; a cycle is refused."""
    data = [(f"n{i}", f"n{j}") for i in range(12) for j in range(i + 1, 12) if (i * j) % 5 == 1]
    labels = {r.node: r for r in reach.labelled(spark.createDataFrame(data, "a string, b string").coalesce(1)).collect()}
    for above, found in plain(data).items():
        for below in found:
            a, b = labels[above], labels[below]
            assert a.level > b.level and all(a[f"low{i}"] <= b[f"low{i}"] and a[f"high{i}"] >= b[f"high{i}"] for i in range(reach.LABELS))
    with pytest.raises(ValueError, match="cycle"):
        reach.labelled(spark.createDataFrame([("a", "b"), ("b", "a")], "a string, b string"))


def test_nothing(spark):
    empty = spark.createDataFrame([], EDGE)
    asked = spark.createDataFrame([("a", "b")], "above string, below string")
    assert rows(reach.reachable(empty, asked)) == [("a", "b", False)]
    assert rows(reach.reachable(empty, asked.limit(0))) == []


def test_edges_off_every_asked_way_are_left_out(spark):
    edges = spark.createDataFrame([("r", "m"), ("x", "m"), *(("m", f"n{i}") for i in range(20)), ("n3", "o")], "a string, b string").coalesce(1)
    asked = spark.createDataFrame([("r", "n1"), ("r", "unknown")], "above string, below string").coalesce(1)
    assert rows(reach._between(edges, asked), "a", "b") == [("m", "n1"), ("r", "m")]


@pytest.mark.parametrize("up", [True, False])
def test_a_hub_is_not_entered_once_for_every_question(spark, monkeypatch, up):
    """60 questions across a hub of 60 ways: the rows that a search stores follow the edges and questions, not their product."""
    edges = [("r", "h")] + [e for i in range(60) for e in (("h", f"c{i}"), (f"c{i}", f"o{i}"))]
    questions = [("r", f"o{i}") for i in range(60)] + [("c1", "o1"), ("c1", "o2")]
    if not up:
        edges, questions = [[(b, a) for a, b in rows] for rows in (edges, questions)]
    sizes, stored = [], reach._stored

    def counted(df, name, *more):
        sizes.append((out := stored(df, name, *more)).count())
        return out

    monkeypatch.setattr(reach, "_stored", counted)
    got = reach.reachable(spark.createDataFrame(edges * 2, EDGE).coalesce(1), spark.createDataFrame(questions, "above string, below string").coalesce(1))
    want = plain(edges)
    assert rows(got, "above", "below", "reachable") == sorted((a, b, b in want.get(a, ())) for a, b in questions)
    assert max(sizes) <= 2 * len(edges)
