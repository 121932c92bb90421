"""Nearest neighbours against brute force."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from govspark.llm import neighbours
from tests.conftest import SF
from tests.llm.conftest import collected

COLUMNS = ("query_id", "rank", "vec_id", "score")
VECTORS = "vec_id long, embedding array<float>, label int"


def brute(rows: list[tuple], nearest: int = 10, every: int = 100) -> list[tuple]:
    sound = []
    for vec_id, vector in rows:
        if vector and all(x is not None and np.isfinite(x) for x in vector) and any(vector):
            sound.append((vec_id, np.array(vector, dtype=np.float64)))
    out = []
    for at, (vec_id, vector) in enumerate(sound):
        if vec_id is None or vec_id % every:
            continue
        found = []
        for k, (other, values) in enumerate(sound):
            if k != at and len(values) == len(vector):
                total = 0.0
                for x, y in zip(vector.tolist(), values.tolist()):
                    total += (x - y) * (x - y)
                found.append((total**0.5, other is None, other or 0, other))
        out += [(vec_id, rank, other, score) for rank, (score, _, _, other) in enumerate(sorted(found)[:nearest], 1)]
    return sorted(out, key=repr)


def same(got: list[tuple], want: list[tuple]) -> None:
    assert [r[:3] for r in got] == [r[:3] for r in want]
    assert np.allclose([r[3] for r in got], [r[3] for r in want], rtol=1e-15, atol=0)


def test_supplied_vectors(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet")
    pairs = [tuple(r) for r in rows.select("vec_id", "embedding").collect()]
    same(collected(neighbours.nearest_neighbours(rows), *COLUMNS), brute(pairs))


def edge_vectors() -> list[tuple]:
    rng = np.random.default_rng(2)
    rows = [(i, rng.standard_normal(16).round(1).tolist()) for i in range(0, 300, 5)]
    hot = rng.standard_normal(16).tolist()
    rows += [(i, hot) for i in range(1000, 1150)]  # one vector that a third of the rows hold
    rows += [(200, rows[3][1]), (200, rows[3][1]), (100, rows[20][1])]  # repeated ids, repeated rows
    rows += [(None, rows[7][1]), (None, hot), (400, None), (500, []), (600, [0.0] * 16), (700, [float("nan")] + [1.0] * 15),
             (800, [float("inf")] + [1.0] * 15), (900, [None] + [1.0] * 15), (300, [1.0, 2.0]), (301, [1.0, -2.0]), (1200, [5.0])]
    return [(i, v and [x if x is None else float(np.float32(x)) for x in v]) for i, v in rows]


@pytest.mark.parametrize("small, bounds", [(2048, 1 << 20), (7, 1)])
def test_edge_vectors(spark, monkeypatch, small, bounds):
    """Nulls, zeros, non-finite components, ties, copies, other lengths; any blocks, any number of bounds at a time."""
    monkeypatch.setattr(neighbours, "SMALL", small)
    monkeypatch.setattr(neighbours, "BOUNDS", bounds)
    rows = edge_vectors()
    table = spark.createDataFrame([(i, v, 1) for i, v in rows], VECTORS).withColumns(
        {c: F.lit("7") for c in ("row", "id", "vector", "size", "block", "visit", "blocks", "rank")}).repartition(3)
    same(collected(neighbours.nearest_neighbours(table), *COLUMNS), brute(rows))


def test_empty_table(spark):
    assert collected(neighbours.nearest_neighbours(spark.createDataFrame([], VECTORS)), *COLUMNS) == []


def test_double_vectors_and_few_candidates(spark):
    rows = [(0, [1.0, 1e-9]), (1, [1.0, 0.0]), (2, [-1.0, 1e-9])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    same(collected(neighbours.nearest_neighbours(table), *COLUMNS), brute(rows))


@pytest.mark.parametrize("size", [3, 64, 100])
def test_bounds_hold(size):
    """True distances lie within the bounds of the one-bit codes."""
    rng = np.random.default_rng(size)
    vectors, queries = rng.standard_normal((3000, size)) * 3 + 5, rng.standard_normal((50, size)) + 5
    low, high = neighbours.Codes(vectors).bounds(queries, slice(0, 3000))
    true = ((queries[:, None, :] - vectors[None]) ** 2).sum(axis=2)
    assert ((low <= true) & (true <= high)).mean() > 0.9999
    assert size < 17 or np.median((high - low) / true) < 1.5


def test_codes_spare_most_exact_distances(monkeypatch):
    """On clustered vectors the bounds leave few to rerank."""
    rng = np.random.default_rng(0)
    centres = rng.standard_normal((40, 64)) * 4
    vectors = centres[rng.integers(0, 40, 8000)] + rng.standard_normal((8000, 64))
    counted = []
    plain = neighbours.distances
    monkeypatch.setattr(neighbours, "distances", lambda a, b: counted.append(len(a)) or plain(a, b))
    block = neighbours.Block(np.arange(8000), np.arange(8000), np.ones(8000, bool), vectors, 10)
    query, vector, _ = block.search(np.arange(64), vectors[:64])
    true = ((vectors[:64, None] - vectors[None]) ** 2).sum(axis=2)
    true[np.arange(64), np.arange(64)] = np.inf
    assert (vector.reshape(64, 10) == np.argsort(true, axis=1)[:, :10]).all()
    assert sum(counted) < 0.1 * 64 * 8000
