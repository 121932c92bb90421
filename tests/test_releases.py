"""Noise on a grid, and the budget that refuses."""

from __future__ import annotations

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from govspark.functions.noise import discrete_laplace
from govspark.operators.releases import noisy_on_grid, release, remaining_budget
from govspark.operators.slices import running_sum
from tests.conftest import rows

REQUEST = "request_id string, dataset_id string, requested_at int, value double, epsilon double"


def test_values_lie_on_the_grid(spark):
    metrics = spark.range(2000).select((F.col("id") / 7 + 0.001).alias("v"))
    got = [r.noisy_value for r in noisy_on_grid(metrics, "v", F.lit(0.3), 1.0, 0.125).collect()]
    assert all((g * 8).is_integer() for g in got) and len(set(got)) > 500


def test_discrete_laplace_distribution(spark):
    """Frequencies of whole numbers against (1 - p) / (1 + p) * p^|z|."""
    n, rate = 200_000, 0.7
    seen = Counter(r[0] for r in spark.range(n).select(discrete_laplace(F.lit(rate))).collect())
    p = math.exp(-rate)
    for z in range(-4, 5):
        want = (1 - p) / (1 + p) * p ** abs(z)
        assert abs(seen[z] / n - want) < 5 * math.sqrt(want / n)


def test_grid_must_be_a_power_of_two(spark):
    metrics = spark.createDataFrame([(1.0,)], "v double")
    for bad in ({"grid": 0.1}, {"grid": 0.0}, {"sensitivity": 0.0}):
        with pytest.raises(ValueError):
            noisy_on_grid(metrics, "v", F.lit(1.0), **bad)


def test_draws_are_independent_of_each_other_and_repeat_with_a_seed(spark):
    metrics = spark.range(500).select("id", F.lit(5.0).alias("v"))
    fresh = [rows(noisy_on_grid(metrics, "v", F.lit(0.5)), "id", "noisy_value") for _ in range(2)]
    seeded = [rows(noisy_on_grid(metrics, "v", F.lit(0.5), seed=1, identity=["id"]), "id", "noisy_value") for _ in range(2)]
    assert fresh[0] != fresh[1] and seeded[0] == seeded[1]


def ask(spark, path, data, budgets):
    limits = spark.createDataFrame(budgets, "dataset_id string, budget double")
    answers = release(path, spark.createDataFrame(data, REQUEST), limits)
    return {r.request_id: (r.released, r.reason, r.noisy_value) for r in answers.collect()}


def test_budget_refuses_and_repeats_answers(spark, tmp_path):
    path, budgets = str(tmp_path / "ledger"), [("a", 0.6), ("a", 0.4), ("b", 0.1), (None, 5.0)]
    first = [("a1", "a", 1, 10.0, 0.1), ("a2", "a", 2, 10.0, 0.2), ("b1", "b", 1, 3.0, 0.1), ("c1", "c", 1, 1.0, 0.1),
             ("a3", "a", 3, None, 0.1), ("a4", "a", 4, 1.0, -1.0), ("a5", "a", 5, 1.0, float("nan")), ("n1", None, 1, 1.0, 0.5)]
    told = ask(spark, path, first + first[:2], budgets)
    assert [told[k][0] for k in ("a1", "a2", "b1")] == [True] * 3
    assert told["c1"] == (False, "dataset has no budget", None) == told["n1"]
    assert {told[k][1] for k in ("a3", "a4", "a5")} == {"epsilon or value is not valid"}
    more = [(f"a{i}", "a", i, 1.0, 0.1) for i in range(6, 16)] + [("b2", "b", 2, 1.0, 1e-9)] + first
    again = ask(spark, path, more, budgets)
    assert {k: again[k] for k in told} == told  # the same answers, and nothing spent for them
    # 0.3 of 1.0 is spent: seven tenths fit exactly.
    assert [again[f"a{i}"][0] for i in range(6, 16)] == [True] * 7 + [False] * 3
    assert again["b2"][1] == "budget exhausted"
    left = remaining_budget(spark.read.parquet(path), spark.createDataFrame(budgets, "dataset_id string, budget double"))
    assert rows(left.where("dataset_id = 'a'"), "spent", "remaining", "refused") == [(1.0, 0.0, 6)]


def test_an_overdrawn_request_closes_its_batch(spark, tmp_path):
    path = str(tmp_path / "ledger")
    told = ask(spark, path, [("x", "a", 1, 1.0, 5.0), ("y", "a", 2, 1.0, 0.1)], [("a", 1.0)])
    assert not told["x"][0] and not told["y"][0]
    assert ask(spark, path, [("z", "a", 3, 1.0, 0.1)], [("a", 1.0)])["z"][0]  # refusals spent nothing


def test_running_sums_across_slices(spark, monkeypatch):
    """Cut into many ranges, with null keys, null amounts and ties."""
    from govspark.operators import slices

    monkeypatch.setattr(slices, "RANGE_ROWS", 7)
    data = [(k, i // 2, i, None if i % 11 == 0 else i) for k in ("hot", None, "b") for i in range(40 if k == "hot" else 9)]
    frame = spark.createDataFrame(data, "k string, t int, i int, n long").repartition(5)
    got = running_sum(frame, ["k"], [F.col("t"), F.col("i")], F.col("n"), "total")
    want = [(k, i, sum(m or 0 for q, _, j, m in data if q == k and j <= i)) for k, _, i, _ in data]
    assert rows(got, "k", "i", "total") == sorted(want, key=repr)


def test_sliced_input_is_evaluated_once(spark, tmp_path):
    """A source that counts how often it is read."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    from govspark.operators.slices import number_rows

    source = spark.range(100, numPartitions=4).mapInArrow(count, "id long")
    numbered = number_rows(source.withColumn("k", F.lit(1)), ["k"], [F.col("id")], "n")
    assert numbered.count() == 100 and numbered.where("n <> id + 1").isEmpty()
    assert seen.value == 100
