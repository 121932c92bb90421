from __future__ import annotations

import datetime as dt
import math
import random

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from govspark.operators import observability as o
from govspark.operators.drift import detect_drift, ks_p_value, ks_statistic
from govspark.sources.metrics import append_points, metric_points
from tests.conftest import rows


def plain_ks(a, b):
    a, b = np.sort(a), np.sort(b)
    points = np.concatenate([a, b])
    gaps = np.searchsorted(a, points, "right") / len(a) - np.searchsorted(b, points, "right") / len(b)
    return np.abs(gaps).max()


def sample(spark, values):
    return spark.createDataFrame([(float(v),) for v in values], "v double")


VALUES = st.lists(st.one_of(st.integers(-3, 3), st.floats(-1e6, 1e6)), min_size=1, max_size=40)


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(VALUES, VALUES, st.sampled_from([2, 5, 1000]))
def test_statistic_is_exact(spark, a, b, range_values):
    got = ks_statistic(sample(spark, a), sample(spark, b), "v", range_values).first()
    assert got.statistic == pytest.approx(plain_ks(a, b), abs=1e-12)
    assert (got.reference_size, got.current_size) == (len(a), len(b))


def test_hot_value(spark):
    """A third of both samples is one value."""
    random.seed(2)
    a = [5.0] * 1000 + [random.gauss(0, 3) for _ in range(2000)]
    b = [5.0] * 1000 + [random.gauss(0.1, 3) for _ in range(2000)]
    assert ks_statistic(sample(spark, a), sample(spark, b), "v", 100).first().statistic == pytest.approx(plain_ks(a, b))


def test_verdicts(spark):
    random.seed(3)
    base = [random.gauss(0, 1) for _ in range(500)]
    same, moved = [random.gauss(0, 1) for _ in range(500)], [random.gauss(1, 1) for _ in range(500)]
    assert detect_drift(sample(spark, base), sample(spark, same), "v").first().has_drift is False
    assert detect_drift(sample(spark, base), sample(spark, moved), "v").first().has_drift is True
    identical = detect_drift(sample(spark, base), sample(spark, base), "v").first()
    assert (identical.statistic, identical.p_value, identical.has_drift) == (0.0, 1.0, False)


def test_threshold_is_strict(spark):
    base, other = sample(spark, range(40)), sample(spark, [x + 12 for x in range(40)])
    p = detect_drift(base, other, "v").first().p_value
    assert 0.01 < p < 0.06
    assert detect_drift(base, other, "v", threshold=0.01).first().has_drift is False
    assert detect_drift(base, other, "v", threshold=p).first().has_drift is False
    assert detect_drift(base, other, "v", threshold=p + 1e-9).first().has_drift is True


def test_p_value_series(spark):
    frame = spark.createDataFrame([(d, 100, 200) for d in (0.01, 0.1, 0.2, 0.5)], "d double, n long, m long")
    got = [r.p for r in frame.select(ks_p_value(F.col("d"), F.col("n"), F.col("m")).alias("p")).collect()]
    root = math.sqrt(100 * 200 / 300)
    for d, p in zip((0.01, 0.1, 0.2, 0.5), got):
        lam = (root + 0.12 + 0.11 / root) * d
        series = 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * lam * lam) for k in range(1, 101))
        assert p == pytest.approx(1.0 if lam < 0.2 else min(max(series, 0), 1), abs=1e-12)


def at(minute: float) -> dt.datetime:
    return dt.datetime(2024, 1, 1, tzinfo=dt.UTC) + dt.timedelta(minutes=minute)


@pytest.fixture
def log(spark):
    data = [("a", at(0), 1.0, "ok"), ("a", at(4.9), 3.0, "schema_drift x"), ("a", at(5), 7.0, "ok"),
            ("b", at(1), 9.0, "distribution_drift schema_drift")]
    return spark.createDataFrame(data, "service string, ts timestamp, value double, message string")


def test_rates(log):
    got = rows(o.rate(log, ["service"], "ts"), "service", "events", "rate")
    assert got == [("a", 1, 1 / 300), ("a", 2, 2 / 300), ("b", 1, 1 / 300)]
    amounts = rows(o.rate(log, ["service"], "ts", amount=F.col("value")), "service", "events")
    assert amounts == [("a", 4.0), ("a", 7.0), ("b", 9.0)]
    shares = rows(o.error_share(log, ["service"], "ts", F.col("value") > 2), "service", "error_percent")
    assert shares == [("a", 100.0), ("a", 50.0), ("b", 100.0)]
    lines = rows(o.log_matches(log, "message", ["schema_drift", "distribution_drift"], "ts"), "word", "lines")
    assert lines == [("distribution_drift", 1), ("schema_drift", 2)]


def test_freshness_and_volume(log):
    ages = dict(rows(o.freshness(log, ["service"], "ts", F.lit(at(6))), "service", "freshness_seconds"))
    assert ages == {"a": 60.0, "b": 300.0}
    loads = rows(o.volume(log, ["service"], F.date_trunc("minute", "ts")), "service", "rows", "total_rows")
    assert loads == [("a", 1, 1), ("a", 1, 2), ("a", 1, 3), ("b", 1, 1)]


@pytest.mark.parametrize(("values", "quantile", "expected"), [
    ([1, 1, 1, 1], 0.5, 2.5),  # half-way into the first bucket (0, 5]
    ([1, 6, 7, 8], 0.5, 5 + 5 * 1 / 3),
    ([100, 200], 0.95, 10.0),  # beyond the last bound
])
def test_histogram_quantile(spark, values, quantile, expected):
    frame = spark.createDataFrame([("a", float(v)) for v in values], "service string, value double")
    got = o.histogram_quantile(frame, ["service"], "value", [5, 10], quantile).first()
    assert got.quantile_value == pytest.approx(expected) and got.total == len(values)


def test_metric_table(spark, tmp_path):
    path = str(tmp_path / "metrics")
    frame = spark.createDataFrame([("d", "x", "gold", 5)], "dataset string, domain string, layer string, rows long")
    for metric in ("row_count", "other"):
        append_points(metric_points(frame, metric, "rows", F.lit(at(0))), path)
    assert rows(spark.read.parquet(path), "metric", "value") == [("other", 5.0), ("row_count", 5.0)]


def test_drift_of_a_fleet_equals_one_column_at_a_time(spark):
    """Several datasets and columns in many small ranges; a null dataset, an empty side, rows of neither side."""
    from govspark.operators.drift import detect_drift, drift_fleet

    frame = spark.range(3000).selectExpr(
        "CASE id % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' END AS dataset", "CASE WHEN id % 10 = 0 THEN NULL ELSE id % 2 = 0 END AS old",
        "id % 17 + (id % 2) * (id % 3) AS x", "CASE WHEN id % 5 > 0 THEN sqrt(id) END AS y", "CASE WHEN id % 2 = 0 THEN 1.0 END AS one_sided")
    got = drift_fleet(frame, F.col("old"), ["x", "y", "one_sided"], ["dataset"], range_values=40)
    told = {(r.dataset, r.column): (r.reference_size, r.current_size, r.statistic, r.has_drift) for r in got.collect()}
    assert len(told) == 9
    for dataset in ("a", "b", None):
        own = frame.where(F.col("dataset").eqNullSafe(F.lit(dataset)))
        for column in ("x", "y"):
            want = detect_drift(own.where("old"), own.where("NOT old"), column).first()
            n1, n2, statistic, drift = told[dataset, column]
            assert (n1, n2, drift) == (want.reference_size, want.current_size, want.has_drift)
            assert abs(statistic - want.statistic) < 1e-12
        assert told[dataset, "one_sided"][2:] == (None, False)


def test_a_fleet_is_one_scan(spark, sf):
    from govspark.operators.drift import drift_fleet

    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    source = spark.range(200).selectExpr("id AS x", "id * 2 AS y").mapInArrow(count, "x long, y long")
    assert drift_fleet(source, F.col("x") % 2 == 0, ["x", "y"]).count() == 2
    assert seen.value == 200


def test_counts_use_the_cores(spark, monkeypatch):
    """Counts that fit one range are still dealt over the cores, and nothing changes by it."""
    from govspark.operators import drift as k

    frame = spark.range(400).select((F.col("id") % 37).alias("place"), (F.col("id") * 7 % 101).alias("v"), (F.col("id") % 3 == 0).alias("old"))
    whole = rows(k.drift_fleet(frame, F.col("old"), ["v"], ["place"]))
    monkeypatch.setattr(k, "LEAST_VALUES", 10)
    counts = frame.groupBy("v").agg(F.count("*").alias("n1"), F.lit(0).alias("n2"))
    assert k._ranged(counts, ["v"], k.RANGE_VALUES).select("bucket").distinct().count() == spark.sparkContext.defaultParallelism
    assert rows(k.drift_fleet(frame, F.col("old"), ["v"], ["place"])) == whole and len(whole) == 37
