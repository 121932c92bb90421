"""Counter increases, rates and rated histograms against plain Python."""

from __future__ import annotations

import datetime as dt
import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from govspark.operators import counters as c
from tests.conftest import rows

SAMPLE = "job string, ts timestamp, value double"
START = dt.datetime(2024, 1, 1)


def at(seconds: float) -> dt.datetime:
    return START + dt.timedelta(seconds=seconds)


def second(moment: dt.datetime) -> int:
    return int((moment - START).total_seconds())


def carried(samples: list[tuple], width: int = 300) -> dict:
    """(samples, resets, increase) by (job, start), one sample at a time."""
    series = defaultdict(list)
    for job, t, value in samples:
        if t is not None and value is not None and value >= 0:
            series[job].append((t, value))
    out = defaultdict(lambda: [0, 0, 0.0])
    for job, points in series.items():
        before = None
        for t, value in sorted(points):
            cell = out[job, t // width * width]
            cell[0] += 1
            if before is not None:
                cell[1] += value < before
                cell[2] += value if value < before else value - before
            before = value
    return {k: tuple(v) for k, v in out.items()}


def frame(spark, samples: list[tuple]):
    return spark.createDataFrame([(j, None if t is None else at(t), v) for j, t, v in samples], SAMPLE)


def test_increases_equal_one_sample_at_a_time(spark):
    random.seed(1)
    samples = []
    for job in ("a", "b", None):
        value, t = 0.0, 0
        for _ in range(300):
            t += random.choice([0, 1, 30, 200, 900])
            value = random.uniform(0, 5) if random.random() < 0.1 else value + random.randint(0, 9)
            samples.append((job, t, value))
    samples += samples[5:9] * 3 + [("a", None, 4.0), ("a", 50, None), ("b", 60, math.nan), ("b", 70, -1.0)]
    got = c.increases(frame(spark, samples).repartition(4), ["job"], "ts", "value")
    want = carried(samples)
    told = {(r.job, second(r.start)): (r.samples, r.resets, r.increase) for r in got.collect()}
    assert told.keys() == want.keys()
    for key, (n, resets, increase) in want.items():
        assert told[key][:2] == (n, resets) and math.isclose(told[key][2], increase, abs_tol=1e-9)


def test_nothing_is_lost_between_ranges(spark):
    """The increases of a series without restarts add up to its last value less its first."""
    samples = [("a", t, float(t * t)) for t in range(10, 4000, 37)]
    total = c.increases(frame(spark, samples), ["job"], "ts", "value").agg(F.sum("increase")).first()[0]
    assert total == samples[-1][2] - samples[0][2]


@pytest.mark.parametrize("samples, want", [
    # Every 60 s from second 30: both borders are half an interval away.
    ([(30, 10.0), (90, 20.0), (150, 30.0), (210, 40.0), (270, 50.0)], 50.0),
    # A counter that began at zero 15 s before its first sample is not stretched further than that.
    ([(30, 5.0), (90, 25.0), (150, 45.0), (210, 65.0), (270, 85.0)], 80 * (240 + 15 + 30) / 240),
    # Samples end early: half an interval is added at the right.
    ([(60, 100.0), (120, 110.0)], 10 * (60 + 60 + 30) / 60),
    # A reset in the middle.
    ([(0, 90.0), (150, 100.0), (300 - 1, 40.0)], 50 * (299 + 0 + 1) / 299),
    ([(100, 5.0)], None),
])
def test_extrapolation(spark, samples, want):
    got = c.increases(frame(spark, [("a", *s) for s in samples]), ["job"], "ts", "value", extrapolate=True).first()
    assert got.increase is None if want is None else math.isclose(got.increase, want)


def test_a_hot_series_is_cut_by_time(spark):
    """Samples are dealt by series and range; only one row per range is dealt by series alone."""
    samples = frame(spark, [("hot", t, float(t)) for t in range(0, 9000, 3)])
    plan = c.increases(samples, ["job"], "ts", "value")._jdf.queryExecution().executedPlan().toString()
    exchanges = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert len(exchanges) == 2  # printed from the top: ranges by series, samples by series and range
    assert "start" not in exchanges[0].split("hashpartitioning")[1] and "start" in exchanges[1].split("hashpartitioning")[1]


def test_rates_and_errors_of_nothing(spark):
    empty = c.increases(spark.createDataFrame([], SAMPLE), ["job"], "ts", "value")
    assert rows(c.rate_by(empty, ["job"])) == []
    idle = c.increases(frame(spark, [("a", 0, 4.0), ("a", 10, 4.0)]), ["job"], "ts", "value")
    assert rows(c.error_share_by(idle, ["job"], F.col("job") == "a"), "requests", "errors", "error_percent") == [(0.0, 0.0, None)]


def quantile(q: float, buckets: dict[str, float]) -> float | None:
    numeric = sorted((math.inf if b.lower() in ("+inf", "inf") else float(b), n) for b, n in buckets.items())
    if not numeric or numeric[-1][0] != math.inf:
        return None
    counts, top = [], 0.0
    for _, n in numeric:
        top = max(top, n)
        counts.append(top)
    if not top:
        return None
    k = next(i for i, n in enumerate(counts) if n >= q * top)
    if numeric[k][0] == math.inf:
        return numeric[k - 1][0] if k else None
    lower = numeric[k - 1][0] if k else min(0.0, numeric[0][0])
    below = counts[k - 1] if k else 0.0
    if k == 0 and numeric[0][0] <= 0 or counts[k] == below:
        return numeric[0][0] if k == 0 and numeric[0][0] <= 0 else lower
    return lower + (numeric[k][0] - lower) * (q * top - below) / (counts[k] - below)


@pytest.mark.parametrize("buckets", [
    {"1": 1.0, "5": 6.0, "10": 9.0, "+Inf": 10.0},
    {"1": 1.0, "5": 6.0, "+Inf": 100.0},  # beyond the last bound
    {"1": 4.0, "5": 2.0, "10": 9.0, "+Inf": 8.0},  # a bucket that counts less than a smaller one
    {"1": 4.0, "5": 7.0},  # no unbounded bucket
    {"+Inf": 7.0},
    {"-5": 3.0, "0": 5.0, "2.5e1": 9.0, "inf": 9.0},
    {"1": 0.0, "+Inf": 0.0},
    {"odd": 3.0, "1": 2.0, "+Inf": 4.0},
])
@pytest.mark.parametrize("q", [0.0, 0.5, 0.95, 1.0])
def test_rated_quantile(spark, buckets, q):
    data = [(START, "s", le, n / 2) for le, n in buckets.items() for _ in range(2)]  # two instances
    increase = spark.createDataFrame(data, "start timestamp, service string, le string, increase double")
    got = c.rated_quantile(increase, ["service"], q).first()
    want = quantile(q, {k: v for k, v in buckets.items() if k != "odd"})
    assert got.quantile_value is None if want is None else math.isclose(got.quantile_value, want, abs_tol=1e-12)


def test_quantile_outside_the_unit_interval(spark):
    with pytest.raises(ValueError):
        c.rated_quantile(spark.createDataFrame([], "start timestamp, le string, increase double"), [], 1.5)
