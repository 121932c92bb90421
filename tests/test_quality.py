from __future__ import annotations

import re

import datetime as dt

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from govspark.operators.expectations import KINDS, Expectation, Kind, broken_values, evaluate_suite, spark_time_pattern
from govspark.operators.gate import keep_first, promote, promotion_verdicts, with_decision_id
from govspark.operators.profile import infer_types, profile_summary, profile_table
from govspark.operators.scoring import dimension_scores, latest_report, overall_score, quality_report, report_name
from govspark.operators.sla import check_sla, contract_sla, due_for_review, layer_thresholds, threshold_table
from govspark.sources.layers import read_dataset, versions, write_dataset
from govspark.vocabulary import DIMENSIONS
from tests.conftest import rows


def one(spark, ddl, data, kind, **kwargs):
    result = evaluate_suite(spark.createDataFrame(data, ddl), [Expectation(kind, kwargs)]).collect()
    assert len(result) == 1
    return result[0].observed, result[0].success


NUMBERS = ("x int", [(1,), (2,), (None,), (2,)])


@pytest.mark.parametrize(
    ("kind", "kwargs", "expected"),
    [
        ("expect_table_row_count_to_be_between", {"min_value": 4, "max_value": 4}, (4.0, True)),
        ("expect_table_row_count_to_be_between", {"min_value": 5}, (4.0, False)),
        ("expect_column_values_to_not_be_null", {"column": "x"}, (1.0, False)),
        ("expect_column_values_to_be_between", {"column": "x", "min_value": 1, "max_value": 2}, (0.0, True)),
        ("expect_column_values_to_be_between", {"column": "x", "min_value": 2}, (1.0, False)),
        ("expect_column_mean_to_be_between", {"column": "x", "max_value": 1.5}, (5 / 3, False)),
        ("expect_column_values_to_be_in_set", {"column": "x", "value_set": [1, 2]}, (0.0, True)),
        ("expect_column_values_to_be_unique", {"column": "x"}, (2.0, False)),
        ("expect_compound_columns_to_be_unique", {"column_list": ["x", "x"]}, (2.0, False)),
        ("expect_column_values_to_be_of_type", {"column": "x", "type_": "integer"}, (0.0, True)),
        ("expect_column_values_to_be_of_type", {"column": "x", "type_": "string"}, (3.0, False)),
        ("expect_column_values_to_match_strftime_format", {"column": "x", "strftime_format": "%Y"}, (3.0, False)),
        ("expect_column_values_to_not_be_null", {"column": "missing"}, (None, None)),
        ("expect_something_new", {"column": "x"}, (None, None)),
    ],
)
def test_single_checks(spark, kind, kwargs, expected):
    observed, success = one(spark, *NUMBERS, kind, **kwargs)
    if expected[0] is None:
        assert observed is None and not success
    else:
        assert observed == pytest.approx(expected[0]) and success is expected[1]


def test_pair_equality_is_null_safe(spark):
    data = [(1, 1), (None, None), (1, None)]
    assert one(spark, "a int, b int", data, "expect_column_pair_values_to_be_equal", column_A="a", column_B="b") == (
        1.0,
        False,
    )


@pytest.mark.parametrize(("kind", "kwargs"), [
    ("expect_column_values_to_be_unique", {"column": "x"}),
    ("expect_column_values_to_be_between", {"column": "x", "min_value": 1}),
    ("expect_column_mean_to_be_between", {"column": "x", "min_value": 1}),
])
def test_empty_table_passes_value_checks(spark, kind, kwargs):
    assert one(spark, "x int", [], kind, **kwargs)[1] is True


def test_strftime_patterns(spark):
    assert spark_time_pattern("%Y-%m-%dT%H:%M:%S") == "yyyy-MM-dd'T'HH:mm:ss"
    assert spark_time_pattern("%d/%m/%y %I:%M %p") == "dd/MM/yy hh:mm a"
    with pytest.raises(ValueError, match="%Q"):
        spark_time_pattern("%Q")
    data = [("2024-01-02T03:04:05",), ("2024-01-02",), (None,), ("2024-13-02T03:04:05",)]
    kwargs = {"column": "t", "strftime_format": "%Y-%m-%dT%H:%M:%S"}
    assert one(spark, "t string", data, "expect_column_values_to_match_strftime_format", **kwargs) == (2.0, False)
    typed = [(dt.datetime(2024, 1, 1),)]
    assert one(spark, "t timestamp", typed, "expect_column_values_to_match_strftime_format", **kwargs) == (0.0, True)


def test_suite_keeps_order_and_mixes_kinds(spark):
    suite = [
        Expectation("expect_column_values_to_be_unique", {"column": "x"}),
        Expectation("expect_unknown"),
        Expectation("expect_table_row_count_to_be_between", {"min_value": 1}),
    ]
    got = evaluate_suite(spark.createDataFrame([(1,)], "x int"), suite).orderBy("position").collect()
    assert [(r.position, r.success) for r in got] == [(0, True), (1, None), (2, True)]


def test_new_kind_is_one_registry_entry(spark):
    kinds = {**KINDS, "expect_column_max_to_be": Kind(
        "accuracy", lambda k: [k["column"]], lambda k, s: F.max(k["column"]), lambda o, k: o == k["value"])}
    got = evaluate_suite(spark.range(5), [Expectation("expect_column_max_to_be", {"column": "id", "value": 4})], kinds)
    assert got.first().success is True


def test_broken_values_keeps_duplicates_and_skips_nulls(spark):
    values = spark.createDataFrame([(1,), (3,), (3,), (None,)], "x int")
    allowed = spark.createDataFrame([(1,), (1,), (2,)], "a int")
    assert rows(broken_values(values, "x", allowed)) == [(3,), (3,)]


RESULT = "dataset_id string, expectation_type string, success boolean"
NOT_NULL, ROWS = "expect_column_values_to_not_be_null", "expect_table_row_count_to_be_between"


def scores_of(spark, data, mapping=None):
    scored = dimension_scores(spark.createDataFrame(data, RESULT), ["dataset_id"], mapping)
    return {r.dimension: r.score for r in scored.collect()}


def test_half_of_completeness(spark):
    scores = scores_of(spark, [("a", NOT_NULL, True), ("a", ROWS, False)])
    assert scores == {d: 0.5 if d == "completeness" else 1.0 for d in DIMENSIONS}


def test_unknown_types_score_one(spark):
    assert scores_of(spark, [("a", "expect_magic", False)]) == dict.fromkeys(DIMENSIONS, 1.0)


def test_missing_success_is_failure_and_custom_map_replaces(spark):
    assert scores_of(spark, [("a", NOT_NULL, None)])["completeness"] == 0.0
    custom = scores_of(spark, [("a", NOT_NULL, False), ("a", "expect_magic", False)], {"expect_magic": "timeliness"})
    assert custom["completeness"] == 1.0 and custom["timeliness"] == 0.0


def test_overall_score(spark):
    scores = [("a", d, s) for d, s in zip(DIMENSIONS, (1.0, 0.5, 1.0, 1.0, 1.0, 0.0))]
    frame = spark.createDataFrame(scores, "dataset_id string, dimension string, score double")
    listed = spark.createDataFrame([("a",), ("b",)], "dataset_id string")
    assert rows(overall_score(frame, ["dataset_id"], listed)) == [("a", 0.75), ("b", 0.0)]


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from(["a", "b"]), st.sampled_from([*KINDS, "other"]),
                          st.sampled_from([True, False, None])), min_size=1, max_size=30))
def test_report_equals_plain_model(spark, data):
    expected = {}
    for dataset in {r[0] for r in data}:
        checks = [(KINDS[k].dimension, bool(s)) for d, k, s in data if d == dataset and k in KINDS]
        scores = []
        for dimension in DIMENSIONS:
            own = [s for d, s in checks if d == dimension]
            scores.append(sum(own) / len(own) if own else 1.0)
        expected[dataset] = sum(scores) / 6
    report = quality_report(spark.createDataFrame(data, RESULT), ["dataset_id"]).collect()
    assert {r.dataset_id: pytest.approx(r.dq_score) for r in report} == expected
    assert sum(r.expectations_total for r in report) == len(data)
    assert sum(r.expectations_passed for r in report) == sum(bool(r[2]) for r in data)


def test_report_names(spark):
    frame = spark.createDataFrame([("default", "gold"), ("finance", "gold")], "s string, l string")
    assert rows(frame.select(report_name(F.col("s"), F.col("l")))) == [("default_gold",), ("finance",)]


def test_latest_report(spark):
    frame = spark.createDataFrame([("a", 1, 0.1), ("a", 3, 0.3), ("b", 2, 0.2)], "d string, created_at int, s double")
    assert rows(latest_report(frame, ["d"])) == [("a", 3, 0.3), ("b", 2, 0.2)]


def test_layer_thresholds_and_sla(spark):
    datasets = spark.createDataFrame([("a", "gold"), ("b", "moon")], "dataset_id string, layer string")
    thresholds = layer_thresholds(datasets, ["dataset_id"])
    assert {(r.dataset_id, r.threshold) for r in thresholds.collect()} == {("a", 0.95), ("b", 0.70)}
    assert thresholds.count() == 12 and threshold_table(spark).count() == 24
    scores = spark.createDataFrame(
        [("a", "completeness", 0.95), ("a", "magic", 0.0)], "dataset_id string, dimension string, score double"
    )
    checked = check_sla(scores, thresholds.where("dataset_id = 'a'"), ["dataset_id"])
    assert {r.dimension: r.passes for r in checked.collect()} == {d: d == "completeness" for d in DIMENSIONS}


def test_review(spark):
    day = dt.datetime(2024, 1, 1)
    slas = spark.createDataFrame([("a", 90, None), ("b", 90, day), ("c", 91, day)],
                                 "id string, review_interval_days int, last_reviewed_at timestamp")
    due = due_for_review(slas, F.lit(day + dt.timedelta(days=90)))
    assert rows(due, "id") == [("a",), ("b",)]


def test_contract_sla(spark):
    measured = spark.createDataFrame([("a", 5.0, 0.99), ("b", 50.0, 0.5)], "d string, age_hours double, completeness double")
    terms = spark.createDataFrame([("a", None, 0.95), ("b", 24.0, 0.95), ("c", None, 0.95)],
                                  "d string, freshness_hours double, completeness_threshold double")
    got = contract_sla(measured, terms, ["d"])
    assert rows(got, "d", "freshness_met", "completeness_met") == [
        ("a", True, True), ("b", False, False), ("c", True, False)]


REQUEST = "domain_id string, dataset_id string, source_layer string, target_layer string, dq_score double"


@pytest.mark.parametrize(("source", "target", "score", "verdict"), [
    ("bronze", "silver", 0.7, "promoted"),
    ("bronze", "silver", 0.699, "refused"),
    ("silver", "gold", 0.85, "decision_required"),
    ("gold", "platinum", 0.94, "refused"),
    ("gold", "platinum", 0.95, "decision_required"),
    ("bronze", "gold", 1.0, "invalid"),
    ("silver", "bronze", 1.0, "invalid"),
    ("bronze", "bronze", 1.0, "invalid"),
    ("landing", "silver", 1.0, "invalid"),
])
def test_promotion_verdicts(spark, source, target, score, verdict):
    got = promotion_verdicts(spark.createDataFrame([("d", "x", source, target, score)], REQUEST)).first()
    assert got.verdict == verdict and got.promoted is (verdict == "promoted")


def test_nothing_checked_is_visible(spark):
    request = spark.createDataFrame([("d", "x", "gold", "platinum", 1.0)], REQUEST).withColumn(
        "expectations_total", F.lit(0)
    )
    assert "nothing checked" in promotion_verdicts(request).first().reason


def test_decision_ids_repeat_and_differ(spark):
    data = [("d", "x", "silver", "gold", 0.9), ("d", "y", "silver", "gold", 0.9), ("d", "z", "bronze", "silver", 0.9)]
    decided = with_decision_id(promotion_verdicts(spark.createDataFrame(data, REQUEST)))
    ids = {r.dataset_id: r.governance_decision_id for r in decided.collect()}
    assert ids["z"] is None and ids["x"] != ids["y"] and len(ids["x"]) == 36
    assert ids == {r.dataset_id: r.governance_decision_id for r in decided.collect()}


def test_promotion_copies_only_promoted(spark, tmp_path):
    root = str(tmp_path)
    for name in ("good", "bad"):
        write_dataset(spark.range(3), root, "bronze", "sales", name)
    requests = [("sales", "good", "bronze", "silver", 0.9), ("sales", "bad", "bronze", "silver", 0.1)]
    promote(root, promotion_verdicts(spark.createDataFrame(requests, REQUEST)))
    assert read_dataset(spark, root, "silver", "sales", "good").count() == 3
    with pytest.raises(FileNotFoundError):
        read_dataset(spark, root, "silver", "sales", "bad")


def test_promotion_can_be_repeated(spark, tmp_path):
    """A finished copy is not made again, an unfinished one is, and a new source version is a copy of its own."""
    import shutil

    root = str(tmp_path)
    request = spark.createDataFrame([("sales", "x", "bronze", "silver", 0.9)], REQUEST)
    write_dataset(spark.range(3), root, "bronze", "sales", "x")
    for _ in range(2):
        promote(root, promotion_verdicts(request))
        assert versions(spark, root, "silver", "sales", "x") == [1]
    (tmp_path / "silver/sales/x/v=1/_SUCCESS").unlink()  # the copy was cut short
    for extra in (tmp_path / "silver/sales/x/v=1").glob("._SUCCESS.crc"):
        extra.unlink()
    promote(root, promotion_verdicts(request))
    assert versions(spark, root, "silver", "sales", "x") == [1] and read_dataset(spark, root, "silver", "sales", "x").count() == 3
    write_dataset(spark.range(5), root, "bronze", "sales", "x")
    promote(root, promotion_verdicts(request))
    promote(root, promotion_verdicts(request))
    assert versions(spark, root, "silver", "sales", "x") == [1, 2]
    assert read_dataset(spark, root, "silver", "sales", "x").count() == 5
    ledger = spark.read.parquet(f"{root}/promotions")
    assert rows(ledger, "source_version", "version") == [(1, 1), (2, 2)]
    shutil.rmtree(tmp_path / "silver/sales/x/v=2")  # and one whose folder is gone
    promote(root, promotion_verdicts(request))
    assert versions(spark, root, "silver", "sales", "x") == [1, 2]


def test_likely_keys_alone_are_counted(spark):
    from govspark.operators.profile import key_candidates, likely_keys

    frame = spark.range(5000).selectExpr("id", "id % 50 AS few", "nullif(id, 7) AS holes", "id DIV 2 AS pairs", "CASE WHEN id = 9 THEN 8 ELSE id END AS nearly")
    assert likely_keys(frame, frame.columns) == ["id", "nearly"]
    told = key_candidates(frame, frame.columns)
    assert rows(told.where("key_candidate"), "column") == [("id",)]
    plan = told._jdf.queryExecution().executedPlan().toString()
    assert set(re.findall(r"struct\(column, (\w+), v,", plan)) == {"id", "nearly"}  # what the exact pass shuffles
    assert rows(key_candidates(frame.limit(0), ["id"]), "key_candidate", "rows") == [(False, 0)]


def test_versions_are_kept(spark, tmp_path):
    root = str(tmp_path)
    assert write_dataset(spark.range(1), root, "bronze", "d", "x") == 1
    (tmp_path / "bronze/d/x/v=2").mkdir()  # a write that failed half-way
    assert write_dataset(spark.range(2), root, "bronze", "d", "x") == 3
    assert versions(spark, root, "bronze", "d", "x") == [1, 3]
    assert read_dataset(spark, root, "bronze", "d", "x").count() == 2
    assert read_dataset(spark, root, "bronze", "d", "x", 1).count() == 1
    with pytest.raises(ValueError, match="layer"):
        write_dataset(spark.range(1), root, "moon", "d", "x")


def test_keep_first(spark):
    frame = spark.createDataFrame([(1, 2, "b"), (1, 1, "a"), (2, 5, None)], "k int, o int, v string")
    assert rows(keep_first(frame, ["k"], ["o"])) == [(1, 1, "a"), (2, 5, None)]


def test_profile_exact_and_sketch(spark):
    frame = spark.createDataFrame([(1, "a"), (2, None), (2, "b"), (None, "b")], "x int, y string")
    exact = {r.column: r for r in profile_table(frame, exact=True).collect()}
    assert exact["x"].distinct_values == 2 and exact["x"].completeness == 0.75 and exact["x"].mean == pytest.approx(5 / 3)
    assert exact["y"].minimum == "a" and exact["y"].mean is None and exact["y"].above_five_percent_null
    sketch = {r.column: r.distinct_values for r in profile_table(frame).collect()}
    assert sketch == {"x": 2, "y": 2}


def test_profile_consistency_and_summary(spark):
    data = [("1", 1), ("2", 2), ("x", 3), ("yes", None), (None, 4)]
    profile = profile_table(spark.createDataFrame(data, "v string, n int"))
    assert {r.column: r.consistency for r in profile.collect()} == {"v": 0.5, "n": 1.0}
    summary = profile_summary(profile).first()
    assert (summary.rows, summary.columns, summary.columns_above_five_percent_null) == (5, 2, 2)
    assert (summary.completeness, summary.consistency) == (0.8, 0.75)


def test_infer_types(spark):
    data = [("1", "1.5", "true", "2024-01-01", "a", None), ("2", "2", "no", "2024-01-02 10:00:00", "1x", None)]
    frame = spark.createDataFrame(data, "i string, f string, b string, t string, x string, n string")
    kinds = {r.column: (r.inferred_type, r.key_candidate) for r in infer_types(frame, frame.columns).collect()}
    assert kinds == {"i": ("integer", True), "f": ("float", True), "b": ("boolean", True), "t": ("timestamp", True),
                     "x": ("text", True), "n": ("text", False)}
