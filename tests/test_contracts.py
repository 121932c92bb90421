from __future__ import annotations

import pytest

from govspark.functions.urns import PII_TAG
from govspark.operators import catalog as c
from govspark.operators import contracts as k
from govspark.sources import config
from tests.conftest import rows

COLUMN = "dataset_id string, name string, data_type string, nullable boolean"


def columns(spark, *data):
    return spark.createDataFrame(list(data), COLUMN)


def test_validation(spark):
    expected = columns(spark, ("a", "id", "string", False), ("a", "x", "float", True), ("b", "id", "string", False),
                       ("c", "id", "string", True))
    actual = columns(spark, ("a", "id", "integer", True), ("a", "extra", "string", True), ("b", "id", "string", True),
                     ("b", "more", "string", True))
    issues = rows(k.contract_issues(expected, actual, ["dataset_id"]), "dataset_id", "name", "issue")
    assert issues == [("a", "extra", "extra_column"), ("a", "id", "type_mismatch"), ("a", "x", "missing_column"),
                      ("b", "more", "extra_column"), ("c", "id", "missing_column")]
    verdicts = dict(rows(k.contract_validation(expected, actual, ["dataset_id"]), "dataset_id", "valid"))
    assert verdicts == {"a": False, "b": True, "c": False}


OLD = [("a", "id", "string", False), ("a", "x", "float", True), ("a", "y", "float", False)]


@pytest.mark.parametrize(("new", "changes", "action"), [
    (OLD, [], "no_change"),
    ([OLD[0], OLD[1], ("a", "y", "float", True)], [], "no_change"),
    ([*OLD, ("a", "n", "string", True)], [("n", "nullable_column_added", False)], "auto_approve"),
    ([*OLD, ("a", "n", "string", False)], [("n", "non_nullable_column_added", True)], "raci_approval"),
    (OLD[:2], [("y", "column_removed", True)], "veto_eligible"),
    ([OLD[0], ("a", "x", "string", False), OLD[2]],
     [("x", "nullable_to_non_nullable", True), ("x", "type_changed", True)], "raci_approval"),
    ([OLD[0], ("a", "z", "float", True), OLD[2]],
     [("x", "column_removed", True), ("z", "nullable_column_added", False)], "veto_eligible"),
])
def test_changes(spark, new, changes, action):
    old = columns(spark, *OLD)
    found = k.schema_changes(old, columns(spark, *new), ["dataset_id"])
    assert rows(found, "name", "change", "breaking") == changes
    decided = k.change_actions(found, old, ["dataset_id"]).first()
    assert decided.governance_action == action
    assert decided.requires_approval is any(breaking for _, _, breaking in changes)
    assert decided.breaking_changes == sum(breaking for _, _, breaking in changes)


def test_type_change_reports_both_types(spark):
    found = k.schema_changes(columns(spark, OLD[1]), columns(spark, ("a", "x", "string", True)), ["dataset_id"]).first()
    assert (found.old_type, found.new_type) == ("float", "string")


def test_history_skips_gaps_and_slices(spark):
    snapshots = spark.createDataFrame(
        [("c", v, n, "string", True) for v, names in {1: "ab", 5: "abd", 1700: "ad", 2900: "ad"}.items() for n in names],
        "contract string, version long, name string, data_type string, nullable boolean",
    )
    found = rows(k.version_changes(snapshots, ["contract"], slice_size=10), "version", "name", "change")
    assert found == [(1700, "b", "column_removed"), (5, "d", "nullable_column_added")]
    assert rows(k.latest_versions(snapshots, ["contract"])) == [("c", 2900)]


def test_drift(spark):
    frame = spark.createDataFrame([(["a", "b", "b"], ["c", "a", "aa"]), (["x"], ["x"])], "expected array<string>, actual array<string>")
    got = [(r.added, r.removed, r.has_drift) for r in k.schema_drift(frame).collect()]
    assert got == [(["aa", "c"], ["b"], True), ([], [], False)]


RULES = [
    c.Rule("pii", "on_ingest", "column matches cpf|mail", "set_pii=true", True),
    c.Rule("never", "on_ingest", "table matches x", "set_pii=true", True),
    c.Rule("tag", "on_ingest", "column matches date", "add_tag=temporal", True),
    c.Rule("suggest", "on_promotion", "column matches amount", "add_tag=financial", False),
]


def test_rules(spark):
    frame = spark.createDataFrame([("t", "CPF"), ("t", "mail_date"), ("t", "Amount_x"), ("t", "id")], "dataset_id string, name string")
    actions = c.rule_actions(frame, RULES)
    assert rows(actions, "rule", "name", "auto_approve") == [
        ("pii", "CPF", "True"), ("pii", "mail_date", "True"), ("suggest", "Amount_x", "False"), ("tag", "mail_date", "True")]
    applied = {r.name: (r.is_pii, r.tags, r.proposals) for r in c.apply_rules(actions, ["dataset_id", "name"]).collect()}
    assert applied == {"CPF": (True, [], []), "mail_date": (True, ["temporal"], []),
                       "Amount_x": (False, [], ["add_tag=financial"])}
    assert c.rule_actions(frame, RULES, "on_promotion").count() == 1
    assert c.rule_actions(frame, []).count() == 0


CATALOG = ("dataset_id string, name string, domain_id string, owner_id string, quality_score double, "
           "schema_fields array<struct<name:string,data_type:string,description:string,is_pii:boolean,is_nullable:boolean>>")  # fmt: skip


def catalog(spark):
    fields = [("id", "string", "Key \"x\"", False, False), ("cpf", "string", "", True, True)]
    return spark.createDataFrame([("sales/a", "Orders", "sales", "ann", 0.5, fields)], CATALOG)


def test_catalog_round_trip(spark):
    exported = c.change_record(catalog(spark), "lake")
    record = exported.first()
    assert record.urn == "urn:li:dataset:(urn:li:dataPlatform:lake,sales/a,PROD)" and PII_TAG in record.record
    back = c.catalog_rows(exported).first()
    assert (back.dataset_id, back.name, back.domain_id) == ("sales/a", "Orders", "unknown")
    assert [tuple(f) for f in back.schema_fields] == [
        ("id", "string", "Key \"x\"", False, False), ("cpf", "string", "", True, True)]


def test_catalog_import_defaults(spark):
    texts = ['{"entityUrn": "plain"}', '{"entityUrn": "u:(p,d,PROD)", "aspect": {"fields": [{"globalTags": {"tags": [{"tag": "z"}]}}]}}', "{}"]
    got = c.catalog_rows(spark.createDataFrame([(t,) for t in texts], "record string")).collect()
    assert [(r.dataset_id, r.name) for r in got] == [("plain", "plain"), ("d", "d"), ("", "")]
    assert got[0].schema_fields == [] and tuple(got[1].schema_fields[0]) == ("", "string", "", True, True)


def test_lineage_dataset(spark):
    got = c.lineage_datasets(catalog(spark), "lake").first()
    assert (got.namespace, got.name) == ("lake://sales", "sales/a")
    assert got.facets.dataQualityMetrics.qualityScore == 0.5
    assert got.facets.ownership.owners[0].type == "DATAOWNER"
    assert [f.type for f in got.facets.schema.fields] == ["string", "string"]


def test_upsert_and_search(spark):
    ddl = "dataset_id string, name string, updated_at int"
    known = spark.createDataFrame([("a", "Old", 1), ("b", "Kept", 5)], ddl)
    changes = spark.createDataFrame([("a", "New", 1), ("b", "Stale", 4), ("c", "Added", 1)], ddl)
    merged = c.upsert(known, changes)
    assert rows(merged) == [("a", "New", 1), ("b", "Kept", 5), ("c", "Added", 1)]
    assert rows(c.search(merged, "AD", ["name"]), "dataset_id") == [("c",)]
    assert c.search(merged, "", ["name"], limit=2).count() == 2


CONTRACT = """
dataset_id: finance/revenue
domain_id: finance
owner_id: team
schema:
  columns:
    - {name: id, data_type: string, nullable: false}
    - {name: cpf, data_type: string, pii: true}
  primary_key: [id]
sla: {freshness_hours: 24}
"""


def test_contract_files(spark, tmp_path):
    (tmp_path / "b.yaml").write_text(CONTRACT)
    (tmp_path / "a.yaml").write_text("name: named\ndataset_id: d\ndomain_id: x\nowner_id: o\n")
    (tmp_path / "note.txt").write_text("not a contract")
    first, second = config.read_contracts(spark, str(tmp_path)).collect()
    assert (first.name, first.completeness_threshold, first.columns) == ("named", 0.95, [])
    assert (second.name, second.freshness_hours, second.primary_key) == ("b", 24.0, ["id"])
    listed = config.contract_columns(config.read_contracts(spark, str(tmp_path)))
    assert rows(listed, "name", "nullable", "pii") == [("cpf", True, True), ("id", False, False)]


@pytest.mark.parametrize("text", ["- a list", "dataset_id: x\ndomain_id: y\n"])
def test_broken_contract_is_an_error(spark, tmp_path, text):
    (tmp_path / "a.yaml").write_text(text)
    with pytest.raises(Exception, match="mapping|owner_id"):
        config.read_contracts(spark, str(tmp_path)).collect()


def test_suites(spark, tmp_path):
    (tmp_path / "finance.yaml").write_text("expectations:\n- {expectation_type: e1, kwargs: {column: x}}\n")
    (tmp_path / "default_gold.yaml").write_text("expectations:\n- expectation_type: e2\n- expectation_type: e3\n")
    (tmp_path / "empty.yaml").write_text("[]")
    suites = config.read_suites(spark, str(tmp_path))
    assert [e.kind for e in config.pick_suite(suites, "finance", "gold")] == ["e1"]
    assert [e.kind for e in config.pick_suite(suites, "default", "gold")] == ["e2", "e3"]
    assert config.pick_suite(suites, "empty", "gold") == [] == config.pick_suite(suites, "default", "platinum")
    datasets = spark.createDataFrame([("a", "finance", "gold"), ("b", "zzz", "gold"), ("c", "empty", "gold"), ("d", "zzz", "x")],
                                     "dataset_id string, suite string, layer string")
    resolved = config.resolve_suites(datasets, config.suite_table(spark, suites), ["dataset_id"])
    assert rows(resolved, "dataset_id", "expectation_type") == [("a", "e1"), ("b", "e2"), ("b", "e3")]
    assert len(config.default_suites()["default_gold"]) == 7


def test_rule_files(spark, tmp_path):
    (tmp_path / "r.yaml").write_text("rules:\n- {name: n, trigger: t, condition: column matches x, action: set_pii=true}\n")
    assert config.read_rules(spark, str(tmp_path / "r.yaml"))[0].auto_approve is False
    assert config.read_rules(spark, str(tmp_path / "missing.yaml")) == []
