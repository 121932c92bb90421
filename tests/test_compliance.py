from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from govspark.operators import compliance as c
from govspark.plans.compliance import FLAGS
from govspark.vocabulary import DIMENSIONS
from tests.conftest import rows

DDL = "system_id string, " + ", ".join(f"{f} boolean" for f in FLAGS) + (
    ", ai_risk_level string, jurisdiction string, implemented_areas array<string>, quality_dimensions array<string>"
)


def system(spark, flags=(), level=None, areas=None, dimensions=None, jurisdiction="eu"):
    values = [True if f in flags else None for f in FLAGS]
    return spark.createDataFrame([("s", *values, level, jurisdiction, areas, dimensions)], DDL)


def check(spark, framework, *flags, **other):
    result = c.assess(system(spark, flags, **other), "system_id", framework).first()
    return result.passed, round(result.score, 6), [f.rule_id for f in result.findings]


@pytest.mark.parametrize(("framework", "flags", "other", "expected"), [
    ("lgpd", (), {}, (False, 0.0, ["LGPD-7", "LGPD-18", "LGPD-41", "LGPD-46"])),
    ("lgpd", ("has_legal_basis",), {}, (True, 0.25, ["LGPD-18", "LGPD-41", "LGPD-46"])),
    ("gdpr", ("has_lawful_basis",), {}, (True, 0.5, ["GDPR-20", "GDPR-35"])),
    ("gdpr", ("has_lawful_basis", "transfers_outside_eu"), {}, (False, 0.25, ["GDPR-20", "GDPR-35", "GDPR-45"])),
    ("gdpr", ("has_lawful_basis", "transfers_outside_eu", "has_adequacy_decision"), {}, (True, 0.5, ["GDPR-20", "GDPR-35"])),
    ("eu_ai_act", (), {}, (True, 1.0, [])),
    ("eu_ai_act", (), {"level": "limited"}, (True, 0.0, ["AI-ACT-52"])),
    ("eu_ai_act", (), {"level": "high"}, (False, 0.0, ["AI-ACT-9", "AI-ACT-10", "AI-ACT-14", "AI-ACT-52"])),
    ("eu_ai_act", ("has_risk_management_system", "has_data_governance"), {"level": "high"},
     (True, 0.5, ["AI-ACT-14", "AI-ACT-52"])),
    ("nist_ai_rmf", ("has_ai_metrics", "has_ai_risk_mapping"), {}, (True, 0.5, ["NIST-GOVERN-1", "NIST-MANAGE-1"])),
    ("nist_ai_rmf", ("has_ai_metrics",), {}, (False, 0.25, ["NIST-GOVERN-1", "NIST-MAP-1", "NIST-MANAGE-1"])),
    ("iso_42001", ("has_ai_scope_definition", "has_ai_monitoring", "has_ai_risk_assessment"), {},
     (True, 0.6, ["ISO42001-5", "ISO42001-8"])),
    ("iso_42001", ("has_ai_monitoring", "has_ai_risk_assessment"), {},
     (False, 0.4, ["ISO42001-4", "ISO42001-5", "ISO42001-8"])),
    ("sox", ("has_audit_trail", "has_access_controls"), {}, (True, 0.5, ["SOX-404-CHANGE", "SOX-802"])),
    ("sox", ("has_audit_trail",), {}, (False, 0.25, ["SOX-404-ACCESS", "SOX-404-CHANGE", "SOX-802"])),
])
def test_frameworks(spark, framework, flags, other, expected):
    assert check(spark, framework, *flags, **other) == expected


def test_dmbok(spark):
    passed, score, found = check(spark, "dama_dmbok")
    assert (passed, score, len(found)) == (False, 0.0, 17)
    areas, dimensions = list(c.KNOWLEDGE_AREAS), list(DIMENSIONS)
    assert check(spark, "dama_dmbok", areas=areas, dimensions=dimensions) == (True, 1.0, [])
    passed, score, found = check(spark, "dama_dmbok", areas=areas[1:6], dimensions=dimensions)
    assert (passed, score) == (False, round(11 / 17, 6)) and found[0] == "DAMA-DATA_GOVERNANCE"
    assert check(spark, "dama_dmbok", areas=areas[1:7], dimensions=dimensions)[0] is True  # 12 of 17
    result = c.assess(system(spark), "system_id", "dama_dmbok").first()
    assert {f.rule_id for f in result.findings if f.severity == "high"} == {
        "DAMA-DATA_GOVERNANCE", "DAMA-DATA_QUALITY", "DAMA-DATA_SECURITY"}


def test_unknown_level_and_framework(spark):
    with pytest.raises(Exception, match="unknown AI risk level"):
        check(spark, "eu_ai_act", level="severe")
    with pytest.raises(ValueError, match="registered"):
        c.assess(system(spark), "system_id", "hipaa")


def test_registry_takes_new_frameworks(spark):
    own = c.Framework("own", (c.Rule("OWN-1", "low", "has_dpo", "d", "r"),), 1.0)
    results = c.assess_all(system(spark, ("has_dpo",)), "system_id", {**c.FRAMEWORK_RULES, "own": own})
    assert results.count() == 8
    assert results.where("framework = 'own'").first().passed is True


def test_findings_and_applicable(spark):
    results = c.assess_all(system(spark), "system_id")
    counted = rows(c.findings_by_severity(results, "system_id").where("framework = 'lgpd'"))
    assert counted == [("lgpd", "critical", 1), ("lgpd", "high", 2), ("lgpd", "medium", 1)]
    wanted = c.applicable(results, system(spark), "system_id")
    assert rows(wanted, "framework") == [("dama_dmbok",), ("eu_ai_act",), ("gdpr",)]


def test_ai_risk(spark):
    data = [(["chatbot", "law_enforcement"],), (["chatbot"],), (["search"],), ([],), (None,)]
    frame = spark.createDataFrame(data, "c array<string>")
    levels = frame.select(c.ai_risk(F.col("c")).alias("ai_risk_level"))
    assert [r.ai_risk_level for r in levels.collect()] == ["high", "limited", "minimal", "minimal", "minimal"]
    assert c.ai_controls(levels.distinct()).count() == 8 + 2 + 1
    own = frame.select(c.ai_risk(F.col("c"), high=("search",)).alias("l"))
    assert [r.l for r in own.collect()] == ["limited", "limited", "high", "minimal", "minimal"]


def test_coverage(spark):
    areas = [("o", level) for level in c.DEFAULT_COVERAGE.values()] + [("p", "planned")]
    listed = spark.createDataFrame([("o",), ("p",), ("q",)], "org string")
    got = c.coverage(spark.createDataFrame(areas, "org string, coverage_level string"), ["org"], organisations=listed)
    assert {r.org: round(r.overall_coverage, 4) for r in got.collect()} == {"o": 0.8636, "p": 0.0, "q": 0.0}
