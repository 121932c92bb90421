"""Words and numbers that results depend on, written out once more, so that a slip in the tables does not stay green."""

from __future__ import annotations

import re

import pytest

from govspark import vocabulary as v
from govspark.functions.pii import TYPE_PATTERNS
from govspark.operators import compliance as c
from govspark.operators.expectations import KINDS

SEVERITIES = {
    "lgpd": "LGPD-7 critical, LGPD-18 high, LGPD-41 medium, LGPD-46 high",
    "gdpr": "GDPR-6 critical, GDPR-20 high, GDPR-35 medium, GDPR-45 critical",
    "eu_ai_act": "AI-ACT-9 critical, AI-ACT-10 critical, AI-ACT-14 high, AI-ACT-52 medium",
    "nist_ai_rmf": "NIST-GOVERN-1 high, NIST-MAP-1 medium, NIST-MEASURE-1 medium, NIST-MANAGE-1 high",
    "iso_42001": "ISO42001-4 medium, ISO42001-5 medium, ISO42001-6 high, ISO42001-8 high, ISO42001-9 medium",
    "sox": "SOX-302 critical, SOX-404-ACCESS critical, SOX-404-CHANGE high, SOX-802 high",
}


@pytest.mark.parametrize("name", SEVERITIES)
def test_rule_severities(name):
    assert ", ".join(f"{r.rule_id} {r.severity}" for r in c.FRAMEWORK_RULES[name].rules) == SEVERITIES[name]


def test_knowledge_areas_of_high_severity():
    high = [r.flag for r in c.FRAMEWORK_RULES["dama_dmbok"].rules if r.severity == "high"]
    assert len(high) == 3 and all(any(a in f for f in high) for a in ("data_governance", "data_quality", "data_security"))


def test_dimensions_of_expectations():
    assert {name.removeprefix("expect_"): kind.dimension for name, kind in KINDS.items()} == {
        "column_values_to_not_be_null": "completeness", "table_row_count_to_be_between": "completeness",
        "column_values_to_be_between": "accuracy", "column_mean_to_be_between": "accuracy",
        "column_values_to_match_regex": "validity", "column_values_to_be_in_set": "validity",
        "column_values_to_be_of_type": "validity", "column_values_to_be_unique": "uniqueness",
        "compound_columns_to_be_unique": "uniqueness", "column_pair_values_to_be_equal": "consistency",
        "column_values_to_match_strftime_format": "timeliness"}


@pytest.mark.parametrize(("column", "kind"), [
    ("cnpj_empresa", "cpf"), ("my_cpf", None), ("customer_E_Mail", "email"), ("mobile", "phone"), ("zip_code", "address"),
    ("postal", "address"), ("first_name", "name"), ("user_full_name", None), ("dob", "birth_date"), ("iban", "financial"),
    ("passport_no", "document"), ("amount", None), ("email_phone", "email"),
])
def test_types_of_names(column, kind):
    assert next((k for k, p in TYPE_PATTERNS if re.search(p, column, re.I)), None) == kind


def test_controls_by_classification():
    everything = {"rbac", "encryption_at_rest", "encryption_in_transit", "pii_masking", "differential_privacy", "mfa_required",
                  "audit_logging"}
    assert {k: set(x) for k, x in v.REQUIRED_CONTROLS.items()} == {
        "public": {"encryption_in_transit"}, "internal": {"rbac", "encryption_in_transit", "audit_logging"},
        "confidential": everything - {"differential_privacy", "mfa_required"}, "restricted": everything,
        "top_secret": everything}


def test_subjects_ranks_and_hours():
    assert v.EVENT_SUBJECTS == {
        "decision_created": "governance.decisions.created", "decision_finalized": "governance.decisions.finalized",
        "approval_requested": "governance.approvals.requested", "approval_cast": "governance.approvals.cast",
        "veto_exercised": "governance.veto.exercised", "veto_overridden": "governance.veto.overridden"}
    assert v.ROLE_RANK == {"accountable": 3, "responsible": 2, "consulted": 1, "informed": 0}
    assert set(v.VETO_ROLES) == {"accountable", "responsible"}
    assert (v.VETO_HOURS, v.EMERGENCY_VETO_HOURS) == (24, 1)
