from __future__ import annotations

import hashlib
import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from govspark.functions import masking as m
from govspark.operators import access as a
from govspark.operators.privacy import (
    classify_columns,
    detect_pii,
    epsilon_of,
    mask_table,
    noisy_metrics,
    policy_for,
    policy_from_contract,
    spent_budget,
)
from tests.conftest import rows

TEXT = st.text(alphabet=st.characters(blacklist_categories=("Cs",), blacklist_characters="\x00"), max_size=12)
SETTINGS = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def masked(spark, mask, values):
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.m for r in frame.select("i", mask(F.col("v")).alias("m")).orderBy("i").collect()]


@SETTINGS
@given(st.lists(TEXT, min_size=1, max_size=20), TEXT)
def test_hash_mask(spark, values, salt):
    assert masked(spark, lambda v: m.hash_mask(v, salt), values) == [sha(salt + v)[:16] for v in values]


def plain_partial(value: str, first: int, last: int) -> str:
    if len(value) <= first + last:
        return "*" * len(value)
    return value[:first] + "*" * (len(value) - first - last) + (value[-last:] if last else "")


@SETTINGS
@given(st.lists(TEXT, min_size=1, max_size=20), st.integers(0, 4), st.integers(0, 4))
def test_partial_mask(spark, values, first, last):
    got = masked(spark, lambda v: m.partial_mask(v, first, last), values)
    assert got == [plain_partial(v, first, last) for v in values]


def plain_email(value: str) -> str:
    if "@" not in value:
        return sha(value)[:16]
    local, domain = value.rsplit("@", 1)
    return f"{sha(local)[:8]}@{domain}"


@SETTINGS
@given(st.lists(st.lists(st.sampled_from(["a", "é", "@", ".", "Z", " "]), max_size=8).map("".join), min_size=1, max_size=20))
def test_email_mask(spark, values):
    assert masked(spark, m.email_mask, values) == [plain_email(v) for v in values]


def test_mask_cases(spark):
    assert masked(spark, m.tax_id_mask, ["12345678901", "1234", "12345", "", None]) == [
        "*******8901", "****", "*2345", "", None]
    assert masked(spark, m.email_mask, ["user@sub@domain.com", "@domain.com"])[0].endswith("@domain.com")
    assert masked(spark, m.redact, ["x", None]) == ["[REDACTED]", None]
    assert masked(spark, m.python_mask(str.upper), ["x", None]) == ["X", None]


def test_mask_table(spark):
    people = spark.createDataFrame([(1, "Ann", "a@b.c", None)], "id int, name string, mail string, cpf string")
    policy = policy_for({"name": "name", "mail": "email", "cpf": "cpf"})
    assert rows(mask_table(people, policy)) == [(1, "[REDACTED]", plain_email("a@b.c"), None)]
    with pytest.raises(ValueError, match="unknown"):
        mask_table(people, policy_for({"nothing": "name"}))


def test_contract_policy(spark):
    contract = spark.createDataFrame([("id", False), ("cpf", True), ("note", True)], "name string, pii boolean")
    policy = policy_from_contract(contract)
    people = spark.createDataFrame([(1, "12345678901", "x")], "id int, cpf string, note string")
    assert rows(mask_table(people, policy)) == [(1, "*******8901", sha("x")[:16])]


def test_budget(spark):
    frame = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", 3.0)], "g string, v double")
    spent = spent_budget(noisy_metrics(frame, "v", epsilon=0.5), ["g"])
    assert rows(spent) == [("a", 2, 1.0), ("b", 1, 0.5)]


NAMES = ["cpf", "customer_cpf", "CPF_number", "e_mail", "EMAIL", "zip_code", "name", "full_name", "charge", "social security",
         "birth-date", "dob", "mobile", "iban", "id", "rg_number", "my_ssn"]


def test_pattern_sets_disagree(spark):
    frame = spark.createDataFrame([(n,) for n in NAMES], "name string")
    types = dict(rows(detect_pii(frame), "name", "pii_type"))
    assert types == {"cpf": "cpf", "CPF_number": "cpf", "e_mail": "email", "EMAIL": "email", "zip_code": "address",
                     "full_name": "name", "dob": "birth_date", "birth-date": "birth_date", "mobile": "phone",
                     "iban": "financial", "rg_number": "document"}
    flagged = {r.name for r in classify_columns(frame).collect() if r.is_pii}
    assert flagged == {"cpf", "customer_cpf", "CPF_number", "e_mail", "EMAIL", "zip_code", "charge", "social security",
                       "birth-date", "dob", "rg_number", "my_ssn"}
    tags = {(r.is_pii, r.suggested_tag) for r in classify_columns(frame).collect()}
    assert tags == {(True, "pii"), (False, None)}


def test_epsilon(spark):
    frame = spark.createDataFrame([("public",), ("top_secret",), ("other",), (None,)], "c string")
    assert [r.e for r in frame.select(epsilon_of(F.col("c")).alias("e")).collect()] == [10.0, 0.01, 1.0, 1.0]


def test_noise_has_laplace_spread_and_is_independent(spark):
    noisy = noisy_metrics(spark.range(20000).withColumn("v", F.lit(100.0)), "v", 2.0, epsilon=0.5)
    got = [r.noisy_value - 100.0 for r in noisy.select("noisy_value").collect()]
    assert len(set(got)) == len(got)
    assert abs(sum(got) / len(got)) < 0.3
    assert sum(map(abs, got)) / len(got) == pytest.approx(4.0, rel=0.05)  # mean distance of Laplace(b) is b = 2 / 0.5
    assert sum(abs(x) > 4.0 * math.log(2) for x in got) / len(got) == pytest.approx(0.5, abs=0.02)


def test_seeded_noise_repeats(spark):
    frame = spark.createDataFrame([("a", 1.0), ("b", 1.0)], "k string, v double")
    first, second = (rows(noisy_metrics(frame, "v", seed=1, identity=["k"]), "k", "noisy_value") for _ in range(2))
    assert first == second and first[0][1] != first[1][1]


def test_controls(spark):
    frame = spark.createDataFrame([("x", "public", None), ("y", "restricted", ["rbac", "mfa_required"]), ("z", "?", [])],
                                  "d string, classification string, controls array<string>")
    gaps = rows(a.control_gaps(frame), "d", "missing_control")
    assert ("x", "encryption_in_transit") in gaps and len(gaps) == 1 + 5 + 3
    matrix = {r.d: r for r in a.control_matrix(frame).collect()}
    assert not matrix["x"].rbac and matrix["y"].differential_privacy and matrix["z"].audit_logging


def test_transfers(spark):
    data = [("eu", "eu"), ("eu", "us"), ("br", "global"), ("us", "eu"), ("global", "br"), (None, "eu"), ("jp", "us")]
    frame = spark.createDataFrame(data, "s string, t string")
    got = [r.a for r in frame.select(a.transfer_allowed(F.col("s"), F.col("t")).alias("a")).collect()]
    assert got == [True, False, False, True, True, True, True]


def test_column_visibility(spark):
    data = [(False, [], "restricted"), (True, ["informed"], "internal"), (True, ["admin"], "restricted"),
            (True, ["data_steward", "x"], "top_secret"), (True, None, "public"), (None, None, None), (True, None, None)]
    frame = spark.createDataFrame(data, "p boolean, r array<string>, c string")
    got = [r.v for r in frame.select(a.column_visible(F.col("p"), F.col("r"), F.col("c")).alias("v")).collect()]
    assert got == [True, False, True, True, True, True, False]
    table = spark.createDataFrame([(1, "x")], "id int, cpf string")
    assert a.visible_columns(table, {"cpf": True}, ["consulted"], "internal").columns == ["id"]
    assert a.visible_columns(table, {"cpf": True}, ["admin"], "internal").columns == ["id", "cpf"]


def test_access(spark):
    data = [("drop", ["admin"]), ("read", ["informed"]), ("read", []), ("read", None), ("write", ["consulted"]),
            ("write", ["responsible"]), ("write", ["accountable"]), ("drop", ["accountable"]), (None, ["informed"])]
    frame = spark.createDataFrame(data, "a string, r array<string>")
    got = [r.v for r in frame.select(a.access_allowed(F.col("a"), F.col("r")).alias("v")).collect()]
    assert got == [True, True, False, False, False, True, True, False, False]


def test_jurisdictions_and_permissions(spark):
    policies = a.jurisdiction_policy(spark.createDataFrame([("br",), ("us",), ("jp",)], "jurisdiction string")).collect()
    assert [(list(p.frameworks), p.transfer_restricted) for p in policies] == [
        (["lgpd", "dama_dmbok"], True), (["sox", "nist_ai_rmf", "dama_dmbok"], False), ([], False)]
    roles = spark.createDataFrame([("u", "consulted"), ("v", "nobody")], "user string, role string")
    assert rows(a.role_permissions(roles), "user", "permission") == [("u", "comment"), ("u", "read")]
