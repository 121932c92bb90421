"""Compliance of systems derived from suppliers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from govspark.operators import compliance as c
from govspark.plans import derived as d
from govspark.plans.registry import query, table
from govspark.vocabulary import DIMENSIONS, JURISDICTION_FRAMEWORKS

# Flags in a fixed order; flag number i of a system is set when (key + i) % 3 = 0.
FLAGS = (
    "has_legal_basis", "supports_data_subject_rights", "has_dpo", "has_security_measures",
    "has_lawful_basis", "supports_data_portability", "has_dpia", "has_adequacy_decision", "transfers_outside_eu",
    "has_risk_management_system", "has_data_governance", "has_human_oversight", "has_transparency_info",
    "has_ai_governance_policy", "has_ai_risk_mapping", "has_ai_metrics", "has_ai_incident_response",
    "has_ai_scope_definition", "has_ai_leadership_commitment", "has_ai_risk_assessment",
    "has_ai_lifecycle_management", "has_ai_monitoring",
    "has_audit_trail", "has_access_controls", "has_change_management", "has_data_retention_policy",
)
LEVELS = ("high", "limited", "minimal")
JURISDICTIONS = ("br", "eu", "us", "global", "jp")
AREAS = tuple(c.KNOWLEDGE_AREAS)


def _members(values: tuple[str, ...], modulus: int) -> Column:
    """The values whose position is not a multiple of the system's own modulus."""
    kept = [F.when((F.col("s_suppkey") + i) % modulus != 0, F.lit(v)) for i, v in enumerate(values)]
    return F.filter(F.array(*kept), lambda v: v.isNotNull())


def _members_sql(values: tuple[str, ...], modulus: int) -> str:
    kept = ", ".join(f"CASE WHEN (s_suppkey + {i}) % {modulus} <> 0 THEN '{v}' END" for i, v in enumerate(values))
    return f"list_filter([{kept}], lambda x: x IS NOT NULL)"


def systems(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("s_suppkey")
    flags = [
        F.when(key % 11 != 0, (key + i + F.floor(key / 7) * i) % 3 != 0).alias(flag) for i, flag in enumerate(FLAGS)
    ]
    return table(spark, folder, "supplier").select(
        F.concat(F.lit("sys_"), key).alias("system_id"),
        *flags,
        F.when(key % 13 != 0, d.pick(LEVELS, key % 3)).alias("ai_risk_level"),
        d.pick(JURISDICTIONS, key % 5).alias("jurisdiction"),
        _members(AREAS, 4).alias("implemented_areas"),
        F.when(key % 5 != 0, _members(DIMENSIONS, 3)).alias("quality_dimensions"),
    )


SYSTEMS_SQL = f"""systems AS (
  SELECT 'sys_' || s_suppkey AS system_id,
         {", ".join(f"CASE WHEN s_suppkey % 11 <> 0 THEN (s_suppkey + {i} + (s_suppkey // 7) * {i}) % 3 <> 0 END AS {f}" for i, f in enumerate(FLAGS))},
         CASE WHEN s_suppkey % 13 <> 0 THEN {d.sql_list(LEVELS)}[CAST(s_suppkey % 3 AS INTEGER) + 1] END AS ai_risk_level,
         {d.sql_list(JURISDICTIONS)}[CAST(s_suppkey % 5 AS INTEGER) + 1] AS jurisdiction,
         {_members_sql(AREAS, 4)} AS implemented_areas,
         CASE WHEN s_suppkey % 5 <> 0 THEN {_members_sql(DIMENSIONS, 3)} END AS quality_dimensions
  FROM supplier)"""


def _condition(rule: c.Rule) -> str:
    flag = rule.flag.replace("array_contains", "list_contains")
    test = f"NOT coalesce({flag}, false)"
    return test if rule.scope is None else f"{test} AND coalesce({rule.scope}, false)"


def _framework_sql(framework: c.Framework) -> str:
    """The rows of one framework: raised rules as text, score and verdict, stated per framework in plain SQL."""
    ids = ", ".join(f"CASE WHEN {_condition(r)} THEN '{r.rule_id}' END" for r in framework.rules)
    critical = [r for r in framework.rules if r.severity == "critical"]
    total = len(framework.rules)
    if framework.name == "eu_ai_act":
        total = "CASE WHEN ai_risk_level = 'high' THEN 4 ELSE 1 END"
    raised = " + ".join(f"CAST({_condition(r)} AS INTEGER)" for r in framework.rules)
    score = f"({total} - ({raised})) / CAST({total} AS DOUBLE)"
    if framework.passes == "no_critical":
        passed = " AND ".join(f"NOT ({_condition(r)})" for r in critical)
    else:
        passed = f"{score} >= {framework.passes}"
    return (
        f"SELECT system_id, '{framework.name}' AS framework, {passed} AS passed, round({score}, 6)::DOUBLE AS score, "
        f"concat_ws(',', {ids}) AS findings FROM systems"
    )


ALL_SQL = f"""{SYSTEMS_SQL}, assessed AS (
{" UNION ALL ".join(_framework_sql(f) for f in c.FRAMEWORK_RULES.values())})"""


def _flat(results: DataFrame) -> DataFrame:
    ids = F.transform("findings", lambda f: f["rule_id"])
    return results.withColumns({"score": F.round("score", 6), "findings": F.array_join(ids, ",")})


def _register(name: str, framework: str) -> None:
    @query(name, f"WITH {SYSTEMS_SQL} {_framework_sql(c.FRAMEWORK_RULES[framework])}")
    def assessed(spark: SparkSession, folder: str) -> DataFrame:
        return _flat(c.assess(systems(spark, folder), "system_id", framework))


for _name, _framework in {
    "compliance_lgpd": "lgpd", "compliance_gdpr": "gdpr", "compliance_ai_act": "eu_ai_act",
    "compliance_nist": "nist_ai_rmf", "compliance_iso42001": "iso_42001", "compliance_sox": "sox",
    "compliance_dmbok": "dama_dmbok",
}.items():
    _register(_name, _framework)


@query("compliance_all", f"WITH {ALL_SQL} SELECT * FROM assessed")
def compliance_all(spark: SparkSession, folder: str) -> DataFrame:
    return _flat(c.assess_all(systems(spark, folder), "system_id"))


_SEVERITY_ROWS = ", ".join(f"('{r.rule_id}', '{r.severity}')" for f in c.FRAMEWORK_RULES.values() for r in f.rules)


@query("findings_by_severity", f"""WITH {ALL_SQL}, severities(rule_id, severity) AS (VALUES {_SEVERITY_ROWS})
SELECT framework, severity, count(*) AS findings
FROM (SELECT framework, unnest(string_split(findings, ',')) AS rule_id FROM assessed WHERE findings <> '')
JOIN severities USING (rule_id) GROUP BY 1, 2""")
def findings_by_severity(spark: SparkSession, folder: str) -> DataFrame:
    return c.findings_by_severity(c.assess_all(systems(spark, folder), "system_id"), "system_id")


_WANTED = "CASE jurisdiction " + " ".join(
    f"WHEN '{k}' THEN {d.sql_list(v)}" for k, v in JURISDICTION_FRAMEWORKS.items()
) + " END"


@query("applicable_compliance", f"""WITH {ALL_SQL}, wanted AS (
  SELECT system_id, jurisdiction, unnest({_WANTED}) AS framework FROM systems)
SELECT system_id, jurisdiction, framework, passed, score FROM wanted JOIN assessed USING (system_id, framework)""")
def applicable_compliance(spark: SparkSession, folder: str) -> DataFrame:
    rows = systems(spark, folder)
    results = c.assess_all(rows, "system_id").select("system_id", "framework", "passed", F.round("score", 6).alias("score"))
    return c.applicable(results, rows, "system_id")


_CAPABILITIES = (*c.HIGH_RISK, *c.LIMITED_RISK, "sql_generation", "data_profiling", "search", "ranking", "forecasting")


def ai_systems(spark: SparkSession, folder: str) -> DataFrame:
    """A system per customer with two capabilities; some have none."""
    key, size = F.col("c_custkey"), len(_CAPABILITIES)
    return table(spark, folder, "customer").select(
        F.concat(F.lit("ai_"), key).alias("system_id"),
        F.when(
            key % 9 != 0, F.array(d.pick(_CAPABILITIES, key % size), d.pick(_CAPABILITIES, (key * 3 + 11) % size))
        ).alias("capabilities"),
    )


_AI_SQL = f"""ai AS (
  SELECT 'ai_' || c_custkey AS system_id, CASE WHEN c_custkey % 9 <> 0 THEN
    [{d.sql_list(_CAPABILITIES)}[CAST(c_custkey % {len(_CAPABILITIES)} AS INTEGER) + 1],
     {d.sql_list(_CAPABILITIES)}[CAST((c_custkey * 3 + 11) % {len(_CAPABILITIES)} AS INTEGER) + 1]] END AS capabilities
  FROM customer),
risk AS (
  SELECT system_id, CASE WHEN list_has_any(capabilities, {d.sql_list(c.HIGH_RISK)}) THEN 'high'
    WHEN list_has_any(capabilities, {d.sql_list(c.LIMITED_RISK)}) THEN 'limited' ELSE 'minimal' END AS ai_risk_level FROM ai)"""


@query("ai_risk", f"WITH {_AI_SQL} SELECT * FROM risk")
def ai_risk(spark: SparkSession, folder: str) -> DataFrame:
    return ai_systems(spark, folder).select("system_id", c.ai_risk(F.col("capabilities")).alias("ai_risk_level"))


@query("ai_controls", f"""WITH {_AI_SQL}
SELECT system_id, ai_risk_level, unnest(CASE ai_risk_level WHEN 'high' THEN {d.sql_list(c.RISK_CONTROLS['high'])}
  WHEN 'limited' THEN {d.sql_list(c.RISK_CONTROLS['limited'])} ELSE {d.sql_list(c.RISK_CONTROLS['minimal'])} END) AS control
FROM risk""")
def ai_controls(spark: SparkSession, folder: str) -> DataFrame:
    return c.ai_controls(ai_risk(spark, folder))


_COVERAGE = ("full", "partial", "none", "full", "planned", "full")


@query("dmbok_coverage", f"""
SELECT 'org_' || o_custkey AS organisation, round(avg(CASE level WHEN 'full' THEN 1.0 WHEN 'partial' THEN 0.5 ELSE 0.0 END), 6)::DOUBLE
       AS overall_coverage
FROM (SELECT o_custkey, {d.sql_list(_COVERAGE)}[CAST(o_orderkey % 6 AS INTEGER) + 1] AS level FROM orders) GROUP BY 1
UNION ALL
SELECT 'org_' || c_custkey, 0.0 FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)""")
def dmbok_coverage(spark: SparkSession, folder: str) -> DataFrame:
    """Organisations are customers, their areas the orders; some have no areas."""
    areas = table(spark, folder, "orders").select(
        F.concat(F.lit("org_"), "o_custkey").alias("organisation"),
        d.pick(_COVERAGE, F.col("o_orderkey") % 6).alias("coverage_level"),
    )
    listed = table(spark, folder, "customer").select(F.concat(F.lit("org_"), "c_custkey").alias("organisation"))
    covered = c.coverage(areas, ["organisation"], organisations=listed)
    return covered.withColumn("overall_coverage", F.round("overall_coverage", 6))
