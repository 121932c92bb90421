"""Compliance frameworks as rule rows, evaluated over one wide row per assessed system.

Flags are nullable booleans; null counts as false. Every framework is a projection: no shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from govspark.vocabulary import DIMENSIONS, JURISDICTION_FRAMEWORKS


@dataclass(frozen=True)
class Rule:
    """A finding is raised when ``flag`` is not set, within ``scope`` (a condition on the row, default always)."""

    rule_id: str
    severity: str
    flag: str
    description: str
    recommendation: str
    scope: str | None = None


@dataclass(frozen=True)
class Framework:
    """``passes`` is either ``no_critical`` or the lowest score that passes."""

    name: str
    rules: tuple[Rule, ...]
    passes: str | float
    total: Callable[[], Column] | None = None


# Rule ids, severities, flags and texts of the frameworks.
LGPD = Framework("lgpd", (
    Rule("LGPD-7", "critical", "has_legal_basis", "No legal basis for data processing",
         "Document legal basis under LGPD Art. 7"),
    Rule("LGPD-18", "high", "supports_data_subject_rights", "Data subject rights not implemented",
         "Implement access, correction, deletion, portability per Art. 18"),
    Rule("LGPD-41", "medium", "has_dpo", "No Data Protection Officer (DPO/Encarregado) designated",
         "Designate an Encarregado per Art. 41"),
    Rule("LGPD-46", "high", "has_security_measures", "Security measures not documented",
         "Implement and document security measures per Art. 46"),
), "no_critical")

GDPR = Framework("gdpr", (
    Rule("GDPR-6", "critical", "has_lawful_basis", "No lawful basis for data processing",
         "Document lawful basis under GDPR Art. 6"),
    Rule("GDPR-20", "high", "supports_data_portability", "Data portability not supported",
         "Implement data export in machine-readable format"),
    Rule("GDPR-35", "medium", "has_dpia", "No Data Protection Impact Assessment conducted",
         "Conduct DPIA for high-risk processing activities"),
    Rule("GDPR-45", "critical", "has_adequacy_decision", "Cross-border transfer without adequacy decision",
         "Ensure adequate safeguards for international data transfers", scope="transfers_outside_eu"),
), "no_critical")

_HIGH = "coalesce(ai_risk_level, 'minimal') = 'high'"
EU_AI_ACT = Framework("eu_ai_act", (
    Rule("AI-ACT-9", "critical", "has_risk_management_system", "High-risk AI system lacks risk management system",
         "Implement continuous risk management per Art. 9", scope=_HIGH),
    Rule("AI-ACT-10", "critical", "has_data_governance", "High-risk AI system lacks data governance measures",
         "Establish data governance for training/validation data", scope=_HIGH),
    Rule("AI-ACT-14", "high", "has_human_oversight", "No human oversight mechanism for high-risk AI",
         "Implement human-in-the-loop oversight mechanisms", scope=_HIGH),
    Rule("AI-ACT-52", "medium", "has_transparency_info", "AI system transparency requirements not met",
         "Provide clear information about AI system capabilities and limitations",
         scope="ai_risk_level in ('high', 'limited')"),
), "no_critical", total=lambda: F.when(F.expr(_HIGH), 4).otherwise(1))

NIST_AI_RMF = Framework("nist_ai_rmf", (
    Rule("NIST-GOVERN-1", "high", "has_ai_governance_policy", "No AI governance policies and procedures established",
         "Define organizational AI risk management policies (GOVERN 1.1-1.7)"),
    Rule("NIST-MAP-1", "medium", "has_ai_risk_mapping", "AI system context and risk not mapped",
         "Map AI system context, stakeholders, and risk (MAP 1.1-1.6)"),
    Rule("NIST-MEASURE-1", "medium", "has_ai_metrics", "No AI performance and risk metrics defined",
         "Define quantitative metrics for AI trustworthiness (MEASURE 1.1-1.3)"),
    Rule("NIST-MANAGE-1", "high", "has_ai_incident_response", "No AI incident response plan",
         "Establish AI risk response and monitoring (MANAGE 1.1-1.4)"),
), 0.5)

ISO_42001 = Framework("iso_42001", (
    Rule("ISO42001-4", "medium", "has_ai_scope_definition", "AI management system scope not defined",
         "Define scope, interested parties, and AIMS boundaries (Clause 4)"),
    Rule("ISO42001-5", "medium", "has_ai_leadership_commitment", "No leadership commitment to AI management",
         "Establish AI policy and management responsibility (Clause 5)"),
    Rule("ISO42001-6", "high", "has_ai_risk_assessment", "No AI risk assessment process",
         "Implement AI risk assessment and treatment (Clause 6)"),
    Rule("ISO42001-8", "high", "has_ai_lifecycle_management", "No AI system lifecycle management",
         "Implement operational planning and control for AI systems (Clause 8)"),
    Rule("ISO42001-9", "medium", "has_ai_monitoring", "No AI performance monitoring and evaluation",
         "Establish monitoring, measurement, and internal audit (Clause 9)"),
), 0.6)

SOX = Framework("sox", (
    Rule("SOX-302", "critical", "has_audit_trail", "No immutable audit trail for financial data changes",
         "Implement hash-chained audit log per SOX Section 302"),
    Rule("SOX-404-ACCESS", "critical", "has_access_controls", "Inadequate access controls for financial reporting data",
         "Enforce RBAC and separation of duties per SOX Section 404"),
    Rule("SOX-404-CHANGE", "high", "has_change_management",
         "No formal change management process for financial data pipelines",
         "Implement RACI-based approval for schema and pipeline changes"),
    Rule("SOX-802", "high", "has_data_retention_policy", "No data retention policy (SOX requires 7 years)",
         "Configure retention policies: audit logs >= 7 years"),
), "no_critical")

# Knowledge areas with what covers them; three of them are severe.
KNOWLEDGE_AREAS = {
    "data_governance": "approvals, vetoes, audit",
    "data_quality": "expectation suites, six dimensions, thresholds",
    "metadata_management": "dataset catalog",
    "data_architecture": "medallion layers",
    "data_modeling": "data contracts and schema validation",
    "data_storage": "versioned layer storage",
    "data_security": "access policies and masking",
    "data_integration": "audit topic and lineage events",
    "reference_data": "enriched catalog",
    "data_warehousing": "layer promotion",
    "document_management": "not covered yet",
}
SEVERE_AREAS = ("data_governance", "data_quality", "data_security")


def _member(array: str, word: str) -> str:
    return f"array_contains({array}, '{word}')"


DMBOK = Framework("dama_dmbok", tuple(
    Rule(f"DAMA-{area.upper()}", "high" if area in SEVERE_AREAS else "medium", _member("implemented_areas", area),
         f"DAMA knowledge area not implemented: {area}", f"Implement: {covered}")
    for area, covered in KNOWLEDGE_AREAS.items()
) + tuple(
    Rule(f"DAMA-DQ-{dimension.upper()}", "medium", _member("quality_dimensions", dimension),
         f"Quality dimension not measured: {dimension}", f"Add {dimension} quality checks to expectation suites")
    for dimension in DIMENSIONS
), 0.7)

FRAMEWORK_RULES: dict[str, Framework] = {
    f.name: f for f in (LGPD, GDPR, EU_AI_ACT, NIST_AI_RMF, ISO_42001, SOX, DMBOK)
}

RESULT = (
    "framework string, passed boolean, score double, findings array<struct<rule_id:string, severity:string, "
    "description:string, recommendation:string>>"
)


def _broken(rule: Rule) -> Column:
    test = ~F.coalesce(F.expr(rule.flag), F.lit(False))
    return test & F.coalesce(F.expr(rule.scope), F.lit(False)) if rule.scope else test


def _assessment(framework: Framework) -> Column:
    """Struct (framework, passed, score, findings) for the row."""
    broken = [_broken(rule) for rule in framework.rules]
    raised = [
        F.when(test, F.struct(
            F.lit(rule.rule_id).alias("rule_id"), F.lit(rule.severity).alias("severity"),
            F.lit(rule.description).alias("description"), F.lit(rule.recommendation).alias("recommendation"),
        ))
        for rule, test in zip(framework.rules, broken)
    ]
    findings = F.filter(F.array(*raised), lambda f: f.isNotNull())
    total = framework.total() if framework.total else F.lit(len(framework.rules))
    score = (total - reduce(Column.__add__, [test.cast("int") for test in broken])) / total
    if framework.passes == "no_critical":
        critical = [test for rule, test in zip(framework.rules, broken) if rule.severity == "critical"]
        passed = ~reduce(Column.__or__, critical, F.lit(False))
    else:
        passed = score >= F.lit(framework.passes)
    return F.struct(
        F.lit(framework.name).alias("framework"), passed.alias("passed"), score.alias("score"),
        findings.alias("findings"),
    )


def assess(systems: DataFrame, key: str, framework: str,
           registry: Mapping[str, Framework] = FRAMEWORK_RULES) -> DataFrame:
    """Assess every system against one framework."""
    if framework not in registry:
        raise ValueError(f"no framework {framework!r} registered")
    return assess_all(systems, key, {framework: registry[framework]})


def assess_all(systems: DataFrame, key: str, registry: Mapping[str, Framework] = FRAMEWORK_RULES) -> DataFrame:
    """One row per system and framework, from a single scan.

    An unknown AI risk level is an error, not a pass.
    """
    checked = systems
    if "eu_ai_act" in registry:
        known = F.coalesce("ai_risk_level", F.lit("minimal")).isin("high", "limited", "minimal")
        checked = systems.withColumn(
            "ai_risk_level",
            F.when(known, F.col("ai_risk_level")).otherwise(
                F.raise_error(F.concat(F.lit("unknown AI risk level: "), F.col("ai_risk_level")))
            ),
        )
    results = F.array(*[_assessment(f) for f in registry.values()])
    return checked.select(key, F.explode(results).alias("r")).select(key, "r.*")


def findings(results: DataFrame, key: str) -> DataFrame:
    return results.select(key, "framework", F.explode("findings").alias("f")).select(key, "framework", "f.*")


def findings_by_severity(results: DataFrame, key: str) -> DataFrame:
    return findings(results, key).groupBy("framework", "severity").agg(F.count("*").alias("findings"))


def applicable(results: DataFrame, systems: DataFrame, key: str) -> DataFrame:
    """Results of the frameworks that the system's jurisdiction calls for (``systems``: key, jurisdiction)."""
    wanted = reduce(
        lambda chain, item: chain.when(F.col("jurisdiction") == item[0], F.array(*[F.lit(f) for f in item[1]])),
        list(JURISDICTION_FRAMEWORKS.items()),
        F.when(F.lit(False), F.array(F.lit(""))),
    )
    needed = systems.select(key, "jurisdiction", F.explode(wanted).alias("framework"))
    return needed.join(results, [key, "framework"])


# Capabilities that make a system high or limited risk.
HIGH_RISK = ("biometric_identification", "critical_infrastructure", "education_scoring", "employment_decisions",
             "essential_services", "law_enforcement", "migration_control")
LIMITED_RISK = ("chatbot", "emotion_recognition", "deepfake_generation", "content_generation")
# Controls by risk level.
RISK_CONTROLS = {
    "high": ("risk_management_system", "data_governance", "technical_documentation", "record_keeping",
             "transparency_info", "human_oversight", "accuracy_robustness", "conformity_assessment"),
    "limited": ("transparency_info", "user_notification"),
    "minimal": ("transparency_info",),
}


def ai_risk(capabilities: Column, high: tuple[str, ...] = HIGH_RISK, limited: tuple[str, ...] = LIMITED_RISK) -> Column:
    """Highest risk level that any capability indicates."""
    has = lambda words: F.coalesce(
        F.arrays_overlap(capabilities, F.array(*[F.lit(w) for w in words])), F.lit(False)
    )
    return F.when(has(high), "high").when(has(limited), "limited").otherwise("minimal")


def ai_controls(systems: DataFrame, level: str = "ai_risk_level") -> DataFrame:
    """One row per system and control its risk level needs."""
    chain = F.when(F.lit(False), F.array(F.lit("")))
    for name, controls in RISK_CONTROLS.items():
        chain = chain.when(F.col(level) == name, F.array(*[F.lit(c) for c in controls]))
    return systems.withColumn("control", F.explode(chain.otherwise(F.array(F.lit("transparency_info")))))


def coverage(areas: DataFrame, keys: list[str], level: str = "coverage_level",
             organisations: DataFrame | None = None) -> DataFrame:
    """Mean coverage of the knowledge areas: full 1, partial 0.5, none or unknown 0; no areas give 0."""
    weight = F.when(F.col(level) == "full", 1.0).when(F.col(level) == "partial", 0.5).otherwise(0.0)
    means = areas.groupBy(*keys).agg(F.avg(weight).alias("overall_coverage"))
    if organisations is None:
        return means
    listed = organisations.select(*keys).distinct().join(means, keys, "left")
    return listed.fillna(0.0, ["overall_coverage"])


# Default coverage of the eleven knowledge areas (9.5 of 11).
DEFAULT_COVERAGE = {
    "Data Governance": "full",
    "Data Quality": "full",
    "Metadata Management": "full",
    "Data Architecture": "full",
    "Data Modeling & Design": "full",
    "Data Storage & Operations": "full",
    "Data Security": "full",
    "Data Integration & Interoperability": "full",
    "Reference & Master Data": "partial",
    "Data Warehousing & BI": "full",
    "Document & Content Management": "none",
}
