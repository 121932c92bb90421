"""Names, thresholds and tables that are part of the governance semantics.

Fixed values: results depend on these exact words and numbers.
"""

from __future__ import annotations

LAYERS = ("bronze", "silver", "gold", "platinum")
PROMOTION_THRESHOLDS = {
    ("bronze", "silver"): 0.7,
    ("silver", "gold"): 0.85,
    ("gold", "platinum"): 0.95,
}
AUTOMATIC_PROMOTIONS = (("bronze", "silver"),)

DIMENSIONS = ("completeness", "accuracy", "consistency", "timeliness", "uniqueness", "validity")
LAYER_SLA = {"bronze": 0.70, "silver": 0.85, "gold": 0.95, "platinum": 0.98}

CLASSIFICATIONS = ("public", "internal", "confidential", "restricted", "top_secret")
EPSILON = {"public": 10.0, "internal": 5.0, "confidential": 1.0, "restricted": 0.1, "top_secret": 0.01}
EPSILON_OTHERWISE = 1.0

CONTROLS = (
    "rbac",
    "encryption_at_rest",
    "encryption_in_transit",
    "pii_masking",
    "differential_privacy",
    "mfa_required",
    "audit_logging",
)
REQUIRED_CONTROLS = {
    "public": ("encryption_in_transit",),
    "internal": ("rbac", "encryption_in_transit", "audit_logging"),
    "confidential": ("rbac", "encryption_at_rest", "encryption_in_transit", "pii_masking", "audit_logging"),
    "restricted": CONTROLS,
    "top_secret": CONTROLS,
}

JURISDICTIONS = ("br", "eu", "us", "global")
RESTRICTED_JURISDICTIONS = ("eu", "br")
JURISDICTION_FRAMEWORKS = {
    "br": ("lgpd", "dama_dmbok"),
    "eu": ("gdpr", "eu_ai_act", "dama_dmbok"),
    "us": ("sox", "nist_ai_rmf", "dama_dmbok"),
    "global": ("iso_42001", "dama_dmbok"),
}
FRAMEWORKS = ("lgpd", "gdpr", "eu_ai_act", "nist_ai_rmf", "iso_42001", "sox", "dama_dmbok")

ROLE_RANK = {"accountable": 3, "responsible": 2, "consulted": 1, "informed": 0}
APPROVER_ROLES = ("responsible", "accountable")
VETO_ROLES = ("accountable", "responsible")
ROLE_PERMISSIONS = {
    "responsible": ("read", "write", "submit", "execute"),
    "accountable": ("read", "write", "approve", "reject", "veto", "escalate"),
    "consulted": ("read", "comment"),
    "informed": ("read",),
}

DECISION_TYPES = ("data_promotion", "schema_change", "access_grant", "expert_registration", "policy_change",
                  "emergency")
DECISION_STATUSES = ("pending", "awaiting_approval", "approved", "rejected", "vetoed", "escalated")
FINAL_STATUSES = ("approved", "rejected", "vetoed", "escalated")
VOTES = ("approve", "reject", "abstain")
VETO_STATUSES = ("active", "expired", "overridden")
AUDIT_EVENT_TYPES = (
    "decision_created",
    "decision_submitted",
    "approval_cast",
    "decision_approved",
    "decision_rejected",
    "veto_exercised",
    "veto_overridden",
    "veto_expired",
    "decision_escalated",
    "expert_registered",
    "expert_deregistered",
    "data_promoted",
    "role_assigned",
    "role_revoked",
)

GENESIS_HASH = "0" * 64
TOPIC_GENESIS = "genesis"

EVENT_SUBJECTS = {
    "decision_created": "governance.decisions.created",
    "decision_finalized": "governance.decisions.finalized",
    "approval_requested": "governance.approvals.requested",
    "approval_cast": "governance.approvals.cast",
    "veto_exercised": "governance.veto.exercised",
    "veto_overridden": "governance.veto.overridden",
}
RETENTION_MESSAGES = 100_000
RETENTION_DAYS = 7

DRIFT_THRESHOLD = 0.05
REVIEW_INTERVAL_DAYS = 90
VETO_HOURS = 24
EMERGENCY_VETO_HOURS = 1
