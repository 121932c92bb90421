"""Decisions, votes, vetoes and roles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from govspark.operators import decisions as g
from govspark.operators.records import record_tests, split_records
from govspark.plans import derived as d
from govspark.plans.registry import query, table


def _governance(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    return d.decisions(spark, folder), d.votes(spark, folder), d.roles(spark, folder), d.vetoes(spark, folder)


@query("list_decisions", f"""WITH {d.DECISIONS_SQL}
SELECT id, title, status, domain_id FROM decisions
WHERE domain_id = '2-HIGH' AND status = 'awaiting_approval' ORDER BY created_at DESC, id LIMIT 50 OFFSET 10""")
def list_decisions(spark: SparkSession, folder: str) -> DataFrame:
    page = g.list_decisions(d.decisions(spark, folder), "2-HIGH", "awaiting_approval", 50, 10)
    return page.select("id", "title", "status", "domain_id")


@query("one_decision_votes", f"""WITH {d.VOTES_SQL}
SELECT id, voter_id, vote FROM votes WHERE decision_id = (SELECT max(o_orderkey) // 2 FROM orders)""")
def one_decision_votes(spark: SparkSession, folder: str) -> DataFrame:
    """Votes of the decision in the middle of the key range."""
    chosen = table(spark, folder, "orders").agg(F.floor(F.max("o_orderkey") / 2)).scalar()
    votes = d.votes(spark, folder)
    return votes.where(F.col("decision_id") == chosen).orderBy("voted_at", "id").select("id", "voter_id", "vote")


@query("roles_of_domain", f"WITH {d.ASSIGNMENTS_SQL} SELECT id, user_id, role FROM assignments WHERE domain_id = '5-LOW'")
def roles_of_domain(spark: SparkSession, folder: str) -> DataFrame:
    return g.roles_of(d.assignments(spark, folder), domain_id="5-LOW").select("id", "user_id", "role")


_LAYER = "[NULL, 'bronze', 'silver', 'gold'][CAST({} % 4 AS INTEGER) + 1]"


@query("fold_promotion", f"""WITH {d.DECISIONS_SQL}, flat AS (
  SELECT id, {_LAYER.format("id")} AS s, {_LAYER.format("(id // 4)")} AS t,
         CASE WHEN id % 5 = 0 THEN 'restricted' END AS c FROM decisions)
SELECT id, s IS NOT NULL AND t IS NOT NULL AS nested, CASE WHEN s IS NOT NULL AND t IS NOT NULL THEN s END AS source_layer,
       CASE WHEN s IS NOT NULL AND t IS NOT NULL THEN t END AS target_layer,
       CASE WHEN s IS NOT NULL AND t IS NOT NULL THEN c END AS data_classification
FROM flat""")
def fold_promotion(spark: SparkSession, folder: str) -> DataFrame:
    """Fold the flat columns into the struct and unfold it again."""
    layers = F.array(F.lit(None).cast("string"), F.lit("bronze"), F.lit("silver"), F.lit("gold"))
    flat = d.decisions(spark, folder).select(
        "id",
        F.get(layers, (F.col("id") % 4).cast("int")).alias("source_layer"),
        F.get(layers, (F.floor(F.col("id") / 4) % 4).cast("int")).alias("target_layer"),
        F.when(F.col("id") % 5 == 0, "restricted").alias("data_classification"),
    )
    folded = g.fold_promotion(flat).withColumn("nested", F.col("promotion").isNotNull())
    return g.unfold_promotion(folded)


@query("record_constraints", f"""WITH {d.DECISIONS_SQL}, broken AS (
  SELECT id, concat_ws(',', CASE WHEN id % 19 = 0 THEN 'title' END, CASE WHEN id % 17 = 0 THEN 'status' END,
         CASE WHEN length(domain_id) < 6 THEN 'source_layer' END) AS violations FROM decisions)
SELECT id, violations FROM broken WHERE violations <> ''""")
def record_constraints(spark: SparkSession, folder: str) -> DataFrame:
    """Quarantine of decisions: titles too long or missing, unknown status, unknown layer."""
    key = F.col("id")
    title = F.when(key % 38 == 0, F.repeat(F.lit("x"), F.lit(501))).when(key % 19 == 0, F.lit(None)).otherwise(F.col("title"))
    records = d.decisions(spark, folder).withColumns({
        "title": title,
        "status": F.when(key % 17 == 0, "closed").otherwise(F.col("status")),
        "source_layer": F.when(F.length("domain_id") < 6, "landing"),
    })
    _, quarantine = split_records(records, record_tests(records, "decision"))
    return quarantine.select("id", F.array_join("violations", ",").alias("violations"))


@query("valid_reports", """
SELECT count(*) AS valid FROM orders WHERE o_totalprice <= 100000 AND length(o_orderpriority) > 0""")
def valid_reports(spark: SparkSession, folder: str) -> DataFrame:
    """Reports whose score lies between 0 and 1."""
    reports = table(spark, folder, "orders").select(
        F.col("o_orderpriority").alias("dataset_id"), (F.col("o_totalprice") / 100000).alias("dq_score")
    )
    valid, _ = split_records(reports, record_tests(reports, "quality_report"))
    return valid.agg(F.count("*").alias("valid"))


@query("role_conflicts", f"""WITH {d.ASSIGNMENTS_SQL}
SELECT id, user_id, domain_id, role FROM assignments
QUALIFY row_number() OVER (PARTITION BY user_id, domain_id ORDER BY assigned_at, id) > 1""")
def role_conflicts(spark: SparkSession, folder: str) -> DataFrame:
    return g.role_conflicts(d.assignments(spark, folder)).select("id", "user_id", "domain_id", "role")


@query("active_roles", f"""WITH {d.ASSIGNMENTS_SQL}
SELECT id, user_id, domain_id, role FROM assignments
WHERE id NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')""")
def active_roles(spark: SparkSession, folder: str) -> DataFrame:
    revoked = table(spark, folder, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("id"))
    return g.active_roles(d.assignments(spark, folder), revoked).select("id", "user_id", "domain_id", "role")


_FIRST_SQL = f"""{d.GOVERNANCE_SQL}, seen AS (
  SELECT v.*, d.domain_id, d.status, r.role FROM votes v LEFT JOIN decisions d ON d.id = v.decision_id
  LEFT JOIN roles r ON r.user_id = v.voter_id AND r.domain_id = d.domain_id),
firsts AS (
  SELECT * FROM seen WHERE status = 'awaiting_approval' AND role IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY decision_id, voter_id ORDER BY voted_at, id) = 1),
required AS (
  SELECT domain_id, count(*) AS required FROM roles WHERE role IN ('responsible', 'accountable') GROUP BY 1),
ordered AS (SELECT *, row_number() OVER (ORDER BY voted_at, id) AS seq FROM votes),
closing AS (
  SELECT f.decision_id, min(CASE WHEN f.vote = 'reject' THEN o.seq END) AS reject_seq,
         count(*) FILTER (WHERE f.vote = 'approve' AND f.role IN ('responsible', 'accountable')) AS approvals,
         max(CASE WHEN f.vote = 'approve' AND f.role IN ('responsible', 'accountable') THEN o.seq END) AS last_approval,
         max(q.required) AS required
  FROM firsts f JOIN ordered o ON o.id = f.id AND o.decision_id = f.decision_id AND o.voter_id = f.voter_id
    AND o.voted_at = f.voted_at
  LEFT JOIN required q ON q.domain_id = f.domain_id GROUP BY 1),
closed AS (
  SELECT decision_id, reject_seq, approvals, CASE WHEN approvals = required THEN last_approval END AS approve_seq
  FROM closing)"""


_VOTES_SQL = f"""{_FIRST_SQL}, {d.JUDGED_VETOES_SQL}, numbered AS (
  SELECT s.*, o.seq, least(c.reject_seq, c.approve_seq) AS closed_seq, f.id AS first_id, f.voted_at AS first_at,
         (SELECT min(x.vetoed_at) FROM stored x WHERE x.decision_id = s.decision_id) AS vetoed_at
  FROM seen s JOIN ordered o ON o.id = s.id AND o.decision_id = s.decision_id AND o.voter_id = s.voter_id
    AND o.voted_at = s.voted_at
  LEFT JOIN closed c ON c.decision_id = s.decision_id
  LEFT JOIN firsts f ON f.decision_id = s.decision_id AND f.voter_id = s.voter_id),
judged_votes AS (
  SELECT decision_id, domain_id, id, voter_id, role AS voter_role, vote, voted_at,
         CASE WHEN status IS NULL THEN 'unknown decision' WHEN status <> 'awaiting_approval' THEN 'not awaiting approval'
              WHEN seq > closed_seq OR voted_at > vetoed_at THEN 'decision closed' WHEN role IS NULL THEN 'no role in domain'
              WHEN id <> first_id OR voted_at <> first_at THEN 'already voted' END AS rejected_because
  FROM numbered),
accepted AS (SELECT * FROM judged_votes WHERE rejected_because IS NULL)"""


@query("valid_votes", f"""WITH {_VOTES_SQL}
SELECT decision_id, id, voter_id, voter_role, vote, rejected_because FROM judged_votes""")
def valid_votes(spark: SparkSession, folder: str) -> DataFrame:
    decisions, votes, roles, vetoes = _governance(spark, folder)
    classified = g.classify_votes(decisions, votes, roles, vetoes)
    return classified.select("decision_id", "id", "voter_id", "voter_role", "vote", "rejected_because")


@query("approval_complete", f"""WITH {_FIRST_SQL}
SELECT d.id AS decision_id, d.domain_id, coalesce(c.approvals, 0) AS required_approvals,
       coalesce(q.required, 0) AS required, coalesce(q.required > 0 AND c.approvals = q.required, false) AS complete
FROM decisions d LEFT JOIN closed c ON c.decision_id = d.id LEFT JOIN required q ON q.domain_id = d.domain_id
WHERE d.status = 'awaiting_approval'""")
def approval_complete(spark: SparkSession, folder: str) -> DataFrame:
    decisions, votes, roles, _ = _governance(spark, folder)
    return g.approval_progress(decisions, votes, roles)


_OUTCOME_SQL = f"""{_FIRST_SQL}, {d.JUDGED_VETOES_SQL},
first_veto AS (SELECT decision_id, min(vetoed_at) AS t_veto FROM stored GROUP BY 1),
timed AS (
  SELECT d.id AS decision_id, d.domain_id, c.reject_seq, c.approve_seq, r.voted_at AS t_reject, a.voted_at AS t_approve,
         v.t_veto, least(r.voted_at, a.voted_at, v.t_veto) AS closed_at
  FROM decisions d LEFT JOIN closed c ON c.decision_id = d.id
  LEFT JOIN ordered r ON r.seq = c.reject_seq LEFT JOIN ordered a ON a.seq = c.approve_seq
  LEFT JOIN first_veto v ON v.decision_id = d.id
  WHERE d.status = 'awaiting_approval'),
outcomes AS (
  SELECT decision_id, domain_id, closed_at,
         CASE WHEN closed_at IS NULL THEN 'awaiting_approval'
              WHEN t_reject = closed_at AND (approve_seq IS NULL OR reject_seq < approve_seq) THEN 'rejected'
              WHEN t_approve = closed_at THEN 'approved' ELSE 'vetoed' END AS status
  FROM timed)"""


def _outcomes(spark: SparkSession, folder: str) -> DataFrame:
    decisions, votes, roles, vetoes = _governance(spark, folder)
    return g.decision_outcomes(decisions, votes, roles, vetoes)


@query("decision_outcomes", f"""WITH {_OUTCOME_SQL}
SELECT decision_id, domain_id, status, strftime(closed_at, '%Y-%m-%d') AS closed_at FROM outcomes""")
def decision_outcomes(spark: SparkSession, folder: str) -> DataFrame:
    return _outcomes(spark, folder).withColumn("closed_at", F.date_format("closed_at", "yyyy-MM-dd"))


@query("implied_audit_events", f"""WITH {_OUTCOME_SQL}
SELECT CAST(decision_id AS VARCHAR) AS entity_id, 'decision' AS entity_type, strftime(closed_at, '%Y-%m-%d') AS occurred_at,
       CASE status WHEN 'approved' THEN 'decision_approved' WHEN 'rejected' THEN 'decision_rejected' ELSE 'veto_exercised' END AS event_type,
       CAST(step AS INTEGER) AS step
FROM outcomes JOIN (VALUES (0), (1)) s(step) ON step = 0 OR status = 'vetoed' WHERE status <> 'awaiting_approval'""")
def implied_audit_events(spark: SparkSession, folder: str) -> DataFrame:
    return g.implied_events(_outcomes(spark, folder)).withColumn("occurred_at", F.date_format("occurred_at", "yyyy-MM-dd"))


def _accepted(spark: SparkSession, folder: str) -> DataFrame:
    decisions, votes, roles, vetoes = _governance(spark, folder)
    return g.accepted_votes(decisions, votes, roles, vetoes)


_TALLY_SQL = """count(*) FILTER (WHERE vote = 'approve') AS approve_votes, count(*) FILTER (WHERE vote = 'reject') AS reject_votes,
       count(*) FILTER (WHERE vote = 'abstain') AS abstain_votes"""


@query("decision_votes", f"""WITH {_VOTES_SQL}
SELECT decision_id, id, voter_id, vote, row_number() OVER (PARTITION BY decision_id ORDER BY voted_at, id) AS position
FROM accepted""")
def decision_votes(spark: SparkSession, folder: str) -> DataFrame:
    """Stored votes of every decision in time order."""
    numbered = g.numbered_votes(_accepted(spark, folder))
    return numbered.select("decision_id", "id", "voter_id", "vote", "position")


@query("vote_tally", f"WITH {_VOTES_SQL} SELECT decision_id, {_TALLY_SQL} FROM accepted GROUP BY 1")
def vote_tally(spark: SparkSession, folder: str) -> DataFrame:
    return g.vote_tally(_accepted(spark, folder))


@query("vote_tally_by_role", f"WITH {_VOTES_SQL} SELECT domain_id, voter_role, {_TALLY_SQL} FROM accepted GROUP BY 1, 2")
def vote_tally_by_role(spark: SparkSession, folder: str) -> DataFrame:
    return g.vote_tally(_accepted(spark, folder), ["domain_id", "voter_role"])


_STATUS_OF = {"signup": "pending", "click": "awaiting_approval", "view": "awaiting_approval", "purchase": "approved",
              "error": "rejected"}
_STATUS_CASE = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _STATUS_OF.items()) + " END"


@query("invalid_transitions", f"""
WITH history AS (SELECT event_id, user_id, {_STATUS_CASE} AS status, ts FROM events),
linked AS (SELECT *, lag(status) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous_status FROM history)
SELECT event_id, user_id, previous_status, status FROM linked
WHERE NOT coalesce((previous_status IS NULL AND status = 'pending')
  OR (previous_status = 'pending' AND status = 'awaiting_approval')
  OR (previous_status = 'awaiting_approval' AND status IN ('approved', 'rejected', 'vetoed', 'escalated')), false)""")
def invalid_transitions(spark: SparkSession, folder: str) -> DataFrame:
    pairs = [F.lit(text) for pair in _STATUS_OF.items() for text in pair]
    history = table(spark, folder, "events").select(
        "event_id", "user_id", F.create_map(*pairs)[F.col("event_type")].alias("status"), "ts"
    )
    found = g.invalid_transitions(history, ["user_id"], [F.col("ts"), F.col("event_id")])
    return found.select("event_id", "user_id", "previous_status", "status")


@query("veto_refusals", f"""WITH {_FIRST_SQL}, {d.JUDGED_VETOES_SQL}
SELECT id, decision_id, vetoed_by, vetoed_by_role, refused_because FROM judged_vetoes""")
def veto_refusals(spark: SparkSession, folder: str) -> DataFrame:
    """Every veto with the reason why it is refused."""
    decisions, votes, roles, vetoes = _governance(spark, folder)
    judged = g.classify_vetoes(decisions, vetoes, roles, votes)
    return judged.select("id", "decision_id", "vetoed_by", "vetoed_by_role", "refused_because")


def stored_vetoes(spark: SparkSession, folder: str) -> DataFrame:
    """Stored vetoes as the veto table holds them later; one in nine has ended already."""
    decisions, votes, roles, vetoes = _governance(spark, folder)
    ended = F.pmod(F.col("decision_id"), F.lit(9)) == 0
    return g.stored_vetoes(decisions, vetoes, roles, votes).withColumn("status", F.when(ended, "expired").otherwise("active"))


_STORED_SQL = f"""{_FIRST_SQL}, {d.JUDGED_VETOES_SQL},
kept AS (SELECT *, CASE WHEN decision_id % 9 = 0 THEN 'expired' ELSE 'active' END AS status FROM stored)"""


@query("veto_expiry", f"""WITH {_STORED_SQL}
SELECT id, decision_id, vetoed_by, vetoed_by_role, strftime(expires_at, '%Y-%m-%d %H:%M:%S') AS expires_at FROM kept""")
def veto_expiry(spark: SparkSession, folder: str) -> DataFrame:
    return stored_vetoes(spark, folder).select(
        "id", "decision_id", "vetoed_by", "vetoed_by_role",
        F.date_format("expires_at", "yyyy-MM-dd HH:mm:ss").alias("expires_at"),
    )


@query("expired_vetoes", f"""WITH {_STORED_SQL}
SELECT id, decision_id FROM kept WHERE status = 'active' AND TIMESTAMP '1998-06-01 01:00:00' > expires_at""")
def expired_vetoes(spark: SparkSession, folder: str) -> DataFrame:
    as_of = F.lit("1998-06-01 01:00:00").cast("timestamp_ntz")
    return g.expired_vetoes(stored_vetoes(spark, folder), as_of).select("id", "decision_id")


#: Two users try to override every veto, the one with the higher number first.
_OVERRIDE_SQL = f"""{_STORED_SQL}, attempts AS (
  SELECT id AS veto_id, 'u' || ((decision_id + 3 * n) % 8 + 1) AS overridden_by, vetoed_at + INTERVAL 1 MINUTE * (2 - n) AS attempted_at
  FROM vetoes, (VALUES (0), (1)) AS tries(n)),
lawful AS (
  SELECT a.veto_id, a.overridden_by, a.attempted_at, k.vetoed_by_role, r.role AS override_role,
         CASE WHEN k.id IS NULL THEN 'unknown veto' WHEN k.status <> 'active' THEN 'veto not active'
              WHEN r.role IS NULL THEN 'no role in domain'
              WHEN (CASE r.role WHEN 'accountable' THEN 3 WHEN 'responsible' THEN 2 WHEN 'consulted' THEN 1 ELSE 0 END)
                <= (CASE k.vetoed_by_role WHEN 'accountable' THEN 3 WHEN 'responsible' THEN 2 WHEN 'consulted' THEN 1 ELSE 0 END)
              THEN 'rank too low' END AS lawless
  FROM attempts a LEFT JOIN kept k ON k.id = a.veto_id
  LEFT JOIN roles r ON r.user_id = a.overridden_by AND r.domain_id = k.domain_id),
judged AS (
  SELECT l.* EXCLUDE (lawless), CASE WHEN coalesce(lawless, '') NOT IN ('unknown veto', 'veto not active') AND EXISTS (
      SELECT 1 FROM lawful e WHERE e.veto_id = l.veto_id AND e.lawless IS NULL AND e.attempted_at < l.attempted_at)
    THEN 'veto not active' ELSE lawless END AS refused_because
  FROM lawful l)"""


def _judged(spark: SparkSession, folder: str) -> DataFrame:
    decisions, _, roles, vetoes = _governance(spark, folder)
    attempts = vetoes.withColumn("n", F.explode(F.array(F.lit(0), F.lit(1)))).select(
        F.col("id").alias("veto_id"),
        F.concat(F.lit("u"), (F.col("decision_id") + 3 * F.col("n")) % 8 + 1).alias("overridden_by"),
        (F.col("vetoed_at") + F.make_dt_interval(mins=F.lit(2) - F.col("n"))).alias("attempted_at"),
    )
    return g.judge_overrides(attempts, stored_vetoes(spark, folder), decisions, roles)


@query("veto_overrides", f"""WITH {_OVERRIDE_SQL}
SELECT veto_id, overridden_by, vetoed_by_role, override_role, refused_because FROM judged""")
def veto_overrides(spark: SparkSession, folder: str) -> DataFrame:
    return _judged(spark, folder).select("veto_id", "overridden_by", "vetoed_by_role", "override_role", "refused_because")


@query("vetoes_after_overrides", f"""WITH {_OVERRIDE_SQL}
SELECT k.id, CASE WHEN j.veto_id IS NOT NULL THEN 'overridden' ELSE k.status END AS status, j.overridden_by
FROM kept k LEFT JOIN (SELECT * FROM judged WHERE refused_because IS NULL) j ON j.veto_id = k.id""")
def vetoes_after_overrides(spark: SparkSession, folder: str) -> DataFrame:
    stored = stored_vetoes(spark, folder)
    return g.apply_overrides(stored, _judged(spark, folder)).select("id", "status", "overridden_by")
