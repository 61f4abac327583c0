"""Queries for alert lifecycle, audit trail and profile feedback."""

from pyspark.sql import functions as F

from fraudloom.operators import lifecycle, profiles
from fraudloom.registry.core import query, sql

TICK = "2024-01-15 00:00:00"
AS_OF = "2024-01-15 12:00:00"


def at(text: str):
    return F.expr(f"TIMESTAMP_NTZ '{text}'")


WINNERS = """
    SELECT alert_id, action_id, target_status, actor, acted_at, resolution_reason FROM (
      SELECT *, row_number() OVER (PARTITION BY alert_id ORDER BY acted_at, action_id) AS rn
      FROM actions_fx WHERE target_status IN ('APPROVED', 'BLOCKED', 'FALSE_POSITIVE')) x WHERE rn = 1"""
OUTCOMES = """
    SELECT a.action_id, a.alert_id, a.target_status, a.actor, a.acted_at, a.resolution_reason, m.severity, m.status AS alert_status,
      CASE WHEN a.target_status = 'PENDING' THEN 'invalid_target' WHEN m.id IS NULL THEN 'not_found'
           WHEN m.status IN ('PENDING', 'ESCALATED_EMAIL', 'ESCALATED_SLACK') AND w.action_id = a.action_id THEN 'applied'
           ELSE 'conflict' END AS outcome
    FROM actions_fx a LEFT JOIN alerts_mix m ON m.id = a.alert_id LEFT JOIN winners w ON w.alert_id = a.alert_id"""


@query("first_valid_action", sql("actions_fx", """
    SELECT alert_id, action_id, target_status, actor, acted_at, resolution_reason FROM winners""", winners=WINNERS))
def winners(t):
    return lifecycle.first_valid_action(t.actions_fx)


@query("actions_to_alerts", sql("actions_fx alerts_mix", """
    SELECT action_id, alert_id, alert_status, outcome FROM outcomes""", winners=WINNERS, outcomes=OUTCOMES))
def outcomes(t):
    return lifecycle.actions_to_alerts(t.alerts_mix, t.actions_fx).select(
        "action_id", "alert_id", "alert_status", "outcome")


@query("resolve_alerts", sql("actions_fx alerts_mix", """
    SELECT m.id, CASE WHEN o.alert_id IS NOT NULL THEN o.target_status ELSE m.status END AS status,
      CASE WHEN o.alert_id IS NOT NULL THEN o.actor ELSE m.resolved_by END AS resolved_by,
      CASE WHEN o.alert_id IS NOT NULL THEN o.acted_at ELSE m.resolved_at END AS resolved_at,
      CASE WHEN o.alert_id IS NOT NULL THEN o.resolution_reason ELSE m.resolution_reason END AS resolution_reason
    FROM alerts_mix m LEFT JOIN outcomes o ON o.alert_id = m.id AND o.outcome = 'applied'""",
    winners=WINNERS, outcomes=OUTCOMES))
def resolved(t):
    return lifecycle.resolve_alerts(t.alerts_mix, t.actions_fx)[0].select(
        "id", "status", "resolved_by", "resolved_at", "resolution_reason")


DUE = f"""
    SELECT id, 'email' AS level FROM (SELECT * FROM alerts_mix WHERE status = 'PENDING'
      AND created_at <= TIMESTAMP '{TICK}' - INTERVAL 5 MINUTE) e
    UNION ALL
    SELECT id, 'slack' FROM (SELECT * FROM alerts_mix WHERE status = 'ESCALATED_EMAIL'
      AND escalated_email_at <= TIMESTAMP '{TICK}' - INTERVAL 10 MINUTE) s"""


@query("due_alerts", sql("alerts_mix", f"""
    SELECT id FROM alerts_mix WHERE status = 'PENDING' AND created_at <= TIMESTAMP '{TICK}' - INTERVAL 5 MINUTE
    ORDER BY created_at, id LIMIT 50"""))
def due(t):
    return lifecycle.due_alerts(t.alerts_mix, at(TICK), "PENDING", "created_at", 5).select("id")


@query("escalation_tick", sql("alerts_mix", f"""
    SELECT m.id, CASE d.level WHEN 'email' THEN 'ESCALATED_EMAIL' WHEN 'slack' THEN 'ESCALATED_SLACK' ELSE m.status END AS status,
      CASE WHEN d.level = 'email' THEN TIMESTAMP '{TICK}' ELSE m.escalated_email_at END AS escalated_email_at,
      CASE WHEN d.level = 'slack' THEN TIMESTAMP '{TICK}' ELSE m.escalated_slack_at END AS escalated_slack_at
    FROM alerts_mix m LEFT JOIN due d ON d.id = m.id""", due=DUE))
def tick(t):
    return lifecycle.escalation_tick(t.alerts_mix, at(TICK))[0].select(
        "id", "status", "escalated_email_at", "escalated_slack_at")


@query("escalations", sql("alerts_mix", """
    SELECT m.id, d.level, m.severity FROM alerts_mix m JOIN due d ON d.id = m.id""", due=DUE))
def made(t):
    return lifecycle.escalation_tick(t.alerts_mix, at(TICK))[1].select("id", "level", "severity")


def _replay(limit: str | None) -> str:
    actions = f"AND acted_at <= {limit}" if limit else ""
    alerts = f"WHERE a.created_at <= {limit}" if limit else ""
    reached = f"AND {{due}} <= {limit}" if limit else ""
    email, slack = "a.created_at + INTERVAL 5 MINUTE", "a.created_at + INTERVAL 15 MINUTE"
    return f"""
    SELECT id, CASE WHEN target_status IS NOT NULL THEN target_status WHEN slack_at IS NOT NULL THEN 'ESCALATED_SLACK'
        WHEN email_at IS NOT NULL THEN 'ESCALATED_EMAIL' ELSE 'PENDING' END AS status,
      email_at AS escalated_email_at, slack_at AS escalated_slack_at, actor AS resolved_by, acted_at AS resolved_at
    FROM (SELECT a.id, w.target_status, w.actor, w.acted_at,
        CASE WHEN (w.acted_at IS NULL OR w.acted_at > {email}) {reached.format(due=email)} THEN {email} END AS email_at,
        CASE WHEN (w.acted_at IS NULL OR w.acted_at > {slack}) {reached.format(due=slack)} THEN {slack} END AS slack_at
      FROM alerts_fx a LEFT JOIN (
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY alert_id ORDER BY acted_at, action_id) AS rn FROM actions_fx
          WHERE target_status <> 'PENDING' {actions}) x WHERE rn = 1) w ON w.alert_id = a.id {alerts}) r"""


REPLAY_COLUMNS = ["id", "status", "escalated_email_at", "escalated_slack_at", "resolved_by", "resolved_at"]


@query("lifecycle_replay", sql("alerts_fx actions_fx", _replay(None)))
def replay(t):
    return lifecycle.lifecycle_replay(t.alerts_fx, t.actions_fx).select(*REPLAY_COLUMNS)


@query("lifecycle_replay_as_of", sql("alerts_fx actions_fx", _replay(f"TIMESTAMP '{AS_OF}'")))
def replay_as_of(t):
    return lifecycle.lifecycle_replay(t.alerts_fx, t.actions_fx, at(AS_OF)).select(*REPLAY_COLUMNS)


@query("audit_rows", sql("actions_fx alerts_mix", f"""
    SELECT actor, concat('alert.', lower(target_status)) AS action, 'Alert' AS entity_type, CAST(alert_id AS VARCHAR) AS entity_id,
      '{{"status":"UNRESOLVED"}}' AS before,
      concat('{{"status":"', target_status, '","resolved_by":"', actor, '","resolution_reason":',
        coalesce('"' || resolution_reason || '"', 'null'), '}}') AS after, acted_at AS created_at
    FROM outcomes WHERE outcome = 'applied'
    UNION ALL
    SELECT 'system:escalation_scheduler', concat('alert.escalated_', level), 'Alert', CAST(id AS VARCHAR),
      CASE level WHEN 'email' THEN '{{"status":"PENDING"}}' ELSE '{{"status":"ESCALATED_EMAIL"}}' END,
      concat('{{"status":"ESCALATED_', upper(level), '","escalated_', level, '_at":"2024-01-15T00:00:00.000000"}}'), TIMESTAMP '{TICK}'
    FROM due""", winners=WINNERS, outcomes=OUTCOMES, due=DUE))
def audits(t):
    applied = lifecycle.actions_to_alerts(t.alerts_mix, t.actions_fx)
    _, escalated = lifecycle.escalation_tick(t.alerts_mix, at(TICK))
    return lifecycle.audit_rows(applied, escalated).drop("id", "correlation_id")


@query("rule_change_audit", sql("rules_tab rules_next", """
    SELECT coalesce(o.id, n.id) AS entity_id,
      CASE WHEN o.id IS NULL THEN 'RULE_CREATE' WHEN n.id IS NULL THEN 'RULE_DELETE' ELSE 'RULE_UPDATE' END AS action,
      'django_admin' AS actor, o.severity AS old_severity, n.severity AS new_severity
    FROM rules_tab o FULL OUTER JOIN rules_next n ON n.id = o.id
    WHERE o.id IS NULL OR n.id IS NULL OR o.severity <> n.severity OR o.enabled <> n.enabled"""))
def rule_changes(t):
    return lifecycle.rule_change_audit(t.rules_tab, t.rules_next).select(
        "entity_id", "action", "actor",
        F.get_json_object("before", "$.severity").alias("old_severity"),
        F.get_json_object("after", "$.severity").alias("new_severity"))


# --------------------------------------------------------------------------------- profiles


@query("compensate_profiles", sql("risk_profiles_fx fp_fx", """
    SELECT coalesce(p.user_id, f.user_id) AS user_id,
      CAST(CASE WHEN p.user_id IS NULL THEN 0 WHEN f.n IS NULL THEN p.risk_score WHEN p.total_alerts = 0 THEN 0
        ELSE least(1, 0.25 * greatest(0, p.total_alerts - p.false_positive_count - f.n)) END AS DECIMAL(5,4)) AS risk_score,
      coalesce(p.total_alerts, 0) AS total_alerts,
      CAST(coalesce(p.false_positive_count, 0) + coalesce(f.n, 0) AS INT) AS false_positive_count
    FROM risk_profiles_fx p FULL OUTER JOIN (SELECT user_id, count(*) AS n FROM fp_fx GROUP BY user_id) f
      ON f.user_id = p.user_id"""))
def compensated(t):
    return profiles.compensate_profiles(t.risk_profiles_fx, t.fp_fx).drop("last_recalculated_at")


EVENTS = """
    SELECT user_id, created_at AS ts, 0 AS kind, id AS event_id FROM alerts_fx
    UNION ALL SELECT user_id, resolved_at, 1, event_id FROM fp_fx"""
RUNNING = """
    SELECT e.*, coalesce(p.risk_score, 0) AS s0,
      CAST(coalesce(p.total_alerts, 0) + sum(1 - kind) OVER w AS BIGINT) AS total_alerts,
      CAST(coalesce(p.false_positive_count, 0) + sum(kind) OVER w AS BIGINT) AS false_positive_count
    FROM ev e LEFT JOIN risk_profiles_fx p ON p.user_id = e.user_id
    WINDOW w AS (PARTITION BY e.user_id ORDER BY ts, kind, event_id ROWS UNBOUNDED PRECEDING)"""


@query("running_profile", sql("alerts_fx fp_fx risk_profiles_fx", """
    SELECT user_id, event_id, kind, total_alerts, false_positive_count FROM run""", ev=EVENTS, run=RUNNING))
def running(t):
    return profiles.running_profile(t.alerts_fx, t.fp_fx, t.risk_profiles_fx).select(
        "user_id", "event_id", "kind", "total_alerts", "false_positive_count")


@query("profile_history", sql("alerts_fx fp_fx risk_profiles_fx", """
    SELECT user_id, ts, kind, event_id, CAST(coalesce(
      last_value(CASE WHEN kind = 1 THEN CASE WHEN total_alerts > 0
        THEN least(1, 0.25 * greatest(0, total_alerts - false_positive_count)) ELSE 0 END END IGNORE NULLS) OVER (
        PARTITION BY user_id ORDER BY ts, kind, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), s0)
      AS DECIMAL(5,4)) AS risk_score FROM run""", ev=EVENTS, run=RUNNING))
def history(t):
    return profiles.profile_history(t.alerts_fx, t.fp_fx, t.risk_profiles_fx).select(
        "user_id", "ts", "kind", "event_id", "risk_score")
