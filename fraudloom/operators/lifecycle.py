"""Alert lifecycle: analyst resolutions, timed escalation, audit trail."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from fraudloom.config import LifecycleConfig
from fraudloom.functions.columns import derived_id, iso_time
from fraudloom.schemas import OPEN_STATUSES, SYSTEM_ACTOR, TERMINAL_STATUSES


def _minutes(count: int) -> Column:
    return F.expr(f"INTERVAL {count} MINUTE")


def first_valid_action(actions: DataFrame) -> DataFrame:
    """The earliest action with an allowed target, per alert; with its reason where there is one."""
    valid = actions.where(F.col("target_status").isin(*TERMINAL_STATUSES))
    reason = [name for name in ("resolution_reason",) if name in actions.columns]
    return valid.groupBy("alert_id").agg(
        F.min(F.struct("acted_at", "action_id", "target_status", "actor", *reason)).alias("winner")
    ).select("alert_id", "winner.*")


def _optional(df: DataFrame, name: str) -> Column:
    """A text column that not every table has."""
    return (F.col(name) if name in df.columns else F.lit(None).cast("string")).alias(name)


def actions_to_alerts(alerts: DataFrame, actions: DataFrame) -> DataFrame:
    """Every action with its outcome: applied, conflict, not_found or invalid_target."""
    winners = first_valid_action(actions).select(
        F.col("alert_id").alias("id"), F.col("action_id").alias("_winner")
    )
    targets = alerts.select(
        "id", F.col("status").alias("alert_status"), "user_id", "transaction_id",
        "correlation_id", _optional(alerts, "severity"), F.lit(True).alias("_found"),
    ).join(winners, "id", "left").withColumnRenamed("id", "alert_id")
    open_alert = F.col("alert_status").isin(*OPEN_STATUSES)
    outcome = (
        F.when(~F.col("target_status").isin(*TERMINAL_STATUSES), "invalid_target")
        .when(F.col("_found").isNull(), "not_found")
        .when(open_alert & (F.col("action_id") == F.col("_winner")), "applied")
        .otherwise("conflict")
    )
    return actions.join(targets, "alert_id", "left").select(
        *actions.columns, "alert_status", "user_id", "transaction_id", "correlation_id",
        "severity", outcome.alias("outcome"),
    )


def resolve_alerts(alerts: DataFrame, actions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Applies one batch of analyst actions: changed alert table, outcome of every action."""
    first = first_valid_action(actions)
    winners = first.select(
        F.col("alert_id").alias("id"), F.col("target_status").alias("_target"),
        F.col("actor").alias("_actor"), F.col("acted_at").alias("_at"),
        _optional(first, "resolution_reason").alias("_reason"),
    )
    applied = F.col("status").isin(*OPEN_STATUSES) & F.col("_target").isNotNull()

    def change(name: str, value: str) -> Column:
        old = F.col(name) if name in alerts.columns else F.lit(None)
        return F.when(applied, F.col(value)).otherwise(old).alias(name)

    changed = {"status": "_target", "resolved_by": "_actor", "resolved_at": "_at",
               "resolution_reason": "_reason"}
    fixed = [c for c in alerts.columns if c not in changed]
    resolved = alerts.join(winners, "id", "left").select(
        *fixed, *[change(name, value) for name, value in changed.items()])
    return resolved, actions_to_alerts(alerts, actions)


def due_alerts(
    alerts: DataFrame, now: Column, status: str, since: str, minutes: int,
    limit: int | None = 50,
) -> DataFrame:
    """The oldest alerts of a status that waited at least `minutes`; all of them without limit."""
    due = alerts.where(_is_due(now, status, since, minutes))
    if limit is None:
        return due
    return due.orderBy(F.col(since).asc(), F.col("id").asc()).limit(limit)


def _is_due(now: Column, status: str, since: str, minutes: int) -> Column:
    return (F.col("status") == status) & (F.col(since) <= now - _minutes(minutes))


def escalation_tick(
    alerts: DataFrame, now: Column, cfg: LifecycleConfig = LifecycleConfig(),
) -> tuple[DataFrame, DataFrame]:
    """One tick at time `now`: the changed alert table and the escalations made.

    Every due alert moves, without a join. With a `batch_size` each tier takes its oldest ones.
    """
    def escalate(table: DataFrame, source: str, since: str, minutes: int, target: str, stamp: str):
        due = due_alerts(table, now, source, since, minutes, cfg.batch_size)
        if cfg.batch_size is None:
            hit = _is_due(now, source, since, minutes)
        else:
            table = table.join(due.select("id", F.lit(True).alias("_due")), "id", "left")
            hit = F.col("_due")
        return table.withColumns({
            "status": F.when(hit, target).otherwise(F.col("status")),
            stamp: F.when(hit, now).otherwise(F.col(stamp)),
        }).drop("_due"), due

    after_email, email = escalate(
        alerts, "PENDING", "created_at", cfg.email_minutes, "ESCALATED_EMAIL",
        "escalated_email_at")
    after_slack, slack = escalate(
        after_email, "ESCALATED_EMAIL", "escalated_email_at", cfg.slack_minutes,
        "ESCALATED_SLACK", "escalated_slack_at")
    fields = [
        "id", "transaction_id", "user_id", "severity", "composite_risk_score", "correlation_id"]
    made = email.select(*fields, F.lit("email").alias("level")).unionByName(
        slack.select(*fields, F.lit("slack").alias("level"))
    )
    return after_slack, made.withColumn("escalated_at", now)


def lifecycle_replay(
    alerts: DataFrame, actions: DataFrame, as_of: Column | None = None,
    cfg: LifecycleConfig = LifecycleConfig(),
) -> DataFrame:
    """State of every alert at `as_of`, from its creation time and the action log.

    An action at the very moment of an escalation wins the race.
    """
    if as_of is not None:
        actions = actions.where(F.col("acted_at") <= as_of)
        alerts = alerts.where(F.col("created_at") <= as_of)
    first = first_valid_action(actions).select(
        F.col("alert_id").alias("id"), F.col("target_status").alias("_target"),
        F.col("actor").alias("_actor"), F.col("acted_at").alias("_acted"),
    )

    def reached(due: Column) -> Column:
        before_action = F.col("_acted").isNull() | (F.col("_acted") > due)
        if as_of is not None:
            before_action = before_action & (due <= as_of)
        return F.when(before_action, due)

    email_due = F.col("created_at") + _minutes(cfg.email_minutes)
    slack_due = email_due + _minutes(cfg.slack_minutes)
    replaced = ("status", "escalated_email_at", "escalated_slack_at", "resolved_by", "resolved_at")
    kept = [c for c in alerts.columns if c not in replaced]
    return alerts.join(first, "id", "left").withColumns({
        "escalated_email_at": reached(email_due),
        "escalated_slack_at": reached(slack_due),
    }).select(
        *kept,
        F.when(F.col("_target").isNotNull(), F.col("_target"))
        .when(F.col("escalated_slack_at").isNotNull(), "ESCALATED_SLACK")
        .when(F.col("escalated_email_at").isNotNull(), "ESCALATED_EMAIL")
        .otherwise("PENDING").alias("status"),
        "escalated_email_at", "escalated_slack_at",
        F.col("_actor").alias("resolved_by"), F.col("_acted").alias("resolved_at"),
    )


def _audit(df: DataFrame, action: Column, actor: Column, ident: Column, before: Column,
           after: Column, at: Column, entity: str = "Alert") -> DataFrame:
    correlation = F.col("correlation_id") if "correlation_id" in df.columns else F.lit(None)
    return df.select(
        derived_id(F.lit("audit"), action, ident, at).alias("id"),
        actor.alias("actor"), action.alias("action"), F.lit(entity).alias("entity_type"),
        ident.cast("string").alias("entity_id"), before.alias("before"), after.alias("after"),
        correlation.cast("string").alias("correlation_id"), at.alias("created_at"),
    )


def audit_rows(applied: DataFrame, escalations: DataFrame, real_from: bool = False) -> DataFrame:
    """Audit rows of applied actions and escalations.

    Resolutions record `UNRESOLVED` as their previous status unless `real_from` is set.
    """
    was = F.col("alert_status") if real_from else F.lit("UNRESOLVED")
    resolved = _audit(
        applied.where(F.col("outcome") == "applied"),
        F.concat(F.lit("alert."), F.lower("target_status")), F.col("actor"), F.col("alert_id"),
        F.to_json(F.struct(was.alias("status"))),
        F.to_json(F.struct(F.col("target_status").alias("status"),
                           F.col("actor").alias("resolved_by"),
                           _optional(applied, "resolution_reason")), {"ignoreNullFields": "false"}),
        F.col("acted_at"),
    )
    target = F.when(F.col("level") == "email", "ESCALATED_EMAIL").otherwise("ESCALATED_SLACK")
    source = F.when(F.col("level") == "email", "PENDING").otherwise("ESCALATED_EMAIL")
    escalated = _audit(
        escalations,
        F.concat(F.lit("alert.escalated_"), F.col("level")), F.lit(SYSTEM_ACTOR), F.col("id"),
        F.to_json(F.struct(source.alias("status"))),
        F.to_json(F.struct(
            target.alias("status"),
            F.when(F.col("level") == "email", iso_time("escalated_at")).alias("escalated_email_at"),
            F.when(F.col("level") == "slack", iso_time("escalated_at")).alias("escalated_slack_at"),
        )),
        F.col("escalated_at"),
    )
    return resolved.unionByName(escalated)


def rule_snapshot() -> Column:
    """The six audited columns of a rule as JSON text."""
    return F.to_json(F.struct("id", "name", "rule_type", "parameters", "severity", "enabled"))


def rule_change_audit(old: DataFrame, new: DataFrame, actor: str = "django_admin") -> DataFrame:
    """Differences of two rule tables as audit rows."""
    before = old.select("id", rule_snapshot().alias("before"))
    after = new.select("id", rule_snapshot().alias("after"))
    action = (
        F.when(F.col("before").isNull(), "RULE_CREATE")
        .when(F.col("after").isNull(), "RULE_DELETE")
        .when(F.col("before") != F.col("after"), "RULE_UPDATE")
    )
    return before.join(after, "id", "full_outer").withColumn("action", action).where(
        "action IS NOT NULL"
    ).select(
        F.lit(actor).alias("actor"), "action", F.lit("FraudRule").alias("entity_type"),
        F.col("id").alias("entity_id"), "before", "after",
    )
