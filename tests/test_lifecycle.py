"""Resolutions, escalation, replay, audit trail and compensation."""

import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from fraudloom.config import LifecycleConfig
from fraudloom.operators import events, lifecycle, profiles

NOW = datetime.datetime(2024, 1, 1, 12)


def ago(minutes):
    return NOW - datetime.timedelta(minutes=minutes)


def now():
    return F.lit(NOW).cast("timestamp_ntz")


def alerts(spark, *rows):
    """(id, status, minutes since creation, minutes since e-mail)."""
    data = [(i, i, 7, status, "HIGH", Decimal("0.8"), None, None, ago(age),
             ago(mail) if mail is not None else None, None, f"c{i}")
            for i, status, age, mail in rows]
    return spark.createDataFrame(
        data, "id long, transaction_id long, user_id long, status string, severity string,"
        " composite_risk_score decimal(5,4), resolved_by string, resolved_at timestamp_ntz,"
        " created_at timestamp_ntz, escalated_email_at timestamp_ntz,"
        " escalated_slack_at timestamp_ntz, correlation_id string")


def actions(spark, *rows):
    """(action id, alert id, target, minutes ago)."""
    return spark.createDataFrame(
        [(a, i, target, "ann", ago(age)) for a, i, target, age in rows],
        "action_id long, alert_id long, target_status string, actor string,"
        " acted_at timestamp_ntz")


def test_email_then_slack(spark):
    table = alerts(spark, (1, "PENDING", 6, None), (2, "PENDING", 5, None),
                   (3, "PENDING", 4, None), (4, "ESCALATED_EMAIL", 30, 10),
                   (5, "ESCALATED_EMAIL", 30, 9), (6, "APPROVED", 60, None))
    changed, made = lifecycle.escalation_tick(table, now())
    assert {r["id"]: r["status"] for r in changed.collect()} == {
        1: "ESCALATED_EMAIL", 2: "ESCALATED_EMAIL", 3: "PENDING", 4: "ESCALATED_SLACK",
        5: "ESCALATED_EMAIL", 6: "APPROVED"}
    assert {(r["id"], r["level"]) for r in made.collect()} == {
        (1, "email"), (2, "email"), (4, "slack")}


def test_batch_takes_the_oldest(spark):
    table = alerts(spark, *[(i, "PENDING", 10 + i, None) for i in range(6)])
    _, made = lifecycle.escalation_tick(table, now(), LifecycleConfig(batch_size=2))
    assert {r["id"] for r in made.collect()} == {4, 5}


def test_same_tick_reaches_slack_only_without_delay(spark):
    table = alerts(spark, (1, "PENDING", 6, None))
    changed, made = lifecycle.escalation_tick(table, now(), LifecycleConfig(slack_minutes=0))
    assert changed.first()["status"] == "ESCALATED_SLACK"
    assert {r["level"] for r in made.collect()} == {"email", "slack"}


def test_first_action_wins(spark):
    table = alerts(spark, (1, "PENDING", 9, None), (2, "BLOCKED", 9, None),
                   (3, "ESCALATED_SLACK", 90, 80))
    log = actions(spark, (11, 1, "BLOCKED", 2), (12, 1, "APPROVED", 3), (13, 1, "PENDING", 5),
                  (21, 2, "APPROVED", 1), (31, 3, "FALSE_POSITIVE", 1), (91, 9, "APPROVED", 1))
    resolved, outcomes = lifecycle.resolve_alerts(table, log)
    assert {r["action_id"]: r["outcome"] for r in outcomes.collect()} == {
        11: "conflict", 12: "applied", 13: "invalid_target", 21: "conflict", 31: "applied",
        91: "not_found"}
    assert {r["id"]: r["status"] for r in resolved.collect()} == {
        1: "APPROVED", 2: "BLOCKED", 3: "FALSE_POSITIVE"}


def test_reason_of_the_winning_action_is_kept(spark):
    table = alerts(spark, (1, "PENDING", 9, None), (2, "PENDING", 9, None))
    log = actions(spark, (11, 1, "BLOCKED", 3), (12, 1, "APPROVED", 2), (21, 2, "APPROVED", 2))
    log = log.withColumn("resolution_reason", F.when(F.col("alert_id") == 1, F.concat(
        F.lit("by "), F.col("action_id").cast("string"))))
    resolved, outcomes = lifecycle.resolve_alerts(table, log)
    assert {r["id"]: r["resolution_reason"] for r in resolved.collect()} == {1: "by 11", 2: None}
    none_made = lifecycle.escalation_tick(table, now())[1].where("false")
    assert {r["entity_id"]: r["after"] for r in lifecycle.audit_rows(outcomes, none_made).collect()} == {
        "1": '{"status":"BLOCKED","resolved_by":"ann","resolution_reason":"by 11"}',
        "2": '{"status":"APPROVED","resolved_by":"ann","resolution_reason":null}'}
    payload = events.resolution_events(outcomes).where("event_type = 'alert.blocked'").first()["payload"]
    assert '"severity":"HIGH"' in payload and '"resolution_reason":"by 11"' in payload


def test_audit_trail(spark):
    table = alerts(spark, (1, "ESCALATED_EMAIL", 9, 4), (2, "PENDING", 9, None))
    _, outcomes = lifecycle.resolve_alerts(table, actions(spark, (11, 1, "BLOCKED", 2)))
    _, made = lifecycle.escalation_tick(table.where("id = 2"), now())
    rows = {r["action"]: r for r in lifecycle.audit_rows(outcomes, made).collect()}
    assert set(rows) == {"alert.blocked", "alert.escalated_email"}
    assert rows["alert.blocked"]["before"] == '{"status":"UNRESOLVED"}'
    assert rows["alert.escalated_email"]["actor"] == "system:escalation_scheduler"
    real = lifecycle.audit_rows(outcomes, made, real_from=True).where("action = 'alert.blocked'")
    assert real.first()["before"] == '{"status":"ESCALATED_EMAIL"}'


@pytest.mark.parametrize("minutes_ago,email,slack,status", [
    (None, True, True, "ESCALATED_SLACK"), (57, False, False, "APPROVED"),
    (55, False, False, "APPROVED"), (50, True, False, "APPROVED"), (45, True, False, "APPROVED"),
    (20, True, True, "APPROVED"),
])
def test_replay(spark, minutes_ago, email, slack, status):
    """Created an hour ago: e-mail was due 55 and Slack 45 minutes ago."""
    log = actions(spark, *([(1, 1, "APPROVED", minutes_ago)] if minutes_ago else [
        (1, 2, "APPROVED", 3)]))
    row = lifecycle.lifecycle_replay(alerts(spark, (1, "PENDING", 60, None)), log).first()
    assert row["status"] == status
    assert (row["escalated_email_at"] is not None, row["escalated_slack_at"] is not None) == (
        email, slack)


def test_replay_as_of_ignores_the_future(spark):
    log = actions(spark, (1, 1, "APPROVED", 1))
    table = alerts(spark, (1, "PENDING", 60, None), (2, "PENDING", 2, None))
    found = lifecycle.lifecycle_replay(table, log, F.lit(ago(50)).cast("timestamp_ntz")).collect()
    assert [(r["id"], r["status"]) for r in found] == [(1, "ESCALATED_EMAIL")]


def test_rule_changes(spark):
    schema = "id string, name string, rule_type string, parameters string, severity string, enabled boolean"
    old = spark.createDataFrame([("a", "A", "T", "{}", "LOW", True), ("b", "B", "T", "{}", "LOW", True),
                                 ("c", "C", "T", "{}", "LOW", True)], schema)
    new = spark.createDataFrame([("a", "A", "T", "{}", "LOW", True), ("b", "B", "T", "{}", "HIGH", True),
                                 ("d", "D", "T", "{}", "LOW", True)], schema)
    found = lifecycle.rule_change_audit(old, new).collect()
    assert {(r["entity_id"], r["action"]) for r in found} == {
        ("b", "RULE_UPDATE"), ("c", "RULE_DELETE"), ("d", "RULE_CREATE")}


def test_compensation(spark):
    table = spark.createDataFrame(
        [(1, Decimal("0.5"), 2, 0), (2, Decimal("0.9"), 9, 0), (3, Decimal("0.7"), 0, 0),
         (4, Decimal("0.3"), 4, 1)],
        "user_id long, risk_score decimal(5,4), total_alerts int, false_positive_count int")
    events = spark.createDataFrame(
        [(10, 1, NOW), (11, 2, NOW), (12, 2, NOW), (13, 3, NOW), (14, 5, NOW), (15, None, NOW)],
        "event_id long, user_id long, resolved_at timestamp_ntz")
    found = {r["user_id"]: (str(r["risk_score"]), r["total_alerts"], r["false_positive_count"])
             for r in profiles.compensate_profiles(table, events).collect()}
    assert found == {1: ("0.2500", 2, 1), 2: ("1.0000", 9, 2), 3: ("0.0000", 0, 1),
                     4: ("0.3000", 4, 1), 5: ("0.0000", 0, 1)}


def test_alerts_raise_counts_not_scores(spark):
    table = spark.createDataFrame(
        [(7, Decimal("0.5"), 2, 1)],
        "user_id long, risk_score decimal(5,4), total_alerts int, false_positive_count int")
    row = profiles.bump_profiles(table, alerts(spark, (1, "PENDING", 1, None))).first()
    assert tuple(row) == (7, Decimal("0.5"), 3, 1)
