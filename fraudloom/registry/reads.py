"""Queries for lists, searches, pages and lookups."""

from pyspark.sql import functions as F

from fraudloom.operators import views
from fraudloom.registry.core import query, sql

SUMMARY = ["id", "transaction_id", "user_id", "status", "severity", "composite_risk_score",
           "is_demo", "created_at"]
SUMMARY_SQL = ", ".join(SUMMARY)


@query("filter_alerts", sql("alerts_mix", f"""
    SELECT {SUMMARY_SQL} FROM alerts_mix WHERE status = 'PENDING' AND severity = 'HIGH'
      AND created_at >= TIMESTAMP '2024-01-05' AND created_at <= TIMESTAMP '2024-01-25'"""))
def filtered(t):
    return views.filter_alerts(
        t.alerts_mix, "PENDING", "HIGH", "2024-01-05", "2024-01-25").select(*SUMMARY)


@query("search_alerts", sql("alerts_mix", """
    SELECT id, status, severity FROM alerts_mix
    WHERE severity = 'LOW' AND contains(CAST(id AS VARCHAR), '12')"""))
def searched(t):
    alerts = t.alerts_mix.select("id", "transaction_id", "status", "severity")
    return views.search_alerts(alerts, "12", severity="LOW").drop("transaction_id")


@query("filter_rules", sql("rules_tab", """
    SELECT id, name, severity, created_at FROM rules_tab
    WHERE enabled AND rule_type = 'VELOCITY' AND severity = 'HIGH'"""))
def some_rules(t):
    return views.filter_rules(t.rules_tab, "true", "VELOCITY", "HIGH").select(
        "id", "name", "severity", "created_at")


@query("filter_audit", sql("audit_fx", """
    SELECT id, actor, entity_id, created_at FROM audit_fx
    WHERE action = 'alert.blocked' AND entity_type = 'Alert' AND actor = 'analyst_1'"""))
def some_audit(t):
    return views.filter_audit(t.audit_fx, "alert.blocked", "Alert", actor="analyst_1").select(
        "id", "actor", "entity_id", "created_at")


@query("filter_users", sql("users_fx", """
    SELECT id, full_name, email FROM users_fx WHERE country = 'GB' AND is_seed_data"""))
def some_users(t):
    return views.filter_users(t.users_fx, "gb", "1").select("id", "full_name", "email")


@query("browse_transactions", sql("txn", """
    SELECT transaction_id, amount, country, created_at FROM txn
    WHERE currency = 'EUR' AND created_at >= TIMESTAMP '2024-01-10' AND created_at < TIMESTAMP '2024-01-11'
      AND (contains(CAST(transaction_id AS VARCHAR), '3') OR contains(CAST(user_id AS VARCHAR), '3')
           OR contains(idempotency_key, '3') OR contains(correlation_id, '3'))"""))
def browsed_transactions(t):
    return views.browse_transactions(t.txn, currency="EUR", day="2024-01-10", query="3").select(
        "transaction_id", "amount", "country", "created_at")


@query("browse_alerts", sql("alerts_mix", """
    SELECT id, severity, status, resolved_by FROM alerts_mix
    WHERE NOT is_demo AND coalesce(contains(resolved_by, 'analyst_2'), FALSE)"""))
def browsed_alerts(t):
    return views.browse_alerts(t.alerts_mix, is_demo=False, query="ANALYST_2").select(
        "id", "severity", "status", "resolved_by")


@query("browse_risk_profiles", sql("risk_profiles_fx", """
    SELECT user_id, risk_score, last_recalculated_at FROM risk_profiles_fx
    WHERE contains(CAST(user_id AS VARCHAR), '9')"""))
def browsed_profiles(t):
    return views.browse_risk_profiles(t.risk_profiles_fx, "9").select(
        "user_id", "risk_score", "last_recalculated_at")


@query("alert_detail", sql("txn alerts_mix", """
    SELECT t.transaction_id AS id, a.status, coalesce(a.rule_matches, CASE WHEN a.id IS NOT NULL THEN '[]' END) AS rule_matches,
      coalesce(a.risk_profile_snapshot, CASE WHEN a.id IS NOT NULL THEN '{}' END) AS risk_profile_snapshot,
      a.resolved_by, a.resolved_at, a.escalated_email_at, a.id IS NOT NULL AS found
    FROM txn t LEFT JOIN alerts_mix a ON a.id = t.transaction_id"""))
def details(t):
    ids = t.txn.select(F.col("transaction_id").alias("id"))
    return views.alert_detail(t.alerts_mix, ids).select(
        "id", "status", "rule_matches", "risk_profile_snapshot", "resolved_by", "resolved_at",
        "escalated_email_at", "found")


@query("lookup_by_id", sql("users_fx alerts_fx", """
    SELECT id, full_name, country FROM users_fx WHERE id IN (SELECT user_id FROM alerts_fx)"""))
def looked_up(t):
    return views.lookup_by_id(t.users_fx, "id", t.alerts_fx.select("user_id")).select(
        "id", "full_name", "country")


@query("transaction_with_alert", sql("txn_submissions txn alerts_mix", """
    SELECT s.transaction_id, t.amount, t.status, a.id AS alert_id, a.status AS alert_status,
      a.severity AS alert_severity, t.transaction_id IS NOT NULL AS found
    FROM txn_submissions s LEFT JOIN txn t ON t.transaction_id = s.transaction_id
    LEFT JOIN alerts_mix a ON a.transaction_id = s.transaction_id"""))
def with_alert(t):
    ids = t.txn_submissions.select("transaction_id")
    return views.transaction_with_alert(t.txn, t.alerts_mix, ids).select(
        "transaction_id", "amount", "status", "alert_id", "alert_status", "alert_severity", "found")


@query("inbox_anti_join", sql("txn inbox_fx", """
    SELECT transaction_id AS event_id, created_at FROM txn WHERE transaction_id NOT IN (
      SELECT event_id FROM inbox_fx WHERE consumer_group = 'processor-group')"""))
def fresh(t):
    events = t.txn.select(F.col("transaction_id").alias("event_id"), "created_at")
    return views.inbox_anti_join(events, t.inbox_fx, "processor-group")


@query("correlation_timeline", sql("txn alerts_mix outbox_fx audit_fx", """
    SELECT correlation_id, created_at AS at, 'transaction' AS source, CAST(transaction_id AS VARCHAR) AS entity_id, status AS what FROM txn
    UNION ALL SELECT correlation_id, created_at, 'alert', CAST(id AS VARCHAR), severity FROM alerts_mix
    UNION ALL SELECT correlation_id, created_at, 'outbox', CAST(id AS VARCHAR), event_type FROM outbox_fx
    UNION ALL SELECT correlation_id, created_at, 'audit', entity_id, action FROM audit_fx"""))
def timeline(t):
    return views.correlation_timeline(t.txn, t.alerts_mix, t.outbox_fx, t.audit_fx)


@query("page_alerts", sql("alerts_mix", f"""
    SELECT {SUMMARY_SQL} FROM alerts_mix WHERE severity = 'LOW'
    ORDER BY created_at DESC, id LIMIT 20 OFFSET 20"""))
def page(t):
    return views.page_alerts(
        views.filter_alerts(t.alerts_mix, severity="LOW"), 2, 20).select(*SUMMARY)


@query("count_alerts", sql("alerts_mix", """
    SELECT count(*) AS total FROM alerts_mix WHERE severity = 'LOW'"""))
def total(t):
    return views.count_alerts(views.filter_alerts(t.alerts_mix, severity="LOW"))


@query("page_window", sql("alerts_mix", """
    SELECT user_id, total, total_pages, least(2, total_pages) AS active_page,
      (least(2, total_pages) - 1) * 3 + 1 AS start_record, least(least(2, total_pages) * 3, total) AS end_record
    FROM (SELECT user_id, count(*) AS total, greatest(1, CAST(ceil(count(*) / 3.0) AS BIGINT)) AS total_pages
          FROM alerts_mix GROUP BY user_id) x"""))
def window_of_page(t):
    totals = t.alerts_mix.groupBy("user_id").agg(F.count(F.lit(1)).alias("total"))
    return views.page_window(totals, 2, 3)


@query("recent_alerts", sql("alerts_mix", """
    SELECT id, created_at FROM alerts_mix ORDER BY created_at DESC, id LIMIT 5"""))
def recent(t):
    return views.recent_alerts(t.alerts_mix).select("id", "created_at")


@query("oldest_pending", sql("outbox_fx", """
    SELECT id, event_type, created_at FROM outbox_fx WHERE status = 'PENDING' ORDER BY created_at, id LIMIT 50"""))
def pending(t):
    return views.oldest_pending(t.outbox_fx).select("id", "event_type", "created_at")


@query("user_pool", sql("users_fx", "SELECT id, country FROM users_fx ORDER BY id LIMIT 500"))
def pool(t):
    return views.user_pool(t.users_fx)


@query("time_sorted", sql("txn", """
    SELECT transaction_id, created_at FROM txn ORDER BY created_at, transaction_id"""))
def by_time(t):
    return views.time_sorted(t.txn).select("transaction_id", "created_at")
