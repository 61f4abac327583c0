"""Queries for scans, sinks, validation and merging."""

from pyspark.sql import functions as F

from fraudloom.operators import merge, quality
from fraudloom.operators.lifecycle import rule_snapshot
from fraudloom.operators.rules import load_active_rules, resolve_rule_params
from fraudloom.registry.core import query, sql
from fraudloom.schemas import UNIQUE_KEYS
from fraudloom.session import shared_dir
from fraudloom.sources import tables, upsert

USER_PATTERN = "^[0-9]+$"


@query("scan_tables", sql("txn", """
    SELECT CAST(transaction_id AS VARCHAR) AS id, created_at, CAST(user_id AS VARCHAR) AS user_id, amount,
      currency, country, merchant_category, status, idempotency_key, metadata, correlation_id
    FROM txn"""))
def scan_tables(t):
    path = shared_dir(t.spark, "scan")
    t.txn.select(
        F.col("transaction_id").cast("string").alias("id"),
        F.col("created_at").cast("timestamp").alias("created_at"),
        F.col("user_id").cast("string").alias("user_id"), "amount", "currency", "country",
        "merchant_category", "status", "idempotency_key", "metadata", "correlation_id",
        F.lit(None).cast("timestamp").alias("processed_at"),
    ).write.parquet(f"{path}/transactions")
    return tables.scan(t.spark, path, "transactions").drop("processed_at").withColumn(
        "created_at", F.col("created_at").cast("timestamp_ntz"))


@query("weekly_layout", sql("txn", """
    SELECT CAST(CAST('1970-01-01' AS DATE) + CAST(floor(epoch(created_at) / 604800) AS INTEGER) * 7 AS VARCHAR) AS week,
      count(*) AS transaction_count, CAST(sum(amount) AS DECIMAL(24,2)) AS total_amount
    FROM txn WHERE created_at >= TIMESTAMP '2024-01-09' AND created_at < TIMESTAMP '2024-01-23'
    GROUP BY 1"""))
def weekly_layout(t):
    path = shared_dir(t.spark, "weekly")
    tables.write_weekly(t.txn, path)
    return tables.read_weekly(t.spark, path, "2024-01-09", "2024-01-23").groupBy(
        F.col("week").cast("string").alias("week")
    ).agg(F.count(F.lit(1)).alias("transaction_count"), F.sum("amount").alias("total_amount"))


RULE_CHECK = """
    SELECT id, rule_type, severity, enabled, parameters,
      CASE WHEN json_extract(parameters, '$.threshold') IS NOT NULL
             AND coalesce(try_cast(CAST(json_extract(parameters, '$.threshold') AS VARCHAR) AS DOUBLE), 1) <> 0
           THEN CAST(json_extract(parameters, '$.threshold') AS VARCHAR) END AS th,
      CASE WHEN json_extract(parameters, '$.amount_threshold') IS NOT NULL
           THEN CAST(json_extract(parameters, '$.amount_threshold') AS VARCHAR) END AS ath,
      CAST(json_extract(parameters, '$.limit') AS VARCHAR) AS lim,
      CASE WHEN coalesce(try_cast(CAST(json_extract(parameters, '$.max_count') AS VARCHAR) AS DOUBLE), 0) <> 0
           THEN CAST(json_extract(parameters, '$.max_count') AS VARCHAR) END AS mc,
      CAST(json_extract(parameters, '$.count_threshold') AS VARCHAR) AS ct,
      CAST(json_extract(parameters, '$.max_amount') AS VARCHAR) AS ma,
      CAST(json_extract(parameters, '$.min_risk_score') AS VARCHAR) AS mrs,
      CAST(json_extract(parameters, '$.risk_threshold') AS VARCHAR) AS rt,
      CASE WHEN json_type(json_extract(parameters, '$.countries')) = 'ARRAY'
                AND json_array_length(json_extract(parameters, '$.countries')) = 0 THEN NULL
           ELSE json_extract(parameters, '$.countries') END AS co,
      json_extract(parameters, '$.country_codes') AS cc,
      json_extract(parameters, '$.categories') AS ca,
      json_extract(parameters, '$.blocked_categories') AS bc,
      json_extract_string(parameters, '$.currency') AS cur,
      json_extract_string(parameters, '$.operator') AS op,
      json_extract_string(parameters, '$.window_minutes') AS win
    FROM rules_tab"""

RULE_TYPED = """
    SELECT id, rule_type, severity, enabled,
      CASE WHEN rule_type = 'AMOUNT_THRESHOLD'
           THEN try_cast(trim(coalesce(th, ath, lim), '"') AS DECIMAL(28,8)) END AS threshold,
      CASE WHEN rule_type = 'AMOUNT_THRESHOLD' THEN upper(cur) END AS currency,
      CASE WHEN rule_type = 'AMOUNT_THRESHOLD' THEN coalesce(op <> '>=', FALSE) END AS strict,
      CASE WHEN rule_type = 'HIGH_RISK_COUNTRY' AND json_type(coalesce(co, cc)) = 'ARRAY'
           THEN array_to_string(list_transform(CAST(coalesce(co, cc) AS VARCHAR[]), lambda x: upper(trim(x))), ',') END AS countries,
      CASE WHEN rule_type = 'MERCHANT_CATEGORY' AND json_type(coalesce(ca, bc)) = 'ARRAY'
           THEN array_to_string(list_transform(CAST(coalesce(ca, bc) AS VARCHAR[]), lambda x: lower(trim(x))), ',') END AS categories,
      CASE WHEN rule_type = 'VELOCITY' THEN try_cast(coalesce(mc, ct, raw_mc) AS BIGINT) END AS max_count,
      CASE WHEN rule_type = 'VELOCITY' THEN try_cast(trim(coalesce(ma, ath), '"') AS DECIMAL(28,8)) END AS max_amount,
      CASE WHEN rule_type = 'USER_RISK_LEVEL' THEN try_cast(trim(coalesce(mrs, rt, th, raw_th), '"') AS DECIMAL(28,8)) END AS min_score,
      CASE WHEN rule_type = 'VELOCITY' THEN win END AS window_text
    FROM (SELECT *, CAST(NULL AS VARCHAR) AS raw_mc,
            CAST(json_extract(parameters, '$.threshold') AS VARCHAR) AS raw_th FROM parsed) p"""


def _typed(rules):
    return rules.select(
        "id", "rule_type", "severity", "enabled", "threshold", "currency", "strict",
        F.array_join("countries", ",").alias("countries"),
        F.array_join("categories", ",").alias("categories"),
        "max_count", "max_amount", "min_score", "window_text",
    )


@query("resolve_rule_params", sql("rules_tab", "SELECT * FROM typed", parsed=RULE_CHECK, typed=RULE_TYPED))
def rule_params(t):
    return _typed(resolve_rule_params(t.rules_tab))


VALID_RULE = """rule_type <> 'UNKNOWN_TYPE' AND severity <> 'SEVERE'"""


@query("load_active_rules", sql(
    "rules_tab", f"SELECT * FROM typed WHERE enabled AND {VALID_RULE}", parsed=RULE_CHECK, typed=RULE_TYPED))
def active_rules(t):
    return _typed(load_active_rules(t.rules_tab)[0])


@query("invalid_rules", sql("rules_tab", f"""
    SELECT id, concat_ws(',', CASE WHEN rule_type = 'UNKNOWN_TYPE' THEN 'rule_type' END,
      CASE WHEN severity = 'SEVERE' THEN 'severity' END) AS reason
    FROM rules_tab WHERE enabled AND NOT ({VALID_RULE})"""))
def invalid_rules(t):
    return load_active_rules(t.rules_tab)[1].select("id", "reason")


@query("rule_snapshot", sql("rules_tab", """
    SELECT id, json_extract_string(s, '$.name') AS name, json_extract_string(s, '$.rule_type') AS rule_type,
      json_extract_string(s, '$.parameters') AS parameters, json_extract_string(s, '$.enabled') AS enabled
    FROM (SELECT id, json_object('id', id, 'name', name, 'rule_type', rule_type, 'parameters', parameters,
      'severity', severity, 'enabled', enabled) AS s FROM rules_tab) x"""))
def snapshots(t):
    s = F.col("s")
    return t.rules_tab.select("id", rule_snapshot().alias("s")).select(
        "id", *[F.get_json_object(s, f"$.{c}").alias(c)
                for c in ("name", "rule_type", "parameters", "enabled")])


# ------------------------------------------------------------------------------- validation

SUBMISSION_CHECK = """
    SELECT r.*, concat_ws(',',
      CASE WHEN coalesce(try_cast(amount AS DECIMAL(38,18)), 0) <= 0 THEN 'amount' END,
      CASE WHEN currency IS NOT NULL AND NOT regexp_matches(upper(currency), '^[A-Z]{3}$') THEN 'currency' END,
      CASE WHEN NOT regexp_matches(upper(country), '^[A-Z]{2}$') THEN 'country' END,
      CASE WHEN length(merchant_category) NOT BETWEEN 1 AND 128 THEN 'merchant_category' END,
      CASE WHEN user_id IS NULL OR NOT regexp_matches(user_id, '^[0-9]+$') THEN 'user_id' END,
      CASE WHEN length(idempotency_key) > 255 THEN 'idempotency_key' END,
      CASE WHEN field_names LIKE '%note%' THEN 'unknown_field' END) AS errors
    FROM raw_submissions r"""


def _raw(t):
    return t.raw_submissions.withColumn("field_names", F.split("field_names", ","))


@query("validate_transactions", sql(
    "raw_submissions", "SELECT submission_id, errors FROM checked WHERE errors <> ''", checked=SUBMISSION_CHECK))
def rejected(t):
    return quality.validate_transactions(_raw(t), USER_PATTERN)[1].select(
        "submission_id", F.array_join("errors", ",").alias("errors"))


@query("normalize_transactions", sql("raw_submissions", """
    SELECT submission_id, upper(trim(currency)) AS currency, upper(trim(country)) AS country, amount
    FROM checked WHERE errors = ''""", checked=SUBMISSION_CHECK))
def normalized(t):
    valid, _ = quality.validate_transactions(_raw(t), USER_PATTERN)
    return quality.normalize_transactions(valid).select(
        "submission_id", "currency", "country", "amount")


@query("apply_defaults", sql("raw_submissions", """
    SELECT submission_id, coalesce(upper(currency), 'USD') AS currency, coalesce(metadata, '{}') AS metadata,
      coalesce(idempotency_key, sha256(concat('key|', CAST(submission_id AS VARCHAR)))) AS idempotency_key,
      'SUBMITTED' AS status
    FROM checked WHERE errors = ''""", checked=SUBMISSION_CHECK))
def with_defaults(t):
    valid, _ = quality.validate_transactions(_raw(t), USER_PATTERN)
    return quality.apply_defaults(quality.normalize_transactions(valid)).select(
        "submission_id", "currency", "metadata", "idempotency_key", "status")


@query("unknown_fields", sql("raw_submissions", """
    SELECT submission_id, 'note,channel' AS unknown FROM raw_submissions WHERE field_names LIKE '%note%'"""))
def not_allowed(t):
    found = _raw(t).select("submission_id", quality.unknown_fields(F.col("field_names")).alias("u"))
    return found.where(F.size("u") > 0).select(
        "submission_id", F.array_join("u", ",").alias("unknown"))


@query("check_constraints", sql("raw_submissions", """
    SELECT 'transactions' AS table_name, c AS constraint_name, CAST(submission_id AS VARCHAR) AS row_key
    FROM (SELECT submission_id, unnest([
        CASE WHEN coalesce(try_cast(amount AS DECIMAL(14,2)), 0) <= 0 THEN 'amount_positive' END,
        CASE WHEN currency IS NULL OR length(currency) > 3 THEN 'currency_length' END,
        CASE WHEN length(country) > 2 THEN 'country_length' END,
        CASE WHEN idempotency_key IS NULL OR length(idempotency_key) > 255 THEN 'idempotency_key_length' END,
        CASE WHEN user_id IS NULL THEN 'user_id_present' END]) AS c FROM raw_submissions) x
    WHERE c IS NOT NULL"""))
def constraint_violations(t):
    rows = t.raw_submissions.withColumn("amount", F.col("amount").try_cast("decimal(14,2)"))
    return quality.check_constraints(rows, "transactions", "submission_id")


@query("check_unique_keys", sql("users_fx txn_submissions", """
    SELECT 'users.email' AS unique_key, email AS key_value, count(*) AS occurrences FROM users_fx
    GROUP BY email HAVING count(*) > 1
    UNION ALL
    SELECT 'transactions.idempotency_key', idempotency_key, count(*) FROM txn_submissions
    GROUP BY idempotency_key HAVING count(*) > 1"""))
def duplicate_keys(t):
    email = UNIQUE_KEYS["users"][1]
    users = quality.check_unique_keys(t.users_fx, email).select(
        F.lit("users.email").alias("unique_key"), F.col("email").alias("key_value"), "occurrences")
    keys = quality.check_unique_keys(t.txn_submissions, ["idempotency_key"]).select(
        F.lit("transactions.idempotency_key").alias("unique_key"),
        F.col("idempotency_key").alias("key_value"), "occurrences")
    return users.unionByName(keys)


@query("orphan_check", sql("txn risk_profiles_fx", """
    SELECT transaction_id, user_id FROM txn WHERE user_id NOT IN (SELECT user_id FROM risk_profiles_fx)"""))
def orphans(t):
    return quality.orphan_check(t.txn, t.risk_profiles_fx, "user_id", "user_id").select(
        "transaction_id", "user_id")


@query("status_class", sql("alerts_mix", """
    SELECT id, status IN ('APPROVED', 'BLOCKED', 'FALSE_POSITIVE') AS is_terminal,
      status LIKE 'ESCALATED%' AS is_escalated,
      status IN ('PENDING', 'ESCALATED_EMAIL', 'ESCALATED_SLACK') AS is_resolvable FROM alerts_mix"""))
def classes(t):
    return quality.status_class(t.alerts_mix).select(
        "id", "is_terminal", "is_escalated", "is_resolvable")


# ---------------------------------------------------------------------------------- merging


@query("first_per_key", sql("txn_submissions", """
    SELECT transaction_id, idempotency_key, created_at FROM (
      SELECT *, row_number() OVER (PARTITION BY idempotency_key ORDER BY created_at, transaction_id) AS rn
      FROM txn_submissions) x WHERE rn = 1"""))
def first_rows(t):
    rows = t.txn_submissions.select("transaction_id", "idempotency_key", "created_at")
    return merge.first_per_key(rows, "idempotency_key", "created_at", "transaction_id")


@query("idempotent_submit", sql("txn_submissions", """
    SELECT transaction_id AS submission_id, idempotency_key,
      CASE WHEN rn = 1 THEN 'accepted' ELSE 'duplicate' END AS outcome, first_id AS transaction_id, status
    FROM (SELECT *, row_number() OVER w AS rn, first_value(transaction_id) OVER w AS first_id
          FROM txn_submissions
          WINDOW w AS (PARTITION BY idempotency_key ORDER BY created_at, transaction_id)) x"""))
def submit(t):
    return merge.idempotent_submit(t.txn_submissions)


@query("upsert_table", sql("risk_profiles_fx txn", """
    SELECT coalesce(p.user_id, d.user_id) AS user_id,
      CASE WHEN d.user_id IS NOT NULL THEN d.risk_score ELSE p.risk_score END AS risk_score,
      CASE WHEN p.user_id IS NULL THEN d.total_alerts ELSE p.total_alerts END AS total_alerts
    FROM risk_profiles_fx p FULL OUTER JOIN (
      SELECT user_id, CAST(least(1, count(*) * 0.01) AS DECIMAL(5,4)) AS risk_score, CAST(0 AS INT) AS total_alerts
      FROM txn GROUP BY user_id) d ON d.user_id = p.user_id"""))
def upserted(t):
    delta = t.txn.groupBy("user_id").agg(
        F.expr("CAST(least(1, count(*) * 0.01) AS DECIMAL(5,4))").alias("risk_score"),
        F.lit(0).alias("total_alerts"))
    base = t.risk_profiles_fx.select("user_id", "risk_score", "total_alerts")
    return merge.upsert_table(base, delta, ["user_id"], ["risk_score"])


@query("upsert_in_place", sql("risk_profiles_fx txn", """
    SELECT coalesce(p.user_id, d.user_id) AS user_id, coalesce(d.risk_score, p.risk_score) AS risk_score,
      coalesce(p.total_alerts, d.total_alerts) AS total_alerts
    FROM risk_profiles_fx p FULL OUTER JOIN (
      SELECT user_id, CAST(least(1, count(*) * 0.01) AS DECIMAL(5,4)) AS risk_score, CAST(0 AS INT) AS total_alerts
      FROM txn WHERE user_id % 100 = 7 GROUP BY user_id) d ON d.user_id = p.user_id"""))
def upserted_in_place(t):
    """The profiles as a stored table after a delta of the users of every hundredth number."""
    path = shared_dir(t.spark, "profiles_table")
    base = t.risk_profiles_fx.select("user_id", "risk_score", "total_alerts")
    upsert.create_keyed(base, path, ["user_id"], partitions=64)
    delta = t.txn.where("user_id % 100 = 7").groupBy("user_id").agg(
        F.expr("CAST(least(1, count(*) * 0.01) AS DECIMAL(5,4))").alias("risk_score"),
        F.lit(0).alias("total_alerts"))
    upsert.upsert_keyed(delta, path, base.schema, ["user_id"], ["risk_score"], partitions=64)
    return upsert.read_keyed(t.spark, path, base.schema)


@query("latest_per_alert", sql("actions_fx", """
    SELECT alert_id AS id, action_id, target_status FROM (
      SELECT *, row_number() OVER (PARTITION BY alert_id ORDER BY acted_at DESC, action_id DESC) AS rn
      FROM actions_fx) x WHERE rn = 1"""))
def last_writes(t):
    writes = t.actions_fx.select(
        F.col("alert_id").alias("id"), "action_id", "target_status", "acted_at")
    return merge.latest_per_alert(writes, "acted_at", "action_id").drop("acted_at")


@query("reconcile_alerts", sql("alerts_fx alerts_mix", """
    SELECT coalesce(s.id, c.id) AS id,
      CASE WHEN s.id IS NOT NULL THEN s.status ELSE c.status END AS status,
      CASE WHEN s.id IS NOT NULL THEN s.is_demo ELSE FALSE END AS is_demo,
      CASE WHEN s.id IS NOT NULL THEN 'rest-sync' ELSE c.correlation_id END AS correlation_id
    FROM (SELECT * FROM alerts_fx WHERE severity <> 'LOW') c
    FULL OUTER JOIN (SELECT * FROM alerts_mix WHERE status <> 'PENDING') s ON s.id = c.id"""))
def reconciled(t):
    cached = t.alerts_fx.where("severity <> 'LOW'").select("id", "status", "correlation_id")
    server = t.alerts_mix.where("status <> 'PENDING'").select("id", "status", "is_demo")
    return merge.reconcile_alerts(cached, server)


@query("prepend_new_alert", sql("alerts_fx", """
    SELECT id, 'ESCALATED_SLACK' AS status, 0 AS position FROM alerts_fx WHERE severity = 'HIGH'
    UNION ALL SELECT id, status, 1 FROM alerts_fx WHERE severity <> 'HIGH'"""))
def prepended(t):
    created = t.alerts_fx.where("severity = 'HIGH'").select(
        "id", F.lit("ESCALATED_SLACK").alias("status"))
    return merge.prepend_new_alert(t.alerts_fx.select("id", "status"), created)


@query("idempotent_seed_load", sql("users_fx", """
    SELECT id, country, is_seed_data FROM users_fx"""))
def seeded(t):
    path = shared_dir(t.spark, "seed")
    users = t.users_fx.select("id", "country", "is_seed_data")
    keys = {"users": ["id"]}
    tables.idempotent_seed_load(t.spark, path, {"users": users}, keys)
    tables.idempotent_seed_load(
        t.spark, path, {"users": users.withColumn("country", F.lit("XX"))}, keys)
    version = tables.idempotent_seed_load(
        t.spark, path, {"users": users.withColumn("country", F.lit("YY"))}, keys, force=True)
    return t.spark.read.parquet(f"{version}/users")
