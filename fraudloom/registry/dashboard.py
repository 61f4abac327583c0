"""Queries for aggregates and scalar functions."""

from pyspark.sql import functions as F

from fraudloom.functions import columns as fn
from fraudloom.operators import events, metrics, quality
from fraudloom.operators.merge import idempotent_submit
from fraudloom.registry.core import query, sql
from fraudloom.registry.ingest import SUBMISSION_CHECK, USER_PATTERN
from fraudloom.schemas import GROUP_NOTIFY, GROUP_PROCESSOR
from fraudloom.session import shared_dir

NOW = "2024-01-20 12:00:30"


def now():
    return F.expr(f"TIMESTAMP_NTZ '{NOW}'")


VOLUME = """SELECT time_bucket(INTERVAL 5 MINUTE, created_at) AS bucket, count(*) AS transaction_count,
      CAST(sum(amount) AS DECIMAL(24,2)) AS total_amount, count(DISTINCT user_id) AS active_users"""


@query("transaction_volume_5m", sql("txn", f"{VOLUME} FROM txn GROUP BY 1"))
def volume(t):
    return metrics.transaction_volume_5m(t.txn)


@query("refresh_volume", sql("txn", f"""
    SELECT * FROM v WHERE bucket < TIMESTAMP '2024-01-19' OR bucket + INTERVAL 5 MINUTE <= TIMESTAMP '2024-01-20 11:59:30'""",
    v=f"{VOLUME} FROM txn GROUP BY 1"))
def refreshed(t):
    path = shared_dir(t.spark, "volume")
    before = t.txn.where(F.col("created_at") < F.expr("TIMESTAMP_NTZ '2024-01-19'"))
    metrics.store_volume(metrics.transaction_volume_5m(before), path)
    metrics.refresh_volume(t.txn, now(), path)
    return t.spark.read.parquet(path).drop("day")


@query("alert_stat_cards", sql("alerts_mix", """
    SELECT pending, critical, resolved, false_positives,
      CAST(CASE WHEN resolved > 0 THEN round(CAST(false_positives AS DECIMAL(18,1)) * 100 / resolved, 1) ELSE 0 END
           AS DECIMAL(5,1)) AS false_positive_rate
    FROM (SELECT count(*) FILTER (WHERE status IN ('PENDING','ESCALATED_EMAIL','ESCALATED_SLACK')) AS pending,
      count(*) FILTER (WHERE severity = 'CRITICAL' AND status NOT IN ('APPROVED','FALSE_POSITIVE')) AS critical,
      count(*) FILTER (WHERE status IN ('APPROVED','BLOCKED','FALSE_POSITIVE')) AS resolved,
      count(*) FILTER (WHERE status = 'FALSE_POSITIVE') AS false_positives FROM alerts_mix) x"""))
def cards(t):
    return metrics.alert_stat_cards(t.alerts_mix)


@query("alerts_per_bucket", sql("alerts_fx", f"""
    SELECT TIMESTAMP '{NOW}' - s.i * INTERVAL 5 MINUTE AS bucket_end, count(a.id) AS alerts
    FROM (SELECT unnest(generate_series(0, 24)) AS i) s LEFT JOIN alerts_fx a
      ON a.created_at >= TIMESTAMP '{NOW}' - (s.i + 1) * INTERVAL 5 MINUTE
     AND a.created_at < TIMESTAMP '{NOW}' - s.i * INTERVAL 5 MINUTE
    GROUP BY s.i"""))
def trend(t):
    return metrics.alerts_per_bucket(t.alerts_fx, now())


@query("user_transaction_counts", sql("users_fx txn", """
    SELECT u.id AS user_id, count(t.transaction_id) AS transaction_count
    FROM users_fx u LEFT JOIN txn t ON t.user_id = u.id GROUP BY u.id"""))
def per_user(t):
    return metrics.user_transaction_counts(t.users_fx, t.txn)


@query("ingest_outcome_counts", sql("txn_submissions raw_submissions processed_fx", """
    SELECT 'received' AS metric, CASE WHEN rn = 1 THEN 'accepted' ELSE 'duplicate' END AS label, count(*) AS n
    FROM (SELECT row_number() OVER (PARTITION BY idempotency_key ORDER BY created_at, transaction_id) AS rn
          FROM txn_submissions) x GROUP BY 2
    UNION ALL SELECT 'rejected', e, count(*) FROM (SELECT unnest(string_split(errors, ',')) AS e FROM checked WHERE errors <> '') y GROUP BY e
    UNION ALL SELECT 'processed', status, count(*) FROM processed_fx GROUP BY status
    UNION ALL SELECT 'failures', coalesce(stage, 'unknown'), count(*) FROM processed_fx
      WHERE status = 'PROCESSING_FAILED' GROUP BY 2""", checked=SUBMISSION_CHECK))
def outcomes(t):
    raw = t.raw_submissions.withColumn("field_names", F.split("field_names", ","))
    _, rejected = quality.validate_transactions(raw, USER_PATTERN)
    return metrics.ingest_outcome_counts(
        idempotent_submit(t.txn_submissions), rejected, t.processed_fx)


@query("alert_escalation_counts", sql("alerts_mix", """
    SELECT 'severity' AS kind, severity AS label, count(*) AS n FROM alerts_mix GROUP BY severity
    UNION ALL SELECT 'escalation', 'email', count(*) FROM alerts_mix WHERE escalated_email_at IS NOT NULL
    UNION ALL SELECT 'escalation', 'slack', count(*) FROM alerts_mix WHERE escalated_slack_at IS NOT NULL"""))
def escalation_counts(t):
    return metrics.alert_escalation_counts(t.alerts_mix)


ROUTED = """SELECT o.*, CASE split_part(event_type, '.', 1) WHEN 'transaction' THEN 'stream:transactions'
      WHEN 'alert' THEN 'stream:alerts' WHEN 'escalation' THEN 'stream:escalations'
      WHEN 'risk_profile' THEN 'stream:compensation'
      ELSE concat('stream:', split_part(event_type, '.', 1)) END AS stream FROM outbox_fx o"""


@query("outbox_counts", sql("outbox_fx", """
    SELECT 'published' AS metric, event_type AS label, count(*) AS n FROM routed WHERE status = 'PUBLISHED' GROUP BY event_type
    UNION ALL SELECT 'dead_lettered', stream, count(*) FROM routed WHERE status = 'DEAD_LETTERED' GROUP BY stream""",
    routed=ROUTED))
def relay_counts(t):
    return metrics.outbox_counts(events.route_events(t.outbox_fx))


@query("latency_histogram", sql("processed_fx", """
    SELECT stage, le, count(*) FILTER (WHERE s <= bound) AS n, count(*) AS total, round(sum(s), 3) AS total_seconds
    FROM (SELECT coalesce(stage, 'unknown') AS stage, epoch_us(processed_at - created_at) / 1e6 AS s FROM processed_fx
          WHERE processed_at IS NOT NULL) p
    CROSS JOIN (VALUES ('0.005', 0.005), ('0.01', 0.01), ('0.025', 0.025), ('0.05', 0.05), ('0.1', 0.1), ('0.25', 0.25),
      ('0.5', 0.5), ('1.0', 1.0), ('2.5', 2.5), ('5.0', 5.0), ('10.0', 10.0), ('+Inf', 1e18)) AS b(le, bound)
    GROUP BY stage, le"""))
def histogram(t):
    return metrics.latency_histogram(t.processed_fx)


@query("outbox_backlog", sql("outbox_fx", """
    SELECT count(*) AS backlog FROM outbox_fx WHERE status = 'PENDING'"""))
def backlog(t):
    return metrics.outbox_backlog(t.outbox_fx)


@query("stream_backlog", sql("outbox_fx inbox_fx", """
    SELECT stream, g AS consumer_group, count(*) FILTER (WHERE i.event_id IS NULL) AS backlog
    FROM routed r JOIN (VALUES ('stream:transactions', 'processor-group'), ('stream:alerts', 'gateway-notify-group'),
        ('stream:escalations', 'gateway-notify-group')) AS w(s, g) ON w.s = r.stream
    LEFT JOIN inbox_fx i ON i.event_id = r.id AND i.consumer_group = w.g GROUP BY stream, g""", routed=ROUTED))
def lag(t):
    groups = {
        GROUP_PROCESSOR: ("stream:transactions",),
        GROUP_NOTIFY: ("stream:alerts", "stream:escalations"),
    }
    return metrics.stream_backlog(events.route_events(t.outbox_fx), t.inbox_fx, groups)


@query("submission_summary", sql("processed_fx", """
    SELECT count(*) AS submitted, count(*) FILTER (WHERE a) AS accepted, count(*) FILTER (WHERE NOT a) AS failed,
      count(*) FILTER (WHERE transaction_id % 50 = 0) AS anomalous,
      round(coalesce(avg(CASE WHEN a THEN ms END), 0), 2) AS mean_latency_ms
    FROM (SELECT transaction_id, status <> 'PROCESSING_FAILED' AS a, CAST(transaction_id % 300 AS DOUBLE) AS ms FROM processed_fx) x"""))
def summary(t):
    log = t.processed_fx.select(
        (F.col("status") != "PROCESSING_FAILED").alias("accepted"),
        (F.col("transaction_id") % 50 == 0).alias("anomalous"),
        (F.col("transaction_id") % 300).cast("double").alias("latency_ms"))
    return metrics.submission_summary(log)


@query("table_row_counts", sql("users_fx txn alerts_fx risk_profiles_fx", """
    SELECT 'users' AS table_name, count(*) AS rows FROM users_fx
    UNION ALL SELECT 'transactions', count(*) FROM txn
    UNION ALL SELECT 'alerts', count(*) FROM alerts_fx
    UNION ALL SELECT 'risk_profiles', count(*) FROM risk_profiles_fx"""))
def row_counts(t):
    return metrics.table_row_counts({
        "users": t.users_fx, "transactions": t.txn, "alerts": t.alerts_fx,
        "risk_profiles": t.risk_profiles_fx})


# ------------------------------------------------------------------------- scalar functions


@query("scalar_text_functions", sql("raw_submissions", """
    SELECT submission_id, upper(trim(currency)) AS upper_code, lower(trim(merchant_category)) AS lower_code,
      coalesce(regexp_matches(upper(trim(currency)), '^[A-Z]{3}$'), FALSE) AS alpha3,
      try_cast(amount AS DECIMAL(28,8)) AS lenient, concat(substring(CAST(submission_id AS VARCHAR), 1, 8), '...') AS short,
      coalesce(currency, 'unknown') AS labelled, contains(lower(merchant_category), 'cry') AS found,
      CASE upper(country) WHEN 'US' THEN 'USD' WHEN 'DE' THEN 'EUR' WHEN 'FR' THEN 'EUR' WHEN 'NL' THEN 'EUR'
        WHEN 'GB' THEN 'GBP' WHEN 'CA' THEN 'CAD' WHEN 'JP' THEN 'JPY' WHEN 'AU' THEN 'AUD' ELSE 'USD' END AS home_currency
    FROM raw_submissions"""))
def text_functions(t):
    return t.raw_submissions.select(
        "submission_id", fn.upper_code("currency").alias("upper_code"),
        fn.lower_code("merchant_category").alias("lower_code"),
        F.coalesce(fn.is_alpha_code(fn.upper_code("currency"), 3), F.lit(False)).alias("alpha3"),
        fn.lenient_decimal("amount").alias("lenient"), fn.short_id("submission_id").alias("short"),
        fn.label("currency").alias("labelled"),
        fn.contains_text("CRY", "merchant_category").alias("found"),
        fn.currency_for_country(F.upper("country")).alias("home_currency"))


@query("scalar_number_functions", sql("txn", """
    SELECT transaction_id, CAST(round(least(greatest(x, 0), 1), 4) AS DECIMAL(5,4)) AS clamped,
      CAST(round(CAST(y AS DOUBLE) / 100e0, 4) AS DECIMAL(5,4)) AS position, CAST(CAST(0.5 AS DECIMAL(5,4)) AS DECIMAL(5,4)) AS degenerate,
      CAST(amount AS VARCHAR) AS two_digits, concat_ws(', ', CASE WHEN amount > 100 THEN 'large' END, currency) AS reasons
    FROM (SELECT *, CAST(amount / 1000 AS DECIMAL(20,6)) - 0.05 AS x, transaction_id % 101 AS y FROM txn) z"""))
def number_functions(t):
    x = (F.col("amount") / 1000).cast("decimal(20,6)") - F.lit("0.05").cast("decimal(3,2)")
    return t.txn.select(
        "transaction_id", fn.clamp01(fn.quantize4(F.greatest(F.lit(0), F.least(F.lit(1), x)))).alias("clamped"),
        fn.min_max((F.col("transaction_id") % 101).cast("double"), 0.0, 100.0).alias("position"),
        fn.min_max(F.col("amount").cast("double"), 1.0, 1.0).alias("degenerate"),
        fn.fixed_text("amount", 2).alias("two_digits"),
        fn.join_reasons([F.when(F.col("amount") > 100, "large"), F.col("currency")]).alias("reasons"))


@query("scalar_time_functions", sql("txn", """
    SELECT transaction_id, strftime(created_at, '%Y-%m-%dT%H:%M:%S.%f') AS iso, hour(created_at) AS hour_of_day,
      time_bucket(INTERVAL 5 MINUTE, created_at) AS bucket, created_at AS parsed FROM txn"""))
def time_functions(t):
    return t.txn.select(
        "transaction_id", fn.iso_time("created_at").alias("iso"),
        fn.hour_of_day("created_at").cast("bigint").alias("hour_of_day"),
        fn.bucket_start("created_at").alias("bucket"),
        fn.parse_time(fn.iso_time("created_at")).cast("timestamp_ntz").alias("parsed"))


@query("scalar_json_functions", sql("outbox_fx", """
    SELECT id, coalesce(json_extract_string(payload, '$.alert_id'), json_extract_string(payload, '$.id')) AS alert_id,
      coalesce(json_extract_string(payload, '$.target_status'), json_extract_string(payload, '$.status')) AS status,
      split_part(event_type, '.', 1) AS family FROM outbox_fx"""))
def json_functions(t):
    return t.outbox_fx.select(
        "id", fn.json_text("payload", "alert_id", "id").alias("alert_id"),
        fn.json_text("payload", "target_status", "status").alias("status"),
        fn.event_family("event_type").alias("family"))
