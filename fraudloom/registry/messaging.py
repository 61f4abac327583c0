"""Queries for envelopes, routing, retries and notifications."""

from pyspark.sql import functions as F

from fraudloom.fixtures import seeded_rules
from fraudloom.operators import events, lifecycle, quality
from fraudloom.operators.scoring import build_alerts
from fraudloom.plans.detection import detect
from fraudloom.registry.core import query, sql
from fraudloom.registry.dashboard import ROUTED
from fraudloom.registry.detection import CFG, upto
from fraudloom.registry.lifecycle import DUE, OUTCOMES, TICK, WINNERS, at

DECODED = """
    SELECT message_id, body,
      CASE WHEN NOT json_valid(body) THEN 'not a JSON object'
           WHEN json_extract(body, '$.extra') IS NOT NULL THEN 'unknown field'
           WHEN json_extract(body, '$.payload') IS NULL THEN 'missing field' END AS error
    FROM (SELECT message_id, coalesce(event, envelope, data, flat) AS body FROM raw_messages) m"""


@query("decode_envelope", sql("raw_messages", """
    SELECT message_id, json_extract_string(body, '$.event_id') AS event_id,
      json_extract_string(body, '$.correlation_id') AS correlation_id,
      coalesce(json_extract_string(body, '$.event_version'), '1.0') AS event_version,
      json_extract_string(body, '$.payload.transaction_id') AS payload_id
    FROM (SELECT * FROM decoded WHERE error IS NULL) d""", decoded=DECODED))
def decoded(t):
    ok, _ = events.decode_envelope(t.raw_messages)
    return ok.select("message_id", "event_id", "correlation_id", "event_version",
                     F.get_json_object("payload", "$.transaction_id").alias("payload_id"))


@query("malformed_envelopes", sql("raw_messages", """
    SELECT message_id, error FROM decoded WHERE error IS NOT NULL""", decoded=DECODED))
def malformed(t):
    return events.decode_envelope(t.raw_messages)[1].select("message_id", "error")


@query("dead_letter_sink", sql("raw_messages", """
    SELECT sha256(concat('dead|stream:transactions|', CAST(message_id AS VARCHAR))) AS id,
      CAST(message_id AS VARCHAR) AS original_event_id, 'unknown.transaction' AS event_type, body AS payload,
      error AS error_message, CAST(1 AS INT) AS retry_count, 'stream:transactions' AS stream_name,
      'processor-group' AS consumer_group
    FROM decoded WHERE error IS NOT NULL""", decoded=DECODED))
def dead_letters(t):
    _, bad = events.decode_envelope(t.raw_messages)
    return events.dead_letters(bad, "stream:transactions", "processor-group")


@query("payload_to_transaction", sql("raw_messages", """
    SELECT message_id, json_extract_string(body, '$.payload.transaction_id') AS transaction_id,
      json_extract_string(body, '$.payload.user_id') AS user_id,
      CAST(json_extract_string(body, '$.payload.amount') AS DECIMAL(14,2)) AS amount, 'USD' AS currency,
      json_extract_string(body, '$.payload.country') AS country, '' AS merchant_category,
      TIMESTAMP '2024-01-01 00:00:00' AS created_at, '{}' AS metadata
    FROM (SELECT * FROM decoded WHERE error IS NULL) d""", decoded=DECODED))
def typed(t):
    ok, _ = events.decode_envelope(t.raw_messages)
    return quality.payload_to_transaction(ok).select(
        "message_id", "transaction_id", "user_id", "amount", "currency", "country",
        "merchant_category", F.col("created_at").cast("timestamp_ntz").alias("created_at"),
        "metadata")


ENVELOPE = """concat('{"event_id":"', CAST(id AS VARCHAR), '","correlation_id":"', correlation_id, '","event_type":"', event_type,
      '","event_version":"1.0","occurred_at":"', strftime(created_at, '%Y-%m-%dT%H:%M:%S.%f'),
      '","producer_service":"gateway","payload":',
      CASE WHEN payload = '"plain"' THEN '{"data":"plain"}' ELSE payload END, '}')"""


@query("encode_envelope", sql("outbox_fx", f"SELECT id, {ENVELOPE} AS envelope FROM outbox_fx"))
def encoded(t):
    return events.encode_envelope(t.outbox_fx).select("id", "envelope")


@query("route_events", sql("outbox_fx", "SELECT id, event_type, stream FROM routed", routed=ROUTED))
def routed(t):
    return events.route_events(t.outbox_fx).select("id", "event_type", "stream")


@query("build_outbox_events", sql("actions_fx alerts_mix", f"""
    SELECT concat('alert.', lower(target_status)) AS event_type, CAST(o.alert_id AS VARCHAR) AS alert_id,
      o.target_status AS status, o.severity, o.resolution_reason, m.correlation_id, 'gateway' AS producer_service, o.acted_at AS created_at
    FROM outcomes o JOIN alerts_mix m ON m.id = o.alert_id WHERE outcome = 'applied'
    UNION ALL SELECT 'risk_profile.recalculate', CAST(o.alert_id AS VARCHAR), NULL, NULL, NULL, m.correlation_id, 'gateway', o.acted_at
    FROM outcomes o JOIN alerts_mix m ON m.id = o.alert_id
    WHERE outcome = 'applied' AND target_status = 'FALSE_POSITIVE'
    UNION ALL SELECT concat('escalation.', level, '.requested'), CAST(d.id AS VARCHAR), concat('ESCALATED_', upper(level)),
      m.severity, NULL, m.correlation_id, 'processor', TIMESTAMP '{TICK}' FROM due d JOIN alerts_mix m ON m.id = d.id""",
    winners=WINNERS, outcomes=OUTCOMES, due=DUE))
def outbox_rows(t):
    outcomes = lifecycle.actions_to_alerts(t.alerts_mix, t.actions_fx)
    _, escalated = lifecycle.escalation_tick(t.alerts_mix, at(TICK))
    rows = events.resolution_events(outcomes).unionByName(events.escalation_events(escalated))
    return rows.select(
        "event_type", F.get_json_object("payload", "$.alert_id").alias("alert_id"),
        *[F.get_json_object("payload", f"$.{name}").alias(name)
          for name in ("status", "severity", "resolution_reason")],
        "correlation_id", "producer_service", "created_at")


@query("transaction_outbox_events", sql("txn", """
    SELECT sha256(concat('event|transaction.created|', CAST(transaction_id AS VARCHAR), '|',
        CASE WHEN strftime(created_at, '%f') = '000000' THEN strftime(created_at, '%Y-%m-%d %H:%M:%S')
             ELSE rtrim(strftime(created_at, '%Y-%m-%d %H:%M:%S.%f'), '0') END)) AS id,
      correlation_id, created_at,
      concat('{"transaction_id":"', CAST(transaction_id AS VARCHAR), '","user_id":"', CAST(user_id AS VARCHAR), '","amount":"',
        CAST(amount AS VARCHAR), '","currency":"', currency, '","country":"', country, '","merchant_category":"', merchant_category,
        '","created_at":"', strftime(created_at, '%Y-%m-%dT%H:%M:%S.%f'), '","metadata":"', replace(metadata, '"', '\\"'), '"}') AS payload
    FROM txn"""))
def transaction_rows(t):
    return events.transaction_events(t.txn).select("id", "correlation_id", "created_at", "payload")


@query("alert_outbox_events", upto("""
    SELECT 'alert.created' AS event_type, sha256(concat('alert|', CAST(transaction_id AS VARCHAR))) AS alert_id,
      severity, CAST(composite_risk_score AS VARCHAR) AS composite_risk_score, correlation_id, 'processor' AS producer_service
    FROM decided WHERE should_alert"""))
def alert_rows(t):
    found = build_alerts(detect(t.txn, t.risk_profiles_fx, seeded_rules(t.spark), cfg=CFG))
    p = F.col("payload")
    return events.alert_events(found).select(
        "event_type", F.get_json_object(p, "$.alert_id").alias("alert_id"),
        F.get_json_object(p, "$.severity").alias("severity"),
        F.get_json_object(p, "$.composite_risk_score").alias("composite_risk_score"),
        "correlation_id", "producer_service")


FAILED = """
    SELECT event_id, count(*) FILTER (WHERE NOT succeeded) AS fails, bool_or(succeeded) AS done,
      min(CASE WHEN succeeded THEN attempted_at END) AS first_ok FROM attempts_fx GROUP BY event_id"""


@query("retry_or_dead_letter", sql("attempts_fx", """
    SELECT event_id, 'alert.created' AS event_type,
      CASE WHEN fails >= 8 THEN 'DEAD_LETTERED' WHEN done THEN 'PUBLISHED' ELSE 'PENDING' END AS status,
      CAST(least(fails, 8) AS INT) AS retry_count, CASE WHEN fails < 8 THEN first_ok END AS published_at FROM failed""",
    failed=FAILED))
def retries(t):
    return events.retry_or_dead_letter(t.attempts_fx)[0]


@query("exhausted_events", sql("attempts_fx", """
    SELECT event_id AS original_event_id, 'alert.created' AS event_type, CAST(8 AS INT) AS retry_count, 'stream:alerts' AS stream_name
    FROM failed WHERE fails >= 8""", failed=FAILED))
def exhausted(t):
    return events.retry_or_dead_letter(t.attempts_fx)[1]


@query("stalled_messages", sql("deliveries_fx acks_fx", """
    SELECT d.stream, d.consumer_group, d.message_id, max(delivered_at) AS last_delivered_at, count(*) AS delivery_count
    FROM deliveries_fx d LEFT JOIN acks_fx a ON a.message_id = d.message_id
    WHERE a.message_id IS NULL
    GROUP BY 1, 2, 3 HAVING max(delivered_at) <= TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 30 SECOND"""))
def stalled(t):
    return events.stalled_messages(t.deliveries_fx, t.acks_fx, at("2024-01-20 00:00:00"))


MESSAGE = """
    SELECT id, event_type, correlation_id, created_at, CASE
      WHEN event_type = 'alert.created' THEN concat('{"type":"alert.created","alert":{"id":"', coalesce(aid, ''), '","transaction_id":"',
        coalesce(tid, ''), '","status":"', coalesce(st, 'PENDING'), '","severity":"', coalesce(sev, 'MEDIUM'),
        '","composite_risk_score":"0.0","created_at":"', iso, '"}}')
      WHEN event_type LIKE 'alert.%' THEN concat('{"type":"alert.updated","alert":{"id":"', coalesce(aid, ''), '","status":"',
        coalesce(ts, st, upper(split_part(event_type, '.', 2))), '","resolved_at":"', iso, '"}}')
      WHEN event_type LIKE 'escalation.%' THEN concat('{"type":"escalation","alert_id":"', coalesce(aid, ''),
        '","escalation_level":"', split_part(event_type, '.', 2), '"}')
      ELSE concat('{"type":"', event_type, '","payload":', payload, '}') END AS message
    FROM (SELECT *, strftime(created_at, '%Y-%m-%dT%H:%M:%S.%f') AS iso,
        coalesce(json_extract_string(payload, '$.alert_id'), json_extract_string(payload, '$.id')) AS aid,
        json_extract_string(payload, '$.transaction_id') AS tid, json_extract_string(payload, '$.status') AS st,
        json_extract_string(payload, '$.target_status') AS ts, json_extract_string(payload, '$.severity') AS sev
      FROM outbox_fx) o"""


@query("notification_messages", sql("outbox_fx", "SELECT id, message FROM msg", msg=MESSAGE))
def messages(t):
    return events.notification_messages(t.outbox_fx).select("id", "message")


@query("apply_notifications", sql("outbox_fx alerts_fx", """
    SELECT coalesce(CAST(b.id AS VARCHAR), m.aid) AS id,
      CASE WHEN m.aid IS NULL THEN b.status WHEN m.event_type LIKE 'escalation%' THEN concat('ESCALATED_', upper(split_part(m.event_type, '.', 2)))
        ELSE json_extract_string(m.message, '$.alert.status') END AS status,
      CASE WHEN m.event_type = 'alert.created' THEN 'HIGH' ELSE b.severity END AS severity,
      json_extract_string(m.message, '$.alert.resolved_at') AS resolved_at
    FROM alerts_fx b FULL OUTER JOIN (
      SELECT *, CAST(id AS VARCHAR) AS aid FROM msg
      WHERE event_type LIKE 'alert.%' OR event_type LIKE 'escalation.%') m ON m.id = b.id
    WHERE b.id IS NOT NULL OR m.event_type = 'alert.created'""", msg=MESSAGE))
def folded(t):
    sent = events.notification_messages(t.outbox_fx).withColumnRenamed("id", "event_id")
    return events.apply_notifications(t.alerts_fx, sent)


@query("relay_outbox", sql("outbox_fx", f"""
    SELECT id, stream, 'PUBLISHED' AS status, {ENVELOPE} AS envelope FROM routed WHERE status = 'PENDING'""", routed=ROUTED))
def relayed(t):
    from fraudloom.sources.sinks import write_streams
    from fraudloom.session import shared_dir

    path = shared_dir(t.spark, "relay")
    write_streams(t.outbox_fx.where("status = 'PENDING'"), path)
    return t.spark.read.parquet(path).select("id", "stream", "status", "envelope")


@query("relay_claims", sql("outbox_fx", f"""
    SELECT id, stream, {ENVELOPE} AS envelope, CAST(1 AS BIGINT) AS times, 'PUBLISHED' AS status
    FROM routed WHERE status = 'PENDING'""", routed=ROUTED))
def relayed_by_claims(t):
    """Two claimers of which one dies before its commit, a third run of one claimer, and one more."""
    from fraudloom.session import shared_dir
    from fraudloom.sources.relay import outbox_status, published, relay_claim

    path, outbox = shared_dir(t.spark, "claims"), t.outbox_fx
    relay_claim(outbox, path, 0, 2, limit=100)
    relay_claim(outbox, path, 1, 2, commit=False)
    relay_claim(outbox, path, 1, 2)
    relay_claim(outbox, path, 0, 1)
    relay_claim(outbox, path, 0, 1)
    sent = published(outbox, path).groupBy("id", "stream", "envelope").agg(
        F.count(F.lit(1)).alias("times"))
    return sent.join(outbox_status(outbox, path).select("id", "status"), "id")
