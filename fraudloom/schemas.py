"""Table schemas, enumerations and names shared by all operators."""

from __future__ import annotations

from pyspark.sql import types as T

MONEY = T.DecimalType(14, 2)
SCORE = T.DecimalType(5, 4)

# Enumerations (fixed values).
TRANSACTION_STATUSES = ("SUBMITTED", "PROCESSING", "PROCESSED", "PROCESSING_FAILED")
ALERT_STATUSES = (
    "PENDING", "ESCALATED_EMAIL", "ESCALATED_SLACK", "APPROVED", "BLOCKED", "FALSE_POSITIVE",
)
OPEN_STATUSES = ("PENDING", "ESCALATED_EMAIL", "ESCALATED_SLACK")
ESCALATED_STATUSES = ("ESCALATED_EMAIL", "ESCALATED_SLACK")
TERMINAL_STATUSES = ("APPROVED", "BLOCKED", "FALSE_POSITIVE")
SEVERITIES = ("LOW", "MEDIUM", "HIGH", "CRITICAL")
RULE_TYPES = (
    "AMOUNT_THRESHOLD", "HIGH_RISK_COUNTRY", "VELOCITY", "USER_RISK_LEVEL", "MERCHANT_CATEGORY",
)
OUTBOX_STATUSES = ("PENDING", "PUBLISHED", "DEAD_LETTERED")

# Streams, consumer groups and event types (fixed values).
STREAM_TRANSACTIONS = "stream:transactions"
STREAM_ALERTS = "stream:alerts"
STREAM_ESCALATIONS = "stream:escalations"
STREAM_COMPENSATION = "stream:compensation"
GROUP_PROCESSOR = "processor-group"
GROUP_COMPENSATION = "processor-compensation-group"
GROUP_NOTIFY = "gateway-notify-group"
EVENT_TRANSACTION_CREATED = "transaction.created"
EVENT_ALERT_CREATED = "alert.created"
EVENT_ALERT_APPROVED = "alert.approved"
EVENT_ALERT_BLOCKED = "alert.blocked"
EVENT_ALERT_FALSE_POSITIVE = "alert.false_positive"
EVENT_ESCALATION_EMAIL = "escalation.email.requested"
EVENT_ESCALATION_SLACK = "escalation.slack.requested"
EVENT_RECALCULATE = "risk_profile.recalculate"
EVENT_VERSION = "1.0"
SYSTEM_ACTOR = "system:escalation_scheduler"

ENVELOPE_FIELDS = (
    "event_id", "correlation_id", "event_type", "event_version", "occurred_at",
    "producer_service", "payload",
)


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


S, B, I, TS = T.StringType(), T.BooleanType(), T.IntegerType(), T.TimestampType()

RULE_MATCH = _struct(
    rule_id=S, rule_name=S, rule_type=S, severity=S, explanation=S, parameters_snapshot=S,
    matched_at=TS,
)
PROFILE_SNAPSHOT = _struct(
    user_id=S, risk_score=SCORE, total_alerts=I, false_positive_count=I, last_recalculated_at=TS,
)

TABLES: dict[str, T.StructType] = {
    "users": _struct(
        id=S, full_name=S, email=S, country=S, account_created_at=TS, is_seed_data=B,
        created_at=TS, updated_at=TS,
    ),
    "fraud_rules": _struct(
        id=S, name=S, rule_type=S, parameters=S, severity=S, enabled=B, created_at=TS,
        updated_at=TS,
    ),
    "audit_logs": _struct(
        id=S, actor=S, action=S, entity_type=S, entity_id=S, before=S, after=S,
        correlation_id=S, created_at=TS,
    ),
    "transactions": _struct(
        id=S, created_at=TS, user_id=S, amount=MONEY, currency=S, country=S,
        merchant_category=S, status=S, idempotency_key=S, metadata=S, correlation_id=S,
        processed_at=TS,
    ),
    "alerts": _struct(
        id=S, transaction_id=S, user_id=S, status=S, severity=S, composite_risk_score=SCORE,
        ml_anomaly_score=SCORE, rule_matches=T.ArrayType(RULE_MATCH),
        risk_profile_snapshot=PROFILE_SNAPSHOT, is_demo=B, resolved_by=S, resolved_at=TS,
        resolution_reason=S, escalated_email_at=TS, escalated_slack_at=TS, correlation_id=S,
        created_at=TS,
    ),
    "risk_profiles": _struct(
        user_id=S, risk_score=SCORE, total_alerts=I, false_positive_count=I,
        last_recalculated_at=TS,
    ),
    "outbox_events": _struct(
        id=S, event_type=S, event_version=S, payload=S, correlation_id=S, producer_service=S,
        status=S, retry_count=I, created_at=TS, published_at=TS,
    ),
    "processed_events": _struct(event_id=S, consumer_group=S, processed_at=TS),
    "dead_letter_events": _struct(
        id=S, original_event_id=S, event_type=S, payload=S, error_message=S, retry_count=I,
        stream_name=S, consumer_group=S, created_at=TS,
    ),
    "transaction_volume_5m": _struct(
        bucket=TS, transaction_count=T.LongType(), total_amount=T.DecimalType(24, 2),
        active_users=T.LongType(),
    ),
}

# Declared keys: table -> list of unique column sets.
UNIQUE_KEYS: dict[str, list[list[str]]] = {
    "users": [["id"], ["email"]],
    "transactions": [["id", "created_at"], ["idempotency_key", "created_at"]],
    "alerts": [["id"], ["transaction_id"]],
    "risk_profiles": [["user_id"]],
    "processed_events": [["event_id", "consumer_group"]],
}

ENVELOPE = _struct(
    event_id=S, correlation_id=S, event_type=S, event_version=S, occurred_at=S,
    producer_service=S, payload=S,
)
