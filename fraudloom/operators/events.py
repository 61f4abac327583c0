"""Event envelopes, routing, outbox rows, retries and client notifications."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from fraudloom.config import MAX_PUBLISH_RETRIES, MIN_IDLE_SECONDS
from fraudloom.functions.columns import derived_id, event_family, iso_time, json_text
from fraudloom.operators.quality import unknown_fields
from fraudloom.schemas import (
    ENVELOPE, ENVELOPE_FIELDS, EVENT_ALERT_APPROVED, EVENT_ALERT_BLOCKED, EVENT_ALERT_CREATED,
    EVENT_ALERT_FALSE_POSITIVE, EVENT_ESCALATION_EMAIL, EVENT_ESCALATION_SLACK,
    EVENT_RECALCULATE, EVENT_TRANSACTION_CREATED, EVENT_VERSION, STREAM_ALERTS,
    STREAM_COMPENSATION, STREAM_ESCALATIONS, STREAM_TRANSACTIONS,
)

REQUIRED_ENVELOPE_FIELDS = ("event_type", "producer_service", "payload")
MESSAGE_SOURCES = ("event", "envelope", "data")


def envelope_error(body: Column) -> Column:
    """Why a message body is no envelope; NULL if it is one."""
    # One complete JSON value: inside brackets it makes an array of exactly one element.
    whole = F.json_array_length(F.concat(F.lit("["), body, F.lit("]"))) == 1
    required = F.array(*[F.lit(name) for name in REQUIRED_ENVELOPE_FIELDS])

    def reason(keys: Column) -> Column:
        return (
            F.when(keys.isNull() | ~F.coalesce(whole, F.lit(False)), "not a JSON object")
            .when(F.size(unknown_fields(keys, ENVELOPE_FIELDS)) > 0, "unknown field")
            .when(F.size(F.array_except(required, keys)) > 0, "missing field")
        )

    # The keys are bound once instead of being parsed again for each of the three tests.
    return F.transform(F.array(F.json_object_keys(body)), reason)[0]


def decode_envelope(
    raw: DataFrame, key: str = "message_id", keep: tuple[str, ...] = (),
) -> tuple[DataFrame, DataFrame]:
    """Envelope columns of the readable messages, and the malformed messages with a reason.

    The envelope is taken from `event`, `envelope` or `data`, else from the flat fields, which
    are expected as JSON text in `flat`.
    """
    sources = [name for name in (*MESSAGE_SOURCES, "flat") if name in raw.columns]
    # Body and check come out of one generator, so a filter on the check cannot make Spark
    # evaluate the body again for each of its uses.
    checked = F.transform(F.array(F.coalesce(*sources)), lambda text: F.struct(
        text.alias("body"), envelope_error(text).alias("error")))
    body = raw.select(key, *keep, F.inline(checked))
    fields = F.from_json("body", ENVELOPE)
    ok = body.where("error IS NULL").withColumn("_e", fields).select(
        key, *keep,
        *[F.coalesce("_e.event_version", F.lit(EVENT_VERSION)).alias(name)
          if name == "event_version" else F.col(f"_e.{name}") for name in ENVELOPE_FIELDS])
    return ok, body.where("error IS NOT NULL")


def encode_envelope(outbox: DataFrame) -> DataFrame:
    """Adds the envelope JSON of outbox rows; a payload that is no object goes under `data`."""
    is_object = F.json_object_keys("payload").isNotNull()
    payload = F.when(is_object, F.col("payload")).otherwise(
        F.concat(F.lit('{"data":'), F.col("payload"), F.lit("}")))
    head = F.to_json(F.struct(
        F.col("id").cast("string").alias("event_id"),
        F.col("correlation_id").cast("string").alias("correlation_id"),
        "event_type", "event_version", iso_time("created_at").alias("occurred_at"),
        "producer_service",
    ))
    # The payload is JSON text already, so it is spliced in before the closing brace.
    text = F.concat(
        F.substring(head, F.lit(1), F.length(head) - 1), F.lit(',"payload":'), payload, F.lit("}"))
    return outbox.withColumn("envelope", text)


def stream_of(event_type: Column | str) -> Column:
    col = F.col(event_type) if isinstance(event_type, str) else event_type
    return (
        F.when(col.startswith("transaction."), STREAM_TRANSACTIONS)
        .when(col.startswith("alert."), STREAM_ALERTS)
        .when(col.startswith("escalation."), STREAM_ESCALATIONS)
        .when(col.startswith("risk_profile."), STREAM_COMPENSATION)
        .otherwise(F.concat(F.lit("stream:"), event_family(col)))
    )


def route_events(events: DataFrame) -> DataFrame:
    return events.withColumn("stream", stream_of("event_type"))


def dead_letters(
    malformed: DataFrame, stream: str, group: str, attempts: Column | int = 1,
    key: str = "message_id",
) -> DataFrame:
    """Dead-letter rows of messages that cannot be decoded."""
    family = stream.split(":")[-1].rstrip("s")
    tries = attempts if isinstance(attempts, Column) else F.lit(attempts)
    return malformed.select(
        derived_id(F.lit("dead"), F.lit(stream), key).alias("id"),
        F.col(key).cast("string").alias("original_event_id"),
        F.lit(f"unknown.{family}").alias("event_type"),
        F.coalesce("body", F.lit("")).alias("payload"),
        F.col("error").alias("error_message"),
        tries.cast("int").alias("retry_count"),
        F.lit(stream).alias("stream_name"), F.lit(group).alias("consumer_group"),
    )


def malformed_compensation(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Splits recalculation events: usable ones, and those whose payload has no user."""
    user = json_text("payload", "user_id")
    return (
        events.where(user.isNotNull()).withColumn("user_id", user),
        events.where(user.isNull()).withColumns({
            "body": F.col("payload"), "error": F.lit("missing user_id")}),
    )


def _outbox(df: DataFrame, event_type: Column, payload: Column, producer: str, at: Column,
            ident: Column) -> DataFrame:
    return df.select(
        derived_id(F.lit("event"), event_type, ident, at).alias("id"),
        event_type.alias("event_type"), F.lit(EVENT_VERSION).alias("event_version"),
        payload.alias("payload"), F.col("correlation_id").cast("string").alias("correlation_id"),
        F.lit(producer).alias("producer_service"), F.lit("PENDING").alias("status"),
        F.lit(0).alias("retry_count"), at.alias("created_at"),
    )


def _text(name: str) -> Column:
    return F.col(name).cast("string").alias(name)


def transaction_events(accepted: DataFrame) -> DataFrame:
    payload = F.to_json(F.struct(
        _text("transaction_id"), _text("user_id"), _text("amount"), "currency", "country",
        "merchant_category", iso_time("created_at").alias("created_at"), "metadata",
    ))
    return _outbox(accepted, F.lit(EVENT_TRANSACTION_CREATED), payload, "gateway",
                   F.col("created_at"), F.col("transaction_id"))


def alert_events(alerts: DataFrame) -> DataFrame:
    payload = F.to_json(F.struct(
        F.col("id").cast("string").alias("alert_id"), _text("transaction_id"), _text("user_id"),
        "status", "severity", _text("composite_risk_score"), _text("ml_anomaly_score"),
        "rule_matches", "is_demo", iso_time("created_at").alias("created_at"),
    ))
    return _outbox(alerts, F.lit(EVENT_ALERT_CREATED), payload, "processor",
                   F.col("created_at"), F.col("id"))


def resolution_events(outcomes: DataFrame) -> DataFrame:
    """Events of applied actions, plus a recalculation for every false positive."""
    applied = outcomes.where(F.col("outcome") == "applied")
    kind = F.concat(F.lit("alert."), F.lower("target_status"))
    severity, reason = ([name for name in (wanted,) if name in outcomes.columns]
                        for wanted in ("severity", "resolution_reason"))
    payload = F.to_json(F.struct(
        _text("alert_id"), _text("transaction_id"), _text("user_id"),
        F.col("target_status").alias("status"), *severity, F.col("actor").alias("resolved_by"),
        iso_time("acted_at").alias("resolved_at"), *reason,
    ), {"ignoreNullFields": "false"})
    recalculation = F.to_json(F.struct(
        _text("user_id"), _text("alert_id"), _text("correlation_id"),
        F.lit("false_positive_resolution").alias("reason"),
        iso_time("acted_at").alias("resolved_at"),
    ))
    false_positives = applied.where(F.col("target_status") == "FALSE_POSITIVE")
    return _outbox(
        applied, kind, payload, "gateway", F.col("acted_at"), F.col("alert_id")
    ).unionByName(_outbox(
        false_positives, F.lit(EVENT_RECALCULATE), recalculation, "gateway", F.col("acted_at"),
        F.col("alert_id")))


def escalation_events(escalations: DataFrame) -> DataFrame:
    email = F.col("level") == "email"
    payload = F.to_json(F.struct(
        F.col("id").cast("string").alias("alert_id"), _text("transaction_id"), _text("user_id"),
        F.when(email, "ESCALATED_EMAIL").otherwise("ESCALATED_SLACK").alias("status"),
        "severity", _text("composite_risk_score"), F.col("level").alias("escalation_type"),
        iso_time("escalated_at").alias("escalated_at"),
    ))
    kind = F.when(email, EVENT_ESCALATION_EMAIL).otherwise(EVENT_ESCALATION_SLACK)
    return _outbox(escalations, kind, payload, "processor", F.col("escalated_at"), F.col("id"))


def retry_or_dead_letter(
    attempts: DataFrame, max_retries: int = MAX_PUBLISH_RETRIES,
) -> tuple[DataFrame, DataFrame]:
    """Status of every event from its attempt log, and the dead letters among them.

    Attempts after the one that used up the retries do not count.
    """
    status = attempts.groupBy("event_id").agg(
        F.count_if(~F.col("succeeded")).cast("int").alias("retry_count"),
        F.max("succeeded").alias("_done"),
        F.max("event_type").alias("event_type"),
        F.min(F.when(F.col("succeeded"), F.col("attempted_at"))).alias("published_at"),
    ).withColumn(
        "status",
        F.when(F.col("retry_count") >= max_retries, "DEAD_LETTERED")
        .when(F.col("_done"), "PUBLISHED").otherwise("PENDING"),
    )
    result = status.select(
        "event_id", "event_type", "status",
        F.least("retry_count", F.lit(max_retries)).alias("retry_count"),
        F.when(F.col("status") == "PUBLISHED", F.col("published_at")).alias("published_at"),
    )
    dead = route_events(result.where(F.col("status") == "DEAD_LETTERED")).select(
        F.col("event_id").alias("original_event_id"), "event_type", "retry_count",
        F.col("stream").alias("stream_name"))
    return result, dead


def stalled_messages(
    deliveries: DataFrame, acks: DataFrame, now: Column, min_idle_seconds: int = MIN_IDLE_SECONDS,
) -> DataFrame:
    """Delivered, not acknowledged and idle messages with their number of deliveries."""
    keys = ["stream", "consumer_group", "message_id"]
    last = deliveries.groupBy(*keys).agg(
        F.max("delivered_at").alias("last_delivered_at"),
        F.count(F.lit(1)).alias("delivery_count"),
    )
    idle = F.col("last_delivered_at") <= now - F.expr(f"INTERVAL {min_idle_seconds} SECOND")
    return last.where(idle).join(acks.select(*keys), keys, "left_anti")


# Default status of a resolution event without a status in its payload (fixed values).
RESOLUTION_STATUS = {
    EVENT_ALERT_APPROVED: "APPROVED",
    EVENT_ALERT_BLOCKED: "BLOCKED",
    EVENT_ALERT_FALSE_POSITIVE: "FALSE_POSITIVE",
}


def notification_messages(events: DataFrame) -> DataFrame:
    """Adds the client message of every event as JSON text."""
    kind = F.col("event_type")
    alert_id = F.coalesce(json_text("payload", "alert_id", "id"), F.lit(""))
    at = iso_time("created_at")
    created = F.to_json(F.struct(F.lit("alert.created").alias("type"), F.struct(
        alert_id.alias("id"),
        F.coalesce(json_text("payload", "transaction_id"), F.lit("")).alias("transaction_id"),
        F.coalesce(F.get_json_object("payload", "$.status"), F.lit("PENDING")).alias("status"),
        F.coalesce(F.get_json_object("payload", "$.severity"), F.lit("MEDIUM")).alias("severity"),
        F.coalesce(F.get_json_object("payload", "$.composite_risk_score"), F.lit("0.0"))
        .alias("composite_risk_score"),
        F.coalesce(json_text("payload", "created_at"), at).alias("created_at"),
    ).alias("alert")))
    status = F.lit("PENDING")
    for event_type, value in RESOLUTION_STATUS.items():
        status = F.when(kind == event_type, value).otherwise(status)
    updated = F.to_json(F.struct(F.lit("alert.updated").alias("type"), F.struct(
        alert_id.alias("id"),
        F.coalesce(json_text("payload", "target_status", "status"), status).alias("status"),
        F.coalesce(json_text("payload", "resolved_at"), at).alias("resolved_at"),
    ).alias("alert")))
    level = F.when(kind == EVENT_ESCALATION_EMAIL, "email").otherwise("slack")
    escalation = F.to_json(F.struct(
        F.lit("escalation").alias("type"), alert_id.alias("alert_id"),
        level.alias("escalation_level")))
    generic = F.concat(
        F.lit('{"type":"'), kind, F.lit('","payload":'), F.col("payload"), F.lit("}"))
    return events.withColumn(
        "message",
        F.when(kind == EVENT_ALERT_CREATED, created)
        .when(kind.startswith("alert."), updated)
        .when(kind.isin(EVENT_ESCALATION_EMAIL, EVENT_ESCALATION_SLACK), escalation)
        .otherwise(generic),
    )


def apply_notifications(alerts: DataFrame, messages: DataFrame) -> DataFrame:
    """Folds client messages into the alert table in message order.

    Creations insert or replace, updates and escalations change the latest state of a known
    alert. Everything is decided by one aggregate per alert id.
    """
    def get(path: str) -> Column:
        return F.get_json_object("message", f"$.{path}")

    kind = get("type")
    order = F.struct("created_at", "event_id")
    parsed = messages.select(
        F.coalesce(get("alert.id"), get("alert_id")).alias("id"), order.alias("o"),
        (kind == "alert.created").alias("creates"),
        F.when(kind == "escalation", F.when(
            get("escalation_level") == "email", "ESCALATED_EMAIL").otherwise("ESCALATED_SLACK"))
        .otherwise(get("alert.status")).alias("status"),
        get("alert.severity").alias("severity"), get("alert.resolved_at").alias("resolved_at"),
    ).where(kind.isin("alert.created", "alert.updated", "escalation"))
    creates = F.col("creates")
    changes = parsed.groupBy("id").agg(
        F.max(F.when(creates, F.struct("o", "severity"))).alias("_new"),
        F.max(F.struct("o", "status")).alias("_last"),
        F.max(F.when(F.col("resolved_at").isNotNull(), F.struct("o", "resolved_at")))
        .alias("_resolved"),
    )
    base = alerts.select(
        F.col("id").cast("string").alias("id"), F.lit(True).alias("_known"),
        F.col("status").alias("_status"), F.col("severity").alias("_severity"),
    )
    joined = base.join(changes, "id", "full_outer")
    created = F.col("_new").isNotNull()
    return joined.where(F.col("_known") | created).select(
        "id",
        F.coalesce("_last.status", "_status").alias("status"),
        F.coalesce("_new.severity", "_severity").alias("severity"),
        F.when(created, F.when(F.col("_resolved.o") > F.col("_new.o"),
                               F.col("_resolved.resolved_at")))
        .otherwise(F.col("_resolved.resolved_at")).alias("resolved_at"),
    )
