"""Streaming forms of detection, relay and notification."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from fraudloom.config import DetectionConfig
from fraudloom.functions.columns import derived_id
from fraudloom.operators.events import (
    alert_events, decode_envelope, encode_envelope, notification_messages, retry_or_dead_letter,
    route_events,
)
from fraudloom.operators.features import with_risk_profile
from fraudloom.operators.isolation import Forest
from fraudloom.operators.merge import first_per_key
from fraudloom.operators.profiles import add_alert_counts
from fraudloom.operators.scoring import build_alerts
from fraudloom.plans.detection import decide_enriched
from fraudloom.schemas import GROUP_PROCESSOR
from fraudloom.sources.sinks import (
    ensure_table, inbox_schema, read_batch, read_inbox, write_batch, write_history, write_inbox,
)
from fraudloom.streaming.dedup import per_batch
from fraudloom.streaming.velocity import velocity_of_batch


def submission_key() -> Column:
    """What makes two submissions the same: the idempotency key, else the transaction id."""
    return F.coalesce(
        F.concat(F.lit("key:"), F.col("idempotency_key").cast("string")),
        F.concat(F.lit("id:"), F.col("transaction_id").cast("string")))


def write_detections(
    batch: DataFrame, batch_id: int, path: str, profiles: DataFrame, rules: DataFrame,
    forest: Forest | None, cfg: DetectionConfig, group: str = GROUP_PROCESSOR,
) -> None:
    """Writes everything one micro-batch decides, each table under the batch number.

    A submission is decided unless its key is in the inbox, however late it comes; further ones
    with its key are answered in `duplicates` with the transaction that was decided. A key is
    the idempotency key or, without one, the transaction id. Profiles are those given plus the
    alerts of earlier batches. Decisions are written first and read back, so they are computed
    once; the other tables follow from the written decisions.
    """
    spark = batch.sparkSession
    ident, user = (batch.schema[name].dataType for name in ("transaction_id", "user_id"))
    inbox, moved = f"{path}/inbox", f"{path}/profile_changes"
    changes = StructType().add("user_id", user).add("new_alerts", "integer").add("batch_id", "long")
    if batch_id == 0:
        ensure_table(spark, inbox, inbox_schema(ident), "bucket", "batch_id")
        ensure_table(spark, moved, changes, "batch_id")

    keyed = batch.withColumn("submission_key", submission_key())
    known = read_inbox(keyed, inbox, batch_id)
    fresh = first_per_key(keyed, "submission_key", "created_at", "transaction_id").join(
        known, "submission_key", "left_anti")
    earlier = spark.read.schema(changes).parquet(moved).where(F.col("batch_id") < batch_id)
    counted = velocity_of_batch(fresh, f"{path}/history", batch_id, cfg.velocity_minutes, rows=batch)
    decisions = decide_enriched(
        with_risk_profile(counted, add_alert_counts(profiles, earlier)), rules, forest, cfg)
    decisions = decisions.withColumn("status", F.lit("PROCESSED"))
    write_batch(decisions, f"{path}/decisions", batch_id)
    decided = read_batch(decisions, f"{path}/decisions", batch_id)

    alerts = build_alerts(decided)
    write_batch(alerts, f"{path}/alerts", batch_id)
    write_batch(alert_events(alerts), f"{path}/outbox_events", batch_id)
    write_batch(alerts.groupBy("user_id").agg(
        F.count(F.lit(1)).cast("int").alias("new_alerts")), moved, batch_id)
    answers = known.unionByName(decided.select("submission_key", "transaction_id"))
    write_batch(
        keyed.select("submission_key", F.col("transaction_id").alias("submission_id"))
        .join(answers, "submission_key").where("submission_id <> transaction_id"),
        f"{path}/duplicates", batch_id)
    write_inbox(decided.where("submission_key IS NOT NULL"), inbox, batch_id)
    write_batch(decided.select(
        derived_id(F.lit("event"), "transaction_id").alias("event_id"),
        F.lit(group).alias("consumer_group"), F.col("created_at").alias("processed_at"),
    ), f"{path}/processed_events", batch_id)
    write_history(decided.select("user_id", "created_at", "amount"), f"{path}/history", batch_id)


def stream_detect(
    txns: DataFrame, load_profiles: Callable[[], DataFrame], load_rules: Callable[[], DataFrame],
    path: str, checkpoint: str, forest: Forest | None = None,
    cfg: DetectionConfig = DetectionConfig(),
) -> StreamingQuery:
    """Decides every transaction of a stream once, in whatever order they come.

    There is no watermark: repeats are found in the stored inbox. Rules and profiles are read
    anew in every micro-batch; `load_profiles` gives the profiles without the alerts of this
    stream. A batch that is repeated after a failure replaces what it wrote before.
    """
    return per_batch(txns, checkpoint, lambda batch, batch_id: write_detections(
        batch, batch_id, path, load_profiles(), load_rules(), forest, cfg))


def stream_relay(outbox: DataFrame) -> DataFrame:
    """Pending outbox rows as envelopes with their stream; write with `partitionBy("stream")`."""
    pending = outbox.where(F.col("status") == "PENDING")
    return encode_envelope(route_events(pending)).select("id", "stream", "envelope")


def stream_notifications(raw: DataFrame) -> DataFrame:
    """Client messages of a stream of envelopes; unreadable ones are left out."""
    ok, _ = decode_envelope(raw, keep=("created_at",))
    return notification_messages(ok).select("message_id", "event_type", "message")


def stream_retry_status(attempts: DataFrame) -> DataFrame:
    """Status of every event from its attempts so far; use output mode `update`."""
    return retry_or_dead_letter(attempts)[0]


def write_files(
    df: DataFrame, path: str, checkpoint: str, partition_by: tuple[str, ...] = (),
) -> StreamingQuery:
    """Appends a stream to Parquet files, each row once."""
    writer = df.writeStream.format("parquet").option("checkpointLocation", checkpoint)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    return writer.option("path", path).trigger(availableNow=True).start()
