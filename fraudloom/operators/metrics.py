"""Aggregates: transaction volume, dashboard counters, operational metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from fraudloom.functions.columns import bucket_start, label, micros
from fraudloom.plans.slices import MINUTE_US
from fraudloom.schemas import OPEN_STATUSES, TERMINAL_STATUSES

BUCKET_MINUTES = 5
TREND_BUCKETS = 25

# Upper bounds of the latency histogram in seconds (fixed values).
LATENCY_BOUNDS = (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0)


def transaction_volume_5m(txns: DataFrame, ts: str = "created_at") -> DataFrame:
    """Count, amount and distinct users per 5-minute bucket."""
    return txns.groupBy(bucket_start(ts).alias("bucket")).agg(
        F.count(F.lit(1)).alias("transaction_count"),
        F.sum("amount").alias("total_amount"),
        F.countDistinct("user_id").alias("active_users"),
    )


def refresh_range(now: Column) -> tuple[Column, Column]:
    """Buckets to rebuild: from the day that started a day ago up to a minute ago."""
    start = F.date_trunc("day", now - F.expr("INTERVAL 1 DAY")).cast("timestamp_ntz")
    return start, now - F.expr("INTERVAL 1 MINUTE")


def refresh_volume(txns: DataFrame, now: Column, path: str) -> None:
    """Rebuilds the recent day partitions of the stored aggregate and leaves older ones alone.

    Only whole buckets that ended before the range end are written. The scan is limited to the
    range, so its cost follows two days of data, not the table.
    """
    start, end = refresh_range(now)
    recent = txns.where((F.col("created_at") >= start) & (F.col("created_at") < end))
    volume = transaction_volume_5m(recent).where(
        F.col("bucket") + F.expr(f"INTERVAL {BUCKET_MINUTES} MINUTE") <= end
    )
    store_volume(volume, path)


def store_volume(volume: DataFrame, path: str) -> None:
    """Writes buckets into day partitions, replacing only the days that occur."""
    (
        volume.withColumn("day", F.to_date("bucket"))
        .hint("rebalance", "day")
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy("day").parquet(path)
    )


def alert_stat_cards(alerts: DataFrame) -> DataFrame:
    """Dashboard counters in one pass."""
    status = F.col("status")
    critical = (F.col("severity") == "CRITICAL") & ~status.isin("APPROVED", "FALSE_POSITIVE")
    counted = alerts.agg(
        F.count_if(status.isin(*OPEN_STATUSES)).alias("pending"),
        F.count_if(critical).alias("critical"),
        F.count_if(status.isin(*TERMINAL_STATUSES)).alias("resolved"),
        F.count_if(status == "FALSE_POSITIVE").alias("false_positives"),
    )
    rate = F.round(F.col("false_positives") * F.lit(100).cast("decimal(5,1)") / F.col("resolved"), 1)
    return counted.withColumn(
        "false_positive_rate",
        F.when(F.col("resolved") > 0, rate).otherwise(F.lit(0)).cast("decimal(5,1)"),
    )


def alerts_per_bucket(
    alerts: DataFrame, now: Column, buckets: int = TREND_BUCKETS, closed: str = "left",
) -> DataFrame:
    """Alerts per 5-minute bucket up to `now`, with zero rows for empty buckets.

    `closed="both"` also counts an alert on a boundary in the bucket that ends there. Alerts
    are reduced to one count per bucket before they meet the list of buckets.
    """
    width = BUCKET_MINUTES * MINUTE_US
    now_us = micros(now)
    age = now_us - micros("created_at")
    recent = alerts.where(
        (F.col("created_at") <= now)
        & (F.col("created_at") >= now - F.expr(f"INTERVAL {buckets * BUCKET_MINUTES} MINUTE"))
    )
    # Bucket i ends i widths before now: (end - width, end] by age is [i*width, (i+1)*width).
    whole = F.call_function("div", age, F.lit(width))
    on_edge = F.pmod(age, F.lit(width)) == 0
    if closed == "both":
        numbers = F.when(on_edge, F.array(whole, whole - 1)).otherwise(F.array(whole))
    else:
        numbers = F.array(F.when(on_edge, whole - 1).otherwise(whole))
    counts = recent.select(F.explode(numbers).alias("bucket_no")).groupBy("bucket_no").agg(
        F.count(F.lit(1)).alias("n"))
    spine = alerts.sparkSession.range(buckets).select(F.col("id").alias("bucket_no"))
    end = F.timestamp_micros(now_us - F.col("bucket_no") * F.lit(width)).cast("timestamp_ntz")
    return spine.join(counts, "bucket_no", "left").select(
        end.alias("bucket_end"), F.coalesce("n", F.lit(0)).alias("alerts"),
    )


def user_transaction_counts(users: DataFrame, txns: DataFrame) -> DataFrame:
    """Transactions of every user, zero for idle users."""
    counts = txns.groupBy("user_id").agg(F.count(F.lit(1)).alias("transaction_count"))
    return users.select(F.col("id").alias("user_id")).join(counts, "user_id", "left").select(
        "user_id", F.coalesce("transaction_count", F.lit(0)).alias("transaction_count"))


def count_by(df: DataFrame, *labels: str) -> DataFrame:
    """Rows per label combination; missing labels count as `unknown`."""
    return df.groupBy(*[label(name).alias(name) for name in labels]).agg(
        F.count(F.lit(1)).alias("n"))


def ingest_outcome_counts(answers: DataFrame, rejected: DataFrame, processed: DataFrame):
    """Received, rejected, processed and failed transactions by their label."""
    def part(df: DataFrame, metric: str, column: str) -> DataFrame:
        return count_by(df, column).select(
            F.lit(metric).alias("metric"), F.col(column).alias("label"), "n")

    failed = processed.where(F.col("status") == "PROCESSING_FAILED")
    return (
        part(answers, "received", "outcome")
        .unionByName(part(rejected.select(F.explode("errors").alias("reason")),
                          "rejected", "reason"))
        .unionByName(part(processed, "processed", "status"))
        .unionByName(part(failed, "failures", "stage"))
    )


def alert_escalation_counts(alerts: DataFrame) -> DataFrame:
    """Alerts by severity, and how many reached each escalation level, in one pass."""
    levels = F.array(
        F.struct(F.lit("severity").alias("kind"), F.col("severity").alias("label")),
        F.when(F.col("escalated_email_at").isNotNull(),
               F.struct(F.lit("escalation").alias("kind"), F.lit("email").alias("label"))),
        F.when(F.col("escalated_slack_at").isNotNull(),
               F.struct(F.lit("escalation").alias("kind"), F.lit("slack").alias("label"))),
    )
    return alerts.select(F.inline(F.array_compact(levels))).groupBy("kind", "label").agg(
        F.count(F.lit(1)).alias("n"))


def outbox_counts(routed: DataFrame) -> DataFrame:
    """Published events by type and dead letters by stream; needs `stream`."""
    published = routed.where(F.col("status") == "PUBLISHED")
    dead = routed.where(F.col("status") == "DEAD_LETTERED")
    return count_by(published, "event_type").select(
        F.lit("published").alias("metric"), F.col("event_type").alias("label"), "n"
    ).unionByName(count_by(dead, "stream").select(
        F.lit("dead_lettered").alias("metric"), F.col("stream").alias("label"), "n"))


def latency_histogram(processed: DataFrame, group: str = "stage") -> DataFrame:
    """Cumulative latency buckets per stage with total count and sum, in one aggregate."""
    seconds = (micros("processed_at") - micros("created_at")) / F.lit(1e6)
    timed = processed.select(label(group).alias("stage"), seconds.alias("s")).where("s IS NOT NULL")
    counted = timed.groupBy("stage").agg(
        *[F.count_if(F.col("s") <= bound).alias(f"b{i}") for i, bound in enumerate(LATENCY_BOUNDS)],
        F.count(F.lit(1)).alias("total"), F.sum("s").alias("total_seconds"),
    )
    bounds = [
        F.struct(F.lit(str(bound)).alias("le"), F.col(f"b{i}").alias("n"))
        for i, bound in enumerate(LATENCY_BOUNDS)
    ] + [F.struct(F.lit("+Inf").alias("le"), F.col("total").alias("n"))]
    return counted.select(
        "stage", F.inline(F.array(*bounds)), "total",
        F.round("total_seconds", 3).alias("total_seconds"),
    )


def outbox_backlog(outbox: DataFrame) -> DataFrame:
    return outbox.where(F.col("status") == "PENDING").agg(F.count(F.lit(1)).alias("backlog"))


def stream_backlog(routed: DataFrame, inbox: DataFrame, groups: dict[str, tuple[str, ...]]):
    """Events per consumer group and stream that the group has not processed.

    `groups` maps a consumer group to the streams it reads.
    """
    pairs = [(stream, group) for group, streams in groups.items() for stream in streams]
    readers = F.create_map(*[
        part for stream in sorted({s for s, _ in pairs}) for part in (
            F.lit(stream), F.array(*[F.lit(g) for s, g in pairs if s == stream]))
    ])
    wanted = routed.select(
        F.col("id").alias("event_id"), "stream",
        F.explode(F.try_element_at(readers, F.col("stream"))).alias("consumer_group"),
    )
    seen = inbox.select("event_id", "consumer_group", F.lit(1).alias("_seen"))
    return wanted.join(seen, ["event_id", "consumer_group"], "left").groupBy(
        "stream", "consumer_group"
    ).agg(F.count_if(F.col("_seen").isNull()).alias("backlog"))


def submission_summary(submissions: DataFrame) -> DataFrame:
    """Totals of a submission log with columns accepted, anomalous and latency_ms."""
    accepted = F.col("accepted")
    mean = F.avg(F.when(accepted, F.col("latency_ms")))
    return submissions.agg(
        F.count(F.lit(1)).alias("submitted"),
        F.count_if(accepted).alias("accepted"),
        F.count_if(~accepted).alias("failed"),
        F.count_if(F.col("anomalous")).alias("anomalous"),
        F.round(F.coalesce(mean, F.lit(0.0)), 2).alias("mean_latency_ms"),
    )


def table_row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Row count of every table."""
    result = None
    for name, df in tables.items():
        part = df.agg(F.count(F.lit(1)).alias("rows")).select(
            F.lit(name).alias("table_name"), "rows")
        result = part if result is None else result.unionByName(part)
    return result
