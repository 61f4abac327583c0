"""Risk profiles: tallies, running state and compensation of false positives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from fraudloom.functions.columns import micros
from fraudloom.plans.slices import MINUTE_US, opening_last, opening_totals, whole_slices
from fraudloom.schemas import SCORE

ALERT_WEIGHT = 0.25


def compensated_score(total: Column, false_positives: Column) -> Column:
    """Score after a false positive: a quarter per effective alert, at most 1."""
    effective = F.greatest(F.lit(0), total - false_positives)
    score = F.least(F.lit(1), effective * F.lit(str(ALERT_WEIGHT)).cast("decimal(3,2)"))
    return F.when(total > 0, score).otherwise(F.lit(0)).cast(SCORE)


def alert_tallies(users: DataFrame, alerts: DataFrame) -> DataFrame:
    """Alerts and false positives of every user, zero for users without any."""
    counts = alerts.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("total_alerts"),
        F.count_if(F.col("status") == "FALSE_POSITIVE").alias("false_positive_count"),
    )
    return users.select(F.col("id").alias("user_id")).join(counts, "user_id", "left").select(
        "user_id",
        F.coalesce("total_alerts", F.lit(0)).alias("total_alerts"),
        F.coalesce("false_positive_count", F.lit(0)).alias("false_positive_count"),
    )


def compensate_profiles(profiles: DataFrame, fp_events: DataFrame) -> DataFrame:
    """Profiles after the given false positives; unknown users get a new profile."""
    counts = fp_events.where("user_id IS NOT NULL").groupBy("user_id").agg(
        F.count(F.lit(1)).cast("int").alias("_fp"), F.max("resolved_at").alias("_at")
    )
    joined = profiles.withColumn("_known", F.lit(True)).join(counts, "user_id", "full_outer")
    hit, total = F.col("_fp").isNotNull(), F.coalesce("total_alerts", F.lit(0))
    tally = F.coalesce("false_positive_count", F.lit(0)) + F.coalesce("_fp", F.lit(0))
    return joined.select(
        "user_id",
        F.when(F.col("_known").isNull(), F.lit(0).cast(SCORE))
        .when(hit, compensated_score(total, tally))
        .otherwise(F.col("risk_score")).cast(SCORE).alias("risk_score"),
        total.cast("int").alias("total_alerts"),
        tally.cast("int").alias("false_positive_count"),
        *([F.coalesce("_at", "last_recalculated_at").alias("last_recalculated_at")]
          if "last_recalculated_at" in profiles.columns else []),
    )


def bump_profiles(profiles: DataFrame, alerts: DataFrame) -> DataFrame:
    """Profiles after new alerts: only the alert count rises, the score stays."""
    return add_alert_counts(profiles, alerts.groupBy("user_id").agg(
        F.count(F.lit(1)).cast("int").alias("new_alerts")))


def add_alert_counts(profiles: DataFrame, changes: DataFrame) -> DataFrame:
    """Profiles after any number of `new_alerts` per user; unknown users get a profile."""
    counts = changes.where("user_id IS NOT NULL").groupBy("user_id").agg(
        F.sum("new_alerts").cast("int").alias("_new"))
    joined = profiles.join(counts, "user_id", "full_outer")
    return joined.select(
        "user_id",
        F.coalesce("risk_score", F.lit(0)).cast(SCORE).alias("risk_score"),
        (F.coalesce("total_alerts", F.lit(0)) + F.coalesce("_new", F.lit(0))).cast("int")
        .alias("total_alerts"),
        F.coalesce("false_positive_count", F.lit(0)).cast("int").alias("false_positive_count"),
    )


def _profile_events(alerts: DataFrame, fp_events: DataFrame) -> DataFrame:
    """Alert creations (kind 0) and false positives (kind 1) in one shape."""
    return alerts.select(
        "user_id", F.col("created_at").alias("ts"), F.lit(0).alias("kind"),
        F.col("id").alias("event_id"),
    ).unionByName(fp_events.select(
        "user_id", F.col("resolved_at").alias("ts"), F.lit(1).alias("kind"), "event_id",
    ))


def _with_opening(events: DataFrame, opening: DataFrame) -> DataFrame:
    """Events next to what their (user, slice) opens with, also where either is missing."""
    right = opening.withColumnsRenamed({"user_id": "_user", "_slice": "_of"})
    same = F.col("user_id").eqNullSafe(F.col("_user")) & F.col("_slice").eqNullSafe(F.col("_of"))
    return events.join(right, same, "left").drop("_user", "_of")


def running_profile(
    alerts: DataFrame, fp_events: DataFrame, profiles: DataFrame | None = None,
    slice_hours: int = 24,
) -> DataFrame:
    """Running alert and false-positive counts of the user at every event.

    Counts of earlier slices come from per-slice totals, so a busy user spreads over slices.
    Events without a user stay and count among themselves.
    """
    events = _profile_events(alerts, fp_events).withColumn(
        "_slice", whole_slices(micros("ts"), slice_hours * 60 * MINUTE_US)
    )
    opening = opening_totals(events, ["user_id"], "_slice", {
        "_alerts": 1 - F.col("kind"), "_fps": F.col("kind"),
    })
    if profiles is not None:
        start = profiles.select(
            "user_id", F.col("total_alerts").alias("_a0"),
            F.col("false_positive_count").alias("_f0"), F.col("risk_score").alias("_s0"),
        )
        opening = opening.join(start, "user_id", "left")
    else:
        opening = opening.withColumns({
            "_a0": F.lit(0), "_f0": F.lit(0), "_s0": F.lit(0).cast(SCORE),
        })
    so_far = (
        Window.partitionBy("user_id", "_slice").orderBy("ts", "kind", "event_id")
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    zero = F.lit(0)
    return _with_opening(events, opening).select(
        "user_id", "ts", "kind", "event_id", "_slice",
        (F.sum(1 - F.col("kind")).over(so_far) + F.col("_alerts") + F.coalesce("_a0", zero))
        .cast("bigint").alias("total_alerts"),
        (F.sum("kind").over(so_far) + F.col("_fps") + F.coalesce("_f0", zero))
        .cast("bigint").alias("false_positive_count"),
        F.coalesce("_s0", F.lit(0)).cast(SCORE).alias("_s0"),
    )


def profile_history(
    alerts: DataFrame, fp_events: DataFrame, profiles: DataFrame | None = None,
    slice_hours: int = 24,
) -> DataFrame:
    """Profile score of the user after every alert and every false positive.

    Only a false positive sets the score; an alert leaves it as it was.
    """
    running = running_profile(alerts, fp_events, profiles, slice_hours).withColumn(
        "_set", F.when(F.col("kind") == 1, compensated_score(
            F.col("total_alerts"), F.col("false_positive_count")))
    )
    order = F.struct("ts", "kind", "event_id")
    opening = opening_last(running, ["user_id"], "_slice", order, F.col("_set"), "_opening")
    so_far = (
        Window.partitionBy("user_id", "_slice").orderBy("ts", "kind", "event_id")
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    return _with_opening(running, opening).select(
        "user_id", "ts", "kind", "event_id", "total_alerts", "false_positive_count",
        F.coalesce(F.last("_set", ignorenulls=True).over(so_far), "_opening", "_s0")
        .alias("risk_score"),
    )
