"""Keyed merges: upserts, first and last row per key, idempotent submission."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, functions as F


def first_per_key(df: DataFrame, key: str | list[str], *order: str) -> DataFrame:
    """The first row of every key. An aggregate, so repeated keys shrink before the shuffle.

    A row without a key repeats no other and stays, as under a unique constraint.
    """
    keys = [key] if isinstance(key, str) else key
    keyed = _has_key(keys)
    row = F.struct(*df.columns)
    return df.where(keyed).groupBy(*keys).agg(
        F.min_by(row, F.struct(*order)).alias("_row")
    ).select("_row.*").unionByName(df.where(~keyed))


def _has_key(keys: list[str]) -> Column:
    return reduce(and_, [F.col(name).isNotNull() for name in keys])


def latest_per_key(df: DataFrame, key: str | list[str], *order: str) -> DataFrame:
    """The last row of every key."""
    keys = [key] if isinstance(key, str) else key
    row = F.struct(*df.columns)
    return df.groupBy(*keys).agg(
        F.max_by(row, F.struct(*order)).alias("_row")
    ).select("_row.*")


def latest_per_alert(writes: DataFrame, *order: str) -> DataFrame:
    return latest_per_key(writes, "id", *order)


def upsert_table(
    base: DataFrame, delta: DataFrame, keys: list[str], update_cols: list[str] | None = None,
) -> DataFrame:
    """Inserts the rows of `delta`; on conflict keeps the base row or takes `update_cols`.

    A key that `delta` repeats takes its greatest row, compared column by column; columns that
    cannot be compared, such as maps, are not for this. One full outer join, so the base is
    shuffled once.
    """
    update_cols = update_cols or []
    left = base.select(*keys, F.struct(*base.columns).alias("_old"))
    right = delta.groupBy(*keys).agg(F.max(F.struct(*delta.columns)).alias("_new"))
    joined = left.join(right, keys, "full_outer")

    def value(name: str) -> Column:
        if name in keys:
            return F.col(name)
        new = F.col(f"_new.{name}") if name in delta.columns else F.lit(None)
        old = F.col(f"_old.{name}")
        if name in update_cols:
            return F.when(F.col("_new").isNotNull(), new).otherwise(old).alias(name)
        return F.when(F.col("_old").isNull(), new).otherwise(old).alias(name)

    return joined.select(*[value(name) for name in base.columns])


def idempotent_submit(
    submissions: DataFrame, key: str = "idempotency_key", ident: str = "transaction_id",
    ts: str = "created_at",
) -> DataFrame:
    """Answers every submission: accepted, or duplicate with the first one's id and status.

    A key repeated very often stays in one partition of the join only until adaptive execution
    splits it; the first row per key is found by a partial aggregate. Submissions without a key
    are always accepted and take no part in either shuffle.
    """
    keyed = submissions.where(F.col(key).isNotNull())
    first = keyed.groupBy(key).agg(
        F.min(F.struct(ts, ident, "status")).alias("_first")
    )
    is_first = F.col(ident) == F.col(f"_first.{ident}")
    answered = keyed.join(first, key).select(
        F.col(ident).alias("submission_id"), key,
        F.when(is_first, "accepted").otherwise("duplicate").alias("outcome"),
        F.col(f"_first.{ident}").alias("transaction_id"),
        F.col("_first.status").alias("status"),
    )
    return answered.unionByName(submissions.where(F.col(key).isNull()).select(
        F.col(ident).alias("submission_id"), key, F.lit("accepted").alias("outcome"),
        F.col(ident).alias("transaction_id"), "status",
    ))


def reconcile_alerts(cached: DataFrame, server: DataFrame) -> DataFrame:
    """Cached and server rows by id; the server's row replaces the cached one as a whole."""
    both = cached.withColumn("_side", F.lit(0)).unionByName(
        server.withColumn("_side", F.lit(1)), allowMissingColumns=True
    )
    merged = latest_per_key(both, "id", "_side").drop("_side")
    defaults = {
        "composite_risk_score": 0.0, "ml_anomaly_score": 0.0, "is_demo": False,
        "correlation_id": "rest-sync",
    }
    return merged.fillna({k: v for k, v in defaults.items() if k in merged.columns})


def prepend_new_alert(alerts: DataFrame, created: DataFrame) -> DataFrame:
    """New alerts take the place of rows with the same id and sort before all others."""
    kept = alerts.join(created.select("id"), "id", "left_anti")
    return created.withColumn("position", F.lit(0)).unionByName(
        kept.withColumn("position", F.lit(1)), allowMissingColumns=True
    )
