"""Velocity, risk profiles and model features of transactions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from fraudloom.functions.columns import (
    hour_of_day, literal_map, lower_code, map_get, micros, upper_code,
)
from fraudloom.plans.slices import MINUTE_US, opening_last, slice_no, slices_per_window, whole_slices
from fraudloom.schemas import SCORE

# Risk tier of a country and risk code of a merchant category (fixed values).
COUNTRY_RISK_TIERS = {
    "US": 0.1, "CA": 0.1, "GB": 0.1, "DE": 0.1, "FR": 0.1, "AU": 0.1, "JP": 0.1, "SG": 0.1,
    "BR": 0.4, "IN": 0.4, "MX": 0.4, "ZA": 0.5, "NG": 0.8, "RU": 0.8, "KP": 1.0, "IR": 1.0,
    "SY": 1.0,
}
MERCHANT_CATEGORY_RISK = {
    "groceries": 0.1, "supermarket": 0.1, "pharmacy": 0.1, "utilities": 0.1, "retail": 0.2,
    "restaurant": 0.2, "travel": 0.4, "electronics": 0.5, "jewelry": 0.7, "money_transfer": 0.8,
    "crypto": 0.9, "gambling": 0.95, "weapons": 1.0,
}
UNKNOWN_RISK = 0.3
FEATURES = [
    "amount", "hour_of_day", "country_risk_tier", "merchant_category_code", "user_rolling_count",
]


def velocity_trailing(
    txns: DataFrame, minutes: int = 10, user: str = "user_id", ts: str = "created_at",
    amount: str = "amount",
) -> DataFrame:
    """Adds count and sum of the user's transactions in [t - minutes, t], both ends included.

    The window is m slices long. A transaction in slice k needs the start of its own slice,
    the end of slice k-m and the whole slices between. Each row goes to its own slice as an
    addition and, as a slim copy moved forward by the window length, to slice k+m as a
    subtraction at the moment it leaves the window. What slices k-m..k-1 hold is added up front,
    at the start of the slice: for m = 1 by a third slim copy, else by one entry made from
    per-slice totals. One running sum over a slice then gives the result, so the work is linear
    after its sort.

    Every row comes back. Rows without a user count among themselves, as in a SQL window, and so
    do rows of a user without a time; a missing amount adds nothing.
    """
    m = slices_per_window(minutes)
    window_us = minutes * MINUTE_US
    width = window_us // m
    base = txns.select(
        user, F.struct(*txns.columns).alias("_row"), F.col(amount).alias("_amount"),
        micros(ts).alias("_us"), slice_no(ts, width).alias("_slice"),
    )
    later, slim = F.col("_slice") + m, F.lit(None)

    def entry(at: Column, position: Column, sign: int, row: Column) -> Column:
        change = F.col("_amount") if sign > 0 else -F.col("_amount")
        return F.struct(at.alias("_slice"), position.alias("_at"), F.lit(sign).alias("_n"),
                        change.alias("_a"), row.alias("_row"))

    # Even positions are additions, so a copy leaves only after the peers of its last moment.
    entries = [
        entry(F.col("_slice"), F.col("_us") * 2, 1, F.col("_row")),
        entry(later, (F.col("_us") + window_us) * 2 + 1, -1, slim),
    ]
    if m == 1:
        entries.append(entry(later, later * (2 * width) - 1, 1, slim))
    so_far = (
        Window.partitionBy(user, "_slice").orderBy("_at")
        .rangeBetween(Window.unboundedPreceding, Window.currentRow)
    )
    moves = base.select(user, F.inline(F.array(*entries)))
    if m > 1:
        per_slice = base.groupBy(user, "_slice").agg(
            F.count(F.lit(1)).alias("_n"), F.sum("_amount").alias("_a")
        )
        past = Window.partitionBy(user).orderBy("_slice").rangeBetween(-m, -1)
        moves = moves.unionByName(per_slice.select(
            user, "_slice", (F.col("_slice") * (2 * width) - 1).alias("_at"),
            F.sum("_n").over(past).alias("_n"), F.sum("_a").over(past).alias("_a"),
            slim.alias("_row"),
        ))
    return moves.select(
        "_row", F.sum("_n").over(so_far).alias("_n"), F.sum("_a").over(so_far).alias("_a"),
    ).where("_row IS NOT NULL").select(
        "_row.*",
        F.col("_n").cast("bigint").alias("txn_count"),
        F.coalesce("_a", F.lit(0)).cast("decimal(24,2)").alias("total_amount"),
    )


def velocity_horizons(
    txns: DataFrame, horizons: list[int], user: str = "user_id", ts: str = "created_at",
    amount: str = "amount",
) -> DataFrame:
    """Adds `txn_count_<m>` and `total_amount_<m>` for trailing windows of several lengths at once.

    All lengths share one grid of slices, whose width divides each of them. A row goes to its slice
    once; per length, a slim copy follows to the slice in which the row leaves that window, and one
    entry per slice brings in what the window held before. One sort of a (user, slice) and one
    running sum per length then give all results. Values and missing keys are as in
    `velocity_trailing`.
    """
    horizons = sorted(set(horizons))
    grid = math.gcd(*horizons)
    width = grid * MINUTE_US // slices_per_window(grid)
    base = txns.select(
        user, F.struct(*txns.columns).alias("_row"), F.col(amount).alias("_amount"),
        micros(ts).alias("_us"), slice_no(ts, width).alias("_slice"),
    )

    def entry(at: Column, position: Column, horizon: int, sign: int, row: Column) -> Column:
        change = F.col("_amount") if sign > 0 else -F.col("_amount")
        return F.struct(at.alias("_slice"), position.alias("_at"), F.lit(horizon).alias("_for"),
                        F.lit(sign).cast("bigint").alias("_n"), change.alias("_a"), row.alias("_row"))

    entries = [entry(F.col("_slice"), F.col("_us") * 2, 0, 1, F.col("_row"))] + [
        entry(F.col("_slice") + m * MINUTE_US // width, (F.col("_us") + m * MINUTE_US) * 2 + 1, m, -1,
              F.lit(None)) for m in horizons]
    per_slice = base.groupBy(user, "_slice").agg(
        F.count(F.lit(1)).alias("_count"), F.sum("_amount").alias("_sum"))
    held = {m: Window.partitionBy(user).orderBy("_slice").rangeBetween(-(m * MINUTE_US // width), -1)
            for m in horizons}
    opening = _openings(per_slice, user, held, width)
    moves = base.select(user, F.inline(F.array(*entries))).unionByName(opening)
    so_far = (
        Window.partitionBy(user, "_slice").orderBy("_at")
        .rangeBetween(Window.unboundedPreceding, Window.currentRow)
    )

    def running(name: str, m: int) -> Column:
        return F.sum(F.when(F.col("_for").isin(0, m), F.col(name))).over(so_far)

    return moves.select(
        "_row", *[running("_n", m).alias(f"_n_{m}") for m in horizons],
        *[running("_a", m).alias(f"_a_{m}") for m in horizons],
    ).where("_row IS NOT NULL").select("_row.*", *[column for m in horizons for column in (
        F.col(f"_n_{m}").cast("bigint").alias(f"txn_count_{m}"),
        F.coalesce(f"_a_{m}", F.lit(0)).cast("decimal(24,2)").alias(f"total_amount_{m}"))])


def _openings(per_slice: DataFrame, user: str, held: dict, width: int) -> DataFrame:
    """Per slice and window length, what the window holds where the slice begins."""
    totals = per_slice.select(user, "_slice", *[column for m, window in held.items() for column in (
        F.sum("_count").over(window).alias(f"_n_{m}"), F.sum("_sum").over(window).alias(f"_a_{m}"))])
    return totals.select(user, F.inline(F.array(*[F.struct(
        F.col("_slice"), (F.col("_slice") * (2 * width) - 1).alias("_at"), F.lit(m).alias("_for"),
        F.col(f"_n_{m}").alias("_n"), F.col(f"_a_{m}").alias("_a"), F.lit(None).alias("_row"),
    ) for m in held])))


def with_risk_profile(txns: DataFrame, profiles: DataFrame, user: str = "user_id") -> DataFrame:
    """Adds the user's profile; users without one get a zero profile."""
    profile = profiles.select(
        F.col("user_id").alias(user), "risk_score", "total_alerts", "false_positive_count",
    )
    return txns.join(profile, user, "left").select(
        *txns.columns,
        F.coalesce("risk_score", F.lit(0)).cast(SCORE).alias("risk_score"),
        F.coalesce("total_alerts", F.lit(0)).cast("int").alias("total_alerts"),
        F.coalesce("false_positive_count", F.lit(0)).cast("int").alias("false_positive_count"),
    )


def profile_as_of(
    txns: DataFrame, history: DataFrame, ts: str = "created_at", changed: str = "changed_at",
    seq: str = "change_id", slice_minutes: int = 60,
) -> DataFrame:
    """Adds `risk_score`, the user's latest profile score at or before the transaction time.

    Changes at the same moment are ordered by `seq` as it is, a number or a text. Transactions
    without user or time get 0; changes without user or time are no one's.
    """
    width = slice_minutes * MINUTE_US
    fields = [c for c in txns.columns if c != "user_id"]
    left = txns.select(
        "user_id", micros(ts).alias("_us"), F.lit(1).alias("_kind"),
        F.lit(None).cast(history.schema[seq].dataType).alias("_seq"),
        F.lit(None).cast(SCORE).alias("_score"), F.struct(*fields).alias("_row"),
    )
    right = history.where(F.col("user_id").isNotNull() & F.col(changed).isNotNull()).select(
        "user_id", micros(changed).alias("_us"), F.lit(0).alias("_kind"),
        F.col(seq).alias("_seq"), F.col("risk_score").alias("_score"),
    )
    both = left.unionByName(right, allowMissingColumns=True).withColumn(
        "_slice", whole_slices(F.col("_us"), width)
    )
    opening = opening_last(
        both.drop("_row"), ["user_id"], "_slice", F.struct("_us", "_seq"), F.col("_score"),
        "_opening",
    )
    so_far = (
        Window.partitionBy("user_id", "_slice").orderBy("_us", "_kind", "_seq")
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    return (
        both.join(opening, ["user_id", "_slice"], "left")
        .withColumn("_now", F.last("_score", ignorenulls=True).over(so_far))
        .where(F.col("_kind") == 1)
        .select(
            "user_id", "_row.*",
            F.coalesce("_now", "_opening", F.lit(0)).cast(SCORE).alias("risk_score"),
        )
    )


def lookup_features(
    txns: DataFrame, tiers: dict[str, float] | None = None,
    categories: dict[str, float] | None = None,
) -> DataFrame:
    """Adds country tier and category risk; unknown names count 0.3."""
    tiers = COUNTRY_RISK_TIERS if tiers is None else tiers
    categories = MERCHANT_CATEGORY_RISK if categories is None else categories
    return txns.withColumns({
        "country_risk": map_get(literal_map(tiers), upper_code("country"), UNKNOWN_RISK),
        "category_risk": map_get(
            literal_map(categories), lower_code("merchant_category"), UNKNOWN_RISK
        ),
    })


def extract_features(
    txns: DataFrame, tiers: dict[str, float] | None = None,
    categories: dict[str, float] | None = None, keep: list[str] | None = None,
) -> DataFrame:
    """The five model inputs as doubles; needs `txn_count` of `velocity_trailing`."""
    keep = ["transaction_id"] if keep is None else keep
    found = lookup_features(txns, tiers, categories)
    columns = {
        "amount": F.col("amount"),
        "hour_of_day": hour_of_day("created_at"),
        "country_risk_tier": F.col("country_risk"),
        "merchant_category_code": F.col("category_risk"),
        "user_rolling_count": F.coalesce("txn_count", F.lit(0)),
    }
    return found.select(
        *keep, *[columns[name].cast("double").alias(f"f_{name}") for name in FEATURES]
    )
