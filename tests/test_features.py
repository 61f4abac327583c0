"""Velocity, as-of profiles and features, also against brute force with a busy user."""

import datetime
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from fraudloom.operators.features import extract_features, profile_as_of, velocity_trailing
from fraudloom.operators.profiles import profile_history
from fraudloom.plans.slices import slices_per_window

START = datetime.datetime(2024, 1, 1)


def history(seed, count, users, minutes):
    """Random rows of which a third belong to one user, with repeated times."""
    rng = random.Random(seed)
    rows = []
    for i in range(count):
        user = 0 if i % 3 == 0 else rng.randrange(1, users)
        at = START + datetime.timedelta(seconds=rng.randrange(0, minutes * 60, 30))
        rows.append((i, user, at, Decimal(rng.randrange(1, 10**6)) / 100))
    return rows


def frame(spark, rows):
    return spark.createDataFrame(
        rows, "transaction_id long, user_id long, created_at timestamp_ntz, amount decimal(14,2)")


@pytest.mark.parametrize("minutes", [10, 90, 1440])
def test_velocity_against_brute_force(spark, minutes):
    rows = history(minutes, 600, 12, minutes * 5)
    found = {r["transaction_id"]: (r["txn_count"], r["total_amount"])
             for r in velocity_trailing(frame(spark, rows), minutes).collect()}
    assert len(found) == len(rows)
    window = datetime.timedelta(minutes=minutes)
    for ident, user, at, _ in rows:
        inside = [a for _, u, t, a in rows if u == user and at - window <= t <= at]
        assert found[ident] == (len(inside), sum(inside))


def test_velocity_is_closed_at_both_ends_and_counts_peers(spark):
    rows = [(1, 1, START, Decimal(1)), (2, 1, START + datetime.timedelta(minutes=10), Decimal(2)),
            (3, 1, START + datetime.timedelta(minutes=10), Decimal(4)),
            (4, 1, START + datetime.timedelta(minutes=10, microseconds=1), Decimal(8))]
    found = {r["transaction_id"]: (r["txn_count"], int(r["total_amount"]))
             for r in velocity_trailing(frame(spark, rows)).collect()}
    assert found == {1: (1, 1), 2: (3, 7), 3: (3, 7), 4: (3, 14)}


def test_velocity_keeps_times_before_the_epoch(spark):
    old = datetime.datetime(1969, 12, 31, 23, 55)
    rows = [(1, 1, old, Decimal(1)), (2, 1, old + datetime.timedelta(minutes=9), Decimal(2))]
    found = {r["transaction_id"]: r["txn_count"]
             for r in velocity_trailing(frame(spark, rows)).collect()}
    assert found == {1: 1, 2: 2}


def test_velocity_partitions_by_user_and_slice(spark):
    plan = velocity_trailing(frame(spark, history(1, 9, 3, 60)))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(user_id" in text and "_slice" in text
    assert text.count("Exchange hashpartitioning") == 1


def test_slices():
    assert slices_per_window(10) == 1
    assert slices_per_window(1440) == 96
    assert (90 * 60 * 10**6) % slices_per_window(90) == 0


def test_as_of_against_brute_force(spark):
    rows = history(5, 300, 8, 60 * 24 * 4)
    changes = [(i, u, t, Decimal(i % 100) / 100) for i, u, t, _ in history(6, 120, 8, 60 * 24 * 4)]
    log = spark.createDataFrame(
        changes, "change_id long, user_id long, changed_at timestamp_ntz, risk_score decimal(5,4)")
    found = {r["transaction_id"]: r["risk_score"]
             for r in profile_as_of(frame(spark, rows), log).collect()}
    assert len(found) == len(rows)
    for ident, user, at, _ in rows:
        past = [(t, i, s) for i, u, t, s in changes if u == user and t <= at]
        assert found[ident] == (max(past)[2] if past else 0)


def test_history_against_brute_force(spark):
    alerts = [(i, u, t) for i, u, t, _ in history(7, 200, 6, 60 * 24 * 6)]
    fps = [(i, u, t + datetime.timedelta(minutes=20)) for i, u, t in alerts if i % 4 == 0]
    found = profile_history(
        spark.createDataFrame(alerts, "id long, user_id long, created_at timestamp_ntz"),
        spark.createDataFrame(fps, "event_id long, user_id long, resolved_at timestamp_ntz"),
    ).collect()
    events = sorted([(u, t, 0, i) for i, u, t in alerts] + [(u, t, 1, i) for i, u, t in fps])
    expected, state = {}, {}
    for user, at, kind, ident in events:
        total, fp, score = state.get(user, (0, 0, Decimal(0)))
        if kind == 0:
            total += 1
        else:
            fp += 1
            score = min(Decimal(1), Decimal("0.25") * max(0, total - fp)) if total else Decimal(0)
        state[user] = (total, fp, score)
        expected[(user, kind, ident)] = state[user]
    assert {(r["user_id"], r["kind"], r["event_id"]):
            (r["total_alerts"], r["false_positive_count"], r["risk_score"])
            for r in found} == expected


def test_features(spark):
    row = spark.createDataFrame(
        [(1, Decimal("1250.50"), datetime.datetime(2024, 1, 1, 14, 30), "us ", "Electronics", 4)],
        "transaction_id long, amount decimal(14,2), created_at timestamp_ntz, country string,"
        " merchant_category string, txn_count long")
    assert list(extract_features(row).first())[1:] == [1250.5, 14.0, 0.1, 0.5, 4.0]
    unknown = row.withColumns({"country": F.lit("XX"), "merchant_category": F.lit("restaurants")})
    assert list(extract_features(unknown).first())[3:5] == [0.3, 0.3]
