"""Rows without user, time or key stay, whatever the window or slice length."""

from datetime import datetime, timedelta
from decimal import Decimal

import pytest

from fraudloom.operators import merge, profiles
from fraudloom.operators.features import profile_as_of, velocity_trailing
from fraudloom.operators.rules import evaluate_rules

START = datetime(2024, 1, 1, 23, 50)
TXN = "transaction_id int, user_id int, created_at timestamp_ntz, amount decimal(12,2)"


def transactions():
    rows = [(n, n % 2 or None, START + timedelta(minutes=7 * n), Decimal(n)) for n in range(40)]
    return rows + [(40, 1, None, Decimal(3)), (41, 1, None, Decimal(4)), (42, None, None, None)]


def expected(minutes):
    out = {}
    for ident, user, at, _ in transactions():
        hits = [a or 0 for _, u, t, a in transactions() if u == user and (
            t is None if at is None else t is not None and at - timedelta(minutes=minutes) <= t <= at)]
        out[ident] = (len(hits), sum(hits))
    return out


@pytest.mark.parametrize("minutes", [10, 15, 16, 1440])
def test_velocity_keeps_every_row(spark, minutes):
    found = velocity_trailing(spark.createDataFrame(transactions(), TXN), minutes).collect()
    assert {r["transaction_id"]: (r["txn_count"], r["total_amount"]) for r in found} == expected(minutes)
    assert len(found) == 43


def test_submissions_without_key_are_accepted(spark):
    rows = spark.createDataFrame(
        [(1, "a", START, "OK"), (2, "a", START, "OK"), (3, None, START, "OK"), (4, None, START, "OK")],
        "transaction_id int, idempotency_key string, created_at timestamp_ntz, status string")
    found = {(r["submission_id"], r["outcome"], r["transaction_id"])
             for r in merge.idempotent_submit(rows).collect()}
    assert found == {(1, "accepted", 1), (2, "duplicate", 1), (3, "accepted", 3), (4, "accepted", 4)}
    first = merge.first_per_key(rows, "idempotency_key", "created_at", "transaction_id").collect()
    assert sorted(r["transaction_id"] for r in first) == [1, 3, 4]


def test_repeated_key_of_a_delta_does_not_multiply_rows(spark):
    base = spark.createDataFrame([(1, "old")], "id int, name string")
    delta = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (2, "c")], "id int, name string")
    found = sorted(tuple(r) for r in merge.upsert_table(base, delta, ["id"], ["name"]).collect())
    assert found == [(1, "b"), (2, "c")]


def test_profile_events_without_user_stay(spark):
    alerts = spark.createDataFrame(
        [("a", 1, START), ("b", None, START), ("c", None, START + timedelta(days=2))],
        "id string, user_id int, created_at timestamp_ntz")
    fps = spark.createDataFrame(
        [("d", None, START + timedelta(days=3))], "event_id string, user_id int, resolved_at timestamp_ntz")
    running = {r["event_id"]: (r["total_alerts"], r["false_positive_count"])
               for r in profiles.running_profile(alerts, fps).collect()}
    assert running == {"a": (1, 0), "b": (1, 0), "c": (2, 0), "d": (2, 1)}
    assert profiles.profile_history(alerts, fps).count() == 4


def test_profile_as_of_takes_text_ids(spark):
    txns = spark.createDataFrame(transactions(), TXN)
    history = spark.createDataFrame(
        [("x1", 1, START, Decimal("0.25")), ("x2", 1, START, Decimal("0.5")), ("x3", None, START, Decimal("1"))],
        "change_id string, user_id int, changed_at timestamp_ntz, risk_score decimal(5,4)")
    found = {r["transaction_id"]: r["risk_score"] for r in profile_as_of(txns, history).collect()}
    assert len(found) == 43 and found[1] == Decimal("0.5") and found[0] == 0 and found[40] == 0


def test_no_rules_have_the_same_schema(spark):
    from fraudloom.fixtures import seeded_rules

    rules = seeded_rules(spark)
    txn = spark.createDataFrame([], TXN).selectExpr(
        "*", "'US' AS country", "'retail' AS merchant_category", "1L AS txn_count",
        "0.0 AS total_amount", "0.1 AS risk_score", "1 AS total_alerts", "'USD' AS currency")
    kind = evaluate_rules(txn, rules).schema["rule_matches"].dataType
    assert evaluate_rules(txn, rules.where("false")).schema["rule_matches"].dataType.simpleString() \
        == kind.simpleString()
