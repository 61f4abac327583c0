"""Many rules and several velocity windows: every path against brute force."""

import datetime
import json
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from fraudloom.operators.features import velocity_horizons, velocity_trailing
from fraudloom.operators.rule_index import reached
from fraudloom.operators.rules import evaluate_rules, evaluate_rules_per_window

START = datetime.datetime(2024, 1, 1)
RULES = ("id string, name string, rule_type string, severity string, enabled boolean,"
         " parameters string, created_at timestamp, rule_order int")
TXNS = ("transaction_id int, user_id int, amount decimal(14,2), currency string, country string,"
        " merchant_category string, created_at timestamp_ntz")


def random_rules(pick, n):
    out = []
    for i in range(n):
        kind = pick.choice(["AMOUNT_THRESHOLD", "HIGH_RISK_COUNTRY", "VELOCITY", "USER_RISK_LEVEL",
                            "MERCHANT_CATEGORY"])
        p = {"AMOUNT_THRESHOLD": {"threshold": pick.choice([10, 10.5, 20, "x", None, 0]),
                                  "operator": pick.choice([">", ">="])},
             "HIGH_RISK_COUNTRY": {"countries": pick.sample(["ru", " KP", "us", ""], pick.randrange(4))},
             "VELOCITY": {"max_count": pick.choice([None, 1, 2, 3]), "max_amount": pick.choice([None, 30, 45.25]),
                          "window_minutes": pick.choice([None, 10, 60, "x", -3])},
             "USER_RISK_LEVEL": {"min_risk_score": pick.choice([0.2, "0.5", None])},
             "MERCHANT_CATEGORY": {"categories": pick.choice([["A", "b "], "a", []])}}[kind]
        if kind == "AMOUNT_THRESHOLD" and pick.random() < 0.5:
            p["currency"] = pick.choice(["usd", "EUR"])
        out.append((f"r{i}", f"n{i}", kind, pick.choice(["LOW", "HIGH"]), pick.random() < 0.9,
                    json.dumps({k: v for k, v in p.items() if v is not None}), START, i // 2))
    return out


def random_txns(pick, n):
    return [(i, pick.choice([1, 2, None]), pick.choice([None, Decimal("10.00"), Decimal("10.50"), Decimal("21.00")]),
             pick.choice(["usd", "EUR", None]), pick.choice([" ru", "KP", "fr", None, ""]),
             pick.choice(["a", "B", None]), None if pick.random() < 0.05 else
             START + datetime.timedelta(minutes=pick.randrange(150))) for i in range(n)]


def enriched(spark, pick, n=60):
    rows = [(*t, pick.randrange(4), pick.choice([None, Decimal("30"), Decimal("45.25"), Decimal("44")]),
             pick.choice([None, Decimal("0.2"), Decimal("0.6")])) for t in random_txns(pick, n)]
    return spark.createDataFrame(
        rows, TXNS + ", txn_count long, total_amount decimal(24,2), risk_score decimal(5,4)")


@pytest.mark.parametrize("seed", [1, 2])
def test_index_equals_compiled_rules(spark, seed):
    pick = random.Random(seed)
    rules = spark.createDataFrame(random_rules(pick, 110), RULES)
    rows = enriched(spark, pick)
    many = evaluate_rules(rows, rules, compile_limit=0).collect()
    few = evaluate_rules(rows, rules, compile_limit=1000).collect()
    assert sum(len(r["rule_matches"]) for r in few) > 100
    assert {r["transaction_id"]: r["rule_matches"] for r in many} == {
        r["transaction_id"]: r["rule_matches"] for r in few}


def test_no_rules_match_nothing(spark):
    rules = spark.createDataFrame([], RULES)
    rows = evaluate_rules(enriched(spark, random.Random(3), 5), rules).collect()
    assert [r["rule_matches"] for r in rows] == [[]] * 5


def test_bisection(spark):
    rows = [(v, size) for size in range(0, 9) for v in range(-1, 2 * size + 2)] + [(None, 3)]
    got = spark.createDataFrame(rows, "v int, size int").withColumn("a", F.when(
        F.col("size") == 0, F.array().cast("array<int>")).otherwise(F.transform(
            F.sequence(F.lit(1), F.greatest("size", F.lit(1))), lambda i: i * 2))).select(
        "v", "size", reached(F.col("a"), F.col("v")).alias("most"),
        reached(F.col("a"), F.col("v"), F.lit(True)).alias("below")).collect()
    for r in got:
        values = [2 * i for i in range(1, r["size"] + 1)]
        assert r["most"] == sum(r["v"] is not None and x <= r["v"] for x in values)
        assert r["below"] == sum(r["v"] is not None and x < r["v"] for x in values)


def test_horizons_equal_single_windows(spark):
    txns = spark.createDataFrame(random_txns(random.Random(5), 400), TXNS)
    got = {r["transaction_id"]: r for r in velocity_horizons(txns, [60, 10, 7, 90]).collect()}
    assert len(got) == 400
    for minutes in (7, 10, 60, 90):
        for r in velocity_trailing(txns, minutes).collect():
            mine = got[r["transaction_id"]]
            assert (mine[f"txn_count_{minutes}"], mine[f"total_amount_{minutes}"]) == (
                r["txn_count"], r["total_amount"]), (minutes, r)


@pytest.mark.parametrize("limit", [0, 1000])
def test_rules_count_over_their_own_window(spark, limit):
    pick = random.Random(7)
    specs = [r for r in random_rules(pick, 150) if r[2] == "VELOCITY"]
    txns = spark.createDataFrame(random_txns(pick, 120), TXNS)
    profiles = spark.createDataFrame(
        [], "user_id int, risk_score decimal(5,4), total_alerts int, false_positive_count int")
    got = evaluate_rules_per_window(txns, profiles, spark.createDataFrame(specs, RULES), 30, limit).collect()
    counted = {m: {r["transaction_id"]: r for r in velocity_trailing(txns, m).collect()} for m in (10, 30, 60)}
    for row in got:
        expected = []
        for rule in specs:
            p = json.loads(rule[5])
            own = p.get("window_minutes")
            seen = counted[own if isinstance(own, int) and own > 0 else 30][row["transaction_id"]]
            if rule[4] and (("max_count" in p and seen["txn_count"] >= p["max_count"]) or (
                    "max_amount" in p and seen["total_amount"] >= Decimal(str(p["max_amount"])))):
                expected.append((rule[7], rule[0]))
        assert [m["rule_id"] for m in row["rule_matches"]] == [i for _, i in sorted(expected)]
