"""Rule predicates and explanations on hand-made rows."""

import json

import pytest
from pyspark.sql import functions as F

from fraudloom.operators.rules import evaluate_rules, load_active_rules, rule_hits

TXN = {
    "transaction_id": 1, "user_id": 7, "amount": "1500.00", "currency": "USD", "country": "US",
    "merchant_category": "electronics", "txn_count": 0, "total_amount": "0.00",
    "risk_score": "0.0000",
}


def enriched(spark, **changes):
    row = {**TXN, **changes}
    df = spark.createDataFrame([row], "transaction_id long, user_id long, amount string,"
                               " currency string, country string, merchant_category string,"
                               " txn_count long, total_amount string, risk_score string")
    return df.withColumns({
        "amount": F.col("amount").cast("decimal(14,2)"),
        "total_amount": F.col("total_amount").cast("decimal(24,2)"),
        "risk_score": F.col("risk_score").cast("decimal(5,4)"),
        "created_at": F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"),
    })


def rules(spark, *specs):
    rows = [(f"r{i}", f"Rule {i}", kind, severity, json.dumps(params), True, i)
            for i, (kind, severity, params) in enumerate(specs)]
    return spark.createDataFrame(rows, "id string, name string, rule_type string, severity string,"
                                 " parameters string, enabled boolean, rule_order int")


def explanations(spark, spec, limit=128, **changes):
    found = evaluate_rules(enriched(spark, **changes), rules(spark, spec), compile_limit=limit)
    return [m["explanation"] for m in found.first()["rule_matches"]]


AMOUNT, COUNTRY, VELOCITY = "AMOUNT_THRESHOLD", "HIGH_RISK_COUNTRY", "VELOCITY"
RISK, CATEGORY = "USER_RISK_LEVEL", "MERCHANT_CATEGORY"

CASES = [
    (AMOUNT, {"threshold": 1500}, {}, 1),
    (AMOUNT, {"threshold": 1500, "operator": ">"}, {}, 0),
    (AMOUNT, {"threshold": 1499.99, "operator": "anything"}, {}, 1),
    (AMOUNT, {"threshold": "invalid_num"}, {}, 0),
    (AMOUNT, {"threshold": True}, {}, 0),
    (AMOUNT, {}, {}, 0),
    (AMOUNT, {"threshold": 0}, {}, 0),
    (AMOUNT, {"threshold": 0, "amount_threshold": 2000}, {}, 0),
    (AMOUNT, {"threshold": 0, "amount_threshold": "1e3"}, {}, 1),
    (AMOUNT, {"limit": 0}, {}, 1),
    (AMOUNT, {"threshold": 1000, "currency": "usd"}, {}, 1),
    (AMOUNT, {"threshold": 1000, "currency": "EUR"}, {}, 0),
    (AMOUNT, {"threshold": 1000, "currency": ""}, {}, 1),
    (COUNTRY, {"countries": [" us ", "KP"]}, {}, 1),
    (COUNTRY, {"countries": 12345}, {}, 0),
    (COUNTRY, {"countries": [], "country_list": ["US"]}, {}, 1),
    (COUNTRY, {}, {}, 0),
    (COUNTRY, {"countries": ["RU"]}, {"country": "ru"}, 1),
    (CATEGORY, {"categories": ["ELECTRONICS "]}, {}, 1),
    (CATEGORY, {"categories": "not-a-list"}, {}, 0),
    (CATEGORY, {"blocked_categories": ["electronics"]}, {}, 1),
    (VELOCITY, {"max_count": 5}, {"txn_count": 6}, 1),
    (VELOCITY, {"max_count": "5.7"}, {"txn_count": 6}, 0),
    (VELOCITY, {"max_count": 5.7}, {"txn_count": 5}, 1),
    (VELOCITY, {"max_count": 9, "max_amount": 100}, {"txn_count": 6, "total_amount": "100.00"}, 1),
    (VELOCITY, {"max_count": "x", "max_amount": "y"}, {"txn_count": 6}, 0),
    (VELOCITY, {}, {"txn_count": 6}, 0),
    (RISK, {"min_risk_score": 0.35}, {"risk_score": "0.3500"}, 1),
    (RISK, {"risk_threshold": "bad"}, {"risk_score": "0.9000"}, 0),
    (RISK, {"threshold": 0.5}, {}, 0),
]


@pytest.fixture(scope="module")
def outcomes(spark):
    """All cases in one plan per path: every case is a rule, every variation a transaction."""
    variants = []
    for *_, changes, _ in CASES:
        if changes not in variants:
            variants.append(changes)
    frames = [enriched(spark, transaction_id=i, **v) for i, v in enumerate(variants)]
    txns = frames[0]
    for frame in frames[1:]:
        txns = txns.unionByName(frame)
    table = rules(spark, *[(kind, "LOW", params) for kind, params, _, _ in CASES])
    result = {}
    for limit in (128, 0):
        found = evaluate_rules(txns, table, compile_limit=limit).collect()
        result[limit] = {
            row["transaction_id"]: {m["rule_id"] for m in row["rule_matches"]} for row in found}
    return variants, result


@pytest.mark.parametrize("number", range(len(CASES)))
@pytest.mark.parametrize("limit", [128, 0])
def test_predicates(outcomes, number, limit):
    variants, result = outcomes
    _, _, changes, expected = CASES[number]
    assert (f"r{number}" in result[limit][variants.index(changes)]) == bool(expected)


def test_explanations(spark):
    assert explanations(spark, (AMOUNT, "HIGH", {"threshold": 1000})) == [
        "Transaction amount 1500.00 USD exceeds threshold 1000.00 USD"]
    assert explanations(spark, (VELOCITY, "HIGH", {"max_count": 5}), txn_count=6) == [
        "User transaction velocity exceeded in 10m window: count 6 >= limit 5"]
    both = {"max_count": 5, "max_amount": 25000, "window_minutes": 15}
    assert explanations(spark, (VELOCITY, "HIGH", both), txn_count=6, total_amount="30000") == [
        "User transaction velocity exceeded in 15m window: count 6 >= limit 5,"
        " total amount 30000.00 >= limit 25000.00"]
    assert explanations(spark, (RISK, "LOW", {"min_risk_score": 0.5}), risk_score="0.7500") == [
        "User risk score 0.7500 meets or exceeds risk threshold 0.5000"]


def test_rule_order_and_disabled_rules(spark):
    table = rules(spark, (AMOUNT, "LOW", {"threshold": 1}), (AMOUNT, "HIGH", {"threshold": 2}),
                  (AMOUNT, "LOW", {"threshold": 3}))
    table = table.withColumn("enabled", F.col("id") != "r1")
    ids = [m["rule_id"] for m in evaluate_rules(enriched(spark), table).first()["rule_matches"]]
    assert ids == ["r0", "r2"]


def test_invalid_rules_are_set_aside(spark):
    table = rules(spark, (AMOUNT, "LOW", {"threshold": 1}), ("NO_TYPE", "LOW", {}),
                  (AMOUNT, "SEVERE", {}))
    active, invalid = load_active_rules(table)
    assert [r["id"] for r in active.collect()] == ["r0"]
    assert {r["id"]: r["reason"] for r in invalid.collect()} == {
        "r1": "rule_type", "r2": "severity"}


def test_no_rules(spark):
    none = rules(spark, (AMOUNT, "LOW", {})).where("false")
    assert evaluate_rules(enriched(spark), none).first()["rule_matches"] == []


def test_hits_need_no_shuffle(spark):
    plan = rule_hits(enriched(spark), rules(spark, (AMOUNT, "LOW", {"threshold": 1})))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in text and "Join" not in text
