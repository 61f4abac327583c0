"""Rules by id for large rule tables: rules stay rows, and every path equals the matches."""

import datetime
import hashlib
import json
import pickle
import random
from collections import Counter
from decimal import Decimal

import numpy as np
import pytest

from fraudloom.operators import rules as operators
from fraudloom.operators.rules import RuleSets, evaluate_rules, evaluate_rules_per_window
from test_many_rules import RULES, START, TXNS, enriched, random_rules, random_txns

PROFILES = "user_id int, risk_score decimal(5,4), total_alerts int, false_positive_count int"
ROWS = TXNS + ", txn_count long, total_amount decimal(24,2), risk_score decimal(5,4)"


def expected(matched):
    """(transaction, number, digest) and transactions per rule, from the matches."""
    told, per_rule = Counter(), Counter()
    for row in matched.collect():
        ids = [match["rule_id"] for match in row["rule_matches"]]
        text = ",".join(i for i in ids if i is not None)
        told[row["transaction_id"], len(ids), hashlib.sha256(text.encode()).hexdigest()] += 1
        per_rule.update(ids)
    return told, per_rule


def check(sets, matched):
    told, per_rule = expected(matched)
    assert Counter(map(tuple, sets.with_digests().collect())) == told
    assert {r["id"]: r["transactions"] for r in sets.transactions_per_rule().collect()} == per_rule
    return per_rule


def long_rules(n=400):
    """Rules with long ids of few distinct limits."""
    kinds = [("AMOUNT_THRESHOLD", {"threshold": 10}), ("USER_RISK_LEVEL", {"min_risk_score": 0.2}),
             ("VELOCITY", {"max_count": 2, "max_amount": 30, "window_minutes": 10})]
    return [(f"rule-{i:06d}-{'x' * 100}", "n", kinds[i % 3][0], "LOW", True, json.dumps(kinds[i % 3][1]), START, i)
            for i in range(n)]


def sent(spark, monkeypatch, run):
    """Bytes of what `run` broadcasts, and the plans of the frame it returns."""
    sizes, broadcast = [], spark.sparkContext.broadcast
    monkeypatch.setattr(spark.sparkContext, "broadcast", lambda value: sizes.append(
        len(pickle.dumps(value))) or broadcast(value))
    plans = run()._jdf.queryExecution()
    return sum(sizes), plans.analyzed().toString() + plans.optimizedPlan().toString()


def test_digests_keep_rules_as_rows(spark, monkeypatch):
    rows, many = enriched(spark, random.Random(1)), spark.createDataFrame(long_rules(), RULES)
    size, plan = sent(spark, monkeypatch, lambda: RuleSets(rows, many, ["transaction_id"]).with_digests())
    assert size < 10_000 and "rule-0000" not in plan


def test_counts_keep_rules_as_rows(spark, monkeypatch):
    rows, many = enriched(spark, random.Random(1)), spark.createDataFrame(long_rules(), RULES)
    size, plan = sent(spark, monkeypatch, lambda: RuleSets(rows, many, ["transaction_id"]).transactions_per_rule())
    assert size < 10_000 and "rule-0000" not in plan


def test_own_windows_keep_rules_as_rows(spark, monkeypatch):
    txns = spark.createDataFrame(random_txns(random.Random(1), 60), TXNS)
    many, profiles = spark.createDataFrame(long_rules(), RULES), spark.createDataFrame([], PROFILES)
    size, plan = sent(spark, monkeypatch, lambda: RuleSets.per_window(
        txns, profiles, many, ["transaction_id"]).with_digests())
    assert size < 10_000 and "rule-0000" not in plan


def test_many_blocks_and_chunks(spark, monkeypatch):
    pick = random.Random(4)
    many = random_rules(pick, 120)
    many = spark.createDataFrame(many + many[:9] + [(None, *many[7][1:]), ("", *many[8][1:])], RULES)
    rows = enriched(spark, pick, 200).cache()
    monkeypatch.setattr(operators, "SETS_PER_TASK", 7)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "6")
    try:
        check(RuleSets(rows, many, ["transaction_id"]), evaluate_rules(rows, many))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_own_windows(spark):
    pick = random.Random(7)
    many = spark.createDataFrame([r for r in random_rules(pick, 200) if r[2] != "USER_RISK_LEVEL"], RULES)
    txns = spark.createDataFrame(random_txns(pick, 150), TXNS).cache()
    profiles = spark.createDataFrame([(1, Decimal("0.3"), 1, 0)], PROFILES)
    check(RuleSets.per_window(txns, profiles, many, ["transaction_id"], 30),
          evaluate_rules_per_window(txns, profiles, many, 30))


def test_limits_beyond_64_bits(spark):
    limits = ["0.00000001", "99999999999999999999", "-99999999999999999999", "92233720368.54775807",
              "92233720368.54775808", "-92233720368.54775808", "1000000000", "300000000000"]
    many = spark.createDataFrame([
        (f"r{i}{over}{key}", "n", kind, "LOW", True, json.dumps({key: limit, "operator": over}), START, i)
        for kind, key in (("AMOUNT_THRESHOLD", "threshold"), ("VELOCITY", "max_amount"))
        for i, limit in enumerate(limits) for over in (">", ">=")], RULES)
    amounts = [Decimal(a) for a in ("999999999999.99", "-999999999999.99", "0.00", "92233720368.54", "92233720368.55",
                                    "1000000000.00", "300000000000.00")]
    rows = spark.createDataFrame([
        (i, 1, a, "EUR", "fr", "a", START, 1, a * 1000, Decimal(0)) for i, a in enumerate(amounts)], ROWS)
    assert len(check(RuleSets(rows, many, ["transaction_id"]), evaluate_rules(rows, many))) > 20


def test_counts_of_two_limits(spark):
    """Rules over count or total, of many limits: a transaction that reaches both counts once."""
    pick = random.Random(9)
    many = [(f"v{i}", "n", "VELOCITY", "LOW", True, json.dumps(
        {"max_count": pick.randrange(1, 40), "max_amount": pick.randrange(1, 500)}), START, i) for i in range(300)]
    rows = [(i, 1, Decimal(1), "EUR", "fr", "a", START + datetime.timedelta(minutes=i), pick.randrange(45),
             Decimal(pick.randrange(550)), Decimal(0)) for i in range(500)]
    sets = RuleSets(spark.createDataFrame(rows, ROWS), spark.createDataFrame(many, RULES), ["transaction_id"])
    count, total = np.array([r[7] for r in rows]), np.array([float(r[8]) for r in rows])
    limits = {r[0]: json.loads(r[5]) for r in many}
    told = {r["id"]: r["transactions"] for r in sets.transactions_per_rule().collect()}
    met = {i: int(((count >= p["max_count"]) | (total >= p["max_amount"])).sum()) for i, p in limits.items()}
    assert told == {i: n for i, n in met.items() if n}


@pytest.mark.parametrize("size", [0, 1, 5])
def test_one_kind_of_rule(spark, size):
    many = spark.createDataFrame([(f"c{i}", "n", "HIGH_RISK_COUNTRY", "LOW", True, json.dumps(
        {"countries": ["ru", "kp"][:i + 1]}), START, -i) for i in range(size)], RULES)
    rows = enriched(spark, random.Random(3), 40).cache()
    check(RuleSets(rows, many, ["transaction_id"]), evaluate_rules(rows, many))
