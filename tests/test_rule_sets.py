"""Rules per transaction by id: the same as the matches, put together once per distinct set."""

import hashlib
import random
from collections import Counter

import pytest

from fraudloom.operators.rules import RuleSets, evaluate_rules
from test_many_rules import RULES, enriched, random_rules


@pytest.mark.parametrize("seed", [1, 2])
def test_sets_equal_matches(spark, seed):
    pick = random.Random(seed)
    many = random_rules(pick, 110)
    rules = spark.createDataFrame(many + many[:5] + [(None, *many[7][1:])], RULES)
    rows = enriched(spark, pick)
    rows = rows.unionByName(rows.limit(20)).cache()
    expected, per_rule = Counter(), Counter()
    for row in evaluate_rules(rows, rules).collect():
        ids = [match["rule_id"] for match in row["rule_matches"]]
        text = ",".join(i for i in ids if i is not None)
        expected[row["transaction_id"], len(ids), hashlib.sha256(text.encode()).hexdigest()] += 1
        per_rule.update(ids)
    sets = RuleSets(rows, rules, ["transaction_id"])
    assert Counter(map(tuple, sets.with_digests().collect())) == expected
    assert {r["id"]: r["transactions"] for r in sets.transactions_per_rule().collect()} == per_rule
    told = [r["transactions"] for r in sets.distinct().collect()]
    assert sum(told) == rows.count() and len(told) <= 60


def test_no_rules(spark):
    rows = enriched(spark, random.Random(3), 5)
    sets = RuleSets(rows, spark.createDataFrame([], RULES), ["transaction_id"])
    empty = hashlib.sha256(b"").hexdigest()
    assert [r[1:] for r in sets.with_digests().collect()] == [(0, empty)] * 5
    assert sets.transactions_per_rule().count() == 0
