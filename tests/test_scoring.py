"""Composite score, decision and demo override."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from fraudloom.config import ScoringConfig
from fraudloom.operators.scoring import build_alerts, composite_score, decide, demo_override

MATCH = ("array<struct<rule_id:string,rule_name:string,rule_type:string,severity:string,"
         "explanation:string,parameters_snapshot:string,matched_at:timestamp_ntz>>")


def scored(spark, severities, ml, profile, metadata="{}"):
    matches = [(f"r{i}", "n", "T", s, "e", "{}", None) for i, s in enumerate(severities)]
    df = spark.createDataFrame(
        [(1, 7, matches, str(ml), str(profile), metadata)],
        f"transaction_id long, user_id long, rule_matches {MATCH}, ml string, profile string,"
        " metadata string")
    return df.withColumns({
        "ml_anomaly_score": F.col("ml").cast("decimal(7,6)"),
        "risk_score": F.col("profile").cast("decimal(5,4)"),
        "total_alerts": F.lit(0), "false_positive_count": F.lit(0),
        "created_at": F.lit("2024-01-01").cast("timestamp_ntz"), "correlation_id": F.lit("c"),
    })


CASES = [
    (["HIGH"], "0.6", "0.5", "0.6550", True, "MEDIUM"),
    (["CRITICAL"], "1", "1", "1.0000", True, "CRITICAL"),
    ([], "0.1", "0", "0.0300", False, "LOW"),
    (["CRITICAL"], "0", "0", "0.5000", True, "CRITICAL"),
    (["MEDIUM"], "0.8", "0.5", "0.5900", False, "MEDIUM"),
    (["MEDIUM"], "0.8334", "0.5", "0.6000", True, "MEDIUM"),
    (["LOW", "HIGH"], "0.75", "0.75", "0.7500", True, "HIGH"),
    (["HIGH"], "1", "0.9", "0.8550", True, "CRITICAL"),
]


@pytest.mark.parametrize("severities,ml,profile,score,alert,severity", CASES)
def test_decisions(spark, severities, ml, profile, score, alert, severity):
    row = decide(scored(spark, severities, ml, profile)).first()
    assert row["composite_risk_score"] == Decimal(score)
    assert row["should_alert"] is alert
    assert row["severity"] == severity
    assert (row["explanation"] is not None) == alert


def test_explanation_names_both_reasons(spark):
    row = decide(scored(spark, ["CRITICAL"], 1, 1)).first()
    assert row["explanation"] == (
        "Triggered by CRITICAL severity deterministic fraud rule; "
        "Composite risk score 1.0000 >= threshold 0.60")


def test_weights_are_configurable_and_clamped(spark):
    cfg = ScoringConfig(Decimal("1.0"), Decimal("1.0"), Decimal("1.0"))
    one = F.lit("0.9").cast("decimal(5,4)")
    row = spark.range(1).select(composite_score(one, one, one, cfg).alias("s")).first()
    assert row["s"] == Decimal("1.0000")


def test_demo_override(spark):
    benign = decide(scored(spark, [], 0, 0, '{"demo_scenario": "sanction_evasion_test"}'))
    forced = demo_override(benign, True).first()
    assert (forced["should_alert"], forced["severity"], forced["is_demo"]) == (
        True, "CRITICAL", True)
    assert forced["composite_risk_score"] == 1
    assert forced["rule_matches"][-1]["rule_type"] == "DEMO_SCENARIO"
    assert demo_override(benign).first()["should_alert"] is False
    plain = decide(scored(spark, [], 0, 0))
    assert demo_override(plain, True).first()["is_demo"] is False


def test_alert_ids_are_stable(spark):
    decision = decide(scored(spark, ["CRITICAL"], 0, 0))
    assert build_alerts(decision).first()["id"] == build_alerts(decision).first()["id"]
    assert build_alerts(decide(scored(spark, [], 0, 0))).count() == 0
