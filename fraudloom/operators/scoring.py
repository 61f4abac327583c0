"""Composite score, severity and the alert decision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from fraudloom.config import ScoringConfig
from fraudloom.functions.columns import clamp01, derived_id, quantize4
from fraudloom.schemas import SCORE

# Severity values and the score from which a severity applies (fixed values).
SEVERITY_VALUES = {"LOW": "0.2500", "MEDIUM": "0.5000", "HIGH": "0.7500", "CRITICAL": "1.0000"}
SEVERITY_FROM = {"CRITICAL": "0.8500", "HIGH": "0.7000", "MEDIUM": "0.5000"}
DEMO_RULE_ID = "00000000-0000-0000-0000-000000000000"


def _score(value) -> Column:
    return F.lit(str(value)).cast(SCORE)


def severity_value(severity: Column) -> Column:
    value = _score("0")
    for name, amount in SEVERITY_VALUES.items():
        value = F.when(severity == name, _score(amount)).otherwise(value)
    return value


def rule_severity_score(matches: Column | str = "rule_matches") -> Column:
    """Highest severity value among the matches, 0 for none."""
    col = F.col(matches) if isinstance(matches, str) else matches
    severities = F.transform(col, lambda m: m["severity"])
    value = _score("0")
    for name, amount in SEVERITY_VALUES.items():
        value = F.when(F.array_contains(severities, name), _score(amount)).otherwise(value)
    return value


def has_critical(matches: Column | str = "rule_matches") -> Column:
    col = F.col(matches) if isinstance(matches, str) else matches
    return F.array_contains(F.transform(col, lambda m: m["severity"]), "CRITICAL")


def composite_score(
    rule: Column, ml: Column, profile: Column, cfg: ScoringConfig = ScoringConfig(),
) -> Column:
    """Weighted sum, clamped to [0, 1] and rounded once at the end."""
    weights = [F.lit(str(w)).cast("decimal(5,4)") for w in (cfg.w_rule, cfg.w_ml, cfg.w_profile)]
    total = sum((w * part for w, part in zip(weights[1:], (ml, profile))), weights[0] * rule)
    return clamp01(quantize4(F.least(F.lit(1).cast("decimal(5,4)"), total)))


def alert_severity(score: Column, critical: Column) -> Column:
    severity = F.when(critical, F.lit("CRITICAL"))
    for name, lower in SEVERITY_FROM.items():
        severity = severity.when(score >= _score(lower), name)
    return severity.otherwise("LOW")


def decide(scored: DataFrame, cfg: ScoringConfig = ScoringConfig()) -> DataFrame:
    """Adds score, severity, decision and explanation.

    Needs `rule_matches`, `ml_anomaly_score` and the profile columns.
    """
    threshold = F.lit(str(cfg.alert_threshold)).cast("decimal(5,4)")
    scored = scored.withColumns({
        "rule_severity_score": rule_severity_score(),
        "ml_anomaly_score": quantize4("ml_anomaly_score"),
        "user_risk_score": quantize4("risk_score"),
        "_critical": has_critical(),
    }).withColumn("composite_risk_score", composite_score(
        F.col("rule_severity_score"), F.col("ml_anomaly_score"), F.col("user_risk_score"), cfg
    ))
    over = F.col("composite_risk_score") >= threshold
    reasons = F.concat_ws(
        "; ",
        F.when(F.col("_critical"),
               F.lit("Triggered by CRITICAL severity deterministic fraud rule")),
        F.when(over, F.concat(
            F.lit("Composite risk score "), F.col("composite_risk_score").cast("string"),
            F.lit(f" >= threshold {cfg.alert_threshold}"),
        )),
    )
    alert = over | F.col("_critical")
    return scored.withColumns({
        "should_alert": alert,
        "severity": alert_severity(F.col("composite_risk_score"), F.col("_critical")),
        "explanation": F.when(alert, reasons),
        "is_demo": F.lit(False),
    }).drop("_critical")


def demo_override(decisions: DataFrame, enabled: bool = False) -> DataFrame:
    """Forces a CRITICAL alert for rows tagged with a demo scenario; off by default."""
    if not enabled:
        return decisions
    scenario = F.nullif(F.get_json_object("metadata", "$.demo_scenario"), F.lit(""))
    match = F.struct(
        F.lit(DEMO_RULE_ID).alias("rule_id"),
        F.concat(F.lit("Demo Scenario: "), F.col("_scenario")).alias("rule_name"),
        F.lit("DEMO_SCENARIO").alias("rule_type"), F.lit("CRITICAL").alias("severity"),
        F.concat(F.lit("DEMO_MODE override forced CRITICAL alert for scenario '"),
                 F.col("_scenario"), F.lit("'")).alias("explanation"),
        F.to_json(F.struct(F.col("_scenario").alias("demo_scenario"))).alias("parameters_snapshot"),
        F.col("created_at").alias("matched_at"),
    )
    tagged = F.col("_scenario").isNotNull()
    kept = decisions.withColumn("_scenario", scenario)
    forced = {
        "rule_matches": F.array_append("rule_matches", match),
        "should_alert": F.lit(True),
        "severity": F.lit("CRITICAL"),
        "composite_risk_score": _score("1"),
        "rule_severity_score": _score("1"),
        "is_demo": F.lit(True),
        "explanation": F.concat(
            F.lit("DEMO_MODE forced alert for scenario: "), F.col("_scenario")),
    }
    return kept.withColumns({
        name: F.when(tagged, value).otherwise(F.col(name)) for name, value in forced.items()
    }).drop("_scenario")


def build_alerts(decisions: DataFrame) -> DataFrame:
    """Alert rows of the decisions that raise one; the id follows from the transaction."""
    nothing = F.lit(None)
    return decisions.where("should_alert").select(
        derived_id(F.lit("alert"), "transaction_id").alias("id"),
        F.col("transaction_id"),
        F.col("user_id"),
        F.lit("PENDING").alias("status"),
        F.col("severity"),
        F.col("composite_risk_score"),
        F.col("ml_anomaly_score"),
        F.to_json("rule_matches").alias("rule_matches"),
        F.to_json(F.struct(
            F.col("user_id").cast("string").alias("user_id"),
            F.col("risk_score").cast("string").alias("risk_score"),
            "total_alerts", "false_positive_count",
        )).alias("risk_profile_snapshot"),
        F.col("is_demo"),
        nothing.cast("string").alias("resolved_by"),
        nothing.cast("timestamp_ntz").alias("resolved_at"),
        nothing.cast("string").alias("resolution_reason"),
        nothing.cast("timestamp_ntz").alias("escalated_email_at"),
        nothing.cast("timestamp_ntz").alias("escalated_slack_at"),
        F.col("correlation_id"),
        F.col("created_at"),
    )


def mark_processed(txns: DataFrame, decisions: DataFrame, at: Column) -> DataFrame:
    """Sets status and processing time of the transactions that have a decision."""
    handled = decisions.select("transaction_id", F.lit(True).alias("_handled"))
    done = F.coalesce("_handled", F.lit(False))
    return txns.join(handled, "transaction_id", "left").withColumns({
        "status": F.when(done, "PROCESSED").otherwise(F.col("status")),
        "processed_at": F.when(done, at),
    }).drop("_handled")


def composite_breakdown(alerts: DataFrame, cfg: ScoringConfig = ScoringConfig()) -> DataFrame:
    """The three components of every alert with their weights applied."""
    parts = {
        "rule": ("rule_severity_score", cfg.w_rule), "ml": ("ml_anomaly_score", cfg.w_ml),
        "profile": ("user_risk_score", cfg.w_profile),
    }
    columns = []
    for name, (column, weight) in parts.items():
        columns.append(F.round(column, 2).cast("decimal(5,2)").alias(f"{name}_score"))
        columns.append(
            quantize4(F.col(column) * F.lit(str(weight)).cast(SCORE)).alias(f"{name}_part"))
    return alerts.select(
        "transaction_id",
        F.round("composite_risk_score", 2).cast("decimal(5,2)").alias("composite_score"),
        *columns,
    )
