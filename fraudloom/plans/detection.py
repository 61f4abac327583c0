"""Transactions to decisions in one plan: velocity, profile, rules, model, score."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from fraudloom.config import DetectionConfig
from fraudloom.operators.features import extract_features, velocity_trailing, with_risk_profile
from fraudloom.operators.isolation import Forest, iforest_score
from fraudloom.operators.rules import evaluate_rules
from fraudloom.operators.scoring import decide, demo_override
from fraudloom.schemas import SCORE


def enrich(txns: DataFrame, profiles: DataFrame, minutes: int) -> DataFrame:
    return with_risk_profile(velocity_trailing(txns, minutes), profiles)


def detect(
    txns: DataFrame, profiles: DataFrame, rules: DataFrame, forest: Forest | None = None,
    cfg: DetectionConfig = DetectionConfig(),
) -> DataFrame:
    """One decision per transaction. Without a forest the model score is zero."""
    return decide_enriched(enrich(txns, profiles, cfg.velocity_minutes), rules, forest, cfg)


def decide_enriched(
    enriched: DataFrame, rules: DataFrame, forest: Forest | None = None,
    cfg: DetectionConfig = DetectionConfig(),
) -> DataFrame:
    """Decisions for transactions that already carry velocity and profile columns."""
    if forest is None:
        scored = enriched.withColumn("ml_anomaly_score", F.lit(0).cast(SCORE))
    else:
        scored = iforest_score(
            extract_features(
                enriched, forest.country_risk_tiers, forest.merchant_category_map,
                keep=enriched.columns,
            ), forest, column="ml_anomaly_score"
        )
        scored = scored.select(*enriched.columns, "ml_anomaly_score")
    matched = evaluate_rules(scored, rules, cfg.velocity_minutes)
    return demo_override(decide(matched, cfg.scoring), cfg.demo_mode)
