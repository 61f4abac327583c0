"""Queries for features and the Isolation Forest."""

import pandas as pd
from pyspark.sql import functions as F

from fraudloom.fixtures import seeded_rules
from fraudloom.operators import isolation
from fraudloom.operators.features import extract_features, velocity_trailing
from fraudloom.plans.detection import detect
from fraudloom.registry.core import query, sql
from fraudloom.functions.columns import lower_code, upper_code
from fraudloom.registry.detection import CFG, MINUTES, STEPS, VELOCITY
from fraudloom.session import shared_dir

FEATURES_SQL = """
    SELECT transaction_id, CAST(amount AS DOUBLE) AS f_amount, CAST(hour(created_at) AS DOUBLE) AS f_hour_of_day,
      CASE WHEN country IN ('US','CA','GB','DE','FR','AU','JP','SG') THEN 0.1e0 WHEN country IN ('BR','IN','MX') THEN 0.4e0
           WHEN country = 'ZA' THEN 0.5e0 WHEN country IN ('NG','RU') THEN 0.8e0
           WHEN country IN ('KP','IR','SY') THEN 1.0e0 ELSE 0.3e0 END AS f_country_risk_tier,
      CASE WHEN merchant_category IN ('groceries','supermarket','pharmacy') THEN 0.1e0
           WHEN merchant_category = 'travel' THEN 0.4e0 WHEN merchant_category = 'electronics' THEN 0.5e0
           WHEN merchant_category = 'jewelry' THEN 0.7e0 WHEN merchant_category = 'crypto' THEN 0.9e0
           WHEN merchant_category = 'gambling' THEN 0.95e0 ELSE 0.3e0 END AS f_merchant_category_code,
      CAST(txn_count AS DOUBLE) AS f_user_rolling_count
    FROM vel"""

# A small forest with known paths: (tree, node, feature, threshold, path length).
FIXED_NODES = [
    (0, 0, 0, 5000.0, None), (0, 1, 4, 3.5, None), (0, 2, -1, None, 1.0),
    (0, 3, -1, None, 6.0), (0, 4, -1, None, 3.0),
    (1, 0, 2, 0.45, None), (1, 1, -1, None, 5.0), (1, 2, 3, 0.65, None),
    (1, 5, -1, None, 3.0), (1, 6, -1, None, 2.0),
    (2, 0, 1, 5.5, None), (2, 1, -1, None, 2.5), (2, 2, -1, None, 5.5),
]
FIXED_PATHS = """
    SELECT transaction_id,
      CASE WHEN f_amount <= 5000 THEN CASE WHEN f_user_rolling_count <= 3.5 THEN 6e0 ELSE 3e0 END ELSE 1e0 END
      + CASE WHEN f_country_risk_tier <= 0.45 THEN 5e0 WHEN f_merchant_category_code <= 0.65 THEN 3e0 ELSE 2e0 END
      + CASE WHEN f_hour_of_day <= 5.5 THEN 2.5e0 ELSE 5.5e0 END AS total
    FROM feats"""
# Average path length of 256 points, to double precision.
PATH_256 = repr(isolation.average_path(256))


def fixed_forest(offset: float | None) -> isolation.Forest:
    nodes = pd.DataFrame(
        FIXED_NODES, columns=["tree", "node", "feature", "threshold", "path_length"])
    return isolation.Forest(nodes=nodes, sample_size=256, offset=offset, min_score=0.1 if offset is None else -0.4,
                            max_score=0.9 if offset is None else 0.3)


def feature_rows(t):
    return extract_features(velocity_trailing(t.txn, MINUTES))


@query("extract_features", sql("txn", "SELECT * FROM feats", vel=VELOCITY, feats=FEATURES_SQL))
def extracted(t):
    return feature_rows(t)


def _score_sql(low: str, high: str, offset: str) -> str:
    return sql("txn", f"""
    SELECT transaction_id, CAST(round(least(1e0, greatest(0e0, (pow(2e0, -(total / 3e0) / {PATH_256}) + {offset} - ({low})) / ({high} - ({low})))), 4)
      AS DECIMAL(5,4)) AS ml_score FROM paths""", vel=VELOCITY, feats=FEATURES_SQL, paths=FIXED_PATHS)


@query("iforest_score", _score_sql("-0.4e0", "0.3e0", "(-0.6e0)"))
def scored(t):
    return isolation.iforest_score(feature_rows(t), fixed_forest(-0.6)).select(
        "transaction_id", "ml_score")


@query("score_samples", _score_sql("0.1e0", "0.9e0", "0e0"))
def plain_scores(t):
    return isolation.iforest_score(feature_rows(t), fixed_forest(None)).select(
        "transaction_id", "ml_score")


@query("score_calibration", sql("txn", f"""
    SELECT round(min(s) - 0.02e0, 4) AS min_score, round(max(s) + 0.02e0, 4) AS max_score
    FROM (SELECT pow(2e0, -(total / 3e0) / {PATH_256}) - 0.6e0 AS s FROM paths) x""",
    vel=VELOCITY, feats=FEATURES_SQL, paths=FIXED_PATHS))
def calibration(t):
    raw = feature_rows(t).select(isolation.raw_score(fixed_forest(-0.6)).alias("raw_score"))
    return isolation.score_calibration(raw)


@query("iforest_fit")
def fitted(t):
    forest = isolation.iforest_fit(feature_rows(t))
    return t.spark.createDataFrame(forest.nodes, isolation.NODE_SCHEMA)


@query("model_metadata", sql("txn", """
    SELECT '1.0.0' AS model_version, count(*) AS training_sample_size, CAST(least(256, count(*)) AS INT) AS sample_size,
      0.05e0 AS contamination, CAST(100 AS INT) AS n_estimators, CAST(5 AS INT) AS features, CAST(17 AS INT) AS country_tiers,
      CAST(13 AS INT) AS categories, TRUE AS bounds_ordered FROM txn"""))
def metadata(t):
    found = isolation.model_metadata(t.spark, isolation.iforest_fit(feature_rows(t)))
    return found.select(
        "model_version", "training_sample_size", "sample_size", "contamination", "n_estimators",
        F.size("feature_names").alias("features"), F.size("country_risk_tiers").alias("country_tiers"),
        F.size("merchant_category_map").alias("categories"),
        (F.col("min_score") < F.col("max_score")).alias("bounds_ordered"))


@query("load_model_tables", sql("txn", """
    SELECT transaction_id, f_country_risk_tier AS country_risk, f_merchant_category_code AS category_risk FROM feats""",
    vel=VELOCITY, feats=FEATURES_SQL))
def loaded(t):
    """Lookups through the two dimension tables of a saved model."""
    path = shared_dir(t.spark, "model")
    isolation.save_model(t.spark, isolation.iforest_fit(feature_rows(t)), path)
    tiers, categories = isolation.lookup_tables(
        isolation.read_metadata(t.spark, f"{path}/metadata"))
    tiers = tiers.withColumnRenamed("risk", "country_risk")
    categories = categories.withColumnRenamed("risk", "category_risk")
    return (
        t.txn.join(tiers, upper_code("country") == tiers["name"], "left")
        .join(categories, lower_code("merchant_category") == categories["name"], "left")
        .select("transaction_id", F.coalesce("country_risk", F.lit(0.3)).alias("country_risk"),
                F.coalesce("category_risk", F.lit(0.3)).alias("category_risk"))
    )


@query("score_with_saved_model")
def reloaded(t):
    path = shared_dir(t.spark, "model")
    isolation.save_model(t.spark, isolation.iforest_fit(feature_rows(t)), path)
    forest = isolation.load_model(t.spark, path)
    return isolation.iforest_score(feature_rows(t), forest).select("transaction_id", "ml_score")


ML_STEPS = {
    **{name: STEPS[name] for name in ("vel", "enriched", "rules", "matched", "scored")},
    "feats": FEATURES_SQL, "paths": FIXED_PATHS,
    "mls": f"""
    SELECT transaction_id, CAST(round(least(1e0, greatest(0e0, (pow(2e0, -(total / 3e0) / {PATH_256}) - 0.6e0 + 0.4e0) / 0.7e0)), 4)
      AS DECIMAL(5,4)) AS ml_anomaly_score FROM paths""",
    "composed": """
    SELECT s.*, m.ml_anomaly_score, CAST(round(least(1, 0.5 * rule_severity_score + 0.3 * ml_anomaly_score + 0.2 * user_risk_score), 4)
      AS DECIMAL(5,4)) AS composite_risk_score FROM scored s JOIN mls m ON m.transaction_id = s.transaction_id""",
    "decided": STEPS["decided"],
}


@query("detect_with_forest", sql("txn risk_profiles_fx", """
    SELECT transaction_id, should_alert, severity, composite_risk_score, ml_anomaly_score, explanation FROM decided""",
    **ML_STEPS))
def forest_detection(t):
    """The whole hybrid decision with a forest whose paths are known."""
    found = detect(t.txn, t.risk_profiles_fx, seeded_rules(t.spark), fixed_forest(-0.6), CFG)
    return found.select("transaction_id", "should_alert", "severity", "composite_risk_score",
                        "ml_anomaly_score", "explanation")


@query("detect_with_model")
def full_detection(t):
    forest = isolation.iforest_fit(feature_rows(t))
    found = detect(t.txn, t.risk_profiles_fx, seeded_rules(t.spark), forest, CFG)
    return found.select("transaction_id", "should_alert", "severity", "composite_risk_score",
                        F.col("ml_anomaly_score"))


@query("iforest_tree_shape", "SELECT CAST(range AS INT) AS tree, TRUE AS rooted, TRUE AS binary FROM range(100)")
def tree_shapes(t):
    """Every tree of a fresh forest has its root and one leaf more than inner nodes."""
    nodes = t.spark.createDataFrame(isolation.iforest_fit(feature_rows(t)).nodes, isolation.NODE_SCHEMA)
    inner = F.count_if(F.col("feature") >= 0)
    return nodes.groupBy(F.col("tree").cast("int").alias("tree")).agg(
        (F.min("node") == 0).alias("rooted"),
        (F.count_if(F.col("feature") < 0) == inner + 1).alias("binary"))


@query("saved_model_differences", sql("txn", "SELECT count(*) AS n_rows, CAST(0 AS BIGINT) AS differences FROM txn"))
def saved_differences(t):
    """Rows that a saved and reloaded forest scores otherwise than the fresh one: none."""
    rows, path = feature_rows(t), shared_dir(t.spark, "model")
    fresh = isolation.iforest_fit(rows)
    isolation.save_model(t.spark, fresh, path)
    forest = isolation.load_model(t.spark, path)
    both = isolation.iforest_score(rows, fresh).withColumnRenamed("ml_score", "fresh_score")
    both = isolation.iforest_score(both, forest)
    return both.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(~F.col("ml_score").eqNullSafe(F.col("fresh_score"))).alias("differences"))


@query("model_decision_parts", sql("txn", "SELECT count(*) AS n_rows, CAST(0 AS BIGINT) AS differences FROM txn"))
def decision_parts(t):
    """Decisions with a fitted forest whose composite is not the weighted sum of its parts: none."""
    forest = isolation.iforest_fit(feature_rows(t))
    found = detect(t.txn, t.risk_profiles_fx, seeded_rules(t.spark), forest, CFG)
    total = sum(F.col(name).cast("decimal(10,4)") * F.lit(weight).cast("decimal(2,1)") for name, weight in (
        ("rule_severity_score", "0.5"), ("ml_anomaly_score", "0.3"), ("user_risk_score", "0.2")))
    expected = F.round(F.least(total, F.lit(1)), 4).cast("decimal(5,4)")
    return found.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(~F.col("composite_risk_score").eqNullSafe(expected)).alias("differences"))
