"""Isolation Forest: fitting, scoring, saving."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fraudloom.operators import isolation
from fraudloom.session import shared_dir


@pytest.fixture(scope="module")
def features(spark):
    """2 000 ordinary rows and 20 far away ones."""
    far = F.col("id") >= 2000
    unit = lambda salt: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(1000)) / 1000.0
    return spark.range(2020).select(
        F.col("id").alias("transaction_id"),
        F.when(far, 50000.0).otherwise(unit(1) * 100).alias("f_amount"),
        (unit(2) * 23).alias("f_hour_of_day"),
        F.when(far, 1.0).otherwise(0.1).alias("f_country_risk_tier"),
        F.when(far, 0.95).otherwise(unit(3) * 0.3).alias("f_merchant_category_code"),
        F.when(far, 40.0).otherwise(unit(4) * 3).alias("f_user_rolling_count"),
    )


@pytest.fixture(scope="module")
def forest(features):
    return isolation.iforest_fit(features, n_trees=40)


def test_fit_is_bounded_and_repeatable(features, forest):
    assert forest.n_trees == 40
    assert len(forest.nodes) <= 40 * (2 * 256 - 1)
    again = isolation.iforest_fit(features.repartition(7), n_trees=40)
    assert forest.nodes.equals(again.nodes)
    assert (forest.offset, forest.min_score, forest.max_score) == (
        again.offset, again.min_score, again.max_score)
    other = isolation.iforest_fit(features, n_trees=40, seed=7)
    assert not forest.nodes.equals(other.nodes)


def test_outliers_score_high(features, forest):
    scored = isolation.iforest_score(features, forest)
    means = {r["far"]: float(r["m"]) for r in scored.groupBy(
        (F.col("transaction_id") >= 2000).alias("far")).agg(F.avg("ml_score").alias("m")).collect()}
    assert means[True] > 0.8 > 0.4 > means[False]
    bounds = scored.agg(F.min("ml_score"), F.max("ml_score")).first()
    assert 0 <= bounds[0] <= bounds[1] <= 1


def test_contamination_share_is_abnormal(features, forest):
    raw = features.select(isolation.raw_score(forest).alias("raw"))
    share = raw.where("raw > -0.00001").count() / 2020
    assert 0.04 <= share <= 0.06


def test_sampling_does_not_depend_on_size(features):
    sampled = isolation.sample_for_trees(features, 2020, 4, 64, 1)
    sizes = [r["count"] for r in sampled.groupBy("tree").count().collect()]
    assert sizes == [64] * 4
    pooled = isolation.sample_for_trees(features, 2020, 2, 8, 1)
    assert all(4 <= r["count"] <= 8 for r in pooled.groupBy("tree").count().collect())


def test_vectorised_paths_match_a_walk(features, forest):
    rows = features.limit(50).collect()
    nodes = {(n.tree, n.node): n for n in forest.nodes.itertuples()}
    total = {r["transaction_id"]: r["s"] for r in features.select(
        "transaction_id", isolation.anomaly(forest).alias("s")).collect()}
    for row in rows:
        lengths = []
        for tree in range(forest.n_trees):
            node = 0
            while nodes[(tree, node)].feature >= 0:
                at = nodes[(tree, node)]
                value = row[isolation.FEATURE_COLUMNS[at.feature]]
                node = 2 * node + (1 if value <= at.threshold else 2)
            lengths.append(nodes[(tree, node)].path_length)
        expected = 2.0 ** (-np.mean(lengths) / isolation.average_path(256))
        assert abs(total[row["transaction_id"]] - expected) < 1e-9


def test_degenerate_bounds(features, forest):
    from dataclasses import replace

    flat = replace(forest, min_score=0.2, max_score=0.2)
    scores = isolation.iforest_score(features, flat).select("ml_score").distinct().collect()
    assert [float(r[0]) for r in scores] == [0.5]


def test_save_and_load(spark, features, forest):
    path = shared_dir(spark, "model")
    isolation.save_model(spark, forest, path)
    loaded = isolation.load_model(spark, path)
    a = isolation.iforest_score(features, forest).collect()
    b = isolation.iforest_score(features, loaded).collect()
    assert {(r[0], r["ml_score"]) for r in a} == {(r[0], r["ml_score"]) for r in b}
    with pytest.raises(ValueError):
        isolation.load_model(spark, path + "-missing")
