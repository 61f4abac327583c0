"""Isolation Forest on DataFrames (Liu, Ting and Zhou, 2008).

Fitting draws the subsample of every tree by hashing row keys, so it is reproducible and never
multiplies the input: one cheap hash selects a pool, a second one distributes the pool over
trees, and each tree is grown from at most `sample_size` rows. A fitted forest has at most
`n_trees * (2 * sample_size - 1)` nodes, whatever the size of the input.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from fraudloom.functions.columns import min_max
from fraudloom.operators.features import (
    COUNTRY_RISK_TIERS, FEATURES, MERCHANT_CATEGORY_RISK,
)
from fraudloom.session import materialize

FEATURE_COLUMNS = [f"f_{name}" for name in FEATURES]
NODE_SCHEMA = "tree int, node int, feature int, threshold double, path_length double"
HASH_RANGE = 1 << 31
POOL_FACTOR = 20
CALIBRATION_MARGIN = 0.02
TREES_PER_PASS = 256


@dataclass(frozen=True)
class Forest:
    """Trees as node rows (binary-heap numbering) plus normalisation settings."""

    nodes: pd.DataFrame
    sample_size: int
    offset: float | None
    min_score: float = 0.0
    max_score: float = 0.0
    training_rows: int = 0
    contamination: float = 0.05
    version: str = "1.0.0"
    country_risk_tiers: dict = field(default_factory=lambda: dict(COUNTRY_RISK_TIERS))
    merchant_category_map: dict = field(default_factory=lambda: dict(MERCHANT_CATEGORY_RISK))

    @property
    def n_trees(self) -> int:
        return int(self.nodes["tree"].nunique())


def average_path(n: int) -> float:
    """Mean path length of an unsuccessful search among n points."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1.0) + np.euler_gamma) - 2.0 * (n - 1.0) / n


def _grow(tree: int, rows: np.ndarray, limit: int, seed: int) -> pd.DataFrame:
    """Node rows of one tree over at most `sample_size` rows."""
    rng = np.random.default_rng([seed, tree])
    out: list[tuple[int, int, int, float | None, float | None]] = []
    pending = [(0, np.arange(len(rows)), 0)]
    while pending:
        node, members, depth = pending.pop()
        values = rows[members]
        low, high = values.min(axis=0), values.max(axis=0)
        splittable = np.flatnonzero(high > low)
        if depth >= limit or len(members) <= 1 or len(splittable) == 0:
            out.append((tree, node, -1, None, depth + average_path(len(members))))
            continue
        feature = int(rng.choice(splittable))
        threshold = float(rng.uniform(low[feature], high[feature]))
        left = values[:, feature] <= threshold
        out.append((tree, node, feature, threshold, None))
        pending.append((2 * node + 1, members[left], depth + 1))
        pending.append((2 * node + 2, members[~left], depth + 1))
    return pd.DataFrame(out, columns=["tree", "node", "feature", "threshold", "path_length"])


def sample_for_trees(
    features: DataFrame, total: int, n_trees: int, sample_size: int, seed: int,
    key: str = "transaction_id",
) -> DataFrame:
    """The rows of every tree: (tree, feature columns), at most `sample_size` rows per tree."""

    def draw(*parts: Column) -> Column:
        return F.pmod(F.xxhash64(F.col(key), F.lit(seed), *parts), F.lit(HASH_RANGE))

    pool_rows = min(total, POOL_FACTOR * n_trees * sample_size)
    pool = features
    if pool_rows < total:
        pool = features.where(draw() < F.lit(int(HASH_RANGE * pool_rows / total)))
    share = min(1.0, 1.5 * sample_size / pool_rows + 16 / pool_rows)
    trees = F.sequence(F.lit(0), F.lit(n_trees - 1))
    if share < 1.0:
        chosen = int(HASH_RANGE * share)
        trees = F.filter(trees, lambda t: draw(t) < F.lit(chosen))
    drawn = pool.select(key, *FEATURE_COLUMNS, F.explode(trees).alias("tree"))
    first = Window.partitionBy("tree").orderBy(draw(F.col("tree")), key)
    return (
        drawn.withColumn("position", F.row_number().over(first))
        .where(F.col("position") <= sample_size)
        .select("tree", "position", *FEATURE_COLUMNS)
    )


def iforest_fit(
    features: DataFrame, n_trees: int = 100, contamination: float = 0.05, seed: int = 42,
    sample_size: int = 256, key: str = "transaction_id",
) -> Forest:
    """Fits a forest and calibrates its score bounds on all rows of `features`.

    The six columns in use are written once to the shared folder; counting, sampling and
    calibration read them from there instead of computing the features three times.
    """
    features = materialize(features.select(key, *FEATURE_COLUMNS), "features")
    total = features.count()
    if total == 0:
        raise ValueError("cannot fit a forest on no rows")
    size = min(sample_size, total)
    limit = math.ceil(math.log2(max(size, 2)))

    def grow(part: pd.DataFrame) -> pd.DataFrame:
        ordered = part.sort_values("position")
        rows = ordered[FEATURE_COLUMNS].to_numpy(dtype=np.float64)
        return _grow(int(ordered["tree"].iloc[0]), rows, limit, seed)

    sampled = sample_for_trees(features, total, n_trees, size, seed, key)
    nodes = sampled.groupBy("tree").applyInPandas(grow, NODE_SCHEMA).toPandas()
    forest = Forest(
        nodes=nodes.sort_values(["tree", "node"], ignore_index=True), sample_size=size,
        offset=0.0, training_rows=total, contamination=contamination,
    )
    return calibrate(features, forest, contamination)


def calibrate(features: DataFrame, forest: Forest, contamination: float) -> Forest:
    """Sets the offset (contamination quantile) and the widened score bounds.

    The quantile comes from counts of scores rounded to 5 digits: at most 100 001 groups, the
    same result on every run.
    """
    score = (-anomaly(forest)).alias("score")
    counts = features.select(F.round(score, 5).alias("score")).groupBy("score").agg(
        F.count(F.lit(1)).alias("n"))
    running = Window.orderBy("score").rowsBetween(Window.unboundedPreceding, 0)
    needed = max(1, math.ceil(contamination * forest.training_rows))
    ranked = counts.withColumn("seen", F.sum("n").over(running))
    found = ranked.agg(
        F.min(F.when(F.col("seen") >= needed, F.col("score"))).alias("offset"),
        F.min("score").alias("low"), F.max("score").alias("high"),
    ).first()
    bounds = score_bounds(found["offset"] - found["high"], found["offset"] - found["low"])
    return replace(forest, offset=float(found["offset"]), min_score=bounds[0],
                   max_score=bounds[1])


def score_bounds(low: float, high: float) -> tuple[float, float]:
    return round(low - CALIBRATION_MARGIN, 4), round(high + CALIBRATION_MARGIN, 4)


def score_calibration(raw: DataFrame, column: str = "raw_score") -> DataFrame:
    """Bounds of the raw scores, widened a little on both sides."""
    margin = F.lit(CALIBRATION_MARGIN)
    return raw.agg(
        F.round(F.min(column) - margin, 4).alias("min_score"),
        F.round(F.max(column) + margin, 4).alias("max_score"),
    )


def _heap_arrays(nodes: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Full binary-heap arrays; below a leaf every left child repeats its path length."""
    depth = int(np.floor(np.log2(nodes["node"].max() + 1)))
    ids = {tree: i for i, tree in enumerate(sorted(nodes["tree"].unique()))}
    row = nodes["tree"].map(ids).to_numpy()
    col = nodes["node"].to_numpy()
    shape = (len(ids), 2 ** (depth + 1) - 1)
    feature = np.zeros(shape, dtype=np.intp)
    threshold = np.full(shape, np.inf)
    path = np.zeros(shape)
    inner = nodes["feature"].to_numpy() >= 0
    feature[row[inner], col[inner]] = nodes["feature"].to_numpy()[inner]
    threshold[row[inner], col[inner]] = nodes["threshold"].to_numpy(dtype=float)[inner]
    path[row[~inner], col[~inner]] = nodes["path_length"].to_numpy(dtype=float)[~inner]
    for node in range(2 ** depth - 1):
        path[:, 2 * node + 1] += path[:, node]
    return feature, threshold, path, depth


def _total_path(nodes: pd.DataFrame):
    """A vectorised UDF: path length of each row, summed over the given trees."""
    feature, threshold, path, depth = _heap_arrays(nodes)
    width = len(FEATURE_COLUMNS)

    @F.pandas_udf("double")
    def total(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for batch in batches:
            matrix = np.column_stack([s.to_numpy(dtype=np.float64) for s in batch]).ravel()
            start = np.arange(len(batch[0])) * width
            result = np.zeros(len(batch[0]))
            for tree in range(feature.shape[0]):
                features, thresholds = feature[tree], threshold[tree]
                at = np.zeros(len(start), dtype=np.intp)
                for _ in range(depth):
                    right = matrix.take(start + features.take(at)) > thresholds.take(at)
                    at = 2 * at + 1 + right
                result += path[tree].take(at)
            yield pd.Series(result)

    return total(*[F.col(name) for name in FEATURE_COLUMNS])


def anomaly(forest: Forest) -> Column:
    """Anomaly score 2^(-E[h]/c) in (0, 1); trees are taken in passes of bounded size."""
    trees = sorted(forest.nodes["tree"].unique())
    total = None
    for at in range(0, len(trees), TREES_PER_PASS):
        part = forest.nodes[forest.nodes["tree"].isin(trees[at:at + TREES_PER_PASS])]
        paths = _total_path(part)
        total = paths if total is None else total + paths
    norm = average_path(forest.sample_size) or 1.0
    return F.pow(F.lit(2.0), -(total / F.lit(float(len(trees)))) / F.lit(norm))


def raw_score(forest: Forest) -> Column:
    """Higher is more abnormal. Without an offset it is the plain anomaly score."""
    score = anomaly(forest)
    return score if forest.offset is None else score + F.lit(float(forest.offset))


def iforest_score(features: DataFrame, forest: Forest, column: str = "ml_score") -> DataFrame:
    """Adds the anomaly score in [0, 1] with 4 digits."""
    return features.withColumn("_raw_score", raw_score(forest)).withColumn(
        column, min_max("_raw_score", forest.min_score, forest.max_score)
    ).drop("_raw_score")


METADATA_SCHEMA = (
    "model_version string, min_score double, max_score double, offset double,"
    " feature_names array<string>, country_risk_tiers map<string,double>,"
    " merchant_category_map map<string,double>, training_sample_size bigint,"
    " sample_size int, contamination double, n_estimators int"
)


def model_metadata(spark: SparkSession, forest: Forest) -> DataFrame:
    """One row describing a fit, including its two lookup maps."""
    row = {
        "model_version": forest.version,
        "min_score": forest.min_score,
        "max_score": forest.max_score,
        "offset": forest.offset,
        "feature_names": list(FEATURES),
        "country_risk_tiers": forest.country_risk_tiers,
        "merchant_category_map": forest.merchant_category_map,
        "training_sample_size": forest.training_rows,
        "sample_size": forest.sample_size,
        "contamination": forest.contamination,
        "n_estimators": forest.n_trees,
    }
    return spark.createDataFrame([row], METADATA_SCHEMA)


def save_model(spark: SparkSession, forest: Forest, path: str) -> None:
    spark.createDataFrame(forest.nodes, NODE_SCHEMA).write.mode("overwrite").parquet(
        f"{path}/nodes")
    model_metadata(spark, forest).write.mode("overwrite").json(f"{path}/metadata")


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """Metadata JSON of a model; text that is no such record fails the read."""
    return spark.read.schema(METADATA_SCHEMA).option("multiLine", "true").option(
        "mode", "FAILFAST").json(path)


def lookup_tables(metadata: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The two lookup maps of a model as tables (name, risk)."""
    return tuple(
        metadata.select(F.explode(name).alias("name", "risk"))
        for name in ("country_risk_tiers", "merchant_category_map")
    )


def load_model(spark: SparkSession, path: str) -> Forest:
    """Reads a saved model; anything missing or unreadable fails, never scores silently."""
    try:
        meta = read_metadata(spark, f"{path}/metadata").first()
        nodes = spark.read.schema(NODE_SCHEMA).parquet(f"{path}/nodes").toPandas()
    except Exception as error:
        raise ValueError(f"model at {path} cannot be loaded") from error
    if meta is None or meta["model_version"] is None or nodes.empty:
        raise ValueError(f"model at {path} is incomplete")
    return Forest(
        nodes=nodes.sort_values(["tree", "node"], ignore_index=True),
        sample_size=meta["sample_size"], offset=meta["offset"], min_score=meta["min_score"],
        max_score=meta["max_score"], training_rows=meta["training_sample_size"],
        contamination=meta["contamination"], version=meta["model_version"],
        country_risk_tiers=dict(meta["country_risk_tiers"]),
        merchant_category_map=dict(meta["merchant_category_map"]),
    )
