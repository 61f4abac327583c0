"""Training-data pipeline: toxicity, line dedup, near-dedup, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and works on all documents that its predecessor kept; its
result is written as Parquet in the shared folder and read again as the next one's documents. All
but the last return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from fraudloom.llm import (
    line_windows, packing, repeated_runs, simhash, spaced_seeds, toxicity,
)
from fraudloom.llm.common import id_hash_mod, read, written
from fraudloom.llm.queries import CAPACITY, PACK_END, PACK_TOKENIZER, tokenizer_path


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the toxicity threshold of their language. NULL and empty texts stay, and so do
    all columns, those named `score` or `toxic` too."""
    model = toxicity.fit(docs, read(spark, sf_dir, "labels"), train_rows=id_hash_mod("doc_id", 4) != 2)
    at = {c: f"__{i}" for i, c in enumerate(docs.columns)}
    kept = toxicity.score_texts(docs.toDF(*at.values()), model, list(at.values()), at["text"], at["lang"])
    return kept.filter(~F.col("toxic")).select(*at.values()).toDF(*docs.columns)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the later occurrences of passages of lines, and then of runs of 50 words
    wherever lines end; `n_chars` follows the text."""
    out = repeated_runs.remove_repeated_runs(written(
        line_windows.remove_repeated_lines(docs, chains=True), "pipeline-lines"))
    if "n_chars" not in docs.columns:
        return out
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, the one with the smallest id (NULL first), of equal
    ids the one whose text has the smaller hash.

    Groups link SimHash fingerprints of three-word shingles that differ in at most three bits; NULL
    and empty texts have fingerprint zero. Rows equal in id and text are one document and come out
    once, with the other columns of the one whose hash is smallest.
    """
    own = F.struct("doc_id", F.xxhash64("text").alias("key"))
    classes = simhash.near_duplicates(docs.select(own.alias("__own"), "text"), "__own", words=3, limit=3)
    firsts = classes.filter(F.col("__own") == F.col("component_id")).groupBy("__own").agg(
        F.count(F.lit(1)).alias("__copies")).select(
        F.col("__own.doc_id").alias("__doc"), F.col("__own.key").alias("__text_key"), "__copies")
    kept = docs.withColumn("__key", F.xxhash64("text")).join(
        firsts, (F.col("__key") == F.col("__text_key")) & F.col("doc_id").eqNullSafe(F.col("__doc")))
    single = kept.filter(F.col("__copies") == 1).select(*docs.columns)
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    several = kept.filter(F.col("__copies") > 1).select(*docs.columns)
    if not rest:
        return single.unionAll(several.distinct())
    merged = several.groupBy("doc_id", "text").agg(F.min_by(
        F.struct(*rest), F.xxhash64(*rest)).alias("__rest"))
    return single.unionAll(merged.select("doc_id", "text", "__rest.*").select(*docs.columns))


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no stretch of a benchmark item."""
    keyed = docs.withColumn("__row", F.xxhash64("doc_id", "text"))
    leaks = spaced_seeds.contaminated(keyed, read(spark, sf_dir, "benchmark"), "__row")
    return keyed.join(leaks.select("__row").distinct(), "__row", "left_anti").select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of token ids."""
    return packing.pack_documents(docs, tokenizer_path(PACK_TOKENIZER), PACK_END, capacity=CAPACITY)


STAGES = [
    ("toxicity", without_toxic),
    ("line_dedup", without_repeated_lines),
    ("near_dedup", without_near_duplicates),
    ("decontamination", without_benchmark),
    ("packing", packed),
]

#: Scores, fingerprints and token ids have no SQL form; tests check the stages by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
