"""Table scans, weekly layout and the guarded seed load."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from fraudloom.functions.columns import micros
from fraudloom.operators.merge import upsert_table
from fraudloom.plans.slices import MINUTE_US, whole_slices
from fraudloom.schemas import TABLES

WEEK_US = 7 * 24 * 60 * MINUTE_US


def scan(spark: SparkSession, path: str, name: str) -> DataFrame:
    """Typed scan of one of the surveillance tables stored under `path`."""
    if name not in TABLES:
        raise ValueError(f"unknown table {name}")
    return spark.read.schema(TABLES[name]).parquet(f"{path.rstrip('/')}/{name}")


def with_week(txns: DataFrame, ts: str = "created_at") -> DataFrame:
    """Adds the first day of the 7-day chunk (counted from the epoch)."""
    start = F.timestamp_micros(whole_slices(micros(ts), WEEK_US) * F.lit(WEEK_US))
    return txns.withColumn("week", F.to_date(start))


def write_weekly(txns: DataFrame, path: str, ts: str = "created_at") -> None:
    """Stores transactions in weekly partitions.

    The rebalance hint lets adaptive execution split a week that holds most rows and merge
    small ones, so files come out even without naming a number of partitions.
    """
    (
        with_week(txns, ts).hint("rebalance", "week")
        .write.mode("overwrite").partitionBy("week").parquet(path)
    )


def read_weekly(
    spark: SparkSession, path: str, start: str | None = None, end: str | None = None,
    ts: str = "created_at",
) -> DataFrame:
    """Rows with start <= time < end; only the weeks that can hold them are listed."""
    df = spark.read.parquet(path)
    if start is not None:
        low = F.lit(start).cast("timestamp_ntz")
        df = df.where(F.col("week") > F.date_sub(F.lit(start).cast("date"), 7)).where(
            F.col(ts) >= low)
    if end is not None:
        df = df.where(F.col("week") <= F.lit(end).cast("date")).where(
            F.col(ts) < F.lit(end).cast("timestamp_ntz"))
    return df


def idempotent_seed_load(
    spark: SparkSession, path: str, tables: dict[str, DataFrame],
    keys: dict[str, list[str]], updates: dict[str, list[str]] | None = None,
    force: bool = False, run_id: str = "seed",
) -> str:
    """Loads seed tables unless an earlier run left its marker; returns the new version path.

    Each run writes a new version folder and a marker row naming it, so nothing is read and
    overwritten in one job.
    """
    updates = updates or {}
    runs = f"{path}/seed_runs"
    known = _runs(spark, runs)
    last = known.orderBy(F.col("run_no").desc()).first() if known is not None else None
    if last is not None and not force:
        return last["version"]
    number = 1 if last is None else last["run_no"] + 1
    version = f"{path}/v{number}"
    for name, seed in tables.items():
        merged = seed
        if last is not None:
            base = spark.read.parquet(f"{last['version']}/{name}")
            merged = upsert_table(base, seed, keys[name], updates.get(name))
        merged.write.mode("overwrite").parquet(f"{version}/{name}")
    marker = spark.createDataFrame(
        [(number, run_id, version)], "run_no int, run_id string, version string")
    marker.write.mode("append").parquet(runs)
    return version


def _runs(spark: SparkSession, path: str) -> DataFrame | None:
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema("run_no int, run_id string, version string").parquet(path)
    except AnalysisException:
        return None
