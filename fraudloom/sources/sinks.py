"""Sinks: relayed streams, dead letters and the tables written per micro-batch."""

from __future__ import annotations

import datetime

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import DataType, StructType

from fraudloom.operators.events import encode_envelope, route_events

#: Folders by key hash in the inbox; a small batch reads only those of its keys.
INBOX_BUCKETS = 16
#: The folder name that Spark gives to NULL.
NO_DAY = "__HIVE_DEFAULT_PARTITION__"


def write_streams(pending: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Publishes pending outbox rows as envelopes into one folder per stream."""
    published = encode_envelope(route_events(pending)).withColumn("status", F.lit("PUBLISHED"))
    (
        published.select("id", "event_type", "created_at", "status", "envelope", "stream")
        .hint("rebalance", "stream")
        .write.mode(mode).partitionBy("stream").parquet(path)
    )


def write_batch(df: DataFrame, path: str, batch_id: int) -> None:
    """Writes one micro-batch into its own folder; a replayed batch replaces it."""
    df.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


def read_batch(like: DataFrame, path: str, batch_id: int) -> DataFrame:
    """Reads one micro-batch back with the schema it was written with."""
    return like.sparkSession.read.schema(like.schema).parquet(f"{path}/batch_id={batch_id}")


def write_history(df: DataFrame, path: str, batch_id: int, ts: str = "created_at") -> None:
    """Appends rows under day and batch folders; a replayed batch replaces its own folders."""
    (
        df.withColumns({"day": F.to_date(ts), "batch_id": F.lit(batch_id)})
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy("day", "batch_id").parquet(path)
    )


def read_history(
    spark: SparkSession, path: str, days: list[datetime.date | None], batch_id: int,
) -> DataFrame | None:
    """Rows of the given days from batches before `batch_id`; None when these have no folder.

    The day None holds rows without a time. Only the folders of these days are listed, however long the history is.
    """
    if not days:
        return None
    listed = ",".join(sorted(NO_DAY if day is None else str(day) for day in days))
    try:
        history = spark.read.option("basePath", path).parquet(f"{path}/day={{{listed}}}")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return history.where(F.col("batch_id") < batch_id).drop("day", "batch_id")


def ensure_table(spark: SparkSession, path: str, schema: StructType, *partitions: str) -> None:
    """Creates the folder of an empty table, so that reading it never has to guess."""
    spark.createDataFrame([], schema).write.mode("append").partitionBy(*partitions).parquet(path)


def inbox_schema(ident: DataType) -> StructType:
    return (
        StructType().add("submission_key", "string").add("transaction_id", ident)
        .add("bucket", "integer").add("batch_id", "long")
    )


def inbox_rows(df: DataFrame) -> DataFrame:
    """Submissions with the bucket of the inbox their key belongs to."""
    bucket = F.pmod(F.xxhash64("submission_key"), F.lit(INBOX_BUCKETS)).cast("int")
    return df.withColumn("bucket", bucket)


def write_inbox(decided: DataFrame, path: str, batch_id: int) -> None:
    """Records decided submissions by key; a replayed batch replaces its own folders."""
    (
        inbox_rows(decided.select("submission_key", "transaction_id"))
        .withColumn("batch_id", F.lit(batch_id).cast("bigint"))
        .hint("rebalance", "bucket").write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("bucket", "batch_id").parquet(path)
    )


def read_inbox(batch: DataFrame, path: str, batch_id: int) -> DataFrame:
    """Keys decided in earlier batches, from the buckets that occur in `batch` only."""
    buckets = [row[0] for row in inbox_rows(batch).where("bucket IS NOT NULL")
               .select("bucket").distinct().collect()]
    schema = inbox_schema(batch.schema["transaction_id"].dataType)
    inbox = batch.sparkSession.read.schema(schema).parquet(path)
    return inbox.where(F.col("bucket").isin(buckets) & (F.col("batch_id") < batch_id)).drop(
        "bucket", "batch_id")
