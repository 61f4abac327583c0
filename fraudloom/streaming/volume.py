"""Transaction volume on a stream, corrected whenever a late row comes.

What each micro-batch adds to a (bucket, user) is stored under its day; the buckets that a batch
touches are put together again from these contributions, so no row is ever too late.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from fraudloom.functions.columns import bucket_start
from fraudloom.sources.sinks import read_history, write_batch, write_history
from fraudloom.streaming.dedup import per_batch, stream_dedup

RESULT = ["transaction_count", "total_amount", "active_users"]


def fold_volume(batch: DataFrame, batch_id: int, path: str, ts: str = "created_at") -> None:
    """Stores the contributions of one micro-batch and a new version of the buckets it touches.

    Only the days of these buckets are read, of which slim rows by bucket and user are kept. Rows
    without a time are in no bucket, as in the batch form; rows without a user count but are no
    active user.
    """
    spark = batch.sparkSession
    batch = batch.where(F.col(ts).isNotNull())
    write_history(batch.groupBy(bucket_start(ts).alias("bucket"), "user_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("amount").alias("amount")),
        f"{path}/contributions", batch_id, "bucket")
    touched = batch.select(bucket_start(ts).alias("touched")).distinct()
    days = [row[0] for row in touched.select(F.to_date("touched")).distinct().collect()]
    if not days:
        return
    stored = read_history(spark, f"{path}/contributions", days, batch_id + 1)
    volume = stored.join(touched, F.col("bucket") == F.col("touched"), "left_semi").groupBy(
        "bucket", "user_id").agg(F.sum("n").alias("n"), F.sum("amount").alias("amount")).groupBy(
        "bucket").agg(
        F.sum("n").alias("transaction_count"),
        F.sum("amount").cast("decimal(24,2)").alias("total_amount"),
        F.count("user_id").alias("active_users"))
    write_batch(volume, f"{path}/volume", batch_id)


def stream_volume_5m(
    txns: DataFrame, path: str, checkpoint: str, key: str | None = "transaction_id",
    ts: str = "created_at",
) -> StreamingQuery:
    """Volume per 5-minute bucket of every transaction once, in whatever order they come.

    `key` tells deliveries of one transaction; None takes every row as a new one. Read the result
    with `current_volume`. A batch that is repeated after a failure replaces what it wrote before.
    """
    return per_batch(stream_dedup(txns, key, ts) if key else txns, checkpoint,
                     lambda batch, batch_id: fold_volume(batch, batch_id, path, ts))


def current_volume(spark: SparkSession, path: str) -> DataFrame:
    """The newest version of every bucket."""
    versions = spark.read.parquet(f"{path}/volume").groupBy("bucket").agg(
        F.max_by(F.struct(*RESULT), "batch_id").alias("newest"))
    return versions.select("bucket", "newest.*")
