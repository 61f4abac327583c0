"""Trailing velocity on a stream, over stored history and not over a watermark.

Each micro-batch is counted by the batch form over its own rows and the stored rows that its windows
reach, so a row may come as late as it likes: it counts what is before it, and rows after it count it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from fraudloom.operators.features import velocity_trailing
from fraudloom.sources.sinks import read_history, write_batch, write_history
from fraudloom.streaming.dedup import per_batch, stream_dedup


def reach_of_batch(batch: DataFrame, minutes: int) -> tuple[list, Column]:
    """The days that windows of the batch touch and, of each, the stretch of time they need."""
    at = F.col("created_at").cast("timestamp_ntz")
    opens = at - F.expr(f"INTERVAL {minutes} MINUTE")
    spans = batch.select(opens.alias("low"), at.alias("high"), F.explode_outer(
        F.sequence(F.to_date(opens), F.to_date(at))).alias("day")).groupBy("day").agg(
        F.min("low").alias("low"), F.max("high").alias("high")).collect()
    needed, own = F.lit(False), F.col("created_at").cast("timestamp_ntz")
    for span in spans:
        if span["day"] is None:
            needed |= F.col("created_at").isNull()
        else:
            needed |= (F.to_date(own) == F.lit(span["day"])) & own.between(
                F.lit(span["low"]).cast("timestamp_ntz"), F.lit(span["high"]).cast("timestamp_ntz"))
    return [span["day"] for span in spans], needed


def velocity_of_batch(
    batch: DataFrame, history: str, batch_id: int, minutes: int, rows: DataFrame | None = None,
) -> DataFrame:
    """Velocity of one micro-batch against the stored transactions before it.

    Each row counts every transaction seen so far in its window, also one that came late. The
    work is the batch form over the batch and the stretches of history that its windows reach. Where
    `batch` is costly to compute, `rows` are stored rows that hold it and tell that reach.
    """
    days, needed = reach_of_batch(batch if rows is None else rows, minutes)
    marked = batch.withColumn("_new", F.lit(True))
    past = read_history(batch.sparkSession, history, days, batch_id)
    if past is not None:
        marked = marked.unionByName(past.where(needed), allowMissingColumns=True)
    return velocity_trailing(marked, minutes).where("_new").drop("_new")


def stream_velocity(
    txns: DataFrame, path: str, checkpoint: str, minutes: int = 10,
    key: str | None = "transaction_id",
) -> StreamingQuery:
    """Writes count and sum of the trailing window of every transaction to `path`/velocity.

    Every transaction comes out once, with what had arrived when it did; `key` tells repeats, None
    takes every row as a new one. Rows without user or time count as in `velocity_trailing`.
    """
    def count(batch: DataFrame, batch_id: int) -> None:
        history = f"{path}/history"
        write_batch(velocity_of_batch(batch, history, batch_id, minutes), f"{path}/velocity", batch_id)
        write_history(batch.select("user_id", "created_at", "amount"), history, batch_id)

    return per_batch(stream_dedup(txns, key) if key else txns, checkpoint, count)
