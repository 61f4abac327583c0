"""Taking in a stream of message deliveries: readable messages, and dead letters of the others.

A message is delivered again until it is acknowledged. Its deliveries are counted in a stored table, so
the first one is told from repeats, and the one too many becomes a dead letter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from fraudloom.operators.events import dead_letters, decode_envelope
from fraudloom.schemas import GROUP_PROCESSOR, STREAM_TRANSACTIONS
from fraudloom.sources.sinks import ensure_table, write_batch
from fraudloom.streaming.dedup import per_batch

#: Deliveries of one message before it is given up (fixed value).
MAX_DELIVERIES = 5


def numbered_deliveries(
    batch: DataFrame, batch_id: int, path: str, key: str = "message_id",
) -> DataFrame:
    """Adds the number of each delivery of a micro-batch among all those of its message.

    What earlier batches counted is read from `path`, where the counts of this one are added; a
    repeated batch replaces its own. Messages without a key are told apart by nothing and count as
    delivered once. Counts stay, as a repeat may come at any time.
    """
    spark, kind = batch.sparkSession, StructType([batch.schema[key]]).add("n", "long")
    if batch_id == 0:
        ensure_table(spark, path, StructType([*kind.fields]).add("batch_id", "long"), "batch_id")
    keyed = batch.where(F.col(key).isNotNull())
    now = keyed.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    write_batch(now, path, batch_id)
    earlier = spark.read.schema(StructType([*kind.fields]).add("batch_id", "long")).parquet(path).where(
        F.col("batch_id") < batch_id).groupBy(key).agg(F.sum("n").alias("_seen"))
    order = Window.partitionBy(key).orderBy(F.lit(1))
    counted = keyed.withColumn("_here", F.row_number().over(order)).join(earlier, key, "left").select(
        *batch.columns, (F.coalesce("_seen", F.lit(0)) + F.col("_here")).cast("long").alias("delivery"))
    return counted.unionByName(batch.where(F.col(key).isNull()).withColumn("delivery", F.lit(1).cast("long")))


def consume_batch(
    deliveries: DataFrame, batch_id: int, path: str, key: str = "message_id",
    stream: str = STREAM_TRANSACTIONS, group: str = GROUP_PROCESSOR,
    max_deliveries: int = MAX_DELIVERIES,
) -> None:
    """Writes three tables of one micro-batch: `events`, `malformed` and `exhausted`.

    A message is read on its first delivery: an envelope is an event, anything else a dead letter at
    once. The delivery after `max_deliveries` makes a dead letter of any message, with its number as
    retry count. Deliveries between and after change nothing. A repeated batch replaces its files.
    """
    ok, bad = decode_envelope(deliveries.where("delivery = 1"), key)
    write_batch(ok, f"{path}/events", batch_id)
    write_batch(dead_letters(bad, stream, group), f"{path}/malformed", batch_id)
    over = deliveries.where(F.col("delivery") == max_deliveries + 1)
    readable, unreadable = decode_envelope(over, key)
    error = F.lit(f"Exceeded max deliveries ({max_deliveries + 1}/{max_deliveries})")
    given_up = dead_letters(
        unreadable.select(key, "body").unionByName(readable.select(key, F.col("payload").alias("body")))
        .withColumn("error", error), stream, group)
    types = readable.select(F.col(key).cast("string").alias("original_event_id"), F.col("event_type").alias("_type"))
    write_batch(given_up.join(types, "original_event_id", "left").withColumns({
        "event_type": F.coalesce("_type", "event_type"),
        "retry_count": F.lit(max_deliveries + 1)}).drop("_type"), f"{path}/exhausted", batch_id)


def stream_consume(
    raw: DataFrame, path: str, checkpoint: str, key: str = "message_id",
    max_deliveries: int = MAX_DELIVERIES,
) -> StreamingQuery:
    """Takes in everything that was delivered; see `consume_batch`."""
    def take(batch: DataFrame, batch_id: int) -> None:
        numbered = numbered_deliveries(batch, batch_id, f"{path}/deliveries", key).where(
            F.col("delivery").isin(1, max_deliveries + 1)).persist()
        try:
            consume_batch(numbered, batch_id, path, key, max_deliveries=max_deliveries)
        finally:
            numbered.unpersist()

    return per_batch(raw, checkpoint, take)
