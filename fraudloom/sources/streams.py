"""Streaming sources of event envelopes: folders of files, or Kafka topics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, types as T

from fraudloom.config import CONSUMER_BATCH_SIZE
from fraudloom.schemas import _struct

S = T.StringType()
MESSAGE = _struct(
    message_id=T.LongType(), event=S, envelope=S, data=S, flat=S, created_at=T.TimestampType(),
)


def file_stream(
    spark: SparkSession, path: str, schema: T.StructType, max_per_trigger: int | None = None,
    latest: bool = False,
) -> DataFrame:
    """Parquet files of a folder as a stream.

    `latest` takes the newest files of a backlog first. Where to begin after a restart is
    decided by the checkpoint of the query, not by the source.
    """
    reader = spark.readStream.schema(schema).option("latestFirst", str(latest).lower())
    if max_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_per_trigger)
    return reader.parquet(path)


def kafka_stream(
    spark: SparkSession, servers: str, topics: list[str], starting: str,
    max_per_trigger: int | None = None,
) -> DataFrame:
    """Kafka topics as messages with the body under `event` (needs the Kafka package)."""
    reader = (
        spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers)
        .option("subscribe", ",".join(topics)).option("startingOffsets", starting)
    )
    if max_per_trigger:
        reader = reader.option("maxOffsetsPerTrigger", max_per_trigger)
    return reader.load().selectExpr(
        "offset AS message_id", "CAST(value AS STRING) AS event", "topic AS stream",
        "timestamp AS created_at")


def transaction_stream(
    spark: SparkSession, path: str, max_per_trigger: int = CONSUMER_BATCH_SIZE,
    schema: T.StructType = MESSAGE, start: str = "latest",
) -> DataFrame:
    """New transaction messages, bounded per micro-batch."""
    return file_stream(spark, path, schema, max_per_trigger, latest=start == "latest")


def event_stream_from_start(
    spark: SparkSession, paths: list[str], max_per_trigger: int | None = None,
    schema: T.StructType = MESSAGE,
) -> DataFrame:
    """Several streams read from their beginning as one."""
    streams = [file_stream(spark, path, schema, max_per_trigger) for path in paths]
    result = streams[0]
    for other in streams[1:]:
        result = result.unionByName(other)
    return result
