"""Every event once, by keyed state, and running a function over each micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery


def stream_dedup(events: DataFrame, key: str | list[str] = "event_id", ts: str | None = None) -> DataFrame:
    """Every event once, however late and however often it is delivered.

    Keys stay in the state store, one row each, and are looked up there: the work of a batch follows
    the batch and not what came before it. Rows without a key (any part of it NULL) are no repeats
    of each other and all pass. Of repeats in one batch any is taken; `ts` is not looked at.
    """
    keys = [key] if isinstance(key, str) else key
    known = F.lit(True)
    for name in keys:
        known &= F.col(name).isNotNull()
    return events.where(known).dropDuplicates(keys).unionByName(events.where(~known))


def per_batch(
    source: DataFrame, checkpoint: str, work: Callable[[DataFrame, int], None],
) -> StreamingQuery:
    """Runs `work` over every micro-batch that has rows; what has arrived is taken in and it ends."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            if not batch.isEmpty():
                work(batch, batch_id)
        finally:
            batch.unpersist()

    return (source.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())
