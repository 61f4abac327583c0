"""Relaying an outbox from several claimers, each event once.

Every claimer owns a slot: a share of the ids by hash. A claim takes the oldest pending rows of its
slot, publishes them under its own number and then records them as published, which is its commit.
Claims of different slots never meet, so no claimer waits for another. A claim that died before its
commit is made again under the same number and replaces what it had published.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructType

from fraudloom.operators.events import encode_envelope, route_events
from fraudloom.sources.sinks import ensure_table

PUBLISHED = "PUBLISHED"


def _table(outbox: DataFrame, path: str, name: str, schema: StructType) -> DataFrame:
    """A table by slot and claim; an empty one where nothing has been written."""
    full = schema.add("slot", "integer").add("claim", "long")
    ensure_table(outbox.sparkSession, f"{path}/{name}", full, "slot", "claim")
    return outbox.sparkSession.read.schema(full).parquet(f"{path}/{name}")


def _committed(outbox: DataFrame, path: str) -> DataFrame:
    ident = outbox.schema["id"].dataType
    return _table(outbox, path, "status", StructType().add("id", ident).add("status", "string"))


def pending_rows(outbox: DataFrame, path: str) -> DataFrame:
    """Pending rows that no committed claim has published."""
    done = _committed(outbox, path).select("id")
    return outbox.where(F.col("status") == "PENDING").join(done, "id", "left_anti")


def slot_of(ident: str, slots: int) -> Column:
    return F.pmod(F.xxhash64(ident), F.lit(slots)).cast("int")


def relay_claim(
    outbox: DataFrame, path: str, slot: int = 0, slots: int = 1, limit: int | None = None,
    commit: bool = True,
) -> int:
    """Publishes one claim of a slot and gives its number of events.

    `limit` bounds a claim to the oldest rows, as a polling worker would; None takes all. A slot has
    one claimer at a time; `slots` may change between claims, as published ids are looked up in all
    slots. Ids are unique in an outbox; a row without id can not be recorded and is left pending.
    `commit=False` leaves a claim unfinished, as a claimer that dies does.
    """
    known = _committed(outbox, path)
    number = (known.where(F.col("slot") == slot).agg(F.max("claim")).first()[0] or 0) + 1
    taken = pending_rows(outbox, path).where(F.col("id").isNotNull() & (slot_of("id", slots) == slot))
    if limit is not None:
        taken = taken.orderBy("created_at", "id").limit(limit)
    envelopes = _envelopes(taken)
    own = f"slot={slot}/claim={number}"
    envelopes.hint("rebalance", "stream").write.mode("overwrite").parquet(f"{path}/streams/{own}")
    # What was published is read back: the record can not name other rows than those written.
    written = outbox.sparkSession.read.schema(envelopes.schema).parquet(f"{path}/streams/{own}")
    count = written.count()
    if commit and count:
        written.select("id", F.lit(PUBLISHED).alias("status")).write.mode("overwrite").parquet(
            f"{path}/status/{own}")
    return count


def _envelopes(rows: DataFrame) -> DataFrame:
    return encode_envelope(route_events(rows)).select(
        "id", "event_type", "created_at", "envelope", "stream")


def published(outbox: DataFrame, path: str) -> DataFrame:
    """Envelopes of committed claims; what an unfinished claim has written is not seen."""
    done = _committed(outbox, path).select("slot", "claim").distinct()
    return _table(outbox, path, "streams", _envelopes(outbox).schema).join(done, ["slot", "claim"])


def outbox_status(outbox: DataFrame, path: str) -> DataFrame:
    """The outbox with the status that committed claims give its rows."""
    done = _committed(outbox, path).select("id", F.col("status").alias("_now"))
    return outbox.join(done, "id", "left").withColumn("status", F.coalesce("_now", "status")).drop("_now")
