"""Claims of an outbox and dead letters on a stream of deliveries."""

import datetime
import json

from pyspark.sql import functions as F

from fraudloom.registry.streams import tune
from fraudloom.session import shared_dir
from fraudloom.sources.relay import outbox_status, pending_rows, published, relay_claim
from fraudloom.sources.streams import file_stream
from fraudloom.streaming.consume import consume_batch, stream_consume

START = datetime.datetime(2024, 1, 1)
OUTBOX = ("id long, correlation_id string, event_type string, event_version string, payload string,"
          " producer_service string, status string, created_at timestamp_ntz")


def outbox(spark, ids, status="PENDING"):
    return spark.createDataFrame(
        [(i, "c", "alert.created", "1.0", "{}", "p", status, START + datetime.timedelta(minutes=-(i or 0)))
         for i in ids], OUTBOX)


def sent(rows, path):
    return sorted(r["id"] for r in published(rows, path).collect())


def test_claims_of_two_slots_are_disjoint_and_whole(spark):
    path, rows = shared_dir(spark, "t"), outbox(spark, range(40)).unionByName(outbox(spark, [99], "DEAD_LETTERED"))
    counts = [relay_claim(rows, path, slot, 2) for slot in (0, 1, 0, 1)]
    assert counts[0] + counts[1] == 40 and min(counts[:2]) > 0 and counts[2:] == [0, 0]
    assert sent(rows, path) == list(range(40)) and pending_rows(rows, path).isEmpty()
    by_status = {r["id"]: r["status"] for r in outbox_status(rows, path).collect()}
    assert by_status.pop(99) == "DEAD_LETTERED" and set(by_status.values()) == {"PUBLISHED"}


def test_unfinished_claim_is_replaced(spark):
    path, rows = shared_dir(spark, "t"), outbox(spark, range(10))
    assert relay_claim(rows, path, limit=4, commit=False) == 4
    assert pending_rows(rows, path).count() == 10
    assert relay_claim(rows, path, limit=3) == 3
    assert sent(rows, path) == [7, 8, 9]  # the oldest; nothing of the unfinished claim is left
    assert relay_claim(rows, path) == 7 and sent(rows, path) == list(range(10))


def test_rows_without_id_stay_pending(spark):
    path, rows = shared_dir(spark, "t"), outbox(spark, [1, None])
    assert relay_claim(rows, path) == 1 and pending_rows(rows, path).count() == 1
    assert relay_claim(outbox(spark, []), shared_dir(spark, "t")) == 0


def test_dead_claimer_of_a_slot_that_is_given_up(spark):
    path, rows = shared_dir(spark, "t"), outbox(spark, range(30))
    assert relay_claim(rows, path, 1, 2, commit=False) > 0 and sent(rows, path) == []
    assert relay_claim(rows, path) == 30 and sent(rows, path) == list(range(30))


def body(i):
    return json.dumps({"event_id": f"e{i}", "event_type": "transaction.created", "producer_service": "g",
                       "payload": {"n": i}})


def messages(spark, *ids):
    return spark.createDataFrame(
        [(i, None if i is None or i % 2 == 0 else "broken", body(i) if i is None or i % 2 == 0 else None)
         for i in ids], "message_id long, event string, flat string")


def counts(spark, out):
    return tuple(spark.read.parquet(f"{out}/{kind}").count() for kind in ("events", "malformed", "exhausted"))


def test_deliveries_over_batches(spark):
    tune(spark)
    path, out, check = (shared_dir(spark, "t") for _ in range(3))
    batches = [messages(spark, 2, 2, 2, 3, None), messages(spark, 2, 2, 3, 4, None),
               messages(spark, 2, 3, 3, 3), messages(spark, 2, 3, 3, 3, 5)]
    for batch in batches:
        batch.write.mode("append").parquet(path)
        stream_consume(file_stream(spark, path, batch.schema), out, check).awaitTermination()
    assert counts(spark, out) == (4, 2, 2)
    dead = {r["original_event_id"]: r for r in spark.read.parquet(f"{out}/exhausted").collect()}
    assert dead["2"]["event_type"] == "transaction.created" and dead["2"]["retry_count"] == 6
    assert dead["3"]["event_type"] == "unknown.transaction" and dead["3"]["payload"] == "broken"


def test_repeated_batch_replaces_its_files(spark):
    out = shared_dir(spark, "t")
    rows = messages(spark, 2, 3, 7).withColumn("delivery", F.when(F.col("message_id") == 7, 6).otherwise(1))
    for _ in range(2):
        consume_batch(rows, 0, out)
        assert counts(spark, out) == (1, 1, 1)
