"""Streaming forms: late rows, redelivery, restarts and timers."""

import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from fraudloom.config import DetectionConfig
from fraudloom.fixtures import seeded_rules
from fraudloom.registry.streams import tune
from fraudloom.session import shared_dir
from fraudloom.sources.streams import file_stream
from fraudloom.streaming.lifecycle import current_state, lifecycle_input, stream_lifecycle
from fraudloom.streaming.dedup import stream_dedup
from fraudloom.streaming.flows import stream_detect, write_files
from fraudloom.streaming.profiles import stream_compensation
from fraudloom.streaming.velocity import stream_velocity
from fraudloom.streaming.volume import current_volume, stream_volume_5m

START = datetime.datetime(2024, 1, 1)
TXN = ("transaction_id long, user_id long, amount decimal(14,2), currency string, country string,"
       " merchant_category string, created_at timestamp, idempotency_key string, metadata string,"
       " correlation_id string")


@pytest.fixture(autouse=True)
def tuned(spark):
    tune(spark)


def txns(spark, *rows):
    """(id, user, minutes after the start, amount)."""
    return spark.createDataFrame(
        [(i, u, Decimal(a), "USD", "US", "groceries", START + datetime.timedelta(minutes=m),
          f"k{i}", "{}", f"c{i}") for i, u, m, a in rows], TXN)


def feed(spark, build, *batches):
    """Runs the query after every batch, restarting it from its checkpoint."""
    path, out, check = (shared_dir(spark, "t") for _ in range(3))
    for batch in batches:
        batch.write.mode("append").parquet(path)
        write_files(build(file_stream(spark, path, batch.schema)), out, check).awaitTermination()
    return spark.read.parquet(out)


def test_dedup_over_restarts(spark):
    first = txns(spark, (1, 1, 0, 5), (2, 1, 1, 5), (2, 1, 1, 5))
    again = txns(spark, (2, 1, 2, 5), (3, 1, 3, 5))
    out = feed(spark, lambda s: stream_dedup(s, "transaction_id"), first, again)
    assert sorted(r["transaction_id"] for r in out.collect()) == [1, 2, 3]


def fold(spark, run, *batches):
    """Runs `run(stream, path, checkpoint)` after every batch; gives the path."""
    path, out, check = (shared_dir(spark, "t") for _ in range(3))
    for batch in batches:
        batch.write.mode("append").parquet(path)
        run(file_stream(spark, path, batch.schema), out, check).awaitTermination()
    return out


def test_dedup_keeps_rows_without_key_and_drops_late_repeats(spark):
    rows = txns(spark, (1, 1, 0, 5), (2, 1, 1, 5), (3, 1, 2, 5)).withColumn(
        "transaction_id", F.expr("nullif(transaction_id, 2)"))
    far = txns(spark, (4, 1, 100_000, 5))
    out = feed(spark, lambda s: stream_dedup(s, "transaction_id"), rows.unionByName(rows), far, rows)
    found = sorted((r["transaction_id"] or 0) for r in out.collect())
    assert found == [0, 0, 0, 1, 3, 4]


def test_velocity_sees_late_rows(spark):
    """A late row counts what is before it, and later rows count it."""
    out = fold(
        spark, stream_velocity,
        txns(spark, (1, 1, 1, 10), (2, 1, 8, 20), (3, 2, 8, 1)),
        txns(spark, (4, 1, 5, 40)), txns(spark, (5, 1, 12, 80), (6, 1, 11, 160), (4, 1, 5, 40)),
        txns(spark, (7, 1, 100_000, 1)), txns(spark, (8, 1, 9, 320)))
    rows = spark.read.parquet(f"{out}/velocity").collect()
    found = {r["transaction_id"]: (r["txn_count"], int(r["total_amount"])) for r in rows}
    assert len(rows) == 8 and found == {
        1: (1, 10), 2: (2, 30), 3: (1, 1), 4: (2, 50), 6: (4, 230), 5: (4, 300), 7: (1, 1), 8: (4, 390)}


def test_velocity_of_rows_without_user_or_time(spark):
    odd = txns(spark, (1, 1, 1, 10), (2, 1, 2, 20), (3, 1, 3, 40)).withColumn(
        "user_id", F.expr("if(transaction_id = 2, null, user_id)")).withColumn(
        "created_at", F.expr("if(transaction_id = 3, null, created_at)"))
    again = odd.withColumn("transaction_id", F.col("transaction_id") + 10)
    out = fold(spark, stream_velocity, odd, again)
    found = {r["transaction_id"]: r["txn_count"] for r in spark.read.parquet(f"{out}/velocity").collect()}
    assert found == {1: 1, 2: 1, 3: 1, 11: 2, 12: 2, 13: 2}


def test_volume_is_corrected_by_late_rows(spark):
    """A row that comes after its bucket was written corrects it; a repeat does not."""
    late = txns(spark, (5, 1, 1, 99), (6, 3, 90, 1), (1, 1, 1, 10))
    out = fold(
        spark, stream_volume_5m,
        txns(spark, (1, 1, 1, 10), (2, 2, 2, 20), (3, 1, 3, 5), (4, 1, 30, 1)), late,
        txns(spark, (7, 9, 2, 1)).withColumn("user_id", F.lit(None).cast("long")),
        txns(spark, (8, 9, 2, 7)).withColumn("created_at", F.lit(None).cast("timestamp")))
    rows = {r["bucket"]: tuple(r)[1:] for r in current_volume(spark, out).collect()}
    at = lambda m: START + datetime.timedelta(minutes=m)
    assert rows == {START: (5, Decimal("135.00"), 2), at(30): (1, Decimal("1.00"), 1),
                    at(90): (1, Decimal("1.00"), 1)}


def profile_events(spark, *rows):
    """(user, minute or None, kind, event id)."""
    return spark.createDataFrame(
        [(u, None if m is None else START + datetime.timedelta(minutes=m), k, i) for u, m, k, i in rows],
        "user_id long, ts timestamp, kind int, event_id long")


@pytest.mark.parametrize("cuts", [(5, 9), (1, 2), (3, 11)])
def test_profiles_do_not_depend_on_the_order_of_events(spark, cuts):
    import random

    pick = random.Random(sum(cuts))
    rows = [(pick.choice([1, 2]), pick.choice([1, 5, 9, 30, 200]), pick.choice([0, 0, 1]), i) for i in range(24)]
    pick.shuffle(rows)
    parts = [rows[:cuts[0]], rows[cuts[0]:cuts[1]], rows[cuts[1]:] + rows[:4]]
    out = feed(spark, stream_compensation, *[profile_events(spark, *p) for p in parts])
    found = {}
    for r in out.collect():
        known = found.get(r["user_id"], (0, 0, None))
        if r["total_alerts"] + r["false_positive_count"] > known[0] + known[1]:
            found[r["user_id"]] = (r["total_alerts"], r["false_positive_count"], float(r["risk_score"]))
    for user in {r[0] for r in rows}:
        total = fps = 0
        score = 0.0
        for _, _, kind, _ in sorted((r for r in rows if r[0] == user), key=lambda r: (r[1], r[2], r[3])):
            total, fps = total + (kind == 0), fps + kind
            if kind:
                score = min(1, 0.25 * max(0, total - fps))
        assert found[user] == (total, fps, score)


def test_lifecycle_timers_and_races(spark):
    """Alert 1 is left alone, 2 is resolved early, 3 between the tiers, 4 twice."""
    table = spark.createDataFrame(
        [(i, START) for i in (1, 2, 3, 4)], "id long, created_at timestamp")
    at = lambda m: START + datetime.timedelta(minutes=m)
    log = spark.createDataFrame(
        [(20, 2, "APPROVED", "a", at(3)), (30, 3, "BLOCKED", "b", at(9)),
         (40, 4, "FALSE_POSITIVE", "c", at(40)), (41, 4, "APPROVED", "d", at(41)),
         (90, 99, "APPROVED", "d", at(50)), (91, 1, "PENDING", "d", at(600))],
        "action_id long, alert_id long, target_status string, actor string, acted_at timestamp")
    events = lifecycle_input(table, log)
    cut = F.lit(at(10))
    out = feed(spark, stream_lifecycle, events.where(F.col("at") <= cut),
               events.where(F.col("at") > cut))
    state = {r["id"]: (r["status"], r["escalated_email_at"], r["escalated_slack_at"],
                       r["resolved_by"]) for r in current_state(out, table).collect()}
    assert state == {
        1: ("ESCALATED_SLACK", at(5), at(15), None), 2: ("APPROVED", None, None, "a"),
        3: ("BLOCKED", at(5), None, "b"), 4: ("FALSE_POSITIVE", at(5), at(15), "c")}


def test_detection_of_redelivered_transactions(spark):
    """Two deliveries of one transaction give one decision; velocity spans batches."""
    path, out, check = (shared_dir(spark, "d") for _ in range(3))
    profiles = spark.createDataFrame(
        [(1, Decimal("0.5"), 2, 0)],
        "user_id long, risk_score decimal(5,4), total_alerts int, false_positive_count int")
    batches = [
        txns(spark, (1, 1, 0, 10), (2, 1, 1, 10), (3, 1, 2, 10)),
        txns(spark, (3, 1, 2, 10), (4, 1, 3, 10), (5, 1, 4, 10), (6, 2, 4, 45000)),
    ]
    for batch in batches:
        batch.write.mode("append").parquet(path)
        stream_detect(
            file_stream(spark, path, batch.schema), lambda: profiles, lambda: seeded_rules(spark),
            out, check, cfg=DetectionConfig()).awaitTermination()
    rows = {r["transaction_id"]: r for r in spark.read.parquet(f"{out}/decisions").collect()}
    assert {i: r["txn_count"] for i, r in rows.items()} == {1: 1, 2: 2, 3: 3, 4: 4, 5: 5, 6: 1}
    assert rows[5]["rule_severity_score"] == Decimal("0.7500")
    assert spark.read.parquet(f"{out}/decisions").count() == 6
    alerts = spark.read.parquet(f"{out}/alerts").collect()
    assert [(a["transaction_id"], a["severity"]) for a in alerts] == [(6, "CRITICAL")]
    assert spark.read.parquet(f"{out}/processed_events").count() == 6
