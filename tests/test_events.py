"""Envelopes, routing, retries, notifications, views and metrics on small rows."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from fraudloom.operators import events, merge, metrics, quality, views
from fraudloom.session import shared_dir
from fraudloom.sources import sinks, tables

NOW = datetime.datetime(2024, 1, 1, 12)


@pytest.mark.parametrize("event_type,stream", [
    ("transaction.created", "stream:transactions"), ("alert.approved", "stream:alerts"),
    ("escalation.email.requested", "stream:escalations"),
    ("risk_profile.recalculate", "stream:compensation"), ("custom.event", "stream:custom"),
    ("plain", "stream:plain"),
])
def test_routes(spark, event_type, stream):
    df = spark.createDataFrame([(event_type,)], "event_type string")
    assert events.route_events(df).first()["stream"] == stream


GOOD = {"event_id": "e", "event_type": "t", "producer_service": "p", "payload": {"a": [1]}}


@pytest.mark.parametrize("body,error", [
    (json.dumps(GOOD), None),
    (json.dumps({**GOOD, "event_version": "2.0"}), None),
    (json.dumps({**GOOD, "more": 1}), "unknown field"),
    (json.dumps({"event_id": "e"}), "missing field"),
    (json.dumps(GOOD) + json.dumps(GOOD), "not a JSON object"),
    (json.dumps(GOOD) + ",1", "not a JSON object"),
    (json.dumps(GOOD)[:-1], "not a JSON object"),
    ("[1]", "not a JSON object"), ("", "not a JSON object"), (None, "not a JSON object"),
])
def test_envelopes(spark, body, error):
    raw = spark.createDataFrame([(1, None, body, None)],
                                "message_id long, event string, envelope string, data string")
    ok, bad = events.decode_envelope(raw)
    if error:
        assert [r["error"] for r in bad.collect()] == [error] and ok.count() == 0
    else:
        row = ok.first()
        assert json.loads(row["payload"]) == {"a": [1]} and bad.count() == 0
        assert row["event_version"] in ("1.0", "2.0")


def test_envelope_round_trip(spark):
    outbox = spark.createDataFrame(
        [(1, "alert.created", "1.0", '{"x":"a\\"b"}', "c", "gateway", NOW),
         (2, "alert.created", "1.0", "[1,2]", "c", "gateway", NOW)],
        "id long, event_type string, event_version string, payload string, correlation_id string,"
        " producer_service string, created_at timestamp_ntz")
    encoded = events.encode_envelope(outbox).select(
        F.col("id").alias("message_id"), F.col("envelope").alias("event"))
    ok, bad = events.decode_envelope(encoded)
    assert bad.count() == 0
    assert {r["message_id"]: json.loads(r["payload"]) for r in ok.collect()} == {
        1: {"x": 'a"b'}, 2: {"data": [1, 2]}}


def test_missing_user_is_malformed(spark):
    df = spark.createDataFrame([(1, '{"user_id":"7"}'), (2, "{}")], "message_id long, payload string")
    good, bad = events.malformed_compensation(df)
    assert [r["message_id"] for r in good.collect()] == [1]
    dead = events.dead_letters(bad, "stream:compensation", "processor-compensation-group").first()
    assert (dead["error_message"], dead["event_type"]) == ("missing user_id", "unknown.compensation")


def test_retries(spark):
    rows = [(1, n, "alert.created", n == 3, NOW) for n in (1, 2, 3)]
    rows += [(2, n, "alert.created", False, NOW) for n in range(1, 8)]
    rows += [(3, n, "alert.created", False, NOW) for n in range(1, 10)]
    log = spark.createDataFrame(rows, "event_id long, attempt_no int, event_type string,"
                                " succeeded boolean, attempted_at timestamp_ntz")
    status, dead = events.retry_or_dead_letter(log)
    assert {r["event_id"]: (r["status"], r["retry_count"]) for r in status.collect()} == {
        1: ("PUBLISHED", 2), 2: ("PENDING", 7), 3: ("DEAD_LETTERED", 8)}
    assert [r["stream_name"] for r in dead.collect()] == ["stream:alerts"]


@pytest.mark.parametrize("event_type,payload,expected", [
    ("alert.approved", {"alert_id": "alt_123", "target_status": "BLOCKED"},
     {"type": "alert.updated", "alert": {"id": "alt_123", "status": "BLOCKED"}}),
    ("alert.false_positive", {"id": "9"},
     {"type": "alert.updated", "alert": {"id": "9", "status": "FALSE_POSITIVE"}}),
    ("alert.created", {"alert_id": "1", "severity": "HIGH"},
     {"type": "alert.created", "alert": {"id": "1", "severity": "HIGH", "status": "PENDING"}}),
    ("escalation.slack.requested", {"alert_id": "1"},
     {"type": "escalation", "alert_id": "1", "escalation_level": "slack"}),
    ("custom.event", {"a": 1}, {"type": "custom.event", "payload": {"a": 1}}),
])
def test_notifications(spark, event_type, payload, expected):
    df = spark.createDataFrame([(event_type, json.dumps(payload), NOW)],
                               "event_type string, payload string, created_at timestamp_ntz")
    message = json.loads(events.notification_messages(df).first()["message"])
    for key, value in expected.items():
        if isinstance(value, dict):
            assert value.items() <= message[key].items()
        else:
            assert message[key] == value


def test_stalled(spark):
    sent = spark.createDataFrame(
        [("s", "g", i, NOW - datetime.timedelta(seconds=age)) for i, age in
         [(1, 31), (2, 29), (3, 90), (3, 10), (4, 99), (5, 30)]],
        "stream string, consumer_group string, message_id long, delivered_at timestamp_ntz")
    acks = spark.createDataFrame([("s", "g", 4)],
                                 "stream string, consumer_group string, message_id long")
    found = events.stalled_messages(sent, acks, F.lit(NOW).cast("timestamp_ntz"))
    assert sorted(r["message_id"] for r in found.collect()) == [1, 5]


def dashboard(spark, *rows):
    return spark.createDataFrame(
        [(i, s, v, NOW - datetime.timedelta(minutes=m)) for i, (s, v, m) in enumerate(rows)],
        "id long, status string, severity string, created_at timestamp_ntz")


def test_stat_cards(spark):
    cards = metrics.alert_stat_cards(dashboard(
        spark, ("PENDING", "CRITICAL", 1), ("FALSE_POSITIVE", "CRITICAL", 2), ("APPROVED", "LOW", 3)))
    row = cards.first()
    assert tuple(row)[:4] == (1, 1, 2, 1) and str(row["false_positive_rate"]) == "50.0"
    empty = metrics.alert_stat_cards(dashboard(spark, ("PENDING", "LOW", 1)).where("false"))
    assert str(empty.first()["false_positive_rate"]) == "0.0"


def test_trend_buckets(spark):
    table = dashboard(spark, ("PENDING", "LOW", 5), ("PENDING", "LOW", 7), ("PENDING", "LOW", 124))
    now = F.lit(NOW).cast("timestamp_ntz")
    half_open = {r["bucket_end"]: r["alerts"] for r in metrics.alerts_per_bucket(table, now).collect()}
    both = {r["bucket_end"]: r["alerts"]
            for r in metrics.alerts_per_bucket(table, now, closed="both").collect()}
    assert len(half_open) == 25
    five_ago = NOW - datetime.timedelta(minutes=5)
    assert (half_open[NOW], half_open[five_ago]) == (1, 1)
    assert (both[NOW], both[five_ago]) == (1, 2)
    assert half_open[NOW - datetime.timedelta(minutes=120)] == 1


def test_pages(spark):
    table = dashboard(spark, *[("PENDING", "LOW", i) for i in range(7)])
    assert [r["id"] for r in views.page_alerts(table, 2, 3).collect()] == [3, 4, 5]
    assert views.page_alerts(table, 9, 3).count() == 0
    window = views.page_window(views.count_alerts(table), 9, 3).first()
    assert tuple(window) == (7, 3, 3, 7, 7)
    nothing = views.page_window(views.count_alerts(table.where("false")), 1, 3).first()
    assert tuple(nothing) == (0, 1, 1, 0, 0)
    with pytest.raises(ValueError):
        views.page_alerts(table, 1, 501)



def test_validation(spark):
    rows = [("5", "usd", "gb", "x", "7", None), ("0", "US1", "USA", "", None, "k" * 256),
            ("1", None, "GB", "m" * 128, "7", "k"), ("NaN", " us", "G1", "x", "a", "k")]
    raw = spark.createDataFrame(rows, "amount string, currency string, country string,"
                                " merchant_category string, user_id string, idempotency_key string")
    good, bad = quality.validate_transactions(raw, "^[0-9]+$")
    assert good.count() == 2
    assert [r["errors"] for r in bad.collect()] == [
        ["amount", "currency", "country", "merchant_category", "user_id", "idempotency_key"],
        ["amount", "currency", "country", "user_id"]]


def test_upsert_modes(spark):
    base = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "id long, name string, n int")
    delta = spark.createDataFrame([(2, "c", None), (3, "d", 4)], "id long, name string, n int")
    keep = {tuple(r) for r in merge.upsert_table(base, delta, ["id"]).collect()}
    assert keep == {(1, "a", 1), (2, "b", 2), (3, "d", 4)}
    update = {tuple(r) for r in merge.upsert_table(base, delta, ["id"], ["name", "n"]).collect()}
    assert update == {(1, "a", 1), (2, "c", None), (3, "d", 4)}


def test_seed_load_is_guarded(spark):
    path = shared_dir(spark, "seed")
    first = spark.createDataFrame([(1, "a")], "id long, name string")
    second = spark.createDataFrame([(1, "z"), (2, "b")], "id long, name string")
    load = lambda df, **o: tables.idempotent_seed_load(
        spark, path, {"users": df}, {"users": ["id"]}, **o)
    assert load(first) == load(second)
    version = load(second, force=True)
    assert {tuple(r) for r in spark.read.parquet(f"{version}/users").collect()} == {(1, "a"), (2, "b")}


def test_weekly_layout_prunes(spark):
    path = shared_dir(spark, "weeks")
    rows = [(i, NOW + datetime.timedelta(days=i)) for i in range(40)]
    tables.write_weekly(spark.createDataFrame(rows, "id long, created_at timestamp_ntz"), path)
    df = tables.read_weekly(spark, path, "2024-01-10 12:00:00", "2024-01-12")
    assert sorted(
        r["id"] for r in df.collect()) == [9, 10]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(week" in plan


def test_batches_replace_themselves(spark):
    path = shared_dir(spark, "batches")
    df = spark.range(5)
    for _ in range(2):
        sinks.write_batch(df, path, 3)
    assert sinks.read_batch(df, path, 3).count() == 5
    rows = df.select("id", F.lit(NOW).cast("timestamp_ntz").alias("created_at"))
    for _ in range(2):
        sinks.write_history(rows, path + "-h", 1)
    today = NOW.date()
    assert sinks.read_history(spark, path + "-h", [today], 2).count() == 5
    assert sinks.read_history(spark, path + "-h", [today], 1).count() == 0
    later = today + datetime.timedelta(days=9)
    assert sinks.read_history(spark, path + "-h", [later], 2) is None
