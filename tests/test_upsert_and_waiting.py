"""Upserts in place, and alert lifecycles whose messages come in any order."""

import datetime
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from fraudloom.registry.streams import tune
from fraudloom.session import shared_dir
from fraudloom.sources.streams import file_stream
from fraudloom.sources.upsert import create_keyed, read_keyed, touched_partitions, upsert_keyed
from fraudloom.streaming.flows import write_files
from fraudloom.streaming.lifecycle import (
    action_outcomes, current_state, lifecycle_input, stream_lifecycle,
)

START = datetime.datetime(2024, 1, 1)
ROW = "id long, name string, n int"


def files(path: str) -> dict[int, set[str]]:
    found: dict[int, set[str]] = {}
    for file in Path(path).glob("key_part=*/*.parquet"):
        found.setdefault(int(file.parent.name.split("=")[1]), set()).add(file.name)
    return found


def test_only_touched_partitions_are_written_again(spark):
    path = shared_dir(spark, "t")
    base = spark.range(1000).select("id", F.lit("old").alias("name"), F.lit(1).alias("n"))
    create_keyed(base, path, ["id"], partitions=64)
    before = files(path)
    delta = spark.createDataFrame([(i, "new", 2) for i in range(0, 1000, 100)] + [(5000, "new", 2)], ROW)
    touched = upsert_keyed(delta, path, base.schema, ["id"], ["name"], partitions=64)
    after = files(path)
    assert touched == touched_partitions(delta, ["id"], 64) and 0 < len(touched) <= 11
    changed = {part for part in after if after[part] != before.get(part)}
    assert changed <= set(touched) and {p for p in touched if p in before} <= changed
    rows = {r["id"]: (r["name"], r["n"]) for r in read_keyed(spark, path, base.schema).collect()}
    assert len(rows) == 1001 and rows[5000] == ("new", 2)
    assert all(rows[i] == (("new", 1) if i % 100 == 0 else ("old", 1)) for i in range(1000))


def test_upsert_of_nothing_narrow_and_other_types(spark):
    path = shared_dir(spark, "t")
    base = spark.createDataFrame([(1, "a", 1), (2, None, None)], ROW)
    create_keyed(base, path, ["id"], partitions=4)
    before = files(path)
    assert upsert_keyed(base.limit(0), path, base.schema, ["id"], ["n"], partitions=4) == []
    assert files(path) == before
    narrow = spark.createDataFrame([(2, 7), (3, 8)], "id int, n long")
    upsert_keyed(narrow, path, base.schema, ["id"], ["n"], partitions=4)
    assert sorted(tuple(r) for r in read_keyed(spark, path, base.schema).collect()) == [
        (1, "a", 1), (2, None, 7), (3, None, 8)]


def at(minutes: int) -> datetime.datetime:
    return START + datetime.timedelta(minutes=minutes)


@pytest.fixture
def run(spark):
    tune(spark)

    def go(table, log, *cuts, **options):
        """Feeds (filter, minute of arrival) one after the other."""
        source = lifecycle_input(table, log)
        path, out, check = (shared_dir(spark, "t") for _ in range(3))
        for kept, minute in cuts:
            source.where(kept).withColumn("arrived_at", F.lit(at(minute))).write.mode("append").parquet(path)
            write_files(stream_lifecycle(file_stream(spark, path, source.schema), **options),
                        out, check).awaitTermination()
        return spark.read.parquet(out), check

    return go


def test_actions_before_their_alert(spark, run):
    """Actions on 1 and 2 wait for them; of two on 1 the earlier one wins, 9 never comes."""
    table = spark.createDataFrame([(i, START) for i in (1, 2, 3)], "id long, created_at timestamp")
    log = spark.createDataFrame(
        [(10, 1, "BLOCKED", "b", at(8)), (11, 1, "APPROVED", "a", at(2)), (20, 2, "APPROVED", "a", at(60)),
         (30, 3, "WRONG", "c", at(1)), (90, 9, "APPROVED", "d", at(1))],
        "action_id long, alert_id long, target_status string, actor string, acted_at timestamp")
    events, check = run(table, log, ("kind = 'action' AND alert_id <> 3", 0), ("kind = 'alert'", 1),
                        ("alert_id = 3 AND kind = 'action'", 10000))
    found = {r["id"]: (r["status"], r["escalated_email_at"], r["escalated_slack_at"], r["resolved_at"])
             for r in current_state(events, table).collect()}
    assert found == {1: ("APPROVED", None, None, at(2)), 2: ("APPROVED", at(5), at(15), at(60)),
                     3: ("ESCALATED_SLACK", at(5), at(15), None)}
    assert {r["action_id"]: r["outcome"] for r in action_outcomes(events).collect()} == {
        10: "conflict", 11: "applied", 20: "applied", 30: "invalid_target", 90: "not_found"}
    for name, left in (("alert", [3]), ("waiting", [])):
        kept = spark.read.format("statestore").option("stateVarName", name).load(check)
        assert [r["alert_id"] for r in kept.select("key.alert_id").collect()] == left


def test_action_after_its_alert_left_the_state(spark, run):
    table = spark.createDataFrame([(1, START), (2, START)], "id long, created_at timestamp")
    log = spark.createDataFrame(
        [("x", 1, "BLOCKED", "b", at(3)), ("y", 1, "APPROVED", "a", at(4)), ("z", 7, "APPROVED", "a", at(4)),
         ("end", 2, "NONE", "a", at(5))],
        "action_id string, alert_id long, target_status string, actor string, acted_at timestamp")
    events, _ = run(table, log, ("kind = 'alert' OR seq = 'x'", 0), ("seq IN ('y', 'z')", 5000),
                    ("seq = 'end'", 10000))
    assert {r["action_id"]: r["outcome"] for r in action_outcomes(events).collect()} == {
        "x": "applied", "y": "conflict", "z": "not_found", "end": "invalid_target"}
    assert {r["id"]: r["status"] for r in current_state(events, table).collect()} == {
        1: "BLOCKED", 2: "ESCALATED_SLACK"}
