"""Deliveries counted in a stored table; alert and profile states that take plain rows."""

from pyspark.sql import Row, functions as F

from fraudloom.session import shared_dir
from fraudloom.streaming.consume import numbered_deliveries
from fraudloom.streaming.lifecycle import AlertLifecycle
from fraudloom.streaming.profiles import ProfileState


class Value:
    """A state variable; asking whether it exists before reading it would be a call too many."""

    def __init__(self):
        self.value = None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value


def test_numbers_go_on_and_repeated_batches_replace_theirs(spark):
    path = shared_dir(spark, "t")

    def numbers(batch_id, *ids):
        batch = spark.createDataFrame([(i,) for i in ids], "message_id long")
        return sorted(map(tuple, numbered_deliveries(batch, batch_id, path).collect()), key=str)

    assert numbers(0, 1, 1, 2, None) == [(1, 1), (1, 2), (2, 1), (None, 1)]
    for _ in range(2):
        assert numbers(1, 1, 2, 3, None, None) == [(1, 3), (2, 2), (3, 1), (None, 1), (None, 1)]
    assert numbers(2, 1, 1) == [(1, 4), (1, 5)]
    assert spark.read.parquet(path).agg(F.sum("n")).first()[0] == 8


def test_alert_state_takes_rows():
    state = AlertLifecycle((5, 15), 100, 100, "bigint")
    state.state = Value()
    state.waiting = type("None_", (), {"exists": lambda self: False})()
    state.handle = type("Timers", (), {"registerTimer": lambda self, at: None})()
    clock = type("Clock", (), {"getCurrentWatermarkInMs": lambda self: 0})()
    row = Row("kind", "at_us", "seq", "target_status", "actor", "arrived_us")
    out = list(state.handleInputRows((1,), iter([
        row("action", 9, 11, "BLOCKED", "b", 9), row("alert", 0, -1, None, None, 0),
        row("action", 3, 10, "APPROVED", "a", 3)]), clock))
    assert [(e["status"], e["action_id"], e["outcome"]) for e in out] == [
        ("APPROVED", 10, "applied"), (None, 11, "conflict")]
    assert state.state.value == (0, 0, 109)


def test_profile_state_takes_rows():
    state, row = ProfileState(), Row("at_us", "kind")
    state.profile = Value()
    known = {}
    state.open = type("Open", (), {
        "getValue": lambda self, key: known.get(key), "updateValue": lambda self, key, value: known.update({key: value}),
        "iterator": lambda self: iter(known.items()), "removeKey": lambda self, key: known.pop(key)})()
    first = list(state.handleInputRows((7,), iter([row(1, 0), row(1, 0), row(5, 0)]), None))
    assert tuple(first[0]) == (7, 3, 0, 0, 5) and known == {(1,): (2,), (5,): (1,)}
    later = list(state.handleInputRows((7,), iter([row(2, 1)]), None))
    assert tuple(later[0]) == (7, 3, 1, 2500, 5) and known == {(5,): (1,)}
