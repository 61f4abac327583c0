"""Risk profiles kept up to date from streams of alerts and false positives, in any order."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from fraudloom.functions.columns import micros
from fraudloom.operators.profiles import _profile_events
from fraudloom.streaming.dedup import stream_dedup

PROFILE = "total_alerts bigint, false_positive_count bigint, score_units bigint, at_us bigint"
PROFILE_ROW = Row("user_id", "total_alerts", "false_positive_count", "score_units", "at_us")
QUARTER_UNITS = 2500
FULL_UNITS = 10000
#: The time of events that have none: before all others.
NO_TIME = -(1 << 62)


class ProfileState(StatefulProcessor):
    """Counts and score of one user, as if all events had come in order.

    The score follows from the latest false positive: how many alerts were there by then, and how
    many false positives there are. A late event only changes these numbers. Alerts after the
    latest false positive are kept by time, as a later one may still take them in.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.profile = handle.getValueState(
            "profile", "total bigint, fps bigint, before bigint, last bigint, at bigint")
        self.open = handle.getMapState("open", "at bigint", "n bigint")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues):
        alerts, fp_times = Counter(), []
        for row in rows:
            if row["kind"] == 1:
                fp_times.append(row["at_us"])
            else:
                alerts[row["at_us"]] += 1
        total, fps, before, last, newest = self.profile.get() or (0, 0, 0, None, NO_TIME)
        total, fps = total + alerts.total(), fps + len(fp_times)
        latest = max(fp_times, default=last)
        if last is not None and latest is not None:
            latest = max(last, latest)
        if latest is not None and latest != last:
            for (time,), (n,) in list(self.open.iterator()):
                if time <= latest:
                    before += n
                    self.open.removeKey((time,))
        for time, n in sorted(alerts.items()):
            if latest is not None and time <= latest:
                before += n
            else:
                known = self.open.getValue((time,)) or (0,)
                self.open.updateValue((time,), (known[0] + n,))
        newest = max(newest, *alerts, *fp_times)
        self.profile.update((total, fps, before, latest, newest))
        units = min(FULL_UNITS, max(0, before - fps) * QUARTER_UNITS) if latest is not None else 0
        yield PROFILE_ROW(key[0], total, fps, units, newest)

    def close(self) -> None:
        pass


def profile_input(alerts: DataFrame, fp_events: DataFrame) -> DataFrame:
    return _profile_events(alerts, fp_events).withColumn("ts", F.col("ts").cast("timestamp"))


def stream_compensation(events: DataFrame) -> DataFrame:
    """Profile after every batch of events, for the users in it, corrected by late events.

    Redelivered events are dropped first, however late; scores move only on false positives.
    """
    kind = events.schema["user_id"].dataType.simpleString()
    states = stream_dedup(events, ["event_id", "kind"]).withColumn(
        "at_us", F.coalesce(micros("ts"), F.lit(NO_TIME))).groupBy("user_id").transformWithState(
        statefulProcessor=ProfileState(), outputStructType=f"user_id {kind}, {PROFILE}", outputMode="Append",
        timeMode="None",
    )
    return states.select(
        "user_id", "total_alerts", "false_positive_count",
        (F.col("score_units") / FULL_UNITS).cast("decimal(5,4)").alias("risk_score"),
        F.when(F.col("at_us") > NO_TIME, F.timestamp_micros("at_us")).alias("changed_at"),
    )
