"""Alert state machine on a stream: timed escalation against analyst actions."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import NumericType

from fraudloom.config import LifecycleConfig
from fraudloom.functions.columns import micros
from fraudloom.plans.slices import MINUTE_US
from fraudloom.schemas import TERMINAL_STATUSES

STATE = "created_us bigint, level int, until_us bigint"
LEVELS = ("ESCALATED_EMAIL", "ESCALATED_SLACK")
EVENT = Row("alert_id", "status", "at_us", "actor", "action_id", "outcome")


class AlertLifecycle(StatefulProcessor):
    """State of one alert: creation time, escalation level and, once closed, until when it is kept.

    Levels are decided by event time, so an action that comes in the same batch as the alert
    meets the escalations that were due before it, whether or not their timer has fired. Actions
    that come before their alert wait in a list. An alert has few rows, so they are taken as they are
    and not as data frames, whose setup would be most of the work.
    """

    def __init__(self, delays_us: tuple[int, int], wait_us: int, keep_us: int, action_type: str):
        self.delays_us, self.wait_us, self.keep_us = delays_us, wait_us, keep_us
        self.action_type = action_type

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("alert", STATE)
        self.waiting = handle.getListState(
            "waiting", f"at_us bigint, seq {self.action_type}, target string, actor string, until_us bigint")

    def _escalate(self, key, created: int, level: int, before_us: int, out: list) -> int:
        """Makes every transition due before the given time."""
        while level < len(LEVELS):
            due = created + self.delays_us[level]
            if due >= before_us:
                break
            out.append(EVENT(key[0], LEVELS[level], due, None, None, None))
            level += 1
        return level

    def _call_at(self, at_us: int, watermark_ms: int) -> None:
        self.handle.registerTimer(max(-(-at_us // 1000), watermark_ms + 1))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues):
        batch = sorted(rows, key=lambda row: (row["at_us"] is None, row["at_us"], row["seq"] is None, row["seq"]))
        watermark_ms = timerValues.getCurrentWatermarkInMs()
        created, level, until = self.state.get() or (None, 0, None)
        known, out, actions = created is not None, [], []
        for row in batch:
            at, seq, target, actor = row["at_us"], row["seq"], row["target_status"], row["actor"]
            if row["kind"] == "alert":
                created = int(at) if created is None else created
            elif target not in TERMINAL_STATUSES:
                out.append(EVENT(key[0], None, int(at), actor, seq, "invalid_target"))
            else:
                actions.append((int(at), seq, target, actor, int(row["arrived_us"]) + self.wait_us))
        if created is None:
            if actions:
                self.waiting.appendList(actions)
                for end in {action[-1] for action in actions}:
                    self._call_at(end, watermark_ms)
            return iter(out)
        if not known and self.waiting.exists():
            actions = sorted([*self.waiting.get(), *actions], key=lambda action: action[:2])
            self.waiting.clear()
        for at, seq, target, actor, _ in actions:
            if until is not None:
                out.append(EVENT(key[0], None, at, actor, seq, "conflict"))
                continue
            level = self._escalate(key, created, level, at, out)
            out.append(EVENT(key[0], target, at, actor, seq, "applied"))
            until = max(row["arrived_us"] for row in batch if row["arrived_us"] is not None) + self.keep_us
            self._call_at(until, watermark_ms)
        self.state.update((created, level, until))
        if not known and until is None and level < len(LEVELS):
            self._call_at(created + self.delays_us[level], watermark_ms)
        return iter(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        watermark_ms = timerValues.getCurrentWatermarkInMs()
        now, out = watermark_ms * 1000, []
        state = self.state.get()
        if state is None:
            waiting = list(self.waiting.get()) if self.waiting.exists() else []
            later = [action for action in waiting if action[-1] > now]
            out += [EVENT(key[0], None, at, actor, seq, "not_found")
                    for at, seq, _, actor, end in waiting if end <= now]
            self.waiting.put(later) if later else self.waiting.clear()
            return iter(out)
        created, level, until = state
        if until is None:
            level = self._escalate(key, created, level, now + 1, out)
            self.state.update((created, level, until))
            if level < len(LEVELS):
                self._call_at(created + self.delays_us[level], watermark_ms)
        elif until <= now:
            self.state.clear()
        return iter(out)

    def close(self) -> None:
        pass


def lifecycle_input(alerts: DataFrame, actions: DataFrame) -> DataFrame:
    """Alerts and actions in the one shape the state machine reads; ids keep their types.

    `arrived_at` is when the message came, here its own time; replace it where that is known.
    """
    kind = actions.schema["action_id"].dataType
    before_all = F.lit(-1 if isinstance(kind, NumericType) else "").cast(kind)
    return alerts.select(
        F.col("id").alias("alert_id"), F.lit("alert").alias("kind"),
        F.col("created_at").cast("timestamp").alias("at"), before_all.alias("seq"),
        F.lit(None).cast("string").alias("target_status"), F.lit(None).cast("string").alias("actor"),
    ).unionByName(actions.select(
        "alert_id", F.lit("action").alias("kind"), F.col("acted_at").cast("timestamp").alias("at"),
        F.col("action_id").alias("seq"), "target_status", "actor",
    )).withColumn("arrived_at", F.col("at"))


def stream_lifecycle(
    events: DataFrame, watermark: str = "1 minute", cfg: LifecycleConfig = LifecycleConfig(),
    wait_minutes: int = 1440, keep_minutes: int = 1440,
) -> DataFrame:
    """What happens to alerts: (alert_id, status, at, actor, action_id, outcome).

    Transitions have a status; every action has an outcome, and the one that closes its alert has
    both. Time moves on with `arrived_at`, so a message is never late by its own time `at`. Actions of
    one batch act in the order of their times, those of later batches find what earlier ones decided.
    An action waits `wait_minutes` for its alert and is `not_found` after that. A closed alert leaves
    the state after `keep_minutes`; see `action_outcomes` for actions that come later still. Open
    alerts stay, as each may yet be closed.
    """
    delays = (cfg.email_minutes * MINUTE_US, (cfg.email_minutes + cfg.slack_minutes) * MINUTE_US)
    rows = events.withWatermark("arrived_at", watermark).withColumns({
        "at_us": micros("at"), "arrived_us": micros("arrived_at")})
    kind, action = (events.schema[name].dataType.simpleString() for name in ("alert_id", "seq"))
    happened = (f"alert_id {kind}, status string, at_us bigint, actor string, action_id {action},"
                " outcome string")
    moved = rows.groupBy("alert_id").transformWithState(
        statefulProcessor=AlertLifecycle(
            delays, wait_minutes * MINUTE_US, keep_minutes * MINUTE_US, action),
        outputStructType=happened, outputMode="Append", timeMode="EventTime",
    )
    return moved.select(
        "alert_id", "status", F.timestamp_micros("at_us").alias("at"), "actor", "action_id", "outcome")


def current_state(transitions: DataFrame, alerts: DataFrame) -> DataFrame:
    """Alert rows as the transitions left them."""
    def time_of(status: str):
        return F.max(F.when(F.col("status") == status, F.col("at"))).cast("timestamp_ntz")

    final = F.col("status").isin(*TERMINAL_STATUSES)
    folded = transitions.where("status IS NOT NULL").groupBy(F.col("alert_id").alias("id")).agg(
        time_of("ESCALATED_EMAIL").alias("escalated_email_at"),
        time_of("ESCALATED_SLACK").alias("escalated_slack_at"),
        F.max_by(F.struct("status", "actor"), F.struct(final, "at")).alias("_last"),
        F.max(F.when(final, F.col("at"))).cast("timestamp_ntz").alias("resolved_at"),
    )
    return alerts.select("id").join(folded, "id", "left").select(
        "id", F.coalesce("_last.status", F.lit("PENDING")).alias("status"),
        "escalated_email_at", "escalated_slack_at", F.col("_last.actor").alias("resolved_by"),
        "resolved_at",
    )


def action_outcomes(events: DataFrame) -> DataFrame:
    """Outcome of every action: (action_id, alert_id, outcome).

    An action that waited in vain because its alert had been closed and had left the state is a
    conflict; closed alerts are told by their transitions.
    """
    closed = events.where(F.col("status").isin(*TERMINAL_STATUSES)).select(
        "alert_id", F.lit(True).alias("_closed")).distinct()
    return events.where("outcome IS NOT NULL").join(closed, "alert_id", "left").select(
        "action_id", "alert_id",
        F.when((F.col("outcome") == "not_found") & F.col("_closed"), "conflict")
        .otherwise(F.col("outcome")).alias("outcome"))
