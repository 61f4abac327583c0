"""Queries that run as streams over files derived from the tables.

The input is cut into consecutive time ranges. Each range is written as files and then
processed by its own run of the query on the same checkpoint, so every query here also
restarts from its checkpoint between ranges.
"""

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from fraudloom.config import DetectionConfig
from fraudloom.fixtures import seeded_rules
from fraudloom.functions.columns import micros
from fraudloom.registry.core import Tables, query, sql
from fraudloom.registry.dashboard import ROUTED, VOLUME
from fraudloom.registry.detection import STEPS
from fraudloom.registry.lifecycle import REPLAY_COLUMNS, WINNERS, _replay
from fraudloom.registry.messaging import DECODED, ENVELOPE, FAILED
from fraudloom.session import prepare, shared_dir
from fraudloom.sources.streams import event_stream_from_start, file_stream, transaction_stream
from fraudloom.streaming.lifecycle import (
    action_outcomes, current_state, lifecycle_input, stream_lifecycle,
)
from fraudloom.streaming.consume import stream_consume
from fraudloom.streaming.dedup import stream_dedup
from fraudloom.streaming.flows import (
    stream_detect, stream_notifications, stream_relay, stream_retry_status, write_files,
)
from fraudloom.streaming.profiles import profile_input, stream_compensation
from fraudloom.streaming.velocity import stream_velocity
from fraudloom.streaming.volume import current_volume, stream_volume_5m

PARTS = 2
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def tune(spark) -> None:
    """State goes to RocksDB; on one machine a state partition per core is enough."""
    prepare(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    if spark.sparkContext.master.startswith("local"):
        cores = spark.sparkContext.defaultParallelism
        if int(spark.conf.get("spark.sql.shuffle.partitions")) > cores:
            spark.conf.set("spark.sql.shuffle.partitions", str(cores))


def run_in_parts(
    t: Tables, source: DataFrame, ts: str, run: Callable[[str], object], parts: int = PARTS,
    name: str = "stream", closing: DataFrame | None = None,
) -> None:
    """Writes `source` range by range into one folder and runs the query after each range.

    `closing` holds rows written last; a time far ahead in it moves the watermark past all data.
    """
    low, high = source.agg(F.min(micros(ts)), F.max(micros(ts))).first()
    step = (high - low) // parts + 1
    starts = [low + part * step for part in range(parts)]
    pieces = [source.where((micros(ts) >= at) & (micros(ts) < at + step)) for at in starts]
    if closing is not None:
        pieces.append(closing.select(*source.columns))
    run_pieces(t, pieces, run, name)


def run_pieces(
    t: Tables, pieces: list[DataFrame], run: Callable[[str], object], name: str = "stream",
) -> None:
    """Writes one piece after the other into one folder and runs the query after each."""
    path, partitions = shared_dir(t.spark, name, "input"), "spark.sql.shuffle.partitions"
    before = t.spark.conf.get(partitions)
    tune(t.spark)
    try:
        for piece in pieces:
            piece.write.mode("append").parquet(path)
            run(path)
    finally:
        t.spark.conf.set(partitions, before)


def results(t: Tables, build: Callable[[str], DataFrame], out: str, check: str, **options):
    """A `run` function appending the stream built over a folder to `out`."""
    def run(path: str) -> None:
        write_files(build(path), out, check, **options).awaitTermination()

    return run


def timed(df: DataFrame, *columns: str) -> DataFrame:
    """Event-time columns as instants, which watermarks need."""
    return df.withColumns({name: F.col(name).cast("timestamp") for name in columns})


def ahead(df: DataFrame, *columns: str) -> DataFrame:
    """One row per closing marker: the last row moved two days ahead."""
    first = columns[0]
    return df.orderBy(F.col(first).desc()).limit(1).withColumns({
        name: F.col(name) + F.expr("INTERVAL 2 DAYS") for name in columns})


@query("transaction_stream", sql("raw_messages", """
    SELECT message_id, coalesce(event, envelope, data, flat) AS body FROM raw_messages"""))
def bounded_read(t):
    out, check = shared_dir(t.spark, "read"), shared_dir(t.spark, "read_check")
    source = timed(t.raw_messages, "created_at")

    def build(path):
        return transaction_stream(t.spark, path, schema=source.schema).select(
            "message_id", F.coalesce("event", "envelope", "data", "flat").alias("body"))

    run_in_parts(t, source, "created_at", results(t, build, out, check))
    return t.spark.read.parquet(out)


@query("event_stream_from_start", sql("raw_messages", """
    SELECT message_id, json_extract_string(body, '$.event_id') AS event_id
    FROM decoded WHERE error IS NULL""", decoded=DECODED))
def replayed_read(t):
    from fraudloom.operators.events import decode_envelope

    out, check = shared_dir(t.spark, "replay"), shared_dir(t.spark, "replay_check")
    source = timed(t.raw_messages, "created_at")
    folders = [shared_dir(t.spark, "replay_in") for _ in range(2)]
    for number, folder in enumerate(folders):
        source.where(F.col("message_id") % 2 == number).write.parquet(folder)
    events = event_stream_from_start(t.spark, folders, schema=source.schema)
    ok, _ = decode_envelope(events)
    write_files(ok.select("message_id", "event_id"), out, check).awaitTermination()
    return t.spark.read.parquet(out)


@query("stream_dedup", sql("txn", "SELECT transaction_id AS event_id, amount, created_at FROM txn"))
def deduplicated(t):
    once = t.txn.select(F.col("transaction_id").alias("event_id"), "amount", "created_at")
    again = once.where("event_id % 10 = 0")
    out, check = shared_dir(t.spark, "dedup"), shared_dir(t.spark, "dedup_check")
    source = timed(once.unionByName(again), "created_at")
    run_in_parts(t, source, "created_at", results(
        t, lambda path: stream_dedup(file_stream(t.spark, path, source.schema)), out, check))
    return t.spark.read.parquet(out).withColumn(
        "created_at", F.col("created_at").cast("timestamp_ntz"))


@query("stream_velocity", sql("txn", """
    SELECT transaction_id, count(*) OVER w AS txn_count, CAST(sum(amount) OVER w AS DECIMAL(24,2)) AS total_amount
    FROM txn WINDOW w AS (PARTITION BY user_id ORDER BY created_at
                 RANGE BETWEEN INTERVAL 1440 MINUTES PRECEDING AND CURRENT ROW)"""))
def counted(t):
    source = timed(t.txn.select("transaction_id", "user_id", "amount", "created_at"), "created_at")
    out, check = shared_dir(t.spark, "velocity"), shared_dir(t.spark, "velocity_check")
    run_in_parts(t, source, "created_at", lambda path: stream_velocity(
        file_stream(t.spark, path, source.schema), out, check, 1440).awaitTermination())
    return t.spark.read.parquet(f"{out}/velocity").select("transaction_id", "txn_count", "total_amount")


def out_of_order(t) -> tuple[DataFrame, list[DataFrame]]:
    """Transactions by `row_no`, a seventh without id, and two batches of them: in the second most
    rows are late, up to the whole time span, and some of the first come again."""
    source = timed(t.txn.select(F.col("transaction_id").alias("row_no"), F.when(
        F.col("transaction_id") % 7 != 0, F.col("transaction_id")).alias("transaction_id"),
        "user_id", "amount", "created_at"), "created_at")
    first = source.where("row_no % 2 = 0")
    again = first.where("row_no % 10 = 0 AND transaction_id IS NOT NULL")
    return source, [first, source.where("row_no % 2 = 1").unionByName(again)]


@query("stream_dedup_disorder", sql("txn", "SELECT transaction_id AS row_no, user_id, amount FROM txn"))
def deduplicated_disorder(t):
    source, pieces = out_of_order(t)
    out, check = shared_dir(t.spark, "dedup"), shared_dir(t.spark, "dedup_check")
    run_pieces(t, pieces, results(t, lambda path: stream_dedup(
        file_stream(t.spark, path, source.schema), "transaction_id"), out, check))
    return t.spark.read.parquet(out).select("row_no", "user_id", "amount")


DAY_WINDOW = """count(*) OVER w AS txn_count, CAST(sum(amount) OVER w AS DECIMAL(24,2)) AS total_amount"""
DAY_FRAME = """WINDOW w AS (PARTITION BY user_id ORDER BY created_at
                 RANGE BETWEEN INTERVAL 1440 MINUTES PRECEDING AND CURRENT ROW)"""


@query("stream_velocity_disorder", sql("txn", f"""
    SELECT transaction_id AS row_no, {DAY_WINDOW} FROM txn WHERE transaction_id % 2 = 0 {DAY_FRAME}
    UNION ALL SELECT row_no, txn_count, total_amount FROM (
      SELECT transaction_id AS row_no, {DAY_WINDOW} FROM txn {DAY_FRAME}) WHERE row_no % 2 = 1"""))
def counted_disorder(t):
    """Rows of the second batch count all before them, those of the first what had come by then."""
    source, pieces = out_of_order(t)
    out, check = shared_dir(t.spark, "velocity"), shared_dir(t.spark, "velocity_check")
    run_pieces(t, pieces, lambda path: stream_velocity(
        file_stream(t.spark, path, source.schema), out, check, 1440).awaitTermination())
    return t.spark.read.parquet(f"{out}/velocity").select("row_no", "txn_count", "total_amount")


def _volume(t, source, feed) -> DataFrame:
    out, check = shared_dir(t.spark, "volume_s"), shared_dir(t.spark, "volume_check")
    feed(lambda path: stream_volume_5m(
        file_stream(t.spark, path, source.schema), out, check).awaitTermination())
    return current_volume(t.spark, out).withColumn("bucket", F.col("bucket").cast("timestamp_ntz"))


@query("stream_volume_5m", sql("txn", f"{VOLUME} FROM txn GROUP BY 1"))
def volume(t):
    source = timed(t.txn.select("transaction_id", "user_id", "amount", "created_at"), "created_at")
    return _volume(t, source, lambda run: run_in_parts(t, source, "created_at", run))


@query("stream_volume_disorder", sql("txn", f"{VOLUME} FROM txn GROUP BY 1"))
def volume_disorder(t):
    source, pieces = out_of_order(t)
    return _volume(t, source, lambda run: run_pieces(t, pieces, run))


PROFILED = """
    SELECT v.*, coalesce(p.risk_score, CAST(0 AS DECIMAL(5,4))) AS risk_score,
      coalesce(p.total_alerts, 0) AS total_alerts, coalesce(p.false_positive_count, 0) AS false_positive_count
    FROM vel v LEFT JOIN risk_profiles_fx p ON p.user_id = v.user_id"""
DETECTION_STEPS = {**STEPS, "enriched": PROFILED}


def _detection_run(t) -> str:
    source = timed(t.txn_submissions, "created_at")
    out, check = shared_dir(t.spark, "detect"), shared_dir(t.spark, "detect_check")

    def run(path):
        stream_detect(
            file_stream(t.spark, path, source.schema), lambda: t.risk_profiles_fx,
            lambda: seeded_rules(t.spark), out, check, cfg=DetectionConfig(velocity_minutes=1440),
        ).awaitTermination()

    run_in_parts(t, source, "created_at", run)
    return out


@query("stream_detect", sql("txn risk_profiles_fx", """
    SELECT transaction_id, should_alert, severity, composite_risk_score, 'PROCESSED' AS status FROM decided""",
    **DETECTION_STEPS))
def detected(t):
    return t.spark.read.parquet(f"{_detection_run(t)}/decisions").select(
        "transaction_id", "should_alert", "severity", "composite_risk_score", "status")


@query("stream_detect_disorder", sql("txn", """
    SELECT transaction_id, CAST(1 AS BIGINT) AS decisions,
      CAST(CASE WHEN transaction_id % 50 = 0 AND transaction_id % 7 <> 0 THEN 1 ELSE 0 END AS BIGINT) AS duplicates
    FROM txn"""))
def disordered(t):
    """Rows up to the whole time span late, repeats in a later batch, some without a key."""
    keyless = F.when(F.col("transaction_id") % 7 != 0, F.col("idempotency_key"))
    once = timed(t.txn, "created_at").withColumn("idempotency_key", keyless)
    half = F.pmod(F.xxhash64("transaction_id"), F.lit(2))
    again = once.where("transaction_id % 50 = 0").withColumn(
        "transaction_id", F.when(F.col("idempotency_key").isNull(), F.col("transaction_id"))
        .otherwise(F.col("transaction_id") + 100000000).cast(once.schema["transaction_id"].dataType))
    out, check = shared_dir(t.spark, "disorder"), shared_dir(t.spark, "disorder_check")

    def run(path):
        stream_detect(
            file_stream(t.spark, path, once.schema), lambda: t.risk_profiles_fx,
            lambda: seeded_rules(t.spark), out, check, cfg=DetectionConfig(velocity_minutes=1440),
        ).awaitTermination()

    run_pieces(t, [once.where(half == 0), once.where(half == 1).unionByName(again)], run)
    decided = t.spark.read.parquet(f"{out}/decisions").groupBy("transaction_id").agg(
        F.count(F.lit(1)).alias("decisions"))
    repeats = t.spark.read.parquet(f"{out}/duplicates").groupBy("transaction_id").agg(
        F.count(F.lit(1)).alias("_n"))
    return decided.join(repeats, "transaction_id", "left").select(
        "transaction_id", "decisions", F.coalesce("_n", F.lit(0)).alias("duplicates"))


@query("decision_sink", sql("txn risk_profiles_fx", """
    SELECT 'alerts' AS table_name, count(*) AS rows FROM decided WHERE should_alert
    UNION ALL SELECT 'outbox_events', count(*) FROM decided WHERE should_alert
    UNION ALL SELECT 'processed_events', count(*) FROM decided
    UNION ALL SELECT 'new_alerts', count(*) FROM decided WHERE should_alert""", **DETECTION_STEPS))
def sink(t):
    out = _detection_run(t)
    parts = [
        t.spark.read.parquet(f"{out}/{name}").agg(F.count(F.lit(1)).alias("rows")).select(
            F.lit(name).alias("table_name"), "rows")
        for name in ("alerts", "outbox_events", "processed_events")
    ] + [t.spark.read.parquet(f"{out}/profile_changes").agg(
        F.sum("new_alerts").cast("bigint").alias("rows")).select(
            F.lit("new_alerts").alias("table_name"), "rows")]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


@query("stream_lifecycle", sql("alerts_fx actions_fx", _replay(None)))
def lifecycle(t):
    source = lifecycle_input(t.alerts_fx, t.actions_fx)
    out, check = shared_dir(t.spark, "lifecycle"), shared_dir(t.spark, "lifecycle_check")
    run_in_parts(t, source, "at", results(
        t, lambda path: stream_lifecycle(file_stream(t.spark, path, source.schema)), out, check),
        closing=_clock(source))
    return current_state(t.spark.read.parquet(out), t.alerts_fx).select(*REPLAY_COLUMNS)


def _clock(source: DataFrame) -> DataFrame:
    """A message that moves time past everything and belongs to no alert."""
    return ahead(source, "at", "arrived_at").withColumns({
        "alert_id": F.lit(-1).cast("bigint"), "kind": F.lit("action"),
        "target_status": F.lit("PENDING")})


def _early_actions(t) -> tuple[str, str]:
    """For every second alert the actions come a batch before the alert, for the others after it."""
    source = lifecycle_input(t.alerts_fx, t.actions_fx)
    out, check = shared_dir(t.spark, "early"), shared_dir(t.spark, "early_check")
    start = source.agg(F.min("at")).first()[0]
    early = (F.col("kind") == "action") == (F.pmod(F.xxhash64("alert_id"), F.lit(2)) == 0)
    pieces = [source.where(early).withColumn("arrived_at", F.lit(start)),
              source.where(~early).withColumn("arrived_at", F.lit(start) + F.expr("INTERVAL 1 MINUTE")),
              _clock(source)]
    run_pieces(t, pieces, results(
        t, lambda path: stream_lifecycle(file_stream(t.spark, path, source.schema)), out, check))
    return out, check


@query("stream_lifecycle_early", sql("alerts_fx actions_fx", _replay(None)))
def lifecycle_early(t):
    out, _ = _early_actions(t)
    return current_state(t.spark.read.parquet(out), t.alerts_fx).select(*REPLAY_COLUMNS)


@query("stream_action_outcomes", sql("alerts_fx actions_fx", """
    SELECT a.action_id, a.alert_id, CASE WHEN a.target_status = 'PENDING' THEN 'invalid_target' WHEN f.id IS NULL THEN 'not_found'
      WHEN w.action_id = a.action_id THEN 'applied' ELSE 'conflict' END AS outcome
    FROM actions_fx a LEFT JOIN alerts_fx f ON f.id = a.alert_id LEFT JOIN winners w ON w.alert_id = a.alert_id""",
    winners=WINNERS))
def streamed_outcomes(t):
    out, _ = _early_actions(t)
    return action_outcomes(t.spark.read.parquet(out)).where("alert_id <> -1")


@query("stream_lifecycle_state", sql("alerts_fx actions_fx", """
    SELECT id, 'alert' AS kept FROM alerts_fx WHERE id NOT IN (SELECT alert_id FROM winners)""", winners=WINNERS))
def lifecycle_state(t):
    """What is left in the state store once a day has gone by: open alerts, nothing else."""
    _, check = _early_actions(t)
    kept = [t.spark.read.format("statestore").option("stateVarName", name).load(check).select(
        F.col("key.alert_id").alias("id"), F.lit(name).alias("kept")) for name in ("alert", "waiting")]
    return kept[0].unionByName(kept[1])


RUN = """
    SELECT *, CAST(sum(1 - kind) OVER w AS BIGINT) AS total_alerts, CAST(sum(kind) OVER w AS BIGINT) AS false_positive_count
    FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY ts, kind, event_id ROWS UNBOUNDED PRECEDING)"""


COMPENSATED = sql("alerts_fx fp_fx", """
    SELECT user_id, max(total_alerts) AS total_alerts, max(false_positive_count) AS false_positive_count,
      CAST(coalesce(max_by(CASE WHEN total_alerts > 0 THEN least(1, 0.25 * greatest(0, total_alerts - false_positive_count)) ELSE 0 END,
        false_positive_count) FILTER (WHERE kind = 1), 0) AS DECIMAL(5,4)) AS risk_score
    FROM run GROUP BY user_id""",
    ev="""SELECT user_id, created_at AS ts, 0 AS kind, id AS event_id FROM alerts_fx
    UNION ALL SELECT user_id, resolved_at, 1, event_id FROM fp_fx""", run=RUN)


def _profiles(t, source, feed) -> DataFrame:
    out, check = shared_dir(t.spark, "profiles"), shared_dir(t.spark, "profiles_check")
    feed(results(t, lambda path: stream_compensation(
        file_stream(t.spark, path, source.schema)), out, check))
    return t.spark.read.parquet(out).groupBy("user_id").agg(F.max_by(
        F.struct("total_alerts", "false_positive_count", "risk_score"),
        F.col("total_alerts") + F.col("false_positive_count")).alias("s")).select("user_id", "s.*")


@query("stream_compensation", COMPENSATED)
def compensation(t):
    source = profile_input(t.alerts_fx, t.fp_fx)
    twice = source.unionByName(source.where("event_id % 10 = 0"))
    return _profiles(t, source, lambda run: run_in_parts(t, twice, "ts", run))


@query("stream_compensation_disorder", COMPENSATED)
def compensation_disorder(t):
    """False positives before their alerts, both up to the whole time span late, some again."""
    source = profile_input(t.alerts_fx, t.fp_fx)
    first = source.where("(event_id + kind) % 3 = 0")
    rest = source.where("(event_id + kind) % 3 <> 0").unionByName(first.where("event_id % 2 = 0"))
    return _profiles(t, source, lambda run: run_pieces(t, [first, rest], run))


@query("stream_retry_status", sql("attempts_fx", """
    SELECT event_id, CASE WHEN fails >= 8 THEN 'DEAD_LETTERED' WHEN done THEN 'PUBLISHED' ELSE 'PENDING' END AS status,
      CAST(least(fails, 8) AS INT) AS retry_count FROM failed""", failed=FAILED))
def retries(t):
    source = t.attempts_fx
    out, check = shared_dir(t.spark, "retry"), shared_dir(t.spark, "retry_check")

    def write(batch, batch_id):
        batch.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").parquet(
            f"{out}/batch_id={batch_id}")

    def run(path):
        (stream_retry_status(file_stream(t.spark, path, source.schema)).writeStream
         .outputMode("update").foreachBatch(write).option("checkpointLocation", check)
         .trigger(availableNow=True).start().awaitTermination())

    run_in_parts(t, source, "attempted_at", run)
    found = t.spark.read.parquet(out).groupBy("event_id").agg(
        F.max_by(F.struct("status", "retry_count"), F.col("batch")).alias("s"))
    return found.select("event_id", "s.*")


@query("stream_relay", sql("outbox_fx", f"""
    SELECT id, stream, {ENVELOPE} AS envelope FROM routed WHERE status = 'PENDING'""", routed=ROUTED))
def relay(t):
    out, check = shared_dir(t.spark, "relay_s"), shared_dir(t.spark, "relay_check")
    source = t.outbox_fx
    run_in_parts(t, source, "created_at", results(
        t, lambda path: stream_relay(file_stream(t.spark, path, source.schema)), out, check,
        partition_by=("stream",)))
    return t.spark.read.parquet(out)


@query("stream_notifications", sql("raw_messages", """
    SELECT message_id, json_extract_string(body, '$.event_type') AS event_type,
      concat('{"type":"', json_extract_string(body, '$.event_type'), '","payload":',
        CAST(json_extract(body, '$.payload') AS VARCHAR), '}') AS message
    FROM decoded WHERE error IS NULL""", decoded=DECODED))
def notifications(t):
    out, check = shared_dir(t.spark, "notify"), shared_dir(t.spark, "notify_check")
    source = timed(t.raw_messages, "created_at")
    run_in_parts(t, source, "created_at", results(
        t, lambda path: stream_notifications(file_stream(t.spark, path, source.schema)),
        out, check))
    return t.spark.read.parquet(out)


@query("stream_consume", sql("raw_messages", """
    SELECT 'events' AS kind, message_id, CAST(1 AS INT) AS retry_count FROM decoded WHERE error IS NULL
    UNION ALL SELECT 'malformed', message_id, 1 FROM decoded WHERE error IS NOT NULL
    UNION ALL SELECT 'exhausted', message_id, 6 FROM decoded WHERE message_id % 11 = 0""", decoded=DECODED))
def consumed(t):
    """Messages delivered once, three times, or three and four times in two batches."""
    source = timed(t.raw_messages, "created_at")
    times = F.when(F.col("message_id") % 11 == 0, 3).when(F.col("message_id") % 13 == 0, 2).otherwise(1)
    many = source.withColumn("_n", F.explode(F.sequence(F.lit(1), times))).drop("_n")
    late = source.where("message_id % 11 = 0").withColumn(
        "_n", F.explode(F.sequence(F.lit(1), F.lit(4)))).drop("_n")
    out, check = shared_dir(t.spark, "consume"), shared_dir(t.spark, "consume_check")
    run_pieces(t, [many.where("message_id % 2 = 0 OR message_id % 11 = 0"), many.where(
        "message_id % 2 = 1 AND message_id % 11 <> 0").unionByName(late)], lambda path: stream_consume(
        file_stream(t.spark, path, source.schema), out, check).awaitTermination())
    kinds = [t.spark.read.parquet(f"{out}/events").select(
        F.lit("events").alias("kind"), "message_id", F.lit(1).alias("retry_count"))]
    kinds += [t.spark.read.parquet(f"{out}/{kind}").select(
        F.lit(kind).alias("kind"), F.col("original_event_id").cast("long").alias("message_id"), "retry_count")
        for kind in ("malformed", "exhausted")]
    return kinds[0].unionByName(kinds[1]).unionByName(kinds[2])
