"""Read paths: filtered lists, searches, pages, lookups and timelines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from fraudloom.functions.columns import contains_text

PAGE_SIZE = 50
MAX_PAGE_SIZE = 500


def _all_of(df: DataFrame, conditions: list[Column]) -> DataFrame:
    for condition in conditions:
        df = df.where(condition)
    return df


def _equals(**filters) -> list[Column]:
    return [F.col(name) == value for name, value in filters.items() if value not in (None, "")]


def _truth(value) -> bool:
    return str(value).lower() in ("true", "1")


def filter_alerts(alerts: DataFrame, status=None, severity=None, from_time=None, to_time=None):
    """Optional status, severity and creation time filters; both time ends are included."""
    conditions = _equals(status=status, severity=severity)
    if from_time is not None:
        conditions.append(F.col("created_at") >= F.lit(from_time))
    if to_time is not None:
        conditions.append(F.col("created_at") <= F.lit(to_time))
    return _all_of(alerts, conditions)


def search_alerts(alerts: DataFrame, query: str = "", status: str = "ALL", severity: str = "ALL"):
    """Substring search on id and transaction id; `ALL` and a blank query filter nothing."""
    conditions = _equals(
        status=None if status == "ALL" else status,
        severity=None if severity == "ALL" else severity,
    )
    if query.strip():
        conditions.append(contains_text(query, "id", "transaction_id"))
    return _all_of(alerts, conditions)


def filter_rules(rules: DataFrame, enabled=None, rule_type=None, severity=None) -> DataFrame:
    conditions = _equals(rule_type=rule_type, severity=severity)
    if enabled is not None:
        conditions.append(F.col("enabled") == _truth(enabled))
    return _all_of(rules, conditions).orderBy(F.col("created_at").desc(), "id")


def filter_audit(audit: DataFrame, action=None, entity_type=None, entity_id=None, actor=None):
    conditions = _equals(
        action=action, entity_type=entity_type, entity_id=entity_id, actor=actor)
    return _all_of(audit, conditions).orderBy(F.col("created_at").desc(), "id")


def filter_users(users: DataFrame, country=None, is_seed_data=None) -> DataFrame:
    conditions = _equals(country=country.upper() if country else None)
    if is_seed_data is not None:
        conditions.append(F.col("is_seed_data") == _truth(is_seed_data))
    return _all_of(users, conditions).orderBy(F.col("created_at").desc(), "id")


def _browse(df: DataFrame, filters: dict, day, query: str, search: tuple[str, ...], newest: str,
            ident: str) -> DataFrame:
    conditions = _equals(**filters)
    if day is not None:
        start = F.lit(day).cast("timestamp_ntz")
        conditions += [F.col(newest) >= start, F.col(newest) < start + F.expr("INTERVAL 1 DAY")]
    if query.strip():
        conditions.append(contains_text(query, *search))
    return _all_of(df, conditions).orderBy(F.col(newest).desc(), ident)


def browse_transactions(txns: DataFrame, status=None, currency=None, country=None, day=None,
                        query: str = "") -> DataFrame:
    return _browse(
        txns, {"status": status, "currency": currency, "country": country}, day, query,
        ("transaction_id", "user_id", "idempotency_key", "correlation_id"), "created_at",
        "transaction_id",
    )


def browse_alerts(alerts: DataFrame, status=None, severity=None, is_demo=None, day=None,
                  query: str = "") -> DataFrame:
    return _browse(
        alerts, {"status": status, "severity": severity, "is_demo": is_demo}, day, query,
        ("id", "transaction_id", "correlation_id", "resolved_by"), "created_at", "id",
    )


def browse_risk_profiles(profiles: DataFrame, query: str = "") -> DataFrame:
    return _browse(profiles, {}, None, query, ("user_id",), "last_recalculated_at", "user_id")


def alert_detail(alerts: DataFrame, ids: DataFrame) -> DataFrame:
    """Detail rows of the asked ids; missing ids are reported with `found` false."""
    detail = alerts.withColumns({
        "rule_matches": F.coalesce("rule_matches", F.lit("[]")),
        "risk_profile_snapshot": F.coalesce("risk_profile_snapshot", F.lit("{}")),
        "found": F.lit(True),
    })
    return ids.join(detail, "id", "left").withColumn("found", F.coalesce("found", F.lit(False)))


def lookup_by_id(df: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """Rows with the given primary keys."""
    return df.join(ids.select(F.col(ids.columns[0]).alias(key)).distinct(), key, "left_semi")


def transaction_with_alert(txns: DataFrame, alerts: DataFrame, ids: DataFrame) -> DataFrame:
    """Asked transactions with the summary of their alert, if they have one."""
    summary = alerts.select(
        "transaction_id", F.col("id").alias("alert_id"), F.col("status").alias("alert_status"),
        F.col("severity").alias("alert_severity"),
    )
    return (
        ids.join(txns.withColumn("_found", F.lit(True)), "transaction_id", "left")
        .join(summary, "transaction_id", "left")
        .withColumn("found", F.coalesce("_found", F.lit(False))).drop("_found")
    )


def inbox_anti_join(events: DataFrame, processed: DataFrame, group: str) -> DataFrame:
    """Events the consumer group has not processed yet."""
    seen = processed.where(F.col("consumer_group") == group).select("event_id")
    return events.join(seen, "event_id", "left_anti")


def page_alerts(alerts: DataFrame, page: int = 1, page_size: int = PAGE_SIZE) -> DataFrame:
    """One page of alerts, newest first; ids break ties."""
    if page < 1 or not 1 <= page_size <= MAX_PAGE_SIZE:
        raise ValueError("page starts at 1 and page_size is 1 to 500")
    return (
        alerts.orderBy(F.col("created_at").desc(), F.col("id").asc())
        .offset((page - 1) * page_size).limit(page_size)
    )


def count_alerts(alerts: DataFrame) -> DataFrame:
    return alerts.agg(F.count(F.lit(1)).alias("total"))


def page_window(totals: DataFrame, page: int, page_size: int) -> DataFrame:
    """Page numbers and record range for a table of totals."""
    pages = F.greatest(F.lit(1), F.ceil(F.col("total") / F.lit(page_size))).cast("bigint")
    active = F.least(F.lit(page).cast("bigint"), F.col("total_pages"))
    return totals.withColumn("total_pages", pages).withColumn("active_page", active).withColumns({
        "start_record": F.when(F.col("total") == 0, F.lit(0)).otherwise(
            (F.col("active_page") - 1) * page_size + 1).cast("bigint"),
        "end_record": F.least(F.col("active_page") * page_size, F.col("total")).cast("bigint"),
    })


def recent_alerts(alerts: DataFrame, count: int = 5) -> DataFrame:
    return alerts.orderBy(F.col("created_at").desc(), F.col("id").asc()).limit(count)


def oldest_pending(outbox: DataFrame, count: int = 50) -> DataFrame:
    return (
        outbox.where(F.col("status") == "PENDING")
        .orderBy(F.col("created_at").asc(), F.col("id").asc()).limit(count)
    )


def user_pool(users: DataFrame, count: int = 500) -> DataFrame:
    return users.select("id", "country").orderBy("id").limit(count)


def time_sorted(txns: DataFrame) -> DataFrame:
    return txns.orderBy("created_at", "transaction_id")


def correlation_timeline(
    txns: DataFrame, alerts: DataFrame, outbox: DataFrame, audit: DataFrame,
    correlation_id: str | None = None,
) -> DataFrame:
    """Everything that shares a correlation id, in time order."""
    def entries(df: DataFrame, source: str, ident: str, what: Column) -> DataFrame:
        return df.select(
            "correlation_id", F.col("created_at").alias("at"), F.lit(source).alias("source"),
            F.col(ident).cast("string").alias("entity_id"), what.alias("what"),
        )

    parts = [
        entries(txns, "transaction", "transaction_id", F.col("status")),
        entries(alerts, "alert", "id", F.col("severity")),
        entries(outbox, "outbox", "id", F.col("event_type")),
        entries(audit, "audit", "entity_id", F.col("action")),
    ]
    if correlation_id is not None:
        parts = [p.where(F.col("correlation_id") == correlation_id) for p in parts]
    timeline = parts[0]
    for part in parts[1:]:
        timeline = timeline.unionByName(part)
    return timeline.orderBy("correlation_id", "at", "source", "entity_id")
