"""Validation, normalisation and integrity checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from fraudloom.functions.columns import derived_id, is_alpha_code, lenient_decimal, upper_code
from fraudloom.schemas import (
    ALERT_STATUSES, ESCALATED_STATUSES, MONEY, OPEN_STATUSES, OUTBOX_STATUSES, SEVERITIES,
    TERMINAL_STATUSES, TRANSACTION_STATUSES,
)

SUBMISSION_FIELDS = (
    "amount", "currency", "country", "merchant_category", "user_id", "idempotency_key", "metadata",
)
UUID_PATTERN = "^[0-9a-fA-F]{8}-?([0-9a-fA-F]{4}-?){3}[0-9a-fA-F]{12}$"


def unknown_fields(given: Column, allowed=SUBMISSION_FIELDS) -> Column:
    """Field names that are not allowed."""
    return F.array_except(given, F.array(*[F.lit(name) for name in allowed]))


def submission_errors(user_pattern: str = UUID_PATTERN, has_field_names: bool = False) -> Column:
    """Array with the name of every field that violates its rule."""

    def length(col: str) -> Column:
        return F.coalesce(F.length(col), F.lit(0))

    amount = lenient_decimal("amount", 38, 18)
    checks = {
        "amount": F.coalesce(amount <= 0, F.lit(True)),
        "currency": F.col("currency").isNotNull()
        & ~((length("currency") == 3) & is_alpha_code(upper_code("currency"), 3)),
        "country": ~((length("country") == 2)
                     & F.coalesce(is_alpha_code(upper_code("country"), 2), F.lit(False))),
        "merchant_category": ~length("merchant_category").between(1, 128),
        "user_id": ~F.coalesce(F.col("user_id").rlike(user_pattern), F.lit(False)),
        "idempotency_key": length("idempotency_key") > 255,
    }
    if has_field_names:
        checks["unknown_field"] = F.size(unknown_fields(F.col("field_names"))) > 0
    return F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in checks.items()]))


def validate_transactions(
    raw: DataFrame, user_pattern: str = UUID_PATTERN,
) -> tuple[DataFrame, DataFrame]:
    """Splits submissions into valid ones and rejected ones with their errors."""
    checked = raw.withColumn(
        "errors", submission_errors(user_pattern, "field_names" in raw.columns)
    )
    valid = checked.where(F.size("errors") == 0).drop("errors")
    return valid, checked.where(F.size("errors") > 0)


def normalize_transactions(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "currency": upper_code("currency"), "country": upper_code("country"),
    })


def apply_defaults(df: DataFrame, key: str = "submission_id") -> DataFrame:
    """Fills currency, metadata, idempotency key and status of a new submission."""
    generated = derived_id(F.lit("key"), key)
    return df.withColumns({
        "currency": F.coalesce("currency", F.lit("USD")),
        "metadata": F.coalesce("metadata", F.lit("{}")),
        "idempotency_key": F.coalesce(F.nullif("idempotency_key", F.lit("")), generated),
        "status": F.lit("SUBMITTED"),
    })


def payload_to_transaction(events: DataFrame, payload: str = "payload") -> DataFrame:
    """Typed transaction columns out of a JSON event payload."""

    def field(name: str) -> Column:
        return F.get_json_object(payload, f"$.{name}")

    return events.withColumns({
        "transaction_id": field("transaction_id"),
        "user_id": field("user_id"),
        "amount": field("amount").try_cast(MONEY),
        "currency": F.coalesce(field("currency"), F.lit("USD")),
        "country": F.coalesce(field("country"), F.lit("")),
        "merchant_category": F.coalesce(field("merchant_category"), F.lit("")),
        "created_at": F.coalesce(F.try_to_timestamp(field("created_at")),
                                 F.try_to_timestamp("occurred_at")),
        "metadata": F.coalesce(field("metadata"), F.lit("{}")),
    })


def status_class(df: DataFrame, status: str = "status") -> DataFrame:
    col = F.col(status)
    return df.withColumns({
        "is_terminal": col.isin(*TERMINAL_STATUSES),
        "is_escalated": col.isin(*ESCALATED_STATUSES),
        "is_resolvable": col.isin(*OPEN_STATUSES),
    })


def _within(col: str, low, high=None) -> Column:
    test = F.col(col) >= low
    return test & (F.col(col) <= high) if high is not None else test


def _at_most(col: str, length: int) -> Column:
    return F.length(col) <= length


def _constraints(table: str) -> dict[str, Column]:
    """Conditions every row of the table has to fulfil (limits are fixed values)."""
    if table == "transactions":
        return {
            "amount_positive": F.col("amount") > 0,
            "currency_length": _at_most("currency", 3),
            "country_length": _at_most("country", 2),
            "merchant_category_length": _at_most("merchant_category", 100),
            "status_allowed": F.col("status").isin(*TRANSACTION_STATUSES),
            "idempotency_key_length": _at_most("idempotency_key", 255),
            "user_id_present": F.col("user_id").isNotNull(),
            "created_at_present": F.col("created_at").isNotNull(),
            "correlation_id_present": F.col("correlation_id").isNotNull(),
        }
    if table == "alerts":
        return {
            "transaction_id_present": F.col("transaction_id").isNotNull(),
            "user_id_present": F.col("user_id").isNotNull(),
            "status_allowed": F.col("status").isin(*ALERT_STATUSES),
            "severity_allowed": F.col("severity").isin(*SEVERITIES),
            "composite_risk_score_range": _within("composite_risk_score", 0, 1),
            "ml_anomaly_score_range": _within("ml_anomaly_score", 0, 1),
        }
    if table == "risk_profiles":
        return {
            "risk_score_range": _within("risk_score", 0, 1),
            "total_alerts_range": _within("total_alerts", 0),
            "false_positive_count_range": _within("false_positive_count", 0),
        }
    if table == "outbox_events":
        return {
            "event_type_length": _at_most("event_type", 128),
            "status_allowed": F.col("status").isin(*OUTBOX_STATUSES),
            "retry_count_range": _within("retry_count", 0),
            "payload_present": F.col("payload").isNotNull(),
        }
    raise ValueError(f"no constraints known for {table}")


def check_constraints(df: DataFrame, table: str, key: str) -> DataFrame:
    """One row (table, constraint, key) per violated constraint; a NULL result is a violation."""
    names = {
        name: cond for name, cond in _constraints(table).items()
        if name.rsplit("_", 1)[0] in df.columns or name in df.columns
    }
    broken = F.array_compact(F.array(*[
        F.when(~F.coalesce(cond, F.lit(False)), F.lit(name)) for name, cond in names.items()
    ]))
    return df.select(
        F.lit(table).alias("table_name"), F.explode(broken).alias("constraint_name"),
        F.col(key).cast("string").alias("row_key"),
    )


def check_unique_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Key values that occur more than once, with their number of rows."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("occurrences")).where(
        "occurrences > 1"
    )


def orphan_check(child: DataFrame, parent: DataFrame, fk: str, pk: str) -> DataFrame:
    """Child rows whose reference does not exist."""
    return child.join(
        parent.select(F.col(pk).alias("_pk")), F.col(fk) == F.col("_pk"), "left_anti"
    )
