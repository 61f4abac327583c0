"""Data-driven fraud rules as column expressions.

The rules table is read once per plan. Up to `COMPILE_LIMIT` enabled rules become one generated
array expression, so matching needs neither a join nor a shuffle. A larger set becomes a constant
predicate index: a row bisects sorted limits and looks up its country and category, and only builds
the matches found. Both give the same rows.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Row, functions as F

from fraudloom.functions.columns import fixed_text
from fraudloom.operators.features import velocity_horizons, with_risk_profile
from fraudloom.operators.rule_index import build_index, constant, met_places, rule_entries
from fraudloom.operators.rule_steps import (
    VELOCITY, digests, rows_of_both, rule_totals, steps_of, with_steps,
)
from fraudloom.schemas import RULE_TYPES, SEVERITIES
from fraudloom.session import materialize

COMPILE_LIMIT = 128
SETS_PER_TASK, MOST_SETS = 500, 50_000
RULE_COLUMNS = [
    "id", "name", "rule_type", "severity", "parameters", "rule_order", "threshold", "currency",
    "strict", "countries", "categories", "max_count", "max_amount", "min_score", "window_text",
    "window",
]
PARAMETER_TYPES = {
    "threshold": "decimal(28,8)", "max_amount": "decimal(28,8)", "min_score": "decimal(28,8)",
    "max_count": "bigint", "window": "int", "strict": "boolean", "countries": "array<string>",
    "categories": "array<string>",
}

# Parameter names in lookup order (fixed values).
THRESHOLD_KEYS = ("threshold", "amount_threshold", "limit")
COUNTRY_KEYS = ("countries", "country_codes", "country_list")
MAX_COUNT_KEYS = ("max_count", "count_threshold")
MAX_AMOUNT_KEYS = ("max_amount", "amount_threshold")
MIN_SCORE_KEYS = ("min_risk_score", "risk_threshold", "threshold")
CATEGORY_KEYS = ("categories", "category_list", "blocked_categories")


# The parameter logic is written as SQL text over columns `_p_<name>` holding the JSON text of
# one parameter each (NULL when absent or JSON null), so every parameter is extracted once.


def _present(key: str) -> str:
    """NULL for values that count as missing: false, zero and empty ones."""
    text = f"_p_{key}"
    return (f"CASE WHEN {text} NOT IN ('false', '\"\"', '[]', '{{}}')"
            f" AND coalesce(try_cast({text} AS double) <> 0, true) THEN {text} END")


def _first(keys: tuple[str, ...], keep_last: bool = True) -> str:
    """First parameter that is present; the last alias counts even when it is zero."""
    found = [_present(key) for key in keys] + ([f"_p_{keys[-1]}"] if keep_last else [])
    return f"coalesce({', '.join(found)})"


def _text(raw: str) -> str:
    """Value of a JSON scalar as plain text."""
    return f"get_json_object(concat('{{\"v\":', {raw}, '}}'), '$.v')"


def _number(raw: str) -> str:
    return (f"try_cast(CASE WHEN {raw} NOT IN ('true', 'false') THEN {_text(raw)} END"
            " AS decimal(28,8))")


def _whole(raw: str) -> str:
    """Whole number of a count limit: JSON numbers are truncated, text must be whole."""
    return (f"CASE WHEN startswith({raw}, '\"') THEN try_cast({_text(raw)} AS bigint)"
            f" WHEN {raw} = 'true' THEN 1 WHEN {raw} = 'false' THEN 0"
            f" ELSE try_cast(try_cast({raw} AS decimal(28,8)) AS bigint) END")


def _list(raw: str, fold: str) -> str:
    values = f"try_variant_get(try_parse_json({raw}), '$', 'array<string>')"
    return (f"array_distinct(transform(filter({values}, v -> v IS NOT NULL),"
            f" v -> {fold}(trim(v))))")


PARAMETER_KEYS = tuple(dict.fromkeys((
    *THRESHOLD_KEYS, *COUNTRY_KEYS, *MAX_COUNT_KEYS, *MAX_AMOUNT_KEYS, *MIN_SCORE_KEYS,
    *CATEGORY_KEYS, "currency", "operator", "window_minutes",
)))
TYPED_PARAMETERS = {
    "threshold": ("AMOUNT_THRESHOLD", _number(_first(THRESHOLD_KEYS))),
    "currency": ("AMOUNT_THRESHOLD", f"upper({_text(_present('currency'))})"),
    "strict": ("AMOUNT_THRESHOLD", f"coalesce({_text('_p_operator')} <> '>=', false)"),
    "countries": ("HIGH_RISK_COUNTRY", _list(_first(COUNTRY_KEYS, False), "upper")),
    "categories": ("MERCHANT_CATEGORY", _list(_first(CATEGORY_KEYS, False), "lower")),
    "max_count": ("VELOCITY", _whole(_first(MAX_COUNT_KEYS))),
    "max_amount": ("VELOCITY", _number(_first(MAX_AMOUNT_KEYS))),
    "min_score": ("USER_RISK_LEVEL", _number(_first(MIN_SCORE_KEYS))),
    "window_text": ("VELOCITY", _text("_p_window_minutes")),
}


def resolve_rule_params(rules: DataFrame) -> DataFrame:
    """Typed columns for the JSON parameters of every rule.

    Unreadable numbers and non-list lists become NULL, which never matches.
    """
    columns = [f"`{name}`" for name in rules.columns]
    parsed = rules.selectExpr(*columns, "try_parse_json(coalesce(parameters, '{}')) AS _params")
    raw = parsed.selectExpr(*columns, *[
        f"nullif(to_json(try_variant_get(_params, '$.{key}', 'variant')), 'null') AS _p_{key}"
        for key in PARAMETER_KEYS
    ])
    return raw.selectExpr(*columns, *[
        f"CASE WHEN rule_type = '{kind}' THEN {value} END AS {name}"
        for name, (kind, value) in TYPED_PARAMETERS.items()
    ])


def load_active_rules(rules: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Enabled rules with typed parameters, and the enabled rules that are not valid."""
    enabled = rules.where("enabled")
    valid = F.col("rule_type").isin(*RULE_TYPES) & F.col("severity").isin(*SEVERITIES)
    bad_type = F.when(~F.col("rule_type").isin(*RULE_TYPES), F.lit("rule_type"))
    bad_severity = F.when(~F.col("severity").isin(*SEVERITIES), F.lit("severity"))
    invalid = enabled.where(~valid).withColumn(
        "reason", F.concat_ws(",", bad_type, bad_severity)
    )
    return resolve_rule_params(enabled.where(valid)), invalid


# ----------------------------------------------------------------------- one rule, one condition


class _Rule:
    """Column access to one rule: literals of a collected row, or fields of a struct column."""

    def __init__(self, source: Row | Column, windows: tuple[int, ...] = ()):
        self._source, self._windows = source, windows

    def velocity(self, name: str) -> Column:
        """`name` over the pipeline's window, or over the rule's own where there are several."""
        if not self._windows:
            return F.col(name)
        if isinstance(self._source, Row):
            return F.col(f"{name}_{self._source['window']}")
        return F.coalesce(*[F.when(self["window"] == m, F.col(f"{name}_{m}")) for m in self._windows])

    def __getitem__(self, name: str) -> Column:
        if isinstance(self._source, Column):
            return self._source[name]
        value = self._source[name]
        kind = PARAMETER_TYPES.get(name, "string")
        if isinstance(value, list):
            return F.array(*[F.lit(v) for v in value]).cast(kind)
        return F.lit(str(value) if isinstance(value, Decimal) else value).cast(kind)


def amount_condition(rule: _Rule) -> Column:
    currency = rule["currency"].isNull() | (F.upper("currency") == rule["currency"])
    above = F.when(rule["strict"], F.col("amount") > rule["threshold"]).otherwise(
        F.col("amount") >= rule["threshold"]
    )
    return currency & above


def country_condition(rule: _Rule) -> Column:
    return F.array_contains(rule["countries"], F.upper(F.trim("country")))


def category_condition(rule: _Rule) -> Column:
    return F.array_contains(rule["categories"], F.lower(F.trim("merchant_category")))


def count_condition(rule: _Rule) -> Column:
    return rule.velocity("txn_count") >= rule["max_count"]


def total_condition(rule: _Rule) -> Column:
    return rule.velocity("total_amount") >= rule["max_amount"]


def velocity_condition(rule: _Rule) -> Column:
    hit = F.lit(False)
    return F.coalesce(count_condition(rule), hit) | F.coalesce(total_condition(rule), hit)


def risk_condition(rule: _Rule) -> Column:
    return F.col("risk_score") >= rule["min_score"]


CONDITIONS = {
    "AMOUNT_THRESHOLD": amount_condition,
    "HIGH_RISK_COUNTRY": country_condition,
    "VELOCITY": velocity_condition,
    "USER_RISK_LEVEL": risk_condition,
    "MERCHANT_CATEGORY": category_condition,
}


# ------------------------------------------------------------------------------- explanations


def explain_amount(rule: _Rule) -> Column:
    return F.concat(
        F.lit("Transaction amount "), fixed_text("amount", 2), F.lit(" "), F.col("currency"),
        F.lit(" exceeds threshold "), fixed_text(rule["threshold"], 2), F.lit(" "),
        F.col("currency"),
    )


def explain_country(rule: _Rule) -> Column:
    return F.concat(
        F.lit("Transaction origin country '"), F.col("country"),
        F.lit("' matches high-risk country list"),
    )


def explain_velocity(rule: _Rule, window_minutes: int = 10) -> Column:
    count = F.when(count_condition(rule), F.concat(
        F.lit("count "), rule.velocity("txn_count").cast("string"), F.lit(" >= limit "),
        rule["max_count"].cast("string"),
    ))
    total = F.when(total_condition(rule), F.concat(
        F.lit("total amount "), fixed_text(rule.velocity("total_amount"), 2), F.lit(" >= limit "),
        fixed_text(rule["max_amount"], 2),
    ))
    return F.concat(
        F.lit("User transaction velocity exceeded in "),
        F.coalesce(rule["window_text"], F.lit(str(window_minutes))), F.lit("m window: "),
        F.concat_ws(", ", count, total),
    )


def explain_risk(rule: _Rule) -> Column:
    return F.concat(
        F.lit("User risk score "), fixed_text("risk_score", 4),
        F.lit(" meets or exceeds risk threshold "), fixed_text(rule["min_score"], 4),
    )


def explain_category(rule: _Rule) -> Column:
    return F.concat(
        F.lit("Merchant category '"), F.col("merchant_category"),
        F.lit("' matches monitored high-risk merchant categories"),
    )


EXPLANATIONS = {
    "AMOUNT_THRESHOLD": explain_amount,
    "HIGH_RISK_COUNTRY": explain_country,
    "VELOCITY": explain_velocity,
    "USER_RISK_LEVEL": explain_risk,
    "MERCHANT_CATEGORY": explain_category,
}


def _match(rule: _Rule, explanation: Column) -> Column:
    return F.struct(
        rule["id"].alias("rule_id"), rule["name"].alias("rule_name"),
        rule["rule_type"].alias("rule_type"), rule["severity"].alias("severity"),
        explanation.alias("explanation"), rule["parameters"].alias("parameters_snapshot"),
        F.col("created_at").alias("matched_at"),
    )


def _explanation(kind: str, rule: _Rule, window_minutes: int) -> Column:
    if kind == "VELOCITY":
        return explain_velocity(rule, window_minutes)
    return EXPLANATIONS[kind](rule)


def _compiled(rows: list[Row], window_minutes: int, windows: tuple[int, ...]) -> Column:
    parts = []
    for row in rows:
        rule = _Rule(row, windows)
        parts.append(F.when(
            CONDITIONS[row["rule_type"]](rule),
            _match(rule, _explanation(row["rule_type"], rule, window_minutes)),
        ))
    return F.array_compact(F.array(*parts))


def _indexed(index: Column, window_minutes: int, windows: tuple[int, ...]) -> Column:
    """Matches through the predicate index, for rule sets too large to generate code for."""

    def match(item: Column) -> Column:
        rule, text = _Rule(item, windows), F
        for kind in CONDITIONS:
            text = text.when(item["rule_type"] == kind, _explanation(kind, rule, window_minutes))
        return _match(rule, text)

    items = F.transform(met_places(index, windows), lambda place: F.get(index["rules"], place))
    return F.transform(items, match)


def evaluate_rules(
    enriched: DataFrame, rules: DataFrame, window_minutes: int = 10,
    compile_limit: int = COMPILE_LIMIT, column: str = "rule_matches",
    windows: tuple[int, ...] = (),
) -> DataFrame:
    """Adds the array of matches of all enabled, valid rules in rule order.

    `enriched` needs the columns of `velocity_trailing` and `with_risk_profile`. Rules are
    ordered by `rule_order` where given, else by creation time and id. With `windows`, each velocity
    rule is tested over its own window, see `evaluate_rules_per_window`.
    """
    active, _ = load_active_rules(_ordered(rules))
    order = ["rule_order", "id"]
    active = active.withColumn("window", rule_window(window_minutes)).select(*RULE_COLUMNS)
    rows = active.orderBy(*order).limit(compile_limit + 1).collect()
    if 0 < len(rows) <= compile_limit:
        return enriched.withColumn(column, _compiled(rows, window_minutes, windows))
    index = constant(build_index(active, order, RULE_COLUMNS, bool(windows)))
    return enriched.withColumn(column, _indexed(index, window_minutes, windows))


def rule_window(default: int) -> Column:
    """Minutes of a rule's own window; the pipeline's where it names none or no whole number above 0."""
    own = F.col("window_text").try_cast("int")
    return F.when(own > 0, own).otherwise(F.lit(default)).cast("int")


def evaluate_rules_per_window(
    txns: DataFrame, profiles: DataFrame, rules: DataFrame, window_minutes: int = 10,
    compile_limit: int = COMPILE_LIMIT, column: str = "rule_matches",
) -> DataFrame:
    """Matches where every velocity rule counts over its own `window_minutes`.

    The distinct lengths of the active rules, read once from the rules table, are all counted in one
    pass over the transactions.
    """
    enriched, windows = _with_own_windows(txns, profiles, rules, window_minutes)
    return evaluate_rules(enriched, rules, window_minutes, compile_limit, column, windows)


def _with_own_windows(
    txns: DataFrame, profiles: DataFrame, rules: DataFrame, window_minutes: int,
) -> tuple[DataFrame, tuple[int, ...]]:
    active, _ = load_active_rules(_ordered(rules))
    found = active.where("rule_type = 'VELOCITY'").select(
        rule_window(window_minutes).alias("window")).distinct().collect()
    windows = tuple(sorted({window_minutes, *(row["window"] for row in found)}))
    return with_risk_profile(velocity_horizons(txns, list(windows)), profiles), windows


class RuleSets:
    """Which rules each transaction meets, by id and without the matches themselves.

    Transactions that reach the same steps of the limits meet the same rules. So the rules are put
    together once per distinct set of steps, and the work follows transactions plus distinct sets, not
    transactions times rules. `rows` has the columns `keep` and `rule_set`. Rules stay rows that tasks
    read in turn; the driver and the workers hold the distinct limits alone.
    """

    def __init__(
        self, enriched: DataFrame, rules: DataFrame, keep: list[str], window_minutes: int = 10,
        windows: tuple[int, ...] = (),
    ):
        active, _ = load_active_rules(_ordered(rules))
        active = active.withColumn("window", rule_window(window_minutes)).select(*RULE_COLUMNS)
        rule = F.struct(*RULE_COLUMNS)
        self._rules = materialize(active.select(
            "id", "rule_order", "rule_type", F.col("window") if windows else F.lit(0).alias("window"),
            rule_entries(rule, bool(windows)).alias("entries")), "rules")
        self._steps, self._windows = steps_of(self._rules), windows
        self._shared = enriched.sparkSession.sparkContext.broadcast(self._steps)
        self.rows = materialize(with_steps(enriched, keep, self._shared, windows), "rule_sets")

    @classmethod
    def per_window(
        cls, txns: DataFrame, profiles: DataFrame, rules: DataFrame, keep: list[str],
        window_minutes: int = 10,
    ) -> RuleSets:
        """Sets where every velocity rule counts over its own `window_minutes`."""
        enriched, windows = _with_own_windows(txns, profiles, rules, window_minutes)
        return cls(enriched, rules, keep, window_minutes, windows)

    def distinct(self) -> DataFrame:
        """Every set once, with its number of `transactions`."""
        return self.rows.groupBy("rule_set").agg(F.count(F.lit(1)).alias("transactions"))

    def with_digests(self) -> DataFrame:
        """`rows` without the set, with `n_matches` and `matched_sha256`, the digest of the rules' ids in
        rule order with commas between. Both are found once per distinct set.

        All rules are read once per chunk of sets, so chunks are few, but at most `MOST_SETS` large.
        """
        sets = materialize(self.distinct(), "distinct_sets")
        n, tasks = sets.count(), int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        chunks = max(1, min(tasks, n // SETS_PER_TASK), -(-n // MOST_SETS))
        told = digests(sets, self._rules, self._shared, chunks, VELOCITY + 2 * max(len(self._windows), 1))
        return self.rows.join(told, "rule_set").select(
            *[name for name in self.rows.columns if name != "rule_set"], "n_matches", "matched_sha256")

    def transactions_per_rule(self) -> DataFrame:
        """(id, transactions) of the rules that are met.

        Transactions are counted per step. A rule's are those of its steps; of a velocity rule with two
        steps, less those that reach both.
        """
        sets = materialize(self.distinct(), "distinct_sets")
        ended = sets.select("transactions", F.explode("rule_set").alias("step")).where("step >= 0").groupBy(
            "step").agg(F.sum("transactions").alias("n")).toArrow()
        rows = sets.sparkSession.sparkContext.broadcast(self._steps.rows_at_least(ended))
        totals = rule_totals(self._rules, self._shared, rows)
        pair = ["window", "count", "total"]
        both = rows_of_both(sets, totals.where("total IS NOT NULL").select(*pair).distinct(),
                            self._steps, self._windows)
        return totals.join(both, pair, "left").groupBy("id").agg(
            F.sum(F.col("n") - F.coalesce("both", F.lit(0))).alias("transactions")).where("transactions > 0")


def _ordered(rules: DataFrame) -> DataFrame:
    if "rule_order" in rules.columns:
        return rules
    return rules.withColumn("rule_order", F.unix_micros(F.col("created_at").cast("timestamp")))


def rule_hits(
    enriched: DataFrame, rules: DataFrame, rule_type: str | None = None,
    key: str = "transaction_id", window_minutes: int = 10,
) -> DataFrame:
    """One row per transaction and matching rule, optionally of one rule type."""
    if rule_type:
        rules = rules.where(F.col("rule_type") == rule_type)
    matched = evaluate_rules(enriched, rules, window_minutes, column="_matches")
    return matched.select(key, F.inline("_matches"))
