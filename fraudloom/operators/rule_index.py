"""Predicate index over many rules: a row looks up the rules it meets and tests no others.

Every condition becomes an entry (key, limit). The key names what is compared, such as amounts in
one currency, or holds the value that must be equal, such as a country. The limits under a key are
sorted, so the rules that an amount reaches are a prefix, found by bisection; so is the key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

LIMIT = "decimal(38,8)"
ENTRY = f"array<struct<key:string,limit:{LIMIT}>>"


def _entry(key: Column, limit: Column | None = None) -> Column:
    """An entry unless its key or its limit is NULL, which no row meets."""
    if limit is None:
        limit = F.lit(0)
    limit = limit.cast(LIMIT)
    return F.when(key.isNotNull() & limit.isNotNull(), F.struct(key.alias("key"), limit.alias("limit")))


def rule_entries(rule: Column, per_window: bool) -> Column:
    """The entries of one rule. A velocity rule has up to two, of which one is enough."""
    of_window = F.concat(F.lit(" "), rule["window"].cast("string")) if per_window else F.lit("")
    over = F.when(rule["strict"], F.lit(">")).otherwise(F.lit(">="))
    currency = F.coalesce(F.concat(F.lit(" "), rule["currency"]), F.lit(""))
    kind = rule["rule_type"]

    def of(name: str, *entries: Column) -> Column:
        return F.when(kind == name, F.array(*entries))

    none = F.array().cast(ENTRY)
    return F.array_compact(F.coalesce(
        of("AMOUNT_THRESHOLD", _entry(F.concat(F.lit("amount"), over, currency), rule["threshold"])),
        of("VELOCITY", _entry(F.concat(F.lit("count>="), of_window), rule["max_count"]),
           _entry(F.concat(F.lit("total>="), of_window), rule["max_amount"])),
        of("USER_RISK_LEVEL", _entry(F.lit("risk>="), rule["min_score"])),
        F.when(kind == "HIGH_RISK_COUNTRY", F.transform(
            F.coalesce(rule["countries"], F.array().cast("array<string>")),
            lambda v: _entry(F.concat(F.lit("country "), v)))),
        F.when(kind == "MERCHANT_CATEGORY", F.transform(
            F.coalesce(rule["categories"], F.array().cast("array<string>")),
            lambda v: _entry(F.concat(F.lit("category "), v)))),
        none))


def build_index(
    rules: DataFrame, order: list[str], columns: list[str], per_window: bool = False,
) -> DataFrame:
    """One row: `rules` in order, and per key its sorted limits with the places of their rules.

    `rules` are typed as by `resolve_rule_params`. The row holds every rule once and every entry
    once, so it is as large as the rules table, which is configuration and not data.
    """
    listed = rules.select(F.sort_array(F.collect_list(F.struct(
        *order, *[c for c in columns if c not in order]))).alias("rules"))
    single = listed.select(F.posexplode("rules").alias("place", "rule")).select(
        "place", F.explode(rule_entries(F.col("rule"), per_window)).alias("entry"))
    # Equal limits are one step of the bisection; `ends` says how many entries are up to each.
    limits = single.groupBy("entry.key", "entry.limit").agg(
        F.sort_array(F.collect_list("place")).alias("places")).withColumn("end", F.sum(
            F.size("places")).over(Window.partitionBy("key").orderBy("limit")).cast("int"))
    keys = limits.groupBy("key").agg(F.sort_array(F.collect_list(F.struct(
        "limit", "end", "places"))).alias("e")).select(
        "key", F.col("e.limit").alias("limits"), F.col("e.end").alias("ends"),
        F.flatten("e.places").alias("places"))
    directory = keys.agg(F.sort_array(F.collect_list(F.struct("key", "limits", "ends", "places"))).alias("d"))
    return listed.crossJoin(directory).select(F.struct(
        "rules", F.col("d.key").alias("keys"), F.col("d").alias("directory")).alias("index"))


def constant(index: DataFrame) -> Column:
    """The index as a constant of the plan; folded once, before any row is read."""
    text = index.select(F.to_json("index").alias("text")).first()["text"]
    return F.from_json(F.lit(text), index.schema["index"].dataType)


def reached(values: Column, value: Column, strict: Column | None = None) -> Column:
    """How many of the sorted `values` are at most `value`, or below it where `strict` holds.

    By bisection, one step per halving; 0 for NULL.
    """
    size = F.size(values)

    def step(range_: Column, _: Column) -> Column:
        low, high = range_["low"], range_["high"]
        middle = F.shiftright(low + high, 1)
        at = F.get(values, middle)
        under = at <= value if strict is None else F.when(strict, at < value).otherwise(at <= value)
        up = (low < high) & F.coalesce(under, F.lit(False))
        return F.struct(F.when(up, middle + 1).otherwise(low).alias("low"),
                        F.when(up | (low >= high), high).otherwise(middle).alias("high"))

    return F.aggregate(
        F.sequence(F.lit(1), F.length(F.bin(size))),
        F.struct(F.lit(0).alias("low"), size.alias("high")), step, lambda range_: range_["low"])


def met_entries(index: Column, windows: tuple[int, ...] = ()) -> Column:
    """What a row of `evaluate_rules` input reaches: per key of the directory the first `n` entries.

    `windows` are the lengths that velocity was counted over, where there are several. Entries of
    different `part` never belong to one rule. Rows that reach the same entries meet the same rules.
    """
    def asked(part: int, key: Column, value: Column, strict: bool = False) -> Column:
        return F.struct(F.lit(part).alias("part"), key.alias("key"), value.cast(LIMIT).alias("value"),
                        F.lit(strict).alias("strict"))

    def entries_up_to(of: Column, question: Column) -> Column:
        steps = reached(of["limits"], question["value"], question["strict"])
        return F.coalesce(F.get(of["ends"], steps - 1), F.lit(0))

    currency = F.concat(F.lit(" "), F.upper("currency"))
    amounts = [(over, money) for over in (">=", ">") for money in (F.lit(""), currency)]
    questions = F.array(
        *[asked(part, F.concat(F.lit(f"amount{over}"), money), F.col("amount"), over == ">")
          for part, (over, money) in enumerate(amounts)],
        asked(4, F.lit("risk>="), F.col("risk_score")),
        asked(5, F.concat(F.lit("country "), F.upper(F.trim("country"))), F.lit(0)),
        asked(6, F.concat(F.lit("category "), F.lower(F.trim("merchant_category"))), F.lit(0)),
        *[asked(7 + part, F.lit(f"{name}>={at}"), F.col(column + at.replace(" ", "_")))
          for part, at in enumerate([f" {m}" for m in windows] or [""])
          for name, column in (("count", "txn_count"), ("total", "total_amount"))])

    def answer(question: Column) -> Column:
        # The transform over one element names it, so the bisection is not repeated per use.
        found = F.array(reached(index["keys"], question["key"]) - 1)
        return F.get(F.transform(found, lambda at: F.struct(
            question["part"].alias("part"), at.alias("at"),
            F.when(F.get(index["keys"], at) == question["key"], entries_up_to(
                F.get(index["directory"], at), question)).otherwise(F.lit(0)).alias("n"))), F.lit(0))

    return F.filter(F.transform(questions, answer), lambda met: met["n"] > 0)


def places_of(index: Column, entries: Column) -> Column:
    """Sorted places of the rules with one of the `entries` that `met_entries` gives."""
    return F.sort_array(F.array_distinct(F.flatten(F.transform(entries, lambda met: F.slice(
        F.get(index["directory"], met["at"])["places"], F.lit(1), met["n"])))))


def met_places(index: Column, windows: tuple[int, ...] = ()) -> Column:
    """Sorted places of the rules that a row of `evaluate_rules` input meets."""
    return places_of(index, met_entries(index, windows))
