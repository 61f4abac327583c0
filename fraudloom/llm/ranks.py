"""Ranks within groups of any size, and joins that survive a hot key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from fraudloom.llm.common import written

SALTS = 64


def ranked(rows: DataFrame, group: str, order: list, name: str) -> DataFrame:
    """`rows` with `rank` (from 0, in `order` within `group`) and `members` (rows of the group).

    Rows are cut into ranges of (group, order), so a group with most rows spans many tasks: each row
    is numbered inside its range, and only the sizes of the ranges are added up. NULL is a group.
    """
    cut = written(rows.repartitionByRange(F.col(group), *order).sortWithinPartitions(
        F.col(group), *order).withColumn("__at", F.monotonically_increasing_id()), name)
    part = F.shiftright("__at", 33).alias("__part")
    sizes = cut.groupBy(F.col(group).alias("__group"), part).agg(
        F.min("__at").alias("__first"), F.count(F.lit(1)).alias("__n"))
    whole = Window.partitionBy("__group")
    before = whole.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(
        "__group", "__part", "__first", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"),
        F.sum("__n").over(whole).alias("members"))
    return cut.withColumn("__own", F.shiftright("__at", 33)).join(
        starts, F.col(group).eqNullSafe(F.col("__group")) & (F.col("__own") == F.col("__part"))).select(
        *rows.columns, (F.col("__at") - F.col("__first") + F.col("__before")).alias("rank"), "members")


def salted_join(rows: DataFrame, facts: DataFrame, keys: list[str], spread: Column,
                salts: int = SALTS) -> DataFrame:
    """`rows` joined on `keys` to `facts`, which has one row per key.

    The fact of a key is first handed to the (key, salt) pairs that occur, at most `salts` a key, so
    rows of a hot key are dealt over that many tasks. `spread` tells rows of a key apart. `rows` are
    read twice and should be written.
    """
    salted = rows.withColumn("__salt", F.pmod(F.xxhash64(spread), F.lit(salts)))
    pairs = salted.select(*keys, "__salt").distinct().join(facts, keys)
    return salted.join(pairs, [*keys, "__salt"]).drop("__salt")
