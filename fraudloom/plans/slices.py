"""Running and trailing values that no single key can overload.

A window partitioned by the key alone puts a busy key into one task. Here the time axis
of every key is cut into slices of fixed width; rows are shuffled by (key, slice), and what
lies outside a slice comes in as pre-aggregated per-slice totals. Those totals hold one row
per key and slice, so their size follows elapsed time, not the number of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from fraudloom.functions.columns import micros

MINUTE_US = 60_000_000
MAX_SLICE_MINUTES = 15


def slice_no(ts: Column | str, width_us: int) -> Column:
    """Number of the epoch-aligned slice a time falls into."""
    return whole_slices(micros(ts), width_us)


def whole_slices(us: Column, width_us: int) -> Column:
    return F.call_function("div", us - F.pmod(us, F.lit(width_us)), F.lit(width_us))


def slices_per_window(minutes: int) -> int:
    """How many slices a trailing window spans, each of at most `MAX_SLICE_MINUTES`."""
    count = -(-minutes // MAX_SLICE_MINUTES)
    while (minutes * MINUTE_US) % count:
        count += 1
    return count


def opening_totals(
    df: DataFrame, keys: list[str], slice_col: str, totals: dict[str, Column],
) -> DataFrame:
    """Per (key, slice): the sum of each total over all earlier slices of the key."""
    per_slice = df.groupBy(*keys, slice_col).agg(
        *[F.sum(expr).alias(name) for name, expr in totals.items()]
    )
    earlier = (
        Window.partitionBy(*keys).orderBy(slice_col)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    return per_slice.select(
        *keys, slice_col,
        *[F.coalesce(F.sum(name).over(earlier), F.lit(0)).alias(name) for name in totals],
    )


def opening_last(
    df: DataFrame, keys: list[str], slice_col: str, order: Column, value: Column, name: str,
) -> DataFrame:
    """Per (key, slice): the latest non-NULL `value` of all earlier slices of the key."""
    latest = F.max(F.when(value.isNotNull(), F.struct(order.alias("o"), value.alias("v"))))
    per_slice = df.groupBy(*keys, slice_col).agg(latest.alias("_latest"))
    earlier = (
        Window.partitionBy(*keys).orderBy(slice_col)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    return per_slice.select(
        *keys, slice_col,
        F.last("_latest.v", ignorenulls=True).over(earlier).alias(name),
    )
