"""Removal of repeated passages by overlapping windows of three consecutive lines."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType

from fraudloom.llm.common import SPACES, written
from fraudloom.llm.repeats import repeated_rows

#: A line ends at a line break, and after a sentence: running text often holds a passage in one line.
LINE_END = r"(?<=\n)|(?<=[.!?] )"
_LINE_END = re.compile(LINE_END)
WIDTH = 3
#: Shorter windows (three interjections) meet by chance.
MIN_CHARS = 40


def lines(text: Column) -> Column:
    """The non-blank lines of a text, trimmed."""
    return F.filter(F.transform(F.split(text, LINE_END), lambda x: F.btrim(x, F.lit(SPACES))),
                    lambda x: x != "")


def _windows(found: Column, min_chars: int) -> Column:
    """Hash and first line of every window; windows below `min_chars` have no hash."""
    def window(i: Column) -> Column:
        parts = [found[i + k] for k in range(WIDTH)]
        size = sum((F.length(p) for p in parts[1:]), F.length(parts[0]))
        return F.when(size >= min_chars, F.xxhash64(*parts))

    return F.when(F.size(found) >= WIDTH, F.transform(
        F.sequence(F.lit(0), F.size(found) - WIDTH), window))


def _chains(found: Column, min_chars: int) -> Column:
    """Hash, first line and number of lines of longer windows where three lines are below `min_chars`:
    from each line on, and back from each line, the fewest lines that reach it."""
    @F.pandas_udf(ArrayType(ArrayType(IntegerType())))
    def spans(sizes: pd.Series) -> pd.Series:
        return pd.Series([_spans(x, min_chars) for x in sizes], dtype=object)

    return F.transform(spans(F.transform(found, F.length)), lambda x: F.struct(
        F.xxhash64(F.slice(found, x[0] + 1, x[1])).alias("__window"), x[0].alias("__at"),
        x[1].alias("__width")))


def _spans(sizes: np.ndarray | None, min_chars: int) -> list[list[int]]:
    """First line and number of lines of the windows of `_chains`."""
    n = 0 if sizes is None else len(sizes)
    if n <= WIDTH:
        return []
    total = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    short = np.flatnonzero(total[WIDTH:] - total[:-WIDTH] < min_chars)
    ends = np.searchsorted(total, total[short] + min_chars, side="left")
    begins = np.searchsorted(total, total[short + WIDTH] - min_chars, side="right") - 1
    found = {(a, e - a) for a, e in zip(short.tolist(), ends.tolist()) if e <= n}
    found |= {(a, e - a) for a, e in zip(begins.tolist(), (short + WIDTH).tolist()) if a >= 0}
    return [list(x) for x in sorted(found)]


@F.pandas_udf(StringType())
def without_lines(texts: pd.Series, starts: pd.Series) -> pd.Series:
    """Each text without the lines that the windows at `starts` cover; None where there are none."""
    out = []
    for text, begins in zip(texts, starts):
        if text is None or begins is None:
            out.append(None)
            continue
        covered = {int(b) + k for b in begins for k in range(WIDTH)}
        kept, n = [], 0
        for line in _LINE_END.split(text):
            if line.strip(SPACES):
                if n not in covered:
                    kept.append(line)
                n += 1
            else:
                kept.append(line)
        out.append("".join(kept))
    return pd.Series(out, dtype=object)


def remove_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                          min_chars: int = MIN_CHARS, removed_col: str | None = None,
                          chains: bool = False) -> DataFrame:
    """`docs` with repeated passages taken out of the text, and all other columns as they are.

    A window is three consecutive non-blank lines of at least `min_chars` characters together,
    compared without surrounding white space. Its first occurrence, by id (NULL first), hash of the
    text and position, stays; every later one covers its lines, and covered lines are removed as a
    union. Texts of fewer than three lines, NULL and empty ones are left as they are; a text can
    become empty. Rows equal in id and text count as one document, so neither loses lines to the
    other. `removed_col` adds the number of lines removed, in place of a column of that name. With `chains`, more than three short lines
    that reach `min_chars` together are windows too, so any repeated passage of three or more whole
    lines with that many characters is removed.

    One shuffle of hashes alone tells which windows repeat (`repeated_rows`); only those are shuffled
    with their places and meet the first of their kind, a join that adaptive execution splits where
    one window is very common. Hashes have 64 bits: of n windows about n / 2**64 of them
    are taken for a repeat by chance.
    """
    row = docs.select(F.col(id_col).alias("__id"), F.xxhash64(id_col, text_col).alias("__key"),
                      lines(F.col(text_col)).alias("__lines"))
    windows = row.select("__id", "__key", F.posexplode(_windows(F.col("__lines"), min_chars))
                         .alias("__at", "__window")).filter(F.col("__window").isNotNull())
    if chains:
        longer = row.select("__id", "__key", F.inline(_chains(F.col("__lines"), min_chars)))
        windows = windows.withColumn("__width", F.lit(WIDTH)).unionByName(longer)
    windows = written(repeated_rows(written(windows, "line-all"), "__window"), "line-windows")
    place = F.struct("__id", "__key", "__at")
    repeated = written(windows.groupBy("__window").agg(
        F.count(F.lit(1)).alias("__n"), F.min(place).alias("__first")
    ).filter(F.col("__n") > 1).drop("__n"), "line-firsts")
    later = windows.join(repeated, "__window").filter(place > F.col("__first"))
    later = later.select("__id", "__key", F.explode(F.sequence(
        "__at", F.col("__at") + F.col("__width") - WIDTH)).alias("__at")) if chains else later
    covered = later.groupBy(F.col("__id").alias("__doc"), F.col("__key").alias("__doc_key")).agg(
        F.sort_array(F.collect_set("__at")).alias("__starts"))
    joined = docs.withColumn("__own", F.xxhash64(id_col, text_col)).join(
        covered, (F.col("__own") == F.col("__doc_key")) & F.col(id_col).eqNullSafe(F.col("__doc")),
        "left")
    fresh = without_lines(F.when(F.col("__starts").isNotNull(), F.col(text_col)), F.col("__starts"))
    out = [F.coalesce(fresh, F.col(text_col)).alias(text_col) if c == text_col else F.col(c)
           for c in docs.columns if c != removed_col]
    if removed_col:
        out.append(_covered_lines(F.col("__starts")).alias(removed_col))
    return joined.select(*out)


def _covered_lines(starts: Column) -> Column:
    """Lines covered by windows at sorted starts: each adds what the one before leaves free."""
    steps = F.aggregate(
        starts, F.struct(F.lit(-WIDTH).alias("last"), F.lit(0).cast("long").alias("n")),
        lambda a, s: F.struct(s.alias("last"), (a["n"] + F.least(
            F.lit(WIDTH), s - a["last"])).cast("long").alias("n")))
    return F.when(starts.isNull(), F.lit(0).cast("long")).otherwise(steps["n"])
