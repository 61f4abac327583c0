"""Removal of repeated runs of words, wherever lines and sentences end.

Every run of `RUN` words holds a gram of `GRAM` words that has the smallest hash among the
`RUN - GRAM + 1` grams in it. Choosing these everywhere, a run that occurs twice has the same chosen
gram in both places, so only the neighbourhood of chosen grams that repeat is looked at run by run.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StringType

from fraudloom.llm.common import map_texts, written
from fraudloom.llm.repeats import repeated_rows

RUN, GRAM = 50, 25
#: Scripts written without spaces: each of their characters counts as a word.
_UNSPACED = ("\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff"
             "\U00020000-\U0003ffff")
WORD = re.compile(f"[{_UNSPACED}]|[^ \t\n\v\f\r{_UNSPACED}]+")
_BASE = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str) -> list[tuple[int, int]]:
    """Begin and end of each word."""
    return [m.span() for m in WORD.finditer(text)]


def _word_hashes(text: str, spans: list[tuple[int, int]], seen: dict) -> np.ndarray:
    out = np.empty(len(spans), np.uint64)
    for i, (a, b) in enumerate(spans):
        word = text[a:b]
        value = seen.get(word)
        if value is None:
            if len(seen) > 200_000:
                seen.clear()
            value = seen[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        out[i] = value
    return out


def run_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of each run of `width` words, in order."""
    if len(hashes) < width:
        return np.zeros(0, np.uint64)
    n = len(hashes) - width + 1
    out = np.zeros(n, np.uint64)
    for k in range(width):
        mixed = hashes[k:k + n] ^ (hashes[k:k + n] >> np.uint64(29))
        out = (out ^ (out >> np.uint64(32))) * _BASE + mixed
    return (out ^ (out >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)


def chosen(grams: np.ndarray, width: int = RUN - GRAM + 1) -> np.ndarray:
    """Positions that hold the smallest value of some `width` neighbours, the first of equal ones."""
    if len(grams) < width:
        return np.zeros(0, np.int64)
    views = np.lib.stride_tricks.sliding_window_view(grams, width)
    at = np.concatenate([views[i:i + 8192].argmin(axis=1) for i in range(0, len(views), 8192)])
    return np.unique(at + np.arange(len(views)))


def _placed(kept: dict, ids: list[str], counts: list[int], **values) -> dict:
    """The id columns repeated for each row's values."""
    at = pa.array(np.repeat(np.arange(len(counts)), counts))
    return {**{c: kept[c].take(at) for c in ids}, **{
        k: np.concatenate(v) if v else np.zeros(0, np.int64) for k, v in values.items()}}


def _grams(texts: list[str], kept: dict) -> dict:
    seen, values, places = {}, [], []
    for text in texts:
        grams = run_hashes(_word_hashes(text, words_of(text), seen), GRAM)
        places.append(chosen(grams))
        values.append(grams[places[-1]].view(np.int64))
    return _placed(kept, ["__id", "__key"], [len(p) for p in places], gram=values, at=places)


def _runs(texts: list[str], kept: dict) -> dict:
    """Hashes of the runs that hold a repeated gram."""
    seen, values, places = {}, [], []
    for text, near in zip(texts, kept["near"].to_pylist()):
        runs = run_hashes(_word_hashes(text, words_of(text), seen), RUN)
        wanted = np.zeros(len(runs), bool)
        for at in near:
            wanted[max(0, at - (RUN - GRAM)):at + 1] = True
        places.append(np.flatnonzero(wanted))
        values.append(runs[places[-1]].view(np.int64))
    return _placed(kept, ["__id", "__key"], [len(p) for p in places], run=values, at=places)


@F.pandas_udf(StringType())
def _without_runs(texts: pd.Series, starts: pd.Series) -> pd.Series:
    """Each text without the words of the runs at `starts` and the space after them; None where there
    are none."""
    out = []
    for text, begins in zip(texts, starts):
        if text is None or begins is None:
            out.append(None)
            continue
        spans = words_of(text)
        step = np.zeros(len(spans) + 1, np.int64)
        np.add.at(step, np.asarray(begins, np.int64), 1)
        np.add.at(step, np.asarray(begins, np.int64) + RUN, -1)
        gone = np.cumsum(step)[:-1] > 0
        kept, at = [], 0
        for i in np.flatnonzero(gone).tolist():
            kept.append(text[at:max(at, spans[i][0])])
            at = spans[i + 1][0] if i + 1 < len(spans) else len(text)
        out.append("".join(kept) + text[at:])
    return pd.Series(out, dtype=object)


def remove_repeated_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` without the words of every run of `RUN` words that occurs before, and all other columns
    as they are.

    Words are compared as written, whatever white space is between them. The first occurrence, by id
    (NULL first), hash of the text and position, stays; all words of later ones are removed, except
    where the two overlap in one text. Rows equal in id and text count as one document. A text can
    become empty. Shorter runs stay.
    """
    kinds = docs.select(F.col(id_col).alias("__id")).dtypes[0][1]
    row = docs.select(F.col(id_col).alias("__id"), F.xxhash64(id_col, text_col).alias("__key"),
                      F.col(text_col).alias("__text"))
    grams = written(map_texts(row, ["__id", "__key"], "__text", _grams,
                              f"__id {kinds}, __key long, gram long, at int"), "run-grams")
    near = repeated_rows(grams, "gram").groupBy(
        F.col("__id").alias("__doc"), F.col("__key").alias("__doc_key")).agg(
        F.collect_set("at").alias("near"))
    touched = row.join(near, (F.col("__key") == F.col("__doc_key")) & F.col("__id").eqNullSafe(
        F.col("__doc")))
    runs = written(map_texts(touched, ["__id", "__key", "near"], "__text", _runs,
                             f"__id {kinds}, __key long, run long, at int"), "run-hashes")
    place = F.struct("__id", "__key", "at")
    runs = written(repeated_rows(runs, "run"), "run-repeats")
    repeated = written(runs.groupBy("run").agg(F.count(F.lit(1)).alias("__n"), F.min(place).alias(
        "__first")).filter(F.col("__n") > 1).drop("__n"), "run-firsts")
    first = F.col("__first")
    apart = ~(F.col("__id").eqNullSafe(first["__id"]) & (F.col("__key") == first["__key"])) | (
        F.col("at") >= first["at"] + RUN)
    covered = runs.join(repeated, "run").filter((place > first) & apart).groupBy(
        F.col("__id").alias("__doc"), F.col("__key").alias("__doc_key")).agg(
        F.collect_set("at").alias("__starts"))
    joined = docs.withColumn("__own", F.xxhash64(id_col, text_col)).join(
        covered, (F.col("__own") == F.col("__doc_key")) & F.col(id_col).eqNullSafe(F.col("__doc")),
        "left")
    fresh = _without_runs(F.when(F.col("__starts").isNotNull(), F.col(text_col)), F.col("__starts"))
    return joined.select(*[F.coalesce(fresh, F.col(text_col)).alias(text_col) if c == text_col
                           else F.col(c) for c in docs.columns])
