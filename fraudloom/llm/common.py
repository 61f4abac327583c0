"""Shared helpers: reading columns, batches of texts, labelled samples, written intermediates."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from fraudloom.session import shared_dir

SPACES = " \t\n\v\f\r"
WORD = re.compile(r"\w+")
BATCH_CHARS = 4_000_000


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes `df` to the shared folder and reads it back: later steps neither repeat it nor
    depend on an executor that may be lost."""
    path = shared_dir(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def id_hash_mod(doc_id: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo; NULL without an id."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % modulus


def in_pieces(batches: Iterator[pa.RecordBatch], text: str = "text",
              chars: int = BATCH_CHARS) -> Iterator[pa.RecordBatch]:
    """Cuts Arrow batches so that few long texts are held as Python objects at a time."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.cumsum(np.asarray(pc.fill_null(
            pc.binary_length(batch.column(batch.schema.get_field_index(text))), 0)))
        begin = 0
        while begin < batch.num_rows:
            base = sizes[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(sizes, base + chars, side="right")))
            yield batch.slice(begin, end - begin)
            begin = end


def map_texts(docs: DataFrame, keep: list[str], text_col: str, per_batch: Callable,
              schema: str) -> DataFrame:
    """Runs `per_batch(texts, kept columns) -> dict of columns` over every text, in bounded pieces.

    A NULL text is passed as an empty one.
    """
    wanted = docs.select(*[F.col(c) for c in keep], F.col(text_col).alias("__text"))
    out = docs.sparkSession.createDataFrame([], schema).schema
    arrow = to_arrow(out)

    def run(batches):
        for piece in in_pieces(batches, "__text"):
            columns = {name: piece.column(i) for i, name in enumerate(piece.schema.names)}
            texts = [t or "" for t in columns.pop("__text").to_pylist()]
            result = per_batch(texts, columns)
            yield pa.RecordBatch.from_arrays(
                [as_arrow(result[f.name], f.type) for f in arrow], schema=arrow)

    return wanted.mapInArrow(run, out)


def to_arrow(schema) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def as_arrow(values, kind: pa.DataType) -> pa.Array:
    if isinstance(values, pa.Array):
        return values if values.type == kind else values.cast(kind)
    return pa.array(values, type=kind)


def word_hashes(text: str) -> np.ndarray:
    """A 64-bit hash of each lower-case word."""
    words = WORD.findall(text.lower())
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


# Character classes; the value of a word is the union of the classes of its characters.
LOWER, UPPER, DIGIT, MARK, SHOUT, STOP, OTHER = 1, 2, 4, 8, 16, 32, 64
SHAPES = 128
_TABLE_SIZE = 0x3000


def _class_of(char: str) -> int:
    if char in "#*$%&|<>@^~=+_{}[]\\/":
        return MARK
    if char in "!?":
        return SHOUT
    if char in ".,;:'\"()-":
        return STOP
    if char.isspace():
        return 0
    if char.isdigit():
        return DIGIT
    if char.isupper():
        return UPPER
    return LOWER if char.isalpha() else OTHER


CLASSES = np.array([_class_of(chr(i)) for i in range(_TABLE_SIZE)], np.uint8)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def char_classes(points: np.ndarray) -> np.ndarray:
    """Characters beyond the table count as lower-case letters."""
    classes = CLASSES[np.minimum(points, _TABLE_SIZE - 1)]
    classes[points >= _TABLE_SIZE] = LOWER
    return classes


def word_shapes(classes: np.ndarray) -> np.ndarray:
    """One class union per word."""
    filled = classes != 0
    if not filled.any():
        return np.zeros(0, np.uint8)
    starts = np.flatnonzero(filled & ~np.concatenate([[False], filled[:-1]]))
    return np.bitwise_or.reduceat(classes, starts)


def labelled_ids(labels: DataFrame, label_col: str, id_col: str, train: Column) -> DataFrame:
    """One row of `__id` and `__label` per labelled id of the rows where `train` holds.

    Rows without id or label are left out; of contradicting labels the largest counts.
    """
    return labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).filter(
        train).groupBy(F.col(id_col).alias("__id")).agg(F.max(label_col).cast("int").alias("__label"))


def labelled_sample(labels: DataFrame, label_col: str, id_col: str, per_class: int,
                    train: Column) -> tuple[DataFrame, dict[int, float]]:
    """At most `per_class` of the `labelled_ids` of each class, in the order of a hash of the id, and
    the weight that gives each class its true share back."""
    rows = labelled_ids(labels, label_col, id_col, train)
    counts = {r["__label"]: r["count"] for r in rows.groupBy("__label").count().collect()}
    parts = [rows.filter(F.col("__label") == k).orderBy(F.xxhash64("__id"), "__id").limit(per_class)
             for k in (0, 1)]
    weights = {k: max(1.0, n / per_class) for k, n in counts.items()}
    return parts[0].unionAll(parts[1]), weights


def sampled_documents(docs: DataFrame, sample: DataFrame, id_col: str) -> DataFrame:
    """The documents of a bounded sample of ids, found without shuffling a text."""
    return docs.join(F.broadcast(sample), docs[id_col] == F.col("__id"))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def newton(sums: Callable, ridge: np.ndarray, steps: int = 25) -> np.ndarray:
    """The coefficients of a regularised logistic regression by Newton steps.

    `sums(beta)` gives the matrix of second derivatives and the gradient, summed over all rows.
    """
    beta = np.zeros(len(ridge))
    for _ in range(steps):
        h, g = sums(beta)
        step = np.linalg.solve(h + np.diag(ridge + 1e-9), g - ridge * beta)
        beta += step * min(1.0, 5 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-7:
            break
    return beta


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, l2: float = 1.0,
                 steps: int = 25) -> np.ndarray:
    """Weights and, last, the intercept of an L2-regularised logistic regression, by Newton steps."""
    x1 = np.concatenate([x, np.ones((len(x), 1))], axis=1).astype(np.float64)
    ridge = np.full(x1.shape[1], l2)
    ridge[-1] = 1e-6

    def sums(beta):
        p = sigmoid(x1 @ beta)
        return (x1 * (weight * p * (1 - p))[:, None]).T @ x1, x1.T @ (weight * (y - p))

    return newton(sums, ridge, steps)


def auc(score: np.ndarray, y: np.ndarray) -> float:
    order = np.argsort(score, kind="stable")
    ranks = np.empty(len(score))
    ranks[order] = np.arange(1, len(score) + 1)
    _, inverse, count = np.unique(score, return_inverse=True, return_counts=True)
    ranks = (np.bincount(inverse, ranks) / count)[inverse]
    pos = y.sum()
    return float((ranks[y == 1].sum() - pos * (pos + 1) / 2) / max(1, pos * (len(y) - pos)))
