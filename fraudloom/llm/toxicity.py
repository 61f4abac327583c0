"""Toxicity of whole texts by a convolutional classifier over hashed word embeddings.

Each word has three embeddings side by side, found by hashes of the word and of its first four and
five characters, so that inflected forms share what is learned; filters over one, two and three
words run over the text, the largest value of each filter goes into a logistic layer.
Words are counted, weights learned, scores calibrated and thresholds set over all labelled rows, in
the tasks: each pass trains one copy of the classifier a shard of rows, and the copies are averaged.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from math import prod

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window, functions as F

from fraudloom.llm.common import (
    WORD, in_pieces, labelled_ids, map_texts, newton, sigmoid, written,
)
from fraudloom.llm.spaced_seeds import bit_array, bits_for, held

BUCKET_BITS = 15
#: Hashed parts of a word (None: all of it) and numbers in the embedding of each.
PARTS, SIZE = (None, 4, 5), 5
#: Words whose hashes a worker remembers.
REMEMBERED = 200_000
WIDTHS = (1, 2, 3)
FILTERS = 8
EPOCHS, DOCS_PER_STEP, RATE = 6, 64, 0.05
#: A step takes fewer documents where they hold more words than this together.
WORDS_PER_STEP = 200_000
#: One in so many ids, by hash, sets the calibration and the thresholds, not the weights.
CALIBRATION_SHARE = 4
#: Rows that one copy of the classifier learns from in a pass, about.
SHARD_ROWS = 6000
#: Shards that rows of one id are dealt over at most.
SALTS = 8
#: Numbers of a vector that are added up together.
SLICE = 2048
#: Rows of each embedding table, and the shapes of all weights: embedding, kernels, biases, output.
ROWS = (1 << BUCKET_BITS) + 1
SHAPES = [(len(PARTS), ROWS, SIZE), *((w, SIZE * len(PARTS), FILTERS) for w in WIDTHS),
          *((FILTERS,) for _ in WIDTHS), (len(WIDTHS) * FILTERS + 1,)]
#: A language needs so many calibration rows of each label for a threshold of its own.
LEAST_ROWS = 20


@dataclass
class Classifier:
    """Weights. `thresholds` by language; `threshold` for languages without one of their own."""

    embedding: np.ndarray
    kernels: list[np.ndarray]
    bias: list[np.ndarray]
    out: np.ndarray
    calibration: tuple[float, float] = (1.0, 0.0)
    threshold: float = 0.5
    thresholds: dict[str, float] = field(default_factory=dict)

    def score(self, docs: list[np.ndarray]) -> np.ndarray:
        if not docs:
            return np.zeros(0)
        raw = forward(self, *pad(docs))[0]
        a, b = self.calibration
        return sigmoid(a * raw + b)


class _Rows(dict):
    """Embedding rows of words, packed into one number, computed at first sight."""

    def __missing__(self, word: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        packed = 0
        for size in reversed(PARTS):
            part = xxhash.xxh64_intdigest(word if size is None else word[:size], seed=size or 0)
            packed = packed << BUCKET_BITS | part & ((1 << BUCKET_BITS) - 1)
        self[word] = packed
        return packed


_ROWS = _Rows()


def buckets(text: str) -> np.ndarray:
    """One embedding row per word and part (row 0 is the padding)."""
    words = WORD.findall(text.lower())
    packed = np.fromiter(map(_ROWS.__getitem__, words), np.int64, len(words))
    mask = (1 << BUCKET_BITS) - 1
    return np.stack([1 + ((packed >> (BUCKET_BITS * k)) & mask) for k in range(len(PARTS))],
                    axis=1).astype(np.int32)


def pad(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """All documents in one array, each followed by padding so that no window reaches the next."""
    gap = np.zeros((max(WIDTHS), len(PARTS)), np.int32)
    words = np.concatenate([part for d in docs for part in (d, gap)])
    ends = np.cumsum([len(d) + len(gap) for d in docs])
    return words, np.concatenate([[0], ends[:-1]]).astype(np.int64)


def embed(model: Classifier, words: np.ndarray) -> np.ndarray:
    return np.concatenate([table[words[:, k]] for k, table in enumerate(model.embedding)], axis=1)


def forward(model: Classifier, words: np.ndarray, starts: np.ndarray):
    """Logits, pooled values and where each of them comes from."""
    x = embed(model, words)
    pooled, at = [], []
    for width, kernel, bias in zip(WIDTHS, model.kernels, model.bias):
        n = len(x) - width + 1
        value = x[:n] @ kernel[0]
        for k in range(1, width):
            value += x[k:k + n] @ kernel[k]
        value = np.concatenate([value, np.full((width - 1, FILTERS), -np.inf, np.float32)])
        best = np.maximum.reduceat(value, starts, axis=0)
        pooled.append(np.maximum(best + bias, 0))
        at.append((value, best))
    features = np.concatenate(pooled, axis=1)
    return features @ model.out[:-1] + model.out[-1], features, at, x


def views(flat: np.ndarray) -> list[np.ndarray]:
    """The arrays of weights that lie one after the other in `flat`."""
    ends = np.cumsum([prod(shape) for shape in SHAPES])
    return [part.reshape(shape) for part, shape in zip(np.split(flat, ends[:-1]), SHAPES)]


def classifier(flat: np.ndarray) -> Classifier:
    embedding, *rest = views(flat)
    n = len(WIDTHS)
    return Classifier(embedding, rest[:n], rest[n:2 * n], rest[2 * n])


def held_by(docs: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    """By label (0, 1) and part, how many of the documents hold each row of the embedding; last, in
    row 0, which is the padding, how many documents there are."""
    total = np.zeros((2, len(PARTS), ROWS), np.int64)
    for doc, y in zip(docs, labels):
        for side in range(len(PARTS)):
            total[y, side, np.unique(doc[:, side])] += 1
    total[:, :, 0] = [[(labels == k).sum()] * len(PARTS) for k in (0, 1)]
    return total


def initial(counts: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Weights before training, from the counts of `held_by`.

    The first coordinate of every embedding starts as how much more of the toxic texts hold the
    word, in standard deviations; everything else starts random.
    """
    flat = np.zeros(sum(prod(shape) for shape in SHAPES), np.float32)
    model = classifier(flat)
    for side in range(len(PARTS)):
        model.embedding[side] = rng.normal(0, 0.05, (ROWS, SIZE))
        clean, toxic = counts[0, side], counts[1, side]
        a, b = max(1, toxic[0]), max(1, clean[0])
        p, q = (toxic + 0.5) / (a + 1), (clean + 0.5) / (b + 1)
        z = (p - q) / np.sqrt(p * (1 - p) / a + q * (1 - q) / b + 1e-9)
        model.embedding[side][:, 0] = np.clip(z / 4, -1, 2)
        model.embedding[side][0] = 0
    for kernel in model.kernels:
        kernel[:] = rng.normal(0, 0.3, kernel.shape)
        kernel[:, ::SIZE, 0] = 0.5 / len(kernel)
    model.out[:] = np.concatenate([rng.normal(0, 0.3, len(WIDTHS) * FILTERS), [-1.0]])
    model.out[[k * FILTERS for k in range(len(WIDTHS))]] = 0.5
    return flat


def learn(flat: np.ndarray, squares: np.ndarray, docs: list[np.ndarray], labels: np.ndarray,
          weight: np.ndarray) -> None:
    """One step of Adagrad over the largest values only: the gradient touches one window per filter
    and text. Weights and sums of squares change in place."""
    model, state, sides = classifier(flat), classifier(squares), range(len(PARTS))

    def step(value, own, grad):
        own += grad * grad
        value -= RATE * grad / np.sqrt(own)

    words, starts = pad(docs)
    raw, features, tops, x = forward(model, words, starts)
    g = ((sigmoid(raw) - labels) * weight / len(docs)).astype(np.float32)
    d_features = g[:, None] * model.out[None, :-1] * (features > 0)
    step(model.out, state.out, np.concatenate([features.T @ g, [g.sum()]]).astype(np.float32)
         + 1e-4 * model.out)
    d_rows, d_values = [[] for _ in sides], [[] for _ in sides]
    ends = np.concatenate([starts[1:], [len(words)]])
    for i, (width, kernel, (value, best)) in enumerate(zip(WIDTHS, model.kernels, tops)):
        d = d_features[:, i * FILTERS:(i + 1) * FILTERS]
        grad = np.zeros_like(kernel)
        top = np.stack([a + value[a:b].argmax(axis=0) for a, b in zip(starts, ends)])
        live = np.nonzero(d)
        top, pull = top[live], d[live][:, None]
        spread = np.eye(FILTERS, dtype=np.float32)[live[1]] * pull
        for k in range(width):
            grad[k] = x[top + k].T @ spread
            dx = kernel[k][:, live[1]].T * pull
            for side in sides:
                d_rows[side].append(words[top + k, side])
                d_values[side].append(dx[:, side * SIZE:(side + 1) * SIZE])
        step(kernel, state.kernels[i], grad)
        step(model.bias[i], state.bias[i], d.sum(axis=0))
    for side in sides:
        rows, inverse = np.unique(np.concatenate(d_rows[side]), return_inverse=True)
        total = np.zeros((len(rows), SIZE), np.float32)
        np.add.at(total, inverse, np.concatenate(d_values[side]))
        total[rows == 0] = 0
        own = state.embedding[side]
        own[rows] += total * total
        model.embedding[side][rows] -= RATE * total / np.sqrt(own[rows])


def train(docs: list[np.ndarray], labels: np.ndarray, weight: np.ndarray, seed: int = 7) -> Classifier:
    """A classifier of few documents, without Spark."""
    rng = np.random.default_rng(seed)
    flat = initial(held_by(docs, labels.astype(int)), rng)
    squares = np.full_like(flat, 1e-3)
    order = np.arange(len(docs))
    for _ in range(EPOCHS):
        rng.shuffle(order)
        for at in range(0, len(order), DOCS_PER_STEP):
            own = order[at:at + DOCS_PER_STEP]
            learn(flat, squares, [docs[i] for i in own], labels[own], weight[own])
    return classifier(flat)


def steps(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
    """Documents and labels of bounded steps, as rows come."""
    docs, labels, words = [], [], 0
    for piece in in_pieces(batches, "__words"):
        for packed, y in zip(piece.column("__words"), piece.column("__label").to_pylist()):
            doc = np.frombuffer(packed.as_buffer(), np.uint16).reshape(-1, len(PARTS)).astype(np.int32)
            if docs and (len(docs) == DOCS_PER_STEP or words + len(doc) > WORDS_PER_STEP):
                yield docs, np.array(labels)
                docs, labels, words = [], [], 0
            docs.append(doc)
            labels.append(y)
            words += len(doc)
    if docs:
        yield docs, np.array(labels)


def added_up(rows: DataFrame, per_task: Callable, add: Callable, kind: type) -> list[np.ndarray]:
    """Arrays of equal shape, one a task, put together slice by slice.

    `per_task(steps)` makes one of type `kind` from the rows of a task, its last axis is cut into
    slices; `add(slices)` gets the same one of each, flat and in the order of shards. Only what that
    returns meets in the driver.
    """
    def run(batches):
        first = []

        def noted():
            for batch in batches:
                if batch.num_rows and not first:
                    first.append(batch.column("__shard")[0].as_py())
                yield batch

        made = per_task(steps(noted()))
        if first:
            cuts = list(range(0, made.shape[-1], SLICE))
            yield pa.RecordBatch.from_pydict({
                "at": pa.array(cuts, pa.int32()), "shard": pa.array([first[0]] * len(cuts), pa.int32()),
                "values": pa.array([made[..., at:at + SLICE].tobytes() for at in cuts], pa.binary())})

    def together(table):
        table = table.sort_by("shard")
        total = add([np.frombuffer(v.as_buffer(), kind) for v in table.column("values")])
        return pa.table({"at": table.column("at")[:1],
                         "values": pa.array([total.astype(kind).tobytes()], pa.binary())})

    got = rows.select("__shard", "__label", "__words").mapInArrow(
        run, "at int, shard int, values binary").groupBy("at").applyInArrow(
        together, "at int, values binary").collect()
    return [np.frombuffer(r["values"], kind) for r in sorted(got, key=lambda r: r["at"])]


def count_words(rows: DataFrame) -> np.ndarray:
    """`held_by` of all rows."""
    def run(found):
        total = np.zeros((2, len(PARTS), ROWS), np.int64)
        for docs, labels in found:
            total += held_by(docs, labels)
        return total

    parts = added_up(rows, run, sum, np.int64)
    return np.concatenate([p.reshape(2, len(PARTS), -1) for p in parts], axis=2)


def one_pass(rows: DataFrame, flat: np.ndarray, squares: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights and sums of squares after every shard went over its rows once, in the order they have.

    A number changes by the mean over the shards that moved it, so what a rare word learns in few
    shards is not thinned by all the others.
    """
    shared = rows.sparkSession.sparkContext.broadcast((flat, squares))

    def run(found):
        before = shared.value
        after = before[0].copy(), before[1].copy()
        for docs, labels in found:
            learn(*after, docs, labels, np.ones(len(docs)))
        return np.stack(after) - np.stack(before)

    def mean(parts):
        total, moved = 0.0, 0
        for p in parts:
            total, moved = total + p.reshape(2, -1).astype(float), moved + (p.reshape(2, -1)[1] > 0)
        return total / np.maximum(moved, 1)

    parts = added_up(rows, run, mean, np.float32)
    shared.destroy()
    change = np.concatenate([p.reshape(2, -1) for p in parts], axis=1)
    return flat + change[0], squares + change[1]


def raw_scores(rows: DataFrame, model: Classifier) -> DataFrame:
    """`label`, `lang` and the `raw` score of each row, written."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for piece in in_pieces(batches, "__words"):
            raw = np.concatenate([forward(shared.value, *pad(docs))[0] for docs, _ in steps([piece])])
            yield pa.RecordBatch.from_arrays(
                [piece.column("__label"), piece.column("__lang"), pa.array(raw.astype(np.float32))],
                ["label", "lang", "raw"])

    return written(rows.select("__label", "__lang", "__words").mapInArrow(
        run, "label int, lang string, raw float"), "toxicity-scores")


def calibrate(scores: DataFrame) -> tuple[float, float]:
    """Slope and intercept that turn raw scores into probabilities; every row counts in each step."""
    def sums(beta):
        x = F.col("raw").cast("double")
        z = F.least(F.greatest(x * float(beta[0]) + float(beta[1]), F.lit(-30.0)), F.lit(30.0))
        p = 1 / (1 + F.exp(-z))
        v, r = p * (1 - p), F.col("label") - p
        xx, x1, one, gx, g1 = scores.agg(*[F.sum(c) for c in (v * x * x, v * x, v, x * r, r)]).first()
        return np.array([[xx, x1], [x1, one]]), np.array([gx, g1])

    a, b = newton(sums, np.array([0.01, 1e-6]))
    return max(float(a), 0.01), float(b)


def best_thresholds(scores: DataFrame) -> dict[str | None, float]:
    """By language, and for all rows together under None, the threshold of `score` with the largest
    F1 on all rows, in the middle of the gap below it.

    Rows are added up by score first. Running sums go by ranges of scores, so that a language with
    most rows spans many tasks. Languages with fewer than LEAST_ROWS of a label are left out.
    """
    sums = scores.withColumn("__own", F.explode(F.array(
        F.struct(F.lit(True).alias("all"), F.lit("").alias("lang")),
        F.struct(F.lit(False).alias("all"), F.col("lang").alias("lang"))))).filter(
        F.col("__own.lang").isNotNull()).groupBy("__own", "score").agg(
        F.sum("label").alias("__hit"), F.count(F.lit(1)).alias("__n"))
    down = F.col("score").desc()
    cut = written(sums.repartitionByRange("__own", down).sortWithinPartitions("__own", down).withColumn(
        "__part", F.shiftright(F.monotonically_increasing_id(), 33)), "toxicity-cuts")
    whole = Window.partitionBy("__own")
    before = whole.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = cut.groupBy("__own", "__part").agg(F.sum("__hit").alias("__h"), F.sum("__n").alias("__t")).select(
        "__own", "__part", F.coalesce(F.sum("__h").over(before), F.lit(0)).alias("__hits_before"),
        F.coalesce(F.sum("__t").over(before), F.lit(0)).alias("__before"),
        F.sum("__h").over(whole).alias("__toxic"), F.sum("__t").over(whole).alias("__rows"))
    inside = Window.partitionBy("__own", "__part").orderBy(down).rowsBetween(Window.unboundedPreceding, 0)
    hits = F.col("__hits_before") + F.sum("__hit").over(inside)
    taken = F.col("__before") + F.sum("__n").over(inside)
    enough = F.least("__toxic", F.col("__rows") - F.col("__toxic")) >= LEAST_ROWS
    best = cut.join(starts, ["__own", "__part"]).filter(F.col("__own.all") | enough).select(
        "__own", F.struct((2 * hits / (taken + F.col("__toxic"))).alias("f1"), "score").alias("__best")).groupBy(
        "__own").agg(F.max("__best")["score"].alias("__at"))
    below = cut.join(best, "__own").groupBy("__own", "__at").agg(
        F.max(F.when(F.col("score") < F.col("__at"), F.col("score"))).alias("__next"))
    return {None if r["__own"]["all"] else r["__own"]["lang"]:
            r["__at"] if r["__next"] is None else (r["__at"] + r["__next"]) / 2 for r in below.collect()}


def labelled_words(docs: DataFrame, ids: DataFrame, id_col: str, text_col: str, lang_col: str | None,
                   shards: int) -> DataFrame:
    """Embedding rows, label and shard of every document with a label.

    Documents are tested against a bit array of the labelled ids, of at most 16 MB, before their
    words are hashed; no text is shuffled. Words and labels are dealt out to the shards by id, rows of
    one id over SALTS of them at most, and meet in a window, as a join would choose its own partitions.
    """
    same = docs.schema[id_col].dataType == ids.schema["__id"].dataType
    bits = bits_for(ids.count())
    table = docs.sparkSession.sparkContext.broadcast(
        bit_array(ids.select(F.xxhash64("__id").alias("seed")), bits) if same else None)
    frame = docs.select(
        F.col(id_col).alias("__id"), F.xxhash64(id_col).alias("__seed"),
        F.xxhash64(id_col, text_col).alias("__key"), F.col(text_col).alias("__t"),
        (F.col(lang_col).cast("string") if lang_col else F.lit(None).cast("string")).alias("__lang"))

    def run(texts, kept):
        seeds = np.asarray(kept.pop("__seed")).view(np.uint64)
        at = np.arange(len(texts)) if table.value is None else held(table.value, bits, seeds)
        return {**{name: column.take(pa.array(at)) for name, column in kept.items()},
                "__words": [buckets(texts[i]).astype(np.uint16).tobytes() for i in at]}

    kind = docs.schema[id_col].dataType.simpleString()
    words = map_texts(frame, ["__id", "__seed", "__key", "__lang"], "__t", run,
                      f"__id {kind}, __key long, __lang string, __words binary").withColumn(
        "__salt", F.pmod("__key", F.lit(SALTS)).cast("int"))
    facts = ids.select("__id", F.struct("__label", "__aside").alias("__fact"),
                       F.explode(F.array(*[F.lit(i) for i in range(SALTS)])).alias("__salt"))
    own = Window.partitionBy("__id", "__salt")
    return words.unionByName(facts, allowMissingColumns=True).repartition(shards, "__id", "__salt").withColumn(
        "__fact", F.max("__fact").over(own)).filter(
        F.col("__words").isNotNull() & F.col("__fact").isNotNull()).select(
        "__key", "__fact.__label", "__fact.__aside", "__lang", "__words",
        F.spark_partition_id().alias("__shard"))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "toxic", lang_col: str | None = "lang", train_rows: Column | None = None,
        seed: int = 7) -> Classifier:
    """Trains on all labelled documents among `train_rows`, in shards by a hash of id and text.

    A quarter of the ids is kept out of the weights: its documents calibrate scores to probabilities
    and set one threshold per language, unless they lack a label; then all rows do both. Without a
    labelled document of both classes the classifier scores everything 0.
    """
    ids = labelled_ids(labels, label_col, id_col, F.lit(True) if train_rows is None else train_rows).withColumn(
        "__aside", F.pmod(F.xxhash64("__id"), F.lit(CALIBRATION_SHARE)) == 0)
    counts = {(r["__label"], r["__aside"]): r["count"] for r in docs.select(F.col(id_col).alias("__doc")).join(
        ids, F.col("__doc") == F.col("__id")).groupBy("__label", "__aside").count().collect()}
    if len({label for label, _ in counts}) < 2:
        empty = train([np.zeros((1, len(PARTS)), np.int32)], np.zeros(1), np.ones(1))
        empty.calibration = (0.0, -30.0)
        return empty
    apart = {(0, True), (1, True)} < set(counts)
    rows = labelled_words(docs, ids, id_col, text_col, lang_col, -(-sum(counts.values()) // SHARD_ROWS))
    rows = rows.persist(StorageLevel.DISK_ONLY)
    try:
        inner, aside = (rows.filter(~F.col("__aside")), rows.filter("__aside")) if apart else (rows, rows)
        flat = initial(count_words(inner), np.random.default_rng(seed))
        squares = np.full_like(flat, 1e-3)
        for epoch in range(EPOCHS):
            mixed = inner.sortWithinPartitions(F.xxhash64("__key", F.lit(epoch)))
            flat, squares = one_pass(mixed, flat, squares)
        model = classifier(flat)
        scores = raw_scores(aside, model)
    finally:
        rows.unpersist()
    a, b = model.calibration = calibrate(scores)

    @F.pandas_udf("double")
    def score(raw: pd.Series) -> pd.Series:
        return pd.Series(sigmoid(a * raw.to_numpy() + b).astype(float))

    model.thresholds = best_thresholds(scores.withColumn("score", score("raw")))
    model.threshold = model.thresholds.pop(None)
    return model


def score_texts(docs: DataFrame, model: Classifier, keep: list[str], text_col: str = "text",
                lang_col: str | None = "lang") -> DataFrame:
    """The columns `keep`, `score` (0 to 1) of every whole text and `toxic`, whether it reaches the
    threshold of its language.

    The language chooses the threshold only; the score depends on the text alone. A NULL text or
    one without words scores as the padding does; an unknown or NULL language takes the common
    threshold. Columns not named are left out, rows that repeat are scored each.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    frame = docs.select(*keep, (F.col(lang_col).cast("string") if lang_col else F.lit(None).cast(
        "string")).alias("__lang"), F.col(text_col).alias("__t"))

    def run(texts, kept):
        known = shared.value
        langs = kept.pop("__lang").to_pylist()
        scores = [known.score([buckets(t) for t in texts[i:i + 64]])
                  for i in range(0, len(texts), 64)]
        score = np.concatenate(scores)
        limit = np.array([known.thresholds.get(x, known.threshold) for x in langs])
        return {**kept, "score": score.astype(float), "toxic": score >= limit}

    return map_texts(frame, [*keep, "__lang"], "__t", run,
                     f"{kinds + ', ' if keep else ''}score double, toxic boolean")
