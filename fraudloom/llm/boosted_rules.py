"""Quality rules: gradient-boosted trees over document statistics, with monotonic constraints."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from fraudloom.llm.common import (
    SHAPES, SPACES, char_classes, code_points, labelled_sample, map_texts, sampled_documents, sigmoid,
    word_shapes,
)

SYMBOLS = "#*$%&|<>"
WINDOW = 5
#: Statistics that the rules fix, and those derived from them for the trees, with the direction in
#: which quality may change: -1 never rises with it, 1 never falls, 0 free.
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
CONSTRAINTS = {
    "log_words": 0, "mean_word": 0, "symbol_share": -1, "dup_line_share": -1, "repeat_share": -1,
    "upper_share": -1, "mark_share": -1, "shout_share": -1, "same_as_last": -1, "distinct_share": 0,
}
FEATURES = tuple(CONSTRAINTS)
MIN_WORDS, MAX_REPEAT_PERCENT = 10, 20
BINS, DEPTH, TREES, RATE, LEAST_WEIGHT, L2 = 64, 3, 60, 0.15, 10.0, 1.0


def repeated_words(hashes: np.ndarray, width: int = WINDOW) -> int:
    """Words that lie in windows of `width` words that occur twice or more, the first included."""
    n = len(hashes) - width + 1
    if n < 2:
        return 0
    total = np.zeros(n, np.uint64)
    for k in range(width):
        total = total * np.uint64(0x9E3779B97F4A7C15) + hashes[k:k + n]
    _, inverse, count = np.unique(total, return_inverse=True, return_counts=True)
    begins = np.flatnonzero(count[inverse] > 1)
    if not len(begins):
        return 0
    step = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(step, begins, 1)
    np.add.at(step, begins + width, -1)
    return int((np.cumsum(step) > 0).sum())


def statistics(text: str) -> tuple[list[int], list[float]]:
    """The base statistics of a whole text and the features of the trees."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    chars = len(text) - sum(text.count(c) for c in SPACES)
    symbols = sum(map(text.count, SYMBOLS))
    lines = [line for line in raw.split(b"\n") if line.strip()]
    dup_lines = len(lines) - len(set(lines))
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, n)
    repeat = repeated_words(hashes)
    shapes = np.bincount(word_shapes(char_classes(code_points(text))), minlength=SHAPES)
    total = max(1, shapes.sum())
    kinds = np.arange(SHAPES)

    def share(bit: int, without: int = 0) -> float:
        return float(shapes[((kinds & bit) > 0) & ((kinds & without) == 0)].sum() / total)

    same = float((hashes[1:] == hashes[:-1]).sum()) if n > 1 else 0.0
    return [n, chars, symbols, dup_lines, repeat], [
        float(np.log1p(n)), chars / max(1, n), symbols / max(1, chars),
        dup_lines / max(1, len(lines)), repeat / max(1, n), share(2, 1), share(8), share(16),
        same / max(1, n), len(set(words)) / max(1, n) ** 0.7]


@dataclass
class Trees:
    """All trees as node arrays; a leaf points at itself. `roots` are where trees begin."""

    feature: np.ndarray
    limit: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    base: float
    threshold: float = 0.5

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1: every row walks all trees at once, level by level."""
        if not len(self.roots):
            return np.full(len(x), float(sigmoid(np.array(self.base))))
        at = np.broadcast_to(self.roots, (len(x), len(self.roots)))
        for _ in range(DEPTH):
            low = np.take_along_axis(x, self.feature[at], axis=1) <= self.limit[at]
            at = np.where(low, self.left[at], self.right[at])
        return sigmoid(self.base + self.value[at].sum(axis=1))


def grow(x: np.ndarray, y: np.ndarray, weight: np.ndarray, constraints: list[int],
         trees: int = TREES) -> Trees:
    """Boosts regression trees on the logistic loss over binned features.

    A split on a constrained feature must order its children that way, and each child's subtree
    stays on its side of their middle, so the whole sum is monotonic.
    """
    edges = [np.unique(np.quantile(col, np.linspace(0, 1, BINS + 1)[1:-1])) for col in x.T]
    binned = np.stack([np.searchsorted(e, col, side="left") for e, col in zip(edges, x.T)], axis=1)
    nodes: dict[str, list] = {k: [] for k in ("feature", "limit", "left", "right", "value")}
    roots = []
    mean = float(np.clip((weight * y).sum() / weight.sum(), 1e-4, 1 - 1e-4))
    base = float(np.log(mean / (1 - mean)))
    raw = np.full(len(y), base)

    def node() -> int:
        for k, v in (("feature", 0), ("limit", np.inf), ("left", 0), ("right", 0), ("value", 0.0)):
            nodes[k].append(v)
        n = len(nodes["value"]) - 1
        nodes["left"][n] = nodes["right"][n] = n
        return n

    def best(g, h, rows, low, high):
        G, H = g[rows].sum(), h[rows].sum()
        found = (1e-6, None)
        for f, kind in enumerate(constraints):
            if not len(edges[f]):
                continue
            size = len(edges[f]) + 1
            gl = np.cumsum(np.bincount(binned[rows, f], g[rows], size))[:-1]
            hl = np.cumsum(np.bincount(binned[rows, f], h[rows], size))[:-1]
            wl = np.cumsum(np.bincount(binned[rows, f], weight[rows], size))[:-1]
            vl = np.clip(-gl / (hl + L2), low, high)
            vr = np.clip(-(G - gl) / (H - hl + L2), low, high)
            gain = gl ** 2 / (hl + L2) + (G - gl) ** 2 / (H - hl + L2) - G ** 2 / (H + L2)
            bad = (wl < LEAST_WEIGHT) | (weight[rows].sum() - wl < LEAST_WEIGHT)
            if kind:
                bad |= kind * (vr - vl) < 0
            gain = np.where(bad, 0, gain)
            k = int(np.argmax(gain))
            if gain[k] > found[0]:
                found = (gain[k], (f, k, vl[k], vr[k]))
        return found[1]

    def build(g, h, rows, depth, low, high) -> int:
        n = node()
        split = best(g, h, rows, low, high) if depth < DEPTH else None
        if split is None:
            nodes["value"][n] = RATE * float(np.clip(
                -g[rows].sum() / (h[rows].sum() + L2), low, high))
            raw[rows] += nodes["value"][n]
            return n
        f, k, vl, vr = split
        nodes["feature"][n], nodes["limit"][n] = f, edges[f][k]
        goes_left = binned[rows, f] <= k
        middle, kind = (vl + vr) / 2, constraints[f]
        l_low, l_high = (low, middle) if kind > 0 else (middle, high) if kind < 0 else (low, high)
        r_low, r_high = (middle, high) if kind > 0 else (low, middle) if kind < 0 else (low, high)
        nodes["left"][n] = build(g, h, rows[goes_left], depth + 1, l_low, l_high)
        nodes["right"][n] = build(g, h, rows[~goes_left], depth + 1, r_low, r_high)
        return n

    for _ in range(trees if 0 < mean < 1 and len(set(y.tolist())) > 1 else 0):
        p = sigmoid(raw)
        roots.append(build(weight * (p - y), weight * p * (1 - p), np.arange(len(y)), 0,
                           -np.inf, np.inf))
    return Trees(*(np.array(nodes[k], t) for k, t in (
        ("feature", int), ("limit", float), ("left", int), ("right", int), ("value", float))),
        np.array(roots, int), base)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "quality", train_rows: Column | None = None,
        per_class: int = 4000) -> Trees:
    """Fits on at most `per_class` labelled documents of each class among `train_rows`; weights give
    the classes their true shares back. Without labels of both classes the verdict is constant."""
    sample, shares = labelled_sample(labels, label_col, id_col, per_class,
                                     F.lit(True) if train_rows is None else train_rows)
    frame = sampled_documents(docs, sample, id_col).select(
        F.xxhash64("__id").alias("__key"), "__label", F.col(text_col).alias("__t"))
    rows = map_texts(frame, ["__key", "__label"], "__t", lambda texts, kept: {
        **kept, "x": [statistics(t)[1] for t in texts]},
        "__key long, __label int, x array<double>").toArrow()
    if not rows.num_rows:
        return grow(np.zeros((1, len(FEATURES))), np.ones(1), np.ones(1), list(CONSTRAINTS.values()))
    order = np.argsort(rows["__key"].to_numpy(), kind="stable")
    x = rows["x"].combine_chunks().values.to_numpy().reshape(-1, len(FEATURES))[order]
    y = rows["__label"].to_numpy()[order].astype(float)
    return grow(x, y, np.array([shares[int(k)] for k in y], float), list(CONSTRAINTS.values()))


def judge(docs: DataFrame, model: Trees, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns `keep`, the base statistics, `base_failed`, `score` and `kept` of every text.

    `base_failed`: fewer than ten words, or more than a fifth of them in repeated windows; such a
    document is not kept whatever the trees say. A NULL or empty text has no words. Rows that
    repeat are judged each; columns not named are left out.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)

    def run(texts, kept):
        both = [statistics(t) for t in texts]
        base = np.array([b for b, _ in both], np.int64)
        score = shared.value.score(np.array([x for _, x in both]))
        failed = (base[:, 0] < MIN_WORDS) | (100 * base[:, 4] > MAX_REPEAT_PERCENT * base[:, 0])
        return {**kept, **{name: base[:, i] for i, name in enumerate(BASE)}, "base_failed": failed,
                "score": score, "kept": ~failed & (score >= shared.value.threshold)}

    return map_texts(docs, keep, text_col, run, (f"{kinds}, " if keep else "")
                     + ", ".join(f"{c} long" for c in BASE)
                     + ", base_failed boolean, score double, kept boolean")
