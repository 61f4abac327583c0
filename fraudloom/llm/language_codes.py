"""Language of whole texts by error-correcting output codes."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from fraudloom.llm.common import code_points, fit_logistic, map_texts

FEATURE_BITS = 12
FEATURES = 1 << FEATURE_BITS
#: Languages up to which every split into two sides is a bit; beyond, random codewords are used.
EXHAUSTIVE = 5
RIDGE = 0.3
#: Below this lead over the next codeword, as a share of the score, a prediction is ambiguous.
CLEAR = 0.1


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def features(text: str) -> np.ndarray:
    """Square roots of the shares of hashed groups of one, two and three characters."""
    points = code_points(" " + text.lower() + " ").astype(np.uint64)
    mult = np.uint64(0x9E3779B97F4A7C15)
    total = np.zeros(FEATURES)
    value = points * mult
    for width in (1, 2, 3):
        if width > 1:
            if len(points) < width:
                break
            value = (value[:-1] ^ (value[:-1] >> np.uint64(31))) * mult + points[width - 1:] * mult
        total += np.bincount((value >> np.uint64(64 - FEATURE_BITS)).astype(np.int64),
                             minlength=FEATURES)
    return np.sqrt(total / max(1, total.sum())).astype(np.float32)


def codewords(n: int, seed: int = 5) -> np.ndarray:
    """One row of +1 and -1 per language.

    Up to five languages: all splits into two sides. More: of many random codes of
    15 * log2(n) bits the one whose closest two words are furthest apart.
    """
    if n < 2:
        return np.ones((n, 1))
    if n <= EXHAUSTIVE:
        bits = np.arange(1, 1 << (n - 1))
        rest = ((bits[None, :] >> np.arange(n - 1)[:, None]) & 1) * -2 + 1
        return np.concatenate([np.ones((1, len(bits))), rest]).astype(float)
    rng, best, apart = np.random.default_rng(seed), None, -1
    width = int(np.ceil(15 * np.log2(n)))
    for _ in range(200):
        code = rng.choice([-1.0, 1.0], (n, width))
        code = code[:, np.abs(code.sum(axis=0)) < n]
        gap = int(((code[:, None] != code[None]).sum(axis=2) + width * np.eye(n, dtype=int)).min())
        if gap > apart:
            best, apart = code, gap
    return best


@dataclass
class LanguageCodes:
    """`languages` sorted, `codes` their words, `weights` one logistic classifier per bit (the last
    row is the intercept), `bit_weight` how reliable each bit is."""

    languages: list[str]
    codes: np.ndarray
    weights: np.ndarray
    bit_weight: np.ndarray

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of the nearest codeword by weighted logistic loss, its score, and its lead."""
        margin = x @ self.weights[:-1] + self.weights[-1]
        loss = np.stack([(self.bit_weight * np.logaddexp(0, -margin * code)).sum(axis=1)
                         for code in self.codes], axis=1)
        share = np.exp(loss.min(axis=1, keepdims=True) - loss)
        share /= share.sum(axis=1, keepdims=True)
        best = loss.argmin(axis=1)
        top = share[np.arange(len(x)), best]
        share[np.arange(len(x)), best] = 0
        return best, top, top - share.max(axis=1, initial=0)


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id",
        train_rows: Column | None = None, per_language: int = 800) -> LanguageCodes:
    """Learns from at most `per_language` documents of each language among `train_rows`, taken in
    the order of a hash of the id. Rows with a NULL language or text teach nothing and take no place;
    without any others, and from an empty table, no language is learned."""
    rows = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    if train_rows is not None:
        rows = rows.filter(train_rows)
    key = F.xxhash64(id_col)
    slim = rows.select(F.col(lang_col).alias("__lang"), key.alias("__key"))
    languages = sorted(r["__lang"] for r in slim.select("__lang").distinct().collect())
    limits = [slim.filter(F.col("__lang") == lang).orderBy("__key").limit(per_language)
              for lang in languages]
    if not languages:
        return LanguageCodes([], np.ones((0, 1)), np.zeros((FEATURES + 1, 1)), np.ones(1))
    sample = limits[0]
    for part in limits[1:]:
        sample = sample.unionAll(part)
    bounds = {r["__lang"]: r["m"] for r in sample.groupBy("__lang").agg(
        F.max("__key").alias("m")).collect()}
    chosen = F.lit(False)
    for lang, bound in bounds.items():
        chosen = chosen | ((F.col(lang_col) == lang) & (key <= bound))
    frame = rows.filter(chosen).select(F.col(lang_col).alias("__lang"), key.alias("__key"),
                                       F.col(text_col).alias("__t"))
    held = map_texts(frame, ["__lang", "__key"], "__t", lambda texts, kept: {
        **kept, "x": [features(t) for t in texts]}, "__lang string, __key long, x array<float>").toArrow()
    order = np.argsort(held["__key"].to_numpy(), kind="stable")
    x = held["x"].combine_chunks().values.to_numpy().reshape(-1, FEATURES)[order]
    y = np.searchsorted(languages, np.array(held["__lang"].to_pylist(), object)[order].astype(str))
    codes = codewords(len(languages))
    counts = np.bincount(y, minlength=len(languages))
    weight = (len(y) / np.maximum(counts, 1) / len(languages))[y]
    weights, reliable = np.zeros((FEATURES + 1, codes.shape[1])), np.ones(codes.shape[1])
    if len(languages) > 1:
        basis = np.linalg.svd(x[:4000] - x[:4000].mean(axis=0), full_matrices=False)[2][:150] \
            if len(x) < 200 else _leading(x, 150)
        z = x @ basis.T
        scale = z.std() + 1e-9
        for bit in range(codes.shape[1]):
            target = (codes[y, bit] > 0).astype(float)
            beta = fit_logistic(z / scale, target, weight, l2=RIDGE)
            weights[:-1, bit] = basis.T @ (beta[:-1] / scale)
            weights[-1, bit] = beta[-1]
            wrong = (((x @ weights[:-1, bit] + weights[-1, bit]) > 0) != (target > 0)).mean()
            reliable[bit] = np.log((1 - wrong + 1e-3) / (wrong + 1e-3))
        reliable = np.maximum(reliable, 0.1) / reliable.max()
    return LanguageCodes(languages, codes, weights, reliable)


def _leading(x: np.ndarray, dims: int, seed: int = 3) -> np.ndarray:
    """Rows that span the leading right singular vectors of x."""
    from fraudloom.llm.knn_quality import latent_basis

    return latent_basis(x.astype(np.float32), dims, seed).T


def predict(docs: DataFrame, model: LanguageCodes, keep: list[str],
            text_col: str = "text") -> DataFrame:
    """The columns `keep`, `lang_pred`, `score` (0 to 1) and `ambiguous` for every whole text.

    A NULL text or one without a letter is `und` with score 0 and ambiguous, as is every text when
    no language was learned. Columns not named are left out; rows that repeat are predicted each.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)

    def run(texts, kept):
        known = shared.value
        lang, score, lead = ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
        some = [i for i, t in enumerate(texts) if known.languages and has_letter(t)]
        for at in range(0, len(some), 256):
            own = some[at:at + 256]
            best, top, gap = known.decode(np.stack([features(texts[i]) for i in own]))
            score[own], lead[own] = top, gap
            for i, b in zip(own, best):
                lang[i] = known.languages[b]
        return {**kept, "lang_pred": lang, "score": score, "ambiguous": lead < CLEAR}

    return map_texts(docs, keep, text_col, run, f"{kinds + ', ' if keep else ''}"
                     "lang_pred string, score double, ambiguous boolean")
