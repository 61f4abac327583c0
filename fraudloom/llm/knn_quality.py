"""Quality of whole texts by nearest-neighbour voting among labelled latent-semantic vectors."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from fraudloom.llm.common import (
    SHAPES, char_classes, code_points, labelled_sample, map_texts, sampled_documents, word_hashes,
    word_shapes,
)

#: Terms: hashed words, then word shapes, then shapes of repeated words.
WORD_TERMS = 2048
TERMS = WORD_TERMS + 2 * SHAPES
#: Share of the vector that words take; the rest belongs to shapes.
WORD_WEIGHT = 0.4


def counts_of(text: str) -> np.ndarray:
    """How often each term occurs in a text."""
    out = np.zeros(TERMS, np.float32)
    hashes = word_hashes(text)
    if len(hashes):
        out[:WORD_TERMS] = np.bincount((hashes % np.uint64(WORD_TERMS)).astype(np.int64),
                                       minlength=WORD_TERMS)
    shapes = word_shapes(char_classes(code_points(text)))
    if len(shapes):
        out[WORD_TERMS:WORD_TERMS + SHAPES] = np.bincount(shapes, minlength=SHAPES)
    pieces = text.split()
    again = np.fromiter((a == b for a, b in zip(pieces, pieces[1:])), bool, max(0, len(pieces) - 1))
    out[WORD_TERMS + SHAPES] = again.sum()
    lines = [x for x in text.split("\n") if x.strip()]
    out[WORD_TERMS + SHAPES + 1] = len(lines) - len(set(lines))
    return out


def weigh(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Term weights, each of the two blocks of unit length."""
    x = counts.copy()
    total = np.maximum(x[:, WORD_TERMS:WORD_TERMS + SHAPES].sum(axis=1, keepdims=True), 1)
    x[:, :WORD_TERMS] = np.log1p(x[:, :WORD_TERMS])
    x[:, WORD_TERMS:] = np.sqrt(x[:, WORD_TERMS:] / total)
    x *= idf
    for part, share in ((slice(0, WORD_TERMS), WORD_WEIGHT), (slice(WORD_TERMS, TERMS), 1 - WORD_WEIGHT)):
        norm = np.linalg.norm(x[:, part], axis=1, keepdims=True)
        x[:, part] *= np.sqrt(share) / np.maximum(norm, 1e-9)
    return x


@dataclass
class Neighbours:
    """`basis` maps weighted terms to the latent space, `vectors` are the labelled documents there,
    of unit length; `weight` gives the classes their true shares back."""

    idf: np.ndarray
    basis: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    weight: np.ndarray
    prior: float
    k: int

    def project(self, counts: np.ndarray) -> np.ndarray:
        z = weigh(counts, self.idf) @ self.basis
        return z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-9)

    def score(self, counts: np.ndarray) -> np.ndarray:
        """Share of the votes of the k most similar labelled documents, by similarity; one exact
        product per block of documents with all labelled vectors."""
        if not len(self.vectors):
            return np.full(len(counts), self.prior)
        similar = self.project(counts) @ self.vectors.T
        k = min(self.k, similar.shape[1])
        near = np.argpartition(-similar, k - 1, axis=1)[:, :k]
        vote = np.maximum(np.take_along_axis(similar, near, axis=1), 0) ** 8 * self.weight[near]
        total = vote.sum(axis=1)
        return np.where(total > 0, (vote * self.labels[near]).sum(axis=1) / np.maximum(total, 1e-12),
                        self.prior)


def document_frequencies(docs: DataFrame, text_col: str = "text") -> tuple[np.ndarray, int]:
    """In how many of all documents each term occurs, and the number of documents.

    Tasks add up a vector of fixed size; one vector per task meets in the sum.
    """
    frame = docs.select(F.col(text_col).alias("__t"))

    def run(texts, kept):
        total = np.zeros(TERMS, np.int64)
        for text in texts:
            total += counts_of(text) > 0
        return {"counts": [total], "n": [len(texts)]}

    def add(frames):
        total, n = np.zeros(TERMS, np.int64), 0
        for f in frames:
            n += int(f["n"].sum())
            for row in f["counts"]:
                total += np.asarray(row)
        yield pd.DataFrame({"term": np.arange(TERMS), "held": total, "n": n})

    parts = map_texts(frame, [], "__t", run, "counts array<long>, n long").mapInPandas(
        add, "term int, held long, n long")
    rows = parts.groupBy("term").agg(F.sum("held").alias("held"), F.sum("n").alias("n")).collect()
    held = np.zeros(TERMS, np.int64)
    for row in rows:
        held[row["term"]] = row["held"]
    return held, int(rows[0]["n"]) if rows else 0


def latent_basis(x: np.ndarray, dims: int, seed: int = 11) -> np.ndarray:
    """The leading right singular vectors of x by a randomised range finder."""
    rng = np.random.default_rng(seed)
    dims = min(dims, *x.shape)
    y = x @ rng.normal(size=(x.shape[1], dims + 16)).astype(np.float32)
    for _ in range(3):
        q, _ = np.linalg.qr(y)
        y = x @ (x.T @ q)
    q, _ = np.linalg.qr(y)
    _, _, vt = np.linalg.svd(q.T @ x, full_matrices=False)
    return vt[:dims].T.astype(np.float32)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "quality", train_rows: Column | None = None, per_class: int = 1500,
        dims: int = 48, k: int = 25) -> Neighbours:
    """Vectors of at most `per_class` labelled documents of each class among `train_rows`.

    Inverse document frequencies come from all documents. The model, at most 2 * per_class vectors
    of `dims` numbers and a basis of fixed size, is small enough to broadcast whatever the corpus.
    """
    held, n = document_frequencies(docs, text_col)
    idf = np.log((1 + n) / (1 + held)).astype(np.float32) + 1
    sample, shares = labelled_sample(labels, label_col, id_col, per_class,
                                     F.lit(True) if train_rows is None else train_rows)
    frame = sampled_documents(docs, sample, id_col).select(
        F.xxhash64("__id").alias("__key"), "__label", F.col(text_col).alias("__t"))

    def run(texts, kept):
        return {**kept, "terms": [counts_of(t) for t in texts]}

    rows = map_texts(frame, ["__key", "__label"], "__t", run,
                     "__key long, __label int, terms array<float>").toArrow()
    if not rows.num_rows:
        return Neighbours(idf, np.zeros((TERMS, 1), np.float32), np.zeros((0, 1), np.float32),
                          np.zeros(0), np.zeros(0), 0.5, k)
    order = np.argsort(rows["__key"].to_numpy(), kind="stable")
    counts = rows["terms"].combine_chunks().values.to_numpy().reshape(-1, TERMS)[order]
    y = rows["__label"].to_numpy()[order]
    weight = np.array([shares[label] for label in y], float)
    basis = latent_basis(weigh(counts, idf), dims)
    model = Neighbours(idf, basis, np.zeros((0, basis.shape[1]), np.float32), y.astype(float), weight,
                       float((weight * y).sum() / weight.sum()), k)
    model.vectors = model.project(counts)
    return model


def score_texts(docs: DataFrame, model: Neighbours, keep: list[str],
                text_col: str = "text") -> DataFrame:
    """The columns `keep` and `score`, the share of votes for label 1, of every whole text.

    A text without words is compared like others (its vector is zero, so it gets the share of label
    1 among the labelled). Columns not named are left out; rows that repeat are scored each.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)

    def run(texts, kept):
        scores = [shared.value.score(np.stack([counts_of(t) for t in texts[i:i + 128]]))
                  for i in range(0, len(texts), 128)]
        return {**kept, "score": np.concatenate(scores).astype(float)}

    return map_texts(docs, keep, text_col, run, f"{kinds + ', ' if keep else ''}score double")
