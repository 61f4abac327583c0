"""Toxicity learns counts, weights, calibration and thresholds from all labelled rows, not a sample."""

import random

import numpy as np
from pyspark.sql import functions as F

from fraudloom.llm import toxicity
from fraudloom.llm.common import fit_logistic, labelled_ids

SCHEMA = "doc_id long, text string, lang string"


def plain_threshold(scores, labels):
    """Tries every score as the lowest that is taken; the first of the best, from above."""
    best = None
    distinct = sorted(set(scores), reverse=True)
    for k, s in enumerate(distinct):
        taken = [y for x, y in zip(scores, labels) if x >= s]
        f1 = 2 * sum(taken) / (len(taken) + sum(labels))
        if best is None or f1 > best[0]:
            best = f1, (s + distinct[k + 1]) / 2 if k + 1 < len(distinct) else s
    return best[1]


def f1_at(limit, rows):
    taken = [r["doc_id"] % 2 for r in rows if r["score"] >= limit]
    return 2 * sum(taken) / (len(taken) + sum(r["doc_id"] % 2 for r in rows))


def made_up(n, seed):
    """More documents of each label than the 3000 that were sampled before."""
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        toxic = i % 2
        text = [f"w{rnd.randrange(300)}" for _ in range(6)]
        if rnd.random() < (0.7 if toxic else 0.1):
            text[rnd.randrange(6)] = rnd.choice(["nasty", "vile", "foul"])
        rows.append((i, " ".join(text), rnd.choice(["a", "b", None]), toxic))
    return rows


def test_thresholds_against_brute_force(spark):
    rnd = random.Random(5)
    rows = [(rnd.choice(["a", "a", "a", "", "few", None]) if i > 30 else "few", round(rnd.random(), 2),
             int(rnd.random() < 0.3)) for i in range(1500)]
    rows += [("clean", rnd.random(), 0) for _ in range(50)]
    got = toxicity.best_thresholds(spark.createDataFrame(rows, "lang string, score double, label int").repartition(7))
    want = {None: plain_threshold([s for _, s, _ in rows], [y for *_, y in rows])}
    for lang in {x for x, *_ in rows if x is not None}:
        own = [(s, y) for x, s, y in rows if x == lang]
        if min(sum(y for _, y in own), sum(1 - y for _, y in own)) >= toxicity.LEAST_ROWS:
            want[lang] = plain_threshold(*zip(*own))
    assert "clean" not in want and "" in want and got == want
    alike = spark.createDataFrame([("a", 0.5, i % 2) for i in range(60)], "lang string, score double, label int")
    assert toxicity.best_thresholds(alike) == {None: 0.5, "a": 0.5}


def test_calibration_against_arrays(spark):
    rng = np.random.default_rng(3)
    raw = rng.normal(0, 2, 4000).astype(np.float32)
    y = (rng.random(4000) < 1 / (1 + np.exp(-(1.5 * raw - 1)))).astype(int)
    scores = spark.createDataFrame([(float(x), int(k)) for x, k in zip(raw, y)], "raw float, label int").repartition(5)
    assert np.allclose(toxicity.calibrate(scores), fit_logistic(raw[:, None], y, np.ones(4000), l2=0.01), atol=1e-6)


def test_fit_uses_all_labelled_rows(spark):
    rows = made_up(9000, 4)
    docs = spark.createDataFrame([r[:3] for r in rows], SCHEMA).repartition(3)
    labels = spark.createDataFrame([(r[0], r[3]) for r in rows], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    scored = toxicity.score_texts(docs, model, ["doc_id", "lang"]).filter(
        F.pmod(F.xxhash64("doc_id"), F.lit(toxicity.CALIBRATION_SHARE)) == 0).collect()
    assert len(scored) > 1500 + 500
    for lang, limit in [(None, model.threshold), *model.thresholds.items()]:
        own = [r for r in scored if lang is None or r["lang"] == lang]
        best = plain_threshold([r["score"] for r in own], [r["doc_id"] % 2 for r in own])
        # Equal texts score alike up to rounding, so the thresholds may lie on two sides of some.
        assert f1_at(limit, own) > f1_at(best, own) - 0.002
    assert set(model.thresholds) == {"a", "b"}
    share = np.mean([r["score"] for r in scored])
    assert abs(share - np.mean([r["doc_id"] % 2 for r in scored])) < 0.01


def test_words_of_all_labelled_rows_are_counted(spark):
    rows = made_up(6500, 6)
    rows += [(1, "same id nasty", "a", 1), (2, None, "b", 0), (None, "no id", "a", 1), (7000, "no label", "a", None)]
    docs = spark.createDataFrame([r[:3] for r in rows], SCHEMA)
    want = [r for r in rows if r[0] is not None and r[3] is not None]
    for kind in ("long", "int"):
        labels = spark.createDataFrame([(r[0], r[3]) for r in rows[:6500]], f"doc_id {kind}, toxic int")
        ids = labelled_ids(labels, "toxic", "doc_id", F.lit(True)).withColumn("__aside", F.lit(False))
        got = toxicity.labelled_words(docs, ids, "doc_id", "text", "lang", 3)
        assert got.count() == len(want)
        counts = toxicity.held_by([toxicity.buckets(r[1] or "") for r in want], np.array([r[3] for r in want]))
        assert (toxicity.count_words(got) == counts).all()


def test_copies_are_averaged_over_the_shards_that_moved(spark):
    """One pass over shards is the mean of what each shard alone comes to."""
    rows = made_up(400, 8)
    docs = spark.createDataFrame([r[:3] for r in rows], SCHEMA)
    labels = spark.createDataFrame([(r[0], r[3]) for r in rows], "doc_id long, toxic int")
    ids = labelled_ids(labels, "toxic", "doc_id", F.lit(True)).withColumn("__aside", F.lit(False))
    words = toxicity.labelled_words(docs, ids, "doc_id", "text", "lang", 3).sortWithinPartitions("__key")
    flat = toxicity.initial(toxicity.count_words(words), np.random.default_rng(1))
    squares = np.full_like(flat, 1e-3)
    total, moved = np.zeros((2, len(flat))), np.zeros(len(flat))
    shards = {}
    for r in sorted(words.collect(), key=lambda r: r["__key"]):
        shards.setdefault(r["__shard"], []).append(r)
    assert len(shards) == 3
    for own in shards.values():
        after = flat.copy(), squares.copy()
        for at in range(0, len(own), toxicity.DOCS_PER_STEP):
            part = own[at:at + toxicity.DOCS_PER_STEP]
            toxicity.learn(*after, [np.frombuffer(r["__words"], np.uint16).reshape(-1, 3).astype(np.int32) for r in part],
                           np.array([r["__label"] for r in part]), np.ones(len(part)))
        change = np.stack(after) - np.stack([flat, squares])
        total, moved = total + change, moved + (change[1] > 0)
    got = np.stack(toxicity.one_pass(words, flat, squares))
    assert np.allclose(got, np.stack([flat, squares]) + total / np.maximum(moved, 1), atol=1e-5)
