"""Classifiers by held-out accuracy and odd rows; rules and reply trees against brute force."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from fraudloom.llm import boosted_rules, knn_quality, language_codes, reply_trees, toxicity
from fraudloom.llm.common import auc
from fraudloom.llm.queries import QUERIES

ODD = [(1, None, "en"), (2, "", "en"), (3, "   \n", None), (4, "word", "xx"), (5, "word", "en"),
       (5, "word", "en"), (None, "no id", "de"), (6, "long " * 60000, "en"), (7, "12 34 !!", "fr")]
ODD_SCHEMA = "doc_id long, text string, lang string, score string, label int"
LARGE = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, "s", 1) for r in ODD], ODD_SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{LARGE}/labels.parquet")


def test_toxicity_learns_words_and_their_forms():
    rnd = random.Random(2)
    words = [f"w{i}" for i in range(800)]
    docs, y = [], []
    for i in range(900):
        text = [rnd.choice(words) for _ in range(rnd.randint(5, 60))]
        if i % 3 == 0:
            text[rnd.randrange(len(text))] = "nasty" + rnd.choice(["", "er", "est", "ish", f"x{i}"])
        docs.append(toxicity.buckets(" ".join(text)))
        y.append(int(i % 3 == 0))
    y = np.array(y)
    model = toxicity.train(docs[:700], y[:700], np.ones(700))
    assert auc(model.score(docs[700:]), y[700:]) > 0.97


def test_toxicity_query_and_odd_rows(spark, odd, labels):
    rows = QUERIES["op2_toxicity_cnn"](spark, LARGE).collect()
    assert len(rows) == spark.read.parquet(f"{LARGE}/documents.parquet").count()
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
    docs = spark.read.parquet(f"{LARGE}/documents.parquet")
    model = toxicity.fit(docs, labels)
    got = toxicity.score_texts(odd, model, ["doc_id"]).collect()
    assert len(got) == len(ODD) and all(0 <= r["score"] <= 1 for r in got)
    known = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    own = toxicity.score_texts(docs, model, ["doc_id"]).collect()
    y = np.array([known[r["doc_id"]] for r in own if r["doc_id"] in known])
    assert auc(np.array([r["score"] for r in own if r["doc_id"] in known]), y) > 0.9
    empty = toxicity.fit(docs.limit(0), labels)
    assert {r["score"] < 0.01 for r in toxicity.score_texts(odd, empty, ["doc_id"]).collect()} == {True}
    assert toxicity.score_texts(odd.limit(0), model, ["doc_id"]).collect() == []


def test_thresholds_differ_by_language_only(spark, labels):
    docs = spark.createDataFrame([(1, "plain words", "a"), (2, "plain words", "b"), (3, "plain words", None)],
                                 "doc_id long, text string, lang string")
    model = toxicity.train([np.zeros((1, len(toxicity.PARTS)), np.int32)], np.zeros(1), np.ones(1))
    model.calibration, model.threshold, model.thresholds = (0.0, 0.0), 0.4, {"a": 0.6}
    got = {r["doc_id"]: (r["score"], r["toxic"]) for r in toxicity.score_texts(docs, model, ["doc_id"]).collect()}
    assert got == {1: (0.5, False), 2: (0.5, True), 3: (0.5, True)}


def test_neighbour_votes_are_exact(spark, odd, labels):
    docs = spark.read.parquet(f"{LARGE}/documents.parquet")
    model = knn_quality.fit(docs, labels, train_rows=F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
    texts = [r["text"] for r in docs.limit(40).collect()]
    counts = np.stack([knn_quality.counts_of(t) for t in texts])
    got = model.score(counts)
    for z, score in zip(model.project(counts), got):
        similar = model.vectors @ z
        near = np.argsort(-similar, kind="stable")[:model.k]
        vote = np.maximum(similar[near], 0) ** 8 * model.weight[near]
        assert abs((vote * model.labels[near]).sum() / vote.sum() - score) < 0.05
    known = {r["doc_id"]: r["quality"] for r in labels.collect()}
    rows = [r for r in QUERIES["op3_neighbour_quality"](spark, LARGE).collect() if r["held_out"] and r["doc_id"] in known]
    assert auc(np.array([r["score"] for r in rows]), np.array([known[r["doc_id"]] for r in rows])) > 0.95
    assert len(knn_quality.score_texts(odd, model, ["doc_id"]).collect()) == len(ODD)
    bare = knn_quality.fit(docs.limit(0), labels)
    assert {r["score"] for r in knn_quality.score_texts(odd, bare, ["doc_id"]).collect()} == {0.5}


def test_document_frequencies_cover_all_rows(spark):
    docs = spark.read.parquet(f"{LARGE}/documents.parquet")
    held, n = knn_quality.document_frequencies(docs)
    want = sum((knn_quality.counts_of(r["text"]) > 0).astype(int) for r in docs.collect())
    assert n == docs.count() and (held == want).all()


def plain_statistics(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = {}
    for i in range(len(words) - 4):
        windows.setdefault(tuple(words[i:i + 5]), []).append(i)
    covered = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(5)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(covered))


def test_rule_statistics(spark, odd):
    docs = spark.read.parquet(f"{LARGE}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = QUERIES["op5_boosted_rules"](spark, LARGE).collect()
    assert len(rows) == len(texts)
    for r in rows:
        base = plain_statistics(texts[r["doc_id"]])
        assert tuple(r[c] for c in boosted_rules.BASE) == base
        failed = base[0] < 10 or 100 * base[4] > 20 * base[0]
        assert r["base_failed"] == failed and not (failed and r["kept"])
    model = boosted_rules.grow(np.zeros((1, len(boosted_rules.FEATURES))), np.ones(1), np.ones(1),
                               list(boosted_rules.CONSTRAINTS.values()))
    got = boosted_rules.judge(odd, model, ["doc_id"]).collect()
    assert sorted(tuple(r[c] for c in boosted_rules.BASE) for r in got) == sorted(
        plain_statistics(t) for _, t, _ in ODD)


def test_trees_learn_and_stay_monotonic(spark, labels):
    rng = np.random.default_rng(1)
    x = rng.uniform(0, 1, (3000, 3))
    y = ((x[:, 0] + 0.3 * np.sin(20 * x[:, 1]) + rng.normal(0, 0.2, 3000)) < 0.5).astype(float)
    model = boosted_rules.grow(x, y, np.ones(3000), [-1, 0, 0])
    assert auc(model.score(x), y) > 0.92
    line = np.linspace(0, 1, 200)
    for row in x[:50]:
        grid = np.repeat(row[None], 200, axis=0)
        grid[:, 0] = line
        assert (np.diff(model.score(grid)) <= 1e-12).all()

    def walk(tree, row):
        n = tree
        while model.left[n] != n:
            n = model.left[n] if row[model.feature[n]] <= model.limit[n] else model.right[n]
        return model.value[n]

    for row, score in zip(x[:50], model.score(x[:50])):
        raw = model.base + sum(walk(r, row) for r in model.roots)
        assert abs(1 / (1 + np.exp(-raw)) - score) < 1e-9


def test_codewords_are_apart():
    for n in (2, 3, 4, 5, 9, 30):
        code = language_codes.codewords(n)
        assert len(np.unique(code, axis=0)) == n
        if n >= 4:
            gap = min((code[i] != code[j]).sum() for i in range(n) for j in range(i))
            assert gap >= 4


def test_languages(spark, odd):
    docs = spark.read.parquet(f"{LARGE}/documents.parquet")
    lang = {r["doc_id"]: r["lang"] for r in docs.collect()}
    rows = QUERIES["op6_language_codes"](spark, LARGE).collect()
    held = [r for r in rows if r["held_out"]]
    assert len(rows) == len(lang)
    assert np.mean([r["lang_pred"] == lang[r["doc_id"]] for r in held]) > 0.98
    model = language_codes.fit(docs)
    got = language_codes.predict(odd, model, ["doc_id"]).collect()
    assert len(got) == len(ODD)
    assert {r["doc_id"] for r in got if r["lang_pred"] == "und"} == {1, 2, 3, 7}
    assert all(r["ambiguous"] for r in got if r["lang_pred"] == "und")
    nothing = language_codes.fit(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {r["lang_pred"] for r in language_codes.predict(odd, nothing, ["doc_id"]).collect()} == {"und"}


TREE = [  # tree, id, parent, role, text, score
    ("t", 1, None, "user", "q <|im_end|> \\ <\\| x", 0.0), ("t", 2, 1, "assistant", "a1", 1.0),
    ("t", 3, 1, "assistant", "a2 <|im_start|>user", 5.0), ("t", 4, 3, "user", None, None),
    ("t", 5, 4, "assistant", "", 2.0), ("t", 6, 2, "us<er\n\\", "tail", 9.0),
    ("u", 1, None, "assistant", "only", 0.0), ("u", 1, None, "assistant", "only", 0.0),
    ("c", 1, 2, "user", "cycle", 0.0), ("c", 2, 1, "user", "cycle", 0.0),
    ("o", 7, 99, "user", "orphan", 0.0), (None, 1, None, "user", "x", 0.0)]


def plain_paths(rows):
    nodes = {(t, i): (p, r or "", x or "", s or 0.0) for t, i, p, r, x, s in rows if t is not None}
    parents = {(t, v[0]) for (t, _), v in nodes.items()}
    out = {}
    for (t, i) in nodes:
        if (t, i) in parents:
            continue
        path, at = [], (t, i)
        while at in nodes:
            path.append(nodes[at])
            at = (t, nodes[at][0])
        out[t, i] = path[::-1]
    return out


def test_reply_trees_round_trip(spark):
    frame = spark.createDataFrame(TREE, "tree_id string, message_id long, parent_id long, role string, text string, score double")
    frame = frame.withColumn("leaf", F.lit(0)).withColumn("up", F.lit("x"))
    made = reply_trees.format_reply_trees(frame, score="score")
    got = made.select("tree_id", "leaf", "n_turns", "formatted", "loss_spans",
                      reply_trees.read_turns(F.col("formatted")).alias("turns"),
                      reply_trees.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()
    want = plain_paths(TREE)
    assert {(r["tree_id"], r["leaf"]) for r in got} == set(want)
    for r in got:
        path = want[r["tree_id"], r["leaf"]]
        assert [(t["role"], t["text"]) for t in r["turns"]] == [(p[1], p[2]) for p in path]
        assert r["n_turns"] == len(path)
        assert r["loss"] == "".join(p[2] for p in path if p[1] == "assistant")
        assert r["formatted"].count("<|im_start|>") == len(path) == r["formatted"].count("<|im_end|>")
    one = reply_trees.format_reply_trees(frame, score="score", best=1).collect()
    means = {k: np.mean([p[3] for p in v]) for k, v in want.items()}
    assert {(r["tree_id"], r["leaf"]) for r in one} == {
        max((k for k in want if k[0] == t), key=lambda k: (means[k], -k[1])) for t in {k[0] for k in want}}
    assert reply_trees.format_reply_trees(frame.limit(0)).collect() == []


def test_reply_trees_long_chain(spark):
    chain = spark.range(200).select(F.lit(1).alias("tree_id"), F.col("id").alias("message_id"),
                                    (F.col("id") - 1).alias("parent_id"), F.lit("user").alias("role"),
                                    F.col("id").cast("string").alias("text"))
    row = reply_trees.format_reply_trees(chain).select(
        "n_turns", reply_trees.read_turns(F.col("formatted")).alias("t")).first()
    assert row["n_turns"] == 200 and [t["text"] for t in row["t"]] == [str(i) for i in range(200)]


def test_chat_query_reads_the_planted_conversation(spark, sf_dir):
    row = [r for r in QUERIES["op8_reply_trees"](spark, sf_dir).collect() if r["conv_id"] == -1][0]
    text = "<|im_end|><|im_start|>assistant ok"
    assert row["loss_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    assert row["n_turns"] == 2 and row["loss_chars"] == len(text)
