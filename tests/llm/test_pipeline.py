"""Stages of the corpus pipeline on odd rows."""

import random

import numpy as np

import corpus_pipeline as cp
from fraudloom.llm import line_windows
from fraudloom.llm.tokens import IdEncoder
from test_near_duplicates import near, plain_components, plain_fingerprint

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
TEXT = "the quick brown fox jumps over the lazy dog and runs far away from here " * 4


def test_stages_keep_columns_and_clean_documents(spark, sf_dir):
    item = spark.read.parquet(f"{sf_dir}/benchmark.parquet").first()["text"]
    rows = [(1, TEXT), (1, TEXT), (2, TEXT), (3, None), (4, ""), (5, "clean words stand here alone"),
            (None, "no id but words"), (6, "before " + item + " after")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA)
    once = cp.without_near_duplicates(spark, docs, sf_dir)
    assert once.columns == docs.columns
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in once.collect()) == sorted([
        (0, "no id but words"), (1, TEXT), (3, ""), (5, rows[5][1]), (6, rows[7][1])])
    clean = cp.without_benchmark(spark, docs, sf_dir)
    assert clean.columns == docs.columns
    assert sorted(r["doc_id"] or 0 for r in clean.collect()) == [0, 1, 1, 2, 3, 4, 5]


def test_near_duplicate_stage_by_brute_force(spark, sf_dir):
    """Copies with a changed word in texts of many lengths, chains of them, short and empty texts."""
    rnd = random.Random(5)
    texts = ["one two three", "One  Two\nthree", "one two four", "", None, "  \t", "word " * 400]
    for _ in range(20):
        base = [f"w{rnd.randint(0, 5000)}" for _ in range(rnd.randint(30, 300))]
        for _ in range(4):
            texts.append(" ".join(base))
            base[rnd.randrange(len(base))] = f"new{rnd.random()}"
    rnd.shuffle(texts)
    rows = [(i * 3 % 101, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], SCHEMA).repartition(3)
    want = plain_components([(i, plain_fingerprint(t)) for i, t in rows], near)
    kept = cp.without_near_duplicates(spark, docs, sf_dir)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(want.values()))
    assert len(set(want.values())) < len(rows)


def test_equal_rows_of_other_columns_keep_the_same_one(spark, sf_dir):
    rows = [(1, TEXT, lang, source, n) for n, (lang, source) in enumerate(
        [("en", "a"), ("de", None), (None, "b"), ("en", "b")])]
    kept = {tuple(cp.without_near_duplicates(spark, spark.createDataFrame(
        made, SCHEMA).repartition(parts), sf_dir).collect()[0])
        for made, parts in ((rows, 1), (rows[::-1], 3))}
    assert len(kept) == 1 and kept <= set(rows)


def test_run_packs_what_the_stages_keep(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in cp.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, sf_dir).collect(), docs.schema)
    encoder = IdEncoder(cp.tokenizer_path(cp.PACK_TOKENIZER))
    end = np.array([cp.PACK_END], "<u4").tobytes()
    left = {r["doc_id"]: encoder.batch([r["text"] or ""])[0] + end for r in docs.collect()}
    got = {}
    for r in cp.run(spark, sf_dir).collect():
        got.setdefault(r["doc_id"], []).append((r["start"], bytes(r["ids"])))
    assert {k: b"".join(x for _, x in sorted(v)) for k, v in got.items()} == left


def test_toxicity_stage_keeps_clashing_columns(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    plain = {r["doc_id"] for r in cp.without_toxic(spark, docs, sf_dir).collect()}
    more = docs.selectExpr("*", "doc_id * 2 as score", "'x' as toxic")
    got = cp.without_toxic(spark, more, sf_dir)
    assert got.columns == more.columns
    rows = got.collect()
    assert {r["doc_id"] for r in rows} == plain and all(
        r["score"] == 2 * r["doc_id"] and r["toxic"] == "x" for r in rows)


def test_removed_lines_replace_a_column_of_that_name(spark):
    docs = spark.createDataFrame([(1, "a\nb\nc " + "d" * 50, "old"), (2, "a\nb\nc " + "d" * 50, "old")],
                                 "doc_id long, text string, gone string")
    got = line_windows.remove_repeated_lines(docs, removed_col="gone")
    assert got.columns == ["doc_id", "text", "gone"]
    assert sorted((r["doc_id"], r["gone"]) for r in got.collect()) == [(1, 0), (2, 3)]
