"""Repeated passages that no three whole lines hold, against all runs of 50 words."""

import random

import corpus_pipeline as cp
from fraudloom.llm import repeated_runs
from fraudloom.llm.repeated_runs import RUN, words_of


def plain_without_runs(rows):
    """rows: distinct (id, text) in order; the words left of each."""
    first, out = {}, {}
    for key, text in rows:
        words = [text[a:b] for a, b in words_of(text)] if text else []
        gone = set()
        for at in range(len(words) - RUN + 1):
            doc, begin = first.setdefault(tuple(words[at:at + RUN]), (key, at))
            if doc != key or at >= begin + RUN:
                gone.update(range(at, at + RUN))
        out[key] = [w for i, w in enumerate(words) if i not in gone]
    return out


def made_rows():
    rnd = random.Random(9)
    some = lambda n: [f"v{rnd.randint(0, 900)}" for _ in range(n)]
    passages = [some(n) for n in (50, 51, 60, 120, 300)]
    texts = []
    for i in range(60):
        body = some(rnd.randint(0, 120))
        if i % 3:
            at = rnd.randint(0, len(body))
            body[at:at] = rnd.choice(passages)
        texts.append(rnd.choice([" ", "\n", "  "]).join(body))
    texts += [" ".join(passages[3]), " ".join(passages[3]), "same " * 400, " ".join(some(7) * 40), None, "", " \n"]
    chinese = "".join(chr(0x4E00 + rnd.randint(0, 800)) for _ in range(90))
    texts += [chinese + "。", "好" + chinese, " ".join(passages[1][1:]) + " end", " ".join(passages[0][:49])]
    return list(enumerate(texts))


def test_runs_by_brute_force(spark):
    rows = made_rows()
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows],
                                 "doc_id long, text string, gram string, at int").repartition(3)
    got = repeated_runs.remove_repeated_runs(docs)
    assert got.columns == docs.columns
    found = {r["doc_id"]: r["text"] for r in got.collect()}
    assert {k: [t[a:b] for a, b in words_of(t or "")] for k, t in found.items()
            for t in [t or ""]} == plain_without_runs(rows)
    assert found[64] is None and found[65] == "" and found[66] == " \n"


def test_equal_rows_and_text_around(spark):
    passage = " ".join(f"p{i}" for i in range(55))
    rows = [(1, passage), (1, passage), (None, "a\n" + passage + "\n\nb"), (2, "c,  " + passage + "\nd")]
    got = repeated_runs.remove_repeated_runs(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((r["doc_id"] or 0, r["text"]) for r in got.collect()) == [
        (0, rows[2][1]), (1, ""), (1, ""), (2, "c,  d")]


def test_stage_removes_passages_of_one_sentence(spark, sf_dir):
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(1, passage), (2, "Set into " + passage + " running text."), (3, passage)]
    docs = spark.createDataFrame([(i, t, len(t)) for i, t in rows], "doc_id long, text string, n_chars long")
    got = cp.without_repeated_lines(spark, docs, sf_dir)
    assert sorted(tuple(r) for r in got.collect()) == [
        (1, passage, len(passage)), (2, "Set into running text.", 22), (3, "", 0)]
