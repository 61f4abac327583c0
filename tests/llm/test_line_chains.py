"""Chains of short lines against brute force, and in the pipeline's stage."""

import random

import corpus_pipeline as cp
from fraudloom.llm import line_windows


def plain_without_chains(rows, min_chars=40):
    """Lines left of each text; a window is any run of lines, the fewest from its first or last line
    on, that has three lines and `min_chars` characters."""
    first, out, every = {}, {}, []
    for key, lines in rows:
        found = set()
        for a in range(len(lines)):
            for b in range(a + 2, len(lines)):
                if sum(map(len, lines[a:b + 1])) >= min_chars:
                    found.add((a, b))
                    break
        for b in range(len(lines)):
            for a in range(b - 2, -1, -1):
                if sum(map(len, lines[a:b + 1])) >= min_chars:
                    found.add((a, b))
                    break
        every.append((key, lines, sorted(found)))
        for a, b in sorted(found):
            first.setdefault(tuple(lines[a:b + 1]), (key, a))
    for key, lines, found in every:
        gone = {i for a, b in found if first[tuple(lines[a:b + 1])] != (key, a) for i in range(a, b + 1)}
        out[key] = [x for i, x in enumerate(lines) if i not in gone]
    return out


def test_chains_by_brute_force(spark):
    rnd = random.Random(3)
    some = lambda n: ["x" * rnd.choice([0, 1, 2, 5, 9, 30]) + f"{rnd.randint(0, 300)}" for _ in range(n)]
    passages = [some(n) for n in (3, 4, 6, 10, 25)]
    rows = []
    for i in range(60):
        body = some(rnd.randint(0, 12))
        at = rnd.randint(0, len(body))
        body[at:at] = rnd.choice(passages)
        rows.append((i, body))
    rows.append((60, ["a", "b"]))
    docs = spark.createDataFrame([(i, "\n".join(x)) for i, x in rows], "doc_id long, text string")
    got = line_windows.remove_repeated_lines(docs, removed_col="n", chains=True).collect()
    want = plain_without_chains(rows)
    assert {r["doc_id"]: r["text"].split() for r in got} == want
    assert {r["doc_id"]: r["n"] for r in got} == {i: len(x) - len(want[i]) for i, x in rows}


def test_stage_removes_repeated_short_lines(spark, sf_dir):
    shouted = "ERWHED.!! EDHEEA!! ONLYND!! QWHAT!! RTIME!! SAGAIN!! "
    rows = [(1, shouted), (2, shouted), (3, "Ha. Ho. Hi."), (4, "Ha. Ho. Hi.")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in cp.without_repeated_lines(spark, docs, sf_dir).collect()}
    assert got == {1: shouted, 2: "", 3: "Ha. Ho. Hi.", 4: "Ha. Ho. Hi."}
