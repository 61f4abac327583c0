"""SimHash groups, repeated lines and benchmark passages against brute force."""

import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from fraudloom.llm import line_windows, simhash, spaced_seeds
from fraudloom.llm.components import component_of
from fraudloom.llm.queries import QUERIES


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(items, near):
    """Smallest id reachable, by union of all near pairs; items: [(id, value)]."""
    root = list(range(len(items)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(items)):
        for j in range(i):
            if near(items[i][1], items[j][1]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    members = {}
    for i, (key, _) in enumerate(items):
        members.setdefault(find(i), []).append(key)
    return {key: min((k for k in m if k is not None), default=None) for m in members.values() for key in m}


def near(a, b):
    return bin(a ^ b).count("1") <= 3


@pytest.mark.parametrize("text", ["", " \t\n", "One", "one two", "A b C d", "é É è", "x y z " * 50,
                                  "\x1c not space \x1c", "a\x0bb\x0cc"])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == plain_fingerprint(text)


@pytest.mark.parametrize("block", [2, 16, 4096])
def test_links_connect_all_near_pairs(spark, block):
    """Dense balls around centres and random values, small blocks forcing the second level."""
    rnd = random.Random(block)
    values = {rnd.getrandbits(64) for _ in range(40)}
    for centre in (0, 2 ** 64 - 1, rnd.getrandbits(64)):
        for _ in range(150):
            x = centre
            for bit in rnd.sample(range(64), rnd.randint(0, 5)):
                x ^= 1 << bit
            values.add(x)
    values = sorted(values)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    fps = spark.createDataFrame([(v,) for v in signed], "fp long")
    links = simhash.links(fps, block=block)
    rows = links.collect()
    mask = (1 << 64) - 1
    assert rows and all(near(r["a"] & mask, r["b"] & mask) and r["a"] != r["b"] for r in rows)
    got = {r["node"]: r["root"] for r in component_of(links).collect()}
    want = plain_components(list(zip(signed, values)), near)
    for v in signed:
        assert got.get(v, v) == want[v]


def test_near_duplicates_with_odd_rows(spark):
    base = "the quick brown fox jumps over the lazy dog and runs far away from here " * 6
    rows = [(5, base), (3, base), (9, base + "again"), (7, None), (8, ""), (6, "   "), (2, "alone here"),
            (None, "nobody has this one"), (4, base), (4, base), (11, "ü " * 5000)]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows],
                                 "doc_id long, text string, fp string, fingerprint int")
    got = simhash.near_duplicates(docs).collect()
    want = plain_components([(i, plain_fingerprint(t)) for i, t in rows], near)
    assert len(got) == len(rows)
    for r in got:
        assert r["component_id"] == want[r["doc_id"]]
    assert Counter(r["fingerprint"] for r in got) == Counter(f"{plain_fingerprint(t):016x}" for _, t in rows)


def test_near_duplicates_query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    items = [(r["doc_id"], plain_fingerprint(r["text"])) for r in docs]
    want = plain_components(items, near)
    got = QUERIES["op7_simhash_variants"](spark, sf_dir).collect()
    assert {(r["doc_id"], r["fingerprint"], r["component_id"]) for r in got} == {
        (i, f"{fp:016x}", want[i]) for i, fp in items}
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(empty).collect() == []


def test_components_of_chains(spark):
    n = 300
    chain = spark.range(1, n).select(F.col("id").alias("a"), (F.col("id") - 1).alias("b"))
    more = spark.createDataFrame([(1000, 1001), (1001, 1000), (5000, 5000)], "a long, b long")
    got = {r["node"]: r["root"] for r in component_of(chain.unionAll(more)).collect()}
    assert all(got[i] == 0 for i in range(n)) and got[1001] == got[1000] == 1000 and 5000 not in got


PASSAGE = "It rained on the long road home. Nobody had seen the old bridge. The lamps were out again. So we walked on. "


def plain_without_lines(rows, min_chars=line_windows.MIN_CHARS):
    """rows: distinct (id, text) in order."""
    seen, out = set(), {}
    for key, text in rows:
        parts = re.sub(r"([.!?] |\n)", "\\1\x1e", text or "").split("\x1e")
        full = [i for i, p in enumerate(parts) if p.strip(" \t\n\v\f\r")]
        lines = [parts[i].strip(" \t\n\v\f\r") for i in full]
        gone = set()
        for k in range(len(lines) - 2):
            window = tuple(lines[k:k + 3])
            if sum(map(len, window)) < min_chars:
                continue
            if window in seen:
                gone.update(full[k:k + 3])
            seen.add(window)
        out[key] = None if text is None else "".join(p for i, p in enumerate(parts) if i not in gone)
    return out


def test_repeated_lines(spark):
    rows = [(1, PASSAGE + "First ends here."), (2, "Second starts. " + PASSAGE), (3, PASSAGE * 3),
            (4, "Ha. Ho. Hi. Ha. Ho. Hi."), (5, None), (6, ""), (7, "\n\n"), (8, "a\nb"),
            (9, "x" * 30 + "\n\n" + "y" * 30 + "\n" + "z" * 30 + "\n"),
            (10, "x" * 30 + "\n" + "y" * 30 + "\n\n\n" + "z" * 30)]
    docs = spark.createDataFrame([(i, t, "k", 2) for i, t in rows],
                                 "doc_id long, text string, lines string, at int")
    got = line_windows.remove_repeated_lines(docs)
    assert got.columns == docs.columns
    assert {r["doc_id"]: r["text"] for r in got.collect()} == plain_without_lines(rows)


def test_repeated_lines_of_repeated_rows_and_ids(spark):
    rows = [(1, PASSAGE), (1, PASSAGE), (None, PASSAGE), (2, PASSAGE), (2, "Other. " + PASSAGE)]
    got = line_windows.remove_repeated_lines(
        spark.createDataFrame(rows, "doc_id long, text string"), removed_col="n").collect()
    kept = Counter((r["doc_id"], r["text"]) for r in got)
    assert kept == {(None, PASSAGE): 1, (1, ""): 2, (2, ""): 1, (2, "Other. "): 1}
    assert sorted(r["n"] for r in got) == [0, 4, 4, 4, 4]
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert line_windows.remove_repeated_lines(empty).collect() == []


def plain_leaks(docs, items, min_words, similarity):
    """Every alignment of every pair; the longest stretch per pair."""
    found = {}
    for doc, text in docs:
        a = re.findall(r"\w+", (text or "").lower())
        for item, other in items:
            b = re.findall(r"\w+", (other or "").lower())
            if len(b) < spaced_seeds.MIN_ITEM:
                continue
            best = 0
            for shift in range(-len(b) + 1, len(a)):
                equal = [0 <= i + shift < len(a) and a[i + shift] == b[i] for i in range(len(b))]
                if sum(equal) < 4:
                    continue
                for i in range(len(b)):
                    for j in range(i + 1, len(b) + 1):
                        if equal[i] and equal[j - 1] and sum(equal[i:j]) >= similarity * (j - i) - 1e-9:
                            best = max(best, j - i)
            if best >= min(min_words, len(b)):
                found[doc, item] = best
    return found


def test_seeds_find_substituted_passages(spark):
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 6)))
    items = [(i, " ".join(word() for _ in range(rnd.choice([5, 7, 12, 20, 40])))) for i in range(20)]
    items += [(90, "too short now"), (91, None), (92, "")]
    docs = []
    for d in range(60):
        body = [word() for _ in range(rnd.randint(0, 60))]
        if d % 2:
            passage = items[d % 20][1].split()
            if d % 4 == 1 and len(passage) >= 12:
                passage[4] = passage[-2] = "changed"
            at = rnd.randint(0, len(body))
            body[at:at] = [p.upper() for p in passage]
        docs.append((d, "  ".join(body)))
    docs += [(100, None), (101, ""), (102, items[4][1] + " " + items[4][1]), (None, items[3][1])]
    frame = spark.createDataFrame([(i, t, "u", 0) for i, t in docs],
                                  "doc_id long, text string, uid string, item long")
    got = spaced_seeds.contaminated(frame.repartition(3), spark.createDataFrame(
        items, "item_id long, text string")).collect()
    want = plain_leaks(docs, items, 10, 0.8)
    assert {(r["doc_id"], r["item_id"]): r["n_words"] for r in got} == want
    assert all(r["n_match"] >= 0.8 * r["n_words"] for r in got)


def test_seeds_with_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert spaced_seeds.contaminated(docs, none).collect() == []
    some = spark.createDataFrame([(1, "one two three four five six")], "item_id long, text string")
    assert spaced_seeds.contaminated(docs.limit(0), some).collect() == []


def test_seeds_query_finds_whole_items(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()
    norm = lambda t: " " + " ".join(re.findall(r"\w+", t.lower())) + " "
    want = {(d["doc_id"], i["item_id"]) for d in docs for i in items if norm(i["text"]) in norm(d["text"])}
    got = {(r["doc_id"], r["item_id"]) for r in QUERIES["op4_spaced_seeds"](spark, sf_dir).collect()}
    assert want and want <= got


def test_best_overlap_takes_the_longest_stretch():
    a = np.array([1, 2, 3, 9, 5, 6, 7, 8, 9, 10, 1])
    b = np.array([1, 2, 3, 4, 5, 6, 7, 8, 0, 0])
    assert spaced_seeds.best_overlap(a, b, 0, 0.8)[:2] == (8, 7)
