"""Merkle manifest, prefix trie and license scan against brute force, on odd rows too."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from fraudloom.llm import license_diagonals, merkle_manifest, prefix_trie
from fraudloom.llm.queries import QUERIES
from fraudloom.llm.ranks import ranked, salted_join

DOCS = "doc_id long, text string, lang string, source string, n_chars long, rank int, key string, block int"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


# ------------------------------------------------------------------------------------ ranks


def test_ranks_span_ranges_and_keep_null_groups(spark):
    rows = [(None if g == 0 else f"g{g}", i % 50) for g in range(3) for i in range([7, 400, 1][g])]
    got = ranked(spark.createDataFrame(rows, "g string, v int").repartition(5), "g", [F.col("v")], "t").collect()
    by_group = defaultdict(list)
    for r in got:
        by_group[r["g"]].append((r["rank"], r["v"], r["members"]))
    assert len(got) == len(rows)
    for found in by_group.values():
        found.sort()
        assert [x[0] for x in found] == list(range(len(found)))
        assert [x[1] for x in found] == sorted(x[1] for x in found)
        assert {x[2] for x in found} == {len(found)}


def test_salted_join_equals_join(spark):
    rows = spark.createDataFrame([(1 if i % 3 else i, i) for i in range(300)], "k int, v int")
    facts = spark.createDataFrame([(k, k * 10) for k in range(200)], "k int, f int")
    got = salted_join(rows, facts, ["k"], F.col("v"), salts=4)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, rows.join(facts, "k").collect()))


# --------------------------------------------------------------------------------- manifest


def levels_of(nodes, arity=2):
    out = [nodes]
    while len(out[-1]) > 1:
        last = out[-1]
        out.append([sha(*last[i:i + arity]) for i in range(0, len(last), arity)])
    return out


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def leaf_of(row, add=0):
    n = None if row["n_chars"] is None else row["n_chars"] + add
    return sha(*map(field, (row["doc_id"], row["source"], row["lang"], n, row["text"])))


def steps(levels, at):
    out = []
    for nodes in levels[:-1]:
        begin = at - at % 2
        run = nodes[begin:begin + 2]
        out.append((run[:at - begin], run[at - begin + 1:]))
        at //= 2
    return out


def check_manifest(rows, made):
    trees = defaultdict(list)
    for row in rows:
        trees[row["lang"]].append(row)
    order = sorted(trees, key=lambda g: (g is not None, (g or "").encode()))
    built = {}
    for g in order:
        trees[g].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf_of(r)))
        built[g] = levels_of([leaf_of(r) for r in trees[g]])
    top = levels_of([built[g][-1][0] for g in order])
    expected = Counter()
    for g in order:
        for i, row in enumerate(trees[g]):
            proof = steps(built[g], i) + steps(top, order.index(g))
            chosen = row["doc_id"] is not None and zlib.crc32(str(row["doc_id"]).encode()) % 7 == 0
            node = leaf_of(row, 1 if chosen else 0)
            for left, right in proof:
                node = sha(*left, node, *right)
            expected[(row["doc_id"], leaf_of(row), built[g][-1][0], top[-1][0],
                      sha(*[x for left, right in proof for x in (*left, *right)]), node,
                      node == top[-1][0])] += 1
    columns = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    assert Counter(tuple(r[c] for c in columns) for r in made) == expected


def odd_documents(n=90):
    rows = [(i, f"text {i} é" * (i % 4), ["en", "de", None, "", "�", "\U00010000"][(i % 13) % 6],
             None if i % 5 == 0 else "web", None if i % 7 == 0 else i, 1, "k", 2) for i in range(n)]
    rows += [(500, None, "en", None, None, 1, "k", 2)] * 3 + [
        (None, "no id", "en", "web", 3, 1, "k", 2), (None, None, None, None, None, None, None, None),
        (7, "long " * 60_000, "xx", "web", 300_000, 1, "k", 2)]
    return rows


@pytest.mark.parametrize("levels", [1, 2, 6])
def test_manifest_equals_brute_force(spark, tmp_path, levels):
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame(odd_documents(), DOCS).write.parquet(path)
    docs = spark.read.parquet(path)
    made = merkle_manifest.documents_manifest(docs, levels).select(
        "doc_id", "leaf", "subroot", "root",
        merkle_manifest.sha(merkle_manifest.siblings(F.col("proof"))).alias("proof_sha256"),
        merkle_manifest.fold(F.col("tampered"), F.col("proof")).alias("folded_root")).withColumn(
        "verified", F.col("folded_root") == F.col("root")).collect()
    check_manifest(docs.collect(), made)
    if levels == 6:
        check_manifest(docs.collect(), QUERIES["op12_merkle_manifest"](spark, str(tmp_path)).collect())


def test_manifest_of_nothing_and_of_one(spark):
    empty = spark.createDataFrame([], DOCS)
    assert merkle_manifest.documents_manifest(empty).collect() == []
    one = spark.createDataFrame([(1, "a", "en", "s", 1, 1, "k", 2)], DOCS)
    row = merkle_manifest.documents_manifest(one).collect()[0]
    assert row["leaf"] == row["subroot"] == row["root"] and row["proof"] == []


def test_wider_trees(spark):
    rows = spark.createDataFrame([("g", i, sha(str(i))) for i in range(50)], "g string, o int, d string")
    made = merkle_manifest.prove(merkle_manifest.write_manifest(rows, "g", ["o"], "d", ["o"], 2, 3))
    root = levels_of([sha(str(i)) for i in range(50)], 3)[-1][0]
    got = made.withColumn("again", merkle_manifest.fold(F.col("digest"), F.col("proof"))).collect()
    assert len(got) == 50 and {r["root"] for r in got} == {r["again"] for r in got} == {root}


# ------------------------------------------------------------------------------------- trie


def brute_trie(members, turns):
    """members: ids; turns: id -> list of (key, chars)."""
    nodes = defaultdict(list)
    for c in members:
        for d in range(len(turns.get(c, [])) + 1):
            nodes[tuple(turns.get(c, [])[:d])].append(c)
    kids = defaultdict(list)
    for path in nodes:
        if path:
            kids[path[:-1]].append(path)
    out = {}
    for path in sorted(nodes, key=len, reverse=True):
        own = (len(nodes[path]) - 1) * (path[-1][1] if path else 0)
        below = [out[k] for k in kids[path]]
        ends = sorted(c for c in nodes[path] if len(turns.get(c, [])) == len(path))
        out[path] = (min(nodes[path]), len(path), min(nodes[path[:-1]]) if path else None,
                     len(nodes[path]), len(below), sum(b[5] for b in below) or 1,
                     own + sum(b[6] for b in below), sha(",".join(map(str, ends))))
    return Counter(out.values())


def trie_rows(made, columns):
    return Counter(tuple(r[c] for c in columns) for r in made.collect())


OWN = ("owner", "depth", "parent_owner", "n_convs", "n_children", "n_leaves", "saved", "ends_sha256")


@pytest.mark.parametrize("block", [1, 3, 4])
def test_trie_equals_brute_force(spark, block):
    import random

    pick = random.Random(block)
    turns = {}
    for c in range(120):
        base = turns[pick.randrange(c)][:pick.randrange(9)] if c and pick.random() < 0.8 else []
        turns[c] = base + [(f"k{pick.randrange(2)}", 5 + pick.randrange(2)) for _ in range(pick.randrange(4))]
    turns = {c: [(k, int(k[1])) for k, _ in t] for c, t in turns.items()}
    turns[1000] = turns[1001] = turns[1002] = [("x", 3)] * 37
    turns[1003] = [("x", 3)] * 20 + [("y", 4)] * 9
    members = [*turns, 2000, 2001]
    rows = spark.createDataFrame([(c, i, k, n) for c, t in turns.items() for i, (k, n) in enumerate(t)],
                                 "conv long, pos long, key string, chars long")
    made = prefix_trie.prefix_trie(rows, spark.createDataFrame([(c,) for c in members], "conv long"), block)
    assert trie_rows(made, OWN) == brute_trie(members, turns)


def rebuild(rows):
    own = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r["turn"] is not None, r["turn"] or 0, r["role"] or "")):
        if r["conv_id"] is not None:
            own[r["conv_id"]].append((r["role"] or "", r["text"] or ""))
    out = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = own.get(c - c % 100, [])[:h] + own[c][h:]
    return {c: [((role, text), len(text)) for role, text in t] for c, t in out.items()}


def test_trie_query_on_odd_conversations(spark, tmp_path):
    rows = [(c, t, ["user", "assistant"][t % 2], f"turn {t} é {c % 3 if t else 0}", 1, "k")
            for c in [*range(0, 12), *range(100, 140), 305, 306] for t in range(c % 11)]
    rows += [(200, None, None, None, 1, "k"), (200, 0, "user", "", 1, "k"), (207, 3, None, "x" * 50_000, 1, "k"),
             (None, 1, "user", "lost", 1, "k"), (208, 0, "user", "same", 1, "k"), (209, 0, "user", "same", 1, "k")]
    schema = "conv_id long, turn long, role string, text string, depth int, owner string"
    for name, data in (("some", rows), ("none", [])):
        spark.createDataFrame(data, schema).write.parquet(str(tmp_path / name / "conversations.parquet"))
    made = QUERIES["op11_prefix_trie"](spark, str(tmp_path / "some"))
    columns = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    turns = rebuild([dict(zip(("conv_id", "turn", "role", "text"), r)) for r in rows])
    assert trie_rows(made, columns) == brute_trie(list(turns), turns)
    assert QUERIES["op11_prefix_trie"](spark, str(tmp_path / "none")).collect() == []


def test_many_ends_at_one_node(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "IDS_OF_A_PIECE", 7)
    ends = spark.createDataFrame([(1, 0, c) for c in range(500)] + [(1, 2, 9), (2, 2, 3)],
                                 "owner long, depth long, conv long").repartition(6)
    got = {(r["owner"], r["depth"]): r["ends_sha256"] for r in prefix_trie._ends_digest(ends).collect()}
    assert got == {(1, 0): sha(",".join(map(str, range(500)))), (1, 2): sha("9"), (2, 2): sha("3")}


# --------------------------------------------------------------------------------- licenses

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return WORDS.findall((text or "").translate({i: i + 32 for i in range(65, 91)}))


def base_of(text):
    words, found = words_of(text), []
    for phrase, label in license_diagonals.PHRASES:
        parts = phrase.split()
        found += [(i, label) for i in range(len(words)) if words[i:i + len(parts)] == parts]
    at = [i for i, _ in found]
    return (len(words), len(found), min(at, default=None), max(at, default=None),
            ",".join(sorted({x for _, x in found})))


MIT = license_diagonals.NOTICES[0][0]
TEXTS = [None, "", "word", "MIT License", "mit license mit  license, MIT-LICENSE", "Kit mit licenЅe",
         "the GNU General Public\nLicense and gnu general public", "cc by cc by-nc CC\x00BY", "ccby", "é" * 9,
         "Apache\tLicense " * 300 + "end", MIT, "Intro. " + MIT.replace("without limitation ", "") + " outro",
         MIT.replace("charge", "cost").replace("merge", "join"), " ".join(MIT.split()[:9]),
         "plain prose about a copy of this software " * 40, "a " * 200_000 + "mit license"]


def test_base_places_and_labels(spark):
    rows = [(i, t, 1, "x") for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], 1, "x")] * 3 + [
        (3, "other mit license", 1, "x"), (None, "apache license", 1, "x"), (None, None, 1, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key int, words string")
    got = license_diagonals.scan_licenses(docs).collect()
    assert Counter((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"])
                   for r in got) == Counter((i, *base_of(t)) for i, t, *_ in rows)
    by_id = {r["doc_id"]: r for r in got}
    for i in (11, 12, 13):
        assert by_id[i]["labels"] == "mit" and by_id[i]["n_base"] == 0
    assert by_id[11]["score"] == 1 and by_id[11]["spans"][0]["to_word"] == len(words_of(MIT))
    assert by_id[14]["labels"] == "" and by_id[15]["labels"] == "" and by_id[15]["score"] == 0
    assert all(0 <= r["score"] <= 1 for r in got)
    assert all(set(r["base_labels"].split(",")) - {""} <= set(r["labels"].split(",")) for r in got)


def test_license_scan_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert license_diagonals.scan_licenses(empty).collect() == []


def test_license_scan_is_native(spark, sf_dir):
    plan = QUERIES["op13_license_diagonals"](spark, sf_dir)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "MapInArrow" not in plan
