"""Packing and the token index against whole-text encoding by the library."""

import random
import sys
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from fraudloom.llm import packing, token_index, tokens
from fraudloom.llm.queries import QUERIES, tokenizer_path
from fraudloom.llm.tokens import IdEncoder
from fraudloom.session import shared_dir

ODD = ["", " ", "a", "A b", " a  b\n\nc ", "don't İ. stop", "é½.\x1c!", "<|endoftext|> x", "中文 字.",
       "tab\there", "x" * 300, "a\u0301b. c", "nul\0 byte", "\n", "end.\n", "1 2 33 four4",
       "a<|endoftext|>b", "[PAD] [UNK]x <s>y</s> <|ENDOFTEXT|>", "a <pad>  <mask> <unk>"]
ROWS = [(i, t, "s", 1) for i, t in enumerate(ODD)] + [
    (50, None, "s", 1), (50, "repeated id", "s", 1), (50, "repeated id", "s", 1), (None, "no id", "s", 1),
    (60, "word and more words " * 2500, "s", 1)]
SCHEMA = "doc_id long, text string, ids string, offset int"


def whole(path, text, end):
    known = Tokenizer.from_file(path)
    return np.array(known.encode(text or "", add_special_tokens=False).ids + [end], "<u4")


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_ids_equal_whole_texts(name):
    path = tokenizer_path(name)
    got = IdEncoder(path).batch(ODD)
    assert got == [whole(path, t, 0)[:-1].tobytes() for t in ODD]


def test_piece_lengths_follow_reciprocal_classes():
    for n in (1, 63, 64, 100, 682, 1023, 1024, 2047, 2048, 2049, 5000):
        pieces = packing.piece_lengths(n, 2048)
        assert sum(pieces) == n and max(pieces) <= 2048
        assert all(p < 2048 // packing.FINEST or p in {2048 // k for k in range(1, 33)} for p in pieces)


def check_pieces(rows, expected, capacity):
    """`expected`: per document its ids. Every id lies once, sequences have no gap."""
    assert sorted(r["doc_tokens"] for r in rows if r["start"] == 0) == sorted(map(len, expected))
    left = [ids.tobytes() for ids in expected]
    by_doc = {}
    for r in rows:
        by_doc.setdefault((r["doc_id"], r["doc_tokens"]), []).append(r)
        assert r["ids_crc32"] == zlib.crc32(r["ids"]) and len(r["ids"]) == 4 * r["length"]
    whole_ids = sorted(b"".join(bytes(r["ids"]) for r in sorted(rs, key=lambda r: r["start"]))
                       for k, rs in by_doc.items() if sum(r["start"] == 0 for r in rs) == 1)
    assert all(x in left for x in whole_ids)
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return sequences


def test_packing_whole_and_gapless(spark):
    path = tokenizer_path("word_bpe_49k.json")
    docs = spark.createDataFrame(ROWS, SCHEMA).repartition(3)
    rows = packing.pack_documents(docs, path, 1).collect()
    check_pieces(rows, [whole(path, r[1], 1) for r in ROWS], 2048)


def test_packing_fills_across_workers(spark):
    """Many small documents on many workers: what workers leave over is put together."""
    path = tokenizer_path("word_bpe_49k.json")
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.expr(
        "array_join(transform(sequence(0, cast(id % 90 as int)), x -> 'w'), ' ')").alias("text"))
    rows = packing.pack_documents(docs.repartition(16), path, 1, capacity=256).collect()
    one = whole(path, "w", 1)
    sequences = check_pieces(rows, [np.concatenate([one[:1].repeat(r["doc_id"] % 90 + 1), one[1:]])
                                    for r in docs.collect()], 256)
    used = sum(r["length"] for r in rows)
    assert used / (256 * len(sequences)) > 0.97


def test_packing_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert packing.pack_documents(docs, tokenizer_path("word_bpe_49k.json"), 1).collect() == []


def test_perfect_hash_is_minimal():
    keys = np.unique(np.random.default_rng(0).integers(-2 ** 62, 2 ** 62, 5000))
    levels = token_index.build_levels(keys)
    assert sorted(token_index.slots(keys, levels)) == list(range(len(keys)))
    again = [token_index.unpack_bits(token_index.pack_bits(b)) for b in levels]
    assert (token_index.slots(keys, again) == token_index.slots(keys, levels)).all()


def test_index_round_trip(spark, monkeypatch):
    monkeypatch.setattr(token_index, "SHARD_BYTES", 400)
    monkeypatch.setattr(token_index, "KEYS_PER_BUCKET", 4)
    path, out = tokenizer_path("byte_bpe_50k.json"), shared_dir(spark, "t")
    token_index.write_token_index(spark.createDataFrame(ROWS, SCHEMA), out, path, 2, partitions=3)
    stored = token_index.read_back(spark, out).collect()
    texts = {}
    for key, text, *_ in ROWS:
        texts.setdefault(key, []).append(whole(path, text, 2))
    stored.sort(key=lambda r: r["start"])
    at = 0
    for r in stored:
        assert r["start"] == at
        at += r["n_tokens"]
        assert r["ids_crc32"] in [zlib.crc32(x.tobytes()) for x in texts[r["key"]]]
    keys = [r["key"] for r in stored]
    assert keys == sorted(keys, key=lambda k: (k is not None, k)) and len(keys) == len(ROWS)
    asked = spark.createDataFrame([(k,) for k in [0, 3, 50, 60, 999, -5, None]], "key long")
    found = {r["key"]: r for r in token_index.lookup(spark, out, asked).collect()}
    assert set(found) == {0, 3, 50, 60} and found[50]["copies"] == 3
    for key, r in found.items():
        first = next(x for x in stored if x["key"] == key)
        assert (r["part"], r["shard"], r["offset"], r["count"]) == (
            first["part"], first["shard"], first["offset"], first["n_tokens"])
    got = {}
    for r in token_index.fetch(spark, out, asked).collect():
        assert r["count"] * 4 == len(r["ids"])
        got.setdefault(r["key"], []).append(bytes(r["ids"]))
    assert {k: sorted(v) for k, v in got.items()} == {
        k: sorted(x.tobytes() for x in texts[k]) for k in (0, 3, 50, 60)}
    keyless = token_index.read_back(spark, out, only_keyless=True).collect()
    assert keyless == [r for r in stored if r["key"] is None]


def test_ids_of_random_texts_equal_the_library():
    chosen = random.Random(5)
    signs = "ab ,.'\n\té中\u0301 \x01\0\u3000  1<|>"
    texts = ["".join(chosen.choice(signs) for _ in range(chosen.randrange(40))) for _ in range(2000)]
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        path, known = tokenizer_path(name), Tokenizer.from_file(tokenizer_path(name))
        got = IdEncoder(path)
        ids = [x for i in range(0, len(texts), 300) for x in got.batch(texts[i:i + 300])]
        assert ids == [np.array(e.ids, "<u4").tobytes()
                       for e in known.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_python_does_not_see_known_words(name):
    """Words of earlier batches cost no Python call, and none is made per text character or word."""
    known, calls = IdEncoder(tokenizer_path(name)), []
    words = [f"{a}{b}{c}" for a in "abcdefghij" for b in "klmnopqrst" for c in "uvwxyzaeio"]
    text = "x " + ", ".join(words) + ". "
    known.batch([text])
    sys.setprofile(lambda frame, event, arg: calls.append(event))
    try:
        got = known.batch([text, text * 2])
    finally:
        sys.setprofile(None)
    assert len(calls) < len(words)
    assert got == [whole(tokenizer_path(name), t, 0)[:-1].tobytes() for t in (text, text * 2)]


def test_signs_after_a_word_make_no_new_word(monkeypatch):
    path, seen = tokenizer_path("byte_bpe_50k.json"), []
    known = IdEncoder(path)
    encode = known._encode_parts
    monkeypatch.setattr(known, "_encode_parts", lambda parts: (seen.extend(parts), encode(parts))[1])
    texts = ["one alpha beta\u00e9", "one alpha### beta\u00e9%%%", "one alpha's beta\u00e9- alpha"]
    got = [known.batch([t])[0] for t in texts]
    assert seen == ["one", " alpha", " beta\u00e9", "###", "%%%", "'s", "-"]
    assert got == [whole(path, t, 0)[:-1].tobytes() for t in texts]


def test_forgotten_and_long_words_keep_their_ids(monkeypatch):
    monkeypatch.setattr(tokens, "REMEMBERED", 5)
    path = tokenizer_path("byte_bpe_50k.json")
    known = IdEncoder(path)
    for k in range(12):
        texts = [" ".join(f"w{i}" for i in range(k, k + 4)), "y" * 100 + ".", None, ""]
        assert known.batch(pa.array(texts)) == [whole(path, t, 0)[:-1].tobytes() for t in texts]
        assert len(known.words) <= 10


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_white_space_and_marks_equal_the_library(name):
    chosen = random.Random(7)
    wide = "".join(c for c in map(chr, range(0x80, 0x3001)) if c.isspace())
    path, known = tokenizer_path(name), Tokenizer.from_file(tokenizer_path(name))
    for signs in ("aB \n\r\t\v\f" + wide + ".\u00e91", "HTWYJ\u0331\u030c\u0308\u030a=<>; aA\u0338",
                  "aAsStTlLrReE''  -_1\u00e9\u0436\u0130."):
        texts = ["".join(chosen.choice(signs) for _ in range(chosen.randrange(30))) for _ in range(1500)]
        got = IdEncoder(path).batch(texts)
        assert got == [np.array(e.ids, "<u4").tobytes()
                       for e in known.encode_batch(texts, add_special_tokens=False)]


def test_index_of_empty_table(spark):
    out = shared_dir(spark, "t")
    token_index.write_token_index(spark.createDataFrame([], SCHEMA), out,
                                  tokenizer_path("byte_bpe_50k.json"), 2)
    asked = spark.createDataFrame([(1,)], "key long")
    assert token_index.lookup(spark, out, asked).collect() == []
    assert token_index.fetch(spark, out, asked).collect() == []
    assert token_index.read_back(spark, out).collect() == []


def test_query_covers_every_document(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    path = tokenizer_path("byte_bpe_50k.json")
    got = {r["doc_id"]: r for r in QUERIES["op10_token_index"](spark, sf_dir).collect()}
    start = 0
    for r in sorted(docs, key=lambda r: r["doc_id"]):
        ids = whole(path, r["text"], 2)
        g = got.pop(r["doc_id"])
        assert (g["start"], g["n_tokens"], g["ids_crc32"]) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert not got
    path = tokenizer_path("word_bpe_49k.json")
    rows = QUERIES["op1_harmonic_packing"](spark, sf_dir).collect()
    texts = {r["doc_id"]: whole(path, r["text"], 1) for r in docs}
    for r in rows:
        part = texts[r["doc_id"]][r["start"]:r["start"] + r["length"]]
        assert r["ids_crc32"] == zlib.crc32(part.tobytes())
    assert sum(r["length"] for r in rows) == sum(map(len, texts.values()))
