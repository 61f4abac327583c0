"""Benchmark decontamination with spaced seeds.

Fixed masks look at some of the words in a window and ignore the others, so a passage still meets
its benchmark item after words have been substituted. What meets is then verified word by word.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from fraudloom.llm.common import in_pieces, to_arrow, written

#: Fixed masks; 1 marks a position that is looked at. Of any stretch of 10 to 12 words of which two
#: are substituted, or of 15 of which three are, one of them looks at equal words only.
MASKS = ("11111", "111011", "11001011")
SPAN = max(map(len, MASKS))
#: Items of fewer words are not searched for.
MIN_ITEM = 5
WORD = re.compile(r"\w+")
#: Bits of the filter per seed of the benchmark, and its bounds as powers of two (at most 16 MB).
BITS_PER_SEED, LEAST_BITS, MOST_BITS, BLOCK_BITS = 64, 20, 27, 16

REGION = "uid long, doc {id}, start long, words array<long>, hits array<struct<at:int,seed:long>>"
FOUND = "n_words int, n_match int, doc_word long, item_word int"


def word_ids(text: str) -> np.ndarray:
    words = WORD.findall(text.lower())
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def _multiplier(n: int) -> np.uint64:
    return np.uint64(((n + 1) * 0x9E3779B97F4A7C15 | 1) & 0xFFFFFFFFFFFFFFFF)


def seeds_of(words: np.ndarray, mask: str) -> np.ndarray:
    """The hash of the looked-at words at every position where the mask fits."""
    n = len(words) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.full(n, xxhash.xxh64_intdigest(mask), np.uint64)
    for k, bit in enumerate(mask):
        if bit == "1":
            total = total * _multiplier(2) + words[k:k + n] * _multiplier(k + 3)
    return total ^ (total >> np.uint64(29))


def item_masks(n_words: int) -> tuple[str, ...]:
    """The masks for an item; one shorter than the widest mask also gets one of its own length."""
    if n_words < MIN_ITEM:
        return ()
    own = ("1" * n_words,) if n_words < SPAN else ()
    return tuple(m for m in MASKS if len(m) <= n_words) + own


def _benchmark(items: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """(uid, item, words, seeds): the words and seeds of every benchmark item."""
    kind = items.schema[item_col].dataType.simpleString()

    def run(batches):
        uid = TaskContext.get().partitionId() << 40
        for batch in in_pieces(batches, "text"):
            rows = []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = word_ids(text or "")
                seeds = [{"at": i, "seed": int(s), "size": len(m)} for m in item_masks(len(words))
                         for i, s in enumerate(seeds_of(words, m).view(np.int64))]
                rows.append({"uid": uid, "item": item, "words": words.view(np.int64), "seeds": seeds})
                uid += 1
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    schema = (f"uid long, item {kind}, words array<long>, "
              "seeds array<struct<at:int,seed:long,size:int>>")
    out = items.sparkSession.createDataFrame([], schema).schema
    arrow = to_arrow(out)
    return items.select(F.col(item_col).alias("item"), F.col(text_col).alias("text")).mapInArrow(
        run, out)


def _places(seed: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    mask = np.uint64((1 << bits) - 1)
    return seed & mask, (seed >> np.uint64(64 - bits)) & mask


def bits_for(n: int) -> int:
    """The size of a bit array for n seeds, as a power of two."""
    return int(np.clip(np.ceil(np.log2(max(1, n) * BITS_PER_SEED)), LEAST_BITS, MOST_BITS))


def bit_array(seeds: DataFrame, bits: int) -> np.ndarray:
    """A bit array over two places of every seed, put together in blocks; at most 16 MB."""
    def places(frames):
        for frame in frames:
            for p in _places(frame["seed"].to_numpy().view(np.uint64), bits):
                p = np.unique(p).astype(np.int64)
                yield pd.DataFrame({"block": p >> BLOCK_BITS, "bit": p & ((1 << BLOCK_BITS) - 1)})

    def block(frame):
        own = np.zeros(1 << BLOCK_BITS, bool)
        own[frame["bit"].to_numpy()] = True
        return pd.DataFrame({"block": [frame["block"].iloc[0]], "raw": [np.packbits(own).tobytes()]})

    out = np.zeros((max(1, (1 << bits) >> BLOCK_BITS), (1 << BLOCK_BITS) // 8), np.uint8)
    for row in seeds.select("seed").mapInPandas(places, "block long, bit long").distinct().groupBy(
            "block").applyInPandas(block, "block long, raw binary").toLocalIterator():
        out[row["block"]] = np.frombuffer(row["raw"], np.uint8)
    return out.reshape(-1)


def held(table: np.ndarray, bits: int, seeds: np.ndarray) -> np.ndarray:
    """Positions of the seeds whose places are both set."""
    first, second = _places(seeds, bits)

    def bit(at):
        return (table[(at >> np.uint64(3)).astype(np.int64)] >> (
            7 - (at & np.uint64(7)).astype(np.uint8))) & 1

    some = np.flatnonzero(bit(first))
    return some[bit(second[some]).astype(bool)]


def _regions(docs: DataFrame, id_col: str, text_col: str, table, bits: int, masks: list[str],
             reach: int) -> DataFrame:
    """The stretches of words around seeds that the filter lets through."""
    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.sparkSession.createDataFrame([], REGION.format(id=kind)).schema
    arrow = to_arrow(out)

    def run(batches):
        uid = TaskContext.get().partitionId() << 40
        for batch in in_pieces(batches, "text"):
            rows = []
            ids = batch.column(0)
            texts = [WORD.findall((t or "").lower()) for t in batch.column(1).to_pylist()]
            lengths = np.fromiter(map(len, texts), np.int64, len(texts))
            words = np.fromiter((xxhash.xxh64_intdigest(w) for t in texts for w in t), np.uint64,
                                int(lengths.sum()))
            ends = np.cumsum(lengths)
            at_all, seed_all = [], []
            for mask in masks:
                seeds = seeds_of(words, mask)
                at = held(table.value, bits, seeds)
                doc = np.searchsorted(ends, at, side="right")
                at, doc = at[inside := at + len(mask) <= ends[doc]], doc[inside]
                at_all.append(at), seed_all.append(seeds[at])
            if not at_all:
                continue
            at, seed = np.concatenate(at_all), np.concatenate(seed_all).view(np.int64)
            order = np.argsort(at, kind="stable")
            at, seed = at[order], seed[order]
            doc = np.searchsorted(ends, at, side="right")
            new = np.flatnonzero((doc[1:] != doc[:-1]) | (np.diff(at) > 2 * reach)) + 1
            for a, b in zip([0, *new] if len(at) else [], [*new, len(at)]):
                d = int(doc[a])
                base = int(ends[d] - lengths[d])
                begin = max(base, int(at[a]) - reach)
                end = min(int(ends[d]), int(at[b - 1]) + reach)
                rows.append({"uid": uid, "doc": ids[d].as_py(), "start": begin - base,
                             "words": words[begin:end].view(np.int64),
                             "hits": [{"at": x, "seed": s} for x, s in zip(
                                 (at[a:b] - begin).tolist(), seed[a:b].tolist())]})
                uid += 1
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text")).mapInArrow(run, out)


def best_overlap(a: np.ndarray, b: np.ndarray, shift: int, similarity: float) -> tuple:
    """The longest stretch, with b lying on a at `shift`, of which the share `similarity` is equal
    and whose ends are: (words, equal words, start in a, start in b)."""
    begin, end = max(0, -shift), min(len(b), len(a) - shift)
    if end <= begin:
        return 0, 0, 0, 0
    equal = a[begin + shift:end + shift] == b[begin:end]
    if not equal.any():
        return 0, 0, 0, 0
    total = np.concatenate([[0.0], np.cumsum(np.where(equal, 1 - similarity, -similarity))])
    low = np.minimum.accumulate(total)
    first = np.searchsorted(-low, -(total + 1e-9), side="left")
    stop = int(np.argmax(np.arange(len(total)) - first))
    same = np.flatnonzero(equal[first[stop]:stop]) + first[stop]
    if not len(same):
        return 0, 0, 0, 0
    start, stop = int(same[0]), int(same[-1]) + 1
    return stop - start, len(same), begin + shift + start, begin + start


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id",
                 text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
                 min_words: int = 10, similarity: float = 0.8) -> DataFrame:
    """(doc_id, item_id, n_words, n_match, doc_word, item_word): every document that holds a
    stretch of a benchmark item, with the longest stretch found for the pair.

    A stretch has at least `min_words` words, or the whole of a shorter item, of which the share
    `similarity` is equal word by word in lower case; the rest may be substituted. Items of fewer
    than five words are not searched. NULL texts hold nothing; rows of equal id are one document in
    the result; NULL ids are reported as one NULL id. Other columns are ignored.

    Seeds of documents are first tested against a bit array of the benchmark's seeds, of at most
    16 MB however large the benchmark is. What passes goes, with the words around it, through an
    equality join with the benchmark's seeds, and only what meets is verified.
    """
    items = written(_benchmark(benchmark, item_col, item_text), "seeds-items")
    seeds = items.select(F.col("uid").alias("item_uid"), F.explode("seeds").alias("s")).select(
        "item_uid", F.col("s.at").alias("item_at"), F.col("s.seed").alias("seed"), "s.size")
    facts = items.agg(F.max(F.size("words")).alias("longest"), F.sum(F.size("seeds")).alias("n"),
                      F.collect_set(F.when((F.size("words") < SPAN) & (F.size("words") >= MIN_ITEM),
                                           F.size("words"))).alias("short")).first()
    n = facts["n"] or 0
    bits = bits_for(n)
    spark = docs.sparkSession
    table = spark.sparkContext.broadcast(bit_array(seeds, bits) if n else np.zeros(
        (1 << bits) // 8, np.uint8))
    masks = list(dict.fromkeys([*MASKS, *("1" * k for k in sorted(facts["short"]))]))
    regions = written(_regions(docs, id_col, text_col, table, bits, masks,
                               (facts["longest"] or 0) + SPAN), "seeds-regions")
    hits = regions.select("uid", F.explode("hits").alias("h")).select("uid", "h.at", "h.seed")
    pairs = hits.join(seeds, "seed").select(
        "uid", "item_uid", (F.col("at") - F.col("item_at")).alias("shift")).distinct()
    known = items.select(F.col("uid").alias("item_uid"), "item", F.col("words").alias("item_words"))
    rows = pairs.join(regions.select("uid", "doc", "start", "words"), "uid").join(known, "item_uid")

    def verify(frames):
        for f in frames:
            found = [best_overlap(np.asarray(a), np.asarray(b), int(s), similarity)
                     for a, b, s in zip(f["words"], f["item_words"], f["shift"])]
            out = f[["doc", "item"]].assign(**{
                name: [x[i] for x in found]
                for i, name in enumerate(("n_words", "n_match", "doc_word", "item_word"))})
            out["doc_word"] += f["start"]
            enough = out["n_words"] >= np.minimum(min_words, f["item_words"].map(len))
            yield out[enough & (out["n_words"] > 0)]

    kinds = (f"doc {docs.schema[id_col].dataType.simpleString()}, "
             f"item {benchmark.schema[item_col].dataType.simpleString()}, " + FOUND)
    best = rows.mapInPandas(verify, kinds).groupBy("doc", "item").agg(F.max(F.struct(
        "n_words", "n_match", (-F.col("doc_word")).alias("d"), (-F.col("item_word")).alias("i")))
        .alias("b"))
    return best.select(
        F.col("doc").alias(id_col), F.col("item").alias(item_col),
        F.col("b.n_words").cast("long").alias("n_words"),
        F.col("b.n_match").cast("long").alias("n_match"), (-F.col("b.d")).alias("doc_word"),
        (-F.col("b.i")).cast("long").alias("item_word"))
