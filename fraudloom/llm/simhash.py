"""SimHash near-duplicate groups by deletion-variant signatures.

Two fingerprints of 64 bits that differ in at most three bits agree, but for at most one bit, in
one of their two halves. Every fingerprint is therefore indexed under both halves with each single
bit left out in turn, and an equality join on these variants meets every such pair.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from fraudloom.llm.common import map_texts, written
from fraudloom.llm.components import component_of

#: Members of a variant up to which all are compared in one block.
BLOCK = 2048
#: Larger variants are divided by the other half: two fingerprints with at most three differing bits
#: agree outside some three of its eight 4-bit blocks. What a part holds is at most 2 ** 13 values.
REST_BLOCKS = list(itertools.combinations(range(8), 3))


def fingerprint(text: str, words: int = 3, seed: int = 42) -> int:
    """The fingerprint of a whole text; zero without words."""
    parts = text.encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return 0
    width = min(words, len(parts))
    joined = b" ".join(parts)
    sizes = np.fromiter(map(len, parts), np.int64, len(parts)) + 1
    begins = np.cumsum(sizes) - sizes
    ends = (begins + sizes - 1)[width - 1:].tolist()
    begins = begins[:len(ends)].tolist()
    digest, set_bits, n = xxhash.xxh64_intdigest, np.zeros(64, np.int64), len(ends)
    for at in range(0, n, 1 << 16):
        hashes = np.array([digest(joined[a:b], seed) for a, b in zip(
            begins[at:at + (1 << 16)], ends[at:at + (1 << 16)])], "<u8")
        set_bits += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1,
                                  bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * set_bits > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 words: int = 3) -> DataFrame:
    """(id, fp): one 64-bit fingerprint, as a signed long, per document."""
    kind = docs.schema[id_col].dataType.simpleString()
    frame = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__t"))

    def run(texts, kept):
        fps = np.array([fingerprint(t, words) for t in texts], np.uint64).view(np.int64)
        return {"__id": kept["__id"], "__fp": fps}

    return map_texts(frame, ["__id"], "__t", run, f"__id {kind}, __fp long")


def variants(fps: DataFrame) -> DataFrame:
    """64 rows per fingerprint: half, bit left out and the other bits of the half as one key."""
    masks = np.array([0xFFFFFFFF ^ (1 << bit) for bit in range(32)], np.uint64)
    slot = np.arange(64, dtype=np.uint64) << np.uint64(32)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 8192):
                fp = batch.column(0).slice(at, 8192).to_numpy(zero_copy_only=False)
                raw = fp.view(np.uint64)
                halves = np.stack([raw & np.uint64(0xFFFFFFFF), raw >> np.uint64(32)], axis=1)
                keys = (halves[:, :, None] & masks).reshape(len(fp), 64) | slot
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys.reshape(-1).view(np.int64)), pa.array(np.repeat(fp, 64))],
                    names=["key", "fp"])

    return fps.mapInArrow(run, "key long, fp long")


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b)


def spanning_links(fps: np.ndarray, limit: int) -> tuple[list[int], list[int]]:
    """Links that connect whatever pairs within `limit` bits connect among distinct fingerprints:
    breadth-first, so one link per member and not one per pair."""
    left, frontier, a, b = fps, np.zeros(0, np.uint64), [], []
    while len(left):
        if not len(frontier):
            frontier, left = left[:1], left[1:]
            continue
        near, frontier = frontier[:64], frontier[64:]
        if not len(left):
            break
        close = distance(near[:, None], left[None, :]) <= limit
        hit = close.any(axis=0)
        a.append(near[close[:, hit].argmax(axis=0)])
        b.append(left[hit])
        frontier, left = np.concatenate([frontier, left[hit]]), left[~hit]
    joined = [np.concatenate(x) if x else np.zeros(0, np.uint64) for x in (a, b)]
    return joined[0], joined[1]


def _scan(batches, key_columns: int, limit: int, block: int | None):
    """Links within runs of equal keys in sorted rows. A run longer than `block` is passed on as
    rows (a NULL `b`) instead, member by member, so it is never held as a whole."""
    held_key, held, long_run = None, [], False

    def finish():
        members = np.unique(np.concatenate(held)) if held else np.zeros(0, np.uint64)
        return spanning_links(members, limit) if len(members) > 1 else ([], [])

    def links(found):
        a, b = found
        return _edges(None, np.asarray(a, np.uint64), np.asarray(b, np.uint64))

    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(i).to_numpy(zero_copy_only=False)
                         for i in range(key_columns)], axis=1)
        fps = batch.column(key_columns).to_numpy(zero_copy_only=False).view(np.uint64)
        new = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
        starts = np.concatenate([[0], new])
        ends = np.concatenate([new, [len(fps)]])
        a, b = [], []
        # the first run may continue the one held, the last one may go on: both are kept aside
        inner = np.flatnonzero(ends - starts > 1)
        for i in [0, *[j for j in inner if 0 < j < len(starts) - 1],
                  *([len(starts) - 1] if len(starts) > 1 else [])]:
            run, key = fps[starts[i]:ends[i]], tuple(keys[starts[i]])
            if i == 0 or i == len(starts) - 1:
                if key != held_key:
                    if held and not long_run:
                        x, y = finish()
                        a.append(x), b.append(y)
                    held_key, held, long_run = key, [], False
                if long_run:
                    yield _edges(key[0], run, None)
                    continue
                held.append(run)
                if block and sum(map(len, held)) > block:
                    yield _edges(key[0], np.concatenate(held), None)
                    held, long_run = [], True
            elif block and len(run) > block:
                yield _edges(key[0], run, None)
            else:
                x, y = spanning_links(np.unique(run), limit)
                a.append(x), b.append(y)
        if any(len(x) for x in a):
            yield links((np.concatenate([np.asarray(x, np.uint64) for x in a]),
                         np.concatenate([np.asarray(x, np.uint64) for x in b])))
    if held and not long_run:
        yield links(finish())


def _edges(key, a: np.ndarray, b: np.ndarray | None) -> pa.RecordBatch:
    n = len(a)
    return pa.RecordBatch.from_arrays(
        [pa.array([key] * n, pa.int64()), pa.array(a.view(np.int64)),
         pa.nulls(n, pa.int64()) if b is None else pa.array(b.view(np.int64))],
        names=["key", "a", "b"])


def _divide(rows: DataFrame) -> DataFrame:
    """The members of large variants under each choice of three blocks of the other half."""
    keep = np.array([0xFFFFFFFF ^ sum(0xF << (4 * i) for i in c) for c in REST_BLOCKS], np.uint64)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                key = batch.column(0).slice(at, 4096).to_numpy(zero_copy_only=False)
                fp = batch.column(1).slice(at, 4096).to_numpy(zero_copy_only=False)
                raw = fp.view(np.uint64)
                in_low = (key >> 37) == 0
                other = np.where(in_low, raw >> np.uint64(32), raw & np.uint64(0xFFFFFFFF))
                rest = (other[:, None] & keep) | (
                    np.arange(len(keep), dtype=np.uint64) << np.uint64(32))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(key, len(keep))),
                     pa.array(rest.reshape(-1).view(np.int64)),
                     pa.array(np.repeat(fp, len(keep)))], names=["key", "rest", "fp"])

    return rows.mapInArrow(run, "key long, rest long, fp long")


def links(fps: DataFrame, limit: int = 3, block: int = BLOCK) -> DataFrame:
    """(a, b): links between distinct fingerprints (column `fp`), verified to differ in at most
    `limit` <= 3 bits, that connect everything that pairs within that distance connect.

    Rows of one variant meet in sorted order in one task. Up to `block` they are compared with
    each other; the members of a larger variant are divided anew under keys that hold at most 8192
    values by construction, so neither a group of near copies nor chance fills a task.
    """
    if not 0 <= limit <= 3:
        raise ValueError("two halves with one bit left out find at most 3 differing bits")
    schema = "key long, a long, b long"
    found = written(variants(fps).repartition("key").sortWithinPartitions("key").mapInArrow(
        lambda batches: _scan(batches, 1, limit, block), schema), "simhash-links")
    large = _divide(found.filter(F.col("b").isNull()).select("key", F.col("a").alias("fp")))
    more = large.repartition("key", "rest").sortWithinPartitions("key", "rest").mapInArrow(
        lambda batches: _scan(batches, 2, limit, None), schema)
    return found.filter(F.col("b").isNotNull()).select("a", "b").unionAll(
        more.select("a", "b")).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    words: int = 3, limit: int = 3) -> DataFrame:
    """One row per document: its id, `fingerprint` (16 hex digits) and `component_id`, the smallest
    id reachable over links of fingerprints that differ in at most `limit` bits.

    NULL and empty texts have fingerprint zero and link like others. Rows of equal id count as
    rows; a component of NULL ids alone has a NULL component_id. Other columns are ignored.
    """
    fps = written(fingerprints(docs, id_col, text_col, words), "simhash")
    distinct = written(fps.groupBy("__fp").agg(F.min("__id").alias("__first")), "simhash-distinct")
    groups = component_of(links(distinct.select(F.col("__fp").alias("fp")), limit))
    named = distinct.join(groups, distinct["__fp"] == groups["node"], "left").select(
        "__fp", "__first", F.coalesce("root", "__fp").alias("__root"))
    smallest = named.groupBy("__root").agg(F.min("__first").alias("component_id"))
    classes = named.join(smallest, "__root").select(F.col("__fp").alias("__key"), "component_id")
    return fps.join(classes, F.col("__fp") == F.col("__key")).select(
        F.col("__id").alias(id_col), F.lower(F.lpad(F.hex("__fp"), 16, "0")).alias("fingerprint"),
        "component_id")
