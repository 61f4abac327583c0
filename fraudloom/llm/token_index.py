"""Token id shards with a minimal perfect hash index from document key to shard offset.

Format of a folder:

* `shards`: one row per shard. `part` and `shard` order the shards, `doc_ids`, `counts` list its
  documents in order, `payload` holds their ids back to back (little-endian, `width` bytes each).
* `index`: one row per bucket of hashed keys. `levels` are the bit arrays of the minimal perfect
  hash, `fingerprints` a check of the key in each slot, `part`, `shard`, `offset`, `count`, `copies`
  what the slot points at.

Payloads are binary cells of Parquet files because Spark's own writers reach any store the cluster
uses; a Python worker can write bare files only to a disk of its own.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F, Window

from fraudloom.llm.common import in_pieces
from fraudloom.llm.tokens import CHARS, encoder

SHARD_BYTES = 4 << 20
KEYS_PER_BUCKET = 8192
#: Bits of a level per key that is still to place.
GAMMA = 2.0

SHARDS = "part int, shard int, width int, doc_ids array<long>, counts array<long>, payload binary"
INDEX = ("bucket long, levels array<binary>, fingerprints binary, part array<int>, "
         "shard array<int>, offset array<long>, count array<long>, copies array<long>")
LOCATED = "key long, part int, shard int, offset long, count long, copies long"


def mix(keys: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit finaliser over keys and seed (splitmix64)."""
    add = (seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF
    x = keys.astype(np.int64).view(np.uint64) + np.uint64(add)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def build_levels(keys: np.ndarray) -> list[np.ndarray]:
    """Bit arrays of a minimal perfect hash over distinct keys: a key sets its bit in the first
    level where no other key of that level has the same place."""
    levels, left = [], keys
    while len(left):
        size = max(8, int(len(left) * GAMMA))
        place = (mix(left, len(levels)) % np.uint64(size)).astype(np.int64)
        bits = np.bincount(place, minlength=size) == 1
        levels.append(bits)
        left = left[~bits[place]]
    return levels


def slots(keys: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """The slot of each key, the rank of its bit; -1 where no level has one."""
    out, open_, base = np.full(len(keys), -1, np.int64), np.arange(len(keys)), 0
    for n, bits in enumerate(levels):
        place = (mix(keys[open_], n) % np.uint64(len(bits))).astype(np.int64)
        found = bits[place]
        ranks = np.cumsum(bits) - 1
        out[open_[found]] = base + ranks[place[found]]
        open_, base = open_[~found], base + int(bits.sum())
    return out


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (mix(keys, 1 << 20) >> np.uint64(32)).astype("<u4")


def pack_bits(bits: np.ndarray) -> bytes:
    return len(bits).to_bytes(8, "little") + np.packbits(bits).tobytes()


def unpack_bits(raw: bytes) -> np.ndarray:
    return np.unpackbits(np.frombuffer(raw, np.uint8, offset=8),
                         count=int.from_bytes(raw[:8], "little")).astype(bool)


def write_shards(docs: DataFrame, path: str, tokenizer: str, end_id: int, id_col: str = "doc_id",
                 text_col: str = "text", partitions: int | None = None) -> None:
    """Encodes every text and writes the shards in ascending order of the document key."""
    spark = docs.sparkSession
    wanted = docs.select(F.col(id_col).cast("long").alias("__id"),
                         F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    order = ["__id", F.xxhash64("__text")]
    partitions = partitions or max(
        int(spark.conf.get("spark.sql.shuffle.partitions")), wanted.rdd.getNumPartitions())
    arrow = pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("width", pa.int32()),
                       ("doc_ids", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64())),
                       ("payload", pa.binary())])

    def run(batches):
        part, shard = TaskContext.get().partitionId(), 0
        keys, counts, payload, held = [], [], [], 0
        width = None

        def row():
            return pa.RecordBatch.from_arrays(
                [pa.array([v], type=f.type) for v, f in zip(
                    (part, shard, width, keys, counts, b"".join(payload)), arrow)], schema=arrow)

        for piece in in_pieces(batches, "__text", CHARS):
            known = encoder(tokenizer)
            width = 2 if max(known.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else 4
            end = np.array([end_id], "<u4").tobytes()
            for key, ids in zip(piece.column(0).to_pylist(), known.batch(piece.column(1))):
                ids += end
                keys.append(key)
                counts.append(len(ids) // 4)
                payload.append(np.frombuffer(ids, "<u4").astype(f"<u{width}").tobytes())
                held += len(payload[-1])
                if held >= SHARD_BYTES:
                    yield row()
                    keys, counts, payload, held, shard = [], [], [], 0, shard + 1
        if keys:
            yield row()

    wanted.repartitionByRange(partitions, *order).sortWithinPartitions(*order).mapInArrow(
        run, SHARDS).write.option("compression", "zstd").parquet(f"{path}/shards")


def build_index(shards: DataFrame, path: str) -> None:
    """Builds the minimal perfect hash of each bucket of keys and writes it beside the shards.

    A key stored more than once points at its first row and counts its rows; rows without a key
    are not indexed.
    """
    entries = places(shards).filter(F.col("key").isNotNull())
    n_keys = shards.select(F.sum(F.size("doc_ids")).alias("n")).first()["n"] or 0
    buckets = max(1, -(-n_keys // KEYS_PER_BUCKET))
    keyed = entries.groupBy("key").agg(
        F.min(F.struct("part", "shard", "offset", "count")).alias("first"),
        F.count(F.lit(1)).alias("copies")).select(
        F.pmod(F.xxhash64("key"), F.lit(buckets)).alias("bucket"), "key", "first.*", "copies")

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        keys = frame["key"].to_numpy()
        levels = build_levels(keys)
        order = np.argsort(slots(keys, levels))
        frame = frame.iloc[order]
        return pd.DataFrame([{
            "bucket": frame["bucket"].iloc[0], "levels": [pack_bits(b) for b in levels],
            "fingerprints": fingerprints(keys[order]).tobytes(),
            **{c: frame[c].to_numpy() for c in ("part", "shard", "offset", "count", "copies")}}])

    keyed.groupBy("bucket").applyInPandas(run, INDEX).withColumn(
        "buckets", F.lit(buckets).cast("long")).write.parquet(f"{path}/index")


def places(shards: DataFrame) -> DataFrame:
    """One row per stored document: key, part, shard, offset, count. Reads no payload."""
    return shards.select("part", "shard", "doc_ids", "counts").mapInArrow(
        _entries, "key long, part int, shard int, offset long, count long")


def _entries(batches):
    arrow = pa.schema([("key", pa.int64()), ("part", pa.int32()), ("shard", pa.int32()),
                       ("offset", pa.int64()), ("count", pa.int64())])
    for batch in batches:
        for row in batch.to_pylist():
            counts = np.array(row["counts"], np.int64)
            n = len(counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array(row["doc_ids"], pa.int64()), pa.array([row["part"]] * n, pa.int32()),
                 pa.array([row["shard"]] * n, pa.int32()), pa.array(np.cumsum(counts) - counts),
                 pa.array(counts)], schema=arrow)


def write_token_index(docs: DataFrame, path: str, tokenizer: str, end_id: int,
                      id_col: str = "doc_id", text_col: str = "text",
                      partitions: int | None = None) -> None:
    """Writes shards and index of `docs` to `path`.

    Every whole text is encoded and followed by `end_id`; a NULL text counts as empty. Documents
    lie in ascending order of the key (NULL first), those of equal key in order of a hash of the
    text. Other columns are ignored. An empty table writes an index without buckets.
    """
    write_shards(docs, path, tokenizer, end_id, id_col, text_col, partitions)
    spark = docs.sparkSession
    build_index(spark.read.schema(SHARDS).parquet(f"{path}/shards"), path)


def lookup(spark: SparkSession, path: str, keys: DataFrame, key_col: str = "key") -> DataFrame:
    """Finds keys through the index: one row per key found, with its location and row count.

    A key costs one hash per level and one comparison; keys not in the index are rejected by their
    fingerprint (a foreign key passes once in 4 billion). Keys go to their bucket by an equi-join.
    """
    index = spark.read.schema(INDEX + ", buckets long").parquet(f"{path}/index")
    known = index.select("buckets").limit(1).collect()
    if not known:
        return spark.createDataFrame([], LOCATED)
    wanted = keys.select(F.col(key_col).cast("long").alias("key")).filter(
        F.col("key").isNotNull()).distinct().groupBy(
        F.pmod(F.xxhash64("key"), F.lit(known[0]["buckets"])).alias("bucket"))
    columns = ("part", "shard", "offset", "count", "copies")

    def run(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        if not len(asked) or not len(held):
            return pd.DataFrame({c: [] for c in ("key", *columns)})
        row, wanted = held.iloc[0], asked["key"].to_numpy()
        slot = slots(wanted, [unpack_bits(b) for b in row["levels"]])
        stored = np.frombuffer(row["fingerprints"], "<u4")
        found = (slot >= 0) & (stored[slot] == fingerprints(wanted))
        return pd.DataFrame({"key": wanted[found], **{
            c: np.asarray(row[c])[slot[found]] for c in columns}})

    return wanted.cogroup(index.drop("buckets").groupBy("bucket")).applyInPandas(run, LOCATED)


def fetch(spark: SparkSession, path: str, keys: DataFrame, key_col: str = "key") -> DataFrame:
    """Token ids by key: one row per stored document of each key found, with part, shard, offset,
    count and `ids` (little-endian unsigned 32-bit).

    Places come from the index, the further places of a key that is stored more than once from the
    key lists of the shards. Places meet their shard by an equi-join, one list per shard, and each
    payload is cut at offset and count; shards without a wanted key are not cut. Keys that are not
    stored, and NULL keys, give no row; a key asked for twice counts once.
    """
    shards = spark.read.schema(SHARDS).parquet(f"{path}/shards")
    found = lookup(spark, path, keys, key_col)
    several = found.filter(F.col("copies") > 1).select(F.col("key").alias("__key"))
    place = ["key", "part", "shard", "offset", "count"]
    more = places(shards).join(several, F.col("key") == F.col("__key")).select(*place)
    wanted = found.filter(F.col("copies") == 1).select(*place).unionAll(more).groupBy(
        "part", "shard").agg(F.collect_list(F.struct("key", "offset", "count")).alias("wanted"))
    arrow = pa.schema([("key", pa.int64()), ("part", pa.int32()), ("shard", pa.int32()),
                       ("offset", pa.int64()), ("count", pa.int64()), ("ids", pa.binary())])

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(j)[i] for j, c in enumerate(batch.schema.names)}
                asked = row["wanted"].values
                key, offset, count = (asked.field(c) for c in ("key", "offset", "count"))
                payload = np.frombuffer(row["payload"].as_buffer(), f"<u{row['width'].as_py()}")
                cut = [payload[a:a + n].astype("<u4").tobytes()
                       for a, n in zip(offset.to_pylist(), count.to_pylist())]
                n = len(cut)
                yield pa.RecordBatch.from_arrays(
                    [key, pa.array([row["part"].as_py()] * n, pa.int32()),
                     pa.array([row["shard"].as_py()] * n, pa.int32()), offset, count,
                     pa.array(cut, pa.binary())], schema=arrow)

    return shards.select("part", "shard", "width", "payload").join(wanted, ["part", "shard"]).mapInArrow(
        run, "key long, part int, shard int, offset long, count long, ids binary")


def shard_starts(shards: DataFrame) -> DataFrame:
    """(part, shard, shard_start): the ids of all documents before each shard, from sums per part and
    per shard, so no task sees more than the list of parts. Reads no payload."""
    sums = shards.select("part", "shard", F.aggregate(
        "counts", F.lit(0).cast("long"), lambda a, x: a + x).alias("__ids"))
    so_far = (Window.unboundedPreceding, -1)
    parts = sums.groupBy("part").agg(F.sum("__ids").alias("__ids")).select(
        "part", F.coalesce(F.sum("__ids").over(Window.orderBy("part").rowsBetween(*so_far)),
                           F.lit(0)).alias("__part_start"))
    inside = sums.select("part", "shard", F.coalesce(F.sum("__ids").over(
        Window.partitionBy("part").orderBy("shard").rowsBetween(*so_far)), F.lit(0)).alias("__before"))
    return inside.join(parts, "part").select(
        "part", "shard", (F.col("__part_start") + F.col("__before")).alias("shard_start"))


def read_back(spark: SparkSession, path: str, only_keyless: bool = False) -> DataFrame:
    """Reads every stored document from its shard: key, part, shard, offset, n_tokens, crc32 of the
    ids as little-endian unsigned 32-bit integers, and `start`, the ids of all documents before it.

    With `only_keyless`, documents without a key alone, which no index finds; shards without any are
    not decoded.
    """
    shards = spark.read.schema(SHARDS).parquet(f"{path}/shards")
    arrow = pa.schema([("key", pa.int64()), ("part", pa.int32()), ("shard", pa.int32()),
                       ("offset", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                counts = np.array(row["counts"], np.int64)
                ids = memoryview(np.frombuffer(row["payload"], f"<u{row['width']}").astype("<u4"))
                ends = np.cumsum(counts)
                n = len(counts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["doc_ids"], pa.int64()), pa.array([row["part"]] * n, pa.int32()),
                     pa.array([row["shard"]] * n, pa.int32()), pa.array(ends - counts),
                     pa.array(counts),
                     pa.array([zlib.crc32(ids[a:b]) for a, b in zip(ends - counts, ends)],
                              pa.int64())], schema=arrow)

    schema = ("key long, part int, shard int, offset long, n_tokens long, ids_crc32 long")
    decoded = shards.filter(F.exists("doc_ids", lambda k: k.isNull())) if only_keyless else shards
    stored = decoded.mapInArrow(run, schema)
    if only_keyless:
        stored = stored.filter(F.col("key").isNull())
    return stored.join(shard_starts(shards), ["part", "shard"]).select(
        "key", "part", "shard", "offset", (F.col("shard_start") + F.col("offset")).alias("start"),
        "n_tokens", "ids_crc32")
