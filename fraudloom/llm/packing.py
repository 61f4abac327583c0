"""Harmonic packing of token ids into fixed-size sequences."""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, Window

from fraudloom.llm.common import in_pieces, written
from fraudloom.llm.tokens import CHARS, encoder

#: Classes below capacity / FINEST are not cut further.
FINEST = 32
BIN_BITS, CLASS_BITS = 28, 12
#: Takes the place of the worker's number in sequences filled from several workers.
SHARED, MIXED = (1 << 22) - 1, (1 << 22) - 2

PIECES = ("doc_id {id}, start long, length long, ids binary, ids_crc32 long, doc_tokens long, "
          "worker int, place long, sequence_id long, offset long")


def piece_lengths(tokens: int, capacity: int) -> list[int]:
    """Cuts a document into whole sequences, then into the largest reciprocal parts of the
    capacity (1/2, 1/3, ...) that still fit, and a short rest."""
    whole, rest = divmod(tokens, capacity)
    out = [capacity] * whole
    while rest:
        share = -(-capacity // rest)  # the first k with capacity / k <= rest
        size = capacity // share
        if share > FINEST or size == 0:
            size = rest
        out.append(size)
        rest -= size
    return out


def sequence_number(worker, size, bin_no):
    """One number per sequence, of the worker, the class and the bin."""
    return (worker << (BIN_BITS + CLASS_BITS)) | (size << BIN_BITS) | bin_no


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id",
                   text_col: str = "text", capacity: int = 2048) -> DataFrame:
    """Packs the token ids of every document, each followed by `end_id`, into sequences.

    One row per piece: the document, the piece's place in it, its ids (little-endian unsigned
    32-bit) and where it lies: `sequence_id`, `offset`. Every worker fills the bins of each class,
    a piece length s, with capacity // s pieces, without regard to other workers. What is left in
    unfilled bins, fewer than one bin per class and worker, is numbered over all workers by counts
    per worker and filled the same way; the last unfilled bin of each class shares a sequence with
    others of its kind. Sequence numbers are unique, not consecutive.

    A NULL or empty text gives the end id alone. Rows that repeat a doc_id, or have none, are
    packed as rows of their own. An empty table gives no rows. Other columns are ignored.
    """
    if capacity >= 1 << CLASS_BITS:
        raise ValueError(f"capacity must be below {1 << CLASS_BITS}")
    wanted = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("__text"))
    kind = wanted.schema["doc_id"].dataType.simpleString()
    schema = docs.sparkSession.createDataFrame([], PIECES.format(id=kind)).schema
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        worker = TaskContext.get().partitionId()
        open_bins, filled = defaultdict(list), defaultdict(int)
        out = []

        def emit():
            columns = list(zip(*out)) if out else [[] for _ in names]
            out.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(c, type=f.type) for c, f in zip(columns, arrow)], schema=arrow)

        id_type = None
        for piece in in_pieces(batches, "__text", CHARS):
            if id_type is None:
                arrow = _schema(piece.schema.field(0).type)
                names, id_type = arrow.names, True
            ids_of = encoder(tokenizer).batch(piece.column(1))
            for doc, ids in zip(piece.column(0).to_pylist(), ids_of):
                ids += end
                total, start = len(ids) // 4, 0
                for size in piece_lengths(total, capacity):
                    part = ids[4 * start:4 * (start + size)]
                    row = (doc, start, size, part, zlib.crc32(part), total)
                    start += size
                    bin_ = open_bins[size]
                    bin_.append(row)
                    if len(bin_) == capacity // size:
                        number = sequence_number(worker, size, filled[size])
                        out.extend((*r, worker, None, number, i * size)
                                   for i, r in enumerate(bin_))
                        filled[size] += 1
                        bin_.clear()
            yield emit()
        for bin_ in open_bins.values():
            out.extend((*r, worker, i, None, None) for i, r in enumerate(bin_))
        if out:
            yield emit()

    pieces = written(wanted.mapInArrow(run, schema), "packing")
    full = pieces.filter(F.col("place").isNull()).drop("worker", "place")
    return full.unionByName(_fill_rest(pieces.filter(F.col("place").isNotNull()), capacity))


def _schema(id_type: pa.DataType) -> pa.Schema:
    whole = pa.int64()
    return pa.schema([("doc_id", id_type), ("start", whole), ("length", whole),
                      ("ids", pa.binary()), ("ids_crc32", whole), ("doc_tokens", whole),
                      ("worker", pa.int32()), ("place", whole), ("sequence_id", whole),
                      ("offset", whole)])


def _fill_rest(rest: DataFrame, capacity: int) -> DataFrame:
    """Fills bins from what the workers have left over; only counts are gathered."""
    counts = rest.groupBy("length", "worker").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy("length").orderBy("worker").rowsBetween(
        Window.unboundedPreceding, -1)
    bases = counts.select("length", "worker",
                          F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    totals = {r["length"]: r["n"] for r in
              counts.groupBy("length").agg(F.sum("__n").alias("n")).collect()}
    shares = mixed_bins({size: n % (capacity // size) for size, n in totals.items()}, capacity)
    plan = rest.sparkSession.createDataFrame(
        [(size, n - n % (capacity // size), *shares.get(size, (0, 0)))
         for size, n in totals.items()],
        "length long, __whole long, __mixed_bin long, __mixed_offset long")
    index = F.col("place") + F.col("__base")
    per_bin = F.floor(F.lit(capacity) / F.col("length")).cast("long")
    whole = index < F.col("__whole")

    def number(worker, size, bin_no):
        return F.lit(worker << (BIN_BITS + CLASS_BITS)) + F.shiftleft(size, BIN_BITS) + bin_no

    return rest.join(bases, ["length", "worker"]).join(F.broadcast(plan), "length").select(
        "doc_id", "start", "length", "ids", "ids_crc32", "doc_tokens",
        F.when(whole, number(SHARED, F.col("length"), F.floor(index / per_bin).cast("long")))
        .otherwise(number(MIXED, F.lit(0).cast("long"), F.col("__mixed_bin"))).alias("sequence_id"),
        F.when(whole, (index % per_bin) * F.col("length"))
        .otherwise(F.col("__mixed_offset") + (index - F.col("__whole")) * F.col("length"))
        .alias("offset"))


def mixed_bins(left: dict[int, int], capacity: int) -> dict[int, tuple[int, int]]:
    """A bin and an offset for the last pieces of each class, largest first, first fit.

    There are at most as many classes as piece lengths, whatever the corpus holds.
    """
    used, out = [], {}
    for size, n in sorted(left.items(), key=lambda x: (-x[0] * x[1], x[0])):
        if not n:
            continue
        bin_no = next((i for i, u in enumerate(used) if u + size * n <= capacity), len(used))
        if bin_no == len(used):
            used.append(0)
        out[size] = (bin_no, used[bin_no])
        used[bin_no] += size * n
    return out
