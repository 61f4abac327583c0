"""Steps of many rules: which limits a row reaches, and what all rules within its reach come to.

Each distinct (key, limit) of the entries of `rule_index` is a step, numbered by key and limit, so a
row that reaches a step reaches all steps below it of that key. A row is told by its highest step per
question; rules are rows of entries, never one value. Only the steps are in one place, as numbers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from fraudloom.operators.rule_index import LIMIT

#: Places of a row's steps: four for amounts, then risk, country, category, and two per window.
RISK, COUNTRY, CATEGORY, VELOCITY = 4, 5, 6, 7
BLOCK = "part int, seq int, ids binary, lengths binary, steps binary, places binary, lows binary"


def _halves(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper 64 bits of decimals; NULL is any number."""
    if not len(values):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    both = np.frombuffer(values.buffers()[1], np.int64).reshape(-1, 2)[values.offset:values.offset + len(values)]
    return both[:, 0], both[:, 1]


def _wide(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Numbers of 128 bits as bytes of the same order."""
    out = np.empty((len(low), 2), ">u8")
    out[:, 0] = high.view(np.uint64) ^ np.uint64(1 << 63)
    out[:, 1] = low.view(np.uint64)
    return out.view("S16").ravel()


def _narrow(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Numbers of 64 bits; others become the nearest one."""
    ends = np.iinfo(np.int64)
    return np.where(high == low >> 63, low, np.where(high < 0, ends.min, ends.max))


class Steps:
    """All steps, in the order of their numbers: per key its first number and its sorted limits.

    Limits of a key are 64-bit numbers (times 10^8) where all of them fit between the ends.
    """

    def __init__(self, found: pa.Table):
        """`found` has `key` and `limit`, each pair once, in this order."""
        self.n, self.at, starts = len(found), {}, []
        if self.n:
            low, high = map(np.concatenate, zip(*map(_halves, found["limit"].chunks), strict=True))
            runs = pc.run_end_encode(pa.concat_arrays(found["key"].chunks), run_end_type=pa.int64())
            ends = np.iinfo(np.int64)
            for key, end in zip(runs.values.to_pylist(), runs.run_ends.to_pylist(), strict=True):
                first = starts[-1][1] if starts else 0
                own = slice(first, end)
                short = _narrow(low[own], high[own])
                fits = (high[own] == low[own] >> 63).all() and short[0] > ends.min and short[-1] < ends.max
                self.at[key] = first, short if fits else _wide(low[own], high[own])
                starts.append((first, end))
        self.firsts = np.array([first for first, _ in starts], np.int64)
        self.ends = np.array([end for _, end in starts], np.int64)

    def key_of(self, steps: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.firsts, steps, "right") - 1

    def reached(self, key: str, low: np.ndarray, high: np.ndarray, strict: bool = False) -> np.ndarray | None:
        """Highest step under `key` whose limit is at most the number, or below it; -1 for none."""
        if key not in self.at:
            return None
        first, limits = self.at[key]
        values = _narrow(low, high) if limits.dtype == np.int64 else _wide(low, high)
        n = np.searchsorted(limits, values, "left" if strict else "right")
        return np.where(n > 0, first + n - 1, -1)

    def rows_at_least(self, ended: pa.Table) -> np.ndarray:
        """Per step the rows that reach it; `ended` counts rows by their highest step of a key."""
        n = np.zeros(self.n + 1, np.int64)
        n[ended["step"].to_numpy()] = ended["n"].to_numpy()
        above = np.cumsum(n[::-1])[::-1]
        return above[:-1] - above[self.ends[self.key_of(np.arange(self.n))]] if self.n else above[:-1]


def steps_of(rules: DataFrame) -> Steps:
    """The steps of `rules` with their `entries`; read to the driver as two plain columns."""
    return Steps(rules.select(F.explode("entries").alias("e")).select("e.key", "e.limit").distinct().orderBy(
        "key", "limit").toArrow())


def _lists(values: np.ndarray, lengths: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, pa.int32()))


def _matrix(lists: pa.Array, width: int) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


# ------------------------------------------------------------------------------------- rows


def with_steps(enriched: DataFrame, keep: list[str], shared, windows: tuple[int, ...] = ()) -> DataFrame:
    """`keep` and `rule_set`, a row's highest step per question or -1; `shared` is a broadcast of `Steps`."""
    names = [f"_{m}" for m in windows] or [""]
    tags = [f" {m}" for m in windows] or [""]
    asked = {
        "__amount": F.col("amount").cast(LIMIT), "__currency": F.upper("currency"),
        "__risk": F.col("risk_score").cast(LIMIT), "__country": F.upper(F.trim("country")),
        "__category": F.lower(F.trim("merchant_category"))}
    for i, name in enumerate(names):
        asked[f"__count{i}"] = F.col(f"txn_count{name}").cast(LIMIT)
        asked[f"__total{i}"] = F.col(f"total_amount{name}").cast(LIMIT)
    width = VELOCITY + 2 * len(names)

    def told(batch: pa.RecordBatch, steps: Steps) -> np.ndarray:
        out = np.full((batch.num_rows, width), -1, np.int32)

        def number(place: int, key: str, name: str, strict: bool = False, rows: np.ndarray | None = None) -> None:
            values = batch.column(name)
            own = values.is_valid().to_numpy(zero_copy_only=False)
            if rows is not None:
                own = own & rows
            low, high = _halves(values)
            found = steps.reached(key, low[own], high[own], strict)
            if found is not None:
                out[own, place] = found

        def words(name: str) -> tuple[list[str], np.ndarray]:
            coded = batch.column(name).dictionary_encode()
            return coded.dictionary.to_pylist(), coded.indices.fill_null(-1).to_numpy(zero_copy_only=False)

        for place, over in ((0, ">="), (2, ">")):
            number(place, f"amount{over}", "__amount", over == ">")
        found, codes = words("__currency")
        for code, word in enumerate(found):
            for place, over in ((1, ">="), (3, ">")):
                if f"amount{over} {word}" in steps.at:
                    number(place, f"amount{over} {word}", "__amount", over == ">", codes == code)
        number(RISK, "risk>=", "__risk")
        for place, kind in ((COUNTRY, "country"), (CATEGORY, "category")):
            found, codes = words(f"__{kind}")
            # The last number is that of NULL, whose code is -1.
            out[:, place] = np.array([steps.at.get(f"{kind} {word}", (-1,))[0] for word in found] + [-1])[codes]
        for i, tag in enumerate(tags):
            number(VELOCITY + 2 * i, f"count>={tag}", f"__count{i}")
            number(VELOCITY + 2 * i + 1, f"total>={tag}", f"__total{i}")
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = told(batch, shared.value)
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(name) for name in keep], _lists(found.ravel(), np.full(len(found), width))],
                names=[*keep, "rule_set"])

    schema = StructType([*[enriched.schema[name] for name in keep],
                         StructField("rule_set", ArrayType(IntegerType()))])
    return enriched.select(*keep, *[column.alias(name) for name, column in asked.items()]).mapInArrow(run, schema)


# ------------------------------------------------------------------------------------ rules


def _steps_in(entries: pa.Array, steps: Steps) -> tuple[np.ndarray, np.ndarray]:
    """Steps of all entries, and how many each rule has."""
    flat = entries.flatten()
    coded, limits = flat.field("key").dictionary_encode(), flat.field("limit")
    codes, (low, high) = coded.indices.to_numpy(), _halves(limits)
    out, order = np.empty(len(flat), np.int32), np.argsort(codes, kind="stable")
    cuts = np.searchsorted(codes[order], np.arange(len(coded.dictionary) + 1))
    for key, begin, end in zip(coded.dictionary.to_pylist(), cuts, cuts[1:], strict=False):
        own = order[begin:end]
        out[own] = steps.reached(key, low[own], high[own])
    return out, entries.value_lengths().to_numpy()


def blocks(rules: DataFrame, shared) -> DataFrame:
    """Rules in the order of `rule_order` and `id`, some thousands a row, as bytes.

    `ids` are their texts, each after a comma, and `lengths` the sizes of these (0 where it is NULL). The
    entries are sorted by step: their rule in the block, and the first entry of the same key.
    """
    order = ["rule_order", "id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, steps = TaskContext.get().partitionId(), shared.value
        for seq, batch in enumerate(batches):
            own, counts = _steps_in(batch.column("entries"), steps)
            wide = pa.large_string()
            texts = pc.binary_join_element_wise(
                pa.scalar("", wide), batch.column("text").cast(wide), pa.scalar(",", wide)).fill_null("")
            at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
            by = np.argsort(own, kind="stable")
            keys = steps.key_of(own[by])
            yield pa.RecordBatch.from_pydict({
                "part": pa.array([part], pa.int32()), "seq": pa.array([seq], pa.int32()),
                "ids": [texts.buffers()[2].to_pybytes()[at[0]:at[-1]] if at[-1] > at[0] else b""],
                **{name: [np.ascontiguousarray(values, np.int32).tobytes()] for name, values in (
                    ("lengths", np.diff(at)), ("steps", own[by]),
                    ("places", np.repeat(np.arange(len(counts)), counts)[by]),
                    ("lows", np.searchsorted(keys, keys, "left")))}})

    return rules.where(F.size("entries") > 0).repartitionByRange(*order).sortWithinPartitions(*order).select(
        F.col("id").cast("string").alias("text"), "entries").mapInArrow(run, BLOCK)


class _Digests:
    """Digests of the sets of one chunk; rules come block by block, so a set costs one running digest.

    Sets that have met the same rules so far share it.
    """

    def __init__(self, sets: np.ndarray, steps: Steps):
        self.sets = sets
        self.steps, place = np.unique(sets, return_inverse=True)
        self.place = place.reshape(sets.shape)
        self.first = np.full(len(self.steps), -1, np.int64)
        some = self.steps >= 0
        self.first[some] = steps.firsts[steps.key_of(self.steps[some])]
        self.group = np.zeros(len(sets), np.int64)
        self.states = [(hashlib.sha256(), 0, False)]

    def add(self, ids: bytes, *arrays: bytes) -> None:
        lengths, steps, places, lows = (np.frombuffer(array, np.int32) for array in arrays)
        text = np.frombuffer(ids, np.uint8)
        # How far into the block's entries each step reaches; 0 where no entry of its key is reached.
        upto = np.searchsorted(steps, self.steps, "right")
        upto[(self.steps < 0) | (upto <= np.searchsorted(steps, self.first, "left"))] = 0
        kinds, kind = np.unique(np.sort(upto[self.place], axis=1), axis=0, return_inverse=True)
        old = len(self.states)
        pairs, self.group = np.unique(kind.ravel() * old + self.group, return_inverse=True)
        states, made = [], (-1, b"", 0)
        for of, group in zip((pairs // old).tolist(), (pairs % old).tolist(), strict=True):
            if of != made[0]:
                met = np.zeros(len(lengths), bool)
                for end in set(kinds[of].tolist()) - {0}:
                    met[places[lows[end - 1]:end]] = True
                made = of, text[np.repeat(met, lengths)].tobytes() if met.any() else b"", int(met.sum())
            state, n, begun = self.states[group]
            if made[1]:
                state = state.copy()
                state.update(made[1] if begun else memoryview(made[1])[1:])
            states.append((state, n + made[2], begun or bool(made[1])))
        self.states = states

    def told(self) -> pa.RecordBatch:
        told = [(n, state.hexdigest()) for state, n, _ in self.states]
        n, width = self.sets.shape
        return pa.RecordBatch.from_pydict({
            "rule_set": _lists(self.sets.ravel(), np.full(n, width)),
            "n_matches": pa.array([told[group][0] for group in self.group.tolist()], pa.int64()),
            "matched_sha256": pa.array([told[group][1] for group in self.group.tolist()], pa.string())})


def digests(sets: DataFrame, rules: DataFrame, shared, chunks: int, width: int) -> DataFrame:
    """Per distinct `rule_set` the number of its rules and the digest of their ids in rule order.

    Sets are dealt into `chunks`; every chunk reads all blocks of rules in order, one after the other.
    """
    cells = [name.split()[0] for name in BLOCK.split(", ")]
    none = [F.lit(None).cast("binary").alias(name) for name in cells[2:]]
    own = sets.select(
        F.pmod(F.xxhash64("rule_set"), F.lit(chunks)).cast("int").alias("chunk"), F.lit(-1).alias("part"),
        F.lit(0).alias("seq"), *none, "rule_set")
    dealt = blocks(rules, shared).select(
        F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"), *cells,
        F.lit(None).cast("array<int>").alias("rule_set"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, waiting, running = None, [], None
        for batch in batches:
            parts, numbers = batch.column("part").to_numpy(), batch.column("chunk").to_numpy()
            at = 0
            while at < batch.num_rows:
                if numbers[at] != chunk:
                    yield from ended(waiting, running)
                    chunk, waiting, running = numbers[at], [], None
                if parts[at] < 0:
                    same = (parts[at:] < 0) & (numbers[at:] == chunk)
                    end = at + (len(same) if same.all() else int(same.argmin()))
                    waiting.append(_matrix(batch.column("rule_set").slice(at, end - at), width).copy())
                    at = end
                    continue
                if running is None and waiting:
                    running = _Digests(np.concatenate(waiting), shared.value)
                    waiting = []
                if running is not None:
                    running.add(*[batch.column(name)[at].as_buffer() for name in cells[2:]])
                at += 1
        yield from ended(waiting, running)

    def ended(waiting: list, running: _Digests | None) -> Iterator[pa.RecordBatch]:
        if waiting:
            running = _Digests(np.concatenate(waiting), shared.value)
        if running is not None:
            yield running.told()

    return own.unionByName(dealt).repartitionById(chunks, "chunk").sortWithinPartitions(
        "chunk", "part", "seq").mapInArrow(
        run, "rule_set array<int>, n_matches bigint, matched_sha256 string")


# ----------------------------------------------------------------------------------- counts


def rule_totals(rules: DataFrame, shared, rows_at_least) -> DataFrame:
    """Per rule the sum over its entries of the rows that reach them, as `n`.

    No row reaches two entries of a rule but both of a velocity rule, `count` (within its key) and `total`.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps, rows = shared.value, rows_at_least.value
        for batch in batches:
            own, counts = _steps_in(batch.column("entries"), steps)
            begins = np.cumsum(counts) - counts
            n = np.add.reduceat(rows[own], begins) if len(own) else np.zeros(0, np.int64)
            alone = ~((batch.column("rule_type").to_numpy(zero_copy_only=False) == "VELOCITY") & (counts == 2))
            first = own[begins]
            second = own[np.minimum(begins + 1, len(own) - 1)] if len(own) else own
            yield pa.RecordBatch.from_arrays([
                batch.column("id"), batch.column("window"), pa.array(n, pa.int64()),
                pa.array(first - steps.firsts[steps.key_of(first)], pa.int32(), mask=alone),
                pa.array(second, pa.int32(), mask=alone)], names=["id", "window", "n", "count", "total"])

    wanted = rules.where(F.size("entries") > 0).select("id", "window", "rule_type", "entries")
    schema = StructType([wanted.schema["id"], wanted.schema["window"]])
    return wanted.mapInArrow(run, schema.add("n", "long").add("count", "integer").add("total", "integer"))


def rows_of_both(sets: DataFrame, pairs: DataFrame, steps: Steps, windows: tuple[int, ...]) -> DataFrame:
    """Adds to distinct (`window`, `count`, `total`) the `both` rows that reach both steps.

    A row stands under one node per level of a binary tree over the steps of its count, and the steps from
    a limit on are at most one node per level, so each pair meets its rows by a running sum over totals.
    """
    keys = [f"count>= {m}" for m in windows] or ["count>="]
    size = max([len(steps.at[key][1]) for key in keys if key in steps.at], default=0)
    bits = size.bit_length()

    def reached(i: int, m: int) -> Column:
        first = steps.at[keys[i]][0] if keys[i] in steps.at else 0
        count, total = F.col("rule_set")[VELOCITY + 2 * i], F.col("rule_set")[VELOCITY + 2 * i + 1]
        return F.when((count >= 0) & (total >= 0), F.struct(
            F.lit(m).alias("window"), (count - first).alias("count"), total.alias("total")))

    rows = sets.select("transactions", F.explode(F.array_compact(F.array(
        *[reached(i, m) for i, m in enumerate(windows or (0,))]))).alias("r")).select(
        "transactions", "r.*").groupBy("window", "count", "total").agg(F.sum("transactions").alias("n"))
    under = rows.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(bits)))).select(
        "window", "level", F.expr("shiftright(count, level)").alias("node"), "total", "n",
        F.lit(None).cast("int").alias("count"))
    rest = f"({1 << bits} - count)"
    asked = pairs.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(bits)))).where(
        f"shiftright({rest}, level) % 2 = 1").select(
        "window", "level", F.expr(
            f"shiftright({1 << bits} - shiftleft(shiftright({rest}, level + 1), level + 1), level) - 1").alias("node"),
        "total", F.lit(0).cast("long").alias("n"), "count")
    found = under.unionByName(asked).selectExpr("*", (
        "sum(n) OVER (PARTITION BY window, level, node ORDER BY total DESC"
        " RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS both"))
    return found.where("count IS NOT NULL").groupBy("window", "count", "total").agg(F.sum("both").alias("both"))
