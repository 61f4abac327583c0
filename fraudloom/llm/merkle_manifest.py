"""Merkle manifest of a dataset that stores only every few levels of its trees.

A leaf is the digest of one row. The leaves of a group form a tree, and the roots of the groups form
one more. Between two stored levels lie aligned subtrees of `arity ** levels` stored nodes; a proof
rebuilds the nodes inside a subtree from the stored ones below, hands out siblings and forgets them.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from fraudloom.llm.common import to_arrow, written
from fraudloom.llm.ranks import ranked

#: Levels between two stored ones: subtrees of 64 nodes at arity 2.
LEVELS = 6


def sha(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def leaf_digest(*fields: Column) -> Column:
    """Digest of fields in order: `-` for NULL, else UTF-8 byte count, `:` and the value as text."""
    parts = []
    for field in fields:
        text = field.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text),
                                F.lit("-")))
    return sha(F.concat(*parts))


def fold(leaf: Column, proof: Column) -> Column:
    """The root that follows from a leaf and its proof."""
    return F.aggregate(proof, leaf, lambda node, side: sha(F.concat(
        F.substring_index(side, ":", 1), node, F.substring_index(side, ":", -1))))


def siblings(proof: Column) -> Column:
    """All digests of a proof, level by level and left to right, as one text."""
    return F.replace(F.array_join(proof, ""), F.lit(":"), F.lit(""))


def height(nodes: int, levels: int, arity: int) -> int:
    """Levels from `nodes` nodes up to one, at most `levels`."""
    done = 0
    while nodes > 1 and done < levels:
        nodes, done = -(-nodes // arity), done + 1
    return done


def regenerate(digests: list[str], levels: int, arity: int) -> tuple[str, list[list[str]]]:
    """The top of one aligned subtree and, per stored node, its siblings at each level.

    A side is `before:after`, the digests left and right of the node in its run. A last run of one
    node has no sibling and is hashed alone.
    """
    sides = [[] for _ in digests]
    nodes, width = digests, 1
    for _ in range(levels):
        above = []
        for begin in range(0, len(nodes), arity):
            run = nodes[begin:begin + arity]
            above.append(hashlib.sha256("".join(run).encode()).hexdigest())
            for i in range(len(run)):
                side = "".join(run[:i]) + ":" + "".join(run[i + 1:])
                for own in sides[(begin + i) * width:(begin + i + 1) * width]:
                    own.append(side)
        nodes, width = above, width * arity
    return nodes[0], sides


@dataclass
class Tree:
    """Stored levels from the leaves upwards: (group, pos, digest, n, payload)."""

    stored: list[DataFrame]
    levels: int
    arity: int

    @property
    def tops(self) -> DataFrame:
        """(group, digest): the root of every group."""
        parts = [s.filter(F.col("n") == 1).select("group", "digest") for s in self.stored]
        out = parts[0]
        for part in parts[1:]:
            out = out.unionAll(part)
        return out


@dataclass
class Manifest:
    groups: Tree
    roots: Tree

    @property
    def root(self) -> DataFrame:
        """(digest): the root of the dataset; no row for an empty one."""
        return self.roots.tops.select("digest")


def build(rows: DataFrame, group: str, order: list[str], digest: str, payload: list[str],
          name: str, levels: int = LEVELS, arity: int = 2) -> Tree:
    """The stored levels of one tree per group over rows in `order`; equal rows are all leaves."""
    leaves = ranked(rows, group, [F.col(c) for c in order], f"{name}-order").select(
        F.col(group).alias("group"), F.col("rank").alias("pos"), F.col(digest).alias("digest"),
        F.col("members").alias("n"), F.struct(*payload, F.lit(0).alias("__")).alias("payload"))
    stored = [written(leaves, f"{name}-level-0")]
    span = arity ** levels
    while not (larger := stored[-1].filter(F.col("n") > 1)).isEmpty():
        above = _subtrees(larger, span).mapInArrow(
            _climb(levels, arity), _schema(larger, "group {group}, pos long, digest string, n long"))
        stored.append(written(above.withColumn("payload", F.struct(F.lit(0).alias("__"))),
                              f"{name}-level-{len(stored) * levels}"))
    return Tree(stored, levels, arity)


def _schema(rows: DataFrame, text: str, **kinds: str):
    kinds["group"] = rows.schema["group"].dataType.simpleString()
    return rows.sparkSession.createDataFrame([], text.format(**kinds)).schema


def _subtrees(nodes: DataFrame, span: int) -> DataFrame:
    """One row per aligned subtree; at most `span` entries each."""
    return nodes.withColumn("block", F.expr(f"pos div {span}")).groupBy("group", "block").agg(
        F.max("n").alias("n"),
        F.sort_array(F.collect_list(F.struct("pos", "digest", "payload"))).alias("nodes"))


def _climb(levels: int, arity: int):
    span = arity ** levels

    def run(batches):
        for batch in batches:
            counts = batch.column(2).to_pylist()
            digests = pa.array([regenerate(
                [node["digest"] for node in nodes.as_py()], height(n, levels, arity), arity)[0]
                for n, nodes in zip(counts, batch.column(3))], pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), digests,
                 pa.array([-(-n // span) for n in counts], pa.int64())],
                names=["group", "pos", "digest", "n"])

    return run


def _emit(levels: int, arity: int, out: pa.Schema):
    def run(batches):
        for batch in batches:
            for begin in range(0, batch.num_rows, 64):
                piece = batch.slice(begin, 64)
                column = dict(zip(piece.schema.names, piece.columns))
                nodes = column["nodes"]
                sizes = nodes.value_lengths().to_pylist()
                flat = nodes.flatten()
                digests = flat.field("digest").to_pylist()
                proofs, at = [], 0
                for size, n, upper in zip(sizes, column["n"].to_pylist(),
                                          column["upper"].to_pylist()):
                    sides = regenerate(digests[at:at + size], height(n, levels, arity), arity)[1]
                    proofs.extend([*own, *upper] for own in sides)
                    at += size
                row = pa.array([i for i, size in enumerate(sizes) for _ in range(size)], pa.int64())
                made = {"group": column["group"].take(row), "subroot": column["subroot"].take(row),
                        "root": column["root"].take(row), "proof": pa.array(
                            proofs, pa.list_(pa.string())),
                        **{k: flat.field(k) for k in ("pos", "digest", "payload")}}
                yield pa.RecordBatch.from_arrays(
                    [made[f.name].cast(f.type) for f in out], schema=out)

    return run


def proofs(tree: Tree, tops: DataFrame) -> DataFrame:
    """(group, pos, digest, payload, proof, subroot, root) of every leaf of a tree.

    `tops` (group, upper, subroot, root) tells how each group's root goes on upwards. Works from the
    highest stored level down; only proofs of stored nodes above the leaves pass a join.
    """
    upper = None
    for level in reversed(tree.stored):
        own = ["group", "pos", "digest", "payload"]
        ends = tops.withColumnRenamed("group", "__group")
        out = level.filter(F.col("n") == 1).join(
            ends, F.col("group").eqNullSafe(F.col("__group"))).select(
            *own, F.col("upper").alias("proof"), "subroot", "root")
        if upper is not None:
            above = upper.select(F.col("group").alias("__group"), F.col("pos").alias("__pos"),
                                 F.col("proof").alias("upper"), "subroot", "root")
            blocks = _subtrees(level.filter(F.col("n") > 1), tree.arity ** tree.levels).join(
                above, F.col("group").eqNullSafe(F.col("__group")) & (F.col("block") == F.col("__pos")))
            schema = level.select(*own).withColumn("proof", F.array(F.lit(""))).withColumn(
                "subroot", F.lit("")).withColumn("root", F.lit("")).schema
            out = out.unionByName(blocks.select("group", "n", "nodes", "upper", "subroot", "root").mapInArrow(
                _emit(tree.levels, tree.arity, to_arrow(schema)), schema))
        upper = out
    return upper


def write_manifest(rows: DataFrame, group: str, order: list[str], digest: str,
                   payload: list[str] | None = None, levels: int = LEVELS, arity: int = 2) -> Manifest:
    """Trees of `rows` by `group` and the tree over the groups' roots, NULL first, then bytewise.

    `payload` columns are stored with the leaves. Rows with equal order columns are ordered by
    digest; NULL orders come first. An empty table has no root.
    """
    groups = build(rows, group, [*order, digest], digest, payload or [], "manifest", levels, arity)
    one = groups.tops.select(F.lit(0).alias("all"), F.col("group").alias("name"), "digest")
    return Manifest(groups, build(one, "all", ["name"], "digest", ["name"], "manifest-roots",
                                  levels, arity))


def prove(manifest: Manifest) -> DataFrame:
    """(group, pos, digest, payload, proof, subroot, root): the proof of every leaf, see `fold`."""
    whole = manifest.roots.tops.select(
        "group", F.array().cast("array<string>").alias("upper"), F.col("digest").alias("subroot"),
        F.col("digest").alias("root"))
    tops = written(proofs(manifest.roots, whole).select(
        F.col("payload.name").alias("group"), F.col("proof").alias("upper"),
        F.col("digest").alias("subroot"), "root"), "manifest-tops")
    return proofs(manifest.groups, tops)


def documents_manifest(docs: DataFrame, levels: int = LEVELS) -> DataFrame:
    """(doc_id, lang, leaf, tampered, proof, subroot, root) of every row of a documents table.

    A leaf covers doc_id, source, lang, n_chars and the whole text; NULLs, empty texts and repeated
    rows are leaves like any other and other columns are not covered. `tampered` is the leaf that
    adding 1 to n_chars would give, for the rows whose crc32 of doc_id 7 divides, else the leaf.
    Texts are read once and only digests are shuffled.
    """
    def digest(n_chars):
        return leaf_digest(F.col("doc_id"), F.col("source"), F.col("lang"), n_chars, F.col("text"))

    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    rows = written(docs.select(
        "doc_id", "lang", digest(F.col("n_chars")).alias("leaf"),
        F.when(chosen, digest(F.col("n_chars") + 1)).alias("tampered")), "manifest-leaves")
    made = prove(write_manifest(rows, "lang", ["doc_id"], "leaf", ["doc_id", "tampered"], levels))
    return made.select(
        F.col("payload.doc_id").alias("doc_id"), F.col("group").alias("lang"),
        F.col("digest").alias("leaf"),
        F.coalesce("payload.tampered", "digest").alias("tampered"), "proof", "subroot", "root")
