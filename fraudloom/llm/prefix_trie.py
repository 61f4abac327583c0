"""Trie of conversation prefixes, grouped by blocks of turns first.

Conversations that agree in a whole block of turns are told apart no further inside it: equal chains
of block digests put them in one class. Single turns are looked at only where conversations with the
same past go on with different blocks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from fraudloom.llm.common import written
from fraudloom.llm.ranks import ranked, salted_join

#: Turns of a block, and blocks whose digests are chained in one go.
BLOCK, SLICE = 4, 4096
#: Ids that are put together before they are hashed.
IDS_OF_A_PIECE = 10_000
NODE = ["owner", "depth"]


def turn_key(role: Column, text: Column) -> Column:
    """Digest of a turn; NULL counts as empty."""
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    return F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)


def numbered_turns(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn",
                   role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, pos, n_turns, key, chars): turns by number, NULL first, then by role and digest.

    Texts are read once; only their digests and lengths go on. Rows without conv_id belong to no
    conversation.
    """
    short = rows.filter(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col), F.lit("")).alias("role"),
        turn_key(F.col(role_col), F.col(text_col)).alias("key"),
        F.length(F.coalesce(F.col(text_col), F.lit(""))).cast("long").alias("chars"))
    numbered = ranked(written(short, "trie-turns"), "conv", [F.col(c) for c in ("turn", "role", "key")],
                      "trie-order")
    return numbered.select("conv", F.col("rank").alias("pos"), F.col("members").alias("n_turns"),
                           "key", "chars")


def _words(digest: Column) -> tuple[Column, Column]:
    """Two numbers of 60 bits from a hexadecimal digest."""
    return tuple(F.conv(F.substring(digest, at, 15), 16, 10).cast("long") for at in (1, 16))


def _blocks(turns: DataFrame, block: int) -> DataFrame:
    """(conv, j, pa, pb, qa, qb, keys, chars): the blocks of every conversation, with the chained
    digest before (p) and after (q) each.

    A chain is the exclusive or of digests that cover a block's number and its turns, so that it
    adds up over slices of a conversation of any length.
    """
    own = turns.groupBy("conv", F.expr(f"pos div {block}").alias("j")).agg(
        F.sort_array(F.collect_list(F.struct("pos", "key", "chars"))).alias("turns")).select(
        "conv", "j", F.expr(f"j div {SLICE}").alias("slice"), F.col("turns.key").alias("keys"),
        F.col("turns.chars").alias("chars"))
    a, b = _words(F.sha2(F.concat(F.col("j").cast("string"), F.lit(":"), F.array_join(
        "keys", "")).cast("binary"), 256))
    own = written(own.withColumn("a", a).withColumn("b", b), "trie-blocks")
    inside = Window.partitionBy("conv", "slice").orderBy("j")
    sums = own.groupBy("conv", "slice").agg(F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b"))
    earlier = Window.partitionBy("conv").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = sums.select("conv", "slice", *[F.coalesce(F.bit_xor(c).over(earlier), F.lit(0).cast(
        "long")).alias(f"c{c}") for c in "ab"])
    chained = own.withColumn("xa", F.bit_xor("a").over(inside)).withColumn(
        "xb", F.bit_xor("b").over(inside)).join(carried, ["conv", "slice"])
    qa, qb = F.col("xa").bitwiseXOR(F.col("ca")), F.col("xb").bitwiseXOR(F.col("cb"))
    return chained.select("conv", "j", qa.bitwiseXOR(F.col("a")).alias("pa"), qb.bitwiseXOR(
        F.col("b")).alias("pb"), qa.alias("qa"), qb.alias("qb"), "keys", "chars")


def _class_nodes(blocks: DataFrame, block: int) -> DataFrame:
    """(j, qa, qb, nodes): for every distinct chain of blocks, the owner (smallest conversation) and
    the number of conversations of the node after each turn of its last block."""
    past, chain = ["j", "pa", "pb"], ["j", "pa", "pb", "qa", "qb"]
    classes = written(blocks.groupBy(*chain).agg(
        F.count(F.lit(1)).alias("n"), F.min("conv").alias("least"), F.first("keys").alias("keys")),
        "trie-classes")
    ways = classes.groupBy(*past).agg(F.count(F.lit(1)).alias("ways"))
    told = written(salted_join(classes, ways, past, F.col("qa")), "trie-ways")
    plain = told.filter(F.col("ways") == 1).select("j", "qa", "qb", F.transform(
        "keys", lambda _: F.struct(F.col("least").alias("owner"), F.col("n").alias("n"))).alias("nodes"))
    # Where blocks diverge, a node is what stands in the block up to a turn, under the same past.
    split = told.filter(F.col("ways") > 1).select(
        *chain, "n", "least", "keys", F.posexplode("keys").alias("t", "key"))
    inner = written(split.select(*chain, "n", "least", "t", F.sha2(F.array_join(F.slice(
        "keys", F.lit(1), F.col("t") + 1), "").cast("binary"), 256).alias("start")), "trie-inner")
    node = [*past, "t", "start"]
    nodes = inner.groupBy(*node).agg(F.min("least").alias("owner"), F.sum("n").alias("all"))
    refined = salted_join(inner, nodes, node, F.col("qa")).groupBy("j", "qa", "qb").agg(F.sort_array(
        F.collect_list(F.struct("t", "owner", "all"))).alias("by_turn")).select(
        "j", "qa", "qb", F.transform("by_turn", lambda x: F.struct(
            x["owner"].alias("owner"), x["all"].alias("n"))).alias("nodes"))
    return plain.unionByName(refined)


def _ends_digest(ends: DataFrame) -> DataFrame:
    """(owner, depth, ends_sha256): digest of the ids that end at each node, in order.

    Ids are put together in pieces by ranges of (node, id) first; the pieces of a node are then
    hashed one after the other as they stream past, so no task holds a node's ids.
    """
    import hashlib

    def pieces(frames):
        for frame in frames:
            ids = frame["conv"].to_numpy()
            own = frame[NODE].to_numpy()
            new = np.flatnonzero((own[1:] != own[:-1]).any(axis=1)) + 1
            cuts = np.union1d(np.concatenate([[0], new]), np.arange(0, len(ids), IDS_OF_A_PIECE))
            texts = [",".join(map(str, ids[a:b].tolist())) for a, b in zip(cuts, [*cuts[1:], len(ids)])]
            yield frame[NODE].iloc[cuts].assign(first=ids[cuts], ids=texts)

    def digests(frames):
        node, state = None, None
        for frame in frames:
            out = []
            for owner, depth, ids in zip(frame["owner"], frame["depth"], frame["ids"]):
                if (owner, depth) != node:
                    if node is not None:
                        out.append((*node, state.hexdigest()))
                    node, state = (owner, depth), hashlib.sha256(ids.encode())
                else:
                    state.update(("," + ids).encode())
            yield pd.DataFrame(out, columns=[*NODE, "ends_sha256"])
        if node is not None:
            yield pd.DataFrame([(*node, state.hexdigest())], columns=[*NODE, "ends_sha256"])

    cut = ends.repartitionByRange("owner", "depth", "conv").sortWithinPartitions("owner", "depth", "conv")
    parts = written(cut.mapInPandas(pieces, "owner long, depth long, first long, ids string"), "trie-ends")
    return parts.repartition("owner", "depth").sortWithinPartitions("owner", "depth", "first").mapInPandas(
        digests, "owner long, depth long, ends_sha256 string")


def _subtree_sums(nodes: DataFrame, path: DataFrame, values: list[str]) -> DataFrame:
    """(owner, depth, values) summed over the shared nodes below and at each shared node.

    Doubling: after k rounds a node holds the sum over less than 2^k levels, and hands it to its
    ancestor 2^k levels up, which is looked up on the owner's own path, one row a key.
    """
    sums = written(nodes.select(*NODE, *values), "trie-sums")
    deepest, step = sums.agg(F.max("depth")).first()[0] or 0, 1
    steps = path.select(F.col("conv").alias("owner"), "depth", F.col("owner").alias("ancestor"))
    while step <= deepest:
        moved = sums.filter(F.col("depth") >= step).withColumn("depth", F.col("depth") - step).join(
            steps, NODE).groupBy(F.col("ancestor").alias("owner"), "depth").agg(
            *[F.sum(v).alias(f"more_{v}") for v in values])
        sums = written(sums.join(moved, NODE, "left").select(*NODE, *[
            (F.col(v) + F.coalesce(f"more_{v}", F.lit(0))).alias(v) for v in values]), "trie-sums")
        step *= 2
    return sums


def prefix_trie(turns: DataFrame, members: DataFrame, block: int = BLOCK) -> DataFrame:
    """The nodes of the trie of all prefixes: (owner, depth, parent_owner, n_convs, n_children,
    n_leaves, saved, ends_sha256), where owner is the smallest conversation that passes a node.

    `turns` (conv, pos, key, chars) has positions from 0 without gaps, `members` (conv) every
    conversation, those without turns too. `saved` sums (n_convs - 1) * chars over a subtree. Equal
    conversations share all nodes; no conversation at all gives no node, not even the root.

    A conversation of any length is cut into blocks and slices; rows of a hot prefix are dealt over
    salts; what all conversations share is one row.
    """
    blocks = written(_blocks(turns, block), "trie-chains")
    info = written(_class_nodes(blocks, block), "trie-nodes")
    known = salted_join(blocks.select("conv", "j", "qa", "qb", "chars"), info, ["j", "qa", "qb"],
                        F.col("conv"))
    members = written(members.select("conv").distinct(), "trie-members")
    first = members.agg(F.min("conv").alias("owner"), F.count(F.lit(1)).alias("n")).filter(
        F.col("n") > 0)
    path = written(known.select("conv", "j", F.posexplode(F.arrays_zip("nodes", "chars")).alias(
        "t", "x")).select(
        "conv", (F.col("j") * block + F.col("t") + 1).alias("depth"),
        F.col("x.nodes.owner").alias("owner"), F.col("x.nodes.n").alias("n"),
        F.col("x.chars").alias("chars")), "trie-path")
    above = path.select("conv", (F.col("depth") + 1).alias("depth"), F.col("owner").alias("parent"))
    top = F.broadcast(first.select(F.col("owner").alias("top")))
    own = path.filter(F.col("conv") == F.col("owner")).drop("conv")
    nodes = written(own.join(above.withColumnRenamed("conv", "owner"), NODE, "left").join(top).select(
        *NODE, "n", "chars", F.when(F.col("depth") == 1, F.col("top")).otherwise(F.col("parent")).alias(
            "parent")).unionByName(first.select(
                "owner", F.lit(0).cast("long").alias("depth"), "n", F.lit(0).cast("long").alias("chars"),
                F.lit(None).cast("long").alias("parent"))), "trie-tree")
    below = nodes.filter(F.col("depth") > 0).groupBy(
        F.col("parent").alias("owner"), (F.col("depth") - 1).alias("depth")).agg(
        F.count(F.lit(1)).alias("n_children"),
        F.count(F.when(F.col("n") == 1, 1)).alias("lone"))
    tree = written(nodes.join(below, NODE, "left").fillna(0, ["n_children", "lone"]), "trie-tree")
    # Under a node of one conversation there is one leaf and nothing to save; such chains, which are
    # most of all nodes, count at the shared node they hang on.
    shared = tree.filter((F.col("n") > 1) | (F.col("depth") == 0)).select(
        *NODE, (F.col("lone") + F.when(F.col("n_children") == 0, 1).otherwise(0)).alias("n_leaves"),
        ((F.col("n") - 1) * F.col("chars")).alias("saved"))
    sums = _subtree_sums(shared, path.filter(F.col("n") > 1).unionByName(members.join(top).select(
        "conv", F.lit(0).cast("long").alias("depth"), F.col("top").alias("owner"),
        F.lit(2).cast("long").alias("n"), F.lit(0).cast("long").alias("chars"))), ["n_leaves", "saved"])
    last = turns.groupBy("conv").agg(F.max("pos").alias("last")).select(
        "conv", (F.col("last") + 1).alias("depth"))
    ends = path.join(last, ["conv", "depth"]).select(*NODE, "conv").unionByName(
        members.join(last, "conv", "left_anti").join(top).select(
            F.col("top").alias("owner"), F.lit(0).cast("long").alias("depth"), "conv"))
    return tree.join(sums, NODE, "left").join(_ends_digest(ends), NODE, "left").select(
        *NODE, F.col("parent").alias("parent_owner"), F.col("n").alias("n_convs"), "n_children",
        F.coalesce("n_leaves", F.lit(1).cast("long")).alias("n_leaves"),
        F.coalesce("saved", F.lit(0).cast("long")).alias("saved"),
        F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"))
