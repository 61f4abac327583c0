"""Conversations from trees of replies, with DataFrame functions only.

The template of a turn is `<|im_start|>role`, a line end, the text, `<|im_end|>` and a line end.
In a text each `<|`, with whatever backslashes stand between the two characters, gets one backslash
more between them, so no control string is left and taking one away restores the text. In a role
backslash, line end and `<` are written `\\b`, `\\n` and `\\l`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, Window

from fraudloom.llm.common import written

START, END = "<|im_start|>", "<|im_end|>"
AFTER = END + "\n"


def escape_text(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape_text(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def escape_role(role: Column) -> Column:
    return F.replace(F.replace(F.replace(role, F.lit("\\"), F.lit("\\b")), F.lit("\n"), F.lit("\\n")),
                     F.lit("<"), F.lit("\\l"))


def unescape_role(role: Column) -> Column:
    return F.replace(F.replace(F.replace(role, F.lit("\\l"), F.lit("<")), F.lit("\\n"), F.lit("\n")),
                     F.lit("\\b"), F.lit("\\"))


def root_to_leaf_paths(messages: DataFrame, tree: str, node: str, parent: str) -> DataFrame:
    """(tree, leaf, node, up): every message on the way from each leaf to its root, `up` steps
    above the leaf.

    Each round joins the paths found so far with jumps of as many steps as they are long, and the
    jumps with themselves, so the number of rounds is the logarithm of the longest path. Both are
    written to the shared folder between rounds. Messages whose parent is NULL or absent are roots;
    messages on a cycle have no root and reach no leaf. Node ids are unique within a tree.
    """
    ids = messages.select(F.col(tree).alias("tree"), F.col(node).alias("node"),
                          F.col(parent).alias("parent"))
    present = ids.select("tree", F.col("node").alias("parent"))
    jumps = written(ids.filter(F.col("parent").isNotNull()).join(
        present, ["tree", "parent"], "left_semi").select("tree", "node", F.col("parent").alias("to")),
        "replies")
    leaves = ids.select("tree", "node").join(
        jumps.select("tree", F.col("to").alias("node")), ["tree", "node"], "left_anti")
    paths = leaves.select("tree", F.col("node").alias("leaf"), "node", F.lit(0).alias("up"))
    length = 1
    while not jumps.isEmpty():
        further = paths.join(jumps, ["tree", "node"]).select(
            "tree", "leaf", F.col("to").alias("node"), (F.col("up") + length).alias("up"))
        paths = written(paths.unionAll(further), "replies")
        if paths.filter(F.col("up") >= length).isEmpty():
            break  # what is left of the jumps lies on cycles
        jumps = written(jumps.alias("a").join(
            jumps.alias("b"), (F.col("a.tree") == F.col("b.tree")) & (F.col("a.to") == F.col("b.node"))
        ).select("a.tree", "a.node", F.col("b.to").alias("to")), "replies")
        length *= 2
    return paths


def format_reply_trees(
    messages: DataFrame, tree: str = "tree_id", node: str = "message_id", parent: str = "parent_id",
    role: str = "role", text: str = "text", score: str | None = None, best: int | None = None,
    assistant: str = "assistant",
) -> DataFrame:
    """One row per chosen path from a root to a leaf: `tree`, `leaf`, `n_turns`, `formatted` and
    `loss_spans`, the stretches of `formatted` (start, end in code points) that train the model:
    every assistant text once, without its markers.

    Paths of a tree are ranked by the mean `score` of their messages (NULL counts as 0), then by
    leaf; `best` keeps that many per tree, None all. A NULL text or role is empty. Exactly repeated
    rows count once. A tree or node id that is NULL takes part in nothing. Other columns are
    ignored, and an empty table gives no rows. A path becomes one row, so it must fit into memory.
    """
    value = F.coalesce(F.col(score).cast("double"), F.lit(0.0)) if score else F.lit(0.0)
    rows = messages.filter(F.col(tree).isNotNull() & F.col(node).isNotNull()).select(
        F.col(tree).alias("tree"), F.col(node).alias("node"), F.col(parent).alias("parent"),
        value.alias("score"), F.coalesce(F.col(role), F.lit("")).alias("role"),
        F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.groupBy("tree", "node").agg(F.min(F.struct("parent", "score", "role", "text"))
                                            .alias("row")).select("tree", "node", "row.*")
    paths = root_to_leaf_paths(rows, "tree", "node", "parent")
    if best is not None:
        ranked = paths.join(rows.select("tree", "node", "score"), ["tree", "node"]).groupBy(
            "tree", "leaf").agg(F.avg("score").alias("mean")).withColumn("rank", F.row_number().over(
                Window.partitionBy("tree").orderBy(F.desc("mean"), "leaf")))
        paths = paths.join(ranked.filter(F.col("rank") <= best).select("tree", "leaf"),
                           ["tree", "leaf"], "left_semi")
    turns = paths.join(rows, ["tree", "node"]).select(
        "tree", "leaf", "up", (F.col("role") == assistant).alias("own"),
        F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n")).alias("head"),
        escape_text(F.col("text")).alias("body"))
    lists = turns.groupBy("tree", "leaf").agg(F.transform(
        F.sort_array(F.collect_list(F.struct((-F.col("up")).alias("at"), "own", "head", "body"))),
        lambda t: F.struct(t["own"].alias("own"), t["head"].alias("head"), t["body"].alias("body"),
                           (F.length(t["head"]) + F.length(t["body"]) + len(AFTER)).alias("size"))
    ).alias("turns"))
    spans = F.aggregate(
        "turns", F.struct(F.lit(0).cast("long").alias("at"),
                          F.expr("cast(array() as array<struct<start:bigint,end:bigint>>)").alias("s")),
        lambda a, t: F.struct((a["at"] + t["size"]).alias("at"), F.when(
            t["own"], F.concat(a["s"], F.array(F.struct(
                (a["at"] + F.length(t["head"])).alias("start"),
                (a["at"] + F.length(t["head"]) + F.length(t["body"])).alias("end"))))
        ).otherwise(a["s"]).alias("s")))["s"]
    return lists.select(
        F.col("tree").alias(tree), F.col("leaf"), F.size("turns").cast("long").alias("n_turns"),
        F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(AFTER))), "")
        .alias("formatted"), spans.alias("loss_spans"))


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation, as an array of (role, text)."""
    parts = F.slice(F.split(formatted, r"<\|im_start\|>"), 2, 1 << 30)

    def turn(part: Column) -> Column:
        head = F.substring_index(part, "\n", 1)
        body = F.substr(part, F.length(head) + 2,
                        F.length(part) - F.length(head) - 1 - len(AFTER))
        return F.struct(unescape_role(head).alias("role"), unescape_text(body).alias("text"))

    return F.transform(parts, turn)


def loss_text(formatted: Column, spans: Column) -> Column:
    """The unescaped texts under the loss mask, in order, nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescape_text(F.substr(
        formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), "")
