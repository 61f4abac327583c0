"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from fraudloom.llm.common import written


def component_of(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): the smallest node each linked node is connected to.

    Alternates the large-star and small-star steps until nothing changes. Every round is written to
    the shared folder, which also cuts the lineage; the number of rounds follows the logarithm of
    the size of the largest component. Nodes without a link are not listed.
    """
    edges = written(links.filter(F.col(a) != F.col(b)).select(
        F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).distinct(), "components")
    if edges.isEmpty():
        return edges.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
    before = None
    while True:
        edges = written(_small_star(_large_star(edges)), "components")
        state = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("hi", "lo")),
                          F.sum(F.xxhash64("lo", "hi").cast("decimal(20,0)"))).first()
        if state == before:
            break
        before = state
    stars = edges.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
    return stars.unionAll(stars.select(F.col("root").alias("node"), "root").distinct())


def _large_star(edges: DataFrame) -> DataFrame:
    """Links the larger neighbours of each node to its smallest one."""
    both = edges.unionAll(edges.select(F.col("lo").alias("hi"), F.col("hi").alias("lo")))
    both = both.toDF("u", "v")
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.filter(F.col("v") > F.col("u")).join(least, "u").select(
        F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Links the smaller neighbours of each node, and itself, to the smallest one."""
    least = edges.groupBy("hi").agg(F.min("lo").alias("m"))
    moved = edges.join(least, "hi").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
    return moved.unionAll(least.select("hi", F.col("m").alias("lo"))).filter(
        F.col("hi") != F.col("lo")).distinct()
