"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factorspark.llm.runtime import cut


def _star(pairs: DataFrame, large: bool) -> DataFrame:
    """One star step over directed pairs (a, b): what a knows is hung under a's least neighbour."""
    least = pairs.groupBy("a").agg(F.min(F.least("a", "b")).alias("m"))
    least = least.select(F.col("a").alias("node"), F.xxhash64("a").alias("h"), "m")
    hung = pairs.join(least, (pairs.a == least.node) & (F.xxhash64(pairs.a) == least.h))  # the second key makes both sides exchange, so a node with many neighbours can be split
    if large:
        hung = hung.where("b > a").select(F.col("b").alias("u"), F.col("m").alias("v"))
    else:
        hung = hung.select(F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("m").alias("v")), F.struct(F.col("b").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
    return hung.where("u != v").distinct()


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node that has an edge; label is the least node that can be reached.

    ``edges`` has two long columns u and v, in any direction, repeats and loops allowed. Every round is
    cut off in the shared folder, so a lost executor costs one round at most. Rounds grow with the
    logarithm of the longest path; nothing is brought to the driver but a count and a checksum.
    """
    edges = cut(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = _mark(edges)
    while mark[0]:
        both = edges.select(F.col("u").alias("a"), F.col("v").alias("b")).unionAll(edges.select(F.col("v").alias("a"), F.col("u").alias("b")))
        down = _star(both, True)
        edges = cut(_star(down.select(F.col("u").alias("a"), F.col("v").alias("b")), False))
        now = _mark(edges)
        if now == mark:
            break
        mark = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).unionAll(edges.select(F.col("v"), F.col("v"))).distinct()
