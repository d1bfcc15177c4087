"""Relationship graphs over weighted edges (target, peer, w)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def attach(weights: DataFrame, edges: DataFrame) -> DataFrame:
    """Adds ``a``: 1 where the pair is an edge, else 0."""
    return weights.join(edges.select("target", "peer", F.lit(1.0).alias("a")).distinct(), ["target", "peer"], "left").fillna({"a": 0.0})


def boost(weights: DataFrame, edges: DataFrame, beta: float = 0.2) -> DataFrame:
    """w * (1 + beta) on edges."""
    return attach(weights, edges).select("target", "peer", (F.col("w") * (1 + F.lit(beta) * F.col("a"))).alias("w"))


def mask(weights: DataFrame, edges: DataFrame) -> DataFrame:
    """Only edges keep weight; a target without any keeps its row as it was."""
    has = F.max("a").over(Window.partitionBy("target")) > 0
    return attach(weights, edges).select("target", "peer", F.when(has, F.col("w") * F.col("a")).otherwise(F.col("w")).alias("w"))


def attested(connections: DataFrame, least: int = 2) -> DataFrame:
    """Edges of targets with at least ``least`` connections, repeats counted."""
    n = F.count(F.lit(1)).over(Window.partitionBy("target"))
    return connections.withColumn("n", n).where(F.col("n") >= least).select("target", "peer").distinct()


def random_graph(weights: DataFrame, edges: DataFrame, trial: int) -> DataFrame:
    """As many peers a target as it has edges, drawn by a hash: the same graph for the same trial."""
    n = edges.distinct().groupBy("target").agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy("target").orderBy(F.xxhash64("target", "peer", F.lit(trial)), "peer"))
    return weights.select("target", "peer").join(n, "target").withColumn("__p", place).where("__p <= n").select("target", "peer")


def permuted_peers(weights: DataFrame, trial: int) -> DataFrame:
    """Weights whose peers are renamed by a hash-ordered permutation of all peers."""
    peers = weights.select("peer").distinct()
    there = peers.withColumn("k", F.row_number().over(Window.orderBy("peer")))
    here = peers.withColumn("k", F.row_number().over(Window.orderBy(F.xxhash64("peer", F.lit(trial)), "peer"))).withColumnRenamed("peer", "to")
    return weights.join(there.join(here, "k").drop("k"), "peer").select("target", F.col("to").alias("peer"), "w")


def assess(weights: DataFrame, strengths: DataFrame) -> DataFrame:
    """Adds ``s``, missing where the pair was not assessed."""
    return weights.join(strengths.select("target", "peer", "s"), ["target", "peer"], "left")


def _filtered(least: float) -> Column:
    kept = F.when(F.col("s") < least, F.lit(0.0)).otherwise(F.col("w"))
    total = F.sum(kept).over(Window.partitionBy("target"))
    return F.when(total < 1e-9, F.col("w")).otherwise(kept)


def strength_filter(weights: DataFrame, strengths: DataFrame, least: float) -> DataFrame:
    """Assessed edges under ``least`` lose their weight; a row left without any is restored."""
    return assess(weights, strengths).select("target", "peer", _filtered(least).alias("w"))


def strength_boost(weights: DataFrame, strengths: DataFrame, beta: float) -> DataFrame:
    """w * (1 + beta * s) on assessed edges."""
    return assess(weights, strengths).select("target", "peer", (F.col("w") * (1 + F.lit(beta) * F.coalesce("s", F.lit(0.0)))).alias("w"))


def confirmed_boost(weights: DataFrame, strengths: DataFrame, least: float, beta: float) -> DataFrame:
    """w * (1 + beta) on edges assessed at or over ``least``."""
    return assess(weights, strengths).select("target", "peer", (F.col("w") * F.when(F.col("s") >= least, F.lit(1.0 + beta)).otherwise(F.lit(1.0))).alias("w"))


def filter_and_boost(weights: DataFrame, strengths: DataFrame, least: float, beta: float) -> DataFrame:
    return strength_boost(strength_filter(weights, strengths, least), strengths, beta)


def linkage(pairs: DataFrame, order: str = "pos") -> DataFrame:
    """(target, peer, s) of typed pairs; the last pair of a key wins."""
    return pairs.where("linkage_type IS NOT NULL AND linkage_type <> ''").groupBy("target", "peer").agg(F.max_by("s", order).alias("s"))


def undirected(*relations: DataFrame) -> DataFrame:
    """Distinct edges of all relations in both directions."""
    out = None
    for r in relations:
        both = r.select("target", "peer").unionAll(r.select(F.col("peer").alias("target"), F.col("target").alias("peer")))
        out = both if out is None else out.unionAll(both)
    return out.distinct()
