"""Peer factors: weighted averages of peer returns, pooling and composites."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, GroupedData, Window
from pyspark.sql import functions as F

from factorspark.operators.similarity import blocks_for

BLOCKS = 4


def _products(weights: GroupedData, returns: GroupedData, dt: str, sym: str) -> DataFrame:
    """(dt, sym, n, d): each group of (target, peer, w) rows times its group of (dt, s, r) rows; ``dt`` and ``sym`` are types."""

    def codes(column: pa.ChunkedArray) -> tuple[pa.Array, np.ndarray]:
        d = column.combine_chunks().dictionary_encode()
        d = d.combine_chunks() if isinstance(d, pa.ChunkedArray) else d
        return d.dictionary, d.indices.to_numpy(zero_copy_only=False)

    def multiply(left: pa.Table, right: pa.Table) -> pa.Table:
        targets, ti = codes(left["target"])
        dates, di = codes(right["dt"])
        both = pa.chunked_array([*left["peer"].chunks, *right["s"].cast(left["peer"].type).chunks])
        _, at = codes(both)
        pi, ri = at[: len(ti)], at[len(ti) :]
        n = int(at.max()) + 1 if len(at) else 0
        a, x, known = np.zeros((len(targets), n)), np.zeros((n, len(dates))), np.zeros((n, len(dates)))
        np.add.at(a, (ti, pi), left["w"].to_numpy())
        x[ri, di] = right["r"].to_numpy()
        known[ri, di] = 1.0
        num, den = a @ x, a @ known
        i, j = np.nonzero(den)
        return pa.table({"dt": dates.take(pa.array(j)), "sym": targets.take(pa.array(i)), "n": num[i, j], "d": den[i, j]})

    return weights.cogroup(returns).applyInArrow(multiply, f"dt {dt}, sym {sym}, n double, d double")


def peer_factor_join(weights: DataFrame, returns: DataFrame, gate: float = 1.0, ret: str = "ret") -> DataFrame:
    """(dt, sym, factor): sum(w * r) / sum(w) over a target's peers with a return, where sum(w) > gate.

    The join form, for sparse graphs: edges x dates rows are made and aggregated.
    """
    r = returns.where(F.col(ret).isNotNull()).select("dt", F.col("sym").alias("peer"), F.col(ret).alias("__r"))
    got = weights.where("w <> 0").join(r, "peer").groupBy("dt", F.col("target").alias("sym")).agg(F.sum(F.col("w") * F.col("__r")).alias("__n"), F.sum("w").alias("__w"))
    return got.where(F.col("__w") > gate).select("dt", "sym", (F.col("__n") / F.col("__w")).alias("factor"))


def peer_factor(weights: DataFrame, returns: DataFrame, gate: float = 1.0, ret: str = "ret", blocks: int | None = None) -> DataFrame:
    """``peer_factor_join`` as block matrix products in Arrow, for dense weights; no edge is pruned.

    Targets, peers and dates are dealt into blocks. A task multiplies one block of weights with one block
    of returns, so it holds two blocks and gives a row a target and date; partial sums of the peer blocks
    are then added. Returns are unique by date and symbol.
    """
    from factorspark.functions.shipping import ship

    ship(weights.sparkSession)
    blocks = blocks or blocks_for(returns, "sym", BLOCKS)
    deal = lambda c: F.pmod(F.hash(c), F.lit(blocks))
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    w = weights.where("w <> 0").select("target", "peer", "w", deal("target").alias("i"), deal("peer").alias("p")).withColumn("m", every)
    r = returns.where(F.col(ret).isNotNull()).select("dt", F.col("sym").alias("s"), F.col(ret).cast("double").alias("r"), deal("sym").alias("rp"), deal("dt").alias("rm")).withColumn("ri", every)
    kinds = (returns.schema["dt"].dataType.simpleString(), weights.schema["target"].dataType.simpleString())
    parts = _products(w.groupBy("i", "p", "m"), r.groupBy("ri", "rp", "rm"), *kinds)
    got = parts.groupBy("dt", "sym").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))
    return got.where(F.col("d") > gate).select("dt", "sym", (F.col("n") / F.col("d")).alias("factor"))


def keyed_factor(weights: DataFrame, returns: DataFrame, keys: tuple[str, ...], gate: float = 1.0) -> DataFrame:
    """(keys, dt, sym, factor): ``peer_factor`` of weights (keys, target, peer, w), each key a set of weights of its own.

    Key and target together are the rows of the matrices, so all keys share one block product. Keys are
    not null and their texts hold no \\x01.
    """
    kinds = {k: weights.schema[k].dataType for k in (*keys, "target")}
    row = F.concat_ws("\x01", *[F.col(k).cast("string") for k in kinds])  # short text: it goes through Arrow once an edge and block
    got = peer_factor(weights.select(row.alias("target"), "peer", "w"), returns, gate).withColumn("r", F.split("sym", "\x01"))
    part = {k: F.col("r")[n].cast(t) for n, (k, t) in enumerate(kinds.items())}
    return got.select(*[part[k].alias(k) for k in keys], "dt", part["target"].alias("sym"), "factor")


def monthly_weighted_factor(weights: DataFrame, daily: DataFrame, gate: float = 1.0, ret: str = "ret", blocks: int | None = None) -> DataFrame:
    """peer_factor with weights (month, target, peer, w) that hold for the days of their month.

    A task multiplies a month's block of weights with the block's returns of that month.
    """
    from factorspark.functions.shipping import ship

    ship(weights.sparkSession)
    blocks = blocks or blocks_for(daily, "sym", BLOCKS)
    deal = lambda c: F.pmod(F.hash(c), F.lit(blocks))
    w = weights.where("w IS NOT NULL").select("month", "target", "peer", "w", deal("target").alias("i"), deal("peer").alias("p"))
    r = daily.where(F.col(ret).isNotNull()).select("dt", F.date_format("dt", "yyyy-MM").alias("rmonth"), F.col("sym").alias("s"), F.col(ret).cast("double").alias("r"), deal("sym").alias("rp"))
    r = r.withColumn("ri", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    kinds = (daily.schema["dt"].dataType.simpleString(), weights.schema["target"].dataType.simpleString())
    parts = _products(w.groupBy("i", "p", "month"), r.groupBy("ri", "rp", "rmonth"), *kinds)
    got = parts.groupBy("dt", "sym").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))
    return got.where(F.col("d") > gate).select("dt", "sym", (F.col("n") / F.col("d")).alias("factor"))


def pool(*factors: DataFrame) -> DataFrame:
    """Mean of several factors per date and symbol; a single one is returned as it is."""
    if len(factors) == 1:
        return factors[0]
    return reduce(DataFrame.unionByName, factors).groupBy("dt", "sym").agg(F.avg("factor").alias("factor"))


def composite(*factors: DataFrame) -> DataFrame:
    """Mean of the factors' cross-sectional z-scores; a date without spread drops out of the mean."""
    w = Window.partitionBy("dt")
    z = F.try_divide(F.col("factor") - F.avg("factor").over(w), F.stddev_samp("factor").over(w))
    return pool(*[f.select("dt", "sym", z.alias("factor")).where("factor IS NOT NULL") for f in factors]) if len(factors) > 1 else factors[0].select("dt", "sym", z.alias("factor")).where("factor IS NOT NULL")


def every_nth_date(df: DataFrame, n: int, dt: str = "dt") -> DataFrame:
    """Rows of each n-th distinct date; dates are numbered in a table of their own."""
    days = df.select(dt).distinct().withColumn("__k", F.row_number().over(Window.orderBy(dt)) - 1)
    return df.join(days.where(F.col("__k") % n == 0).select(dt), dt, "left_semi")
