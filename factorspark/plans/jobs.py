"""Composite jobs: families of weights or factors scored side by side in one plan each."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factorspark.operators import stats
from factorspark.operators.factor import keyed_factor


def stacked(**named: DataFrame) -> DataFrame:
    """Union of tables of one shape with the column ``variant`` in front."""
    return reduce(DataFrame.unionByName, [df.withColumn("variant", F.lit(k)) for k, df in named.items()])


def variant_factors(weights: DataFrame, returns: DataFrame, gate: float = 1.0) -> DataFrame:
    """(variant, dt, sym, factor) of weights (variant, target, peer, w): all variants share one block product."""
    return keyed_factor(weights, returns, ("variant",), gate)


def variant_scores(factors: DataFrame, labels: DataFrame | None = None, periods: float = 12.0, by: tuple[str, ...] = ("variant",)) -> DataFrame:
    """(by, mean_ic, icir) of rank coefficients of factors, to nine places, against labels (dt, sym, label) or their own."""
    joined = factors.withColumn("factor", F.round("factor", 9))
    joined = joined if labels is None else joined.join(labels, ["dt", "sym"])
    c = stats.rank_ic(joined, "factor", "label", [*by, "dt"], "ic")
    return c.groupBy(*by).agg(F.avg("ic").alias("mean_ic"), (F.try_divide(F.avg("ic"), F.stddev_samp("ic")) * F.sqrt(F.lit(periods))).alias("icir"))
