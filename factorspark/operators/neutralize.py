"""Neutralization: residuals of a factor on style, sector or neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factorspark.operators.stats import ols_residual
from factorspark.operators.xsection import population_zscore, winsorize_percentile

LEAST = 10


def _standard(df: DataFrame, cols: list[str], by: list[str]) -> DataFrame:
    df = df.withColumns({c: winsorize_percentile(c, by) for c in cols})
    return df.withColumns({c: population_zscore(c, by) for c in cols})


def mild(df: DataFrame, y: str, x: str, dt: str = "dt", least: int = LEAST) -> DataFrame:
    """Residual of the standardized factor on one standardized style, dates with ``least`` names or more."""
    known = df.where(F.col(y).isNotNull() & F.col(x).isNotNull()).withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy(dt)))
    return _standard(known.where(F.col("__n") >= least).drop("__n"), [y, x], [dt]).withColumn("residual", ols_residual(y, x, [dt]))


def styles(df: DataFrame, y: str, xs: list[str], dt: str = "dt", sym: str = "sym", least: int = LEAST) -> DataFrame:
    """(dt, sym, residual, r2) of the standardized factor on several standardized styles and a constant.

    Least squares by successive residuals: each style is cleared of those before it, the factor of each
    cleared style, all in windows over the date; a style that those before it explain adds nothing.
    """
    cols = [y, *xs]
    known = df.where(" AND ".join(f"{c} IS NOT NULL" for c in cols)).withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy(dt)))
    rows = _standard(known.where(F.col("__n") >= least).drop("__n"), cols, [dt]).select(dt, sym, F.col(y).alias("__y"), *cols)
    for k, x in enumerate(xs):
        rows = rows.withColumns({c: ols_residual(c, x, [dt]) for c in (y, *xs[k + 1 :])})
    w = Window.partitionBy(dt)
    rows = rows.withColumn("__y", F.col("__y") - F.avg("__y").over(w))
    total = F.sum(F.col("__y") * F.col("__y")).over(w)
    return rows.select(dt, sym, F.col(y).alias("residual"), F.when(total > 1e-20, 1 - F.sum(F.col(y) * F.col(y)).over(w) / total).otherwise(F.lit(0.0)).alias("r2"))


def sector_and_size(df: DataFrame, y: str, x: str, sector: str = "sector", dt: str = "dt") -> DataFrame:
    """Residual on sector dummies and one regressor: both are demeaned by sector, then one slope a date."""
    known = df.where(F.col(y).isNotNull() & F.col(x).isNotNull() & F.col(sector).isNotNull())
    w, d = Window.partitionBy(dt, sector), Window.partitionBy(dt)
    known = known.withColumns({"__y": F.col(y) - F.avg(y).over(w), "__x": F.col(x) - F.avg(x).over(w)})
    slope = F.try_divide(F.sum(F.col("__x") * F.col("__y")).over(d), F.sum(F.col("__x") * F.col("__x")).over(d))
    return known.withColumn("residual", F.col("__y") - F.coalesce(slope, F.lit(0.0)) * F.col("__x")).drop("__x", "__y")


def sector_demean(df: DataFrame, y: str, sector: str = "sector", dt: str = "dt") -> DataFrame:
    known = df.where(F.col(sector).isNotNull())
    return known.withColumn("residual", F.col(y) - F.avg(y).over(Window.partitionBy(dt, sector)))


def neighbour_demean(df: DataFrame, neighbours: DataFrame, y: str, dt: str = "dt", sym: str = "sym") -> DataFrame:
    """y less the similarity-weighted mean of the static neighbours present that date (0 without any).

    ``neighbours`` is (target, peer, sim); a zero sum of weights divides by 1.
    """
    vals = df.where(F.col(y).isNotNull()).select(F.col(dt).alias("__d"), F.col(sym).alias("peer"), F.col(y).alias("__v"))
    mean = neighbours.join(vals, "peer").groupBy("__d", "target").agg(F.sum(F.col("sim") * F.col("__v")).alias("__n"), F.sum("sim").alias("__w"))
    mean = mean.select("__d", "target", (F.col("__n") / F.when(F.col("__w") == 0, F.lit(1.0)).otherwise(F.col("__w"))).alias("__m"))
    joined = df.join(mean, (df[dt] == mean["__d"]) & (df[sym] == mean["target"]), "left")
    return joined.withColumn("residual", F.col(y) - F.coalesce("__m", F.lit(0.0))).drop("__d", "target", "__m")
