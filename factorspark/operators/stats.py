"""Correlations, information coefficients, regressions and return metrics."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factorspark.functions.weights import normal_cdf
from factorspark.operators.xsection import avg_rank


def safe_corr(x: str, y: str) -> Column:
    """Pearson correlation of pairwise complete rows; missing for one row or no variance."""
    a, b = F.when(F.col(y).isNotNull(), F.col(x)), F.when(F.col(x).isNotNull(), F.col(y))
    c = F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))
    return F.when((F.count(F.when(b.isNotNull(), a)) > 1) & (F.stddev_pop(a) > 1e-14) & (F.stddev_pop(b) > 1e-14), c)


def ic(df: DataFrame, factor: str, label: str, by: Sequence[str], out: str = "ic") -> DataFrame:
    """Pearson information coefficient of each group."""
    return df.groupBy(*by).agg(safe_corr(factor, label).alias(out))


def rank_ic(df: DataFrame, factor: str, label: str, by: Sequence[str], out: str = "rank_ic", count: str | None = None) -> DataFrame:
    """Spearman coefficient; each side is ranked over its own known values before rows are paired.

    Rows are dealt by group once, which all four windows and the sums share. ``count`` names a column of
    the groups' rows.
    """
    own = df.select(*by, F.col(factor).alias("__f"), F.col(label).alias("__l")).repartition(*by)
    ranked = own.select(*by, avg_rank("__f", by).alias("__rf"), avg_rank("__l", by).alias("__rl"))
    more = [F.count(F.lit(1)).alias(count)] if count else []
    return ranked.groupBy(*by).agg(safe_corr("__rf", "__rl").alias(out), *more)


def ic_summary(df: DataFrame, x: str, periods: float, ddof: int = 1) -> DataFrame:
    """mean, sd, z, p_value, winratio, icir, icir_annual of a table of coefficients (absolute ICIR)."""
    sd = F.stddev_samp(x) if ddof else F.stddev_pop(x)
    got = df.agg(F.avg(x).alias("mean"), sd.alias("sd"), F.count(x).alias("n"), F.try_divide(F.count_if(F.col(x) > 0), F.count(x)).alias("winratio"))
    z = F.when(F.col("sd") > 0, F.col("mean") / (F.col("sd") / F.sqrt("n"))).otherwise(F.lit(0.0))
    got = got.withColumn("z", z)
    icir = F.when(F.col("sd") > 0, F.abs("mean") / F.col("sd")).otherwise(F.lit(0.0))
    return got.withColumns({"p_value": F.lit(2.0) * (F.lit(1.0) - normal_cdf(F.abs("z"))), "icir": icir, "icir_annual": icir * math.sqrt(periods)})


def signed_summary(df: DataFrame, x: str, periods: float, ddof: int = 1) -> DataFrame:
    """mean, sd, signed annual ICIR, t statistic, hit rate and n."""
    sd = F.stddev_samp(x) if ddof else F.stddev_pop(x)
    got = df.agg(F.avg(x).alias("mean"), sd.alias("sd"), F.count(x).alias("n"), F.try_divide(F.count_if(F.col(x) > 0), F.count(x)).alias("hit_rate"))
    return got.withColumns({"icir_annual": F.try_divide("mean", "sd") * math.sqrt(periods), "t_stat": F.try_divide("mean", F.col("sd") / F.sqrt("n"))})


def ols_residual(y: str, x: str, by: Sequence[str]) -> Column:
    """Residual of y on x and a constant within the group; slope 0 where x has no variance."""
    w = Window.partitionBy(*by)
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    xs, ys = F.when(both, F.col(x)), F.when(both, F.col(y))
    var = F.var_pop(xs).over(w)
    slope = F.when(var > 1e-24, F.covar_pop(xs, ys).over(w) / var).otherwise(F.lit(0.0))
    return F.when(both, F.col(y) - F.avg(ys).over(w) - slope * (F.col(x) - F.avg(xs).over(w)))


def nan_stats(x: str) -> list[Column]:
    """Sum, mean and population deviation of known values, 0 where there are none."""
    return [F.coalesce(F.sum(x), F.lit(0.0)).alias("nansum"), F.coalesce(F.avg(x), F.lit(0.0)).alias("nanmean"), F.coalesce(F.stddev_pop(x), F.lit(0.0)).alias("nanstd")]


def drawdown(df: DataFrame, x: str, by: Sequence[str], order: str, out: str = "max_dd") -> DataFrame:
    """Additive drawdown: worst (cumulative - running maximum) / (running maximum + 1), within [-1, 0]."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    rows = df.withColumn("__cum", F.sum(F.coalesce(F.col(x), F.lit(0.0))).over(w))
    rows = rows.withColumn("__top", F.max("__cum").over(w))
    worst = F.min(F.try_divide(F.col("__cum") - F.col("__top"), F.col("__top") + 1))
    return rows.groupBy(*by).agg(F.greatest(F.least(F.coalesce(worst, F.lit(0.0)), F.lit(0.0)), F.lit(-1.0)).alias(out))


def return_metrics(df: DataFrame, x: str, by: Sequence[str], order: str, years: float | Column, periods: float | Column) -> DataFrame:
    """ret_annual, ret_sharpe, ret_sortino, ret_max_dd, ret_calmar of a table of daily returns."""
    years = F.lit(years) if not isinstance(years, Column) else years
    periods = F.lit(periods) if not isinstance(periods, Column) else periods
    down = F.coalesce(F.stddev_pop(F.when(F.col(x) < 0, F.col(x))), F.lit(0.0))
    got = df.groupBy(*by).agg(F.sum(x).alias("__sum"), F.avg(x).alias("__mean"), F.coalesce(F.stddev_pop(x), F.lit(0.0)).alias("__sd"), down.alias("__down"))
    got = got.join(drawdown(df, x, by, order, "ret_max_dd"), list(by))
    ratio = lambda sd: F.when(F.col(sd) > 0, F.col("__mean") / F.col(sd) * F.sqrt(periods)).otherwise(F.lit(0.0))
    got = got.withColumns({"ret_annual": F.col("__sum") / years, "ret_sharpe": ratio("__sd"), "ret_sortino": ratio("__down")})
    calmar = F.when(F.col("ret_max_dd") != 0, F.col("ret_annual") / F.abs("ret_max_dd")).otherwise(F.lit(0.0))
    return got.withColumn("ret_calmar", calmar).select(*by, "ret_annual", "ret_sharpe", "ret_sortino", "ret_max_dd", "ret_calmar")


def time_metrics(df: DataFrame, dt: str, annual_days: float | None = None) -> DataFrame:
    """num_dates, num_years, dates_to_years of the dates of a table."""
    got = df.agg(F.countDistinct(dt).alias("num_dates"), F.min(dt).alias("__a"), F.max(dt).alias("__b"))
    years = F.greatest(F.datediff("__b", "__a") / F.lit(365.25), F.lit(1 / 365.25))
    got = got.withColumn("num_years", years)
    per = F.lit(float(annual_days)) if annual_days else F.col("num_dates") / F.col("num_years")
    return got.select("num_dates", "num_years", per.alias("dates_to_years"))
