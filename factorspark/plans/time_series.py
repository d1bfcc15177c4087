"""Time-series backtest of single series (t, day, factor, label), any number of them by key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factorspark.functions.weights import squash
from factorspark.operators import rolling, stats
from factorspark.plans.cross_section import ALL_SIDES, HELD

WINDOW = 126


def weights(x: str) -> Column:
    return F.coalesce(F.col(x), F.lit(0.0))


def threshold(x: str, long: float, short: float) -> Column:
    """1 at or over ``long``, -1 at or under ``short``, else 0."""
    return F.coalesce(F.when(F.col(x) <= short, F.lit(-1.0)).when(F.col(x) >= long, F.lit(1.0)), F.lit(0.0))


def gradual(x: str, end_short: float, start_short: float, start_long: float, end_long: float) -> Column:
    """Piecewise linear between the start and end thresholds of each side."""
    v = F.col(x)
    up = (v - start_long) / (end_long - start_long)
    down = -1.0 + (v - end_short) / (start_short - end_short)
    rule = F.when((v > start_long) & (v < end_long), up).when((v > end_short) & (v < start_short), down)
    return F.coalesce(rule.when(v >= end_long, F.lit(1.0)).when(v <= end_short, F.lit(-1.0)), F.lit(0.0))


def normalized(df: DataFrame, x: str, by: Sequence[str], order: str, n: int, winsorize: str = "std", method: str = "zscore", squash_method: str = "tanh", out: str = "pos") -> DataFrame:
    """Rolling winsorize, normalize, squash."""
    w = rolling.last(n, by, order)
    df = df.withColumn("__w", rolling.winsorize(x, w, winsorize))
    df = df.withColumn("__z", rolling.normalize("__w", w, n, method))
    return df.withColumn(out, F.when(F.col(x).isNotNull(), F.coalesce(squash(F.col("__z"), squash_method), F.lit(0.0))).otherwise(F.lit(0.0))).drop("__w", "__z")


def prepare(df: DataFrame, lag: int, by: Sequence[str] = ("key",), order: str = "t") -> DataFrame:
    """Valid labels, lagged factor, reference price."""
    w = Window.partitionBy(*by).orderBy(order)
    ok = df.where("label > -1")
    ref = F.coalesce(F.product(F.col("label") + 1).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(1.0))
    return ok.withColumns({"ref": ref, "factor": F.lag("factor", lag).over(w) if lag else F.col("factor")})


def trades(df: DataFrame, fee: float, by: Sequence[str] = ("key",), order: str = "t") -> DataFrame:
    """tpnl_<side> of the sides of ``pos`` and of the passive holdings."""
    w = Window.partitionBy(*by).orderBy(order)
    df = df.withColumns({"pos_ls": F.col("pos"), "pos_long": F.greatest("pos", F.lit(0.0)), "pos_short": F.least("pos", F.lit(0.0)), "pos_passive": F.lit(1.0)})
    out = {}
    for s in HELD:
        prev = F.coalesce(F.lag(f"pos_{s}").over(w), F.lit(0.0))
        old = F.coalesce(F.lag(F.col(f"pos_{s}") / F.col("ref")).over(w), F.lit(0.0)) * F.col("ref")
        out[f"tpnl_{s}"] = old - prev - F.abs(F.col(f"pos_{s}") - old) * fee
    before = F.lag("label").over(w)
    out["tpnl_short_passive"] = F.coalesce(-before - F.abs(before) * fee, F.lit(-fee))
    return df.withColumns(out)


def rolling_ic(df: DataFrame, factor: str = "factor", label: str = "label", by: Sequence[str] = ("key",), order: str = "t", n: int = WINDOW) -> DataFrame:
    """Adds ``ic`` over the last n rows, from the n-th row on."""
    w = rolling.last(n, by, order)
    both = F.col(factor).isNotNull() & F.col(label).isNotNull()
    a, b = F.when(both, F.col(factor)), F.when(both, F.col(label))
    sa, sb = F.stddev_pop(a).over(w), F.stddev_pop(b).over(w)
    c = F.when((sa > 1e-14) & (sb > 1e-14), F.covar_pop(a, b).over(w) / (sa * sb))
    nth = F.row_number().over(Window.partitionBy(*by).orderBy(order))
    return df.withColumn("ic", F.when(nth >= n, c))


def rolling_rank_ic(df: DataFrame, factor: str = "factor", label: str = "label", by: Sequence[str] = ("key",), order: str = "t", n: int = WINDOW) -> DataFrame:
    """(key, order, rank_ic) re-ranked inside each window of n rows.

    Each row is copied to the n windows that hold it by an explode of window numbers, then grouped: the
    work is n x rows and no range join is planned.
    """
    rows = df.withColumn("__i", F.row_number().over(Window.partitionBy(*by).orderBy(order)))
    most = F.max("__i").over(Window.partitionBy(*by))
    rows = rows.withColumn("__m", most).where("__m >= " + str(n))
    spread = rows.select(*by, "__i", order, factor, label, F.explode(F.sequence(F.greatest("__i", F.lit(n)), F.least(F.col("__i") + n - 1, "__m"))).alias("__w"))
    spread = spread.where(F.col("__w").between(F.col("__i"), F.col("__i") + n - 1))
    ends = rows.select(*by, F.col("__i").alias("__w"), F.col(order).alias("__t"))
    got = stats.rank_ic(spread, factor, label, [*by, "__w"])
    return got.join(ends, [*by, "__w"]).select(*by, F.col("__t").alias(order), "rank_ic")


def acf(df: DataFrame, factor: str, lags: Sequence[int], by: Sequence[str] = ("key",), order: str = "t") -> DataFrame:
    """(key, lag, acf): Spearman correlation of the series with itself ``lag`` rows on."""
    rows = df.withColumns({"__i": F.row_number().over(Window.partitionBy(*by).orderBy(order))}).select(*by, "__i", F.col(factor).alias("__a"))
    later = rows.select(*by, F.col("__i").alias("__j"), F.col("__a").alias("__b"))
    pairs = rows.withColumn("lag", F.explode(F.array(*map(F.lit, lags)))).withColumn("__j", F.col("__i") + F.col("lag")).join(later, [*by, "__j"])
    return stats.rank_ic(pairs, "__a", "__b", [*by, "lag"], "acf")


def summary(df: DataFrame, fee: float, by: Sequence[str] = ("key",), order: str = "t", day: str = "day", annual_days: float = 252) -> DataFrame:
    """(key, side, metrics) of a table with ``pos`` and ``ref``."""
    traded = trades(df, fee, by, order)
    sides = ALL_SIDES
    tidy = traded.select(*by, day, F.explode(F.array(*[F.struct(F.lit(s).alias("side"), F.col(f"tpnl_{s}").alias("pnl")) for s in sides])).alias("r")).select(*by, day, "r.*")
    daily = tidy.groupBy(*by, "side", day).agg(F.sum("pnl").alias("pnl"))
    t = traded.groupBy(*by).agg(F.greatest(F.datediff(F.max(day), F.min(day)) / F.lit(365.25), F.lit(1 / 365.25)).alias("years"))
    return stats.return_metrics(daily.join(t, list(by)), "pnl", [*by, "side", "years"], day, F.col("years"), float(annual_days)).drop("years")
