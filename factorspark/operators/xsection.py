"""Cross-sectional transforms: Column builders over one window a date (or any other group)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def over(*by: str) -> WindowSpec:
    return Window.partitionBy(*by)


def avg_rank(x: str, by: Sequence[str]) -> Column:
    """Average-tie rank of non-missing values within the group, from 1."""
    known = F.when(F.col(x).isNotNull(), F.lit(1)).otherwise(F.lit(0))
    first = F.rank().over(Window.partitionBy(*by, known).orderBy(x))
    same = F.count(F.lit(1)).over(Window.partitionBy(*by, x))
    return F.when(F.col(x).isNotNull(), first + (same - 1) / F.lit(2.0))


def ordinal_pct(x: str, by: Sequence[str], tie: str) -> Column:
    """Ordinal rank over the number of valid values; ties in the order of ``tie``, missing stays missing."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.col(x).asc_nulls_last(), tie))
    return F.when(F.col(x).isNotNull(), place / F.count(x).over(over(*by)))


def layer(x: str, layers: int, by: Sequence[str], tie: str) -> Column:
    """Layer 1 (highest values) to ``layers``; missing values are in layer 0."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.col(x).desc_nulls_last(), tie))
    code = F.ceil(place * F.lit(layers) / F.count(x).over(over(*by)))
    return F.when(F.col(x).isNotNull(), code).otherwise(F.lit(0)).cast("int")


def zscore(x: str, by: Sequence[str], ddof: int = 1) -> Column:
    """Standard score; 0 where the group has one value or no spread."""
    w = over(*by)
    sd = (F.stddev_samp(x) if ddof else F.stddev_pop(x)).over(w)
    return F.when(F.col(x).isNotNull(), F.when(sd > 0, (F.col(x) - F.avg(x).over(w)) / sd).otherwise(F.lit(0.0)))


def minmax(x: str, by: Sequence[str]) -> Column:
    """Scaled to [-1, 1]; 0 without spread."""
    w = over(*by)
    low, span = F.min(x).over(w), F.max(x).over(w) - F.min(x).over(w)
    return F.when(F.col(x).isNotNull(), F.when(span > 0, (F.col(x) - low) / span * 2 - 1).otherwise(F.lit(0.0)))


def demean(x: str, by: Sequence[str]) -> Column:
    return F.col(x) - F.avg(x).over(over(*by))


def rank_scaled(x: str, by: Sequence[str]) -> Column:
    """Average-tie rank scaled to [-1, 1]; 0 for a single value."""
    n = F.count(x).over(over(*by))
    return F.when(F.col(x).isNotNull(), F.when(n > 1, (avg_rank(x, by) - 1) * 2 / (n - 1) - 1).otherwise(F.lit(0.0)))


def _clip(x: Column, low: Column, high: Column) -> Column:
    return F.when(x.isNotNull(), F.greatest(F.least(x, high), low))


def winsorize_std(x: str, by: Sequence[str], n: float = 3.0) -> Column:
    w = over(*by)
    mu, sd = F.avg(x).over(w), F.coalesce(F.stddev_samp(x).over(w), F.lit(0.0))
    return F.when(sd > 0, _clip(F.col(x), mu - n * sd, mu + n * sd)).otherwise(F.col(x))


def median(x: str, by: Sequence[str]) -> Column:
    return F.percentile(x, F.lit(0.5)).over(over(*by))


def mad(x: str, center: str, by: Sequence[str]) -> Column:
    """Median distance from the ``center`` column, unscaled."""
    return F.percentile(F.abs(F.col(x) - F.col(center)), F.lit(0.5)).over(over(*by))


def winsorize_around(x: str, center: str, spread: str, n: float) -> Column:
    """Clipped to center +- n * spread; unchanged without spread."""
    c, s = F.col(center), F.col(spread)
    return F.when(s > 0, _clip(F.col(x), c - n * s, c + n * s)).otherwise(F.col(x))


def nearest_quantile(values: Column, q: float) -> Column:
    """Element int(q * (n - 1) + 0.5) of a sorted array."""
    return F.try_element_at(values, F.floor(F.lit(q) * (F.size(values) - 1) + F.lit(0.5)).cast("int") + 1)


def winsorize_quantile(df: DataFrame, x: str, by: Sequence[str], q: float = 0.01, out: str = "winsorized") -> DataFrame:
    """Adds x clipped to the nearest quantiles q and 1 - q of its group, which are found once a group."""
    bounds = df.groupBy(*by).agg(F.sort_array(F.collect_list(x)).alias("__v"))
    bounds = bounds.select(*by, nearest_quantile(F.col("__v"), q).alias("__low"), nearest_quantile(F.col("__v"), 1 - q).alias("__high"))
    return df.join(bounds, list(by)).withColumn(out, _clip(F.col(x), F.col("__low"), F.col("__high"))).drop("__low", "__high")


def winsorize_percentile(x: str, by: Sequence[str], low: float = 0.01, high: float = 0.99) -> Column:
    """Clipped to linearly interpolated percentiles of the group."""
    w = over(*by)
    return _clip(F.col(x), F.percentile(x, F.lit(low)).over(w), F.percentile(x, F.lit(high)).over(w))


def population_zscore(x: str, by: Sequence[str], floor: float = 1e-12) -> Column:
    w = over(*by)
    sd = F.stddev_pop(x).over(w)
    return F.when(F.col(x).isNotNull(), F.when(sd > floor, (F.col(x) - F.avg(x).over(w)) / sd).otherwise(F.lit(0.0)))


NORMALIZERS = {"zscore": zscore, "minmax": minmax, "rank": rank_scaled, "demean": demean}


def normalize(x: str, by: Sequence[str], method: str = "zscore") -> Column:
    """Dispatch by method name."""
    if method not in NORMALIZERS:
        raise ValueError(f"no such normalization: {method}")
    return NORMALIZERS[method](x, by)


def winsorize(df, x: str, by: Sequence[str], method="std", n=3.0, out: str = "winsorized"):
    """Adds a winsorized column to a frame, by method name."""
    if method == "std":
        return df.withColumn(out, winsorize_std(x, by, n))
    if method == "quantile":
        return winsorize_quantile(df, x, by, n, out)
    if method == "mad":
        df = df.withColumn("__median", median(x, by))
        df = df.withColumn("__mad", mad(x, "__median", by))
        return df.withColumn(out, winsorize_around(x, "__median", "__mad", n)).drop("__median", "__mad")
    raise ValueError(f"no such winsorizing: {method}")
