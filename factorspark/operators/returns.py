"""Returns, dense calendars and fills over a long panel (dt, sym, close)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def by_symbol(sym: str = "sym", dt: str = "dt") -> WindowSpec:
    return Window.partitionBy(sym).orderBy(dt)


def lookback_return(n: int = 1, close: str = "close", sym: str = "sym", dt: str = "dt") -> Column:
    """close over the close n rows earlier, less 1; missing at the edge or after a zero price."""
    return F.try_divide(F.col(close), F.lag(close, n).over(by_symbol(sym, dt))) - 1


def forward_return(close: str = "close", sym: str = "sym", dt: str = "dt") -> Column:
    """Next row's close over this one's, less 1."""
    return F.try_divide(F.lead(close).over(by_symbol(sym, dt)), F.col(close)) - 1


def tradable_return(daily: DataFrame, dt: str = "dt", sym: str = "sym", close: str = "close") -> DataFrame:
    """(month, sym, first_close, month_close, ret): last over first trading close of each month."""
    got = daily.where(F.col(close).isNotNull()).groupBy(F.trunc(dt, "month").alias("month"), sym).agg(F.min_by(close, dt).alias("first_close"), F.max_by(close, dt).alias("month_close"))
    return got.withColumn("ret", F.try_divide("month_close", "first_close") - 1)


def sector_relative(x: str, sector: str = "sector", dt: str = "dt", keep_raw: bool = False) -> Column:
    """x less the mean of its sector on that date.

    A missing sector gives a missing result, or the raw value with ``keep_raw``.
    """
    known = F.col(sector).isNotNull() & (F.col(sector).cast("string") != "")
    rel = F.col(x) - F.avg(x).over(Window.partitionBy(dt, sector))
    return F.when(known, rel).otherwise(F.col(x) if keep_raw else F.lit(None))


def less_sector_mean(df: DataFrame, x: str, out: str, sector: str = "sector", dt: str = "dt") -> DataFrame:
    """``sector_relative`` as a column ``out`` for few dates and sectors: their means are sent to the rows, which stay where they are."""
    known = F.col(sector).isNotNull() & (F.col(sector).cast("string") != "")
    mean = df.groupBy(F.col(dt).alias("__d"), F.col(sector).alias("__s")).agg(F.avg(x).alias("__m"))
    got = df.join(F.broadcast(mean), F.col(dt).eqNullSafe(F.col("__d")) & (F.col(sector) == F.col("__s")), "left")  # a row a date and sector
    return got.withColumn(out, F.when(known, F.col(x) - F.col("__m"))).drop("__d", "__s", "__m")


def densify(df: DataFrame, dt: str = "dt", sym: str = "sym") -> DataFrame:
    """All dates times all symbols, missing cells as rows without values."""
    dates, syms = df.select(dt).distinct(), df.select(sym).distinct()
    return dates.crossJoin(syms).join(df, [dt, sym], "left")


def forward_fill(x: str, sym: str = "sym", dt: str = "dt") -> Column:
    """The value or the latest earlier one of the symbol."""
    return F.last(x, ignorenulls=True).over(by_symbol(sym, dt).rowsBetween(Window.unboundedPreceding, 0))


def cumulative(x: str, sym: str = "sym", dt: str = "dt") -> Column:
    """Running sum of known values; missing where the value is."""
    return F.when(F.col(x).isNotNull(), F.sum(x).over(by_symbol(sym, dt).rowsBetween(Window.unboundedPreceding, 0)))


def reference_price(label: str, sym: str = "sym", dt: str = "dt") -> Column:
    """Product of 1 + label over all earlier rows of the symbol, 1 at its first."""
    w = by_symbol(sym, dt).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.product(F.col(label) + 1).over(w), F.lit(1.0))


def log_size(close: Column, shares: Column) -> Column:
    """Logarithm of close times shares where that is positive."""
    cap = close * shares
    return F.when(cap > 0, F.log(cap))
