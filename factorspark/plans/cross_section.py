"""Cross-sectional backtest as one family of window plans over (dt, sym, factor, label[, weight]).

Order of work: per symbol (lag, reference price), per date (layers, positions), per symbol (trades), per
date (sums). Fees enter after aggregation: base PnL and traded volume are summed once for all fees.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factorspark.functions.weights import finite
from factorspark.operators import stats
from factorspark.operators.returns import reference_price
from factorspark.operators.xsection import layer, normalize, winsorize

ALL_SIDES = "ls long short passive short_passive".split()
HELD = tuple(ALL_SIDES[:4])
SIDES = dict(zip(ALL_SIDES, ["long_short", *ALL_SIDES[1:]], strict=True))
MODES = ("long/short_layers", "long/short_normalization")


@dataclass
class Config:
    """Parameters of a cross-sectional backtest."""

    layers: int = 5
    long_layers: tuple[int, ...] = (1,)
    short_layers: tuple[int, ...] = (5,)
    fees: tuple[float, ...] = (0.0, 0.0002, 0.0005)
    lag: int = 2
    annual_days: float | None = 252
    mode: str = "long/short_layers"
    winsorize_method: str = "std"
    winsorize_n: float = 3.0
    normalization_method: str = "zscore"
    weight: str | None = None
    problems: list[str] = field(default_factory=list)


def validate(df: DataFrame, c: Config) -> list[str]:
    """What is wrong with a configuration for this panel; empty if nothing is."""
    out = []
    if c.mode not in MODES:
        out.append(f"unknown mode {c.mode}")
    if c.layers < 2:
        out.append("layers must be 2 or more")
    if c.lag < 0:
        out.append("lag must not be negative")
    if any(f < 0 for f in c.fees) or not c.fees:
        out.append("fees must be given and not negative")
    if c.mode == MODES[0]:
        if not c.long_layers or not c.short_layers or set(c.long_layers) & set(c.short_layers):
            out.append("long and short layers must be given and differ")
        if any(not 1 <= x <= c.layers for x in (*c.long_layers, *c.short_layers)):
            out.append("layers out of range")
    least = df.groupBy("dt").agg(F.countDistinct("sym").alias("n")).agg(F.min("n")).first()[0] or 0
    if least < c.layers:
        out.append(f"a date has {least} symbols for {c.layers} layers")
    return out


def prepare(df: DataFrame, lag: int) -> DataFrame:
    """Valid labels only, then the factor of ``lag`` rows ago and the reference price of each row."""
    ok = df.where(finite(F.col("label")).isNotNull() & (F.col("label") > -1)).withColumn("factor", finite(F.col("factor")))
    w = Window.partitionBy("sym").orderBy("dt")
    return ok.withColumns({"factor": F.lag("factor", lag).over(w) if lag else F.col("factor"), "ref": reference_price("label")})


def raw_signal(df: DataFrame, c: Config) -> DataFrame:
    """Adds ``layer`` and ``raw``: +1, -1 or 0 by layer, or the normalized factor."""
    df = df.withColumn("layer", layer("factor", c.layers, ["dt"], "sym"))
    if c.mode == MODES[0]:
        raw = F.when(F.col("layer").isin(*c.long_layers), F.lit(1.0)).when(F.col("layer").isin(*c.short_layers), F.lit(-1.0)).otherwise(F.lit(0.0))
        return df.withColumn("raw", raw)
    df = winsorize(df, "factor", ["dt"], c.winsorize_method, c.winsorize_n, "__w")
    return df.withColumn("raw", F.coalesce(normalize("__w", ["dt"], c.normalization_method), F.lit(0.0))).drop("__w")


def positions(df: DataFrame) -> DataFrame:
    """Adds pos_ls, pos_long, pos_short, pos_passive from ``raw`` of the rows that have a factor."""
    w = Window.partitionBy("dt")
    use = F.col("factor").isNotNull()
    df = df.withColumn("__d", F.when(use, F.col("raw") - F.avg(F.when(use, F.col("raw"))).over(w)))
    gross = F.sum(F.abs("__d")).over(w)
    df = df.withColumn("pos_ls", F.when(use & (gross > 1e-15), F.col("__d") / gross).otherwise(F.lit(0.0)))
    up = F.sum(F.greatest("pos_ls", F.lit(0.0))).over(w)
    down = F.sum(F.least("pos_ls", F.lit(0.0))).over(w)
    return df.withColumns(
        {
            "pos_long": F.when(up > 0, F.greatest("pos_ls", F.lit(0.0)) / up).otherwise(F.lit(0.0)),
            "pos_short": F.when(down < 0, F.least("pos_ls", F.lit(0.0)) / -down).otherwise(F.lit(0.0)),
            "pos_passive": F.lit(1.0) / F.count(F.lit(1)).over(w),
        }
    ).drop("__d")


def trades(df: DataFrame, sides: tuple[str, ...] = HELD) -> DataFrame:
    """Adds base_<side> and trade_<side>: PnL before fees and traded volume of each row."""
    w = Window.partitionBy("sym").orderBy("dt")
    out = {}
    for s in sides:
        prev = F.coalesce(F.lag(f"pos_{s}").over(w), F.lit(0.0))
        old = F.coalesce(F.lag(F.col(f"pos_{s}") / F.col("ref")).over(w), F.lit(0.0)) * F.col("ref")
        out[f"base_{s}"] = old - prev
        out[f"trade_{s}"] = F.abs(F.col(f"pos_{s}") - old)
        out[f"turn_{s}"] = F.abs(F.col(f"pos_{s}") - prev)
    return df.withColumns(out)


def prepared(df: DataFrame, c: Config) -> DataFrame:
    """Panel with factor, layers, positions and trades."""
    return trades(positions(raw_signal(prepare(df, c.lag), c)))


def fee_table(df: DataFrame, fees: tuple[float, ...]) -> DataFrame:
    """(fee, cost): the fees with their labels in basis points."""
    rows = [(float(f), f"{round(f * 1e4, 1)} bp") for f in fees]
    return df.sparkSession.createDataFrame(rows, "fee double, cost string")


def pnl(traded: DataFrame, fees: tuple[float, ...]) -> DataFrame:
    """(cost, dt, side, pnl) per date: sums over symbols first, fees applied to the sums."""
    sides = HELD
    sums = traded.groupBy("dt").agg(*[F.sum(f"base_{s}").alias(f"b_{s}") for s in sides], *[F.sum(f"trade_{s}").alias(f"t_{s}") for s in sides])
    rows = [F.struct(F.lit(s).alias("side"), F.col(f"b_{s}").alias("b"), F.col(f"t_{s}").alias("t")) for s in sides]
    rows.append(F.struct(F.lit("short_passive").alias("side"), (-F.col("b_passive")).alias("b"), F.col("t_passive").alias("t")))
    tidy = sums.select("dt", F.explode(F.array(*rows)).alias("r")).select("dt", "r.side", "r.b", "r.t")
    return tidy.crossJoin(F.broadcast(fee_table(traded, fees))).select("cost", "dt", "side", (F.col("b") - F.col("fee") * F.col("t")).alias("pnl"))  # a row a fee


def turnover(traded: DataFrame) -> DataFrame:
    """(dt, ls, long, short, passive): position changes summed per date."""
    return traded.groupBy("dt").agg(*[F.sum(f"turn_{s}").alias(s) for s in HELD])


def win_rates(traded: DataFrame, fees: tuple[float, ...]) -> DataFrame:
    """(cost, side, win_rate): share of held rows with a positive PnL."""
    sides = HELD
    rows = [F.struct(F.lit(s).alias("side"), F.col(f"base_{s}").alias("b"), F.col(f"trade_{s}").alias("t"), F.col(f"pos_{s}").alias("p")) for s in sides]
    rows.append(F.struct(F.lit("short_passive").alias("side"), (-F.col("base_passive")).alias("b"), F.col("trade_passive").alias("t"), F.col("pos_passive").alias("p")))
    tidy = traded.select(F.explode(F.array(*rows)).alias("r")).select("r.*").where("p <> 0").crossJoin(F.broadcast(fee_table(traded, fees)))  # a row a fee
    return tidy.groupBy("cost", "side").agg((F.count_if(F.col("b") - F.col("fee") * F.col("t") > 0) / F.count("*")).alias("win_rate"))


def layer_returns(df: DataFrame, weight: str | None = None) -> DataFrame:
    """(dt, layer, ret): PnL of holding each layer, credited to the layer held before."""
    g, w = Window.partitionBy("dt", "layer"), Window.partitionBy("sym").orderBy("dt")
    pos = F.lit(1.0) / F.count(F.lit(1)).over(g)
    if weight:
        own = F.when(F.col(weight) > 0, F.col(weight)).otherwise(F.lit(0.0))
        pos = F.when(F.sum(own).over(g) > 0, own / F.sum(own).over(g)).otherwise(pos)
    df = df.withColumn("__p", F.when(F.col("layer") > 0, pos).otherwise(F.lit(0.0)))
    df = df.withColumns({"__l": F.lag("layer").over(w), "__b": F.lag(F.col("__p") / F.col("ref")).over(w) * F.col("ref") - F.lag("__p").over(w)})
    return df.where("__l > 0").groupBy("dt", F.col("__l").alias("layer")).agg(F.sum("__b").alias("ret"))


def layer_rank_ic(df: DataFrame) -> DataFrame:
    """(dt, layer, rank_ic), ranks taken within the layer."""
    return stats.rank_ic(df.where("layer > 0"), "factor", "label", ["dt", "layer"])


LAGS = (*range(1, 21), *range(25, 51, 5), 100, 150, 200)


def factor_acf(df: DataFrame, lags: tuple[int, ...] = LAGS) -> DataFrame:
    """(lag, acf): mean over dates of the correlation between factors ``lag`` dates apart.

    The lag table is joined by equality on the shifted date number, so the work is lags x rows.
    """
    days = df.select("dt").distinct().withColumn("i", F.row_number().over(Window.orderBy("dt")))
    rows = df.join(days, "dt").select("sym", "i", "factor")
    shifted = rows.select(F.col("sym").alias("s2"), F.col("i").alias("i2"), F.col("factor").alias("later"))
    pairs = rows.withColumn("lag", F.explode(F.array(*map(F.lit, lags)))).join(shifted, (F.col("sym") == F.col("s2")) & (F.col("i") + F.col("lag") == F.col("i2")))
    return stats.ic(pairs, "factor", "later", ["lag", "i"], "c").groupBy("lag").agg(F.avg("c").alias("acf"))


def half_life(acf: DataFrame) -> DataFrame:
    """(acf_1, acf_halflife): first lag under 0.5, the longest lag if there is none."""
    return acf.agg(F.max(F.when(F.col("lag") == 1, F.col("acf"))).alias("acf_1"), F.coalesce(F.min(F.when(F.col("acf") < 0.5, F.col("lag"))), F.lit(max(LAGS))).alias("acf_halflife"))


def summary(df: DataFrame, c: Config | None = None) -> DataFrame:
    """(cost, side, ret_annual, ret_sharpe, ret_sortino, ret_max_dd, ret_calmar, turnover_ratio,
    ret_sharpe_per_turnover, excess_ret_annual, win_rate): one row a fee and side."""
    c = c or Config()
    traded = prepared(df, c)
    t = stats.time_metrics(traded, "dt", c.annual_days)
    daily = pnl(traded, c.fees).groupBy("cost", "side", F.to_date("dt").alias("day")).agg(F.sum("pnl").alias("pnl"))
    years = daily.crossJoin(F.broadcast(t))  # one row
    got = stats.return_metrics(years.withColumn("__years", F.col("num_years")), "pnl", ["cost", "side", "num_years", "dates_to_years"], "day", F.col("num_years"), F.col("dates_to_years"))
    turn = turnover(traded).agg(*[F.avg(s).alias(s) for s in HELD])
    ratio = F.when(F.col("side") == "short_passive", F.col("passive"))
    for s in HELD:
        ratio = ratio.when(F.col("side") == s, F.col(s))
    got = got.crossJoin(F.broadcast(turn)).withColumn("turnover_ratio", ratio)  # one row
    got = got.withColumn("ret_sharpe_per_turnover", F.when(F.col("turnover_ratio") > 0, F.col("ret_sharpe") / F.col("turnover_ratio")).otherwise(F.lit(0.0)))
    w = Window.partitionBy("cost")
    annual = lambda s: F.max(F.when(F.col("side") == s, F.col("ret_annual"))).over(w)
    excess = F.when(F.col("side") == "long", F.col("ret_annual") - annual("passive")).when(F.col("side") == "short", F.col("ret_annual") - annual("short_passive"))
    got = got.withColumn("excess_ret_annual", excess).join(win_rates(traded, c.fees), ["cost", "side"], "left")
    return got.select("cost", "side", "ret_annual", "ret_sharpe", "ret_sortino", "ret_max_dd", "ret_calmar", "turnover_ratio", "ret_sharpe_per_turnover", "excess_ret_annual", F.coalesce("win_rate", F.lit(0.0)).alias("win_rate"))


def issues(summary_table: DataFrame) -> DataFrame:
    """(cost, side, metric, value, issue) of metrics beyond their plausible bounds."""
    bounds = {"ret_annual": (-5.0, 5.0), "ret_sharpe": (-10.0, 10.0), "ret_max_dd": (-1.0, 0.0)}
    tidy = summary_table.unpivot(["cost", "side"], list(bounds), "metric", "value")
    code = F.when(F.col("value").isNull() | F.isnan("value"), F.lit("missing"))
    for m, (a, b) in bounds.items():
        code = code.when((F.col("metric") == m) & ~F.col("value").between(a, b), F.lit("out_of_range"))
    return tidy.withColumn("issue", code).where("issue IS NOT NULL")


def by_cost(summary_table: DataFrame) -> DataFrame:
    """(metric, by_cost): metric names prefixed by side, values as a map from cost."""
    metrics = [c for c in summary_table.columns if c not in ("cost", "side")]
    tidy = summary_table.unpivot(["cost", "side"], metrics, "m", "value").where("value IS NOT NULL")
    names = F.create_map(*[F.lit(x) for kv in SIDES.items() for x in kv])
    return tidy.groupBy(F.concat_ws("_", names[F.col("side")], "m").alias("metric")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("cost", "value")))).alias("by_cost"))
