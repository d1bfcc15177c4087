"""Queries over one date's cross-section and over rolling windows, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factorspark.functions import weights as W
from factorspark.operators import returns as ret
from factorspark.operators import rolling as roll
from factorspark.operators import stats
from factorspark.operators import xsection as xs
from factorspark.plans.registry import query
from factorspark.sources import fixtures as fx

BY = ["dt"]


def r(c: Column | str, name: str) -> Column:
    """Rounded for comparison; adding 0.0 turns a negative zero into zero."""
    return (F.round(F.col(c) if isinstance(c, str) else c, 6) + F.lit(0.0)).alias(name)


def rs(expr: str, name: str) -> str:
    return f"round({expr}, 6) + 0.0 AS {name}"


def simple(name: str, column: Callable[[], Column], sql: str) -> None:
    """A query of one derived column over the valid panel."""

    @query(name, f"WITH {fx.FL_SQL} SELECT dt, sym, {rs(sql, 'value')} FROM ok WINDOW wd AS (PARTITION BY dt), ws AS (PARTITION BY sym ORDER BY dt)")
    def run(spark: SparkSession, d: str) -> DataFrame:
        return fx.ok(spark, d).select("dt", "sym", r(column(), "value"))


simple("w15_cs_zscore", lambda: xs.zscore("factor", BY), "CASE WHEN coalesce(stddev_samp(factor) OVER wd, 0) > 0 THEN (factor - avg(factor) OVER wd) / stddev_samp(factor) OVER wd ELSE 0 END")
simple("w16_cs_minmax", lambda: xs.minmax("factor", BY), "CASE WHEN max(factor) OVER wd > min(factor) OVER wd THEN (factor - min(factor) OVER wd) / (max(factor) OVER wd - min(factor) OVER wd) * 2 - 1 ELSE 0 END")
simple("w17_cs_demean", lambda: xs.demean("factor", BY), "factor - avg(factor) OVER wd")
simple("w19_cs_winsorize_std", lambda: xs.winsorize_std("factor", BY, 1.5), "CASE WHEN coalesce(stddev_samp(factor) OVER wd, 0) > 0 THEN greatest(least(factor, avg(factor) OVER wd + 1.5 * stddev_samp(factor) OVER wd), avg(factor) OVER wd - 1.5 * stddev_samp(factor) OVER wd) ELSE factor END")
simple("w38_cs_zscore_population", lambda: xs.population_zscore("factor", BY), "CASE WHEN stddev_pop(factor) OVER wd > 1e-12 THEN (factor - avg(factor) OVER wd) / stddev_pop(factor) OVER wd ELSE 0 END")
simple("w39_gics_demean", lambda: xs.demean("factor", ["dt", "sector"]), "factor - avg(factor) OVER (PARTITION BY dt, sector)")


@query("w21_cs_winsorize_quantile", f"WITH {fx.FL_SQL} SELECT dt, sym, {rs('greatest(least(factor, list_sort(list(factor) OVER wd)[CAST(floor(0.9 * (count(*) OVER wd - 1) + 0.5) AS INT) + 1]), list_sort(list(factor) OVER wd)[CAST(floor(0.1 * (count(*) OVER wd - 1) + 0.5) AS INT) + 1])', 'value')} FROM ok WINDOW wd AS (PARTITION BY dt)")
def w21(spark: SparkSession, d: str) -> DataFrame:
    return xs.winsorize_quantile(fx.ok(spark, d), "factor", BY, 0.1, "x").select("dt", "sym", r("x", "value"))


simple("f5_winsorize_percentile", lambda: xs.winsorize_percentile("factor", BY), "greatest(least(factor, quantile_cont(factor, 0.99) OVER wd), quantile_cont(factor, 0.01) OVER wd)")
simple("w41_own_momentum", lambda: ret.lookback_return(2), "close / nullif(lag(close, 2) OVER ws, 0) - 1")
simple("w35_cumulative_sum", lambda: ret.cumulative("label"), "sum(label) OVER (PARTITION BY sym ORDER BY dt ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")
simple("w9_reference_price", lambda: ret.reference_price("label"), "coalesce(product(1 + label) OVER (PARTITION BY sym ORDER BY dt ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1)")
simple("w8_lag_after_filter", lambda: F.lag("factor", 2).over(ret.by_symbol()), "lag(factor, 2) OVER ws")
simple("f1_sigmoid_weights", lambda: W.sigmoid_weights(F.col("factor"), 10.0, 0.5), "1.0 / (1.0 + exp(-10.0 * (factor - 0.5)))")
simple("f2_threshold_weights", lambda: W.threshold_weights(F.col("factor"), 0.05), "CASE WHEN factor >= 0.05 THEN 1.0 ELSE 0.0 END")
simple("f3_blend_ranks", lambda: W.blend(xs.ordinal_pct("factor", BY, "sym"), xs.ordinal_pct("close", BY, "sym"), 0.25), "0.25 * (row_number() OVER (PARTITION BY dt ORDER BY factor, sym) / CAST(count(*) OVER wd AS DOUBLE)) + 0.75 * (row_number() OVER (PARTITION BY dt ORDER BY close, sym) / CAST(count(*) OVER wd AS DOUBLE))")
simple("f6_squash_tanh", lambda: W.squash(F.col("factor") * 5), "tanh(factor * 5)")
simple("f6_squash_clip", lambda: W.squash(F.col("factor") * 10, "clip"), "greatest(-1.0, least(1.0, factor * 10))")
simple("f8_guarded_log", lambda: F.when(F.col("factor") > 0, F.log("factor")), "CASE WHEN factor > 0 THEN ln(factor) END")
simple("p11_finite_or_null", lambda: W.finite(F.when(F.col("sym") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("factor"))), "CASE WHEN sym % 7 <> 0 THEN factor END")
simple("p13_weight_not_positive_is_zero", lambda: F.when(F.col("weight") > 0, F.col("weight")).otherwise(F.lit(0.0)), "CASE WHEN weight > 0 THEN weight ELSE 0 END")


_RANKS = "WITH {fl}, rk AS (SELECT *, rank() OVER (PARTITION BY dt ORDER BY q) + (count(*) OVER (PARTITION BY dt, q) - 1) / 2.0 AS rk, count(*) OVER (PARTITION BY dt) AS m FROM (SELECT dt, sym, round(factor, 1) AS q FROM ok))"


@query("w4_average_rank", _RANKS.format(fl=fx.FL_SQL) + " SELECT dt, sym, rk AS value FROM rk")
def w4(spark: SparkSession, d: str) -> DataFrame:
    q = fx.ok(spark, d).select("dt", "sym", F.round("factor", 1).alias("q"))
    return q.select("dt", "sym", xs.avg_rank("q", BY).alias("value"))


@query("w18_cs_rank_scaled", _RANKS.format(fl=fx.FL_SQL) + f" SELECT dt, sym, {rs('CASE WHEN m > 1 THEN (rk - 1) * 2 / (m - 1) - 1 ELSE 0 END', 'value')} FROM rk")
def w18(spark: SparkSession, d: str) -> DataFrame:
    q = fx.ok(spark, d).select("dt", "sym", F.round("factor", 1).alias("q"))
    return q.select("dt", "sym", r(xs.rank_scaled("q", BY), "value"))


@query("w5_w6_percentile_rank", f"WITH {fx.FL_SQL} SELECT dt, sym, CASE WHEN factor IS NOT NULL THEN row_number() OVER (PARTITION BY dt ORDER BY factor NULLS LAST, sym) / CAST(count(factor) OVER (PARTITION BY dt) AS DOUBLE) END AS pct FROM fl")
def w5(spark: SparkSession, d: str) -> DataFrame:
    return fx.fl(spark, d).select("dt", "sym", xs.ordinal_pct("factor", BY, "sym").alias("pct"))


_LAYER = "CASE WHEN factor IS NULL THEN 0 ELSE CAST(ceil(row_number() OVER (PARTITION BY dt ORDER BY factor DESC NULLS LAST, sym) * 5 / CAST(count(factor) OVER (PARTITION BY dt) AS DOUBLE)) AS INT) END"


@query("w7_layers", f"WITH {fx.FL_SQL} SELECT dt, sym, {_LAYER} AS layer FROM fl")
def w7(spark: SparkSession, d: str) -> DataFrame:
    return fx.fl(spark, d).select("dt", "sym", xs.layer("factor", 5, BY, "sym").alias("layer"))


@query("a28_layer_counts", f"WITH {fx.FL_SQL}, l AS (SELECT dt, {_LAYER} AS layer FROM fl) SELECT dt, layer, count(*) AS n FROM l GROUP BY 1, 2")
def a28(spark: SparkSession, d: str) -> DataFrame:
    return w7(spark, d).groupBy("dt", "layer").agg(F.count("*").alias("n"))


@query("w20_cs_winsorize_mad", f"WITH {fx.FL_SQL}, m AS (SELECT *, quantile_cont(factor, 0.5) OVER (PARTITION BY dt) AS md FROM ok), s AS (SELECT *, quantile_cont(abs(factor - md), 0.5) OVER (PARTITION BY dt) AS mad FROM m) SELECT dt, sym, {rs('CASE WHEN mad > 0 THEN greatest(least(factor, md + 2 * mad), md - 2 * mad) ELSE factor END', 'value')} FROM s")
def w20(spark: SparkSession, d: str) -> DataFrame:
    return xs.winsorize(fx.ok(spark, d), "factor", BY, "mad", 2.0).select("dt", "sym", r("winsorized", "value"))


@query("w22_winsorize_then_zscore", f"WITH {fx.FL_SQL}, w AS (SELECT dt, sym, greatest(least(factor, avg(factor) OVER wd + 2 * stddev_samp(factor) OVER wd), avg(factor) OVER wd - 2 * stddev_samp(factor) OVER wd) AS x FROM ok WINDOW wd AS (PARTITION BY dt)) SELECT dt, sym, {rs('CASE WHEN stddev_samp(x) OVER wd > 0 THEN (x - avg(x) OVER wd) / stddev_samp(x) OVER wd ELSE 0 END', 'value')} FROM w WINDOW wd AS (PARTITION BY dt)")
def w22(spark: SparkSession, d: str) -> DataFrame:
    rows = xs.winsorize(fx.ok(spark, d), "factor", BY, "std", 2.0)
    return rows.select("dt", "sym", r(xs.normalize("winsorized", BY, "zscore"), "value"))


@query("f9_transform_dispatch", f"WITH {fx.FL_SQL} SELECT dt, sym, {rs('factor - avg(factor) OVER wd', 'demeaned')}, {rs('CASE WHEN stddev_samp(factor) OVER wd > 0 THEN (factor - avg(factor) OVER wd) / stddev_samp(factor) OVER wd ELSE 0 END', 'scored')} FROM ok WINDOW wd AS (PARTITION BY dt)")
def f9(spark: SparkSession, d: str) -> DataFrame:
    return fx.ok(spark, d).select("dt", "sym", r(xs.normalize("factor", BY, "demean"), "demeaned"), r(xs.normalize("factor", BY, "zscore"), "scored"))


@query("a43_nearest_quantile", f"WITH {fx.FL_SQL} SELECT dt, {rs('list_sort(list(factor))[CAST(floor(0.25 * (count(*) - 1) + 0.5) AS INT) + 1]', 'q25')} FROM ok GROUP BY dt")
def a43(spark: SparkSession, d: str) -> DataFrame:
    return fx.ok(spark, d).groupBy("dt").agg(r(xs.nearest_quantile(F.sort_array(F.collect_list("factor")), 0.25), "q25"))


@query("a44_median_mad", f"WITH {fx.FL_SQL}, m AS (SELECT dt, factor, quantile_cont(factor, 0.5) OVER (PARTITION BY dt) AS md FROM ok) SELECT dt, {rs('max(md)', 'median')}, {rs('quantile_cont(abs(factor - md), 0.5)', 'mad')} FROM m GROUP BY dt")
def a44(spark: SparkSession, d: str) -> DataFrame:
    rows = fx.ok(spark, d).withColumn("md", xs.median("factor", BY))
    return rows.groupBy("dt").agg(r(F.max("md"), "median"), r(F.percentile(F.abs(F.col("factor") - F.col("md")), F.lit(0.5)), "mad"))


@query("a42_percentiles", f"WITH {fx.FL_SQL} SELECT {rs('quantile_cont(factor, 0.01)', 'p1')}, {rs('quantile_cont(factor, 0.99)', 'p99')} FROM ok")
def a42(spark: SparkSession, d: str) -> DataFrame:
    return fx.ok(spark, d).agg(r(F.percentile("factor", F.lit(0.01)), "p1"), r(F.percentile("factor", F.lit(0.99)), "p99"))


@query("v15_winsor_zscore_min_names", f"WITH {fx.FL_SQL}, c AS (SELECT *, count(*) OVER (PARTITION BY dt, region) AS n FROM ok), w AS (SELECT dt, region, sym, greatest(least(factor, quantile_cont(factor, 0.99) OVER g), quantile_cont(factor, 0.01) OVER g) AS x FROM c WHERE n >= 5 WINDOW g AS (PARTITION BY dt, region)) SELECT dt, sym, {rs('CASE WHEN stddev_pop(x) OVER g > 1e-10 THEN (x - avg(x) OVER g) / stddev_pop(x) OVER g ELSE x - avg(x) OVER g END', 'value')} FROM w WINDOW g AS (PARTITION BY dt, region)")
def v15(spark: SparkSession, d: str) -> DataFrame:
    by = ["dt", "region"]
    rows = fx.ok(spark, d).withColumn("n", F.count(F.lit(1)).over(xs.over(*by))).where("n >= 5").withColumn("x", xs.winsorize_percentile("factor", by))
    sd, mu = F.stddev_pop("x").over(xs.over(*by)), F.avg("x").over(xs.over(*by))
    return rows.select("dt", "sym", r(F.when(sd > 1e-10, (F.col("x") - mu) / sd).otherwise(F.col("x") - mu), "value"))


@query("a2_sector_relative_core", f"WITH {fx.FL_SQL} SELECT dt, sym, {rs('CASE WHEN sector > 0 THEN factor - avg(factor) OVER (PARTITION BY dt, nullif(sector, 0)) ELSE factor END', 'value')} FROM ok")
def a2(spark: SparkSession, d: str) -> DataFrame:
    rows = fx.ok(spark, d).withColumn("sec", F.nullif("sector", F.lit(0)))
    return rows.select("dt", "sym", r(ret.sector_relative("factor", "sec", keep_raw=True), "value"))


@query("j2_sector_relative_left_join", f"WITH {fx.FL_SQL}, m AS (SELECT dt, sector, avg(factor) AS mu FROM ok WHERE sector > 0 GROUP BY 1, 2) SELECT ok.dt, sym, {rs('factor - mu', 'value')} FROM ok LEFT JOIN m ON m.dt = ok.dt AND m.sector = ok.sector")
def j2(spark: SparkSession, d: str) -> DataFrame:
    rows = fx.ok(spark, d).withColumn("sec", F.nullif("sector", F.lit(0)))
    return rows.select("dt", "sym", r(ret.sector_relative("factor", "sec"), "value"))


@query("a1_sector_mean", f"WITH {fx.FL_SQL} SELECT dt, sector, {rs('avg(factor)', 'mean')} FROM ok GROUP BY 1, 2")
def a1(spark: SparkSession, d: str) -> DataFrame:
    return fx.ok(spark, d).groupBy("dt", "sector").agg(r(F.avg("factor"), "mean"))


@query("w1_lookback_returns", f"WITH {fx.PANEL_SQL} SELECT dt, sym, {rs('close / nullif(lag(close) OVER w, 0) - 1', 'r1')}, {rs('close / nullif(lag(close, 12) OVER w, 0) - 1', 'r12')} FROM panel WINDOW w AS (PARTITION BY sym ORDER BY dt)")
def w1(spark: SparkSession, d: str) -> DataFrame:
    return fx.panel(spark, d).select("dt", "sym", r(ret.lookback_return(1), "r1"), r(ret.lookback_return(12), "r12"))


@query("w2_forward_label", f"WITH {fx.PANEL_SQL} SELECT dt, sym, {rs('lead(close) OVER (PARTITION BY sym ORDER BY dt) / nullif(close, 0) - 1', 'label')} FROM panel")
def w2(spark: SparkSession, d: str) -> DataFrame:
    return fx.panel(spark, d).select("dt", "sym", r(ret.forward_return(), "label"))


DAILY_SQL = "daily AS (SELECT CAST(l_shipdate AS DATE) AS dt, l_suppkey AS sym, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS DOUBLE) / CAST(sum(CAST(l_quantity AS BIGINT)) AS DOUBLE) AS close FROM lineitem GROUP BY 1, 2)"


def daily(spark: SparkSession, d: str) -> DataFrame:
    """Sparse daily panel (dt, sym, close), dealt by symbol once for the sums and the windows: few lines share a day."""
    cents, volume = F.round(F.col("l_extendedprice") * 100).cast("long").alias("cents"), F.col("l_quantity").cast("long").alias("volume")
    lines = fx.table(spark, d, "lineitem").select(F.to_date("l_shipdate").alias("dt"), F.col("l_suppkey").alias("sym"), cents, volume).repartition("sym")
    return lines.groupBy("dt", "sym").agg((F.sum("cents").cast("double") / F.sum("volume").cast("double")).alias("close"))


@query("w3_a3_tradable_return", f"WITH {DAILY_SQL} SELECT CAST(date_trunc('month', dt) AS DATE) AS month, sym, {rs('arg_min(close, dt)', 'first_close')}, {rs('arg_max(close, dt)', 'month_close')}, {rs('arg_max(close, dt) / nullif(arg_min(close, dt), 0) - 1', 'ret')} FROM daily GROUP BY 1, 2")
def w3(spark: SparkSession, d: str) -> DataFrame:
    got = ret.tradable_return(daily(spark, d))
    return got.select("month", "sym", r("first_close", "first_close"), r("month_close", "month_close"), r("ret", "ret"))


@query("w34_densify_forward_fill", f"WITH {fx.PANEL_SQL}, g AS (SELECT dt, sym FROM (SELECT DISTINCT dt FROM panel), (SELECT DISTINCT sym FROM panel)) SELECT g.dt AS dt, g.sym AS sym, {rs('last_value(close IGNORE NULLS) OVER (PARTITION BY g.sym ORDER BY g.dt ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)', 'close')} FROM g LEFT JOIN panel p ON p.dt = g.dt AND p.sym = g.sym")
def w34(spark: SparkSession, d: str) -> DataFrame:
    return ret.densify(fx.panel(spark, d)).select("dt", "sym", r(ret.forward_fill("close"), "close"))


@query("w14_turnover", f"WITH {fx.FL_SQL} SELECT dt, {rs('sum(x)', 'turnover')} FROM (SELECT dt, abs(factor - coalesce(lag(factor) OVER (PARTITION BY sym ORDER BY dt), 0)) AS x FROM ok) GROUP BY dt")
def w14(spark: SparkSession, d: str) -> DataFrame:
    moved = F.abs(F.col("factor") - F.coalesce(F.lag("factor").over(ret.by_symbol()), F.lit(0.0)))
    return fx.ok(spark, d).withColumn("x", moved).groupBy("dt").agg(r(F.sum("x"), "turnover"))


SHARES_SQL = "shares AS (SELECT dt, sym, volume AS shares FROM panel WHERE month(dt) % 3 = 0)"


def shares(spark: SparkSession, d: str) -> DataFrame:
    return fx.panel(spark, d).where("month(dt) % 3 = 0").select("dt", "sym", F.col("volume").alias("shares"))


@query("w42_j8_log_size", f"WITH {fx.PANEL_SQL}, {SHARES_SQL} SELECT p.dt AS dt, p.sym AS sym, {rs('ln(p.close * s.shares)', 'lncap')} FROM panel p ASOF JOIN shares s ON p.sym = s.sym AND p.dt >= s.dt")
def w42(spark: SparkSession, d: str) -> DataFrame:
    from factorspark.operators.joins import asof_backward

    got = asof_backward(fx.panel(spark, d), shares(spark, d), "dt", "shares", ["sym"])
    return got.where("shares IS NOT NULL").select("dt", "sym", r(ret.log_size(F.col("close"), F.col("shares")), "lncap"))


# rolling

_RW = "WINDOW w AS (PARTITION BY sym ORDER BY dt ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)"


def rolling(name: str, make, sql: str) -> None:
    @query(name, f"WITH {fx.FL_SQL} SELECT dt, sym, {rs(sql, 'value')} FROM ok {_RW}")
    def run(spark: SparkSession, d: str) -> DataFrame:
        return fx.ok(spark, d).select("dt", "sym", r(make(roll.last(12, ["sym"], "dt")), "value"))


_SD = "CASE WHEN count(factor) OVER w > 1 THEN stddev_samp(factor) OVER w END"
rolling("w23_rolling_mean", lambda w: roll.mean("factor", w), "avg(factor) OVER w")
rolling("w23_rolling_std", lambda w: roll.std("factor", w), _SD)
rolling("w24_rolling_winsorize_std", lambda w: roll.winsorize_std("factor", w, 1.5), f"CASE WHEN {_SD} > 0 THEN greatest(least(factor, avg(factor) OVER w + 1.5 * ({_SD})), avg(factor) OVER w - 1.5 * ({_SD})) ELSE factor END")
rolling("w25_rolling_winsorize_mad", lambda w: roll.winsorize_mad("factor", w, 1.0), f"CASE WHEN {_SD} > 0 THEN greatest(least(factor, quantile_cont(factor, 0.5) OVER w + 1.4826 * ({_SD})), quantile_cont(factor, 0.5) OVER w - 1.4826 * ({_SD})) ELSE factor END")
rolling("w26_rolling_winsorize_quantile", lambda w: roll.winsorize_quantile("factor", w, 0.1), "greatest(least(factor, list_sort(list(factor) OVER w)[CAST(floor(0.9 * (count(*) OVER w - 1) + 0.5) AS INT) + 1]), list_sort(list(factor) OVER w)[CAST(floor(0.1 * (count(*) OVER w - 1) + 0.5) AS INT) + 1])")
rolling("w27_rolling_zscore", lambda w: roll.zscore("factor", w), f"CASE WHEN coalesce({_SD}, 0) > 0 THEN (factor - avg(factor) OVER w) / ({_SD}) ELSE 0 END")
rolling("w28_rolling_tanh_rank", lambda w: roll.tanh_rank("factor", w, 12), f"CASE WHEN count(factor) OVER w = 12 AND {_SD} > 0 THEN tanh((factor - avg(factor) OVER w) / ({_SD})) ELSE 0 END")
rolling("w29_rolling_demean", lambda w: roll.demean("factor", w, 12), "CASE WHEN count(factor) OVER w = 12 THEN factor - avg(factor) OVER w END")
rolling("w30_rolling_minmax", lambda w: roll.minmax("factor", w), "CASE WHEN max(factor) OVER w > min(factor) OVER w THEN (factor - min(factor) OVER w) / (max(factor) OVER w - min(factor) OVER w) * 2 - 1 ELSE 0 END")


@query("w33_ema_deviation", f"WITH RECURSIVE {fx.PANEL_SQL}, n AS (SELECT sym, dt, close, row_number() OVER (PARTITION BY sym ORDER BY dt) AS i FROM panel), e AS (SELECT sym, dt, close, i, close AS ema FROM n WHERE i = 1 UNION ALL SELECT n.sym, n.dt, n.close, n.i, 0.5 * n.close + 0.5 * e.ema FROM e JOIN n ON n.sym = e.sym AND n.i = e.i + 1) SELECT dt, sym, {rs('ema', 'ema')}, {rs('close / ema - 1', 'deviation')} FROM e")
def w33(spark: SparkSession, d: str) -> DataFrame:
    got = roll.ema(fx.panel(spark, d), "close", ["sym"], "dt", 3)
    return got.select("dt", "sym", r("ema", "ema"), r(F.try_divide("close", "ema") - 1, "deviation"))


# statistics

_CORR = "CASE WHEN count(*) > 1 AND stddev_pop({x}) > 1e-14 AND stddev_pop({y}) > 1e-14 THEN covar_pop({x}, {y}) / (stddev_pop({x}) * stddev_pop({y})) END"
IC_SQL = f"ics AS (SELECT dt, {_CORR.format(x='factor', y='label')} AS ic FROM ok GROUP BY dt)"
RANK_IC_SQL = (
    "rk AS (SELECT dt, CASE WHEN factor IS NOT NULL THEN rank() OVER (PARTITION BY dt, factor IS NULL ORDER BY factor) + (count(*) OVER (PARTITION BY dt, factor) - 1) / 2.0 END AS x, "
    "CASE WHEN label IS NOT NULL THEN rank() OVER (PARTITION BY dt, label IS NULL ORDER BY label) + (count(*) OVER (PARTITION BY dt, label) - 1) / 2.0 END AS y FROM fl), "
    f"rics AS (SELECT dt, {_CORR.format(x='x', y='y')} AS rank_ic FROM rk WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY dt)"
)


@query("a20_pearson_ic", f"WITH {fx.FL_SQL}, {IC_SQL} SELECT dt, {rs('ic', 'ic')} FROM ics")
def a20(spark: SparkSession, d: str) -> DataFrame:
    return stats.ic(fx.ok(spark, d), "factor", "label", BY).select("dt", r("ic", "ic"))


@query("a21_spearman_ic", f"WITH {fx.FL_SQL}, {RANK_IC_SQL} SELECT dt, {rs('rank_ic', 'rank_ic')} FROM rics WHERE rank_ic IS NOT NULL")
def a21(spark: SparkSession, d: str) -> DataFrame:
    return stats.rank_ic(fx.fl(spark, d), "factor", "label", BY).where("rank_ic IS NOT NULL").select("dt", r("rank_ic", "rank_ic"))


@query("a22_layer_spearman_ic", f"WITH {fx.FL_SQL}, l AS (SELECT dt, factor, label, {_LAYER} AS layer FROM ok), rk AS (SELECT dt, layer, rank() OVER (PARTITION BY dt, layer ORDER BY factor) + (count(*) OVER (PARTITION BY dt, layer, factor) - 1) / 2.0 AS x, rank() OVER (PARTITION BY dt, layer ORDER BY label) + (count(*) OVER (PARTITION BY dt, layer, label) - 1) / 2.0 AS y FROM l) SELECT dt, layer, {rs(_CORR.format(x='x', y='y'), 'rank_ic')} FROM rk GROUP BY 1, 2")
def a22(spark: SparkSession, d: str) -> DataFrame:
    rows = fx.ok(spark, d).withColumn("layer", xs.layer("factor", 5, BY, "sym"))
    return stats.rank_ic(rows, "factor", "label", ["dt", "layer"]).select("dt", "layer", r("rank_ic", "rank_ic"))


@query("a23_rowwise_correlation", f"WITH {fx.FL_SQL} SELECT sym, {rs(_CORR.format(x='factor', y='label'), 'corr')} FROM ok GROUP BY sym")
def a23(spark: SparkSession, d: str) -> DataFrame:
    return stats.ic(fx.ok(spark, d), "factor", "label", ["sym"], "corr").select("sym", r("corr", "corr"))


_PHI = "(CASE WHEN abs(z) >= 0 THEN 1.0 - exp(-z * z / 2) * 0.3989422804014327 * (t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))) END)"


@query("a24_ic_summary", f"WITH {fx.FL_SQL}, {IC_SQL}, g AS (SELECT avg(ic) AS mean, stddev_samp(ic) AS sd, count(ic) AS n, count(*) FILTER (WHERE ic > 0) / CAST(count(ic) AS DOUBLE) AS winratio FROM ics), z AS (SELECT *, CASE WHEN sd > 0 THEN mean / (sd / sqrt(n)) ELSE 0 END AS z FROM g), t AS (SELECT *, 1.0 / (1.0 + 0.2316419 * abs(z)) AS t FROM z) SELECT {rs('mean', 'mean')}, {rs('sd', 'sd')}, n, {rs('winratio', 'winratio')}, {rs('z', 'z')}, {rs('2.0 * (1.0 - ' + _PHI + ')', 'p_value')}, {rs('CASE WHEN sd > 0 THEN abs(mean) / sd ELSE 0 END', 'icir')}, {rs('CASE WHEN sd > 0 THEN abs(mean) / sd ELSE 0 END * sqrt(12)', 'icir_annual')} FROM t")
def a24(spark: SparkSession, d: str) -> DataFrame:
    got = stats.ic_summary(stats.ic(fx.ok(spark, d), "factor", "label", BY), "ic", 12)
    return got.select(r("mean", "mean"), r("sd", "sd"), "n", r("winratio", "winratio"), r("z", "z"), r("p_value", "p_value"), r("icir", "icir"), r("icir_annual", "icir_annual"))


@query("a25_signed_rank_ic_summary", f"WITH {fx.FL_SQL}, {RANK_IC_SQL}, g AS (SELECT avg(rank_ic) AS mean, stddev_samp(rank_ic) AS sd, count(rank_ic) AS n, count(*) FILTER (WHERE rank_ic > 0) / CAST(count(rank_ic) AS DOUBLE) AS hit FROM rics) SELECT {rs('mean', 'mean')}, {rs('sd', 'sd')}, n, {rs('hit', 'hit_rate')}, {rs('mean / nullif(sd, 0) * sqrt(12)', 'icir_annual')}, {rs('mean / nullif(sd / sqrt(n), 0)', 't_stat')} FROM g")
def a25(spark: SparkSession, d: str) -> DataFrame:
    got = stats.signed_summary(stats.rank_ic(fx.fl(spark, d), "factor", "label", BY), "rank_ic", 12)
    return got.select(r("mean", "mean"), r("sd", "sd"), "n", r("hit_rate", "hit_rate"), r("icir_annual", "icir_annual"), r("t_stat", "t_stat"))


@query("a26_v5_daily_mean", f"SELECT CAST(ts AS DATE) AS day, {rs('avg(value)', 'mean')} FROM events GROUP BY 1")
def a26(spark: SparkSession, d: str) -> DataFrame:
    return fx.table(spark, d, "events").groupBy(F.to_date("ts").alias("day")).agg(r(F.avg("value"), "mean"))


@query("a27_grouped_sums", f"WITH {fx.FL_SQL} SELECT dt, {rs('sum(close / 1000000)', 's1')}, {rs('sum(factor)', 's2')}, {rs('sum(label)', 's3')}, {rs('sum(weight)', 's4')} FROM ok GROUP BY dt")
def a27(spark: SparkSession, d: str) -> DataFrame:
    return fx.ok(spark, d).groupBy("dt").agg(*[r(F.sum(c), f"s{k}") for k, c in enumerate((F.col("close") / 1000000, "factor", "label", "weight"), 1)])


@query("a30_nan_stats", f"WITH {fx.FL_SQL} SELECT sym, {rs('coalesce(sum(factor), 0)', 'nansum')}, {rs('coalesce(avg(factor), 0)', 'nanmean')}, {rs('coalesce(stddev_pop(factor), 0)', 'nanstd')} FROM fl GROUP BY sym")
def a30(spark: SparkSession, d: str) -> DataFrame:
    got = fx.fl(spark, d).groupBy("sym").agg(*stats.nan_stats("factor"))
    return got.select("sym", r("nansum", "nansum"), r("nanmean", "nanmean"), r("nanstd", "nanstd"))


_DD = "dd AS (SELECT sym, min((cum - top) / nullif(top + 1, 0)) AS dd FROM (SELECT sym, cum, max(cum) OVER (PARTITION BY sym ORDER BY dt ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS top FROM (SELECT sym, dt, sum(label) OVER (PARTITION BY sym ORDER BY dt ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum FROM ok)) GROUP BY sym), m AS (SELECT sym, greatest(least(dd, 0), -1) AS ret_max_dd FROM dd)"


@query("a34_max_drawdown", f"WITH {fx.FL_SQL}, {_DD} SELECT sym, {rs('ret_max_dd', 'max_dd')} FROM m")
def a34(spark: SparkSession, d: str) -> DataFrame:
    return stats.drawdown(fx.ok(spark, d), "label", ["sym"], "dt").select("sym", r("max_dd", "max_dd"))


@query("a31_a33_a35_return_metrics", f"WITH {fx.FL_SQL}, {_DD}, g AS (SELECT sym, sum(label) / 6.5 AS ra, avg(label) AS mu, stddev_pop(label) AS sd, stddev_pop(CASE WHEN label < 0 THEN label END) AS dn FROM ok GROUP BY sym) SELECT sym, {rs('ra', 'ret_annual')}, {rs('CASE WHEN sd > 0 THEN mu / sd * sqrt(12.0) ELSE 0 END', 'ret_sharpe')}, {rs('CASE WHEN coalesce(dn, 0) > 0 THEN mu / dn * sqrt(12.0) ELSE 0 END', 'ret_sortino')}, {rs('ret_max_dd', 'ret_max_dd')}, {rs('CASE WHEN ret_max_dd <> 0 THEN ra / abs(ret_max_dd) ELSE 0 END', 'ret_calmar')} FROM g JOIN m USING (sym)")
def a31(spark: SparkSession, d: str) -> DataFrame:
    got = stats.return_metrics(fx.ok(spark, d), "label", ["sym"], "dt", 6.5, 12.0)
    return got.select("sym", *[r(c, c) for c in ("ret_annual", "ret_sharpe", "ret_sortino", "ret_max_dd", "ret_calmar")])


@query("a37_time_metrics", f"WITH {fx.PANEL_SQL}, g AS (SELECT count(DISTINCT dt) AS n, greatest(date_diff('day', min(dt), max(dt)) / 365.25, 1 / 365.25) AS y FROM panel) SELECT n AS num_dates, {rs('y', 'num_years')}, {rs('n / y', 'dates_to_years')} FROM g")
def a37(spark: SparkSession, d: str) -> DataFrame:
    return stats.time_metrics(fx.panel(spark, d), "dt").select("num_dates", r("num_years", "num_years"), r("dates_to_years", "dates_to_years"))


@query("a38_histogram", f"WITH {fx.FL_SQL}, b AS (SELECT min(label) AS lo, max(label) AS hi FROM ok) SELECT CAST(least(floor((label - lo) / (hi - lo) * 50), 49) AS BIGINT) AS bin, count(*) AS n FROM ok, b GROUP BY 1")
def a38(spark: SparkSession, d: str) -> DataFrame:
    rows = fx.ok(spark, d)
    ends = rows.agg(F.min("label").alias("lo"), F.max("label").alias("hi"))
    return rows.crossJoin(F.broadcast(ends)).groupBy(F.least(F.floor((F.col("label") - F.col("lo")) / (F.col("hi") - F.col("lo")) * 50), F.lit(49)).alias("bin")).agg(F.count("*").alias("n"))  # one row


@query("a38_moments", f"WITH {fx.FL_SQL}, c AS (SELECT label - avg(label) OVER () AS x FROM ok), m AS (SELECT avg(x * x) AS m2, avg(x * x * x) AS m3, avg(x * x * x * x) AS m4 FROM c) SELECT {rs('m3 / (m2 * sqrt(m2))', 'skew')}, {rs('m4 / (m2 * m2) - 3', 'kurtosis')} FROM m")
def a38b(spark: SparkSession, d: str) -> DataFrame:
    return fx.ok(spark, d).agg(r(F.skewness("label"), "skew"), r(F.kurtosis("label"), "kurtosis"))


@query("a39_cumulative_ic_intervals", f"WITH {fx.FL_SQL}, {IC_SQL}, c AS (SELECT dt, sum(ic) OVER (ORDER BY dt) AS cum, row_number() OVER (ORDER BY dt) - 1 AS i, count(*) OVER () AS n FROM ics), k AS (SELECT dt, i, cum, greatest(1, n // 15) AS step FROM c) SELECT dt, {rs('(cum - coalesce(lag(cum) OVER (ORDER BY i), 0)) / step', 'mean_ic')} FROM k WHERE i % step = step - 1")
def a39(spark: SparkSession, d: str) -> DataFrame:
    """Mean IC of each of about 15 intervals; the table has one row a date."""
    w = Window.orderBy("dt")
    c = stats.ic(fx.ok(spark, d), "factor", "label", BY).withColumns({"cum": F.sum("ic").over(w), "i": F.row_number().over(w) - 1, "n": F.count(F.lit(1)).over(Window.partitionBy(F.lit(1)))})
    c = c.withColumn("step", F.greatest(F.lit(1), F.floor(F.col("n") / 15))).where("i % step = step - 1")
    return c.select("dt", r((F.col("cum") - F.coalesce(F.lag("cum").over(Window.orderBy("i")), F.lit(0.0))) / F.col("step"), "mean_ic"))


@query("a45_ols_residual_mild", f"WITH {fx.FL_SQL}, n AS (SELECT *, count(*) OVER (PARTITION BY dt) AS n FROM ok), w AS (SELECT dt, sym, greatest(least(factor, quantile_cont(factor, 0.99) OVER d), quantile_cont(factor, 0.01) OVER d) AS y, greatest(least(close, quantile_cont(close, 0.99) OVER d), quantile_cont(close, 0.01) OVER d) AS x FROM n WHERE n >= 10 WINDOW d AS (PARTITION BY dt)), z AS (SELECT dt, sym, CASE WHEN stddev_pop(y) OVER d > 1e-12 THEN (y - avg(y) OVER d) / stddev_pop(y) OVER d ELSE 0 END AS y, CASE WHEN stddev_pop(x) OVER d > 1e-12 THEN (x - avg(x) OVER d) / stddev_pop(x) OVER d ELSE 0 END AS x FROM w WINDOW d AS (PARTITION BY dt)) SELECT dt, sym, {rs('y - avg(y) OVER d - CASE WHEN var_pop(x) OVER d > 1e-24 THEN covar_pop(x, y) OVER d / var_pop(x) OVER d ELSE 0 END * (x - avg(x) OVER d)', 'residual')} FROM z WINDOW d AS (PARTITION BY dt)")
def a45(spark: SparkSession, d: str) -> DataFrame:
    from factorspark.operators.neutralize import mild

    return mild(fx.ok(spark, d), "factor", "close").select("dt", "sym", r("residual", "residual"))


def _less(y: str, x: str) -> str:
    return f"{y} - avg({y}) OVER d - CASE WHEN var_pop({x}) OVER d > 1e-24 THEN covar_pop({x}, {y}) OVER d / var_pop({x}) OVER d ELSE 0 END * ({x} - avg({x}) OVER d) AS {y}"


_STYLES = ("factor", "size", "own", "weight")
A46_SQL = (
    f"WITH {fx.FL_SQL}, s0 AS (SELECT dt, sym, factor, ln(close) AS size, close / nullif(lag(close, 2) OVER (PARTITION BY sym ORDER BY dt), 0) - 1 AS own, weight FROM ok), s1 AS (SELECT *, count(*) OVER (PARTITION BY dt) AS n FROM s0 WHERE size IS NOT NULL AND own IS NOT NULL AND weight IS NOT NULL), "
    f"s2 AS (SELECT dt, sym, {', '.join(f'greatest(least({c}, quantile_cont({c}, 0.99) OVER d), quantile_cont({c}, 0.01) OVER d) AS {c}' for c in _STYLES)} FROM s1 WHERE n >= 10 WINDOW d AS (PARTITION BY dt)), "
    f"s3 AS (SELECT dt, sym, {', '.join(f'CASE WHEN stddev_pop({c}) OVER d > 1e-12 THEN ({c} - avg({c}) OVER d) / stddev_pop({c}) OVER d ELSE 0 END AS {c}' for c in _STYLES)} FROM s2 WINDOW d AS (PARTITION BY dt)), "
    f"s4 AS (SELECT dt, sym, factor AS y, size, {_less('factor', 'size')}, {_less('own', 'size')}, {_less('weight', 'size')} FROM s3 WINDOW d AS (PARTITION BY dt)), "
    f"s5 AS (SELECT dt, sym, y, own, {_less('factor', 'own')}, {_less('weight', 'own')} FROM s4 WINDOW d AS (PARTITION BY dt)), "
    f"s6 AS (SELECT dt, sym, y, {_less('factor', 'weight')} FROM s5 WINDOW d AS (PARTITION BY dt)) "
    f"SELECT dt, sym, {rs('factor', 'residual')}, {rs('CASE WHEN sum((y - my) * (y - my)) OVER d > 1e-20 THEN 1 - sum(factor * factor) OVER d / sum((y - my) * (y - my)) OVER d ELSE 0 END', 'r2')} FROM (SELECT *, avg(y) OVER (PARTITION BY dt) AS my FROM s6) WINDOW d AS (PARTITION BY dt)"
)


@query("a46_ols_residual_styles", A46_SQL)
def a46(spark: SparkSession, d: str) -> DataFrame:
    from factorspark.operators.neutralize import styles

    rows = fx.ok(spark, d).withColumns({"size": F.log("close"), "own": ret.lookback_return(2)})
    return styles(rows, "factor", ["size", "own", "weight"]).select("dt", "sym", r("residual", "residual"), r("r2", "r2"))


@query("a47_ols_sector_dummies", f"WITH {fx.FL_SQL}, m AS (SELECT dt, sym, factor - avg(factor) OVER s AS y, ln(close) - avg(ln(close)) OVER s AS x FROM ok WINDOW s AS (PARTITION BY dt, sector)) SELECT dt, sym, {rs('y - coalesce(sum(x * y) OVER d / nullif(sum(x * x) OVER d, 0), 0) * x', 'residual')} FROM m WINDOW d AS (PARTITION BY dt)")
def a47(spark: SparkSession, d: str) -> DataFrame:
    from factorspark.operators.neutralize import sector_and_size

    return sector_and_size(fx.ok(spark, d).withColumn("lnclose", F.log("close")), "factor", "lnclose").select("dt", "sym", r("residual", "residual"))


@query("a51_icir_gate", f"WITH {fx.FL_SQL}, {IC_SQL} SELECT CASE WHEN abs(avg(ic)) / nullif(stddev_samp(ic), 0) * sqrt(12) > 0.5 THEN 'PASS' ELSE 'FAIL' END AS gate FROM ics")
def a51(spark: SparkSession, d: str) -> DataFrame:
    got = stats.ic_summary(stats.ic(fx.ok(spark, d), "factor", "label", BY), "ic", 12)
    return got.select(F.when(F.col("icir_annual") > 0.5, "PASS").otherwise("FAIL").alias("gate"))
