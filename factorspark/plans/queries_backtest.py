"""Cross-sectional and time-series backtest queries, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factorspark.operators import stats
from factorspark.plans import cross_section as cs
from factorspark.plans import time_series as ts
from factorspark.plans.queries_cross import _CORR, _LAYER, r, rs
from factorspark.plans.registry import query
from factorspark.sources import fixtures as fx

C = cs.Config(annual_days=12, lag=1)
_P = "PARTITION BY sym ORDER BY dt"
BASE_SQL = (
    fx.FL_SQL
    + f""", b1 AS (SELECT dt, sym, label, weight, lag(factor, 1) OVER ({_P}) AS factor, coalesce(product(1 + label) OVER ({_P} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1) AS ref FROM fl WHERE label > -1),
b2 AS (SELECT *, {_LAYER} AS layer FROM b1),
b3 AS (SELECT *, CASE WHEN layer = 1 THEN 1.0 WHEN layer = 5 THEN -1.0 ELSE 0.0 END AS raw FROM b2),
b4 AS (SELECT *, CASE WHEN factor IS NOT NULL THEN raw - avg(CASE WHEN factor IS NOT NULL THEN raw END) OVER d END AS dm FROM b3 WINDOW d AS (PARTITION BY dt)),
b5 AS (SELECT *, CASE WHEN factor IS NOT NULL AND sum(abs(dm)) OVER d > 1e-15 THEN dm / sum(abs(dm)) OVER d ELSE 0 END AS pos_ls FROM b4 WINDOW d AS (PARTITION BY dt)),
b6 AS (SELECT *, CASE WHEN sum(greatest(pos_ls, 0)) OVER d > 0 THEN greatest(pos_ls, 0) / sum(greatest(pos_ls, 0)) OVER d ELSE 0 END AS pos_long, CASE WHEN sum(least(pos_ls, 0)) OVER d < 0 THEN least(pos_ls, 0) / -(sum(least(pos_ls, 0)) OVER d) ELSE 0 END AS pos_short, 1.0 / count(*) OVER d AS pos_passive FROM b5 WINDOW d AS (PARTITION BY dt)),
b7 AS (SELECT *, {', '.join(f"coalesce(lag(pos_{s}) OVER s, 0) AS prev_{s}, coalesce(lag(pos_{s} / ref) OVER s, 0) * ref AS old_{s}" for s in ('ls', 'long', 'short', 'passive'))} FROM b6 WINDOW s AS ({_P})),
fees AS (SELECT * FROM (VALUES (0.0, '0.0 bp'), (0.0002, '2.0 bp'), (0.0005, '5.0 bp')) AS t(fee, cost)),
obs AS (SELECT dt, sym, side, b, t, p FROM (SELECT dt, sym, unnest(['ls', 'long', 'short', 'passive', 'short_passive']) AS side, unnest([old_ls - prev_ls, old_long - prev_long, old_short - prev_short, old_passive - prev_passive, prev_passive - old_passive]) AS b, unnest([abs(pos_ls - old_ls), abs(pos_long - old_long), abs(pos_short - old_short), abs(pos_passive - old_passive), abs(pos_passive - old_passive)]) AS t, unnest([pos_ls, pos_long, pos_short, pos_passive, pos_passive]) AS p FROM b7)),
pl AS (SELECT cost, dt, side, sum(b) - fee * sum(t) AS pnl FROM obs, fees GROUP BY cost, fee, dt, side)"""
)


def base(spark: SparkSession, d: str) -> DataFrame:
    return fx.fl(spark, d).select("dt", "sym", "factor", "label", "weight")


@query("v1_p1_prepare_panel", f"WITH {BASE_SQL} SELECT dt, sym, {rs('factor', 'factor')}, {rs('label', 'label')}, {rs('ref', 'ref')} FROM b1")
def v1(spark: SparkSession, d: str) -> DataFrame:
    return cs.prepare(base(spark, d), 1).select("dt", "sym", r("factor", "factor"), r("label", "label"), r("ref", "ref"))


@query("w10_positions", f"WITH {BASE_SQL} SELECT dt, sym, layer, {rs('pos_ls', 'pos_ls')}, {rs('pos_long', 'pos_long')}, {rs('pos_short', 'pos_short')}, {rs('pos_passive', 'pos_passive')} FROM b6")
def w10(spark: SparkSession, d: str) -> DataFrame:
    got = cs.positions(cs.raw_signal(cs.prepare(base(spark, d), 1), C))
    return got.select("dt", "sym", "layer", *[r(f"pos_{s}", f"pos_{s}") for s in cs.HELD])


@query("w11_transaction_pnl", f"WITH {BASE_SQL} SELECT dt, sym, {rs('old_ls - prev_ls - abs(pos_ls - old_ls) * 0.0005', 'tpnl_ls')}, {rs('old_long - prev_long - abs(pos_long - old_long) * 0.0005', 'tpnl_long')} FROM b7")
def w11(spark: SparkSession, d: str) -> DataFrame:
    t = cs.prepared(base(spark, d), C)
    return t.select("dt", "sym", *[r(F.col(f"base_{s}") - F.col(f"trade_{s}") * 0.0005, f"tpnl_{s}") for s in ("ls", "long")])


@query("a41_multi_fee_pnl", f"WITH {BASE_SQL} SELECT cost, dt, side, {rs('pnl', 'pnl')} FROM pl")
def a41(spark: SparkSession, d: str) -> DataFrame:
    return cs.pnl(cs.prepared(base(spark, d), C), C.fees).select("cost", "dt", "side", r("pnl", "pnl"))


@query("a36_win_rate", f"WITH {BASE_SQL} SELECT cost, side, {rs('count(*) FILTER (WHERE b - fee * t > 1e-12) / CAST(count(*) AS DOUBLE)', 'win_rate')} FROM obs, fees WHERE p <> 0 GROUP BY cost, fee, side")
def a36(spark: SparkSession, d: str) -> DataFrame:
    return cs.win_rates(cs.prepared(base(spark, d), C), C.fees).select("cost", "side", r("win_rate", "win_rate"))


@query("w14_a40_position_turnover", f"WITH {BASE_SQL} SELECT dt, {rs('sum(abs(pos_ls - prev_ls))', 'ls')}, {rs('sum(abs(pos_long - prev_long))', 'long')}, {rs('sum(abs(pos_short - prev_short))', 'short')}, {rs('sum(abs(pos_passive - prev_passive))', 'passive')} FROM b7 GROUP BY dt")
def w14b(spark: SparkSession, d: str) -> DataFrame:
    return cs.turnover(cs.prepared(base(spark, d), C)).select("dt", *[r(s, s) for s in cs.HELD])


_LR = f"l1 AS (SELECT *, CASE WHEN layer > 0 THEN CASE WHEN sum(CASE WHEN weight > 0 THEN weight ELSE 0 END) OVER g > 0 THEN CASE WHEN weight > 0 THEN weight ELSE 0 END / sum(CASE WHEN weight > 0 THEN weight ELSE 0 END) OVER g ELSE 1.0 / count(*) OVER g END ELSE 0 END AS lp FROM b2 WINDOW g AS (PARTITION BY dt, layer)), l2 AS (SELECT dt, lag(layer) OVER s AS pl, lag(lp / ref) OVER s * ref - lag(lp) OVER s AS b FROM l1 WINDOW s AS ({_P}))"


@query("w12_w13_a29_weighted_layer_returns", f"WITH {BASE_SQL}, {_LR} SELECT dt, pl AS layer, {rs('sum(b)', 'ret')} FROM l2 WHERE pl > 0 GROUP BY 1, 2")
def w12(spark: SparkSession, d: str) -> DataFrame:
    rows = cs.raw_signal(cs.prepare(base(spark, d), 1), C)
    return cs.layer_returns(rows, "weight").select("dt", "layer", r("ret", "ret"))


_TM = "tm AS (SELECT greatest(date_diff('day', min(dt), max(dt)) / 365.25, 1 / 365.25) AS years FROM b1)"


@query("a40_layer_annual_return", f"WITH {BASE_SQL}, {_LR}, {_TM} SELECT pl AS layer, {rs('sum(b) / max(years)', 'ret_annual')} FROM l2, tm WHERE pl > 0 GROUP BY 1")
def a40(spark: SparkSession, d: str) -> DataFrame:
    rows = cs.raw_signal(cs.prepare(base(spark, d), 1), C)
    years = stats.time_metrics(rows, "dt").select("num_years")
    got = cs.layer_returns(rows, "weight").groupBy("layer").agg(F.sum("ret").alias("s")).crossJoin(F.broadcast(years))  # one row
    return got.select("layer", r(F.col("s") / F.col("num_years"), "ret_annual"))


@query("a40_layer_mean_rank_ic", f"WITH {BASE_SQL}, k AS (SELECT dt, layer, rank() OVER (PARTITION BY dt, layer ORDER BY factor) + (count(*) OVER (PARTITION BY dt, layer, factor) - 1) / 2.0 AS x, rank() OVER (PARTITION BY dt, layer ORDER BY label) + (count(*) OVER (PARTITION BY dt, layer, label) - 1) / 2.0 AS y FROM b2 WHERE layer > 0), c AS (SELECT dt, layer, {_CORR.format(x='x', y='y')} AS ic FROM k GROUP BY 1, 2) SELECT layer, {rs('avg(ic)', 'rank_ic')} FROM c GROUP BY 1")
def a40b(spark: SparkSession, d: str) -> DataFrame:
    rows = cs.raw_signal(cs.prepare(base(spark, d), 1), C)
    return cs.layer_rank_ic(rows).groupBy("layer").agg(r(F.avg("rank_ic"), "rank_ic"))


_ACF = f"ai AS (SELECT sym, factor, dense_rank() OVER (ORDER BY dt) AS i FROM b1), lg AS (SELECT unnest([{', '.join(map(str, cs.LAGS))}]) AS lag), ap AS (SELECT lag, a.i AS i, {_CORR.format(x='a.factor', y='b.factor').replace('count(*)', 'count(*)')} AS c FROM lg, ai a JOIN ai b ON b.sym = a.sym AND b.i = a.i + lag WHERE a.factor IS NOT NULL AND b.factor IS NOT NULL GROUP BY 1, 2), acf AS (SELECT lag, avg(c) AS acf FROM ap GROUP BY 1)"


@query("w36_factor_acf", f"WITH {BASE_SQL}, {_ACF} SELECT lag, {rs('acf', 'acf')} FROM acf WHERE acf IS NOT NULL")
def w36(spark: SparkSession, d: str) -> DataFrame:
    return cs.factor_acf(cs.prepare(base(spark, d), 1)).where("acf IS NOT NULL").select("lag", r("acf", "acf"))


@query("w36_acf_half_life", f"WITH {BASE_SQL}, {_ACF} SELECT {rs('max(CASE WHEN lag = 1 THEN acf END)', 'acf_1')}, coalesce(min(CASE WHEN acf < 0.5 THEN lag END), 200) AS acf_halflife FROM acf")
def w36b(spark: SparkSession, d: str) -> DataFrame:
    return cs.half_life(cs.factor_acf(cs.prepare(base(spark, d), 1))).select(r("acf_1", "acf_1"), "acf_halflife")


_SUMMARY = (
    _TM
    + """, cum AS (SELECT cost, side, dt, pnl, sum(pnl) OVER (PARTITION BY cost, side ORDER BY dt) AS cum FROM pl), top AS (SELECT *, max(cum) OVER (PARTITION BY cost, side ORDER BY dt) AS top FROM cum),
m AS (SELECT cost, side, sum(pnl) / max(years) AS ra, avg(pnl) AS mu, stddev_pop(pnl) AS sd, stddev_pop(CASE WHEN pnl < 0 THEN pnl END) AS dn, greatest(least(min((cum - top) / nullif(top + 1, 0)), 0), -1) AS dd FROM top, tm GROUP BY 1, 2),
tn AS (SELECT avg(ls) AS ls, avg(lo) AS lo, avg(sh) AS sh, avg(pa) AS pa FROM (SELECT dt, sum(abs(pos_ls - prev_ls)) AS ls, sum(abs(pos_long - prev_long)) AS lo, sum(abs(pos_short - prev_short)) AS sh, sum(abs(pos_passive - prev_passive)) AS pa FROM b7 GROUP BY dt)),
su AS (SELECT cost, side, ra, CASE WHEN sd > 0 THEN mu / sd * sqrt(12.0) ELSE 0 END AS sharpe, CASE WHEN coalesce(dn, 0) > 0 THEN mu / dn * sqrt(12.0) ELSE 0 END AS sortino, dd, CASE WHEN dd <> 0 THEN ra / abs(dd) ELSE 0 END AS calmar, CASE side WHEN 'ls' THEN ls WHEN 'long' THEN lo WHEN 'short' THEN sh ELSE pa END AS turn,
CASE side WHEN 'long' THEN ra - max(CASE WHEN side = 'passive' THEN ra END) OVER c WHEN 'short' THEN ra - max(CASE WHEN side = 'short_passive' THEN ra END) OVER c END AS excess FROM m, tn WINDOW c AS (PARTITION BY cost)),
wr AS (SELECT cost, side, count(*) FILTER (WHERE b - fee * t > 0) / CAST(count(*) AS DOUBLE) AS win FROM obs, fees WHERE p <> 0 GROUP BY cost, fee, side)"""
)
_SUMMARY_COLS = f"su.cost AS cost, su.side AS side, {rs('ra', 'ret_annual')}, {rs('sharpe', 'ret_sharpe')}, {rs('sortino', 'ret_sortino')}, {rs('dd', 'ret_max_dd')}, {rs('calmar', 'ret_calmar')}, {rs('turn', 'turnover_ratio')}, {rs('CASE WHEN turn > 0 THEN sharpe / turn ELSE 0 END', 'ret_sharpe_per_turnover')}, {rs('excess', 'excess_ret_annual')}"


@query("x1_cross_section_summary", f"WITH {BASE_SQL}, {_SUMMARY} SELECT {_SUMMARY_COLS} FROM su")
def x1(spark: SparkSession, d: str) -> DataFrame:
    got = cs.summary(base(spark, d), C)
    return got.select("cost", "side", *[r(c, c) for c in got.columns if c not in ("cost", "side", "win_rate")])


@query("p10_metric_issues", f"WITH {BASE_SQL}, {_SUMMARY}, t AS (SELECT cost, side, unnest(['ret_annual', 'ret_sharpe', 'ret_max_dd']) AS metric, unnest([ra, sharpe * 20, dd]) AS value, unnest([-5.0, -10.0, -1.0]) AS lo, unnest([5.0, 10.0, 0.0]) AS hi FROM su) SELECT cost, side, metric, {rs('value', 'value')}, CASE WHEN value IS NULL THEN 'missing' ELSE 'out_of_range' END AS issue FROM t WHERE value IS NULL OR value < lo OR value > hi")
def p10(spark: SparkSession, d: str) -> DataFrame:
    """Issues of a summary whose Sharpe ratios are inflated twentyfold, so that some are out of range."""
    got = cs.issues(cs.summary(base(spark, d), C).withColumn("ret_sharpe", F.col("ret_sharpe") * 20))
    return got.select("cost", "side", "metric", r("value", "value"), "issue")


@query("v6_v7_summary_by_cost", f"WITH {BASE_SQL}, {_SUMMARY} SELECT CASE side WHEN 'ls' THEN 'long_short' ELSE side END || '_ret_annual' AS metric, {rs('max(CASE WHEN cost = $$0.0 bp$$ THEN ra END)', 'cost_0')}, {rs('max(CASE WHEN cost = $$2.0 bp$$ THEN ra END)', 'cost_2')} FROM su GROUP BY side")
def v6(spark: SparkSession, d: str) -> DataFrame:
    got = cs.by_cost(cs.summary(base(spark, d), C)).where("metric LIKE '%_ret_annual' AND metric NOT LIKE '%excess%'")
    return got.select("metric", *[r(F.try_element_at("by_cost", F.lit(f"{k}.0 bp")), f"cost_{k}") for k in (0, 2)])


@query("k4_summary_json", f"WITH {BASE_SQL}, {_SUMMARY} SELECT cost, side, round(ra, 4) + 0.0 AS ra FROM su")
def k4(spark: SparkSession, d: str) -> DataFrame:
    """Summary rows through their JSON form and back."""
    text = cs.summary(base(spark, d), C).select(F.to_json(F.struct("cost", "side", (F.round("ret_annual", 4) + F.lit(0.0)).alias("ra"))).alias("j"))
    return text.select(F.from_json("j", "cost string, side string, ra double").alias("s")).select("s.*")


@query("p12_universe_size", f"WITH {fx.FL_SQL} SELECT min(n) AS least FROM (SELECT dt, count(DISTINCT sym) AS n FROM ok GROUP BY dt)")
def p12(spark: SparkSession, d: str) -> DataFrame:
    return fx.ok(spark, d).groupBy("dt").agg(F.countDistinct("sym").alias("n")).agg(F.min("n").alias("least"))


@query("x1_normalization_mode", f"WITH {BASE_SQL}, z AS (SELECT dt, sym, CASE WHEN coalesce(stddev_samp(factor) OVER d, 0) > 0 THEN greatest(least(factor, avg(factor) OVER d + 3 * stddev_samp(factor) OVER d), avg(factor) OVER d - 3 * stddev_samp(factor) OVER d) ELSE factor END AS w FROM b1 WINDOW d AS (PARTITION BY dt)), n AS (SELECT dt, sym, w, CASE WHEN w IS NOT NULL THEN CASE WHEN stddev_samp(w) OVER d > 0 THEN (w - avg(w) OVER d) / stddev_samp(w) OVER d ELSE 0 END ELSE 0 END AS raw FROM z WINDOW d AS (PARTITION BY dt)), e AS (SELECT dt, sym, CASE WHEN w IS NOT NULL THEN raw - avg(CASE WHEN w IS NOT NULL THEN raw END) OVER (PARTITION BY dt) END AS dm FROM n) SELECT dt, sym, {rs('CASE WHEN dm IS NOT NULL AND sum(abs(dm)) OVER (PARTITION BY dt) > 1e-15 THEN dm / sum(abs(dm)) OVER (PARTITION BY dt) ELSE 0 END', 'pos_ls')} FROM e")
def x1n(spark: SparkSession, d: str) -> DataFrame:
    c = cs.Config(mode="long/short_normalization", lag=1)
    return cs.positions(cs.raw_signal(cs.prepare(base(spark, d), 1), c)).select("dt", "sym", r("pos_ls", "pos_ls"))


# one series


def series(spark: SparkSession, d: str) -> DataFrame:
    return fx.series(spark, d).withColumn("key", F.lit("click"))


_THRESHOLD = "CASE WHEN factor <= 45 THEN -1.0 WHEN factor >= 55 THEN 1.0 ELSE 0.0 END"
_GRADUAL = "CASE WHEN factor > 52 AND factor < 60 THEN (factor - 52) / 8 WHEN factor > 40 AND factor < 48 THEN -1.0 + (factor - 40) / 8 WHEN factor >= 60 THEN 1.0 WHEN factor <= 40 THEN -1.0 ELSE 0.0 END"


@query("f7_ts_positions", f"WITH {fx.SERIES_SQL} SELECT t, {rs('factor', 'weights')}, {rs(_THRESHOLD, 'threshold')}, {rs(_GRADUAL, 'gradual')} FROM tsl")
def f7(spark: SparkSession, d: str) -> DataFrame:
    return series(spark, d).select("t", r(ts.weights("factor"), "weights"), r(ts.threshold("factor", 55, 45), "threshold"), r(ts.gradual("factor", 40, 48, 52, 60), "gradual"))


_RW = "WINDOW w AS (ORDER BY t ROWS BETWEEN 23 PRECEDING AND CURRENT ROW)"


@query("f7_ts_normalized_positions", f"WITH {fx.SERIES_SQL}, a AS (SELECT t, CASE WHEN stddev_samp(factor) OVER w > 0 THEN greatest(least(factor, avg(factor) OVER w + 3 * stddev_samp(factor) OVER w), avg(factor) OVER w - 3 * stddev_samp(factor) OVER w) ELSE factor END AS x FROM tsl {_RW}) SELECT t, {rs('tanh(CASE WHEN stddev_samp(x) OVER w > 0 THEN (x - avg(x) OVER w) / stddev_samp(x) OVER w ELSE 0 END)', 'pos')} FROM a {_RW}")
def f7n(spark: SparkSession, d: str) -> DataFrame:
    return ts.normalized(series(spark, d), "factor", ["key"], "t", 24).select("t", r("pos", "pos"))


_R126 = "WINDOW w AS (ORDER BY t ROWS BETWEEN 125 PRECEDING AND CURRENT ROW)"


@query("w31_rolling_ic", f"WITH {fx.SERIES_SQL}, c AS (SELECT t, row_number() OVER (ORDER BY t) AS i, CASE WHEN stddev_pop(factor) OVER w > 1e-14 AND stddev_pop(label) OVER w > 1e-14 THEN covar_pop(factor, label) OVER w / (stddev_pop(factor) OVER w * stddev_pop(label) OVER w) END AS ic FROM tsl {_R126}) SELECT t, CASE WHEN i >= 126 THEN round(ic, 6) + 0.0 END AS ic FROM c")
def w31(spark: SparkSession, d: str) -> DataFrame:
    return ts.rolling_ic(series(spark, d)).select("t", r("ic", "ic"))


@query("w32_rolling_rank_ic", f"WITH {fx.SERIES_SQL}, n AS (SELECT t, factor, label, row_number() OVER (ORDER BY t) AS i FROM tsl), k AS (SELECT e.t AS t, rank() OVER (PARTITION BY e.t ORDER BY v.factor) + (count(*) OVER (PARTITION BY e.t, v.factor) - 1) / 2.0 AS x, rank() OVER (PARTITION BY e.t ORDER BY v.label) + (count(*) OVER (PARTITION BY e.t, v.label) - 1) / 2.0 AS y FROM n e JOIN n v ON v.i BETWEEN e.i - 125 AND e.i WHERE e.i >= 126) SELECT t, {rs(_CORR.format(x='x', y='y'), 'rank_ic')} FROM k GROUP BY t")
def w32(spark: SparkSession, d: str) -> DataFrame:
    return ts.rolling_rank_ic(series(spark, d)).select("t", r("rank_ic", "rank_ic"))


@query("w37_series_acf", f"WITH {fx.SERIES_SQL}, n AS (SELECT factor, row_number() OVER (ORDER BY t) AS i FROM tsl), p AS (SELECT lag, a.factor AS x, b.factor AS y FROM (SELECT unnest([1, 2, 5, 10, 50]) AS lag), n a JOIN n b ON b.i = a.i + lag), k AS (SELECT lag, rank() OVER (PARTITION BY lag ORDER BY x) + (count(*) OVER (PARTITION BY lag, x) - 1) / 2.0 AS x, rank() OVER (PARTITION BY lag ORDER BY y) + (count(*) OVER (PARTITION BY lag, y) - 1) / 2.0 AS y FROM p) SELECT lag, {rs(_CORR.format(x='x', y='y'), 'acf')} FROM k GROUP BY lag")
def w37(spark: SparkSession, d: str) -> DataFrame:
    return ts.acf(series(spark, d), "factor", [1, 2, 5, 10, 50]).select("lag", r("acf", "acf"))


_TS = f"p0 AS (SELECT t, day, label, coalesce(product(1 + label) OVER (ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1) AS ref, lag(factor, 1) OVER (ORDER BY t) AS factor FROM tsl), p1 AS (SELECT *, coalesce({_THRESHOLD}, 0) AS pos FROM p0), p2 AS (SELECT t, day, label, ref, pos AS ls, greatest(pos, 0) AS lo, least(pos, 0) AS sh, 1.0 AS pa FROM p1), p3 AS (SELECT *, {', '.join(f'coalesce(lag({s}) OVER o, 0) AS prev_{s}, coalesce(lag({s} / ref) OVER o, 0) * ref AS old_{s}' for s in ('ls', 'lo', 'sh', 'pa'))}, lag(label) OVER o AS before FROM p2 WINDOW o AS (ORDER BY t)), p4 AS (SELECT t, day, {', '.join(f'old_{s} - prev_{s} - abs({s} - old_{s}) * 0.0002 AS t_{s}' for s in ('ls', 'lo', 'sh', 'pa'))}, coalesce(-before - abs(before) * 0.0002, -0.0002) AS t_sp FROM p3)"


def ts_table(spark: SparkSession, d: str) -> DataFrame:
    return ts.prepare(series(spark, d), 1).withColumn("pos", ts.threshold("factor", 55, 45))


@query("w11_ts_transaction_pnl", f"WITH {fx.SERIES_SQL}, {_TS} SELECT t, {rs('t_ls', 'ls')}, {rs('t_lo', 'long')}, {rs('t_sh', 'short')}, {rs('t_pa', 'passive')}, {rs('t_sp', 'short_passive')} FROM p4")
def w11t(spark: SparkSession, d: str) -> DataFrame:
    got = ts.trades(ts_table(spark, d), 0.0002)
    return got.select("t", *[r(f"tpnl_{s}", s) for s in cs.ALL_SIDES])


@query("x2_time_series_summary", f"WITH {fx.SERIES_SQL}, {_TS}, u AS (SELECT day, unnest(['ls', 'long', 'short', 'passive', 'short_passive']) AS side, unnest([t_ls, t_lo, t_sh, t_pa, t_sp]) AS pnl FROM p4), dy AS (SELECT side, day, sum(pnl) AS pnl FROM u GROUP BY 1, 2), y AS (SELECT greatest(date_diff('day', min(day), max(day)) / 365.25, 1 / 365.25) AS y FROM p4), c AS (SELECT *, sum(pnl) OVER (PARTITION BY side ORDER BY day) AS cum FROM dy), tp AS (SELECT *, max(cum) OVER (PARTITION BY side ORDER BY day) AS top FROM c), m AS (SELECT side, sum(pnl) / max(y) AS ra, avg(pnl) AS mu, stddev_pop(pnl) AS sd, stddev_pop(CASE WHEN pnl < 0 THEN pnl END) AS dn, greatest(least(min((cum - top) / nullif(top + 1, 0)), 0), -1) AS dd FROM tp, y GROUP BY side) SELECT side, {rs('ra', 'ret_annual')}, {rs('CASE WHEN sd > 0 THEN mu / sd * sqrt(252.0) ELSE 0 END', 'ret_sharpe')}, {rs('CASE WHEN coalesce(dn, 0) > 0 THEN mu / dn * sqrt(252.0) ELSE 0 END', 'ret_sortino')}, {rs('dd', 'ret_max_dd')}, {rs('CASE WHEN dd <> 0 THEN ra / abs(dd) ELSE 0 END', 'ret_calmar')} FROM m")
def x2(spark: SparkSession, d: str) -> DataFrame:
    got = ts.summary(ts_table(spark, d), 0.0002)
    return got.select("side", *[r(c, c) for c in ("ret_annual", "ret_sharpe", "ret_sortino", "ret_max_dd", "ret_calmar")])


@query("v21_cumulative_return_series", f"WITH {BASE_SQL} SELECT cost, side, dt, {rs('sum(pnl) OVER (PARTITION BY cost, side ORDER BY dt)', 'cumulative')} FROM pl")
def v21(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("cost", "side").orderBy("dt").rowsBetween(Window.unboundedPreceding, 0)
    return cs.pnl(cs.prepared(base(spark, d), C), C.fees).select("cost", "side", "dt", r(F.sum("pnl").over(w), "cumulative"))
