"""Queries of joins, filters, set operations and table layouts, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factorspark.functions.shipping import ship
from factorspark.operators import joins as jn
from factorspark.operators import returns as ret
from factorspark.operators import stats
from factorspark.plans.queries_cross import _CORR, r, rs, shares
from factorspark.plans.queries_cross import SHARES_SQL as _SHARES
from factorspark.plans.registry import query
from factorspark.sources import fixtures as fx


@query("s1_s7_panel_scan", f"WITH {fx.PANEL_SQL}, g AS (SELECT dt, sym FROM (SELECT DISTINCT dt FROM panel WHERE dt BETWEEN DATE '1996-01-01' AND DATE '1997-12-31'), (SELECT DISTINCT sym FROM panel WHERE sym <= 50 AND dt BETWEEN DATE '1996-01-01' AND DATE '1997-12-31')) SELECT g.dt AS dt, g.sym AS sym, {rs('close', 'close')} FROM g LEFT JOIN panel p ON p.dt = g.dt AND p.sym = g.sym")
def s1(spark: SparkSession, d: str) -> DataFrame:
    """Dates in a range, chosen symbols and fields, missing cells as nulls."""
    p = fx.panel(spark, d).where("dt BETWEEN DATE'1996-01-01' AND DATE'1997-12-31' AND sym <= 50").select("dt", "sym", "close")
    return ret.densify(p).select("dt", "sym", r("close", "close"))


@query("s3_select_rename_subset", f"WITH {fx.PANEL_SQL}, w AS (SELECT unnest([3, 1, 999999]) AS sym, unnest([0, 1, 2]) AS pos) SELECT w.pos AS pos, w.sym AS sym, coalesce(CAST(dt AS VARCHAR), '') AS day, {rs('close', 'px')} FROM w LEFT JOIN panel ON panel.sym = w.sym")
def s3(spark: SparkSession, d: str) -> DataFrame:
    """Requested symbols in their order; one that is missing gives a row of nulls."""
    wanted = spark.createDataFrame([(0, 3), (1, 1), (2, 999999)], "pos int, sym long")
    return wanted.join(fx.panel(spark, d), "sym", "left").select("pos", "sym", F.coalesce(F.col("dt").cast("string"), F.lit("")).alias("day"), r("close", "px"))


@query("s4_resolve_indices", "WITH w AS (SELECT unnest([5, 2, 5, 999999, 1]) AS sym, unnest([0, 1, 2, 3, 4]) AS pos), f AS (SELECT sym, min(pos) AS pos FROM w GROUP BY sym), k AS (SELECT s_suppkey AS sym, row_number() OVER (ORDER BY s_suppkey) - 1 AS idx FROM supplier) SELECT f.pos AS pos, f.sym AS sym, coalesce(idx, -1) AS idx FROM f LEFT JOIN k USING (sym)")
def s4(spark: SparkSession, d: str) -> DataFrame:
    wanted = spark.createDataFrame([(k, s) for k, s in enumerate((5, 2, 5, 999999, 1))], "pos int, sym long").groupBy("sym").agg(F.min("pos").alias("pos"))
    known = fx.table(spark, d, "supplier").select(F.col("s_suppkey").alias("sym"), (F.row_number().over(Window.orderBy("s_suppkey")) - 1).alias("idx"))
    return wanted.join(known, "sym", "left").select("pos", "sym", F.coalesce("idx", F.lit(-1)).alias("idx"))


@query("s5_u5_aligned_embeddings", f"WITH {fx.CATEGORIES_SQL} SELECT category, count(*) AS n, min(sym) AS lo, max(sym) AS hi FROM cats GROUP BY 1")
def s5(spark: SparkSession, d: str) -> DataFrame:
    return fx.categories(spark, d).groupBy("category").agg(F.count("*").alias("n"), F.min("sym").alias("lo"), F.max("sym").alias("hi"))


@query("p2_min_count_gate", f"WITH {fx.FL_SQL} SELECT dt, region, count(*) AS n FROM ok GROUP BY 1, 2 HAVING count(*) >= 10")
def p2(spark: SparkSession, d: str) -> DataFrame:
    return fx.ok(spark, d).groupBy("dt", "region").agg(F.count("*").alias("n")).where("n >= 10")


@query("p3_month_list_filter", f"WITH {fx.PANEL_SQL} SELECT dt, sym FROM panel WHERE dt IN (DATE '1995-03-01', DATE '1998-07-01')")
def p3(spark: SparkSession, d: str) -> DataFrame:
    months = spark.sql("SELECT explode(array(DATE'1995-03-01', DATE'1998-07-01')) AS dt")
    return fx.panel(spark, d).join(months, "dt", "left_semi").select("dt", "sym")


@query("p4_s6_region_sector_filter", f"WITH {fx.SYMBOLS_SQL} SELECT sym, sector FROM symbols WHERE region = 2 AND sector <> 0")
def p4(spark: SparkSession, d: str) -> DataFrame:
    return fx.symbols(spark, d).where("region = 2 AND sector <> 0").select("sym", "sector")


@query("p5_drop_nulls_after_lag", f"WITH {fx.FL_SQL} SELECT count(*) AS n FROM fl WHERE factor IS NOT NULL")
def p5(spark: SparkSession, d: str) -> DataFrame:
    return fx.fl(spark, d).na.drop(subset=["factor"]).agg(F.count("*").alias("n"))


@query("p6_cast_dates", "SELECT o_orderkey, coalesce(CAST(try_cast(CASE WHEN o_orderkey % 9 = 0 THEN 'n/a' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS DATE) AS VARCHAR), 'none') AS day FROM orders")
def p6(spark: SparkSession, d: str) -> DataFrame:
    text = F.when(F.col("o_orderkey") % 9 == 0, "n/a").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    return fx.table(spark, d, "orders").select("o_orderkey", F.coalesce(F.try_to_date(text, "yyyy-MM-dd").cast("string"), F.lit("none")).alias("day"))


@query("j1_factor_label_join", f"WITH {fx.FL_SQL}, l AS (SELECT dt, sym, label FROM fl WHERE label IS NOT NULL AND sym % 3 = 0) SELECT f.dt AS dt, f.sym AS sym, {rs('f.factor', 'factor')}, {rs('l.label', 'label')} FROM fl f JOIN l ON l.dt = f.dt AND l.sym = f.sym WHERE f.factor IS NOT NULL")
def j1(spark: SparkSession, d: str) -> DataFrame:
    rows = fx.fl(spark, d)
    labels = rows.where("label IS NOT NULL AND sym % 3 = 0").select("dt", "sym", "label")
    return rows.where("factor IS NOT NULL").select("dt", "sym", "factor").join(labels, ["dt", "sym"]).select("dt", "sym", r("factor", "factor"), r("label", "label"))


@query("j3_dimension_join", f"WITH {fx.PANEL_SQL}, {fx.SYMBOLS_SQL} SELECT sector, count(*) AS n FROM panel JOIN symbols USING (sym) WHERE sector <> 0 GROUP BY 1")
def j3(spark: SparkSession, d: str) -> DataFrame:
    known = fx.symbols(spark, d).where("sector <> 0").select("sym", "sector")
    return fx.panel(spark, d).join(known, "sym").groupBy("sector").agg(F.count("*").alias("n"))


@query("j4_j5_common_dates_symbols", f"WITH {fx.PANEL_SQL}, a AS (SELECT * FROM panel WHERE year(dt) <= 1997), b AS (SELECT * FROM panel WHERE year(dt) >= 1996 AND sym % 2 = 0) SELECT dt, sym FROM a WHERE dt IN (SELECT dt FROM b) AND sym IN (SELECT sym FROM b)")
def j4(spark: SparkSession, d: str) -> DataFrame:
    p = fx.panel(spark, d).select("dt", "sym")
    b = p.where("year(dt) >= 1996 AND sym % 2 = 0")
    return p.where("year(dt) <= 1997").join(b.select("dt").distinct(), "dt", "left_semi").join(b.select("sym").distinct(), "sym", "left_semi").select("dt", "sym")


@query("j6_star_join", f"WITH {fx.FL_SQL}, {_SHARES}, c AS (SELECT p.dt AS dt, p.sym AS sym, ln(p.close * s.shares) AS lncap FROM panel p ASOF JOIN shares s ON p.sym = s.sym AND p.dt >= s.dt), i AS (SELECT dt, sector, avg(factor) AS ind FROM ok GROUP BY 1, 2) SELECT ok.dt AS dt, ok.sym AS sym, {rs('factor', 'factor')}, {rs('lncap', 'lncap')}, {rs('ind', 'ind_mom')} FROM ok JOIN c ON c.dt = ok.dt AND c.sym = ok.sym JOIN i ON i.dt = ok.dt AND i.sector = ok.sector")
def j6(spark: SparkSession, d: str) -> DataFrame:
    rows = fx.ok(spark, d).select("dt", "sym", "sector", "factor")
    cap = jn.asof_backward(fx.panel(spark, d), shares(spark, d), "dt", "shares", ["sym"]).where("shares IS NOT NULL").select("dt", "sym", ret.log_size(F.col("close"), F.col("shares")).alias("lncap"))
    ind = rows.groupBy("dt", "sector").agg(F.avg("factor").alias("ind_mom"))
    return rows.join(cap, ["dt", "sym"]).join(ind, ["dt", "sector"]).select("dt", "sym", r("factor", "factor"), r("lncap", "lncap"), r("ind_mom", "ind_mom"))


@query("j7_asof_backward", "WITH m AS (SELECT last_day(CAST(unnest(generate_series(DATE '1995-01-01', DATE '1998-12-01', INTERVAL 1 MONTH)) AS DATE)) AS dt), o AS (SELECT CAST(o_orderdate AS DATE) AS dt, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY 1) SELECT m.dt AS dt, o.n AS n FROM m ASOF LEFT JOIN o ON m.dt >= o.dt")
def j7(spark: SparkSession, d: str) -> DataFrame:
    months = spark.sql("SELECT explode(transform(sequence(0, 47), i -> last_day(add_months(DATE'1995-01-01', i)))) AS dt")
    days = fx.table(spark, d, "orders").groupBy(F.to_date("o_orderdate").alias("dt")).agg(F.count("*").alias("n"))
    return jn.asof_backward(months, days, "dt", "n")


@query("j8_asof_per_key", f"WITH {fx.PANEL_SQL}, {_SHARES} SELECT p.dt AS dt, p.sym AS sym, s.shares AS shares FROM panel p ASOF LEFT JOIN shares s ON p.sym = s.sym AND p.dt >= s.dt")
def j8(spark: SparkSession, d: str) -> DataFrame:
    return jn.asof_backward(fx.panel(spark, d).select("dt", "sym"), shares(spark, d), "dt", "shares", ["sym"])


@query("j10_next_date_join", f"WITH {fx.PANEL_SQL}, c AS (SELECT dt, row_number() OVER (ORDER BY dt) AS i FROM (SELECT DISTINCT dt FROM panel)), k AS (SELECT panel.*, i FROM panel JOIN c USING (dt)) SELECT a.dt AS dt, a.sym AS sym, {rs('b.close / nullif(a.close, 0) - 1', 'label')} FROM k a JOIN k b ON b.sym = a.sym AND b.i = a.i + 1")
def j10(spark: SparkSession, d: str) -> DataFrame:
    p = fx.panel(spark, d).select("dt", "sym", "close")
    k = p.join(jn.calendar_index(p), "dt")
    later = k.select("sym", (F.col("idx") - 1).alias("idx"), F.col("close").alias("next"))
    return k.join(later, ["sym", "idx"]).select("dt", "sym", r(F.try_divide("next", "close") - 1, "label"))


@query("j14_prefix_join", "WITH t AS (SELECT DISTINCT upper(substr(p_brand, 1, 5)) || substr(p_brand, 7, 1) AS ticker FROM part), s AS (SELECT DISTINCT upper(substr(p_brand, 1, 5)) || substr(p_brand, 7, 1) || '.' || p_size AS sym FROM part), h AS (SELECT ticker, sym, row_number() OVER (PARTITION BY ticker ORDER BY sym) AS n FROM t JOIN s ON s.sym = ticker OR starts_with(s.sym, ticker || '.')) SELECT ticker, sym FROM h WHERE n = 1")
def j14(spark: SparkSession, d: str) -> DataFrame:
    part = fx.table(spark, d, "part").withColumn("ticker", F.concat(F.upper(F.substring("p_brand", 1, 5)), F.substring("p_brand", 7, 1)))
    symbols = part.select(F.concat_ws(".", "ticker", F.col("p_size").cast("string")).alias("sym")).distinct().withColumn("pos", F.col("sym"))
    return jn.prefix_match(part.select("ticker").distinct(), symbols, "ticker", "sym", "pos")


@query("j15_fuzzy_names")
def j15(spark: SparkSession, d: str) -> DataFrame:
    ship(spark)
    s = fx.table(spark, d, "supplier")
    noisy = s.select(F.regexp_replace(F.upper("s_name"), "0(?=[0-9]$)", "O").alias("name"))
    return jn.fuzzy_match(noisy, s.select(F.col("s_name").alias("target")), "name", "target", 0.8).select("name", "target", r("ratio", "ratio"))


@query("j18_u7_skip_existing", "SELECT o_orderkey FROM orders EXCEPT SELECT l_orderkey FROM lineitem WHERE l_quantity > 45")
def j18(spark: SparkSession, d: str) -> DataFrame:
    done = fx.table(spark, d, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"))
    return jn.skip_existing(fx.table(spark, d, "orders").select("o_orderkey").distinct(), done, ["o_orderkey"])


@query("k5_upsert_latest_wins", "WITH o AS (SELECT o_custkey, o_orderkey, 0 AS n, o_orderdate FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT o_custkey, o_orderkey, 1, o_orderdate FROM orders WHERE o_orderkey % 2 = 1), k AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, o_orderdate DESC, o_orderkey DESC) AS r FROM o) SELECT o_custkey, o_orderkey FROM k WHERE r = 1")
def k5(spark: SparkSession, d: str) -> DataFrame:
    o = fx.table(spark, d, "orders").select("o_custkey", "o_orderkey", F.struct("o_orderdate", "o_orderkey").alias("at"))
    return jn.upsert(o.where("o_orderkey % 2 = 0"), o.where("o_orderkey % 2 = 1"), ["o_custkey"], "at").select("o_custkey", "o_orderkey")


@query("a4_last_of_month", "SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS last_price FROM orders GROUP BY 1")
def a4(spark: SparkSession, d: str) -> DataFrame:
    return fx.table(spark, d, "orders").groupBy(F.trunc("o_orderdate", "month").alias("month")).agg(F.max_by("o_totalprice", F.struct("o_orderdate", "o_orderkey")).alias("last_price"))


@query("a5_month_end_dates", "SELECT strftime(o_orderdate, '%Y-%m') AS month, CAST(max(o_orderdate) AS DATE) AS month_end FROM orders GROUP BY 1")
def a5(spark: SparkSession, d: str) -> DataFrame:
    return fx.table(spark, d, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.to_date(F.max("o_orderdate")).alias("month_end"))


@query("a7_universe_min", f"WITH {fx.PANEL_SQL} SELECT min(n) AS least FROM (SELECT dt, count(DISTINCT sym) AS n FROM panel GROUP BY dt)")
def a7(spark: SparkSession, d: str) -> DataFrame:
    return fx.panel(spark, d).groupBy("dt").agg(F.countDistinct("sym").alias("n")).agg(F.min("n").alias("least"))


@query("u6_v9_distinct_dates", f"WITH {fx.PANEL_SQL} SELECT DISTINCT dt FROM panel WHERE dt BETWEEN DATE '1994-01-01' AND DATE '1996-12-31'")
def u6(spark: SparkSession, d: str) -> DataFrame:
    return fx.panel(spark, d).where("dt BETWEEN DATE'1994-01-01' AND DATE'1996-12-31'").select("dt").distinct()


@query("v2_unpivot_wide", "SELECT o_orderkey, unnest(['o_custkey', 'o_total']) AS field, unnest([CAST(o_custkey AS DOUBLE), o_totalprice]) AS value FROM orders")
def v2(spark: SparkSession, d: str) -> DataFrame:
    wide = fx.table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").cast("double").alias("o_custkey"), F.col("o_totalprice").alias("o_total"))
    return wide.unpivot("o_orderkey", ["o_custkey", "o_total"], "field", "value")


@query("v3_pivot_to_wide", f"WITH {fx.FL_SQL} SELECT dt, {', '.join(rs(f'max(CASE WHEN sym = {k} THEN close END)', f's{k}') for k in (1, 2, 3))} FROM fl WHERE sym <= 3 GROUP BY dt")
def v3(spark: SparkSession, d: str) -> DataFrame:
    wide = fx.fl(spark, d).where("sym <= 3").groupBy("dt").pivot("sym", [1, 2, 3]).agg(F.max("close"))
    return wide.select("dt", *[r(F.col(str(k)), f"s{k}") for k in (1, 2, 3)])


@query("v8_label_preference", f"WITH {fx.FL_SQL}, t AS (SELECT dt, sym, label FROM fl WHERE sym % 2 = 0) SELECT fl.dt AS dt, fl.sym AS sym, {rs('coalesce(t.label, fl.label / 2)', 'label')} FROM fl LEFT JOIN t ON t.dt = fl.dt AND t.sym = fl.sym")
def v8(spark: SparkSession, d: str) -> DataFrame:
    rows = fx.fl(spark, d).select("dt", "sym", "label")
    best = rows.where("sym % 2 = 0").select("dt", "sym", F.col("label").alias("tradable"))
    return rows.join(best, ["dt", "sym"], "left").select("dt", "sym", r(F.coalesce("tradable", F.col("label") / 2), "label"))


@query("v18_completeness", f"WITH {fx.PANEL_SQL} SELECT count(*) AS stored, (SELECT count(DISTINCT dt) FROM panel) * (SELECT count(DISTINCT sym) FROM panel) AS expected, count(*) = (SELECT count(DISTINCT dt) FROM panel) * (SELECT count(DISTINCT sym) FROM panel) AS complete FROM panel")
def v18(spark: SparkSession, d: str) -> DataFrame:
    got = fx.panel(spark, d).agg(F.count("*").alias("stored"), (F.countDistinct("dt") * F.countDistinct("sym")).alias("expected"))
    return got.withColumn("complete", F.col("stored") == F.col("expected"))


@query("x10_ema_reversion_factor", f"WITH RECURSIVE {fx.PANEL_SQL}, {fx.SYMBOLS_SQL}, n AS (SELECT sym, dt, close, row_number() OVER (PARTITION BY sym ORDER BY dt) AS i FROM panel), e AS (SELECT sym, dt, close, i, close AS ema FROM n WHERE i = 1 UNION ALL SELECT n.sym, n.dt, n.close, n.i, (2.0 / 7) * n.close + (1 - 2.0 / 7) * e.ema FROM e JOIN n ON n.sym = e.sym AND n.i = e.i + 1), f AS (SELECT dt, sector, -avg(close / nullif(ema, 0) - 1) AS factor FROM e JOIN symbols USING (sym) WHERE region = 1 GROUP BY 1, 2), lab AS (SELECT dt, sym, lead(close) OVER (PARTITION BY sym ORDER BY dt) / nullif(close, 0) - 1 AS label FROM panel), j AS (SELECT f.dt AS dt, factor, label FROM f JOIN symbols ON symbols.sector = f.sector AND region = 2 JOIN lab ON lab.dt = f.dt AND lab.sym = symbols.sym WHERE label IS NOT NULL), k AS (SELECT dt, rank() OVER (PARTITION BY dt ORDER BY round(factor, 9)) + (count(*) OVER (PARTITION BY dt, round(factor, 9)) - 1) / 2.0 AS x, rank() OVER (PARTITION BY dt ORDER BY label) + (count(*) OVER (PARTITION BY dt, label) - 1) / 2.0 AS y FROM j) SELECT dt, {rs(_CORR.format(x='x', y='y'), 'ic')} FROM k GROUP BY dt")
def x10(spark: SparkSession, d: str) -> DataFrame:
    """Mean reversion of one market's symbols, carried by sector to another market and scored there."""
    from factorspark.operators.rolling import ema

    s = fx.symbols(spark, d)
    p = fx.panel(spark, d)
    dev = ema(p, "close", ["sym"], "dt", 6).select("dt", "sym", (F.try_divide("close", "ema") - 1).alias("dev"))
    f = dev.join(s.where("region = 1"), "sym").groupBy("dt", "sector").agg((-F.avg("dev")).alias("factor"))
    lab = p.select("dt", "sym", ret.forward_return().alias("label")).where("label IS NOT NULL").join(s.where("region = 2"), "sym")
    return stats.rank_ic(lab.join(f.withColumn("factor", F.round("factor", 9)), ["dt", "sector"]), "factor", "label", ["dt"], "ic").select("dt", r("ic", "ic"))
