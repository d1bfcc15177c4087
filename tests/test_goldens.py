"""Hand-computed goldens, invariants and equivalences of the panel operators."""

import datetime as dt
import math
import os

import pytest
from factorspark.functions import text as tx
from factorspark.functions import weights as W
from factorspark.operators import joins, rolling, stats
from factorspark.operators import xsection as xs
from factorspark.operators.returns import reference_price
from factorspark.plans import cross_section as cs
from factorspark.sources import panel_store as ps
from pyspark.sql import functions as F


def frame(spark, values, **cols):
    rows = [("d", k, v, *(c[k] for c in cols.values())) for k, v in enumerate(values)]
    return spark.createDataFrame(rows, "dt string, sym int, x double" + "".join(f", {c} double" for c in cols))


def column(df, c):
    return [r.v for r in df.select("sym", c.alias("v")).orderBy("sym").collect()]


def test_layer_sizes(spark):
    got = column(frame(spark, [7.0, 6.0, 5.0, 4.0, 3.0, 2.0, 1.0]), xs.layer("x", 5, ["dt"], "sym"))
    assert [got.count(k) for k in (1, 2, 3, 4, 5)] == [1, 1, 2, 1, 2]


def test_percentile_and_average_ranks(spark):
    assert column(frame(spark, [0.2, None, 0.9, 0.2]), xs.ordinal_pct("x", ["dt"], "sym")) == pytest.approx([1 / 3, None, 1, 2 / 3])
    assert column(frame(spark, [1.0, 2.0, 2.0, 5.0]), xs.avg_rank("x", ["dt"])) == [1, 2.5, 2.5, 4]


def test_positions(spark):
    df = frame(spark, [3.0, 2.0, 1.0]).withColumn("factor", F.col("x")).withColumn("raw", F.col("x") - 2)
    got = cs.positions(df).orderBy("sym").collect()
    assert [r.pos_ls for r in got] == [0.5, 0, -0.5] and [r.pos_long for r in got] == [1, 0, 0]
    assert [r.pos_short for r in got] == [0, 0, -1] and {r.pos_passive for r in got} == {1 / 3}


def test_reference_price_and_trades(spark):
    df = spark.createDataFrame([("a", k, v) for k, v in enumerate((0.1, 0.2, -0.5))], "sym string, dt int, label double")
    assert [r.v for r in df.select("dt", reference_price("label").alias("v")).orderBy("dt").collect()] == pytest.approx([1, 1.1, 1.32])
    held = spark.createDataFrame([("a", 0, 1.0, 1.0), ("a", 1, 1.0, 1.1)], "sym string, dt int, pos_ls double, ref double")
    got = cs.trades(held, ("ls",)).orderBy("dt").collect()
    assert [r.base_ls - 0.01 * r.trade_ls for r in got] == pytest.approx([-0.01, 0.099])
    assert [r.base_ls for r in got] == pytest.approx([0, 0.1])


def test_ema_drawdown_quantile(spark):
    df = spark.createDataFrame([("a", k, float(k + 1)) for k in range(3)], "sym string, dt int, x double")
    assert [r.ema for r in rolling.ema(df, "x", ["sym"], "dt", 3).orderBy("dt").collect()] == [1, 1.5, 2.25]
    df = spark.createDataFrame([("a", k, v) for k, v in enumerate((0.1, -0.2, 0.05))], "sym string, dt int, x double")
    assert stats.drawdown(df, "x", ["sym"], "dt").first().max_dd == pytest.approx(-0.2 / 1.1)
    assert spark.range(1).select(xs.nearest_quantile(F.array(*map(F.lit, (1.0, 2.0, 3.0))), 0.1).alias("v")).first().v == 1


def test_safe_corr_and_phi(spark):
    df = spark.createDataFrame([(1, 2.0, 5.0), (1, 2.0, 6.0), (2, 1.0, 1.0), (3, 1.0, 2.0), (3, 2.0, 4.0), (3, None, 9.0)], "g int, x double, y double")
    assert {r.g: r.ic for r in stats.ic(df, "x", "y", ["g"]).collect()} == {1: None, 2: None, 3: pytest.approx(1.0)}
    zs = spark.createDataFrame([(z / 4,) for z in range(-16, 17)], "z double")
    for r in zs.select("z", W.normal_cdf(F.col("z")).alias("p")).collect():
        assert r.p == pytest.approx((1 + math.erf(r.z / 2**0.5)) / 2, abs=2e-7)


def test_invariants_of_a_backtest(spark):
    import random

    rng = random.Random(0)
    rows = [(dt.date(2020, 1, 1) + dt.timedelta(days=d), s, rng.random(), rng.uniform(-0.1, 0.1)) for d in range(30) for s in range(20) if rng.random() < 0.9]
    df = spark.createDataFrame(rows, "dt date, sym int, factor double, label double")
    c = cs.Config(annual_days=252, lag=1)
    traded = cs.prepared(df, c).cache()
    for r in traded.groupBy("dt").agg(F.sum("pos_ls").alias("s"), F.sum(F.abs("pos_ls")).alias("g"), F.sum("pos_long").alias("l"), F.sum("pos_short").alias("h"), F.count("factor").alias("n")).collect():
        if r.n:
            assert r.s == pytest.approx(0, abs=1e-12) and r.g == pytest.approx(1) and r.l == pytest.approx(1) and r.h == pytest.approx(-1)
    fee = 0.0005
    per_fee = traded.groupBy("dt").agg(F.sum(F.col("base_ls") - F.col("trade_ls") * fee).alias("v"))
    at_once = cs.pnl(traded, (0.0, fee)).where("side = 'ls' AND cost = '5.0 bp'")
    a, b = {r.dt: r.v for r in per_fee.collect()}, {r.dt: r.pnl for r in at_once.collect()}
    assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k], abs=1e-12) for k in a)
    assert cs.summary(df, c).count() == 15 and cs.validate(df, c) == []
    assert cs.validate(df, cs.Config(layers=50, long_layers=(1,), short_layers=(1,))) != []


def test_parameter_names():
    assert tx.encode_ck(0.99, 50) == "c0_99_k50" and tx.encode_ck(0.97, 30) == "c0_97_k30" and tx.encode_ck(0.995, 80) == "c0_995_k80"
    assert tx.encode_threshold(0.95) == "t0_95" and tx.encode_threshold(0.80) == "t0_80"
    assert tx.decode_ck("c0_99_k50") == (0.99, 50.0)
    assert tx.parse_factor_name(tx.factor_name("us", "jp", "emb", 0.995, 80)) == {"target": "us", "peer": "jp", "kind": "emb", "c": 0.995, "k": 80.0}


def test_fuzzy_match_agrees_with_all_pairs(spark):
    import difflib

    names, targets = ["Acme Corp", "ACME CORP", "Globex", "Initech Ltd", "Umbrela", "zzz"], ["acme corp", "Globex Inc", "Initech Ltd.", "Umbrella", "q"]
    got = {r.name: r.target for r in joins.fuzzy_match(spark.createDataFrame([(n,) for n in names], "name string"), spark.createDataFrame([(t,) for t in targets], "target string"), "name", "target").collect()}
    low = {t.lower(): t for t in targets}
    want = {n: low[m[0]] for n in names if (m := difflib.get_close_matches(n.lower(), low, 1, 0.8))}
    assert got == want


def test_panel_store_round_trip(spark, tmp_path):
    path = str(tmp_path / "store")
    key = {"product": "eq", "region": "us", "freq": "1d", "source": "x"}
    rows = [(f"2020-01-0{d}", s, float(d), float(d * 2)) for d in range(1, 6) for s in ("A", "B") if (d, s) != (3, "B")]
    df = spark.createDataFrame(rows, "date string, symbol string, open double, close double")
    ps.save_panel(df, path, **key)
    got = ps.load_panel(spark, path, **key, start="2020-01-02", end="2020-01-04", fields=["close"])
    assert got.columns == ["date", "symbol", "close"] and got.count() == 6 and got.where("close IS NULL").count() == 1
    ps.save_panel(df.withColumn("close", F.lit(0.0)), path, **key, overwrite=False)
    assert ps.load_panel(spark, path, **key, start="2020-01-01", end="2020-01-05", fields=["close"]).where("close = 0").count() == 0
    ps.copy_selected(spark, path, str(tmp_path / "copy"), key, {"px": "close"}, ["B", "Z"], "2020-01-01", "2020-01-09")
    copied = spark.read.parquet(str(tmp_path / "copy"))
    assert copied.count() == 10 and copied.where("symbol = 'Z' AND px IS NOT NULL").count() == 0


def test_reports_and_dictionaries(spark, tmp_path):
    folder = tmp_path / "us_fy24"
    folder.mkdir()
    (folder / "a.json").write_text('{"source_file": "a", "categories": {"revenue_model": "r"}, "filing_date": "2024-01-01", "symbol": "A", "form_type": "10-K"}')
    (folder / "b.json").write_text('{"symbol": "A", "report_type": "SecReport", "filing_date": "2025-01-01", "source_file": "b", "categories": {}}')
    (folder / "bad.json").write_text("{not json")
    got = ps.load_reports(spark, [str(folder)])
    assert sorted(r.form_type for r in got.collect()) == ["10-K", "SecReport"] and {r.source for r in got.collect()} == {"us_fy24"}
    assert ps.latest_filing(got).first().source_file == "b" and len(got.first().categories) == 10
    (tmp_path / "s.csv").write_text("SYMBOL,region,sector,gics_sector,company,industry\nA,us,Tech,,x,y\n2330.TW,tw_twse,Chips,IT,z,y\n")
    assert {r.symbol: r.sector for r in ps.symbol_sectors(spark, str(tmp_path / "s.csv")).collect()} == {"A": "Tech", "2330.TW": "IT"}
    assert [r.stock_id for r in ps.twse_codes(spark, str(tmp_path / "s.csv")).collect()] == ["2330"]
    (tmp_path / "d.xml").write_text("<result><list><corp_code>1</corp_code><corp_name>n</corp_name><stock_code>000650</stock_code></list><list><corp_code>2</corp_code><corp_name>m</corp_name><stock_code> </stock_code></list></result>")
    assert [r.symbol for r in ps.dart_codes(spark, str(tmp_path / "d.xml")).collect()] == ["000650.KS"]
    (tmp_path / "h.json").write_text('[{"c": "00700", "i": "7"}, {"c": "1", "i": "8"}]')
    assert [r.symbol for r in ps.hkex_codes(spark, str(tmp_path / "h.json")).collect()] == ["0700.HK"]
    (tmp_path / "g.json").write_text('{"US1": {"connections": [{"jp_ticker": "1.T"}, {"jp_ticker": "2.T"}]}}')
    assert sorted(r.target for r in ps.load_graph(spark, str(tmp_path / "g.json")).collect()) == ["1.T", "2.T"]
    header = ",".join(f"h{k}" for k in range(13))
    (tmp_path / "e.csv").write_bytes(("title\n" + header + "\nE1,k,上場,c,1,3,Name,N,n,a,i,13320,9\nE2,k,,c,1,3,Other,N,n,a,i,,9\n").encode("cp932"))
    assert [r.symbol for r in ps.edinet_codes(spark, str(tmp_path / "e.csv")).collect()] == ["1332.T"]
    edges = spark.createDataFrame([("us", "jp", "A", "B", 0.5)], "target_region string, peer_region string, target string, peer string, pct double")
    ps.save_edges(edges, str(tmp_path / "edges"), "target_region", "peer_region")
    assert ps.load_edges(spark, str(tmp_path / "edges"), target_region="us").count() == 1
    assert ps.cached_keys(spark, str(tmp_path / "edges"), "target_region", "peer_region").count() == 1


D = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(D), reason="needs the small tables")
def test_streaming(spark):
    from factorspark.streaming import events as ev

    stream = ev.read_events(spark, f"{D}/events.parquet*")
    q = ev.tumbling(stream).writeStream.format("memory").queryName("tumbled").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    batch = spark.read.parquet(f"{D}/events.parquet")
    assert spark.table("tumbled").agg(F.sum("n")).first()[0] == batch.count()
    q = ev.running_ema(stream).writeStream.format("memory").queryName("emas").outputMode("update").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("emas").agg(F.sum("n")).first()[0] == batch.count()


@pytest.mark.skipif(not os.path.isdir(D), reason="needs the small tables")
def test_queries_agree_with_sql(spark):
    """A few queries of each module against DuckDB; all of them are compared outside the tests."""
    import duckdb

    from factorspark.plans import registry

    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    queries, sql = registry.queries(), registry.oracle_sql()
    for name in ("w7_layers", "a34_max_drawdown", "x3_w6_similarity_ranks", "a11_peer_momentum", "x1_cross_section_summary", "j8_asof_per_key", "g1_parse_filename", "r6_strength_filter"):
        found = con.execute(sql[name])
        cols = [c[0] for c in found.description]
        clean = lambda v: round(v, 5) + 0.0 if isinstance(v, float) else v
        want = sorted(repr([clean(v) for v in row]) for row in found.fetchall())
        got = sorted(repr([clean(r[c]) for c in cols]) for r in queries[name](spark, D).collect())
        assert got == want, name


def test_report_page(spark):
    from factorspark.plans.report import formatted, render

    summary = spark.createDataFrame([("2.0 bp", "ls", 0.1234, None)], "cost string, side string, ret_annual double, ret_sharpe double")
    series = spark.createDataFrame([("cum", k, float(k)) for k in range(3)], "name string, dt int, value double")
    page = render(summary, series, "A & B")
    assert "12.34%" in page and "n/a" in page and "<polyline" in page and "A &amp; B" in page
    assert formatted(3.0, "integer") == "3" and formatted(0.5, "ratio") == "0.500"


def test_matrix_forms_agree_with_joins(spark):
    import random

    from factorspark.operators import factor as fa
    from factorspark.operators import similarity as sm

    rng = random.Random(6)
    emb = spark.createDataFrame([(s, c, [rng.gauss(0, 1) for _ in range(4)] if s != 5 else [0.0] * 4) for s in range(30) for c in range(3) if (s + c) % 7], "sym long, category int, emb array<float>")
    for w in (None, {0: 0.5, 1: 0.0}):
        a = {(r.target, r.peer): r.sim for r in sm.weighted_similarity(sm.category_cosine(emb, emb), w).collect()}
        b = {(r.target, r.peer): r.sim for r in sm.block_similarity(emb, emb, w, 3).collect()}
        assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k], abs=1e-12) for k in a)
    weights = spark.createDataFrame([(f"t{t}", f"p{p}", rng.random() if rng.random() < 0.8 else 0.0) for t in range(12) for p in range(20)], "target string, peer string, w double")
    rets = spark.createDataFrame([(dt.date(2020, 1, d), f"p{p}", rng.gauss(0, 1) if rng.random() < 0.9 else None) for d in range(1, 10) for p in range(22)], "dt date, sym string, ret double")
    for gate in (0.0, 7.0):
        a = {(r.dt, r.sym): r.factor for r in fa.peer_factor_join(weights, rets, gate).collect()}
        b = {(r.dt, r.sym): r.factor for r in fa.peer_factor(weights, rets, gate).collect()}
        assert a and a.keys() == b.keys() and all(a[k] == pytest.approx(b[k], abs=1e-12) for k in a)
