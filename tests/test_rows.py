"""Pairs are made, ranked and used within one task: nothing of the size of the pairs is exchanged, and results stay the same."""

import datetime as dt
import os
import random

import numpy as np
import pytest

D = "/root/testdata/sf0.001"
small = pytest.mark.skipif(not os.path.isdir(D), reason="needs the small tables")
PAIRS = "a8_f4_weighted_similarity a9_complete_similarity r1_graph_boost r7_strength_boost j11_r13_self_mask_after_rank j12_u4_blend_embedding_correlation j19_sparse_edge_lookup a18_j13_t3_recent_correlation r4_random_graph t2_top_k_neighbours".split()
FACTORS = "a11_peer_momentum a12_build_factor_gated a13_daily_factor a14_similarity_pooling j20_month_keyed_weights".split()
JOBS = "j16_w40_neighbour_demean x0_peer_momentum_rank_ic x4_graph_experiments x5_peer_baselines x7_market_matrix x8_pool_definitions x9_category_ablation x11_agentic_variants x12_daily_pooled_composite".split()


@small
@pytest.mark.parametrize("name", PAIRS + FACTORS + JOBS)
def test_no_table_of_pairs_is_exchanged(spark, name):
    import __spark_entry__ as e

    plan = e.queries()[name](spark, D)._jdf.queryExecution().sparkPlan().toString()
    assert "MapInArrow" in plan and "CoGroup" not in plan
    if name not in JOBS:
        above = plan[: plan.index("MapInArrow")]
        assert not any(x in above for x in ("Window", "Join", "Aggregate", "Sort", "Exchange")), above


def vectors(spark, n=60, seed=1):
    rng = random.Random(seed)
    base = {(s, c): [rng.gauss(0, 1) for _ in range(5)] for s in range(n) for c in range(3)}
    rows = [(s, c, base[s % 7 if s >= n - 20 else s, c]) for s in range(n) for c in range(3) if (s + c) % 4]
    return spark.createDataFrame(rows, "sym long, category int, emb array<float>").cache()


def test_similarity_and_ranks_agree_with_joins_and_copies_tie(spark):
    from factorspark.operators import rows as rw
    from factorspark.operators import similarity as sim

    v = vectors(spark)
    t = rw.store(v)

    def use(x):
        s, met = x.similarity()
        return s, rw.pct(s, met), met

    got = {(r.target, r.peer): (r.sim, r.pct) for r in rw.edges(t.rows, t, use, ("sim", "pct"), cells=130).collect()}
    want = {(r.target, r.peer): r.sim for r in sim.weighted_similarity(sim.category_cosine(v, v)).collect()}
    assert got.keys() == want.keys() and all(got[k][0] == pytest.approx(x, abs=1e-12) for k, x in want.items())
    for target in range(60):
        row = sorted((s, p) for (a, p), (s, _) in got.items() if a == target)
        assert [got[target, p][1] for _, p in row] == pytest.approx([(k + 1) / len(row) for k in range(len(row))])
    same = [(a, p, q) for a, p in got for q in range(40, 60) if (a, q) in got and p >= 40 and p % 7 == q % 7 and p % 4 == q % 4]
    assert same and all(got[a, p][0] == got[a, q][0] for a, p, q in same)

    def five(x):
        s, met = x.similarity()
        return s, *rw.top(s, rw.without_self(x, met), 5)

    near = {(r.target, r.peer): r.place for r in rw.edges(t.rows, t, five, ("sim", "place")).collect()}
    best = {(r.target, r.peer) for r in sim.top_neighbours(rw.edges(t.rows, t, lambda x: x.similarity(), ("sim",)), 5).collect()}
    assert near.keys() == best


def test_correlations_agree_with_the_walk(spark):
    from factorspark.operators import rows as rw
    from factorspark.operators.similarity import correlation_edges

    rng = random.Random(3)
    days = [dt.date(2001, 1 + k % 12, 1 + k // 12) for k in range(30)]
    # 3 is constant, 4 is constant but for one day that few others have
    value = lambda s, k: 0.1 if s == 3 else (50.0 if k == 0 else 0.1) if s == 4 else rng.gauss(0, 1)
    rows = [(d, s, value(s, k)) for k, d in enumerate(days) for s in range(12) if (s in (3, 4)) or (k > 0 and rng.random() < 0.7)]
    r = spark.createDataFrame([*rows, (days[0], 99, None)], "dt date, sym long, ret double").cache()
    t = rw.store(None, {"r": r})

    def use(x):
        c, n = x.correlation("r", 5)
        return c, n, n > 0

    got = {(x.target, x.peer): (x.n, x.corr) for x in rw.edges(t.rows, t, use, ("corr", "n"), ("r",), cells=30).collect()}
    want = {(x.target, x.peer): (x.n, x.corr) for x in correlation_edges(r, 5).collect()}
    assert got.keys() == want.keys()
    for k, (n, c) in want.items():
        assert got[k] == (n, None if c is None else pytest.approx(c, abs=1e-9)), k
    assert got[4, 0][1] == 0.0


def test_factors_agree_with_the_join(spark):
    from factorspark.operators import factor as fa
    from factorspark.operators import rows as rw

    rng = random.Random(5)
    days = [dt.date(2001, 2, k) for k in range(1, 15)]
    r = spark.createDataFrame([(d, s, rng.gauss(0, 1)) for d in days for s in range(50) if rng.random() < 0.6] + [(days[0], 51, None)], "dt date, sym long, ret double").cache()
    groups = spark.createDataFrame([(s, s % 3) for s in range(60)], "sym long, g int")
    t = rw.store(vectors(spark), {"r": r}, g=groups)

    def weigh(x):
        p, met = (s := x.similarity())[0], s[1]
        return rw.sigmoid(rw.pct(p, met), 10.0, 0.5) * met

    w = rw.edges(t.rows, t, lambda x: (weigh(x), x.similarity()[1]), ("w",)).cache()
    named = lambda x: iter([("own", weigh(x)), ("alone", rw.without_self(x, weigh(x)))])
    got = {(x.variant, x.dt, x.sym): x.factor for x in rw.factors(t.rows, t, named, 2.0, cells=200).collect()}
    for name, edges in (("own", w), ("alone", w.where("target <> peer"))):
        want = {(name, x.dt, x.sym): x.factor for x in fa.peer_factor_join(edges, r, 2.0).collect()}
        mine = {k: v for k, v in got.items() if k[0] == name}
        assert want and mine.keys() == want.keys() and all(mine[k] == pytest.approx(v, abs=1e-9) for k, v in want.items())
    by = {(x.grp, x.dt, x.sym): x.factor for x in rw.factors(t.rows, t, named, 0.0, group="g", groups=3).where("variant = 'own'").collect()}
    for g in range(3):
        want = {(g, x.dt, x.sym): x.factor for x in fa.peer_factor_join(w.where(f"peer % 3 = {g}"), r, 0.0).collect()}
        assert {k for k in by if k[0] == g} == want.keys() and all(by[k] == pytest.approx(v, abs=1e-9) for k, v in want.items())


def test_hash_is_that_of_spark(spark):
    from factorspark.operators import rows as rw
    from pyspark.sql import functions as F

    ids = [0, 1, 7, -3, 2**40 + 5]
    df = spark.createDataFrame([(a, b) for a in ids for b in ids], "a long, b long")
    want = [(x.a, x.b, x.h) for x in df.select("a", "b", F.xxhash64("a", "b", F.lit(1)).alias("h")).collect()]
    assert [(a, b, int(rw.xxhash64(a, np.array([b]), 1)[0])) for a, b, _ in want] == want


@small
def test_random_graph_is_that_of_the_operator(spark):
    import __spark_entry__ as e
    from factorspark.operators import graph as gr
    from factorspark.plans import queries_graph as qg
    from factorspark.sources import fixtures as fx

    want = gr.random_graph(qg.weights(spark, D), fx.edges(spark, D), 1).collect()
    assert want and sorted(e.queries()["r4_random_graph"](spark, D).collect()) == sorted(want)


def test_fuzzy_match_compares_few_pairs_and_finds_the_best(spark, monkeypatch):
    import difflib

    from factorspark.operators import joins

    rng = random.Random(8)
    texts = sorted({"".join(rng.choice("abc01") for _ in range(rng.randint(0, 14))) for _ in range(300)} | {f"Supplier#{k:05d}" for k in range(200)} | {"x" * 90 + "y", "z" * 70})
    names = [f"Supplier#{k:04d}O" for k in range(20)] + ["x" * 91, "ab0c1a", "zz", "caba01b0", "é漢字"]
    got = {r.name: (r.target, r.ratio) for r in joins.fuzzy_match(spark.createDataFrame([(n,) for n in names], "name string"), spark.createDataFrame([(t,) for t in texts], "target string"), "name", "target", 0.7).collect()}
    for n in names:
        all_ = [(difflib.SequenceMatcher(None, t.lower(), n.lower()).ratio(), t) for t in texts]
        equal = [t for t in texts if t.lower() == n.lower()]
        best = (1.0, min(equal)) if equal else max(all_)
        assert got.get(n) == ((best[1], best[0]) if best[0] >= 0.7 else None), n
    many = [f"supplier#{k:09d}" for k in range(5000)]
    best = max((difflib.SequenceMatcher(None, t, "supplier#0000012o4").ratio(), t) for t in many)
    tried = []
    ratio = difflib.SequenceMatcher.ratio
    monkeypatch.setattr(difflib.SequenceMatcher, "ratio", lambda m: tried.append(1) or ratio(m))
    assert joins._Texts(many, many).best("supplier#0000012o4", (0.8, None)) == best and len(tried) < 100


def test_ranks_of_ties_and_rounds_are_those_of_spark(spark):
    from factorspark.operators import rows as rw
    from pyspark.sql import functions as F

    rng = np.random.default_rng(6)
    for v in (rng.normal(size=5000), rng.integers(0, 9, 5000) / 4.0, np.zeros(300), np.array([]), np.array([1.0, np.nan, 1.0, -0.0, 0.0])):
        assert rw.order(v).tolist() == np.argsort(v, kind="stable").tolist()
    x = np.concatenate([rng.normal(size=3000), np.arange(-400, 400) / 128.0, rng.integers(-(10**7), 10**7, 3000) / 1e6 + 5e-7, [0.0, -0.0, -1e-9, 1e-300, 2.5e-6, 3.5e-6, 123456789.1234565, -1e17, 0.1234565, 1.0000005]])
    want = [r.y for r in spark.createDataFrame([(k, float(v)) for k, v in enumerate(x)], "k int, x double").orderBy("k").select((F.round("x", 6) + F.lit(0.0)).alias("y")).collect()]
    got = rw.rounded(x, 6).tolist()
    assert [repr(v) for v in got] == [repr(v) for v in want]
    assert np.isnan(rw.rounded(np.array([np.nan]), 6)).all()


def test_returns_are_made_once(spark, tmp_path):
    import uuid

    from factorspark.operators import rows as rw

    def made(batches):
        (tmp_path / uuid.uuid4().hex).touch()
        yield from batches

    days = [dt.date(2001, 3, 9), dt.date(2001, 3, 1), dt.date(2004, 1, 1)]
    r = spark.createDataFrame([(d, s, float(s)) for d in days for s in range(9)] + [(dt.date(2002, 1, 1), 1, None)], "dt date, sym long, ret double")
    t = rw.store(vectors(spark), {"r": r.repartition(3).mapInArrow(made, r.schema)})
    assert t.dates == sorted(days) and len(list(tmp_path.iterdir())) == 3
    at = rw.Calendar(t.dates, t.dt).place(rw.pa.array(days))
    assert at.tolist() == [1, 0, 2] and rw.Calendar([3, 5, 9], rw.T.LongType()).place(rw.pa.array([9, 3])).tolist() == [2, 0]


def test_expanding_correlations_agree_with_the_walk_tile_by_tile(spark):
    from factorspark.operators import rows as rw
    from factorspark.operators.similarity import expanding_correlation_edges

    rng = random.Random(9)
    days = [dt.date(2001, m, 1) for m in range(1, 13)]
    rows = [(d, s, 0.1 if s == 3 else rng.gauss(0, 1)) for k, d in enumerate(days) for s in range(23) if rng.random() < 0.6 and not (s == 5 and k < 9)]
    r = spark.createDataFrame([*rows, (days[0], 99, None)], "dt date, sym long, ret double").cache()
    stops = [(days[max(k - 1, 0)], d) for k, d in enumerate(days)]
    t = rw.store(None, {"r": r})
    got = {(x.month, x.target, x.peer): (x.n, x.corr) for x in rw.expanding(t.rows, t, stops, rw.T.DateType(), 3, tile=(4, 5)).collect()}
    want = {(x.month, x.target, x.peer): (x.n, x.corr) for x in expanding_correlation_edges(r, spark.createDataFrame(stops, "upto date, month date"), 3, 2).collect()}
    assert want and got.keys() == want.keys()
    for k, (n, c) in want.items():
        assert got[k] == (n, None if c is None else pytest.approx(c, abs=1e-12)), k


@small
@pytest.mark.parametrize("name", ["a19_j21_monthly_correlation_weights", "k2_s9_correlation_cache", "k2_s8_similarity_cache"])
def test_no_pair_is_exchanged_or_stored(spark, name, monkeypatch):
    import __spark_entry__ as e
    from factorspark.sources import panel_store as ps

    kept, save = [], ps.save_edges
    monkeypatch.setattr(ps, "save_edges", lambda df, *a: kept.append(df) or save(df, *a))
    plan = e.queries()[name](spark, D)._jdf.queryExecution().sparkPlan().toString()
    assert "MapInArrow" in plan and "CoGroup" not in plan and not any(x in plan[: plan.index("MapInArrow")] for x in ("Join", "Exchange", "Window"))
    assert not any("peer" in df.columns for df in kept)


def test_pairs_come_whole_in_strips_that_make_short_files(spark, tmp_path, monkeypatch):
    from factorspark.operators import rows as rw

    v = spark.createDataFrame([(s, 0, [1.0, float(s % 7)]) for s in range(3000)], "sym long, category int, emb array<float>")
    t = rw.store(v)
    one = lambda x: (np.ones((len(x.targets), len(x.peers))), x.similarity()[1])
    got = rw.edges(t.rows.where("sym % 10 = 0"), t, one)
    got.write.parquet(str(tmp_path / "w"))
    assert got.count() == got.distinct().count() == 300 * 3000
    assert sum(f.stat().st_size for f in (tmp_path / "w").glob("*.parquet")) < 900_000
    monkeypatch.setattr(rw, "WIDE", 7)
    monkeypatch.setattr(rw, "BATCH", 20)
    few = rw.edges(t.rows.where("sym < 9"), t, lambda x: x.similarity(), ("sim",))
    assert sorted((x.target, x.peer) for x in few.collect()) == [(a, b) for a in range(9) for b in range(3000)]


def test_targets_of_factors_leave_their_returns_behind(spark, monkeypatch):
    from factorspark.operators import rows as rw

    r = spark.createDataFrame([(dt.date(2001, 1, k), s, float(s)) for k in (1, 2) for s in range(9)], "dt date, sym long, ret double")
    t = rw.store(vectors(spark), {"r": r, "m": r, "label": r})
    sent, deal = [], rw.each
    monkeypatch.setattr(rw, "each", lambda targets, *x: sent.append(targets.columns) or deal(targets, *x))
    for x, gone in (({}, {"r"}), ({"more": ("m",)}, {"r"}), ({"more": ("r",)}, set()), ({"label": "r"}, set()), ({"series": ("r", "m"), "label": "label"}, {"r", "m"})):
        assert rw.factors(t.rows, t, lambda x: iter([("w", x.similarity()[1] * 1.0)]), **x).count()
        assert {"r_ret", "m_ret", "label_ret", "r_at", "m_at", "label_at"} - set(sent[-1]) == {f"{g}_{y}" for g in gone for y in ("at", "ret")}


@small
@pytest.mark.parametrize("name", ["a13_daily_factor", "j20_month_keyed_weights"])
def test_daily_returns_are_dealt_by_symbol_once(spark, name, monkeypatch):
    import __spark_entry__ as e
    from factorspark.operators import rows as rw

    kept, save = [], rw.store
    monkeypatch.setattr(rw, "store", lambda v, returns=None, how="left", **c: kept.append(returns["r"]) or save(v, returns, how, **c))
    e.queries()[name](spark, D)
    assert kept[0].groupBy("sym").agg({"ret": "max"})._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1


def test_stored_rows_go_with_the_session(tmp_path):
    import subprocess
    import sys
    import time

    code = """
from pyspark.sql import SparkSession
s = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", "file://%s").getOrCreate()
from factorspark.operators import rows as rw
t = rw.store(s.createDataFrame([(1, 0, [1.0])], "sym long, category int, emb array<float>"))
print("stored", t.rows.count())
s.stop()
""" % tmp_path
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=120)
    assert "stored 1" in done.stdout, done.stderr[-2000:]
    end = time.time() + 20
    while list(tmp_path.rglob("*.parquet")) and time.time() < end:
        time.sleep(0.2)
    assert not list(tmp_path.rglob("*.parquet"))


@small
@pytest.mark.parametrize("name", ["a11_peer_momentum", "a14_similarity_pooling", "x7_market_matrix"])
def test_monthly_returns_read_lines_once_and_stay_with_their_symbol(spark, name, monkeypatch):
    import __spark_entry__ as e
    from factorspark.operators import rows as rw
    from pyspark.sql import DataFrameWriter

    plans, write = [], DataFrameWriter.parquet

    def watched(self, path, *a, **b):
        if "/rows-" in path:
            df = self._df.select("sym", *[c for c in self._df.columns if c.endswith("_ret")])
            df.collect()  # under the settings of the write
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(self, path, *a, **b)

    monkeypatch.setattr(DataFrameWriter, "parquet", watched)
    monkeypatch.setattr(rw, "factors", lambda *a, **b: spark.createDataFrame([], "variant string, series string, grp int, dt date, sym long, factor double, label double, region int"))
    e.queries()[name](spark, D)
    made = [x.strip(" :+-|") for x in plans[0].split("Initial Plan")[0].splitlines()]
    assert sum("FileScan" in x and "l_shipdate" in x for x in made) == 1, plans[0]
    assert sum(x.startswith("Exchange hashpartitioning(dt") for x in made) == 1, plans[0]


def test_sector_means_that_are_sent_are_those_of_the_window(spark):
    from factorspark.operators import returns as ret

    rng = random.Random(4)
    days = [None, dt.date(2001, 1, 1), dt.date(2001, 2, 1)]
    rows = [(d, s, rng.choice([None, "", "a", "b", "c"]), None if rng.random() < 0.2 else float(s)) for d in days for s in range(60)]
    x = spark.createDataFrame([*rows, (days[1], 99, "alone", None)], "dt date, sym long, sector string, x double")
    want = {(r.dt, r.sym): r.y for r in x.withColumn("y", ret.sector_relative("x")).collect()}
    got = ret.less_sector_mean(x, "x", "y")
    assert got.columns == [*x.columns, "y"] and got.count() == len(want)
    assert all(r.y == (None if want[r.dt, r.sym] is None else pytest.approx(want[r.dt, r.sym], abs=1e-12)) for r in got.collect())


def test_neighbours_in_the_task_give_the_residuals_of_the_join(spark):
    from factorspark.operators import neutralize as nt
    from factorspark.operators import rows as rw

    rng = random.Random(7)
    days, lone = list(range(14)), 13
    rows = [(d, s, rng.gauss(0, 1)) for d in days for s in range(75) if rng.random() < 0.5]  # symbols over 60 have no vectors
    r = spark.createDataFrame([*rows, (5, 3, None)], "dt int, sym long, ret double").cache()
    t = rw.store(vectors(spark), {"r": r}, "full")

    def five(x):
        s, met = x.similarity()
        place, chosen = rw.top(s, rw.without_self(x, met), 5)
        return np.where(s < 0, 0.0, s), chosen  # targets 0 to 9 have also neighbours of weight 0

    near = rw.edges(t.rows.where("v IS NOT NULL"), t, five, ("sim",))
    for cells in (100, 8_000_000):
        got = rw.demeaned(t.rows.where("r_at IS NOT NULL"), t, five, lone=lone, cells=cells).collect()
        want = {(x.dt, x.sym): x.residual for x in nt.neighbour_demean(r.where(f"ret IS NOT NULL AND dt <> {lone}"), near, "ret").collect()}
        want |= {(d, s): v for d, s, v in rows if d == lone}
        assert len(got) == len(want) and {(x.dt, x.sym) for x in got} == want.keys()
        assert all(x.residual == pytest.approx(want[x.dt, x.sym], abs=1e-9) for x in got)


@small
def test_neighbour_demean_exchanges_no_row_a_neighbour_and_date(spark):
    import __spark_entry__ as e

    plan = e.queries()["j16_w40_neighbour_demean"](spark, D)._jdf.queryExecution().sparkPlan().toString()
    above = plan[: plan.index("MapInArrow")]
    assert not any(x in above for x in ("Join", "Aggregate", "Sort", "Exchange")), above


def test_blocks_without_any_vector_are_rows_of_zeros(spark):
    from factorspark.operators import rows as rw

    r = spark.createDataFrame([(dt.date(2001, 1, 1), s, 1.0) for s in range(90)], "dt date, sym long, ret double")
    t = rw.store(vectors(spark, 20), {"r": r}, "full")
    got = rw.edges(t.rows, t, lambda x: x.similarity(), ("sim",), cells=90).collect()
    assert t.count == 90 and got and max(x.target for x in got) < 20


def test_shuffles_of_a_stored_table_go_when_it_is_stored(spark):
    import time
    from pathlib import Path

    from factorspark.functions.shipping import STORING
    from factorspark.operators import rows as rw
    from pyspark.sql import functions as F

    dirs = list(spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString())
    kept = lambda: {f for d in dirs for f in Path(d).rglob("shuffle_*.data")}
    before, conf = kept(), {k: spark.conf.get(k, None) for k in STORING}
    r = spark.range(100_000).select(F.date_add(F.lit(dt.date(2001, 1, 1)), (F.col("id") % 100).cast("int")).alias("dt"), (F.col("id") % 997).alias("sym"), F.rand(1).alias("ret"))
    t = rw.store(vectors(spark), {"r": r}, "full")
    assert t.count == 997 and {k: spark.conf.get(k, None) for k in STORING} == conf
    big = lambda: sum(f.stat().st_size for f in kept() - before if f.exists())
    end = time.time() + 20
    while big() > 100_000 and time.time() < end:
        time.sleep(0.2)
    assert big() < 100_000  # the returns alone took over a megabyte
