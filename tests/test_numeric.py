"""Whitening, keyed factors, as-of joins and exponential means against NumPy and loops."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

D = "/root/testdata/sf0.01"


def test_whitening_of_every_width(spark):
    from factorspark.operators import similarity as sim

    rng = np.random.default_rng(2)
    x = rng.normal(size=(120, 6)) @ rng.normal(size=(6, 6)) + 3
    df = spark.createDataFrame([(k, [float(v) for v in row]) for k, row in enumerate(x)] + [(999, None)], "sym long, emb array<double>").repartition(5)
    model = sim.fit_whitening(df, 6)
    centred = x - x.mean(0)
    u, s, _ = np.linalg.svd(centred, full_matrices=False)
    assert np.allclose(model.explained, np.cumsum(s**2) / (s**2).sum())
    got = np.array([r.z for r in sim.whiten(df, model).orderBy("sym").collect()])
    want = np.sqrt(len(x)) * u
    assert np.allclose(np.abs(got), np.abs(want), atol=1e-6)
    cov = {(r.i, r.j): r["cov"] for r in sim.covariance(sim.whiten(df, 6), 4).collect()}
    assert len(cov) == 16 and all(abs(v - (i == j)) < 1e-8 for (i, j), v in cov.items())


def test_covariance_is_not_always_the_identity(spark):
    from factorspark.operators import similarity as sim

    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, -1.0]), (3, [0.0, 4.0])], "sym long, z array<double>")
    cov = {(r.i, r.j): round(r["cov"], 9) for r in sim.covariance(df).collect()}
    assert cov == {(0, 0): round(10 / 3, 9), (0, 1): round(-1 / 3, 9), (1, 0): round(-1 / 3, 9), (1, 1): 7.0}


def test_a_direction_without_variance(spark):
    from factorspark.operators import similarity as sim

    df = spark.createDataFrame([(k, [float(k), 2.0 * k, 5.0]) for k in range(9)], "sym long, emb array<double>")
    z = np.array([r.z for r in sim.whiten(df, 3).collect()])
    assert np.allclose((z**2).mean(0), [1, 0, 0])
    assert sim.gram(df.where("false"))[0] == 0


def test_keyed_factor_agrees_with_the_join(spark):
    from factorspark.operators import factor as fa

    rng = random.Random(1)
    w = spark.createDataFrame([(v, t, p, rng.random()) for v in ("a", "b/|\"c") for t in range(12) for p in range(12) if rng.random() < 0.6], "v string, target long, peer long, w double").cache()
    rets = spark.createDataFrame([(d, s, rng.gauss(0, 1)) for d in range(5) for s in range(12) if rng.random() < 0.8], "dt int, sym long, ret double").cache()
    got = {(r.v, r.dt, r.sym): r.factor for r in fa.keyed_factor(w, rets, ("v",), 0.5).collect()}
    want = {(v, r.dt, r.sym): r.factor for v in ("a", "b/|\"c") for r in fa.peer_factor_join(w.where(F.col("v") == v), rets, 0.5).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


@pytest.mark.parametrize("kind", ["date", "timestamp", "long"])
def test_asof_without_a_key(spark, kind):
    from factorspark.operators.joins import asof_backward

    rng = random.Random(7)
    left, right = sorted(rng.sample(range(-50, 5000), 300)), sorted(rng.sample(range(0, 4000), 60))
    at = {"date": "date_add(DATE'2001-01-01', CAST(t AS INT))", "timestamp": "timestamp_seconds(t * 977)", "long": "t"}[kind]
    a = spark.createDataFrame([(t,) for t in left], "t long").selectExpr("t", f"{at} AS dt")
    b = spark.createDataFrame([(t,) for t in right], "t long").selectExpr(f"{at} AS dt", "t AS v")
    got = {r.t: r.v for r in asof_backward(a, b, "dt", "v").collect()}
    assert got == {t: max((x for x in right if x <= t), default=None) for t in left}
    assert {r.v for r in asof_backward(a, b.where("false"), "dt", "v").collect()} == {None}


def test_styles_agree_with_least_squares(spark):
    from factorspark.operators.neutralize import styles

    rng = np.random.default_rng(5)
    rows = [(d, k, *map(float, rng.normal(size=3))) for d in range(2) for k in range(40)]
    df = spark.createDataFrame([(d, s, y, a, b, 2 * a) for d, s, y, a, b in rows], "dt int, sym int, y double, a double, b double, c double")
    got = styles(df, "y", ["a", "b", "c"]).collect()
    assert len(got) == 80
    for day in range(2):
        own = [r for r in rows if r[0] == day]

        def std(v):
            v = np.clip(v, np.percentile(v, 1), np.percentile(v, 99))
            return (v - v.mean()) / v.std()

        y, a, b = (std(np.array([r[k] for r in own])) for k in (2, 3, 4))
        m = np.column_stack([np.ones(40), a, b])
        res = y - m @ np.linalg.lstsq(m, y, rcond=None)[0]
        mine = {r.sym: r for r in got if r.dt == day}
        assert all(abs(mine[r[1]].residual - e) < 1e-9 for r, e in zip(own, res, strict=True))
        assert abs(mine[0].r2 - (1 - (res**2).sum() / (y**2).sum())) < 1e-9


@pytest.mark.skipif(not os.path.isdir(D), reason="needs the small tables")
def test_sector_queries_have_rows(spark):
    import __spark_entry__

    for name in ("j17_sector_baseline", "x10_ema_reversion_factor", "s15_twse_codes", "s16_dart_codes", "s17_hkex_codes"):
        assert __spark_entry__.queries()[name](spark, D).count() > 0, name


@pytest.mark.skipif(not os.path.isdir(D), reason="needs the small tables")
def test_random_and_permuted_graphs(spark):
    """A random graph has each target's number of edges; a permutation keeps each target's weights and renames peers one to one."""
    from factorspark.operators import graph as gr
    from factorspark.sources import fixtures as fx

    w = fx.categories(spark, D).select("sym").distinct()
    w = w.select(F.col("sym").alias("target")).crossJoin(w.select(F.col("sym").alias("peer"))).withColumn("w", F.col("target") * 1000.0 + F.col("peer")).cache()
    e = fx.edges(spark, D)
    degree = {r.target: r.n for r in e.distinct().groupBy("target").agg(F.count("*").alias("n")).collect()}
    peers = w.select("peer").distinct().count()
    got = {r.target: (r.n, r.m) for r in gr.random_graph(w, e, 1).groupBy("target").agg(F.count("*").alias("n"), F.countDistinct("peer").alias("m")).collect()}
    assert got == {t: (min(n, peers),) * 2 for t, n in degree.items() if t in {r.target for r in w.select("target").distinct().collect()}}
    moved = gr.permuted_peers(w, 1).collect()
    to = {}
    for r in moved:
        assert to.setdefault(r.w - 1000.0 * r.target, r.peer) == r.peer
    assert len(moved) == w.count() and len(set(to.values())) == len(to) == peers
