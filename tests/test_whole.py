"""Registered queries work on whole tables; brute force or whole SQL is the measure here.

No registered SQL takes a subset of ids that its query doesn't.
"""

import os

import pytest

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
D = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(D), reason="needs the small tables")


@pytest.fixture(scope="module")
def queries():
    import __spark_entry__

    return __spark_entry__.queries()


def clean(v):
    return round(v, 5) + 0.0 if isinstance(v, float) else v


def duck(sql, columns, folder=D):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{folder}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet{'/*.parquet' if os.path.isdir(f'{folder}/{t}.parquet') else ''}')")
    found = con.execute(sql)
    at = [[c[0] for c in found.description].index(c) for c in columns]
    return sorted(repr([clean(row[k]) for k in at]) for row in found.fetchall())


def spark_rows(df):
    return sorted(repr([clean(v) for v in row]) for row in df.collect())


def whole(cut, name):
    """The registered SQL of a query, which must not have the subset of ids that it once had."""
    from factorspark.plans import registry

    sql = registry.oracle_sql()[name]
    assert cut not in sql
    return sql


HARD = ['quote " and \\ backslash', "line\none\r\ttab", "\x01\x02\x1f control", "\u2028 é 漢字 😀 \x7f", "", None, "x" * 300_000, "</script>{\"a\": [1]}"]


def test_report_and_result_json_carry_every_text(spark, queries, tmp_path):
    rows = [(k, t, "en" if k % 4 else None, "s", None if t is None else len(t)) for k, t in enumerate(HARD * 3)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    got = queries["s10_d11_report_json"](spark, str(tmp_path)).collect()
    assert sorted(((r.doc_id, r.form_type, r.main) for r in got), key=str) == sorted(((k, lang, t) for k, t, lang, *_ in rows), key=str)
    got = queries["k6_result_json"](spark, str(tmp_path)).collect()
    assert sorted(((r.doc_id, r.lang, r.n_chars) for r in got), key=str) == sorted(((k, lang, n) for k, _, lang, _, n in rows), key=str)
    for name, text in (("s10_d11_report_json", "SELECT doc_id, lang AS form_type, text AS main FROM documents"), ("k6_result_json", "SELECT doc_id, lang, n_chars FROM documents")):
        df = queries[name](spark, D)
        assert spark_rows(df) == duck(text, df.columns), name


@pytest.mark.parametrize(
    ("name", "cut"),
    [
        ("a13_daily_factor", " AND target % 10 = 0"),
        ("j20_month_keyed_weights", " AND target % 20 = 0"),
        ("x12_daily_pooled_composite", " AND target % 20 = 0"),
        ("x11_agentic_variants", " AND target % 2 = 0"),
    ],
)
def test_factors_of_every_target(spark, queries, name, cut):
    df = queries[name](spark, D)
    got = spark_rows(df)
    assert got and got == duck(whole(cut, name), df.columns)


def test_correlations_of_every_symbol_and_month(spark, queries, tmp_path):
    for name, cuts in (("a19_j21_monthly_correlation_weights", (" WHERE year(dt) = 2000", " AND sym <= 20")), ("k2_s9_correlation_cache", ("a.sym <= 30 AND b.sym <= 30 AND ",))):
        for cut in cuts:
            text = whole(cut, name)
        df = queries[name](spark, "/root/testdata/sf0.01")
        got = spark_rows(df)
        assert got and got == duck(text, df.columns, "/root/testdata/sf0.01"), name


def test_expanding_correlations_agree_with_edges(spark):
    import datetime as dt
    import random

    from factorspark.operators.similarity import correlation_edges, expanding_correlation_edges
    from pyspark.sql import functions as F

    rng = random.Random(4)
    days = [dt.date(2000, m, 1) for m in range(1, 11)]
    rows = spark.createDataFrame([(d, s, 0.1 if s == 3 else rng.gauss(0, 1)) for d in days for s in range(9) if rng.random() < 0.7] + [(days[0], 99, None)], "dt date, sym long, ret double").cache()
    months = spark.createDataFrame([(f"m{k}", d) for k, d in enumerate(days)], "month string, upto date")
    got = {(r.month, r.target, r.peer): (r.n, r.corr) for r in expanding_correlation_edges(rows, months, 3, 4).collect()}
    want = {(f"m{k}", r.target, r.peer): (r.n, r.corr) for k, d in enumerate(days) for r in correlation_edges(rows.where(F.col("dt") <= d), 3).collect()}
    assert got.keys() == want.keys()
    assert all(got[k] == (n, None if c is None else pytest.approx(c, abs=1e-9)) for k, (n, c) in want.items())


@pytest.mark.parametrize(
    ("name", "cut"),
    [
        ("j7_asof_backward", " WHERE o_orderkey % 50 = 0"),
        ("v2_unpivot_wide", " WHERE o_orderkey % 10 = 0"),
        ("g5_filing_urls", " WHERE o_orderkey % 20 = 0"),
        ("s13_d9_graph_json", " WHERE l_orderkey % 100 = 0"),
        ("j18_u7_skip_existing", " WHERE o_custkey % 4 = 0"),
    ],
)
def test_orders_and_lines_are_read_whole(spark, queries, name, cut):
    df = queries[name](spark, D)
    got = spark_rows(df)
    assert got and got == duck(whole(cut, name), df.columns)
