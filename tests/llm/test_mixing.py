import random
from collections import defaultdict

import numpy as np
import pytest
from factorspark.llm import mixing as mx


def water_fill(sizes):
    """Targets by the stated rounds: share by weight, stop at three times, reshare the excess."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (1, 2, 3)[k % 3] for k, s in enumerate(order)}
    total, full, target = sum(sizes.values()), set(), {}
    while True:
        rest = total - sum(3 * sizes[s] for s in full)
        free = [s for s in order if s not in full]
        for s in free:
            target[s] = rest * weight[s] / sum(weight[x] for x in free)
        over = [s for s in free if target[s] > 3 * sizes[s]]
        if not over:
            return {**target, **{s: 3.0 * sizes[s] for s in full}}
        full.update(over)


def table(spark, n=3000, seed=1):
    rng = random.Random(seed)
    sources = ["a", "B", "é", "zz", None, "tiny", "none"]
    rows = []
    for k in range(n):
        s = rng.choices(sources, (50, 5, 10, 10, 10, 1, 0))[0]
        rows.append((k, " ".join(["w"] * rng.choice((0, 1, 5, 30, 200))), s))
    rows += [(n, "", "none"), (n + 1, None, "none"), (None, "a b c", "a"), (None, "a b c", "a"), (7, "w w", "B"), (7, "w w", "B")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string"), rows


@pytest.mark.parametrize("bucket", [4096, 50, 7])
def test_totals_caps_and_reruns(spark, bucket):
    df, rows = table(spark)
    got = mx.mix(df.withColumn("size", df.doc_id), bucket=bucket).collect()
    assert len(got) == len(rows)
    sizes, count = defaultdict(int), defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
        count[s] += 1
    want = water_fill(sizes)
    by_size = {v: want[s] for s, v in sizes.items()}
    taken, copies = defaultdict(int), defaultdict(int)
    for r in got:
        assert r.taken == r.copies * r.size and 0 <= r.copies <= 3
        assert abs(r.target - by_size[r.source_size]) < 1e-6
        taken[r.source_size] += r.taken
        copies[r.source_size] += r.copies
    for s, v in sizes.items():
        assert abs(taken[v] - want[s]) <= 200, (s, taken[v], want[s])
        if v:
            assert abs(copies[v] - count[s] * want[s] / v) <= 2.5
    again = mx.mix(df.repartition(7), bucket=bucket).collect()
    key = lambda r: (r.doc_id is None, r.doc_id, r.key, r.copies)
    assert sorted(map(key, got)) == sorted(map(key, again))


def test_flight_keeps_both_totals():
    rng = np.random.default_rng(0)
    size, x = rng.integers(0, 500, 400), rng.random(400)
    y = mx.flight(size, x, 3, False)
    assert ((y > 1e-9) & (y < 1 - 1e-9)).sum() <= 2
    assert abs(y.sum() - x.sum()) < 1e-6 and abs((size * y).sum() - (size * x).sum()) < 1e-4
    z = mx.flight(size, x, 3, True)
    assert set(np.round(z, 9)) <= {0.0, 1.0}
    flat = mx.flight(np.full(50, 9), np.full(50, 0.5), 1, True)
    assert flat.sum() == 25


def test_rows_are_taken_as_often_as_decided(spark):
    df, rows = table(spark, 300, 4)
    df = df.selectExpr("doc_id", "text", "'en' AS lang", "source", "0L AS n_chars", "1 AS copies_", "2 AS key")
    got = mx.apply_mix(df)
    assert got.columns == df.columns
    decided = mx.mix(df).collect()
    assert got.count() == sum(r.copies for r in decided)
    assert got.select(mx.word_count("text").alias("n")).groupBy().sum("n").first()[0] == sum(r.taken for r in decided)


def test_empty_table(spark):
    df, _ = table(spark, 5)
    assert mx.mix(df.where("false")).count() == 0 and mx.apply_mix(df.where("false")).count() == 0


def test_word_count(spark):
    rows = [(0, None), (1, ""), (2, " \t\n\v\f\r"), (3, "a b c\nd"), (4, " x")]
    got = spark.createDataFrame(rows, "i int, t string").select("i", mx.word_count("t").alias("n")).collect()
    assert [r.n for r in sorted(got)] == [len((t or "").encode().split()) for _, t in rows]
