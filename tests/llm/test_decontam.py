import math
import random

from factorspark.llm import decontam as dc


def brute(docs, items):
    out = []
    for i, text in items:
        w = (text or "").encode().lower().split()
        n = min(5, len(w))
        want = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if n else set()
        for d, t in docs:
            v = (t or "").encode().lower().split()
            have = len(want & {tuple(v[k : k + n]) for k in range(len(v) - n + 1)}) if n else 0
            if want and have >= math.ceil(0.8 * len(want) - 1e-9):
                out.append((d, i, len(want), have))
    return sorted(out)


def fixture():
    rng = random.Random(2)
    words = [f"w{k}" for k in range(60)]
    items = [(k, " ".join(rng.choice(words) for _ in range(rng.choice((1, 2, 4, 5, 6, 12, 30, 70, 130))))) for k in range(40)] + [(90, ""), (91, None), (92, "W1  w2")]
    docs = []
    for k in range(120):
        body = [rng.choice(words) for _ in range(rng.choice((0, 3, 50, 400)))]
        if rng.random() < 0.7:
            part = (rng.choice(items)[1] or "").split()
            for _ in range(rng.choice((0, 0, 1, 2))):
                if part:
                    part[rng.randrange(len(part))] = "changed"
            at = rng.randrange(len(body) + 1)
            body[at:at] = [p.upper() if rng.random() < 0.2 else p for p in part]
        docs.append((k, rng.choice(" \t\n").join(body)))
    return docs + [(500, None), (501, ""), (0, docs[0][1])], items


def test_agrees_with_brute_force_in_any_blocks(spark, docs_of):
    docs, items = fixture()
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs, items)
    assert len(want) > 20
    for block in (10**6, 50):
        got = dc.containments(docs_of(docs, item_id=1, shared="x"), bench, block=block).collect()
        assert sorted((r.doc_id, r.item_id, r.item_shingles, r.shared) for r in got) == want
        assert all(abs(r.containment - r.shared / r.item_shingles) < 1e-12 for r in got)


def test_clean_documents_stay(spark, docs_of):
    docs, items = fixture()
    bench = spark.createDataFrame(items, "item_id long, text string")
    dirty = {d for d, *_ in brute(docs, items)}
    df = docs_of(docs)
    kept = dc.decontaminate(df, bench)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(d for d, _ in docs if d not in dirty)


def test_empty_tables(spark, docs_of):
    none = spark.createDataFrame([], "item_id long, text string")
    df = docs_of(["a b c d e f"])
    assert dc.containments(df, none).count() == 0
    assert dc.decontaminate(df, none).count() == 1
    assert dc.containments(df.where("false"), spark.createDataFrame([(1, "a b")], "item_id long, text string")).count() == 0


def test_a_very_long_text(spark, docs_of):
    item = "alpha beta gamma delta epsilon zeta eta"
    long = "filler " * 300_000 + item + " filler" * 10
    got = dc.containments(docs_of([long, "x" * 3_000_000]), spark.createDataFrame([(4, item)], "item_id long, text string")).collect()
    assert [(r.doc_id, r.item_id) for r in got] == [(0, 4)]
