import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from factorspark.llm import quality as ql


def brute(text):
    t = text or ""
    w = t.encode().split()
    grams = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
    count = Counter(grams)
    hit = {k + j for k, g in enumerate(grams) if count[g] > 1 for j in range(5)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if line.encode().split():
            dup += line in seen
            seen.add(line)
    chars = sum(c not in " \t\n\v\f\r" for c in t)
    return [len(w), chars, sum(c in "#*$%&|<>" for c in t), dup, len(hit)]


def texts():
    rng = random.Random(4)
    out = ["", None, " \n\t", "a b c d e a b c d e", "x\nx\n\n \nx", "é # ñ | <b>", "same words " * 40, "a b c d e f\na b c d e f"]
    for _ in range(200):
        out.append("".join(rng.choice(("ab ", "c ", "\n", "d", "é", "# ", "\t")) for _ in range(rng.randint(0, 80))))
    return out


def test_base_figures_agree_with_brute_force():
    rows = texts()
    got = ql.base(pa.array(rows))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    assert np.stack([got[n] for n in names], 1).tolist() == [brute(t) for t in rows]


def page(rng, good):
    words = [rng.choice(("river", "stone", "market", "window", "garden", "letter")) for _ in range(rng.randint(12, 60))]
    if good:
        return " ".join(words) + "."
    return " ".join(w.upper() + "!!" if rng.random() < 0.9 else w + "$$$" for w in words)


@pytest.fixture(scope="module")
def model():
    rng = random.Random(1)
    return ql.fit([(page(rng, k % 4 > 0), int(k % 4 > 0)) for k in range(400)])


def test_held_out_accuracy_and_calibration(model):
    rng = random.Random(8)
    rows = [(page(rng, k % 4 > 0), k % 4 > 0) for k in range(200)]
    p = model.probability(pa.array([t for t, _ in rows]))
    assert sum((x >= 0.5) != y for x, (_, y) in zip(p, rows, strict=True)) <= 2
    assert abs(p.mean() - 0.75) < 0.08


def test_scores_do_not_depend_on_pieces(model, monkeypatch):
    rows = texts() + ["river stone " * 500]
    whole = model.probability(pa.array(rows))
    alone = np.array([model.probability(pa.array([t], pa.string()))[0] for t in rows])
    assert np.allclose(whole, alone)
    from factorspark.llm import textvec

    monkeypatch.setattr(textvec, "PIECE", 50)
    assert np.allclose(model.probability(pa.array(rows)), whole)


def test_table(docs_of, model):
    rows = texts() + ["river stone market window garden letter and then some more words here", "W!! " * 300_000]
    got = sorted(ql.judge(docs_of(rows, n_words="clash"), model).collect(), key=lambda r: r.doc_id)
    assert len(got) == len(rows)
    for r, t in zip(got, rows, strict=True):
        n, *_, rep = b = brute(t)
        assert [r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words] == b
        assert r.base_failed == (n < 10 or 100 * rep > 20 * n)
        assert r.kept == (not r.base_failed and r.probability >= ql.THRESHOLD)
    assert got[-2].kept and not got[-1].kept
    assert ql.judge(docs_of(["a"]).where("false"), model).count() == 0


def test_one_class_or_no_labels(spark, docs_of):
    df = docs_of(["some words that are long enough to pass all of the base rules"])
    empty = spark.createDataFrame([], "doc_id long, quality int")
    assert ql.judge(df, ql.train(df, empty)).first().kept
    bad = spark.createDataFrame([(0, 0)], "doc_id long, quality int")
    assert not ql.judge(df, ql.train(df, bad)).first().kept
