import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from factorspark.llm import toxicity as tx
from factorspark.llm.training import held_out, labelled_sample

WORDS = [f"{a}{b}{c}" for a in ("ka", "lo", "mi", "ter") for b in ("na", "shi", "or") for c in ("en", "ve", "du")]


def corpus(n=900, seed=0):
    rng = random.Random(seed)
    out = []
    for k in range(n):
        sentences = [" ".join(rng.choice(WORDS) for _ in range(rng.randint(2, 12))) for _ in range(rng.choice((1, 3, 20)))]
        bad = k % 6 == 0
        if bad:
            for _ in range(rng.choice((1, 2))):
                j = rng.randrange(len(sentences))
                sentences[j] += " " + rng.choice(("badword", "wretchen", "wretchly", "Wretching"))
        out.append((k, rng.choice((". ", "! ", "\n")).join(sentences), int(bad)))
    return out


@pytest.fixture(scope="module")
def model():
    return tx.fit([(t, y) for i, t, y in corpus() if i % 4])


def test_held_out_accuracy_and_spans(model):
    rows = [(t, y) for i, t, y in corpus() if i % 4 == 0]
    p, n, spans = tx.score(model, pa.array([t for t, _ in rows]))
    wrong = sum((s >= 0.3) != bool(y) for s, (_, y) in zip(p, rows, strict=True))
    assert wrong <= 0.02 * len(rows)
    assert ((p >= 0) & (p <= 1)).all()
    for row, a, b, _ in spans:
        part = rows[row][0].encode()[a:b].lower()
        assert b"badword" in part or b"wretch" in part
        assert not any(c in part.rstrip(b".!?\n") for c in b".!?\n")


def test_sentence_counts():
    texts = ["", "a", "a. b! c? d\ne", "...", "a..b", " . x", "no end", "é. ñ"]
    data, offs = tx.parted(pa.array(texts))
    assert tx.sentences(data, offs)[1].tolist() == [0, 1, 5, 0, 2, 1, 1, 2]


def test_scores_do_not_depend_on_neighbours_or_pieces(model, monkeypatch):
    texts = [t for _, t, _ in corpus(60, 9)] + ["", "x", "badword"]
    together = tx.score(model, pa.array(texts))[0]
    alone = np.array([tx.score(model, pa.array([t]))[0][0] for t in texts])
    assert np.allclose(together, alone)
    from factorspark.llm import textvec

    monkeypatch.setattr(textvec, "PIECE", 64)
    assert np.allclose(tx.score(model, pa.array(texts))[0], together)


def test_noisy_or_by_hand(model):
    text = "kanaen badword. lonaen badword. mishive"
    parts = [tx.score(model, pa.array([s]))[0][0] for s in ("kanaen badword", "lonaen badword", "mishive")]
    whole = tx.score(model, pa.array([text]))[0][0]
    rest = np.prod([(1 - p) / (1 - model.leak) for p in parts]) * (1 - model.leak)
    assert abs(whole - (1 - rest)) < 1e-9


def test_query_table(spark, docs_of, model):
    df = docs_of([(0, "kanaen badword"), (1, None), (2, ""), (None, "lonaen"), (2, ""), (3, "badword " * 200_000)], score="clash", toxic=1)
    got = tx.score_table(df, model).collect()
    assert len(got) == 6
    for r in got:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert r.predicted == int(r.score >= 0.3)
    assert {r.doc_id for r in got if r.predicted} == {0, 3}
    kept = tx.drop_toxic(df, model)
    assert kept.columns == df.columns and kept.count() == 4
    assert tx.score_table(df.where("false"), model).count() == 0


def test_labels_of_the_held_out_quarter_teach_nothing(spark, docs_of):
    rows = corpus(200)
    df = docs_of([(i, t) for i, t, _ in rows])
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (7, None)], "doc_id long, toxic int")
    flipped = labels.withColumn("toxic", (labels.toxic + held_out().cast("int")) % 2)
    a, b = tx.train(df, labels), tx.train(df, flipped)
    assert np.array_equal(a.keys, b.keys) and np.array_equal(a.weights, b.weights) and a.bias == b.bias
    ids = {i for i, _, _ in labelled_sample(df, labels, "toxic", ~held_out())}
    assert ids and all(zlib.crc32(str(i).encode()) % 4 != 2 for i in ids)


def test_sample_is_bounded_and_whole(spark, docs_of):
    rows = [(k, "w" * (k % 50)) for k in range(500)] + [(600, "z" * 10_000)]
    df = docs_of(rows)
    labels = spark.createDataFrame([(i, i % 2) for i, _ in rows] * 2, "doc_id long, toxic int")
    got = labelled_sample(df, labels, "toxic", rows=100, size=900)
    assert 0 < len(got) <= 100 and sum(len(t) for *_, t in got) <= 900
    assert all(dict(rows)[i] == t for i, _, t in got)
    assert got == labelled_sample(df.repartition(7), labels, "toxic", rows=100, size=900)


def test_no_labels(spark, docs_of):
    df = docs_of(["a b", "c"])
    m = tx.train(df, spark.createDataFrame([], "doc_id long, toxic int"))
    assert {r.score for r in tx.score_table(df, m).collect()} and all(abs(r.score - 0.05) < 0.01 for r in tx.score_table(df, m).collect())
