"""Odd pages, long texts and stored maps: cases that were once slow, lost or doubled."""

import gzip
import re
import time

import pytest


@pytest.mark.parametrize("page", ["<a " * 350_000 + '"', '<a x="' * 170_000, "<p a='" * 170_000, "<div>x" * 60_000, "<b>" * 60_000 + "</i>" * 60_000, "</script" * 100_000, "<script " * 100_000])
def test_pages_are_read_in_linear_time(page):
    from factorspark.llm import htmltext as ht

    began = time.perf_counter()
    ht.blocks(page)
    assert time.perf_counter() - began < 8


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<p>a</p><script/>var x=1;</script><p>b</p>", ["a", "b"]),
        ("<p>E = <math><mi>m</mi></math>c</p>", ["E = mc"]),
        ("<article><noscript><p>n</p></noscript><object>o</object><canvas>c</canvas></article>", ["n", "oc"]),
        ("<p>x</p><xmp><b>raw</b> &amp;</xmp>y", ["x", "<b>raw</b> &amp;", "y"]),
        ('<p a=b"c>u</p><p d="e>v</p>', ["u", "v"]),
        ("<head><title>t</title><body><p>x", ["x"]),
        ("<b>" * 2000 + "<div>x</div>", ["x"]),
    ],
)
def test_odd_markup(page, want):
    from factorspark.llm import htmltext as ht

    assert [b.text for b in ht.blocks(page)] == want


def test_token_pieces_are_the_whole_text():
    import random

    from factorspark.llm import tokencount as tc

    rng = random.Random(1)
    enc = tc.encoder(tc.VOCABULARY)
    parts = ["word", "don't", " ", "  ", "\n", "42", "é", "漢字", "!?", "_", "a_b", "\t", "'s", "x y", "½"]
    for _ in range(40):
        text = "".join(rng.choice(parts) + rng.choice(("", " ")) for _ in range(300))
        cut = list(tc.pieces(text, 20))
        assert "".join(cut) == text and [t for p in cut for t in enc.encode_ordinary(p)] == enc.encode_ordinary(text)
    assert len(list(tc.pieces("one two three four " * 50, 20))) > 20


def test_decontamination_in_small_pieces(spark):
    import random

    import numpy as np
    import pyarrow as pa
    from factorspark.llm import decontam as dc
    from tests.llm.test_decontam import brute

    rng = random.Random(4)
    words = [f"w{k}" for k in range(30)]
    items = [(k, " ".join(rng.choice(words) for _ in range(rng.choice((2, 5, 8, 20))))) for k in range(30)]
    docs = []
    for k in range(40):
        body = [rng.choice(words) for _ in range(rng.choice((0, 5, 200)))]
        at = rng.randrange(len(body) + 1)
        body[at:at] = rng.choice(items)[1].split()
        docs.append((k, rng.choice((" ", "  \n")).join(body)))
    index = dc.build_index(items)
    maps = {w: dc._bitmap(x[0]) for w, x in index.sketch.items()}
    column = pa.array([t for _, t in docs])
    want = [(d, i, n) for d, i, _, n in brute(docs, items)]
    for piece in (16, 60, 10**9):
        assert sorted((r, index.ids[k], n) for r, k, n in dc.search(index, column, maps, piece)) == want
    assert [p.tobytes() for p in dc._pieces(np.frombuffer(b"aa bb cc dd", np.uint8), 2, 5)] == [b"aa bb", b"bb cc", b"cc dd"]


def test_warc_ids_are_unique(spark):
    from factorspark.llm import warc

    big = "y" * 3000
    data = [(1, "http://a/", big), (1, "http://b/", big), (2, "http://c/", big), (3, "http://d/", "small"), (3, "http://d/", "small"), (3, "http://d/", "x" * 600_000)]
    manifest, _ = warc.archive(spark.createDataFrame(data * 2, "page_id long, url string, html string"))
    raw = b"".join(gzip.open(r.path, "rb").read() for r in manifest.collect())
    ids, to = re.findall(rb"WARC-Record-ID: (\S+)", raw), re.findall(rb"WARC-Refers-To: (\S+)", raw)
    assert len(ids) == len(set(ids)) == 16 and len(to) == 4 and set(to) <= set(ids)


def test_a_stored_version_is_refused(spark, docs_of, tmp_path):
    from factorspark.llm import sharding as sd

    path = str(tmp_path / "map")
    one = sd.first_map(sd.slot_bytes(sd.sized(docs_of(["a", "b"]))), 4)
    sd.store_map(one, path)
    with pytest.raises(ValueError, match="version 1"):
        sd.store_map(one, path)
    assert sd.load_map(spark, path).count() == sd.SLOTS
    assert {r.map_version for r in sd.assign(docs_of(["c"] * 50), map_path=path).collect()} == {1}


def test_labels_of_other_documents_take_no_place(spark, docs_of):
    from factorspark.llm.training import labelled_sample

    labels = spark.range(20_000).selectExpr("id + 1000 AS doc_id", "1 AS toxic").unionAll(spark.range(20).selectExpr("id", "0"))
    docs = docs_of([(k, f"text {k}") for k in range(20)] * 50)
    got = labelled_sample(docs, labels, "toxic", rows=100)
    assert [i for i, *_ in got] == list(range(20))


def test_repeats_of_a_row_are_dealt_alike(spark):
    from factorspark.llm import mixing as mx

    rows = [(1, "a b c", "s")] * 9000 + [(k, "w " * (k % 7), "t") for k in range(2, 1500)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mx.mix(df).collect()
    assert len(got) == len(rows)
    many = [r for r in got if r.doc_id == 1]
    assert len(many) == 9000 and max(r.copies for r in many) - min(r.copies for r in many) <= 1
    assert abs(sum(r.taken for r in many) - many[0].target) <= 3
    assert mx.apply_mix(df).where("doc_id = 1").count() == sum(r.copies for r in many)


def test_a_host_of_many_labels_is_mined(spark):
    from factorspark.llm import urlfilter as uf

    host = ".".join(f"l{k}" for k in range(20))
    rows = [(f"http://{host}/a/b/c/d/e/{k}.php?p=1&q=2&r=3", 1) for k in range(25)] + [(f"http://good.com/x/{k}", 0) for k in range(200)]
    rules = uf.Rules(stated=(), mined=uf.mine(spark.createDataFrame(rows, "url string, bad int")))
    assert frozenset({f"host={host}"}) in {r[0] for r in rules.mined} and all(len(r[0]) == 1 for r in rules.mined)
    assert rules.judge(f"http://x.{host}/1")[3] == "block" and rules.judge("http://good.com/x/1")[3] == "allow"
