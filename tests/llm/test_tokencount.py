import random

import numpy as np
import pytest
from factorspark.llm import tokencount as tc


def expected(ids, eod=9):
    out, n = [], 0
    for t in ids:
        if t == eod:
            out.append((n, True))
            n = 0
        else:
            n += 1
    return out + ([(n, False)] if n else [])


@pytest.mark.parametrize("block", [2, 6, 64, 1 << 20])
@pytest.mark.parametrize("width", [2, 4])
def test_scan_agrees_with_a_loop(spark, tmp_path, block, width):
    rng = random.Random(block + width)
    files, want = [], {}
    for k, n in enumerate((0, 1, 2, 50, 400, 37)):
        ids = [rng.choice((9, 1, 2, 3, 4)) for _ in range(n)] if k < 4 else [1] * n + [9] * (k % 2)
        p = tmp_path / f"{k}.bin"
        p.write_bytes(np.array(ids, f"<u{width}").tobytes())
        files.append((str(p), p.stat().st_size))
        want[str(p)] = expected(ids)
    df = spark.createDataFrame(files, "path string, bytes long")
    got: dict = {}
    for r in tc.scan_flat(df, f"file://{tmp_path}", 9, width, max(block, width)).collect():
        got.setdefault(r.path, {})[r.ordinal] = (r.n_tokens, r.closed)
    assert {p: [got.get(p, {})[k] for k in sorted(got.get(p, {}))] for p in want} == want
    assert all(sorted(v) == list(range(len(v))) for v in got.values())


def test_counts_agree_with_the_tokenizer(docs_of):
    texts = ["", None, "one two", "naïve café\n\n\n x", "<|endoftext|> is text", "word " * 5000, "same", "same"]
    df = docs_of([*enumerate(texts), (None, "no id"), (3, "again")], n_tokens="clash")
    enc = tc.encoder(tc.VOCABULARY)
    want = sorted((i is None, i or 0, len(enc.encode_ordinary(t or ""))) for i, t in [*enumerate(texts), (None, "no id"), (3, "again")])
    for block in (64, tc.BLOCK):
        got = tc.count_tokens(df, block=block).collect()
        assert sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens) for r in got) == want


def test_partial_token_is_an_error(spark, tmp_path):
    p = tmp_path / "x.bin"
    p.write_bytes(b"abc")
    with pytest.raises(Exception, match="whole tokens"):
        tc.scan_flat(spark.createDataFrame([(str(p), 3)], "path string, bytes long"), f"file://{tmp_path}").collect()


def test_empty_table(docs_of):
    assert tc.count_tokens(docs_of(["a"]).where("false")).count() == 0
