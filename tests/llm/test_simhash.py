import random

import numpy as np
import pytest
import xxhash
from factorspark.llm import simhash as sh
from factorspark.llm.graph import components


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows):
    """doc_id -> least id reachable over fingerprints within four bits."""
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if (rows[a][1] ^ rows[b][1]).bit_count() <= 4:
                parent[max(find(a), find(b))] = min(find(a), find(b))
    least = {}
    for k, (i, _) in enumerate(rows):
        least[find(k)] = min(least.get(find(k), i), i)
    return {i: least[find(k)] for k, (i, _) in enumerate(rows)}


def noisy(rng, words, n):
    out = list(words)
    for _ in range(n):
        out[rng.randrange(len(out))] = f"w{rng.randrange(9999)}"
    return " ".join(out)


@pytest.mark.parametrize("text", [None, "", " \t\n", "one", "One two\vthree", "é È a b c d e", "x " * 5000, "a b c d"])
def test_fingerprint_of_odd_texts(text):
    assert sh.fingerprint((text or "").encode()) % 2**64 == brute_fingerprint(text)


def test_fingerprint_in_pieces(monkeypatch):
    text = " ".join(f"w{k % 97}" for k in range(400))
    whole = sh.fingerprint(text.encode())
    monkeypatch.setattr(sh, "PIECE", 61)
    assert sh.fingerprint(text.encode()) == whole == np.uint64(brute_fingerprint(text)).astype(np.int64)


def test_components_agree_with_brute_force(docs_of):
    rng = random.Random(3)
    base = [[f"w{rng.randrange(500)}" for _ in range(120)] for _ in range(12)]
    texts = [noisy(rng, b, rng.choice((0, 0, 1, 1, 2, 3))) for b in base for _ in range(12)] + ["", None, " ", "same text here"] * 3
    rows = [(k * 7 % len(texts), t) for k, t in enumerate(texts)]
    df = docs_of(rows, component_id="clash", fp="clash")
    got = {r.doc_id: r for r in sh.near_duplicates(df).collect()}
    want = brute_components([(i, brute_fingerprint(t)) for i, t in rows])
    assert {i: r.component_id for i, r in got.items()} == want
    assert all(r.fp % 2**64 == brute_fingerprint(dict(rows)[i]) for i, r in got.items())


def test_hot_postings_lose_no_link(spark):
    rng = random.Random(5)
    centre = rng.getrandbits(64)
    fps = {centre}
    for _ in range(700):
        x = rng.choice(list(fps)) if rng.random() < 0.3 else centre
        for b in rng.sample(range(64), rng.choice((1, 2, 3, 4, 6))):
            x ^= 1 << b
        fps.add(x)
    fps |= {rng.getrandbits(64) for _ in range(300)}
    signed = [int(np.uint64(x).astype(np.int64)) for x in sorted(fps)]
    nodes = spark.createDataFrame([(x,) for x in signed], "fp long")
    label = {r.node: r.label for r in components(sh.links(nodes, posting=40)).collect()}
    parent = {x: x for x in signed}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, a in enumerate(signed):
        for b in signed[:k]:
            if ((a ^ b) % 2**64).bit_count() <= 4:
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    assert {x: label.get(x, x) for x in signed} == {x: find(x) for x in signed}


def test_dense_list_uses_masks_exactly():
    rng = np.random.default_rng(1)
    fps = np.unique(rng.integers(0, 1 << 16, 3000).astype(np.uint64) << np.uint64(8))
    a, b = sh._dense(fps, 2)
    label = {int(x): int(x) for x in fps}
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        label[x] = y
    i, j = np.nonzero(np.triu(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 2, 1))
    want = fps[sh._forest(len(fps), i, j)]
    assert [label[int(x)] for x in fps] == want.tolist()


def test_one_of_each_group_stays(docs_of):
    df = docs_of([(5, "a b c d e f g h"), (2, "a b c d e f g h"), (2, "a b c d e f g h"), (None, "a b c d e f g h"), (9, "other words are here now"), (9, "yet more of the other kind"), (None, "nobody else has these words"), (7, None)])
    kept = sorted((r.doc_id if r.doc_id is not None else -1, r.text or "") for r in sh.drop_near_duplicates(df).collect())
    assert kept == [(-1, "nobody else has these words"), (2, "a b c d e f g h"), (7, ""), (9, "other words are here now"), (9, "yet more of the other kind")]
    assert sh.drop_near_duplicates(df).columns == df.columns


def test_empty_table(docs_of):
    df = docs_of(["x"]).where("false")
    assert sh.near_duplicates(df).count() == 0 and sh.drop_near_duplicates(df).count() == 0


def test_components_of_a_long_path_and_a_star(spark):
    path = [(k, k + 1) for k in range(300)]
    star = [(1000, 1001 + k) for k in range(200)]
    got = dict(components(spark.createDataFrame([*path, *star, (5, 5), (3, 2)], "u long, v long")).collect())
    assert got == {**{k: 0 for k in range(301)}, **{1000 + k: 1000 for k in range(201)}}
