import pytest
from factorspark.llm import urlfilter as uf


@pytest.mark.parametrize(
    ("url", "want"),
    [
        (None, ("", "")),
        ("", ("", "")),
        ("no scheme/x", ("", "")),
        ("http://A.Example.NET/En/1?q#f", ("a.example.net", "/En/1")),
        ("x://y", ("y", "")),
        ("x://y?z/w", ("y", "")),
        ("x://y#z://w", ("y", "")),
        ("://h/p", ("h", "/p")),
        ("a://b://c", ("b:", "//c")),
        ("http://É.org/", ("É.org", "/")),
    ],
)
def test_split(url, want):
    assert uf.split(url) == want


@pytest.mark.parametrize(
    ("url", "rule", "verdict"),
    [
        ("http://x.net/a", "net/", "block"),
        ("http://net/a", "net/", "block"),
        ("http://xnet/a", None, "allow"),
        ("http://x.net", None, "allow"),
        ("http://m.example.net/en/1", "example.net/en/", "allow"),
        ("http://m.example.net/enx", "net/", "block"),
        ("http://badexample.com/de/1", None, "allow"),
        ("http://www.example.com/de/1", "example.com/de/", "block"),
        ("http://a.org/fr/2", "org/fr/", "allow"),
        ("http://a.org/FR/2", None, "allow"),
    ],
)
def test_stated_rules(url, rule, verdict):
    assert uf.Rules().judge(url)[2:4] == (rule, verdict)


def test_mined_rules_find_planted_combinations(spark):
    rows = []
    for k in range(2000):
        host = ("alpha", "beta", "gamma", "casino")[k % 4]
        ext, key = (".php", ".html")[k // 4 % 2], ("id", "ref")[k // 8 % 2]
        bad = host == "casino" or (ext == ".php" and key == "ref" and host != "alpha")
        rows.append((f"http://www.{host}.com/en/{k}{ext}?{key}={k}", int(bad if k % 50 else not bad)))
    df = spark.createDataFrame(rows + [(None, 1), ("http://x.com/", None), ("junk", 1)], "url string, bad int")
    rules = uf.Rules(stated=(), mined=uf.mine(df))
    assert any(r[0] == {"host=casino.com"} for r in rules.mined)
    assert all(c >= uf.CONFIDENCE and n >= uf.SUPPORT for _, c, n in rules.mined)
    verdict = lambda u: rules.judge(u)[3]
    assert verdict("http://m.casino.com/x") == "block" and verdict("http://www.beta.com/en/1.php?ref=2") == "block"
    assert verdict("http://www.alpha.com/en/1.html?id=2") == "allow" and verdict(None) == "allow"


def test_index_matches_like_subset_tests():
    rules = uf.Rules(stated=(), mined=[(frozenset({"host=a.com", "ext=php"}), 0.9, 50), (frozenset({"host=com"}), 0.8, 40)])
    for url in ("http://a.com/x.php", "http://a.com/x", "http://b.com/x.php", "http://b.org/x.php"):
        fired = [k for k, (items, *_) in enumerate(rules.mined) if items <= set(uf.tokens(url))]
        assert rules.judge(url)[4] == (min(fired) if fired else None)


def test_nothing_to_mine(spark):
    assert uf.mine(spark.createDataFrame([], "url string, bad int")) == []
    assert uf.mine(spark.createDataFrame([("http://a.b/c", 0)] * 100, "url string, bad int")) == []


def test_table_and_labels(spark):
    df = spark.createDataFrame([(1, "http://a.net/en/7.html?x=1", "c"), (1, "http://a.net/en/7.html?x=1", "c"), (2, None, "c"), (None, "http://b.org/fr/8#t", "c"), (4, "http://c.com/" + "x" * 100_000, "c")], "page_id long, url string, host string")
    got = uf.judge_table(df, uf.Rules()).collect()
    assert len(got) == 5 and [r.verdict for r in got if r.page_id == 1] == ["block"] * 2
    labels = spark.createDataFrame([(7, 0, 0), (8, 1, 0), (8, 1, None)], "doc_id long, quality int, toxic int")
    assert sorted((r.url[:12], r.bad) for r in uf.labelled_urls(df, labels).collect()) == [("http://a.net", 1), ("http://a.net", 1), ("http://b.org", 0)]
    assert uf.judge_table(df.where("false"), uf.Rules()).count() == 0


def test_many_bad_hosts_are_all_blocked(spark):
    rows = [(f"http://www.some-long-spam-host-name-{h}.example.com/en/{k}.php?id={k}&ref=1", 1) for h in range(80) for k in range(20)]
    rows += [(f"http://www.good.example.com/en/{k}.php?id={k}&ref=1", 0) for k in range(3000)]
    rules = uf.Rules(stated=(), mined=uf.mine(spark.createDataFrame(rows, "url string, bad int")))
    assert all(rules.judge(f"http://m.some-long-spam-host-name-{h}.example.com/x")[3] == "block" for h in range(80))
    assert rules.judge("http://www.good.example.com/en/1.php?id=1&ref=1")[3] == "allow"
    assert all(len(items) == 1 for items, *_ in rules.mined)


def test_deeper_path_parts_are_mined(spark):
    rows = [(f"http://a.com/en/{('casino', 'news')[k % 2]}/{k}", 1 - k % 2) for k in range(400)]
    rules = uf.Rules(stated=(), mined=uf.mine(spark.createDataFrame(rows, "url string, bad int")))
    assert rules.judge("http://b.org/de/x/casino/9")[3] == "block" and rules.judge("http://a.com/en/news/9")[3] == "allow"


def test_kept_sets_agree_with_brute_force(spark):
    import itertools
    import random

    rng = random.Random(3)
    sets = [(sorted(s), round(rng.uniform(0.6, 1), 3), 20) for n in range(1, 5) for s in itertools.combinations("abcdef", n) if rng.random() < 0.7]
    want = []
    for items, c, n in sets:
        if not any(k <= set(items) and least >= c - 0.05 for k, least, _ in want):
            want.append((frozenset(items), c, n))
    df = spark.createDataFrame([(i, "\n".join(i), c, n) for i, c, n in sets], "items array<string>, key string, confidence double, bad long")
    got = uf._minimal(df, 4)
    assert sorted(map(repr, ((sorted(k), c, n) for k, c, n in got))) == sorted(map(repr, ((sorted(k), c, n) for k, c, n in want)))
