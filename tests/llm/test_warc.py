import glob
import gzip
import hashlib

import pytest
from factorspark.llm import warc


def rows():
    big = "é" * 700_000
    return [
        (1, "http://a/x y\r\n", "<p>" + "same " * 300),
        (2, "http://b/", "<p>" + "same " * 300),
        (9, "http://c/", "<p>" + "same " * 300),
        (3, None, None),
        (4, "http://d/", ""),
        (5, "http://e/", "tiny"),
        (6, "http://f/", "tiny"),
        (7, "http://g/", big),
        (8, "http://h/", big),
        (10, "http://i/", "WARC/1.1\r\n\r\nContent-Length: 3\r\n\r\n" * 50),
        (11, "http://j/", "repeated"),
        (11, "http://j/", "repeated"),
        (12, "http://k/", "x" * 999),
        (13, "http://k/", "x" * 999),
        (14, "http://l/", "y" * 600_000),
        (14, "http://l/", "z" * 600_000),
        (None, "http://n/", "no id at all"),
    ]


def want(data):
    heads = {}
    for i, _, t in data:
        heads[t or ""] = max((x for x in (heads.get(t or ""), i) if x is not None), default=None)
    out = []
    for i, _, t in data:
        raw = (t or "").encode()
        again = len(raw) >= 1000 and heads[t or ""] != i
        out.append((i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if again else "response", heads[t] if again else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("chunk", [256 << 10, 5000])
def test_round_trip(spark, chunk):
    data = rows()
    df = spark.createDataFrame([(*r, "clash") for r in data], "page_id long, url string, html string, sha1 string")
    manifest, path = warc.archive(df, size=chunk)
    got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read(manifest, path).collect()]
    assert sorted(got, key=repr) == want(data)


def test_archives_are_plain_warc(spark):
    df = spark.createDataFrame(rows(), "page_id long, url string, html string").coalesce(1)
    manifest, _ = warc.archive(df, size=100_000)
    seen = {}
    for r in manifest.collect():
        assert not glob.glob(r.path + ".tmp*")
        raw = gzip.open(r.path, "rb").read()
        at = n = 0
        while at < len(raw):
            end = raw.index(b"\r\n\r\n", at)
            head = dict(x.split(": ", 1) for x in raw[at:end].decode().split("\r\n")[1:])
            assert raw[at:end].startswith(b"WARC/1.1\r\n")
            size = int(head["Content-Length"])
            assert size <= 100_000
            seen.setdefault(head["X-Record"], []).append((int(head.get("WARC-Segment-Number", 1)), raw[end + 4 : end + 4 + size], head))
            at = end + 4 + size
            assert raw[at : at + 4] == b"\r\n\r\n"
            at += 4
            n += 1
        assert n == r.records
    parts = sorted(seen["8"], key=lambda p: p[0])
    assert b"".join(p[1] for p in parts).decode() == "é" * 700_000 and len(parts) == 14
    assert parts[-1][2]["WARC-Segment-Total-Length"] == "1400000" and parts[1][2]["WARC-Type"] == "continuation"
    assert seen["7"][0][2]["X-Refers-To"] == "8" and seen["7"][0][1] == b""


def test_chunks_carry_digests_so_far(spark):
    df = spark.createDataFrame([(1, "u", "abcdefghij")], "page_id long, url string, html string")
    got = sorted(warc.chunks(df, size=4).collect(), key=lambda r: r.chunk_no)
    assert [bytes(r.data) for r in got] == [b"abcd", b"efgh", b"ij"] and [r.last for r in got] == [False, False, True]
    assert [r.sha1 for r in got] == [hashlib.sha1(b"abcdefghij"[:n]).hexdigest() for n in (4, 8, 10)]


def test_damage_is_found(spark):
    df = spark.createDataFrame([(1, "u", "abc" * 100)], "page_id long, url string, html string")
    manifest, path = warc.archive(df)
    file = manifest.first().path
    raw = gzip.open(file, "rb").read().replace(b"abcabc", b"abcabd", 1)
    with open(file, "wb") as f:
        f.write(gzip.compress(raw))
    with pytest.raises(Exception, match="does not have the payload"):
        warc.read(manifest, path).collect()


def test_empty_table(spark):
    manifest, path = warc.archive(spark.createDataFrame([], "page_id long, url string, html string"))
    assert warc.read(manifest, path).count() == 0
