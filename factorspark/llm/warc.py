"""WARC archives through a chunked record table.

Payloads are cut into (record id, chunk number) rows of at most ``CHUNK`` bytes that carry the SHA-1 of
the payload so far; the last one's is the payload's. A digest's records of at least ``SMALLEST`` bytes
have one response, the greatest id, which the others revisit. Chunk rows are dealt by record and sorted
by (record, chunk); a writer turns each into a gzip member of its own as it comes, so it holds one
chunk: the first chunk of a payload is its response record, later ones are continuation records with
segment numbers, the last with the total length. Writers put archives in the shared folder under names
unique to the attempt and return them as rows, so the manifest names the archives of successful tasks
only. Readers stream the archives of the manifest member by member and never hold a payload.

Defined cases: a null or empty payload has no bytes and is a response record; a null URL is written as
``urn:null``; equal payloads of under ``SMALLEST`` bytes are all responses; repeated ids and repeated rows
are written and read each in turn, under names of their own (the nth record of an id and payload), and a
revisit refers to the first; columns besides id, URL and payload are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factorspark.llm.runtime import HOT, arrow_uri, cut, new_dir

CHUNK = 256 << 10
SMALLEST = 1000
ARCHIVE = 64 << 20
CHUNKS = "record_id long, url string, payload_sha1 string, seq long, chunk_no long, data binary, sha1 string, last boolean"


def chunks(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", size: int = CHUNK, bare: dict[str, int] | None = None) -> DataFrame:
    """(record_id, url, payload_sha1, seq, chunk_no, data, sha1 so far, last) rows; seq tells repeated rows apart.

    ``bare`` gives the response's id of payloads that very many records share: of these only the response
    has its bytes cut into rows, any other a single row without data that ends with the payload's digest.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in CHUNKS.split(", ")]
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.string(), pa.bool_()]
        for batch in batches:
            rows, held = [], 0
            for *own, payload in zip(*(batch.column(k).to_pylist() for k in range(4)), batch.column(4), strict=True):
                buf = payload.as_buffer()
                view = memoryview(buf) if buf is not None else memoryview(b"")
                if bare and own[2] in bare and own[0] != bare[own[2]]:
                    rows.append((*own, 0, b"", own[2], True))
                    continue
                sha = hashlib.sha1()
                for k in range(max(1, -(-len(view) // size))):
                    part = bytes(view[k * size : (k + 1) * size])
                    sha.update(part)
                    rows.append((*own, k, part, sha.hexdigest(), (k + 1) * size >= len(view)))
                    held += len(part)
                    if held >= 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                        rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    return pages.select(F.col(id_col).cast("long").alias("record_id"), F.col(url_col).cast("string").alias("url"), F.sha1(payload).alias("payload_sha1"), F.monotonically_increasing_id().alias("seq"), payload.alias("payload")).mapInArrow(scan, CHUNKS)


def originals(pages: DataFrame, id_col: str = "page_id", payload_col: str = "html", smallest: int = SMALLEST) -> DataFrame:
    """(record_id, payload_bytes, sha1, refers_to) per row; refers_to is null for responses."""
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    own = cut(pages.select(F.col(id_col).cast("long").alias("record_id"), F.octet_length(payload).cast("long").alias("payload_bytes"), F.sha1(payload).alias("sha1")))
    large = own.where(F.col("payload_bytes") >= smallest)
    shared = cut(large.groupBy("sha1").agg(F.max("record_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("sha1", "first"))
    first = F.when((F.col("payload_bytes") >= smallest) & ~F.col("first").eqNullSafe(F.col("record_id")), F.col("first"))
    return own.join(shared, "sha1", "left").select("record_id", "payload_bytes", "sha1", first.alias("refers_to"))


def _uuid(record_id: object, sha1: str, nth: int = 0, part: int = 0) -> str:
    """Name of a part of the nth record with this id and payload."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{record_id}/{sha1}/{nth}/{part}')}>"


def _member(headers: list[tuple[str, object]], body: bytes, level: int) -> bytes:
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers) + f"Content-Length: {len(body)}\r\n\r\n"
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(head.encode()) + packer.compress(body) + packer.compress(b"\r\n\r\n") + packer.flush()


def _clean(url: str | None) -> str:
    return "urn:null" if url is None else "".join(c if c.isprintable() and c != " " else f"%{ord(c):02X}" for c in url)


def write(rows: DataFrame, path: str, size: int = ARCHIVE, level: int = 1) -> DataFrame:
    """Writes sorted chunk rows with their ``payload_bytes``, ``payload_sha1`` and ``refers_to``.

    Returns the manifest (path, records, bytes). ``path`` is a URI that pyarrow's file systems know.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(path)
        out, name, records, count = None, "", 0, 0
        own, nth = None, 0
        for batch in batches:
            for r in batch.select(["record_id", "url", "chunk_no", "last", "payload_bytes", "payload_sha1", "refers_to"]).to_pylist():
                r["data"] = batch.column("data")[count].as_buffer() if r["refers_to"] is None else b""
                count += 1
                if r["refers_to"] is not None and r["chunk_no"]:
                    continue
                if not r["chunk_no"]:
                    nth = nth + 1 if own == (r["record_id"], r["payload_sha1"]) else 0
                    own = (r["record_id"], r["payload_sha1"])
                if out is not None and out.tell() >= size and not r["chunk_no"]:
                    out.close()
                    yield pa.RecordBatch.from_pylist([{"path": name, "records": records, "bytes": fs.get_file_info(name).size}])
                    out, records = None, 0
                if out is None:
                    fs.create_dir(root, recursive=True)
                    name = f"{root}/{uuid.uuid4().hex}.warc.gz"
                    out = fs.open_output_stream(name, compression=None)
                first, whole = r["chunk_no"] == 0, r["last"] and r["chunk_no"] == 0
                kind = "revisit" if r["refers_to"] is not None else "response" if first else "continuation"
                head = [("WARC-Type", kind), ("WARC-Record-ID", _uuid(*own, nth, r["chunk_no"])), ("WARC-Date", "1970-01-01T00:00:00Z"), ("WARC-Target-URI", _clean(r["url"])), ("X-Record", r["record_id"])]
                if first:
                    head += [("WARC-Payload-Digest", f"sha1:{r['payload_sha1']}"), ("X-Payload-Length", r["payload_bytes"]), ("Content-Type", "text/html")]
                if kind == "revisit":
                    head += [("WARC-Refers-To", _uuid(r["refers_to"], r["payload_sha1"])), ("X-Refers-To", r["refers_to"]), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
                elif not whole:
                    head.append(("WARC-Segment-Number", r["chunk_no"] + 1))
                    if not first:
                        head.append(("WARC-Segment-Origin-ID", _uuid(*own, nth)))
                    if r["last"]:
                        head.append(("WARC-Segment-Total-Length", r["payload_bytes"]))
                out.write(_member(head, bytes(r["data"]), level))
                records += 1
            count = 0
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pylist([{"path": name, "records": records, "bytes": fs.get_file_info(name).size}])

    return rows.mapInArrow(scan, "path string, records long, bytes long")


def _blocks(stream, step: int = 1 << 16) -> Iterator[bytes]:
    """Decompressed bytes of concatenated gzip members."""
    unpack = zlib.decompressobj(31)
    while got := stream.read(step):
        while got:
            yield unpack.decompress(got)
            got = unpack.unused_data
            if unpack.eof:
                unpack = zlib.decompressobj(31)


def _records(blocks: Iterator[bytes]) -> Iterator[tuple[dict[str, str], Iterator[bytes]]]:
    """(headers, pieces of the block) of each record; pieces must be used up before the next record."""
    held = bytearray()
    while True:
        while (end := held.find(b"\r\n\r\n")) < 0:
            more = next(blocks, None)
            if more is None:
                if held.strip():
                    raise ValueError("an archive ends inside a record's header")
                return
            held += more
        head = dict(x.split(": ", 1) for x in held[:end].decode().split("\r\n")[1:])
        del held[: end + 4]
        left = int(head["Content-Length"])

        def body(left: int = left) -> Iterator[bytes]:
            while left:
                if not held:
                    more = next(blocks, None)
                    if more is None:
                        raise ValueError("an archive ends inside a record's block")
                    held.extend(more)
                part = bytes(held[:left])
                del held[: len(part)]
                left -= len(part)
                yield part

        yield head, body()
        while len(held) < 4:
            held += next(blocks)
        del held[:4]


def read(manifest: DataFrame, path: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, segments) of the archives.

    Digest and length of a response are computed from its segments as they stream by and held against
    its header; a revisit has those that its header states.
    """
    kinds = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64(), "segments": pa.int64()}

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = pafs.FileSystem.from_uri(path)
        number = lambda v: None if v in (None, "None") else int(v)

        def close(open_):
            head, sha, n, parts = open_
            if head["WARC-Type"] == "response" and (f"sha1:{sha.hexdigest()}" != head["WARC-Payload-Digest"] or n != int(head["X-Payload-Length"])):
                raise ValueError(f"record {head['X-Record']} does not have the payload that its header states")
            return (number(head["X-Record"]), int(head["X-Payload-Length"]), head["WARC-Payload-Digest"][5:], head["WARC-Type"], number(head.get("X-Refers-To")), parts)

        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows, now = [], None
                with fs.open_input_stream(name, compression=None) as stream:
                    for head, body in _records(_blocks(stream)):
                        if head["WARC-Type"] != "continuation":
                            if now:
                                rows.append(close(now))
                            now = (head, hashlib.sha1(), 0, 0)
                        n = now[2]
                        for part in body:
                            now[1].update(part)
                            n += len(part)
                        now = (now[0], now[1], n, now[3] + 1)
                        if len(rows) >= 5000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds.values(), strict=True)], list(kinds))
                            rows = []
                if now:
                    rows.append(close(now))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds.values(), strict=True)], list(kinds))

    return manifest.select("path").mapInArrow(scan, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, segments long")


def archive(pages: DataFrame, path: str | None = None, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", size: int = CHUNK) -> tuple[DataFrame, str]:
    """Writes one record per row into archives below ``path``; returns the manifest and the path."""
    path = arrow_uri(path or new_dir(pages.sparkSession, "warc"))
    own = originals(pages, id_col, payload_col)
    facts = cut(own.select(F.col("record_id").alias("__id"), "payload_bytes", F.col("sha1").alias("__sha1"), "refers_to").distinct())
    again = F.col("refers_to").isNotNull()
    largest = facts.where(again).groupBy("__sha1").agg(F.count("*").alias("n")).where(F.col("n") * HOT > facts.count())
    bare = {r["__sha1"]: r["first"] for r in facts.join(largest, "__sha1").where(again).groupBy("__sha1").agg(F.max("refers_to").alias("first")).collect()}  # fewer than HOT digests
    rows = chunks(pages, id_col, url_col, payload_col, size, bare)
    same = F.coalesce(F.col("record_id") == F.col("__id"), F.col("record_id").isNull() & F.col("__id").isNull()) & (F.concat("payload_sha1", F.lit("")) == F.concat("__sha1", F.lit("")))
    hashed = lambda i, d: F.xxhash64(i, d).alias("__k")
    rows = rows.select("*", hashed("record_id", "payload_sha1")).repartition("__k")  # a record and its repeats stay together
    joined = rows.join(facts.select("*", hashed("__id", "__sha1")), "__k").where(same)
    joined = joined.select("record_id", "url", "seq", "chunk_no", "data", "last", "payload_bytes", "payload_sha1", "refers_to")
    return cut(write(joined.sortWithinPartitions("record_id", "payload_sha1", "seq", "chunk_no"), path)), path
