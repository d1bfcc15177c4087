"""Token counts by a separator scan of flat token files.

A flat file is nothing but token ids of a fixed width, each document ended by one end-of-document id;
there is no index. Files are read in blocks of ``BLOCK`` bytes, wherever those fall: each block is
searched for the id in one vectorised comparison and gives one row, the token counts of the documents
that end in it and the place of its last separator. A prefix scan over a file's block rows (running
maximum of last separators, running sum of separators) then gives each block what its first document has
before the block and that document's ordinal; the scan carries four numbers a block, never its counts. ``write_flat`` makes such files from a table with a public
byte-level vocabulary and returns the order of ids as rows, since the files themselves have none.

Defined cases: a null or empty text has 0 tokens; tokens after the last separator are a document that is
not closed; an empty file gives no rows; a file whose size isn't a multiple of the width is an error;
repeated rows and ids are counted each.
"""

from __future__ import annotations

import base64
import re
import uuid
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factorspark.llm.runtime import arrow_uri, cut, new_dir, stored

BLOCK = 4 << 20
FILE = 128 << 20
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
EOD = 50256
WIDTH = 2
PIECE = 1 << 20
_CUT = re.compile(r"[^\W_] (?=[^\W_])")
_KINDS = {2: "<u2", 4: "<u4"}
_ENCODERS: dict[str, object] = {}


def encoder(path: str, content: bytes | None = None):
    """The encoder of a vocabulary file, or of its content where the file isn't at hand; one a worker."""
    if path not in _ENCODERS:
        import tiktoken

        lines = (Path(path).read_bytes() if content is None else content).splitlines()
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        _ENCODERS[path] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[path]


def pieces(text: str, size: int = PIECE) -> Iterator[str]:
    """A text in pieces of about ``size`` characters, cut before a lone space between two words.

    The pattern always ends a token there, so the pieces' tokens are the text's.
    """
    a = 0
    while len(text) - a > size:
        m = _CUT.search(text, a + size)
        if m is None:
            break
        yield text[a : m.start() + 1]
        a = m.start() + 1
    yield text[a:]


def write_flat(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, eod: int = EOD, width: int = WIDTH, size: int = FILE) -> tuple[DataFrame, str]:
    """Tokenizes texts into flat files; returns (path, ordinal, doc_id, bytes) rows and the folder.

    The row that has ``bytes`` closes a file and has no ordinal. Names are unique to the attempt, so
    only files of successful tasks are in the rows.
    """
    path = arrow_uri(path or new_dir(docs.sparkSession, "tokens"))
    content = docs.sparkSession.sparkContext.broadcast(Path(vocabulary).read_bytes())  # a vocabulary, whatever the input
    names = ["path", "ordinal", "doc_id", "bytes"]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64()]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(path)
        tokens = encoder(vocabulary, content.value)
        out, name, n, rows = None, "", 0, []

        def flush() -> pa.RecordBatch:
            got = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)
            rows.clear()
            return got

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if out is None:
                    fs.create_dir(root, recursive=True)
                    name, n = f"{root}/{uuid.uuid4().hex}.bin", 0
                    out = fs.open_output_stream(name, compression=None)
                for part in pieces(text.as_py() or ""):
                    out.write(np.array(tokens.encode_ordinary(part), _KINDS[width]).tobytes())
                out.write(np.array([eod], _KINDS[width]).tobytes())
                rows.append((name, n, doc_id, None))
                n += 1
                if out.tell() >= size:
                    rows.append((name, None, None, out.tell()))
                    out.close()
                    out = None
            if rows:
                yield flush()
        if out is not None:
            rows.append((name, None, None, out.tell()))
            out.close()
            yield flush()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(scan, "path string, ordinal long, doc_id long, bytes long")
    return stored(rows, "token-order"), path


def _blocks(root: str, eod: int, width: int, block: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = pafs.FileSystem.from_uri(root)
        for batch in batches:
            for r in batch.to_pylist():
                start = r["block"] * block
                with fs.open_input_file(r["path"]) as f:
                    raw = f.read_at(min(block, r["bytes"] - start), start)
                if len(raw) % width:
                    raise ValueError(f"{r['path']} does not hold whole tokens")
                ids = np.frombuffer(raw, _KINDS[width])
                at = np.flatnonzero(ids == eod)
                counts = np.diff(at, prepend=-1) - 1
                tail = len(ids) - (int(at[-1]) + 1 if len(at) else 0)
                open_ = start + len(raw) >= r["bytes"]
                if open_ and (tail or not len(at)):
                    counts = np.append(counts, tail)
                base = start // width
                last = base + int(at[-1]) if len(at) else None
                yield pa.RecordBatch.from_arrays([pa.array([r["path"]]), pa.array([r["block"]], pa.int64()), pa.array([base], pa.int64()), pa.array([last], pa.int64()), pa.array([len(at)], pa.int64()), pa.array([counts.tolist()], pa.list_(pa.int64()))], ["path", "block", "base", "last", "ended", "counts"])

    return scan


def scan_flat(files: DataFrame, root: str, eod: int = EOD, width: int = WIDTH, block: int = BLOCK) -> DataFrame:
    """(path, ordinal, n_tokens, closed) of every document in the files of (path, bytes) rows."""
    block -= block % width
    parts = files.where("bytes > 0").select("path", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("bytes") - 1) / block))).alias("block"))
    found = parts.repartition("path", "block").mapInArrow(_blocks(root, eod, width, block), "path string, block long, base long, last long, ended long, counts array<long>")
    found = cut(found)
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    scanned = found.select("path", "block", "ended", (F.col("base") - F.coalesce(F.max("last").over(before) + 1, F.lit(0))).alias("carried"), F.coalesce(F.sum("ended").over(before), F.lit(0)).alias("first"))
    each = found.select("path", "block", "counts").join(scanned, ["path", "block"]).select("path", "first", "carried", "ended", F.posexplode("counts").alias("k", "n"))
    n = F.col("n") + F.when(F.col("k") == 0, F.col("carried")).otherwise(0)
    got = each.select("path", (F.col("first") + F.col("k")).alias("ordinal"), n.alias("n_tokens"), (F.col("k") < F.col("ended")).alias("closed"))
    return got.where("closed OR n_tokens > 0")


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, block: int = BLOCK) -> DataFrame:
    """(doc_id, n_tokens) per row, by writing flat files and scanning them."""
    order, root = write_flat(docs, None, id_col, text_col, vocabulary)
    found = scan_flat(order.where("bytes IS NOT NULL").select("path", "bytes"), root, block=block)
    ids = order.where("ordinal IS NOT NULL").select("path", "ordinal", "doc_id")
    # the stored order is small as a file and large as rows, so the planner's size estimate must not broadcast it
    return ids.hint("merge").join(found, ["path", "ordinal"]).select("doc_id", "n_tokens")
