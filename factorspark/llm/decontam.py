"""Benchmark decontamination: size-partitioned MinHash containment search, verified exactly.

An item leaks into a document when at least ``THRESHOLD`` of its distinct five-word shingles occur in
the document. Jaccard-style signatures of the document are useless here, since a long document drowns
a short item; the sketch is therefore kept on the item's side. Items are partitioned by the size of
their shingle set (powers of two), and an item of a partition with at most u shingles keeps the
k = u - ceil(t u) + 1 least MinHash values of its set (all, if it has fewer). An item of q <= u
shingles may miss q - ceil(t q) < k of them, so a true containment always hits its sketch at least
k - (q - ceil(t q)) times: candidates are exact in recall. Each is verified by the shingles' strings.

The benchmark is taken in blocks of at most ``BLOCK`` shingles, sorted by id, so what goes to the tasks
has a fixed bound. One block is a narrow pass within the reader's plan; of more, each is a pass of its own
whose finds are stored before the next begins, so that driver and tasks hold one block at a time. A text
is searched in pieces of about ``PIECE`` bytes that overlap by a shingle less a word.

Defined cases: words are runs of bytes outside {0x20, 0x09-0x0D}, A-Z folded; an item of one to four
words is one shingle of that many words; an item without words never matches; null texts are empty;
repeated documents or items are reported each; other columns are passed over, and kept as they are
where documents are filtered.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factorspark.llm.runtime import filtered, new_dir, whole_key
from factorspark.llm.textvec import IS_SPACE, buffers, shingles, slices, words

WIDTH = 5
THRESHOLD = 0.8
BLOCK = 500_000
PIECE = 8 << 20


@dataclass
class Index:
    """Sketches of one block of items; arrays of all widths are keyed by the width."""

    ids: list
    sizes: np.ndarray
    need: np.ndarray
    least_hits: np.ndarray
    sketch: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]
    strings: list[frozenset[bytes]]
    widths: list[int]


def _shingle_strings(text: bytes, width: int) -> tuple[list[bytes], int]:
    found = text.lower().split()
    width = min(width, len(found))
    return [b" ".join(found[i : i + width]) for i in range(len(found) - width + 1)] if width else [], width


def build_index(items: list[tuple[object, str | None]], threshold: float = THRESHOLD, width: int = WIDTH) -> Index:
    """Index of (id, text) items; needs no more memory than their distinct shingles."""
    ids, sets, widths = [], [], []
    for item_id, text in items:
        strings, w = _shingle_strings((text or "").encode("utf-8", "surrogatepass"), width)
        if strings:
            ids.append(item_id)
            sets.append(frozenset(strings))
            widths.append(w)
    sizes = np.array([len(s) for s in sets], np.int64)
    need = np.array([math.ceil(threshold * n - 1e-9) for n in sizes.tolist()], np.int64)
    least = np.zeros(len(ids), np.int64)
    posts: dict[int, list[tuple[int, int]]] = {}
    for k, found in enumerate(sets):
        upper = (1 << len(found).bit_length()) - 1
        length = min(len(found), upper - math.ceil(threshold * upper - 1e-9) + 1)
        line = b"\n".join(found)
        data, offs = np.frombuffer(line, np.uint8), np.cumsum([0, *(len(x) + 1 for x in found)])
        offs[-1] -= 1
        _, _, h, firsts = words(data, offs)
        minhash = np.unique(shingles(h, firsts, widths[k])[0])[:length]
        least[k] = max(1, len(minhash) - (len(found) - need[k]))
        posts.setdefault(widths[k], []).extend((int(x), k) for x in minhash)
    sketch = {}
    for w, pairs in posts.items():
        pairs.sort()
        keys, starts = np.unique(np.array([p[0] for p in pairs], np.uint64), return_index=True)
        sketch[w] = (keys, np.append(starts, len(pairs)), np.array([p[1] for p in pairs], np.int64))
    return Index(ids, sizes, need, least, sketch, sets, widths)


def _bitmap(keys: np.ndarray) -> np.ndarray:
    out = np.zeros(1 << 20, bool)
    out[(keys >> np.uint64(44)).astype(np.int64)] = True
    return out


def _hits(index: Index, data: np.ndarray, offs: np.ndarray, maps: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
    """By width the distinct (row, place of a sketch value) pairs in texts laid one after the other."""
    _, _, hashes, firsts = words(data, offs)
    out = {}
    for width, (keys, _, _) in index.sketch.items():
        hs, at = shingles(hashes, firsts, width)
        some = np.flatnonzero(maps[width][(hs >> np.uint64(44)).astype(np.int64)])
        place = np.searchsorted(keys, hs[some])
        hit = (place < len(keys)) & (keys[np.minimum(place, len(keys) - 1)] == hs[some])
        some, place = some[hit], place[hit]
        if len(some):
            row = np.searchsorted(firsts, at[some], "right") - 1
            out[width] = np.unique(np.stack([row, place], 1), axis=0)
    return out


def _pieces(text: np.ndarray, width: int, size: int) -> Iterator[np.ndarray]:
    """The bytes of a long text in pieces that end between words and begin ``width`` - 1 words before the last one's end."""
    a, end, step = 0, len(text), size
    while True:
        b = min(a + step, end)
        while b < end and not IS_SPACE[text[b]]:
            ahead = np.flatnonzero(IS_SPACE[text[b : b + size]])
            b = b + int(ahead[0]) if len(ahead) else min(b + size, end)
        if b >= end:
            yield text[a:]
            return
        back, left = b, width - 1
        while left and back > a:
            while back > a and IS_SPACE[text[back - 1]]:
                back -= 1
            while back > a and not IS_SPACE[text[back - 1]]:
                back -= 1
            left -= 1
        if back <= a:  # too few words for a shingle and a step
            step *= 2
            continue
        yield text[a:b]
        a, step = back, size


def search(index: Index, column: pa.Array, maps: dict[int, np.ndarray], piece: int = PIECE) -> list[tuple[int, int, int]]:
    """(row, item, shared shingles) of every containment in a string column."""
    data, offs = buffers(column)
    if not index.sketch:
        return []
    widest = max(index.sketch)
    long = np.diff(offs) > piece
    cut = {int(r): data[offs[r] : offs[r + 1]] for r in np.flatnonzero(long)}
    found: dict[int, list[np.ndarray]] = {w: [np.zeros((0, 2), np.int64)] for w in index.sketch}
    if not long.all():
        kept = np.flatnonzero(~long)
        if long.any():
            short = np.concatenate([data[offs[r] : offs[r + 1]] for r in kept])
            got = _hits(index, short, np.concatenate([[0], np.cumsum(np.diff(offs)[kept])]), maps)
        else:
            got = _hits(index, data, offs, maps)
        for w, pairs in got.items():
            found[w].append(np.stack([kept[pairs[:, 0]], pairs[:, 1]], 1))
    for r, text in cut.items():
        for part in _pieces(text, widest, piece):
            for w, pairs in _hits(index, part, np.array([0, len(part)]), maps).items():
                pairs[:, 0] = r
                found[w].append(pairs)
    out = []
    for width, (_, cuts, items) in index.sketch.items():
        tally: dict[tuple[int, int], int] = {}
        for r, p in np.unique(np.concatenate(found[width]), axis=0).tolist():
            for k in items[cuts[p] : cuts[p + 1]].tolist():
                tally[r, k] = tally.get((r, k), 0) + 1
        by_row: dict[int, list[int]] = {}
        for (r, k), n in tally.items():
            if n >= index.least_hits[k]:
                by_row.setdefault(r, []).append(k)
        for r, ks in by_row.items():
            wanted = frozenset().union(*(index.strings[k] for k in ks))
            there: set[bytes] = set()
            for part in _pieces(data[offs[r] : offs[r + 1]], width, piece):
                toks = part.tobytes().lower().split()
                there.update(g for i in range(len(toks) - width + 1) if (g := b" ".join(toks[i : i + width])) in wanted)
            out.extend((r, k, n) for k in ks if (n := len(index.strings[k] & there)) >= index.need[k])
    return sorted(out)


def blocks(benchmark: DataFrame, id_col: str, text_col: str, threshold: float, size: int = BLOCK) -> Iterator[Index]:
    """Indexes of at most ``size`` shingles, or one item; the driver holds one block at a time."""
    held, count = [], 0
    for row in benchmark.select(id_col, text_col).sort(id_col).toLocalIterator():
        n = len((row[1] or "").split())
        if held and count + n > size:
            yield build_index(held, threshold)
            held, count = [], 0
        held.append((row[0], row[1]))
        count += n
    if held:
        yield build_index(held, threshold)


def _found(rows: DataFrame, index: Index, spec: str) -> DataFrame:
    """(own, item_id, item_shingles, shared, containment) of each find of one block in (own, text) rows."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maps = {w: _bitmap(x[0]) for w, x in index.sketch.items()}
        for batch in batches:
            for part in slices(batch, "text"):
                hits = search(index, part.column(1), maps)
                if hits:
                    own = part.column(0).take(pa.array([h[0] for h in hits]))
                    size = [int(index.sizes[h[1]]) for h in hits]
                    shared = [h[2] for h in hits]
                    yield pa.RecordBatch.from_arrays([own, pa.array([index.ids[h[1]] for h in hits], pa.int64()), pa.array(size, pa.int64()), pa.array(shared, pa.int64()), pa.array([a / b for a, b in zip(shared, size, strict=True)])], ["own", "item_id", "item_shingles", "shared", "containment"])

    return rows.mapInArrow(scan, spec)


def _finds(rows: DataFrame, first: Index, rest: Iterator[Index]) -> DataFrame:
    """Finds of all blocks in (own, text) rows; those of more than one block are stored block by block."""
    spec = "own long, item_id long, item_shingles long, shared long, containment double"
    second = next(rest, None)
    if second is None:
        return _found(rows, first, spec)
    path = new_dir(rows.sparkSession, "contained")
    for index in chain((first, second), rest):
        _found(rows, index, spec).write.mode("append").parquet(path)
    return rows.sparkSession.read.schema(spec).parquet(path)


def containments(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """(doc_id, item_id, item_shingles, shared, containment) of every item found in a document."""
    rows = docs.select(F.col(id_col).cast("long").alias("own"), F.col(text_col).alias("text"))
    rest = blocks(benchmark, item_col, item_text, threshold, block)
    first = next(rest, None)
    if first is None:
        return docs.sparkSession.createDataFrame([], "doc_id long, item_id long, item_shingles long, shared long, containment double")
    return _finds(rows, first, rest).withColumnRenamed("own", "doc_id")


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """The documents, all columns kept, in which no item is contained.

    With one block of items rows are filtered where they are read; with more, the finds' rows are taken
    out by the key of all their columns.
    """
    rest = blocks(benchmark, item_col, item_text, threshold, block)
    first = next(rest, None)
    if first is None:
        return docs
    second = next(rest, None)
    if second is not None:
        rows = docs.select(whole_key(docs).alias("own"), F.col(text_col).alias("text"))
        dirty = _finds(rows, first, chain((second,), rest)).select("own").distinct()
        return docs.select(F.struct("*").alias("row"), whole_key(docs).alias("own")).join(dirty, "own", "left_anti").select("row.*")

    def verdict():
        maps = {w: _bitmap(x[0]) for w, x in first.sketch.items()}

        def clean(column: pa.Array) -> np.ndarray:
            out = np.ones(len(column), bool)
            out[[h[0] for h in search(first, column, maps)]] = False
            return out

        return clean

    return filtered(docs, text_col, verdict)
