"""SimHash near-duplicates through a byte-position inverted index with count filtering.

A 64-bit fingerprint is eight positional bytes. Two fingerprints within four bits share at least four
of them, the guaranteed minimum. Postings by single bytes would bring N^2 / 512 pairs together, so this
is a variant of that index: since four shared bytes of eight are at least three of any seven, each
distinct fingerprint is posted under all 35 triples of its first seven positional bytes, which loses no
pair. Where two meet, all their shared positional bytes are tallied, pairs under the guaranteed four are
dropped, and the rest are verified by their differing bits. A posting of over ``POSTING`` members is posted again under sextuples of the nibbles
left free, after which only 16 bits are free and a list has at most 65,536 members whatever the input.
Each list gives the edges of a spanning forest, never all its pairs, which loses no component.

Defined cases: a null or empty text has fingerprint zero and links like any other; repeated rows and
copies share a fingerprint and are one node; a row without id takes part and its component is named by
the least id found, null if the component has none; columns other than id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factorspark.llm.graph import components
from factorspark.llm.runtime import cut, hot_join, row_key
from factorspark.llm.textvec import PIECE, Pair, buffers

WIDTH = 4
SEED = 42
BITS = 4
BYTES = 8
POSTING = 2048
_TRIPLES = list(combinations(range(7), 3))
_SPACES = b" \t\n\r\x0b\x0c"


def _tally(words: list[bytes], width: int) -> tuple[np.ndarray, int]:
    """Per bit the number of shingles that set it, most significant first, and the number of shingles."""
    line = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(sizes) - 1
    starts = ends - sizes + 1
    n = max(1, len(words) - width + 1)
    last = ends[width - 1 :] if len(words) >= width else ends[-1:]
    digest = xxhash.xxh64_digest
    raw = b"".join([digest(line[a:b], SEED) for a, b in zip(starts[:n].tolist(), last.tolist(), strict=True)])
    return np.unpackbits(np.frombuffer(raw, np.uint8)).reshape(n, 64).sum(axis=0, dtype=np.int64), n


def fingerprint(text: bytes, width: int = WIDTH) -> int:
    """The signed 64-bit SimHash of one text; long texts are worked off piece by piece."""
    counts, total, carry, a = np.zeros(64, np.int64), 0, [], 0
    while a < len(text):
        b = min(a + PIECE, len(text))
        while b < len(text) and text[b - 1] not in _SPACES:
            b += 1
        carry += text[a:b].lower().split()
        a = b
        if len(carry) >= width:
            part, n = _tally(carry, width)
            counts += part
            total += n
            carry = carry[len(carry) - width + 1 :]
    if not total and carry:
        counts, total = _tally(carry, width)
    if not total:
        return 0
    return int(np.packbits(2 * counts > total).view(">i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, key, fp) per row; key tells rows of one id but other texts apart."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = buffers(batch.column(2))
            raw, cuts = data.tobytes(), offs.tolist()
            found = np.fromiter((fingerprint(raw[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)), np.int64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found)], ["doc_id", "key", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), row_key(id_col, text_col).alias("key"), F.col(text_col).alias("text"))
    return rows.mapInArrow(scan, "doc_id long, key long, fp long")


def _close(x: np.ndarray, bits: int) -> np.ndarray:
    """Verdict on XORs of fingerprints: enough positional bytes shared, then few enough bits differ."""
    shared = (x[..., None].view(np.uint8) == 0).sum(axis=-1)
    return (shared >= BYTES - bits) & (np.bitwise_count(x) <= bits)


def _forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Least index reachable from each of n nodes over edges (i, j)."""
    label = np.arange(n)
    while len(i):
        one, two = label[i], label[j]
        np.minimum.at(label, np.maximum(one, two), np.minimum(one, two))
        while (label != (up := label[label])).any():
            label = up
        keep = label[i] != label[j]
        i, j = i[keep], j[keep]
    return label


def _small(keys: np.ndarray, fps: np.ndarray, bits: int) -> Pair:
    """Forest edges of complete lists lying one after the other, compared at growing shifts."""
    ends = np.searchsorted(keys, keys, "right")
    left = [np.zeros(0, np.int64)]
    right = [np.zeros(0, np.int64)]
    at, shift = np.arange(len(keys)), 1
    while len(at := at[at + shift < ends[at]]):
        ok = at[_close(fps[at] ^ fps[at + shift], bits)]
        left.append(ok)
        right.append(ok + shift)
        shift += 1
    label = _forest(len(keys), np.concatenate(left), np.concatenate(right))
    hung = np.flatnonzero(label != np.arange(len(keys)))
    return fps[hung], fps[label[hung]]


def _dense(fps: np.ndarray, bits: int) -> Pair:
    """Forest edges of one list whose members differ in 16 known bits at most: masks instead of pairs."""
    spread = np.bitwise_or.reduce(fps ^ fps[0])
    free = [b for b in range(64) if spread >> np.uint64(b) & np.uint64(1)]
    if len(free) > 16:  # two lists under one hashed key
        return _small(np.zeros(len(fps), np.int64), fps, bits)
    low = np.zeros(len(fps), np.int64)
    for k, b in enumerate(free):
        low |= ((fps >> np.uint64(b)) & np.uint64(1)).astype(np.int64) << k
    place = np.full(1 << len(free), -1, np.int64)
    place[low] = np.arange(len(fps))
    left, right = [], []
    for r in range(1, min(bits, len(free)) + 1):
        for bs in combinations(range(len(free)), r):
            to = place[low ^ sum(1 << b for b in bs)]
            ok = np.flatnonzero(to > np.arange(len(fps)))
            left.append(ok)
            right.append(to[ok])
    label = _forest(len(fps), np.concatenate(left), np.concatenate(right))
    hung = np.flatnonzero(label != np.arange(len(fps)))
    return fps[hung], fps[label[hung]]


def _lists(limit: int | None, bits: int):
    """Reader of (key, fp) rows sorted by key: edges of each list; lists over the limit pass on, marked."""
    names = ["u", "v", "hot"]

    def edges(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array(np.zeros(len(a), bool))], names)

    def passed(keys: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(fps.view(np.int64)), pa.array(np.ones(len(keys), bool))], names)

    def settle(keys: np.ndarray, fps: np.ndarray) -> Iterator[pa.RecordBatch]:
        sizes = np.diff(np.append(np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]), len(keys)))
        size_of = np.repeat(sizes, sizes)
        keys, fps, size_of = keys[size_of > 1], fps[size_of > 1], size_of[size_of > 1]
        large = size_of > POSTING
        if len(keys) and (~large).any():
            yield edges(*_small(keys[~large], fps[~large], bits))
        for key in np.unique(keys[large]):
            some = large & (keys == key)
            yield passed(keys[some], fps[some]) if limit else edges(*_dense(fps[some], bits))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count, hot = [], 0, None
        for batch in batches:
            keys, fps = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
            if hot is not None:
                n = int(np.searchsorted(keys, hot, "right"))
                if n:
                    yield passed(keys[:n], fps[:n])
                keys, fps = keys[n:], fps[n:]
                if not len(keys):
                    continue
                hot = None
            if not len(keys):
                continue
            held.append((keys, fps))
            count += len(keys)
            keys, fps = (np.concatenate(x) for x in zip(*held, strict=True))
            open_at = int(np.searchsorted(keys, keys[-1], "left"))
            yield from settle(keys[:open_at], fps[:open_at])
            keys, fps = keys[open_at:], fps[open_at:]
            if limit and len(keys) > limit:
                hot = keys[0]
                yield passed(keys, fps)
                held, count = [], 0
            else:
                held, count = [(keys, fps)], len(keys)
        if count:
            yield from settle(*(np.concatenate(x) for x in zip(*held, strict=True)))

    return scan


def _byte(p: int):
    return F.shiftrightunsigned("fp", 8 * p).bitwiseAND(F.lit(255).cast("long"))


def links(nodes: DataFrame, bits: int = BITS, posting: int = POSTING) -> DataFrame:
    """Forest edges (u, v) between distinct fingerprints (column fp) that differ in ``bits`` or fewer."""
    keys = [F.lit(k << 24).cast("long") + _byte(a) * 65536 + _byte(b) * 256 + _byte(c) for k, (a, b, c) in enumerate(_TRIPLES)]
    posted = nodes.select(F.explode(F.array(*keys)).alias("key"), "fp")
    found = cut(posted.repartition("key").sortWithinPartitions("key").mapInArrow(_lists(posting, bits), "u long, v long, hot boolean"))
    edges, hot = found.where("NOT hot").select("u", "v"), found.where("hot").select(F.col("u").alias("key"), F.col("v").alias("fp"))
    if hot.isEmpty():
        return edges
    finer = []
    for k, triple in enumerate(_TRIPLES):
        nibbles = [n for b in range(8) if b not in triple for n in (2 * b, 2 * b + 1)]
        for six in combinations(nibbles, 6):
            mask = sum(15 << (4 * n) for n in six) | sum(255 << (8 * b) for b in triple)
            finer.append((k, mask - (1 << 64) if mask >> 63 else mask))
    per = [F.array(*[F.xxhash64(F.lit(m), F.col("fp").bitwiseAND(F.lit(m).cast("long"))) for q, m in finer if q == k]) for k in range(len(_TRIPLES))]
    chosen = F.lit(None).cast("array<bigint>")
    for k, a in enumerate(per):
        chosen = F.when(F.shiftrightunsigned("key", 24) == k, a).otherwise(chosen)
    again = hot.select(F.explode(chosen).alias("key"), "fp").distinct()
    more = again.repartition("key").sortWithinPartitions("key").mapInArrow(_lists(None, bits), "u long, v long, hot boolean")
    return edges.unionAll(more.select("u", "v"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = BITS) -> DataFrame:
    """(doc_id, key, fp, label, component_id) per row; label is the component's least fingerprint.

    Names go from components to fingerprints and on to rows; a component or fingerprint that holds a large
    share of them is broadcast, so its members are never dealt to one task.
    """
    rows = cut(fingerprints(docs, id_col, text_col))
    nodes = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")))
    labels = cut(components(links(nodes.select("fp"), bits)).withColumnsRenamed({"node": "fp"}))
    linked = cut(nodes.join(labels, "fp"))
    groups = cut(linked.groupBy("label").agg(F.min("rep").alias("component_id"), F.count("*").alias("m")))
    named = hot_join(linked, groups, "label", "m").select("fp", "n", "label", "component_id")
    alone = nodes.join(labels, "fp", "left_anti").select("fp", "n", F.col("fp").alias("label"), F.col("rep").alias("component_id"))
    facts = cut(named.unionByName(alone))
    return hot_join(rows, facts, "fp", "n").select("doc_id", "key", "fp", "label", "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = BITS) -> DataFrame:
    """One row of each component stays: the least id, a row without id only where no other has one.

    Rows are matched by their 64-bit key of id and text and by the id itself, so repeats of one id with
    other texts are told apart. Rows equal in both fall to one, which one is open, first in their own
    partitions; whole rows travel in one struct, whatever their columns are called.
    """
    found = near_duplicates(docs, id_col, text_col, bits)
    best = found.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("best"))
    best = best.select("best.key", "best.none", F.coalesce("best.doc_id", F.lit(0)).alias("id"))
    own = F.col(id_col).cast("long")
    packed = docs.select(F.struct("*").alias("row"), row_key(id_col, text_col).alias("key"), own.isNull().alias("none"), F.coalesce(own, F.lit(0)).alias("id"))
    once = packed.groupBy("key", "none", "id").agg(F.first("row").alias("row"))
    return once.join(best, ["key", "none", "id"], "left_semi").select("row.*")
