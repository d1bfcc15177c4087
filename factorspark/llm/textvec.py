"""Vectorised words and shingles over the raw buffers of Arrow string columns.

Words are the maximal runs of bytes outside {0x20, 0x09-0x0D}; hashing folds A-Z to a-z. A word's
hash is a polynomial in random 64-bit byte codes with wrapping arithmetic, so one cumulative sum
hashes every word of a buffer. Buffers are worked off in pieces of about ``PIECE`` bytes that end at
white space or a text's end; what grows with the buffer is 24 bytes a word.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

PIECE = 1 << 19
Pair = tuple[np.ndarray, np.ndarray]
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_STEP = np.uint64(0xD6E8FEB86659FD93)

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_CODE = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_CODE_LOWER = _CODE[LOWER]


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> Pair:
    if n in _POWERS:
        return _POWERS[n]
    up = np.full(n + 1, _BASE, np.uint64)
    down = np.full(n + 1, _BASE_INV, np.uint64)
    up[0] = down[0] = 1
    got = np.multiply.accumulate(up), np.multiply.accumulate(down)
    if n <= PIECE + 4096:
        _POWERS[n] = got
    return got


def powers(n: int) -> Pair:
    return _powers(PIECE + 4096 if n <= PIECE + 4096 else 1 << n.bit_length())


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser: spreads a polynomial value over all 64 bits."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(32))


def buffers(column: pa.Array) -> Pair:
    """Bytes and offsets of a string column; a null is an empty text."""
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(offsets, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offs - offs[0]


def pieces(data: np.ndarray, offs: np.ndarray):
    """Cut points [a, b) of about PIECE bytes that split no word."""
    a, end = 0, len(data)
    while a < end:
        b = min(a + PIECE, end)
        if b < end:
            back = data[a:b]
            space = np.flatnonzero(IS_SPACE[back[-65536:]])
            edge = offs[np.searchsorted(offs, b, "right") - 1]
            if len(space):
                b = max(b - min(65536, b - a) + int(space[-1]) + 1, int(edge) if edge > a else 0)
            elif edge > a:
                b = int(edge)
            else:
                while b < end:
                    ahead = np.flatnonzero(IS_SPACE[data[b : b + PIECE]])
                    edge = offs[np.searchsorted(offs, b, "left")]
                    stop = min(b + int(ahead[0]) if len(ahead) else b + PIECE, int(edge), end)
                    if len(ahead) or stop in (int(edge), end):
                        b = stop
                        break
                    b = stop
        yield a, b
        a = b


def words(data: np.ndarray, offs: np.ndarray, lower: bool = True, hashed: bool = True):
    """Starts, ends and hashes of all words, and the index of each text's first word (length n + 1)."""
    starts, ends, hashes = [], [], []
    for a, b in pieces(data, offs):
        part = data[a:b]
        text = ~IS_SPACE[part]
        edge = offs[np.searchsorted(offs, a, "left") : np.searchsorted(offs, b, "left")] - a
        begin, finish = text.copy(), text.copy()
        begin[1:] &= ~text[:-1]
        finish[:-1] &= ~text[1:]
        begin[edge] |= text[edge]
        inner = edge[edge > 0] - 1
        finish[inner] |= text[inner]
        s, e = np.flatnonzero(begin), np.flatnonzero(finish) + 1
        starts.append(s + a)
        ends.append(e + a)
        if hashed:
            up, down = powers(len(part) + 1)
            total = np.empty(len(part) + 1, np.uint64)
            total[0] = 0
            np.cumsum((_CODE_LOWER if lower else _CODE)[part] * up[: len(part)], out=total[1:])
            hashes.append(mix((total[e] - total[s]) * down[s] + (e - s).astype(np.uint64)))
    join = lambda xs, kind: np.concatenate(xs) if xs else np.zeros(0, kind)
    starts = join(starts, np.int64)
    return starts, join(ends, np.int64), join(hashes, np.uint64), np.searchsorted(starts, offs)


def shingles(hashes: np.ndarray, firsts: np.ndarray, width: int) -> Pair:
    """Hash of each window of ``width`` words inside one text, and the index of its first word."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    out = hashes[:n].copy()
    for j in range(1, width):
        out = out * _STEP + hashes[j : j + n]
    fits = np.ones(len(hashes), bool)
    for j in range(1, width):  # a window starting so near a text's end would reach into the next
        last = firsts[1:] - j
        fits[last[(last >= 0) & (last >= firsts[:-1])]] = False
    at = np.flatnonzero(fits[:n])
    return mix(out[at]), at


def slices(batch: pa.RecordBatch, column: str | int, limit: int = 4 << 20):
    """The batch in slices of whole rows whose texts come to about ``limit`` bytes."""
    k = column if isinstance(column, int) else batch.schema.get_field_index(column)
    _, offs = buffers(batch.column(k))
    a, n = 0, batch.num_rows
    while a < n:
        b = max(a + 1, int(np.searchsorted(offs, offs[a] + limit, "right")) - 1)
        yield batch.slice(a, b - a)
        a = b
