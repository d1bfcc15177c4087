"""Quality rules: hashed word and character n-gram logistic regression over fixed base rules.

Base figures of a text: words are runs of bytes outside {0x20, 0x09-0x0D}; word characters are their code
points; symbols are the characters ``#*$%&|<>``; a duplicate line is a \\n-split line with a word that
equals an earlier one; repeated words are those in five-word windows found twice or more. A text fails
the base rules with under 10 words, or if over a fifth of its words are repeated. The classifier's
features are relative frequencies of words (hashed to 2^18 places) and of 4-byte grams (2^16 places),
letter case kept; its logit is Platt-calibrated on a quarter of the sample held out of the fit, and a
text is kept if it passes the base rules and P(quality) reaches ``THRESHOLD``. Scoring runs in Arrow
batches over whole texts.

Defined cases: a null text is empty, has no words and fails; copies get equal rows; if the labels hold one
class only, the model's verdict is that class (kept without any label). Windows are compared by 64-bit
hashes of their words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factorspark.llm import textvec
from factorspark.llm.runtime import trim
from factorspark.llm.textvec import IS_SPACE, Pair, buffers, mix, pieces, shingles, slices, words
from factorspark.llm.training import labelled_sample

THRESHOLD = 0.5
LEAST_WORDS = 10
WORD_BITS = 18
GRAM_BITS = 16
GRAM = 4
SCALE = 40.0
STEPS = 80
L2 = 1e-6
ROWS = 1500
BYTES = 4 << 20
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_C = np.uint64(0x9E3779B97F4A7C15)


def _sums(values: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between offsets."""
    total = np.zeros(len(values) + 1, np.float64 if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=total[1:])
    return total[offs[1:]] - total[offs[:-1]]


def _piece_sums(values: np.ndarray, a: int, offs: np.ndarray, out: np.ndarray) -> None:
    """Adds the sums of values that start at byte ``a`` to the texts that they lie in."""
    b = a + len(values)
    i, j = int(np.searchsorted(offs, a, "right")) - 1, int(np.searchsorted(offs, b, "left"))
    if j > i:
        out[i:j] += _sums(values, np.clip(offs[i : j + 1], a, b) - a)


def base(column: pa.Array) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a string column."""
    data, offs = buffers(column)
    n = len(offs) - 1
    _, _, hashes, firsts = words(data, offs, lower=False)
    n_words = np.diff(firsts)
    chars, symbols, breaks = (np.zeros(n, np.int64) for _ in range(3))
    for a, b in pieces(data, offs):
        part = data[a:b]
        for values, out in ((~IS_SPACE[part] & ((part & 0xC0) != 0x80), chars), (_SYMBOL[part], symbols), (part == 0x0A, breaks)):
            _piece_sums(values, a, offs, out)
    h, at = shingles(hashes, firsts, 5)
    row = np.searchsorted(firsts, at, "right") - 1
    order = np.argsort(mix(h + row.astype(np.uint64) * _C), kind="stable")
    hs, rs = h[order], row[order]
    same = (hs[1:] == hs[:-1]) & (rs[1:] == rs[:-1])
    twice = np.zeros(len(h), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    cover = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(cover, at[twice], 1)
    np.add.at(cover, at[twice] + 5, -1)
    repeated = _sums(np.cumsum(cover[:-1]) > 0, firsts)
    dup = np.zeros(n, np.int64)
    raw, cuts = data.tobytes(), offs.tolist()
    for k in np.flatnonzero(breaks).tolist():
        lines = [x for x in raw[cuts[k] : cuts[k + 1]].split(b"\n") if x and not x.isspace()]
        dup[k] = len(lines) - len(set(lines))
    return {"n_words": n_words, "word_chars": chars, "n_symbols": symbols, "n_dup_lines": dup, "n_repeat_words": repeated}


def base_failed(n_words: np.ndarray, repeated: np.ndarray) -> np.ndarray:
    return (n_words < LEAST_WORDS) | (100 * repeated > 20 * n_words)


def _word_places(data: np.ndarray, offs: np.ndarray) -> Pair:
    _, _, h, firsts = words(data, offs, lower=False)
    return (h >> np.uint64(64 - WORD_BITS)).astype(np.int64), firsts


def _gram_places(data: np.ndarray, offs: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(piece start, places, gram lies inside one text) for the grams that start in each piece."""
    code = textvec._CODE
    for a, b in pieces(data, offs):
        stop = min(b + GRAM - 1, len(data))
        codes = code[data[a:stop]]
        n = stop - a - GRAM + 1
        if n <= 0:
            continue
        h = codes[:n].copy()
        for j in range(1, GRAM):
            h = h * _C + codes[j : j + n]
        inside = np.ones(n, bool)
        edge = offs[(offs > a) & (offs < stop)] - a
        for j in range(1, GRAM):
            cut = edge - j
            inside[cut[(cut >= 0) & (cut < n)]] = False
        yield a, (mix(h) >> np.uint64(64 - GRAM_BITS)).astype(np.int64), inside


@dataclass
class Model:
    words: np.ndarray
    grams: np.ndarray
    bias: float
    slope: float = 1.0
    shift: float = 0.0

    def logits(self, column: pa.Array) -> np.ndarray:
        """Uncalibrated logits of whole texts."""
        data, offs = buffers(column)
        places, firsts = _word_places(data, offs)
        z = self.bias + SCALE * _sums(self.words[places], firsts) / np.maximum(np.diff(firsts), 1)
        got, here = np.zeros(len(z)), np.zeros(len(z), np.int64)
        for a, at, inside in _gram_places(data, offs):
            _piece_sums(np.where(inside, self.grams[at], 0.0), a, offs, got)
            _piece_sums(inside, a, offs, here)
        return z + SCALE * got / np.maximum(here, 1)

    def probability(self, column: pa.Array) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * self.logits(column) + self.shift)))


def _rows(texts: list[str]):
    """Sparse features: (row, place, relative frequency) with grams after the words."""
    data, offs = buffers(pa.array(texts, pa.large_string()))
    n = len(texts)
    places, firsts = _word_places(data, offs)
    row = np.repeat(np.arange(n), np.diff(firsts))
    width = (1 << WORD_BITS) + (1 << GRAM_BITS)
    keys, counts = np.unique(row * np.int64(width) + places, return_counts=True)
    value = SCALE * counts / np.maximum(np.diff(firsts), 1)[keys // width]
    out = [(keys // width, keys % width, value)]
    size = np.zeros(n, np.int64)
    grams = []
    for a, at, inside in _gram_places(data, offs):
        r = np.searchsorted(offs, a + np.flatnonzero(inside), "right") - 1
        size += np.bincount(r, minlength=n)
        grams.append(np.unique(r * np.int64(width) + at[inside] + (1 << WORD_BITS), return_counts=True))
    if grams:
        keys, inverse = np.unique(np.concatenate([g[0] for g in grams]), return_inverse=True)
        counts = np.bincount(inverse, weights=np.concatenate([g[1] for g in grams]))
        out.append((keys // width, keys % width, SCALE * counts / np.maximum(size, 1)[keys // width]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def fit(samples: list[tuple[str, int]], steps: int = STEPS, l2: float = L2) -> Model:
    """Weights from (text, label) pairs, copies of a text counting once; deterministic."""
    samples = sorted({t: int(y > 0) for t, y in samples}.items())
    y = np.array([label for _, label in samples], float)
    flat = Model(np.zeros(1 << WORD_BITS), np.zeros(1 << GRAM_BITS), 0.0)
    if not len(y) or not 0 < y.sum() < len(y):
        flat.bias = 10.0 if not len(y) or y.sum() else -10.0
        return flat
    order = np.random.default_rng(11).permutation(len(y))
    held = np.zeros(len(y), bool)
    held[order[: len(y) // 4]] = True
    row, col, value = _rows([t for t, _ in samples])
    used = ~held[row]
    tr, tc, tv = row[used], col[used], value[used]
    names, tc = np.unique(tc, return_inverse=True)
    n, fitted = int((~held).sum()), ~held
    w, b, gw, gb = np.zeros(len(names)), 0.0, np.full(len(names), 1e-8), 1e-8
    for _ in range(steps):
        z = b + np.bincount(tr, weights=w[tc] * tv, minlength=len(y))
        g = np.where(fitted, 1 / (1 + np.exp(-z)) - y, 0.0) / n
        dw, db = np.bincount(tc, weights=g[tr] * tv, minlength=len(names)) + l2 * w, g.sum()
        gw += dw * dw
        gb += db * db
        w -= 0.1 * dw / np.sqrt(gw)
        b -= 0.3 * db / np.sqrt(gb)
    full = np.zeros((1 << WORD_BITS) + (1 << GRAM_BITS))
    full[names] = w
    model = Model(full[: 1 << WORD_BITS], full[1 << WORD_BITS :], float(b))
    if held.any() and 0 < y[held].sum() < held.sum():
        z, t = model.logits(pa.array([t for (t, _), h in zip(samples, held, strict=True) if h], pa.large_string())), y[held]
        up, down = t.sum(), (1 - t).sum()
        t = np.where(t > 0, (up + 1) / (up + 2), 1 / (down + 2))  # Platt's targets
        s, c = 1.0, 0.0
        for _ in range(50):
            p = 1 / (1 + np.exp(-(s * z + c)))
            r, v = p - t, np.maximum(p * (1 - p), 1e-9)
            h = np.array([[(v * z * z).sum() + 1e-6, (v * z).sum()], [(v * z).sum(), v.sum() + 1e-6]])
            step = np.linalg.solve(h, [(r * z).sum(), r.sum()])
            s, c = s - np.clip(step[0], -1, 1), c - np.clip(step[1], -1, 1)
        if s > 0:
            model.slope, model.shift = float(s), float(c)
    return model


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", **bounds) -> Model:
    model = fit([(t, y) for _, y, t in labelled_sample(docs, labels, label, **({"rows": ROWS, "size": BYTES} | bounds))])
    trim()
    return model


def judge(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, base figures, base_failed, probability, kept) per row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2^18 + 2^16 weights
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "probability", "kept"]
    spec = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, probability double, kept boolean"

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                own = base(part.column(1))
                failed = base_failed(own["n_words"], own["n_repeat_words"])
                p = shared.value.probability(part.column(1))
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(own[k].astype(np.int64)) for k in names[1:6]), pa.array(failed), pa.array(p), pa.array(~failed & (p >= threshold))], names)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(scan, spec)
