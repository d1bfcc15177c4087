"""Toxicity by multiple-instance learning: sentence scores, combined by noisy-or, from document labels.

A sentence is a run between the bytes . ! ? and newline that has a token; tokens are runs of ASCII
letters, digits and bytes over 0x7F, A-Z folded. Its features are its tokens and the 5-byte grams inside
them, a separator on either side included. P(sentence) is logistic in the present features, and a
document is toxic unless no sentence is: 1 - (1 - leak) * prod(1 - P(sentence)), the leak standing for
labels that no sentence explains. Features are screened by their documents' labels, first by place in a
fixed table, where one that shares its place with others can be lost, weights fitted by
proximal adaptive-gradient steps with an L1 term on a bounded labelled sample; sentences are never labelled. A text
is scored whole, in pieces that end at white space.

Defined cases: null and empty texts have no sentence and score the leak; copies score alike; without any
usable label the model has no weights and every score is the leak of 0.05.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factorspark.llm import textvec
from factorspark.llm.runtime import filtered, trim
from factorspark.llm.textvec import LOWER, Pair, buffers, mix, pieces, slices
from factorspark.llm.training import held_out, labelled_sample

THRESHOLD = 0.3
GRAM = 5
VOCABULARY = 3000
LEAST_DOCS = 3
SCREEN = 1.5
STEPS = 250
L1 = 2e-4
_FOLD = np.full(256, 0x20, np.uint8)
_FOLD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = LOWER[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]]
_ENDS = np.zeros(256, bool)
_ENDS[[0x0A, 0x21, 0x2E, 0x3F]] = True
_C = np.uint64(0x9E3779B97F4A7C15)


def parted(column: pa.Array) -> Pair:
    """Bytes and offsets of a string column with a newline after every text, so that none touches the next."""
    raw, offs = buffers(column)
    n = len(offs) - 1
    text, cuts = raw.tobytes(), offs.tolist()
    line = b"\n".join([text[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]) + b"\n" * (n > 0)
    return np.frombuffer(line, np.uint8), offs + np.arange(n + 1)


def features(data: np.ndarray, offs: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(hash, byte position) of all token and gram occurrences, piece by piece."""
    code = textvec._CODE
    for a, b in pieces(data, offs):
        line = np.full(b - a + 2, 0x20, np.uint8)
        line[1:-1] = _FOLD[data[a:b]]
        codes = code[line]
        gap = line == 0x20
        n = len(line) - GRAM + 1
        if n > 0:
            h = codes[:n].copy()
            for j in range(1, GRAM):
                h = h * _C + codes[j : j + n]
            fits = ~gap[1 : 1 + n]
            for j in range(2, GRAM - 1):
                fits &= ~gap[j : j + n]
            at = np.flatnonzero(fits)
            yield mix(h[at]), at + a
        starts, _, hashes, _ = textvec.words(line, np.array([0, len(line)]))
        yield hashes ^ _C, starts + (a - 1)


def sentences(data: np.ndarray, offs: np.ndarray) -> Pair:
    """Positions of sentence ends, and per text its number of sentences that have a token."""
    ends, keys = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    seen = 0
    for a, b in pieces(data, offs):
        part = data[a:b]
        stop = _ENDS[part]
        token = _FOLD[part] != 0x20
        first = token.copy()
        first[1:] &= ~token[:-1]
        at = np.flatnonzero(first)
        count = np.cumsum(stop)
        keys.append(np.unique(count[at] + seen + np.searchsorted(offs, at + a, "right") - 1))
        seen += int(count[-1])
        ends.append(np.flatnonzero(stop) + a)
    ends, keys = np.concatenate(ends), np.unique(np.concatenate(keys))
    texts = np.arange(len(offs) - 1)
    low = np.searchsorted(ends, offs[:-1]) + texts
    high = np.searchsorted(ends, offs[1:]) + texts
    return ends, np.searchsorted(keys, high, "right") - np.searchsorted(keys, low)


@dataclass
class Model:
    keys: np.ndarray
    weights: np.ndarray
    bias: float
    leak: float


def _bitmap(keys: np.ndarray) -> np.ndarray:
    out = np.zeros(1 << 20, bool)
    out[(keys >> np.uint64(44)).astype(np.int64)] = True
    return out


def hits(data: np.ndarray, offs: np.ndarray, keys: np.ndarray, bitmap: np.ndarray) -> Pair:
    """Positions and indexes of the occurrences of known features."""
    pos, ks = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for h, at in features(data, offs):
        some = np.flatnonzero(bitmap[(h >> np.uint64(44)).astype(np.int64)])
        k = np.searchsorted(keys, h[some])
        ok = (k < len(keys)) & (keys[np.minimum(k, max(len(keys) - 1, 0))] == h[some]) if len(keys) else np.zeros(0, bool)
        pos.append(at[some][ok])
        ks.append(k[ok])
    return np.concatenate(pos), np.concatenate(ks)


def _sentence_of(pos: np.ndarray, ends: np.ndarray, data: np.ndarray, offs: np.ndarray) -> Pair:
    """Text and sentence key of an occurrence; one that starts at a separator belongs to the byte after it."""
    pos = np.where(pos < 0, 0, pos)
    pos = pos + ((_FOLD[data[pos]] == 0x20) & (pos + 1 < len(data)))
    text = np.searchsorted(offs, pos, "right") - 1
    return text, np.searchsorted(ends, pos) + text


def _present(data: np.ndarray, offs: np.ndarray, keys: np.ndarray, bitmap: np.ndarray):
    """Distinct (text, sentence, feature) rows, with the sentence counts of the texts."""
    ends, counts = sentences(data, offs)
    pos, ks = hits(data, offs, keys, bitmap)
    if not len(pos):
        return np.zeros((0, 3), np.int64), counts, ends
    text, key = _sentence_of(pos, ends, data, offs)
    one = np.unique(key * np.int64(len(keys)) + ks)
    key, ks = one // len(keys), one % len(keys)
    text = np.searchsorted(np.searchsorted(ends, offs[:-1]) + np.arange(len(offs) - 1), key, "right") - 1
    return np.stack([text, key, ks], 1), counts, ends


def _softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0.0, z)


def fit(samples: list[tuple[str, int]], vocabulary: int = VOCABULARY, steps: int = STEPS, l1: float = L1) -> Model:
    """Weights from (text, label) pairs, copies of a text counting once; deterministic."""
    samples = sorted({t: label for t, label in samples}.items())
    y = np.array([1.0 if label else 0.0 for _, label in samples])
    if not len(y) or not 0 < y.sum() < len(y):
        return Model(np.zeros(0, np.uint64), np.zeros(0), -12.0, 0.05)
    texts = [t for t, _ in samples]

    def of(k: int) -> np.ndarray:
        found = [h for h, _ in features(*parted(pa.array(texts[k : k + 1], pa.large_string())))]
        return np.unique(np.concatenate(found)) if found else np.zeros(0, np.uint64)

    rate = y.mean()
    score_of = lambda df, pos: (pos - rate * df) / np.sqrt(df * rate * (1 - rate) + 1)
    df, pos = np.zeros(1 << 22, np.int32), np.zeros(1 << 22, np.int32)
    for k in range(len(y)):  # first by place in a fixed table, which bounds memory, then exactly for what passes
        at = (of(k) >> np.uint64(42)).astype(np.int64)
        df[at] += 1
        pos[at] += int(y[k])
    passed = np.concatenate([(n >= LEAST_DOCS) & (score_of(n, m) > SCREEN) for n, m in zip(np.split(df, 64), np.split(pos, 64), strict=True)])
    found = [h[passed[(h >> np.uint64(42)).astype(np.int64)]] for h in map(of, range(len(y)))]
    names, inverse = np.unique(np.concatenate(found), return_inverse=True)
    df, pos = np.bincount(inverse, minlength=len(names)), np.bincount(inverse, weights=np.repeat(y, [len(h) for h in found]), minlength=len(names))
    z = score_of(df, pos)
    ok = np.flatnonzero((df >= LEAST_DOCS) & (z > SCREEN))
    ok = ok[np.lexsort((names[ok], -z[ok]))][:vocabulary]
    vocab = np.sort(names[ok])
    del found, inverse
    bitmap, (sent, ks, counts, doc_of) = _bitmap(vocab), ([], [], [], [])
    seen = 0
    for k in range(len(texts)):  # text by text: what is held is the present features alone
        rows, n, _ = _present(*parted(pa.array(texts[k : k + 1], pa.large_string())), vocab, bitmap)
        uniq, own = np.unique(rows[:, 1], return_inverse=True)
        sent.append((own + seen).astype(np.int32))
        ks.append(rows[:, 2].astype(np.int32))
        doc_of.append(np.full(len(uniq), k, np.int32))
        counts.append(n)
        seen += len(uniq)
    sent, ks, doc_of, counts = (np.concatenate(x) for x in (sent, ks, doc_of, counts))
    bare = counts - np.bincount(doc_of, minlength=len(y))
    w, b, q = np.zeros(len(vocab)), -5.0, np.log(rate / 2)
    gw, gb, gq = np.zeros(len(vocab)), 0.0, 0.0
    n = len(y)
    for _ in range(steps):
        zs = b + np.bincount(sent, weights=w[ks], minlength=seen)
        ps, p0 = 1 / (1 + np.exp(-zs)), 1 / (1 + np.exp(-b))
        leak = np.exp(q)
        log_q = np.log1p(-leak) - np.bincount(doc_of, weights=_softplus(zs), minlength=n) - bare * _softplus(np.array(b))
        p = np.clip(-np.expm1(log_q), 1e-9, 1 - 1e-12)
        slope = np.where(y > 0, -(1 - p) / p, 1.0)  # of the loss by the sum of softplus
        gs = slope[doc_of] * ps
        dw = np.bincount(ks, weights=gs[sent], minlength=len(vocab)) / n
        db = (gs.sum() + (slope * bare * p0).sum()) / n
        dq = (slope * leak / (1 - leak)).sum() / n
        gw += dw * dw
        gb += db * db
        gq += dq * dq
        rate_w = 0.5 / np.sqrt(gw + 1e-12)
        w = w - rate_w * dw
        w = np.sign(w) * np.maximum(np.abs(w) - rate_w * l1, 0)
        b = min(-4.0, b - 0.3 * db / np.sqrt(gb + 1e-12))
        q = min(np.log(0.15), max(np.log(1e-4), q - 0.1 * dq / np.sqrt(gq + 1e-12)))
    keep = np.abs(w) > 1e-3
    return Model(vocab[keep], w[keep], float(b), float(np.exp(q)))


def score(model: Model, column: pa.Array, threshold: float = THRESHOLD):
    """Scores of a string column, sentence counts and (row, start, end, P) of offending sentences.

    Starts and ends are byte offsets in the text."""
    data, offs = parted(column)
    rows, counts, ends = _present(data, offs, model.keys, _bitmap(model.keys))
    log_q = np.log1p(-model.leak) - counts * _softplus(np.array(model.bias))
    spans = []
    if len(rows):
        uniq, first, sent = np.unique(rows[:, 1], return_index=True, return_inverse=True)
        zs = model.bias + np.bincount(sent, weights=model.weights[rows[:, 2]])
        text = rows[first, 0]
        np.add.at(log_q, text, _softplus(np.array(model.bias)) - _softplus(zs))
        ps = 1 / (1 + np.exp(-zs))
        for k in np.flatnonzero(ps >= threshold).tolist():
            t = int(text[k])
            e = int(uniq[k]) - t
            start = max(int(offs[t]), int(ends[e - 1]) + 1 if e else 0)
            stop = min(int(offs[t + 1]) - 1, int(ends[e]) + 1 if e < len(ends) else len(data))
            spans.append((t, start - int(offs[t]), stop - int(offs[t]), float(ps[k])))
    return np.clip(-np.expm1(log_q), 0.0, 1.0), counts, spans


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", **bounds) -> Model:
    """A model from the labelled rows outside the held-out quarter."""
    model = fit([(t, y) for _, y, t in labelled_sample(docs, labels, label, ~held_out(), **bounds)])
    trim()
    return model


def score_table(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted, n_sentences, offending spans) per row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most VOCABULARY weights
    spec = "doc_id long, held_out boolean, score double, predicted int, n_sentences long, offending array<struct<start:long,end:long,score:double>>"
    names = ["doc_id", "held_out", "score", "predicted", "n_sentences", "offending"]
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                p, n, spans = score(shared.value, part.column(2), threshold)
                bad: list[list[dict]] = [[] for _ in range(part.num_rows)]
                for row, start, end, ps in spans:
                    bad[row].append({"start": start, "end": end, "score": ps})
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(p), pa.array((p >= threshold).astype(np.int32)), pa.array(n.astype(np.int64)), pa.array(bad, kind)], names)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))
    return rows.mapInArrow(scan, spec)


def drop_toxic(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The documents, all columns kept, that score below the threshold."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return filtered(docs, text_col, lambda: lambda column: score(shared.value, column, threshold)[0] < threshold)
