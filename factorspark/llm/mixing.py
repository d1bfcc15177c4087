"""Mixing sources to target weights by cube-method balanced sampling.

A source's target is its weighted share of all words, held at ``cap`` times its own size with the
excess reshared (water filling over the sources' table, in window functions). Every document of a
source is due target / source_size copies: the whole part is given, the fraction is an inclusion
probability. A flight phase then moves the probabilities of a source through the null space of two
constraints, words and documents, until they are 0 or 1. It runs in hash buckets of about ``BUCKET``
rows, each leaving two fractional documents at most; those go to a coarser level, and so on, which
keeps both totals exactly until at most two documents of a source are left. Only they are rounded,
to the combination nearest in words. A hot source is many buckets like any other.

Repeated rows are one row with a number of repeats through all of this: their dues are added, the whole
copies are dealt round them again at the end, and none of a large group of them ever meets another in one
task. Whole rows are moved once, to be put together with the number of their copies.

Defined cases: a null text or one without words has size 0 and takes no words; a null source is a
source of its own, ordered last; a source without words has target 0; rows without id are dealt like
others; order and draws depend on the rows alone, so reruns agree; other columns keep their values,
whatever they are called.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factorspark.llm.runtime import cut, row_key, stored, whole_key

BUCKET = 4096
FAN = 1024
REPEATS = 4096
CAP = 3.0
EDGE = 1e-9


def word_count(text: str):
    """Number of runs outside {0x20, 0x09-0x0D}, on the JVM; null counts 0."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit("[^\\x20\\x09-\\x0D]++")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: float = CAP) -> DataFrame:
    """(source, n, source_size, target) from rows (source, size, repeats); one row a source."""
    per = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("repeats")).alias("source_size"), F.count("*").alias("n"))
    order = Window.orderBy(F.col("source").isNull(), "source")
    per = per.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int")).cast("double"))
    most = F.col("source_size") * F.lit(float(cap))
    by = Window.orderBy(most / F.col("weight"), F.col("source").isNull(), "source")
    all_rows, before = Window.partitionBy(F.lit(1)), by.rowsBetween(Window.unboundedPreceding, -1)
    rest = F.sum("source_size").over(all_rows) - F.coalesce(F.sum(most).over(before), F.lit(0.0))
    level = rest / (F.sum("weight").over(all_rows) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    per = per.withColumn("place", F.row_number().over(by)).withColumn("level", level)
    fits = F.col("weight") * F.col("level") <= most
    per = per.withColumn("level", F.min_by("level", F.when(fits, F.col("place"))).over(all_rows))
    return per.select("source", "n", "source_size", F.least(most, F.col("weight") * F.coalesce("level", F.lit(0.0))).alias("target"))


def flight(size: np.ndarray, x: np.ndarray, seed: int, land: bool) -> np.ndarray:
    """Moves probabilities x until at most two are fractional (none if land), sums of x and size * x kept."""
    x = x.astype(float).copy()
    rng = np.random.default_rng(seed)
    draws = iter(rng.random(len(x) + 8).tolist())
    todo = np.flatnonzero((x > EDGE) & (x < 1 - EDGE)).tolist()
    s, v = size.astype(float).tolist(), x.tolist()
    held: list[int] = []
    for k in todo:
        held.append(k)
        if len(held) < 3:
            continue
        a, b, c = held
        u = (s[b] - s[c], s[c] - s[a], s[a] - s[b])
        scale = max(abs(u[0]), abs(u[1]), abs(u[2]))
        u = (u[0] / scale, u[1] / scale, u[2] / scale) if scale else (1.0, -1.0, 0.0)
        up = down = math.inf
        for k2, w in zip(held, u, strict=True):
            if w > 0:
                up, down = min(up, (1 - v[k2]) / w), min(down, v[k2] / w)
            elif w < 0:
                up, down = min(up, v[k2] / -w), min(down, (1 - v[k2]) / -w)
        step = up if next(draws) * (up + down) < down else -down
        for k2, w in zip(held, u, strict=True):
            v[k2] += step * w
        held = [k2 for k2 in held if EDGE < v[k2] < 1 - EDGE]
    if land and held:
        best = min(range(1 << len(held)), key=lambda m: (abs(sum(s[k] * ((m >> i & 1) - v[k]) for i, k in enumerate(held))), abs(sum((m >> i & 1) - v[k] for i, k in enumerate(held))), m))
        for i, k in enumerate(held):
            v[k] = float(best >> i & 1)
    return np.array(v)


def _flown(level: int):
    """The flight of one bucket; a source's last bucket lands."""

    def fly(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["key", "doc_id", "size", "every"], kind="stable", na_position="last").reset_index(drop=True)
        name, at, of = pdf["source"].iloc[0], int(pdf["bucket"].iloc[0]), int(pdf["of"].iloc[0])
        seed = zlib.crc32(f"{name!r}/{at}/{level}".encode("utf-8", "surrogatepass"))
        pdf["x"] = flight(pdf["size"].to_numpy(), pdf["x"].to_numpy(), seed, of <= 1)
        return pdf

    return fly


def _decided(docs: DataFrame, every: Column, id_col: str, text_col: str, source_col: str, weights: tuple[int, ...], cap: float, bucket: int) -> DataFrame:
    """(key, every, doc_id, size, source_size, target, repeats, total): copies of all repeats of each distinct row, ``every`` its key."""
    rows = docs.select(row_key(id_col, text_col, source_col).alias("key"), every.alias("every"), F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).alias("source"), word_count(text_col).alias("size"))
    rows = cut(rows.groupBy("key", "every", "doc_id", "source", "size").agg(F.count("*").alias("repeats")))
    per = stored(targets(rows, weights, cap), "mixing-sources")
    level, most = 0, per.agg(F.max("n")).first()[0] or 0
    due = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size") * F.col("repeats")).otherwise(F.lit(0.0))
    state = rows.join(per, rows.source.eqNullSafe(per.source)).select("key", "every", "doc_id", rows.source, "size", "source_size", "target", "repeats", due.alias("due"), F.pmod(F.xxhash64("key", F.lit(1)), F.ceil(F.col("n") / bucket)).alias("bucket"), F.ceil(F.col("n") / bucket).alias("of"))
    state = state.withColumn("whole", F.floor(F.col("due") + EDGE).cast("double")).withColumn("x", F.greatest(F.col("due") - F.col("whole"), F.lit(0.0))).drop("due")
    settled, fractional = None, (F.col("x") > EDGE) & (F.col("x") < 1 - EDGE)
    while True:
        last = most <= bucket * FAN**level
        flown = cut(state.groupBy("source", "bucket").applyInPandas(_flown(level), state.schema))
        done = flown.where(~fractional)
        settled = done if settled is None else settled.unionAll(done)
        if last:
            break
        level += 1
        state = flown.where(fractional).withColumns({"bucket": F.floor(F.col("bucket") / FAN), "of": F.ceil(F.col("of") / FAN)})
    return settled.select("key", "every", "doc_id", "size", "source_size", "target", "repeats", (F.col("whole") + F.round("x")).cast("long").alias("total"))


def _expanded(df: DataFrame, times: str, at: str) -> DataFrame:
    """Each row ``times`` times, numbered from 0 in column ``at``; a large number is first dealt to other tasks in parts of REPEATS."""
    few = F.sequence(F.lit(0).cast("long"), F.col(times) - 1)
    some = df.where(F.col(times).between(1, REPEATS)).withColumn(at, F.explode(few))
    many = df.where(F.col(times) > REPEATS)
    if many.isEmpty():
        return some
    parts = many.withColumn("__from", F.explode(F.sequence(F.lit(0).cast("long"), F.col(times) - 1, F.lit(REPEATS).cast("long"))))
    parts = parts.repartition("__from")
    return some.unionByName(parts.withColumn(at, F.explode(F.sequence(F.col("__from"), F.least(F.col("__from") + REPEATS, F.col(times)) - 1))).drop("__from"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (1, 2, 3), cap: float = CAP, bucket: int = BUCKET) -> DataFrame:
    """(doc_id, key, size, source_size, target, copies, taken) per row; key is the row's hash."""
    decided = _decided(docs, row_key(id_col, text_col, source_col), id_col, text_col, source_col, weights, cap, bucket)
    each = _expanded(decided, "repeats", "at")
    copies = F.floor(F.col("total") / F.col("repeats")) + (F.col("at") < F.pmod("total", "repeats")).cast("long")
    return each.select("doc_id", "key", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def apply_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (1, 2, 3), cap: float = CAP, bucket: int = BUCKET) -> DataFrame:
    """The documents, all columns kept, each row as often as the mix takes it (not at all for 0).

    Rows that are equal in all columns are repeats; each of them and its copies are the same row.
    """
    decided = _decided(docs, whole_key(docs), id_col, text_col, source_col, weights, cap, bucket)
    own = F.col("doc_id")
    chosen = decided.where("total > 0").select("every", own.isNull().alias("none"), F.coalesce(own, F.lit(0)).alias("id"), "total")
    own = F.col(id_col).cast("long")
    packed = docs.select(F.struct("*").alias("row"), whole_key(docs).alias("every"), own.isNull().alias("none"), F.coalesce(own, F.lit(0)).alias("id"))
    once = packed.groupBy("every", "none", "id").agg(F.first("row").alias("row"))
    got = once.join(chosen, ["every", "none", "id"]).select("row", "total")
    if chosen.where(F.col("total") > REPEATS).isEmpty():
        return got.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("total")))).select("row.*")
    return _expanded(got, "total", "at").select("row.*")
