"""Joins that a plain equality cannot express, planned as windows or equi joins."""

from __future__ import annotations

import difflib
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factorspark.functions.shipping import scratch, ship
from factorspark.operators.rows import Reader, arrow_uri

FUZZY_PAIRS = 8_000_000


def asof_backward(left: DataFrame, right: DataFrame, on: str, value: str, by: Sequence[str] = (), out: str | None = None) -> DataFrame:
    """Each left row with the value of the right row latest at or before it, per key.

    One union, one sort a key: no range join, so the plan has a single exchange by ``by``. ``right``
    should be unique by key and time. Without a key time is cut into ``SPANS`` equal spans, which are the
    keys, and a row before the first right row of its span has the last value of the spans before.
    """
    out = out or value
    if not by:
        return _asof_by_span(left, right, on, value, out)
    keys = list(by)
    a = left.select(*left.columns, F.lit(None).cast(right.schema[value].dataType).alias("__v"), F.lit(1).alias("__side"))
    fill = [F.lit(None).cast(left.schema[c].dataType).alias(c) for c in left.columns if c not in (*keys, on)]
    b = right.select(*keys, on, *fill, F.col(value).alias("__v"), F.lit(0).alias("__side"))
    w = Window.partitionBy(*keys).orderBy(on, "__side").rowsBetween(Window.unboundedPreceding, 0)
    both = a.unionByName(b).withColumn("__v", F.last("__v", ignorenulls=True).over(w))
    return both.where("__side = 1").select(*left.columns, F.col("__v").alias(out))


SPANS = 256


def _asof_by_span(left: DataFrame, right: DataFrame, on: str, value: str, out: str) -> DataFrame:
    at = lambda c: F.unix_micros(F.col(c).cast("timestamp")) if isinstance(left.schema[on].dataType, T.DatetimeType | T.TimestampNTZType) else F.col(c).cast("double")
    low, high = right.agg(F.min(at(on)), F.max(at(on))).first()
    width = ((high - low) / SPANS if low is not None else 0) or 1
    span = F.least(F.greatest(F.floor((at(on) - F.lit(low or 0)) / F.lit(width)), F.lit(-1)), F.lit(SPANS)).cast("int")
    keyed = right.where(F.col(value).isNotNull()).select(on, value, span.alias("__span"))
    own = asof_backward(left.withColumn("__span", span), keyed, on, value, ["__span"], "__own")
    last = keyed.groupBy("__span").agg(F.max_by(value, on).alias("__last"))
    spans = left.sparkSession.range(-1, SPANS + 1).select(F.col("id").cast("int").alias("__span"))
    before = Window.orderBy("__span").rowsBetween(Window.unboundedPreceding, -1)
    carried = spans.join(last, "__span", "left").select("__span", F.last("__last", ignorenulls=True).over(before).alias("__carried"))  # SPANS rows
    got = own.join(F.broadcast(carried), "__span", "left")
    return got.select(*left.columns, F.coalesce("__own", "__carried").alias(out))


def calendar_index(df: DataFrame, dt: str = "dt", out: str = "idx") -> DataFrame:
    """(dt, idx): the distinct dates numbered from 1. The number of dates bounds the single window."""
    return df.select(dt).distinct().withColumn(out, F.row_number().over(Window.orderBy(dt)))


def prefix_match(tickers: DataFrame, symbols: DataFrame, ticker: str, symbol: str, order: str) -> DataFrame:
    """Each ticker with the first symbol that equals it or starts with it and a dot."""
    keyed = symbols.select(symbol, order, F.split(symbol, "\\.")[0].alias("__base"))
    keyed = keyed.select(symbol, order, F.explode(F.array_distinct(F.array(F.col("__base"), F.col(symbol)))).alias("__key"))
    hit = tickers.join(keyed, tickers[ticker] == keyed["__key"])
    first = F.row_number().over(Window.partitionBy(ticker).orderBy(order))
    return hit.withColumn("__n", first).where("__n = 1").drop("__n", "__key", order)


def fuzzy_match(names: DataFrame, targets: DataFrame, name: str, target: str, cutoff: float = 0.8) -> DataFrame:
    """Best target per name: equal in lower case, else of the highest sequence ratio at or over cutoff, the last of equals.

    Names that match exactly never reach Python. The rest are dealt to tasks that stream the stored targets
    past them in blocks. Shared letters, then the longest common subsequence, bound the ratio from above;
    both are taken for a block at once, and only targets whose bound reaches the best so far are compared.
    """
    n, t = names.select(name).distinct(), targets.select(target).distinct()
    n = n.withColumn("__a", F.lower(F.trim(name)))
    t = t.withColumn("__b", F.lower(F.trim(target)))
    exact = n.join(t, F.col("__a") == F.col("__b")).groupBy(name).agg(F.min(target).alias(target)).withColumn("ratio", F.lit(1.0))
    spark = names.sparkSession
    ship(spark)
    path = scratch(spark, "names")
    t.where("__b IS NOT NULL").select(target, "__b").write.parquet(path)
    rest = n.where("__a IS NOT NULL").join(exact, name, "left_anti")
    tasks = max(8, -(-rest.count() * spark.read.parquet(path).count() // FUZZY_PAIRS))
    uri = arrow_uri(path)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stored = Reader(uri, [target, "__b"])
        for batch in batches:
            best: list = [(cutoff, None)] * batch.num_rows
            texts = batch.column(1).to_pylist()
            for part in stored:
                block = _Texts(part.column(1).to_pylist(), part.column(0).to_pylist())
                best = [block.best(x, was) for x, was in zip(texts, best, strict=True)]
            found = [k for k, (_, at) in enumerate(best) if at is not None]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(found, pa.int64())), pa.array([best[k][1] for k in found], pa.string()), pa.array([best[k][0] for k in found], pa.float64())], [name, target, "ratio"])

    near = rest.repartition(tasks, name).mapInArrow(search, f"`{name}` string, `{target}` string, ratio double")
    return exact.unionByName(near)


class _Texts:
    """A block of targets with what bounds their sequence ratios to a text."""

    def __init__(self, texts: list[str], names: list[str]) -> None:
        self.texts, self.names = texts, names
        self.sizes = np.array([len(x) for x in texts])
        codes = np.array(texts, dtype=f"<U{max(int(self.sizes.max(initial=0)), 1)}")
        codes = codes.view(np.uint32).reshape(len(texts), -1)
        chars, inverse = np.unique(codes, return_inverse=True)
        self.place = {chr(c): k for k, c in enumerate(chars.tolist())}
        self.codes = inverse.reshape(codes.shape)
        self.counts: dict[str, np.ndarray] = {}

    def count(self, c: str) -> np.ndarray:
        if c not in self.counts:
            self.counts[c] = (self.codes == self.place[c]).sum(1)
        return self.counts[c]

    def common(self, x: str, at: np.ndarray) -> np.ndarray:
        """Length of the longest common subsequence of a text of at most 64 characters and each target, bits of the text in parallel."""
        masks = np.zeros(len(self.place), np.uint64)
        for k, c in enumerate(x):
            if c in self.place:
                masks[self.place[c]] |= np.uint64(1 << k)
        v = np.full(len(at), 2**64 - 1, np.uint64)
        for k in range(int(self.sizes[at].max(initial=0))):
            u = v & masks[self.codes[at, k]]
            v = (v + u) | (v - u)
        return np.bitwise_count(~v & np.uint64(2 ** len(x) - 1)).astype(int)

    def best(self, x: str, was: tuple[float, str | None]) -> tuple[float, str | None]:
        """The better of ``was``, a ratio and a name, and this block's best at or over that ratio."""
        shared = np.zeros(len(self.texts), int)
        for c, n in Counter(x).items():
            if c in self.place:
                shared += np.minimum(self.count(c), n)
        total = np.maximum(self.sizes + len(x), 1)
        bound = 2.0 * shared / total
        m = difflib.SequenceMatcher(None, "", x)
        for b in np.unique(bound[bound >= was[0]])[::-1]:
            if b < was[0]:
                break
            at = np.nonzero(bound == b)[0]
            closer = 2.0 * self.common(x, at) / total[at] if len(x) <= 64 else np.full(len(at), b)
            for k in np.argsort(-closer, kind="stable"):
                if closer[k] < was[0]:
                    break
                m.set_seq1(self.texts[at[k]])
                was = max(was, (m.ratio(), self.names[at[k]]), key=lambda r: (r[0], r[1] is not None, r[1] or ""))
        return was


def skip_existing(todo: DataFrame, done: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows of ``todo`` whose key is not in ``done``."""
    return todo.join(done, list(on), "left_anti")


def upsert(old: DataFrame, new: DataFrame, on: Sequence[str], order: str) -> DataFrame:
    """Union of two tables in which the latest row of a key wins, new ones first among equals."""
    both = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)), allowMissingColumns=True)
    last = F.row_number().over(Window.partitionBy(*on).orderBy(F.desc("__new"), F.desc_nulls_last(order)))
    return both.withColumn("__n", last).where("__n = 1").drop("__n", "__new")
