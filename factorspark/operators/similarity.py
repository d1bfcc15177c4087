"""Vector similarity edges: weighted cosine, percentile ranks, neighbours, correlation edges, whitening."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from factorspark.functions import weights as W
from factorspark.operators.xsection import ordinal_pct


BLOCKS = 8
SERIES_BLOCKS = 16
BLOCK_ROWS = 1000


def blocks_for(df: DataFrame, key: str = "sym", least: int = BLOCKS, size: int = BLOCK_ROWS) -> int:
    """Number of blocks that hold about ``size`` keys each, ``least`` at least, so a task's matrices have a fixed size."""
    return max(least, -(-(df.agg(F.approx_count_distinct(key)).first()[0] or 0) // size))


def category_cosine(targets: DataFrame, peers: DataFrame, blocks: int = BLOCKS) -> DataFrame:
    """(target, peer, category, cos) of embeddings (sym, category, emb), joined within the category.

    Vectors are scaled to unit length once a side, so a pair costs one dot product. There are few
    categories, so peers are dealt into blocks and targets are repeated for each: the join has
    categories x blocks keys to spread over tasks.
    """
    a = targets.select(F.col("sym").alias("target"), "category", W.unit(F.col("emb")).alias("__a"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("__k"))
    b = peers.select(F.col("sym").alias("peer"), "category", W.unit(F.col("emb")).alias("__b"), F.pmod(F.hash("sym"), F.lit(blocks)).alias("__k"))
    return a.join(b, ["category", "__k"]).select("target", "peer", "category", W.dot(F.col("__a"), F.col("__b")).alias("cos"))


def block_similarity(targets: DataFrame, peers: DataFrame, category_weights: dict[int, float] | None = None, blocks: int | None = None) -> DataFrame:
    """(target, peer, sim): ``weighted_similarity`` of ``category_cosine``, as matrix products in Arrow.

    Targets and peers are dealt into blocks; each pair of blocks is one task that holds two blocks of
    vectors and multiplies them category by category, so pairs leave it already averaged and no row a
    category is ever shuffled.
    """
    kind = targets.schema["sym"].dataType.simpleString()
    blocks = blocks or max(blocks_for(targets), blocks_for(peers))
    block = lambda: F.pmod(F.hash("sym"), F.lit(blocks))
    all_ = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    a = targets.select("sym", "category", "emb", block().alias("i")).withColumn("j", all_)
    b = peers.select(F.col("sym").alias("peer"), F.col("category").alias("peer_category"), F.col("emb").alias("peer_emb"), block().alias("peer_j")).withColumn("peer_i", all_)

    def sides(t: pa.Table) -> tuple[list, dict]:
        t = t.select([0, 1, 2]).rename_columns(["sym", "category", "emb"])
        syms = sorted(set(t["sym"].to_pylist()))
        place = {s: k for k, s in enumerate(syms)}
        by: dict = {}
        for s, c, e in zip(t["sym"].to_pylist(), t["category"].to_pylist(), t["emb"], strict=True):
            rows, vectors = by.setdefault(c, ([], []))
            v = np.asarray(e.values, float)
            rows.append(place[s])
            vectors.append(v / (np.sqrt(v @ v) or 1.0))
        return syms, {c: (np.array(r), np.stack(v)) for c, (r, v) in by.items()}

    def multiply(left: pa.Table, right: pa.Table) -> pa.Table:
        (ts, x), (ps, y) = sides(left), sides(right)
        total, weight = np.zeros((len(ts), len(ps))), np.zeros((len(ts), len(ps)))
        for c in sorted(x.keys() & y.keys()):
            w = 1.0 if category_weights is None else category_weights.get(c, 0.0)
            at = np.ix_(x[c][0], y[c][0])
            total[at] += w * (x[c][1] @ y[c][1].T)
            weight[at] += w
        met = np.zeros(total.shape, bool)
        for c in x.keys() & y.keys():
            met[np.ix_(x[c][0], y[c][0])] = True
        i, j = np.nonzero(met)
        sim = np.divide(total[i, j], weight[i, j], out=np.zeros(len(i)), where=weight[i, j] > 0)
        return pa.table({"target": pa.array(ts, left["sym"].type).take(pa.array(i)), "peer": pa.array(ps, right["peer"].type).take(pa.array(j)), "sim": sim})

    return a.groupBy("i", "j").cogroup(b.groupBy("peer_i", "peer_j")).applyInArrow(multiply, f"target {kind}, peer {kind}, sim double")


def weighted_similarity(pairs: DataFrame, category_weights: dict[int, float] | None = None) -> DataFrame:
    """(target, peer, sim): mean over the categories that both have, weights renormalised; 0 without weight."""
    w = F.lit(1.0)
    if category_weights is not None:
        w = F.coalesce(F.create_map(*[F.lit(x) for kv in category_weights.items() for x in kv])[F.col("category")], F.lit(0.0))
    got = pairs.withColumn("__w", w).groupBy("target", "peer").agg(F.sum(F.col("__w") * F.col("cos")).alias("__s"), F.sum("__w").alias("__t"))
    return got.select("target", "peer", F.coalesce(F.try_divide("__s", "__t"), F.lit(0.0)).alias("sim"))


def complete_similarity(pairs: DataFrame, categories: int) -> DataFrame:
    """Sum of equally weighted cosines of pairs that share every category."""
    got = pairs.groupBy("target", "peer").agg(F.sum(F.col("cos") / categories).alias("sim"), F.countDistinct("category").alias("n"))
    return got.where(F.col("n") == categories).drop("n")


def pct_rank(edges: DataFrame, sim: str = "sim") -> DataFrame:
    """Adds ``pct``: a target's ordinal rank of each peer over its number of peers with a value."""
    return edges.withColumn("pct", ordinal_pct(sim, ["target"], "peer"))


def top_neighbours(edges: DataFrame, k: int, sim: str = "sim") -> DataFrame:
    """The k most similar other peers of each target, with renormalised weights left to the caller."""
    best = F.row_number().over(Window.partitionBy("target").orderBy(F.desc(sim), "peer"))
    return edges.where("target <> peer").withColumn("place", best).where(F.col("place") <= k)


def search(vectors: DataFrame, query: list[float], k: int, key: str = "vec_id", emb: str = "embedding") -> DataFrame:
    """The k rows nearest to a query vector by cosine; zero vectors last, ties by key."""
    q = F.array(*[F.lit(float(x)) for x in query])
    zero = W.dot(F.col(emb), F.col(emb)) == 0
    score = F.when(zero, F.lit(float("-inf"))).otherwise(W.cosine(F.col(emb), q))
    return vectors.select(key, score.alias("score")).orderBy(F.desc("score"), key).limit(k)


def mean_embedding(cats: DataFrame) -> DataFrame:
    """(sym, emb): positionwise mean over a symbol's categories."""
    flat = cats.select("sym", F.posexplode("emb").alias("pos", "x"))
    per = flat.groupBy("sym", "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return per.groupBy("sym").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("emb"))


def correlation_edges(returns: DataFrame, min_overlap: int, blocks: int | None = None) -> DataFrame:
    """(target, peer, corr, n) of return series (dt, sym, ret) over shared dates, at least ``min_overlap``.

    A pair in which a side has no variance has correlation 0; pairs under the overlap have none. Pairs
    leave their block as one row, so no row a pair and date is ever made.
    """
    return _walked(returns, [(None, None)], T.IntegerType(), min_overlap, blocks).select("target", "peer", "corr", "n")


def expanding_correlation_edges(returns: DataFrame, months: DataFrame, min_overlap: int, blocks: int | None = None) -> DataFrame:
    """(month, target, peer, corr, n): ``correlation_edges`` of the returns up to each (month, upto), for all months in one pass.

    Symbols are dealt into blocks. A task walks the dates of one pair of blocks once, keeps running means
    and co-moments of all its pairs as matrices, and gives a row a pair with a shared date at each month.
    Returns are unique by date and symbol; the calendar, one row a month, goes to the tasks.
    """
    stops = sorted((np.datetime64(r["upto"]), r["month"]) for r in months.select("month", "upto").collect())
    return _walked(returns, stops, months.schema["month"].dataType, min_overlap, blocks)


def _walked(returns: DataFrame, stops: list, month: T.DataType, min_overlap: int, blocks: int | None) -> DataFrame:
    """Correlations of all pairs up to each stop (date, name); a stop without date is the end."""
    from factorspark.functions.shipping import ship

    ship(returns.sparkSession)
    blocks = blocks or blocks_for(returns, "sym", SERIES_BLOCKS, BLOCK_ROWS // 2)
    kind = returns.schema["sym"].dataType
    out = pa.schema([("month", to_arrow_type(month)), ("target", to_arrow_type(kind)), ("peer", to_arrow_type(kind)), ("corr", pa.float64()), ("n", pa.int64())])
    deal = F.pmod(F.hash("sym"), F.lit(blocks))
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    rows = returns.where("ret IS NOT NULL").select("dt", "sym", F.col("ret").cast("double").alias("ret"))
    a = rows.select("*", deal.alias("i"), every.alias("j"))
    b = rows.select(F.col("dt").alias("peer_dt"), F.col("sym").alias("peer"), F.col("ret").alias("peer_ret"), deal.alias("peer_j"), every.alias("peer_i"))

    def side(t: pa.Table, dates: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        syms = t["sym"].combine_chunks().dictionary_encode()
        at = (np.searchsorted(dates, t["dt"].to_numpy()), syms.indices.to_numpy(zero_copy_only=False))
        x, known = np.zeros((len(dates), len(syms.dictionary))), np.zeros((len(dates), len(syms.dictionary)))
        x[at], known[at] = t["ret"].to_numpy(), 1.0
        return syms.dictionary, x, known

    def walk(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return out.empty_table()
        left, right = left.select(["dt", "sym", "ret"]), right.select(["peer_dt", "peer", "peer_ret"]).rename_columns(["dt", "sym", "ret"])
        dates = np.intersect1d(left["dt"].to_numpy(), right["dt"].to_numpy())
        left, right = (t.filter(pa.array(np.isin(t["dt"].to_numpy(), dates))) for t in (left, right))
        (targets, x, kx), (peers, y, ky) = side(left, dates), side(right, dates)
        n, mx, my, cxx, cyy, cxy = (np.zeros((len(targets), len(peers))) for _ in range(6))
        parts, done = [], 0
        for upto, name in stops:
            while done < len(dates) and (upto is None or dates[done] <= upto):
                both = np.outer(kx[done], ky[done])
                n += both
                share = both / np.maximum(n, 1.0)
                dx, dy = x[done][:, None] - mx, y[done][None, :] - my
                mx += dx * share
                my += dy * share
                rest = both * (y[done][None, :] - my)
                cxx += both * dx * (x[done][:, None] - mx)
                cyy += dy * rest
                cxy += dx * rest
                done += 1
            i, j = np.nonzero(n)
            if len(i):
                m = n[i, j]
                sx, sy = np.sqrt(cxx[i, j] / m), np.sqrt(cyy[i, j] / m)
                moves = (sx > 1e-14) & (sy > 1e-14)
                corr = np.divide(cxy[i, j] / m, sx * sy, out=np.zeros(len(i)), where=moves)
                parts.append(pa.table([pa.repeat(pa.scalar(name, out.field("month").type), len(i)), targets.take(pa.array(i)), peers.take(pa.array(j)), pa.array(corr, mask=m < min_overlap), pa.array(m.astype("int64"))], schema=out))
        return pa.concat_tables(parts) if parts else out.empty_table()

    return a.groupBy("i", "j").cogroup(b.groupBy("peer_i", "peer_j")).applyInArrow(walk, f"month {month.simpleString()}, target {kind.simpleString()}, peer {kind.simpleString()}, corr double, n long")


def gram(vectors: DataFrame, emb: str = "emb") -> tuple[int, np.ndarray, np.ndarray]:
    """Number, mean and centred cross products of the vectors, from one sum a partition; d x d numbers reach the driver."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            rows = batch.column(0)
            if len(rows):
                x = np.asarray(rows.flatten(), float).reshape(len(rows), -1)
                x = np.hstack([np.ones((len(x), 1)), x])
                total = x.T @ x if total is None else total + x.T @ x
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], ["i", "row"])

    def add(parts: pa.Table) -> pa.Table:
        row = np.sum([np.asarray(v.values, float) for v in parts["row"]], axis=0)
        return pa.table([parts["i"].slice(0, 1), pa.array([row], pa.list_(pa.float64()))], ["i", "row"])

    known = vectors.where(F.col(emb).isNotNull()).select(F.transform(emb, lambda x: x.cast("double")).alias("v"))
    sums = known.mapInArrow(scan, "i int, row array<double>").groupBy("i").applyInArrow(add, "i int, row array<double>").collect()
    if not sums:
        return 0, np.zeros(0), np.zeros((0, 0))
    m = np.array([r["row"] for r in sorted(sums, key=lambda r: r["i"])])
    n, mean = m[0, 0], m[0, 1:] / m[0, 0]
    return int(n), mean, m[1:, 1:] - n * np.outer(mean, mean)


@dataclass
class Whitening:
    """Directions of a table of vectors by falling variance: z = (x - mean) @ project; explained[w - 1] is the share of the first w."""

    mean: np.ndarray
    project: np.ndarray
    explained: np.ndarray


def fit_whitening(vectors: DataFrame, widest: int, emb: str = "emb") -> Whitening:
    """The decomposition behind sqrt(n) * U[:, :w] for every w up to ``widest``, from the vectors' cross products."""
    from factorspark.functions.shipping import ship

    ship(vectors.sparkSession)
    n, mean, cross = gram(vectors, emb)
    values, directions = np.linalg.eigh(cross)
    values, directions = np.maximum(values[::-1], 0.0), directions[:, ::-1]
    flat = values <= 1e-10 * max(values.max(initial=0.0), 1e-300)  # a direction without variance has coordinate 0
    scale = np.where(flat, 0.0, np.sqrt(n) / np.sqrt(np.where(flat, 1.0, values)))
    return Whitening(mean, directions[:, :widest] * scale[:widest], np.cumsum(values)[:widest] / max(values.sum(), 1e-300))


def whiten(vectors: DataFrame, k: int | Whitening, key: str = "sym", emb: str = "emb") -> DataFrame:
    """(key, z): whitened coordinates of the vectors, narrower ones being the first of them."""
    model = fit_whitening(vectors, k, emb) if isinstance(k, int) else k

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = np.asarray(batch.column(1).flatten(), float).reshape(batch.num_rows, -1)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list((x - model.mean) @ model.project), pa.list_(pa.float64()))], [key, "z"])

    rows = vectors.where(F.col(emb).isNotNull()).select(key, F.transform(emb, lambda x: x.cast("double")).alias("v"))
    return rows.mapInArrow(scan, f"{key} {rows.schema[key].dataType.simpleString()}, z array<double>")


def covariance(white: DataFrame, width: int | None = None, z: str = "z") -> DataFrame:
    """(i, j, cov) of the first ``width`` coordinates; the identity if whitening holds."""
    part = F.col(z) if width is None else F.slice(z, 1, width)
    rows = white.select(part.alias("v"))
    pairs = rows.select(F.posexplode("v").alias("i", "x"), "v").select("i", "x", F.posexplode("v").alias("j", "y"))
    return pairs.groupBy("i", "j").agg((F.sum(F.col("x") * F.col("y")) / F.count("*")).alias("cov"))
