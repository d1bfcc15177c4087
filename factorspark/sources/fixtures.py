"""Views of the driver tables in the shapes that the panel operators read, as DataFrames and as SQL.

Each ``*_SQL`` text is a chain of common table expressions that DuckDB can run; the function of the
same name builds the same rows as a DataFrame. Both sides use integer sums where the order of a sum
could matter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


PANEL_SQL = """panel AS (
  SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS dt, l_suppkey AS sym,
         CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS DOUBLE) / CAST(sum(CAST(l_quantity AS BIGINT)) AS DOUBLE) AS close,
         CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS volume
  FROM lineitem GROUP BY 1, 2)"""


def panel(spark: SparkSession, d: str) -> DataFrame:
    """Monthly panel (dt, sym, close, volume), one row a supplier and month with shipments."""
    cents = F.sum(F.round(F.col("l_extendedprice") * 100).cast("long"))
    volume = F.sum(F.col("l_quantity").cast("long"))
    rows = table(spark, d, "lineitem").groupBy(F.trunc("l_shipdate", "month").alias("dt"), F.col("l_suppkey").alias("sym"))
    return rows.agg((cents.cast("double") / volume.cast("double")).alias("close"), volume.alias("volume"))


SYMBOLS_SQL = """symbols AS (
  SELECT s_suppkey AS sym, s_suppkey % 7 AS sector, n_regionkey AS region, s_acctbal AS weight
  FROM supplier JOIN nation ON n_nationkey = s_nationkey)"""


def symbols(spark: SparkSession, d: str) -> DataFrame:
    """Symbol dictionary (sym, sector, region, weight)."""
    nation = table(spark, d, "nation")
    s = table(spark, d, "supplier").join(F.broadcast(nation), F.col("n_nationkey") == F.col("s_nationkey"))  # 25 nations
    return s.select(F.col("s_suppkey").alias("sym"), (F.col("s_suppkey") % 7).alias("sector"), F.col("n_regionkey").alias("region"), F.col("s_acctbal").alias("weight"))


FL_SQL = (
    PANEL_SQL
    + ", "
    + SYMBOLS_SQL
    + """, fl AS (
  SELECT dt, panel.sym AS sym, close, volume, sector, region, weight,
         close / nullif(lag(close, 3) OVER w, 0) - 1 AS factor, lead(close) OVER w / nullif(close, 0) - 1 AS label
  FROM panel JOIN symbols USING (sym) WINDOW w AS (PARTITION BY panel.sym ORDER BY dt)), ok AS (
  SELECT * FROM fl WHERE factor IS NOT NULL AND label > -1)"""
)


def fl(spark: SparkSession, d: str) -> DataFrame:
    """Panel with factor (three-month return), next-month label and symbol attributes."""
    w = Window.partitionBy("sym").orderBy("dt")
    rows = panel(spark, d).join(symbols(spark, d), "sym")
    return rows.select("dt", "sym", "close", "volume", "sector", "region", "weight", (F.try_divide("close", F.lag("close", 3).over(w)) - 1).alias("factor"), (F.try_divide(F.lead("close").over(w), F.col("close")) - 1).alias("label"))


def ok(spark: SparkSession, d: str) -> DataFrame:
    """Rows of ``fl`` with a factor and a label over -1."""
    return fl(spark, d).where("factor IS NOT NULL AND label > -1")


CATEGORIES_SQL = """cats AS (
  SELECT vec_id AS sym, c AS category, list_slice(embedding, c * 16 + 1, c * 16 + 16) AS emb
  FROM embeddings, (SELECT unnest([0, 1, 2, 3]) AS c) WHERE (vec_id + c) % 7 <> 0 AND vec_id <= (SELECT max(s_suppkey) FROM supplier) AND vec_id > 0)"""


def categories(spark: SparkSession, d: str) -> DataFrame:
    """Category embeddings (sym, category, emb): four slices of 16; some symbols lack some categories."""
    top = table(spark, d, "supplier").agg(F.max("s_suppkey").alias("top"))
    e = table(spark, d, "embeddings").join(F.broadcast(top), (F.col("vec_id") <= F.col("top")) & (F.col("vec_id") > 0))  # one row
    e = e.select(F.col("vec_id").alias("sym"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("category"), "embedding")
    return e.where((F.col("sym") + F.col("category")) % 7 != 0).select("sym", "category", F.slice("embedding", F.col("category") * 16 + 1, F.lit(16)).alias("emb"))


EDGES_SQL = """edges AS (
  SELECT DISTINCT l_suppkey AS target, l_partkey % (SELECT count(*) FROM supplier) + 1 AS peer FROM lineitem WHERE l_partkey % 10 = 3 AND l_suppkey % 4 <> 0)"""


def edges(spark: SparkSession, d: str) -> DataFrame:
    """Relationship edges (target, peer); a quarter of the targets have none."""
    n = table(spark, d, "supplier").agg(F.count("*").alias("n"))
    rows = table(spark, d, "lineitem").where("l_partkey % 10 = 3 AND l_suppkey % 4 <> 0").crossJoin(F.broadcast(n))  # one row
    return rows.select(F.col("l_suppkey").alias("target"), (F.col("l_partkey") % F.col("n") + 1).alias("peer")).distinct()


SERIES_SQL = """series AS (
  SELECT CAST(floor(epoch(date_trunc('hour', ts)) / 3600) AS BIGINT) AS t, CAST(date_trunc('day', min(ts)) AS DATE) AS day,
         CAST(sum(CAST(round(value * 10000) AS BIGINT)) AS DOUBLE) / (10000.0 * count(*)) AS x
  FROM events WHERE event_type = 'click' GROUP BY 1, date_trunc('hour', ts)), ts AS (
  SELECT t, day, x, lead(x) OVER (ORDER BY t) / nullif(x, 0) - 1 AS raw FROM series), tsl AS (
  SELECT t, day, x AS factor, greatest(-0.5, least(0.5, raw)) / 10 AS label FROM ts WHERE raw IS NOT NULL)"""


def series(spark: SparkSession, d: str) -> DataFrame:
    """One hourly series (t, day, factor, label): mean value of click events, next relative change."""
    e = table(spark, d, "events").where("event_type = 'click'")
    hour = F.date_trunc("hour", "ts")
    cents = F.sum(F.round(F.col("value") * 10000).cast("long")).cast("double")
    s = e.groupBy(F.floor(F.unix_timestamp(hour.cast("timestamp")) / 3600).alias("t")).agg((cents / (F.lit(10000.0) * F.count("*"))).alias("x"), F.min(F.to_date(hour)).alias("day"))
    raw = F.try_divide(F.lead("x").over(Window.partitionBy(F.lit(0)).orderBy("t")), F.col("x")) - 1
    s = s.select("t", "day", F.col("x").alias("factor"), raw.alias("raw")).where("raw IS NOT NULL")
    return s.select("t", "day", "factor", (F.greatest(F.lit(-0.5), F.least(F.lit(0.5), "raw")) / 10).alias("label"))
