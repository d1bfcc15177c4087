"""Date-partitioned panel store, filing JSON, symbol dictionaries and edge caches.

Layout ``product=/region=/freq=/source=/date=``: a date range or a region prunes directories, chosen
fields prune columns.
"""

from __future__ import annotations

import csv
import io
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factorspark.functions.text import CATEGORIES
from factorspark.operators.returns import densify

KEYS = ("product", "region", "freq", "source")


def save_panel(df: DataFrame, path: str, product: str, region: str, freq: str, source: str, overwrite: bool = True) -> None:
    """Writes (date, symbol, fields) by date; with ``overwrite`` only the dates at hand are replaced."""
    tagged = df.withColumns({k: F.lit(v) for k, v in zip(KEYS, (product, region, freq, source), strict=True)})
    if not overwrite:
        have = existing_dates(df.sparkSession, path, product, region, freq, source)
        if have is not None:
            tagged = tagged.join(have, "date", "left_anti")
    writer = tagged.repartition("date").sortWithinPartitions("date", "symbol").write.mode("overwrite" if overwrite else "append").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(*KEYS, "date").parquet(path)


def _stored(spark: SparkSession, path: str, **where: str) -> DataFrame:
    df = spark.read.parquet(path)
    for k, v in where.items():
        df = df.where(F.col(k) == v)
    return df


def existing_dates(spark: SparkSession, path: str, product: str, region: str, freq: str, source: str) -> DataFrame | None:
    """(date) of the stored partitions; None if nothing is stored."""
    from pyspark.errors import AnalysisException

    try:
        return _stored(spark, path, product=product, region=region, freq=freq, source=source).select("date").distinct()
    except AnalysisException:
        return None


def load_panel(spark: SparkSession, path: str, product: str, region: str, freq: str, source: str, start: str, end: str, fields: list[str], symbols: list[str] | None = None, dense: bool = True) -> DataFrame:
    """(date, symbol, fields) in an inclusive range of dates, every date with every symbol if ``dense``."""
    df = _stored(spark, path, product=product, region=region, freq=freq, source=source).where(F.col("date").between(start, end))
    if symbols is not None:
        df = df.where(F.col("symbol").isin(*symbols))
    df = df.select("date", "symbol", *fields)
    return densify(df, "date", "symbol") if dense else df


def copy_selected(spark: SparkSession, src: str, dst: str, key: dict[str, str], fields: dict[str, str], symbols: list[str], start: str, end: str) -> None:
    """Copies chosen fields under new names (new: old) for listed symbols; absent cells stay null."""
    have = load_panel(spark, src, **key, start=start, end=end, fields=list(dict.fromkeys(fields.values())), dense=False)
    wanted = spark.createDataFrame([(s,) for s in dict.fromkeys(symbols)], "symbol string")
    grid = have.select("date").distinct().crossJoin(F.broadcast(wanted))  # the caller's own list
    out = grid.join(have, ["date", "symbol"], "left").select("date", "symbol", *[F.col(old).alias(new) for new, old in fields.items()])
    save_panel(out, dst, **key)


REPORT = "symbol string, form_type string, report_type string, filing_date string, source_file string, categories map<string,string>"


def load_reports(spark: SparkSession, paths: list[str]) -> DataFrame:
    """One row a filing: missing categories become empty texts, the folder names the source."""
    raw = spark.read.schema(REPORT + ", _corrupt_record string").option("multiLine", True).option("mode", "PERMISSIVE").json(paths)
    raw = raw.select("*", F.col("_metadata.file_path").alias("__p")).where("_corrupt_record IS NULL AND symbol IS NOT NULL")
    cats = F.map_from_arrays(F.array(*map(F.lit, CATEGORIES)), F.array(*[F.coalesce(F.try_element_at("categories", F.lit(c)), F.lit("")) for c in CATEGORIES]))
    return raw.select("symbol", F.coalesce("form_type", "report_type").alias("form_type"), "filing_date", "source_file", cats.alias("categories"), F.regexp_extract("__p", "([^/]+)/[^/]+$", 1).alias("source"))


def latest_filing(reports: DataFrame) -> DataFrame:
    """The filing of each symbol with the greatest date text, ties by file name."""
    best = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("filing_date"), F.desc("source_file")))
    return reports.withColumn("__n", best).where("__n = 1").drop("__n")


def symbol_sectors(spark: SparkSession, path: str) -> DataFrame:
    """(symbol, region, sector) of a symbol dictionary; the GICS sector wins where it has text."""
    df = spark.read.option("header", True).csv(path)
    return df.select(F.col("SYMBOL").alias("symbol"), "region", F.when(F.col("gics_sector").isNotNull() & (F.col("gics_sector") != ""), F.col("gics_sector")).otherwise(F.col("sector")).alias("sector"))


def edinet_codes(spark: SparkSession, path: str) -> DataFrame:
    """(symbol, edinet_code, name) of listed filers with five-digit codes in EDINET code lists.

    The lists are cp932, which Spark's readers do not take, with a title row above the header; each file
    is small and is decoded whole in one task.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [r for content in batch.column(0).to_pylist() for r in list(csv.reader(io.StringIO(content.decode("cp932"))))[2:]]
            found = [(f"{r[11][:4]}.T", r[0], r[6]) for r in rows if len(r) > 11 and re.fullmatch("[0-9]{5}", r[11]) and r[2] in ("上場", "Listed company", "Listed")]
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.string()) for k in range(3)], ["symbol", "edinet_code", "name"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(scan, "symbol string, edinet_code string, name string")


def twse_codes(spark: SparkSession, path: str) -> DataFrame:
    """(symbol, stock_id, company) of the Taiwanese rows of a symbol dictionary."""
    df = spark.read.option("header", True).csv(path)
    return df.where(F.col("region") == "tw_twse").select(F.col("SYMBOL").alias("symbol"), F.regexp_replace("SYMBOL", "\\.TW$", "").alias("stock_id"), "company")


def dart_codes(spark: SparkSession, path: str) -> DataFrame:
    """(symbol, corp_code, corp_name) of a DART XML list; companies without stock code are left out."""
    df = spark.read.format("xml").option("rowTag", "list").schema("corp_code string, corp_name string, stock_code string").load(path)
    code = F.trim("stock_code")
    return df.where(F.length(code) > 0).select(F.concat(code, F.lit(".KS")).alias("symbol"), "corp_code", "corp_name")


def hkex_codes(spark: SparkSession, path: str) -> DataFrame:
    """(symbol, stock_id) of a Hong Kong JSON list of {c: code, i: id} rows."""
    df = spark.read.schema("c string, i string").option("multiLine", True).json(path)
    digits = F.regexp_replace("c", "^0", "")
    return df.where(F.length("c") == 5).select(F.concat(digits, F.lit(".HK")).alias("symbol"), F.col("i").alias("stock_id"))


def load_graph(spark: SparkSession, path: str) -> DataFrame:
    """(source, target) edges of a JSON object {symbol: {connections: [{jp_ticker}]}}."""
    text = spark.read.option("wholetext", True).text(path)
    shape = "map<string, struct<connections: array<struct<jp_ticker: string>>>>"
    pairs = text.select(F.explode(F.from_json("value", shape)).alias("source", "v"))
    return pairs.select("source", F.explode("v.connections").alias("c")).select("source", F.col("c.jp_ticker").alias("target"))


def save_edges(edges: DataFrame, path: str, *by: str) -> None:
    """Stores similarity or correlation edges partitioned by their cache key."""
    edges.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def load_edges(spark: SparkSession, path: str, **key: object) -> DataFrame:
    df = spark.read.parquet(path)
    for k, v in key.items():
        df = df.where(F.col(k) == v)
    return df


def cached_keys(spark: SparkSession, path: str, *by: str) -> DataFrame:
    """Which keys a cache holds, from its partition columns alone."""
    return spark.read.parquet(path).select(*by).distinct()
