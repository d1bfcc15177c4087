"""Queries over text, names, dates and JSON, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factorspark.functions import text as tx
from factorspark.plans.queries_cross import r
from factorspark.plans.registry import query
from factorspark.sources import fixtures as fx

_FILES = "SELECT s_suppkey AS k, CASE s_suppkey % 4 WHEN 0 THEN 'S' || s_suppkey || '_10-K_2024-02-' || lpad(CAST(s_suppkey % 28 + 1 AS VARCHAR), 2, '0') || '.pdf' WHEN 1 THEN 'S' || s_suppkey || '_AnnualReport.html' WHEN 2 THEN 'S' || s_suppkey || '.T.pdf' ELSE 'A_B' || s_suppkey || '_10-K_2023.pdf' END AS name FROM supplier"


def files(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    day = F.lpad((k % 28 + 1).cast("string"), 2, "0")
    name = F.when(k % 4 == 0, F.concat(F.lit("S"), k, F.lit("_10-K_2024-02-"), day, F.lit(".pdf"))).when(k % 4 == 1, F.concat(F.lit("S"), k, F.lit("_AnnualReport.html"))).when(k % 4 == 2, F.concat(F.lit("S"), k, F.lit(".T.pdf"))).otherwise(F.concat(F.lit("A_B"), k, F.lit("_10-K_2023.pdf")))
    return fx.table(spark, d, "supplier").select(k.alias("k"), name.alias("name"))


_BARE = "regexp_replace(name, '\\.[A-Za-z0-9]+$', '')"


@query("g1_parse_filename", f"WITH f AS ({_FILES}) SELECT k, coalesce(nullif(split_part({_BARE}, '_', 1), ''), 'unknown') AS symbol, coalesce(nullif(split_part({_BARE}, '_', 2), ''), 'unknown') AS kind, coalesce(nullif(split_part({_BARE}, '_', 3), ''), 'unknown') AS filed FROM f")
def g1(spark: SparkSession, d: str) -> DataFrame:
    return files(spark, d).select("k", tx.file_parts(F.col("name")).alias("p")).select("k", "p.*")


@query("g2_stored_symbols", f"WITH f AS ({_FILES}) SELECT k, regexp_extract({_BARE}, '^(.*)_[^_]+_[^_]+$', 1) AS symbol FROM f")
def g2(spark: SparkSession, d: str) -> DataFrame:
    return files(spark, d).select("k", tx.stored_symbol(F.col("name")).alias("symbol"))


_TICK = "SELECT s_suppkey AS k, s_suppkey || CASE s_suppkey % 5 WHEN 0 THEN '.T' WHEN 1 THEN '.TW' WHEN 2 THEN '.KS' WHEN 3 THEN '.HK' ELSE '' END AS sym FROM supplier"


def tickers(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    suffix = F.element_at(F.array(*map(F.lit, (".T", ".TW", ".KS", ".HK", ""))), (k % 5 + 1).cast("int"))
    return fx.table(spark, d, "supplier").select(k.alias("k"), F.concat(k.cast("string"), suffix).alias("sym"))


@query("g3_region_of_symbol", f"WITH f AS ({_TICK}) SELECT k, CASE WHEN sym LIKE '%.T' THEN 'jp_topix' WHEN sym LIKE '%.TW' THEN 'tw_twse' WHEN sym LIKE '%.KS' THEN 'kr_kospi' WHEN sym LIKE '%.HK' THEN 'hk_hsci' ELSE 'us_russell_1000' END AS region FROM f")
def g3(spark: SparkSession, d: str) -> DataFrame:
    return tickers(spark, d).select("k", tx.region(F.col("sym")).alias("region"))


@query("g4_hk_codes", "SELECT s_suppkey AS k, lpad(CAST(s_suppkey AS VARCHAR), CAST(greatest(4, length(CAST(s_suppkey AS VARCHAR))) AS INT), '0') || '.HK' AS code FROM supplier")
def g4(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    return fx.table(spark, d, "supplier").select(k.alias("k"), tx.hk_code(F.concat(F.lpad(k.cast("string"), 5, "0"), F.lit(".HK"))).alias("code"))


@query("g5_filing_urls", "SELECT o_orderkey AS k, lpad(CAST(o_custkey AS VARCHAR), 10, '0') AS cik, 'https://www.sec.gov/Archives/edgar/data/' || o_custkey || '/' || replace('0000-24-' || o_orderkey, '-', '') || '/doc.htm' AS url FROM orders")
def g5(spark: SparkSession, d: str) -> DataFrame:
    o = fx.table(spark, d, "orders")
    cik = tx.zfill(F.col("o_custkey").cast("string"), 10)
    return o.select(F.col("o_orderkey").alias("k"), cik.alias("cik"), tx.accession_url(cik, F.concat(F.lit("0000-24-"), "o_orderkey"), F.lit("doc.htm")).alias("url"))


@query("g6_roc_dates", "SELECT o_orderkey AS k, CAST(o_orderdate AS DATE) + INTERVAL 0 DAY = CAST(o_orderdate AS DATE) AS same, CAST(o_orderdate AS DATE) AS day FROM orders WHERE year(o_orderdate) - 1911 < 100 OR o_orderkey % 2 = 0")
def g6(spark: SparkSession, d: str) -> DataFrame:
    """Dates through their year-of-the-republic form and back (two-digit years padded)."""
    roc = F.concat(F.lpad((F.year("o_orderdate") - 1911).cast("string"), 3, "0"), F.lit("/"), F.date_format("o_orderdate", "MM/dd"))
    o = fx.table(spark, d, "orders").where("year(o_orderdate) - 1911 < 100 OR o_orderkey % 2 = 0")
    back = tx.roc_date(F.concat(F.lit("filed "), roc))
    return o.select(F.col("o_orderkey").alias("k"), (back == F.to_date("o_orderdate")).alias("same"), back.alias("day"))


@query("g7_iso_dates", "SELECT o_orderkey AS k, strftime(o_orderdate, '%Y-%m-%d') AS iso FROM orders")
def g7(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey") % 3
    raw = F.when(k == 0, F.date_format("o_orderdate", "yyyyMMdd")).when(k == 1, F.date_format("o_orderdate", "dd/MM/yyyy")).otherwise(F.date_format("o_orderdate", "yyyy/MM/dd"))
    return fx.table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), tx.iso_date(raw).alias("iso"))


@query("g8_month_keys", "SELECT o_orderkey AS k, strftime(o_orderdate, '%Y-%m') AS month, CAST(date_trunc('month', o_orderdate) AS DATE) AS first FROM orders")
def g8(spark: SparkSession, d: str) -> DataFrame:
    return fx.table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), tx.month_key(F.col("o_orderdate")).alias("month"), F.trunc("o_orderdate", "month").alias("first"))


@query("g9_s21_strip_html", "SELECT * FROM (SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')) AS text FROM pages) WHERE length(text) > 100")
def g9(spark: SparkSession, d: str) -> DataFrame:
    return fx.table(spark, d, "pages").select("page_id", tx.strip_html(F.col("html")).alias("text")).where("length(text) > 100")


@query("g10_truncate_text", "SELECT doc_id, CASE WHEN length(text) > 200 THEN substr(text, 1, 200) || chr(10) || '[TRUNCATED]' ELSE text END AS text FROM documents")
def g10(spark: SparkSession, d: str) -> DataFrame:
    """The feature itself is the cut: a text over the limit ends in a marker."""
    return fx.table(spark, d, "documents").select("doc_id", tx.truncate(F.col("text"), 200).alias("text"))


@query("g11_salvage_json", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def g11(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id") % 3
    reply = F.when(k == 0, F.concat(F.lit("```json\n"), "props", F.lit("\n```"))).when(k == 1, F.concat(F.lit("Here you are: "), "props", F.lit(" Done."))).otherwise(F.col("props"))
    return fx.table(spark, d, "events").select("event_id", F.from_json(tx.salvage_json(reply), "k long")["k"].alias("k"))


@query("g12_prompt_text", "SELECT conv_id, turn, 'MAIN BUSINESS SEGMENTS: ' || text || CASE WHEN role = 'user' THEN chr(10) || chr(10) || 'PRIMARY CUSTOMERS MARKETS: ' || role ELSE '' END AS prompt FROM conversations WHERE length(trim(text)) > 0")
def g12(spark: SparkSession, d: str) -> DataFrame:
    cats = F.create_map(F.lit(tx.CATEGORIES[0]), "text", F.lit(tx.CATEGORIES[2]), F.when(F.col("role") == "user", F.col("role")).otherwise(F.lit(" ")))
    return fx.table(spark, d, "conversations").where("length(trim(text)) > 0").select("conv_id", "turn", tx.prompt_text(cats).alias("prompt"))


@query("g13_parameter_names", "SELECT k, CAST(0.9 + k / 100.0 AS DOUBLE) AS c, CAST(10 * k AS DOUBLE) AS kk FROM (SELECT unnest([1, 5, 7, 9]) AS k)")
def g13(spark: SparkSession, d: str) -> DataFrame:
    """Encoded on the driver, decoded in columns."""
    rows = spark.createDataFrame([(k, tx.factor_name("us", "jp", "emb", round(0.9 + k / 100, 4), 10 * k)) for k in (1, 5, 7, 9)], "k int, name string")
    return rows.select("k", tx.decode_ck_column(F.col("name")).alias("p")).select("k", F.round("p.c", 6).alias("c"), F.col("p.k").alias("kk"))


@query("g14_fee_labels", "SELECT fee, label FROM (VALUES (0.0, '0.0 bp'), (0.0002, '2.0 bp'), (0.00055, '5.5 bp'), (0.002, '20.0 bp')) AS t(fee, label)")
def g14(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.createDataFrame([(0.0,), (0.0002,), (0.00055,), (0.002,)], "fee double")
    return rows.select("fee", tx.fee_label(F.col("fee")).alias("label"))


@query("g15_metric_names", "SELECT m, label FROM (VALUES ('ret_annual', 'Annual return'), ('ret_sharpe', 'Sharpe ratio'), ('other', 'other')) AS t(m, label)")
def g15(spark: SparkSession, d: str) -> DataFrame:
    names = F.create_map(*map(F.lit, ("ret_annual", "Annual return", "ret_sharpe", "Sharpe ratio")))
    rows = spark.createDataFrame([("ret_annual",), ("ret_sharpe",), ("other",)], "m string")
    return rows.select("m", F.coalesce(names[F.col("m")], "m").alias("label"))


@query("g16_listing_parse", "SELECT page_id, len(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS n, coalesce(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)[1], '') AS first FROM pages")
def g16(spark: SparkSession, d: str) -> DataFrame:
    links = F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))
    return fx.table(spark, d, "pages").select("page_id", F.size(links).cast("long").alias("n"), F.coalesce(F.try_element_at(links, F.lit(1)), F.lit("")).alias("first"))


@query("p7_relevant_pages", "WITH p AS (SELECT conv_id AS doc, turn AS page, lower(text) AS t, length(text) AS n FROM conversations), k AS (SELECT *, page < 2 OR (NOT regexp_matches(t, 'auditor') AND (regexp_matches(t, 'business') OR n > 100)) AS keep, count(*) OVER (PARTITION BY doc) AS c FROM p), q AS (SELECT *, count(*) FILTER (WHERE keep) OVER (PARTITION BY doc) AS kept FROM k) SELECT doc, page FROM q WHERE keep OR kept < greatest(2, c * 0.15)")
def p7(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    pages = fx.table(spark, d, "conversations").select(F.col("conv_id").alias("doc"), F.col("turn").alias("page"), "text")
    t = F.lower("text")
    keep = (F.col("page") < 2) | (~t.rlike("auditor") & (t.rlike("business") | (F.length("text") > 100)))
    w = Window.partitionBy("doc")
    rows = pages.withColumns({"keep": keep, "c": F.count(F.lit(1)).over(w)}).withColumn("kept", F.count_if("keep").over(w))
    return rows.where(F.col("keep") | (F.col("kept") < F.greatest(F.lit(2), F.col("c") * 0.15))).select("doc", "page")


@query("p8_empty_text", "SELECT doc_id FROM documents WHERE length(trim(text)) > 0")
def p8(spark: SparkSession, d: str) -> DataFrame:
    return fx.table(spark, d, "documents").where(F.length(F.trim("text")) > 0).select("doc_id")


@query("p14_report_preference", "SELECT conv_id, arg_min(role, (CASE role WHEN 'assistant' THEN 0 ELSE 1 END, turn)) AS role, CAST(arg_min(turn, (CASE role WHEN 'assistant' THEN 0 ELSE 1 END, turn)) AS BIGINT) AS turn FROM conversations GROUP BY 1")
def p14(spark: SparkSession, d: str) -> DataFrame:
    best = F.struct(F.when(F.col("role") == "assistant", 0).otherwise(1), F.col("turn"))
    return fx.table(spark, d, "conversations").groupBy("conv_id").agg(F.min_by("role", best).alias("role"), F.min_by("turn", best).alias("turn"))


@query("a6_latest_filing", "SELECT source, arg_max(doc_id, (n_chars, doc_id)) AS doc_id FROM documents GROUP BY 1")
def a6(spark: SparkSession, d: str) -> DataFrame:
    return fx.table(spark, d, "documents").groupBy("source").agg(F.max_by("doc_id", F.struct("n_chars", "doc_id")).alias("doc_id"))


@query("a52_source_counts", "SELECT source, count(*) AS n, round(avg(n_chars), 6) + 0.0 AS mean_chars FROM documents GROUP BY 1")
def a52(spark: SparkSession, d: str) -> DataFrame:
    return fx.table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n"), r(F.avg("n_chars"), "mean_chars"))


@query("s10_d11_report_json", "SELECT doc_id, lang AS form_type, text AS main FROM documents")
def s10(spark: SparkSession, d: str) -> DataFrame:
    """Reports with their whole texts to JSON text and back through the report schema."""
    from factorspark.sources.panel_store import REPORT

    docs = fx.table(spark, d, "documents")
    j = F.to_json(F.struct(F.col("doc_id").cast("string").alias("symbol"), F.col("lang").alias("report_type"), F.create_map(F.lit(tx.CATEGORIES[0]), F.col("text")).alias("categories")))
    back = docs.select(F.from_json(j, REPORT).alias("x"))
    return back.select(F.col("x.symbol").cast("long").alias("doc_id"), F.coalesce("x.form_type", "x.report_type").alias("form_type"), F.try_element_at("x.categories", F.lit(tx.CATEGORIES[0])).alias("main"))


@query("s13_d9_graph_json", "SELECT 'S' || l_suppkey AS source, CAST(l_partkey AS VARCHAR) || '.T' AS target FROM lineitem")
def s13(spark: SparkSession, d: str) -> DataFrame:
    """Links of each source as JSON lists and back; a list holds at most the lines of 16,384 order numbers."""
    rows = fx.table(spark, d, "lineitem").groupBy(F.concat(F.lit("S"), "l_suppkey").alias("s"), F.floor(F.col("l_orderkey") / 16384).alias("part"))
    j = rows.agg(F.to_json(F.collect_list(F.struct(F.concat(F.col("l_partkey").cast("string"), F.lit(".T")).alias("jp_ticker")))).alias("j"))
    back = j.select("s", F.explode(F.from_json("j", "array<struct<jp_ticker: string>>")).alias("c"))
    return back.select(F.col("s").alias("source"), F.col("c.jp_ticker").alias("target"))
