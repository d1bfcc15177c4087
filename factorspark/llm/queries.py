"""Queries of this subpackage and their SQL, as ``__spark_entry__`` registers them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factorspark.functions.shipping import ship
from factorspark.llm import decontam, htmltext, mixing, quality, runtime, sharding, simhash, tokencount, toxicity, urlfilter, warc


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the archives of all pages hold, read back from them."""
    manifest, path = warc.archive(_read(spark, sf_dir, "pages"))
    return warc.read(manifest, path)


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every (document, benchmark item) with at least 0.8 of the item's five-word shingles."""
    return decontam.containments(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return htmltext.extract_table(_read(spark, sf_dir, "pages"), htmltext.train())


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base figures and verdict of every document."""
    docs = _read(spark, sf_dir, "documents")
    return quality.judge(docs, quality.train(docs, _read(spark, sf_dir, "labels")))


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = simhash.near_duplicates(_read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and place of every document under the law of near equal bytes; the map is stored and read."""
    return sharding.assign(_read(spark, sf_dir, "documents"), map_path=runtime.new_dir(spark, "slot-map"))


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's URL."""
    pages = _read(spark, sf_dir, "pages")
    mined = urlfilter.mine(urlfilter.labelled_urls(pages, _read(spark, sf_dir, "labels")))
    return urlfilter.judge_table(pages, urlfilter.Rules(mined=mined))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document."""
    return mixing.mix(_read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document, counted in flat token files."""
    return tokencount.count_tokens(_read(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document by the noisy-or of its sentences."""
    docs = _read(spark, sf_dir, "documents")
    return toxicity.score_table(docs, toxicity.train(docs, _read(spark, sf_dir, "labels")))


OP1_SQL = """
WITH p AS (SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
r AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS head FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 1000 AND page_id <> head THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> head THEN head END AS refers_to,
       CASE WHEN payload_bytes >= 1000 AND page_id <> head THEN 1 ELSE CAST(greatest(1, ceil(payload_bytes / 262144.0)) AS BIGINT) END AS segments
FROM r
"""
_WORDS = "list_filter(regexp_split_to_array(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"
OP2_SQL = f"""
WITH item_words AS (SELECT item_id, {_WORDS.format("text")} AS w FROM benchmark WHERE text IS NOT NULL),
item_grams AS (SELECT DISTINCT item_id, least(len(w), 5) AS width, unnest(list_transform(range(1, greatest(len(w) - 5, 0) + 2), lambda i: array_to_string(w[i:i + 4], ' '))) AS g FROM item_words WHERE len(w) > 0),
items AS (SELECT item_id, count(*) AS n FROM item_grams GROUP BY item_id),
doc_words AS (SELECT doc_id, {_WORDS.format("text")} AS w FROM documents WHERE text IS NOT NULL),
widths AS (SELECT DISTINCT width FROM item_grams),
doc_grams AS (SELECT DISTINCT doc_id, width, unnest(list_transform(range(1, len(w) - width + 2), lambda i: array_to_string(w[i:i + width - 1], ' '))) AS g FROM doc_words, widths WHERE len(w) >= width),
shared AS (SELECT doc_id, item_id, count(*) AS shared FROM doc_grams JOIN item_grams USING (width, g) GROUP BY doc_id, item_id)
SELECT CAST(doc_id AS BIGINT) AS doc_id, CAST(item_id AS BIGINT) AS item_id, CAST(n AS BIGINT) AS item_shingles, CAST(shared AS BIGINT) AS shared, CAST(shared AS DOUBLE) / n AS containment
FROM shared JOIN items USING (item_id) WHERE shared >= 0.8 * n
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_warc, op2_benchmark_decontamination, op3_html_extraction, op4_quality_rules, op5_simhash_near_dedup, op6_sharding, op7_url_filters, op8_mixing, op9_token_counts, op10_toxicity)}


def oracle_sql() -> dict[str, str]:
    return {"op1_warc": OP1_SQL, "op2_benchmark_decontamination": OP2_SQL}
