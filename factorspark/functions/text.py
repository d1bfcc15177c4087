"""String, date and JSON functions over filings, tickers and listings, as Column builders."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FILINGS = "https://www.sec.gov/Archives" + "/edgar"
REGION_SUFFIXES = ((".T", "jp_topix"), (".TW", "tw_twse"), (".KS", "kr_kospi"), (".HK", "hk_hsci"))
CATEGORIES = tuple("main_business_segments core_technologies_production_methods primary_customers_markets geographic_coverage supply_chain_position strategic_focus_rd_direction revenue_model key_competitors_industry_positioning financial_scale_growth_profile value_proposition_product_differentiation".split())


def file_parts(name: Column) -> Column:
    """Struct (symbol, kind, filed) of SYMBOL_TYPE_DATE.ext names; missing parts are 'unknown'."""
    parts = F.split(F.regexp_replace(name, "\\.[A-Za-z0-9]+$", ""), "_")
    part = lambda k: F.coalesce(F.nullif(F.try_element_at(parts, F.lit(k)), F.lit("")), F.lit("unknown"))
    return F.struct(part(1).alias("symbol"), part(2).alias("kind"), part(3).alias("filed"))


def stored_symbol(name: Column) -> Column:
    """What stands before the last two underscores of a file name."""
    return F.regexp_extract(F.regexp_replace(name, "\\.[A-Za-z0-9]+$", ""), "^(.*)_[^_]+_[^_]+$", 1)


def region(symbol: Column) -> Column:
    out = None
    for suffix, name in REGION_SUFFIXES:
        rule = symbol.endswith(suffix)
        out = F.when(rule, F.lit(name)) if out is None else out.when(rule, F.lit(name))
    return out.otherwise(F.lit("us_russell_1000"))


def zfill(x: Column, n: int) -> Column:
    """Zeros on the left up to n characters; longer values stay whole."""
    return F.when(F.length(x) < n, F.lpad(x, n, "0")).otherwise(x)


def hk_code(x: Column) -> Column:
    """Four-digit Hong Kong code with its suffix."""
    digits = F.regexp_replace(F.regexp_replace(x, "\\.HK$", ""), "^0+", "")
    return F.concat(zfill(digits, 4), F.lit(".HK"))


def accession_url(cik: Column, accession: Column, document: Column) -> Column:
    return F.concat(F.lit(FILINGS + "/data/"), F.regexp_replace(cik, "^0+(?=.)", ""), F.lit("/"), F.replace(accession, F.lit("-"), F.lit("")), F.lit("/"), document)


def roc_date(x: Column) -> Column:
    """Date of a year counted from 1911, as yyy/MM/dd."""
    part = lambda k: F.regexp_extract(x, "([0-9]{3})/([0-9]{2})/([0-9]{2})", k)
    return F.when(x.rlike("[0-9]{3}/[0-9]{2}/[0-9]{2}"), F.try_to_date(F.concat((part(1).try_cast("int") + 1911).cast("string"), F.lit("-"), part(2), F.lit("-"), part(3))))


def iso_date(x: Column) -> Column:
    """ISO text of yyyyMMdd, dd/MM/yyyy and yyyy/MM/dd; other text is passed on."""
    compact = F.concat_ws("-", F.substring(x, 1, 4), F.substring(x, 5, 2), F.substring(x, 7, 2))
    return F.when(x.rlike("^[0-9]{8}$"), compact).when(x.rlike("^[0-9]{2}/[0-9]{2}/[0-9]{4}"), F.regexp_replace(F.substring(x, 1, 10), "^([0-9]{2})/([0-9]{2})/([0-9]{4})$", "$3-$2-$1")).when(x.rlike("^[0-9]{4}/[0-9]{2}/[0-9]{2}$"), F.replace(x, F.lit("/"), F.lit("-"))).otherwise(x)


def month_key(dt: Column) -> Column:
    return F.date_format(dt, "yyyy-MM")


def strip_html(x: Column) -> Column:
    """Text between tags, white space collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(x, "<[^>]+>", " "), "\\s+", " "))


def truncate(x: Column, n: int, mark: str = "\n[TRUNCATED]") -> Column:
    return F.when(F.length(x) > n, F.concat(F.substring(x, 1, n), F.lit(mark))).otherwise(x)


def salvage_json(x: Column) -> Column:
    """The JSON object in a model's reply: code fences dropped, else first brace to last."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(F.trim(x), "^```(?:json)?\\s*", ""), "\\s*```$", ""))
    return F.when(bare.startswith("{") & bare.endswith("}"), bare).otherwise(F.nullif(F.regexp_extract(bare, "(?s)\\{.*\\}", 0), F.lit("")))


def prompt_text(categories: Column, keys: tuple[str, ...] = CATEGORIES[:3]) -> Column:
    """Labelled paragraphs of the categories that have text."""
    part = lambda k: F.when(F.length(F.trim(F.try_element_at(categories, F.lit(k)))) > 0, F.concat(F.lit(k.replace("_", " ").upper() + ": "), F.try_element_at(categories, F.lit(k))))
    return F.concat_ws("\n\n", *[part(k) for k in keys])


def relevant_pages(pages: DataFrame, doc: str = "doc", page: str = "page", text: str = "text", relevant: str = "business|product", irrelevant: str = "auditor|signature", first: int = 6) -> DataFrame:
    """Pages to read: the first ones, then relevant or long ones that aren't irrelevant; all of them where
    fewer than the greater of 8 and 15 % would be left."""
    t = F.lower(text)
    keep = (F.col(page) < first) | (~t.rlike(irrelevant) & (t.rlike(relevant) | (F.length(text) > 500)))
    w = Window.partitionBy(doc)
    rows = pages.withColumns({"__k": keep, "__n": F.count(F.lit(1)).over(w)})
    rows = rows.withColumn("__kept", F.count_if("__k").over(w))
    return rows.where(F.col("__k") | (F.col("__kept") < F.greatest(F.lit(8), F.col("__n") * 0.15))).drop("__k", "__n", "__kept")


def encode_ck(c, k):
    """Name part of sigmoid parameters: (0.99, 50) -> c0_99_k50."""
    number = lambda v: (str(int(v)) if float(v).is_integer() else f"{v:g}" if v < 1e-3 else f"{v:.10f}".rstrip("0")).replace(".", "_")
    c_text = f"{c:.2f}" if round(c, 2) == c else f"{c:.10f}".rstrip("0")
    return f"c{c_text.replace('.', '_')}_k{number(k)}"


def decode_ck(name: str) -> tuple[float, float]:
    m = re.fullmatch(r"c(\d+)_(\d+)_k(\d+(?:_\d+)?)", name)
    if m is None:
        raise ValueError(f"not a parameter name: {name}")
    return float(f"{m[1]}.{m[2]}"), float(m[3].replace("_", "."))


def encode_threshold(t: float) -> str:
    whole, part = divmod(round(100 * t), 100)
    return f"t{whole}_{part:02d}"


def factor_name(target: str, peer: str, kind: str, c: float, k: float) -> str:
    return f"{target}__{peer}__{kind}__{encode_ck(c, k)}"


def parse_factor_name(name: str) -> dict[str, object]:
    target, peer, kind, ck = name.split("__")
    c, k = decode_ck(ck)
    return {"target": target, "peer": peer, "kind": kind, "c": c, "k": k}


def decode_ck_column(x: Column) -> Column:
    """Struct (c, k) of a name that ends in encoded parameters."""
    pattern = "c([0-9]+)_([0-9]+)_k([0-9]+)$"
    c = F.concat(F.regexp_extract(x, pattern, 1), F.lit("."), F.regexp_extract(x, pattern, 2)).try_cast("double")
    return F.struct(c.alias("c"), F.regexp_extract(x, pattern, 3).try_cast("double").alias("k"))


def fee_label(fee: Column) -> Column:
    """Fee in basis points with one decimal."""
    return F.concat(F.format_string("%.1f", F.round(fee * 10000, 1)), F.lit(" bp"))
