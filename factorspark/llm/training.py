"""Bounded samples of labelled rows for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROWS = 3000
BYTES = 10 << 20


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, where: Column | None = None, rows: int = ROWS, size: int = BYTES, id_col: str = "doc_id", text_col: str = "text") -> list[tuple[int, int, str]]:
    """(id, label, whole text) of labelled documents, taken in the order of a hash of the id.

    At most ``rows`` rows and ``size`` bytes of text are taken, a bound that does not grow with the
    corpus; a text that would go over the bound is left out. Only labels of documents at hand count
    towards it. Rows without id or label teach nothing; an id's label is its greatest, its text the
    shortest and then the least. ``where`` is a condition on the labels.
    """
    known = labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull())
    if where is not None:
        known = known.where(where)
    known = known.groupBy(F.col(id_col).cast("long").alias("id")).agg(F.max(label).cast("int").alias("y"))
    heads = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.octet_length(text_col), F.lit(0)).alias("n"))
    heads = heads.where("id IS NOT NULL").groupBy("id").agg(F.min("n").alias("n"))
    left, chosen = size, []
    for r in known.join(heads, "id").orderBy(F.xxhash64("id"), "id").limit(rows).collect():
        if r["n"] <= left:
            left -= r["n"]
            chosen.append((r["id"], r["y"], r["n"]))
    if not chosen:
        return []
    few = docs.sparkSession.createDataFrame(sorted(chosen), "id long, y int, n int")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(few), "id").where(F.octet_length("text") == F.col("n"))
    found = texts.groupBy("id", "y").agg(F.min("text").alias("text")).collect()
    return sorted((r["id"], r["y"], r["text"]) for r in found)


def held_out(id_col: str = "doc_id") -> Column:
    """Whether a row's id is in the held-out quarter: crc32 of the id's digits, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))
