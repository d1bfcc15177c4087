"""Stages of the pipeline on tables whose extra columns have the operators' own names."""

import os

import pytest
from pyspark.sql import functions as F

CLASH = ["copies", "size", "part", "shard", "slot", "law", "key", "__key", "__row", "__n", "score", "row", "none", "id", "fp", "label", "n", "m", "total", "virtual_slot", "x", "bucket", "due", "doc.id"]
D = "/root/testdata/sf0.001"


@pytest.fixture
def clashing(docs_of):
    texts = [(k, f"word{k} alpha beta gamma delta number {k} of many words in this text") for k in range(60)] + [(100, "same words here in both of them"), (101, "same words here in both of them"), (102, None), (102, None), (None, "no id")]
    df = docs_of(texts)
    return df.withColumns({c: F.concat(F.lit(f"{c}-"), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))) for c in CLASH})


def intact(rows, columns=CLASH):
    return all(r[c] == f"{c}-{'none' if r['doc_id'] is None else r['doc_id']}" for r in rows for c in columns)


def test_near_dedup_keeps_columns(clashing):
    from factorspark.llm import simhash

    got = simhash.drop_near_duplicates(clashing)
    assert got.columns == clashing.columns
    rows = got.collect()
    assert intact(rows) and {100, 102} <= {r.doc_id for r in rows} and 101 not in {r.doc_id for r in rows}


def test_toxicity_and_decontamination_keep_columns(spark, clashing):
    from factorspark.llm import decontam, toxicity

    model = toxicity.train(clashing, spark.createDataFrame([], "doc_id long, toxic int"))
    got = toxicity.drop_toxic(clashing, model)
    assert got.columns == clashing.columns and intact(got.collect()) and got.count() == clashing.count()
    bench = spark.createDataFrame([(1, "word3 alpha beta gamma delta number 3 of many words"), (2, "word5 alpha beta gamma delta number 5 of many")], "item_id long, text string")
    for block in (10**6, 5):
        got = decontam.decontaminate(clashing, bench, block=block)
        rows = got.collect()
        assert got.columns == clashing.columns and intact(rows) and len(rows) == clashing.count() - 2


def test_mixing_keeps_columns(clashing):
    from factorspark.llm import mixing

    got = mixing.apply_mix(clashing)
    assert got.columns == clashing.columns and intact(got.collect())


def test_sharding_keeps_values(clashing):
    from factorspark.llm import sharding

    got = sharding.assign(clashing, keep=tuple(c for c in clashing.columns if c != "doc_id"))
    rows = got.collect()
    assert len(set(got.columns)) == len(got.columns) and len(rows) == clashing.count()
    added = {"size", "shard", "slot", "law", "virtual_slot"}
    assert intact(rows, [c for c in CLASH if c not in added])
    assert all(r[f"{c}_in"] == f"{c}-{'none' if r['doc_id'] is None else r['doc_id']}" for r in rows for c in added)
    assert all(0 <= r["shard"] < 24 for r in rows)


@pytest.mark.skipif(not os.path.isdir(D), reason="needs the small tables")
def test_whole_pipeline(spark, tmp_path, clashing):
    import corpus_pipeline

    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{D}/{t}.parquet").write.parquet(str(tmp_path / f"{t}.parquet"))
    usual = spark.read.parquet(f"{D}/documents.parquet")
    extra = usual.withColumns({c: F.concat(F.lit(f"{c}-"), F.col("doc_id").cast("string")) for c in CLASH})
    extra.write.parquet(str(tmp_path / "documents.parquet"))
    plain = sorted((r.doc_id, r.shard, r.slot) for r in corpus_pipeline.run(spark, D).collect())
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.shard, r.slot) for r in rows) == plain
    assert intact(rows, ["copies", "part", "key", "__key", "__row", "__n", "score", "doc.id"])


@pytest.mark.skipif(not os.path.isdir(D), reason="needs the small tables")
def test_pipeline_of_an_empty_table(spark, tmp_path):
    import corpus_pipeline

    for t in ("labels", "benchmark", "documents"):
        spark.read.parquet(f"{D}/{t}.parquet").where("false").write.parquet(str(tmp_path / f"{t}.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert got.count() == 0 and {"doc_id", "text", "shard", "slot"} <= set(got.columns)
