"""Shared folder, lineage cuts and row keys used by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import gc
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factorspark.llm.textvec import slices


def shared_dir(spark: SparkSession) -> str:
    """The folder that every executor can reach; a local one only for a local master without a setting."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="factorspark-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def new_dir(spark: SparkSession, what: str) -> str:
    """A fresh path below the shared folder; Hadoop's file system deletes it when the session's JVM ends."""
    root = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/factorspark/{what}-{uuid.uuid4().hex}")
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(root)
    fs.deleteOnExit(root)
    return f"{root.toString()}/rows"


def arrow_uri(path: str) -> str:
    """A path as the URI that pyarrow's file systems know: local paths get a scheme, s3a and s3n become s3."""
    scheme, mark, rest = path.partition("://")
    if mark:
        return f"s3://{rest}" if scheme in ("s3a", "s3n") else path
    return f"file://{path[5:] if path.startswith('file:') else path}"


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder: later plans start from stored rows."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


def stored(df: DataFrame, what: str) -> DataFrame:
    """The rows written once as Parquet in the shared folder and read from there."""
    path = new_dir(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def trim() -> None:
    """Gives freed memory back to the system after a fit on the driver, where the C library can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        give_back = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if give_back is not None:
            give_back(0)


def row_key(*cols: str) -> Column:
    """A 64-bit key of a row's columns, never null; joins add a null-safe test of the id itself."""
    return F.xxhash64(*cols)


def whole_key(df: DataFrame) -> Column:
    """A 64-bit key of all columns of a row; maps, which have no hash, count by their JSON text."""
    cols = [F.col(f"`{c.replace('`', '``')}`") for c in df.columns]
    return F.xxhash64(*[F.to_json(F.struct(c)) if "map<" in f.dataType.simpleString() else c for c, f in zip(cols, df.schema, strict=True)])


HOT = 1000


def hot_join(rows: DataFrame, facts: DataFrame, key: str, weight: str) -> DataFrame:
    """Rows with the facts of their key; ``facts`` has one row a key, whose ``weight`` is its number of rows.

    Keys with more than one in ``HOT`` of all rows, hence fewer than ``HOT`` keys whatever the input, are
    broadcast and their rows stay in their partitions; all other keys meet by an exchange.
    """
    total = facts.agg(F.sum(weight)).first()[0] or 0
    is_hot = F.col(weight) * HOT > total
    hot, cold = facts.where(is_hot).drop(weight), facts.where(~is_hot).drop(weight)
    if hot.isEmpty():
        return rows.join(cold, key)
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key)
    return rows.join(F.broadcast(hot), key).unionByName(rest)


def filtered(docs: DataFrame, text_col: str, verdict: Callable[[], Callable[[pa.Array], np.ndarray]]) -> DataFrame:
    """The rows whose text passes, all columns kept; ``verdict`` makes a task's test of a column of texts.

    Columns go to Python under plain names, since not every name can be passed there.
    """
    at = docs.columns.index(text_col)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passes = verdict()
        for batch in batches:
            for part in slices(batch, at):
                yield part.filter(pa.array(passes(part.column(at))))

    plain = docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])
    return plain.mapInArrow(scan, plain.schema).toDF(*docs.columns)
