"""Sharding through fixed virtual slots, in DataFrame functions only.

Rows are hashed into ``SLOTS`` virtual slots that never change. Bytes are summed per slot, and a
versioned map holds each slot's shard. Version 1 deals the slots out by falling bytes, each to the shard
with the fewest so far; a rebalance edits that map: shards that are over their share of bytes give up
slots to new or light shards, all other slots stay where they are. Each virtual slot has ``FINE`` parts
for numbering rows, so a row's place in its shard is a prefix sum over at most SLOTS x FINE counts plus
a count inside one part; no shard's rows ever meet in one task.

Equal texts are no unit: copies under other ids have slots of their own, so that a large group of them is
spread over all shards. Rows equal in id and text are one record and share its slot.

Defined cases: a null text has 8 bytes and checksum 0; a null id hashes by its text's checksum and size;
copies and repeated rows get places of their own; an empty table gives none; extra columns are ignored
unless asked for, and a kept one that has the name of a result is called ``<name>_in``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factorspark.llm.runtime import cut

SLOTS = 4096
FINE = 64
SHARDS = 24
MAP = "virtual_slot long, shard int, version int"


RESULT = ("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard", "virtual_slot", "map_version")


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, size, text_crc32, part, virtual_slot and, if any column is kept, kept) per row; kept is a struct."""
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    kept = [F.struct(*[_column(c) for c in keep]).alias("kept")] if keep else []
    rows = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text).cast("long") + 8).alias("size"), F.crc32(text).alias("text_crc32"), *kept)
    rows = rows.withColumn("part", F.pmod(F.xxhash64("doc_id", "text_crc32", "size"), F.lit(slots * FINE)))
    return rows.withColumn("virtual_slot", F.floor(F.col("part") / FINE))


def _column(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def _out(keep: tuple[str, ...]) -> list[Column]:
    """Kept columns out of their struct, renamed where a result or another kept column has the name."""
    taken, out = {*RESULT, *keep}, []
    for c in keep:
        name = c
        while name in RESULT or (name != c and name in taken):
            name += "_in"
        taken.add(name)
        out.append(F.col("kept")[c].alias(name))
    return out


def slot_bytes(rows: DataFrame, slots: int = SLOTS) -> DataFrame:
    """(virtual_slot, bytes, rows): what each virtual slot weighs; a slot without rows weighs nothing."""
    got = rows.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    return _every_slot(rows, slots).join(got, "virtual_slot", "left").na.fill(0, ["bytes", "rows"])


def _every_slot(df: DataFrame, slots: int) -> DataFrame:
    return df.sparkSession.range(slots).select(F.col("id").alias("virtual_slot"))


def _lightest(items: Column, shards: int, start: Column | None = None) -> Column:
    """Fold over (bytes, virtual_slot) structs: each goes to the shard with the fewest bytes so far, empty ones go round."""
    loads = start if start is not None else F.array_repeat(F.lit(0).cast("bigint"), shards)
    empty = F.array().cast("array<struct<virtual_slot:bigint,shard:int>>")
    def step(acc, x):
        k = F.array_position(acc["loads"], F.array_min(acc["loads"])).cast("int") - 1
        grown = F.transform(acc["loads"], lambda v, i: F.when(i == k, v + x["bytes"]).otherwise(v))
        return F.struct(grown.alias("loads"), F.concat(acc["dealt"], F.array(F.struct(x["virtual_slot"].alias("virtual_slot"), k.alias("shard")))).alias("dealt"))
    dealt = F.aggregate(F.filter(items, lambda x: x["bytes"] > 0), F.struct(loads.alias("loads"), empty.alias("dealt")), step, lambda acc: acc["dealt"])
    rest = F.filter(items, lambda x: x["bytes"] == 0)
    return F.concat(dealt, F.transform(rest, lambda x, i: F.struct(x["virtual_slot"].alias("virtual_slot"), (i % shards).cast("int").alias("shard"))))


def first_map(weights: DataFrame, shards: int = SHARDS, slots: int = SLOTS) -> DataFrame:
    """Version 1 of the map: (virtual_slot, shard, version) of every slot. SLOTS rows are folded."""
    weights = _every_slot(weights, slots).join(weights.select("virtual_slot", "bytes"), "virtual_slot", "left").na.fill(0, ["bytes"])
    items = F.sort_array(F.collect_list(F.struct("bytes", "virtual_slot")), asc=False)
    dealt = weights.agg(items.alias("items")).select(F.explode(_lightest(F.col("items"), shards)).alias("d"))
    return dealt.select("d.virtual_slot", "d.shard", F.lit(1).alias("version"))


def rebalance(slot_map: DataFrame, weights: DataFrame, shards: int) -> DataFrame:
    """The next version for ``shards`` shards: slots beyond a shard's share move, the others stay.

    A shard keeps its heaviest slots while they fit into its share of all bytes (slots of shards that no
    longer exist all move, as do slots that only ``weights`` has); the rest, at most SLOTS rows, are dealt to
    the lightest shards. Empty slots stay where they are.
    """
    cur = slot_map.join(weights, "virtual_slot", "full").select("virtual_slot", "shard", "version", F.coalesce("bytes", F.lit(0)).cast("bigint").alias("bytes"))
    share = F.sum("bytes").over(Window.partitionBy(F.lit(1))) / F.lit(shards)
    running = F.sum("bytes").over(Window.partitionBy("shard").orderBy(F.desc("bytes"), "virtual_slot"))
    cur = cur.withColumn("stays", F.coalesce((F.col("shard") < shards) & ((running <= share) | (F.col("bytes") == 0)), F.lit(False)))
    got = cur.agg(F.collect_list(F.when(F.col("stays"), F.struct("virtual_slot", "shard", "bytes"))).alias("kept"), F.sort_array(F.collect_list(F.when(~F.col("stays"), F.struct("bytes", "virtual_slot"))), asc=False).alias("moving"), (F.coalesce(F.max("version"), F.lit(0)) + 1).alias("version"))
    loads = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: F.aggregate(F.filter("kept", lambda k: k["shard"] == s), F.lit(0).cast("bigint"), lambda a, k: a + k["bytes"]))
    stay = F.transform("kept", lambda k: F.struct(k["virtual_slot"].alias("virtual_slot"), k["shard"].alias("shard")))
    new = got.select(F.explode(F.concat(stay, _lightest(F.col("moving"), shards, loads))).alias("d"), "version")
    return new.select("d.virtual_slot", "d.shard", "version")


def store_map(slot_map: DataFrame, path: str) -> None:
    """Adds one version of the map to the table at ``path``; a version that is stored there is refused."""
    slot_map = cut(slot_map)
    new = {r["version"] for r in slot_map.select("version").distinct().collect()}
    if stored := new & stored_versions(slot_map.sparkSession, path):
        raise ValueError(f"version {min(stored)} of the map is stored already")
    slot_map.coalesce(1).write.partitionBy("version").mode("append").parquet(path)


def stored_versions(spark: SparkSession, path: str) -> set[int]:
    """Versions of the map at ``path``; none where nothing is stored."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return set()
    return {r["version"] for r in spark.read.schema(MAP).parquet(path).select("version").distinct().collect()}


def load_map(spark: SparkSession, path: str) -> DataFrame:
    """The newest version of the map stored at ``path``."""
    every = spark.read.schema(MAP).parquet(path)
    return every.join(every.agg(F.max("version").alias("version")), "version", "left_semi").select("virtual_slot", "shard", "version")


def complete(slot_map: DataFrame, shards: int = SHARDS, slots: int = SLOTS) -> DataFrame:
    """One version of a map with every slot: those that it lacks are dealt round its shards by their number."""
    known = slot_map.agg(F.coalesce(F.max("shard") + 1, F.lit(shards)).alias("__shards"), F.coalesce(F.max("version"), F.lit(1)).alias("__version"))
    every = _every_slot(slot_map, slots).crossJoin(F.broadcast(known))  # one row
    got = every.join(slot_map, "virtual_slot", "left")
    return got.select("virtual_slot", F.coalesce("shard", F.pmod("virtual_slot", "__shards").cast("int")).alias("shard"), F.col("__version").alias("version"))


def assign(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS, slots: int = SLOTS, keep: tuple[str, ...] = (), slot_map: DataFrame | None = None, map_path: str | None = None) -> DataFrame:
    """Shard and place of every row under the ``bytes`` law; kept columns are passed on.

    ``slot_map`` is one version of a map, also one of other rows. Without it the newest map stored at
    ``map_path`` holds; where none is stored, a first map is made, stored there if a path is given, and read.

    (doc_id, size, text_crc32, law, shard, slot, grown_shard, virtual_slot, map_version, kept columns)
    """
    spark = docs.sparkSession
    rows = sized(docs, id_col, text_col, slots, keep)
    if not keep:
        rows = cut(rows)
    parts = cut(rows.groupBy("part", "virtual_slot").agg(F.sum("size").alias("size"), F.count("*").alias("n")))
    if slot_map is None and map_path is not None:
        if not stored_versions(spark, map_path):
            store_map(first_map(parts.groupBy("virtual_slot").agg(F.sum("size").alias("bytes")), shards, slots), map_path)
        slot_map = load_map(spark, map_path)
    elif slot_map is None:
        slot_map = first_map(parts.groupBy("virtual_slot").agg(F.sum("size").alias("bytes")), shards, slots)
    slot_map = complete(slot_map, shards, slots)
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    places = parts.join(slot_map, "virtual_slot").select(F.col("part").alias("__part"), "shard", F.col("version").alias("map_version"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__before"))
    nth = F.row_number().over(Window.partitionBy("part").orderBy("doc_id", "text_crc32", "size"))
    out = rows.withColumn("__nth", nth).join(places, F.col("part") == F.col("__part"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("__before") + F.col("__nth") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "map_version", *_out(keep))
