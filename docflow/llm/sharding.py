"""Sharding by fixed virtual slots: records are hashed into thousands of slots, bytes are aggregated by slot, and a stored,
versioned map from slot to shard is edited when shards are rebalanced. DataFrame functions only.

Defined results: a null text has no bytes and crc32 0; a null doc_id is hashed like any other value; equal rows all keep a row of
their own and adjacent places; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docflow.session import checkpoint_dir

SLOTS = 16384
#: A rebalancing leaves the slots of a shard in place up to this share of the mean and deals the rest anew.
KEEP = 0.9
MAP_SCHEMA = "version int, virtual_slot int, shard int, bytes long"


def records(docs: DataFrame, n_slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32, virtual_slot."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32")).withColumn(
        "virtual_slot", F.pmod(F.xxhash64("doc_id", "text_crc32", "size"), F.lit(n_slots)).cast("int")
    )


def slot_loads(recs: DataFrame) -> DataFrame:
    """virtual_slot, bytes, n_rows; summed on the map side first, so at most one row for each slot and task is shuffled."""
    return recs.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count("*").alias("n_rows"))


def first_map(spark: SparkSession, n_shards: int, n_slots: int = SLOTS) -> DataFrame:
    """Version 1: slots dealt in turn."""
    return spark.range(n_slots).select(F.lit(1).alias("version"), F.col("id").cast("int").alias("virtual_slot"), (F.col("id") % n_shards).cast("int").alias("shard"), F.lit(0).cast("long").alias("bytes"))


def rebalance(current: DataFrame, loads: DataFrame, n_shards: int, keep: float = KEEP) -> DataFrame:
    """The next version of the map, edited from the current one for n_shards shards by the bytes of each slot.

    Each shard keeps its slots, the largest first, up to keep times the mean load; the others, and those of shards that are no more, are
    dealt from the largest to the smallest, each to the shard with the least load. All of this works on one row for each slot,
    a fixed number; the deal is one fold over them.
    """
    by_slot = current.select("version", "virtual_slot", "shard").join(F.broadcast(loads.select("virtual_slot", "bytes")), "virtual_slot", "left").fillna(0, ["bytes"])
    mean = F.sum("bytes").over(Window.partitionBy("version")) / n_shards
    running = F.sum("bytes").over(Window.partitionBy("shard").orderBy(F.desc("bytes"), "virtual_slot"))
    marked = by_slot.withColumn("mean", mean).withColumn("stays", (F.col("shard") < n_shards) & ((running <= F.col("mean") * keep) | (F.col("bytes") == 0)))
    kept = marked.where("stays").groupBy("shard").agg(F.sum("bytes").alias("load"))
    every = marked.sparkSession.range(n_shards).select(F.col("id").cast("int").alias("shard"))
    start = every.join(F.broadcast(kept), "shard", "left").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("load", F.lit(0).cast("long")).alias("load"), "shard"))).alias("start"))
    pool = marked.where("not stays").agg(F.sort_array(F.collect_list(F.struct("bytes", "virtual_slot")), False).alias("pool"))
    empty = F.array().cast("array<struct<virtual_slot:int,shard:int>>")

    def give(acc, item):
        least = F.array_min(acc["loads"])
        return F.transform(
            F.array(least),
            lambda to: F.struct(
                F.transform(acc["loads"], lambda x: F.struct((x["load"] + F.when(x["shard"] == to["shard"], item["bytes"]).otherwise(F.lit(0).cast("long"))).alias("load"), x["shard"].alias("shard"))).alias("loads"),
                F.concat(acc["out"], F.array(F.struct(item["virtual_slot"].alias("virtual_slot"), to["shard"].alias("shard")))).alias("out"),
            ),
        )[0]

    dealt = start.crossJoin(pool).select(F.aggregate("pool", F.struct(F.col("start").alias("loads"), empty.alias("out")), give)["out"].alias("out"))  # one row each
    moved = dealt.select(F.inline("out")).withColumnRenamed("shard", "new_shard")
    return marked.join(F.broadcast(moved), "virtual_slot", "left").select((F.col("version") + 1).alias("version"), "virtual_slot", F.coalesce("new_shard", "shard").alias("shard"), "bytes")


def store_map(slot_map: DataFrame, path: str) -> None:
    """Append one version to the stored map."""
    slot_map.coalesce(1).write.mode("append").partitionBy("version").parquet(path)


def load_map(spark: SparkSession, path: str, version: int) -> DataFrame:
    return spark.read.schema(MAP_SCHEMA).parquet(path).where(F.col("version") == version)


def place(recs: DataFrame, loads: DataFrame, slot_map: DataFrame) -> DataFrame:
    """recs with shard and place, which counts from 0 without gaps in each shard.

    Places are counted inside each virtual slot and shifted by the rows of the shard's slots before it: nothing gathers a shard.
    """
    order = Window.partitionBy("shard").orderBy("virtual_slot")
    shifts = slot_map.select("virtual_slot", "shard").join(F.broadcast(loads.select("virtual_slot", "n_rows")), "virtual_slot").withColumn("shift", F.sum("n_rows").over(order) - F.col("n_rows")).drop("n_rows")
    inside = F.row_number().over(Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size")) - 1
    return recs.withColumn("inside", inside).join(F.broadcast(shifts), "virtual_slot").withColumn("place", F.col("inside") + F.col("shift")).drop("inside", "shift")


def shard_documents(docs: DataFrame, n_shards: int = 24, n_slots: int = SLOTS) -> DataFrame:
    """All documents into n_shards shards of near equal bytes: doc_id, size, text_crc32, law, shard, slot (the place in the
    shard), grown_shard (null: another shard moves slots by their bytes), virtual_slot, map_version."""
    spark = docs.sparkSession
    path = f"{checkpoint_dir(spark)}/docflow/slot-map-{uuid.uuid4().hex}"
    recs = records(docs, n_slots)
    loads_path = path + "-loads"
    slot_loads(recs).repartition(1).write.parquet(loads_path)  # at most n_slots rows, added up before they come to one task
    loads = spark.read.schema("virtual_slot int, bytes long, n_rows long").parquet(loads_path)
    store_map(first_map(spark, n_shards, n_slots), path)
    store_map(rebalance(load_map(spark, path, 1), loads, n_shards), path)
    placed = place(recs, loads, load_map(spark, path, 2))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("place").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", F.lit(2).alias("map_version"))
