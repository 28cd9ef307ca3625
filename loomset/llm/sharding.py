"""Sharding by jump consistent hashing, in SQL functions alone.

A key jumps through the shards b(0) = 0 < b(1) < ...: after jump b it goes on to floor((b + 1) / u(b)), u(b) uniform
in (0, 1] and drawn from the key and b, and stays in the last shard below the number of shards. The draws don't depend
on that number, so that one shard more takes rows only into itself, 1 / (n + 1) of all; there is no table of the ring.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHARDS = 24
#: Slices of a shard in which slots are numbered; a slice is the largest group that one task numbers.
SLICES = 256


def jump(key: Column, shards: int) -> Column:
    """The shard, from 0, of a string key among so many shards."""
    draw = lambda b: (F.conv(F.substring(F.md5(F.concat(key, F.lit(":"), b.cast("string"))), 1, 8), 16, 10).cast("double") + F.lit(1.0)) / F.lit(4294967296.0)
    step = lambda s, _: F.when(
        s["j"] < shards,
        F.struct(s["j"].alias("b"), F.floor((s["j"].cast("double") + F.lit(1.0)) / draw(s["j"])).cast("long").alias("j")),
    ).otherwise(s)
    start = F.struct(F.lit(0).cast("long").alias("b"), F.lit(0).cast("long").alias("j"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(shards)), start, step, lambda s: s["b"]).cast("int")


def shard(docs: DataFrame, shards: int = SHARDS, slices: int = SLICES) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for each row.

    A null id is the key "null"; a null text has size 8 and the crc32 of no bytes, 0. Repeated rows share a shard and
    get slots of their own. A very long text is only measured. An empty table gives an empty result. Other columns are
    not read. Slots are numbered in two steps, rows inside slices of a shard and slices by their counts, so that no shard
    is sorted as a whole; a slice is by id and length, so that rows without an id are not one slice."""
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    data = F.encode("text", "utf-8")
    slot_slice = F.pmod(F.xxhash64("doc_id", F.octet_length("text")), F.lit(slices)).cast("int").alias("slice")
    rows = docs.select(
        "doc_id",
        F.coalesce(F.octet_length("text") + 8, F.lit(8)).cast("long").alias("size"),
        F.coalesce(F.crc32(data), F.lit(0)).cast("long").alias("text_crc32"),
        jump(key, shards).alias("shard"),
        jump(key, shards + 1).alias("grown_shard"),
        slot_slice,
    )
    ids = docs.select(jump(key, shards).alias("shard"), slot_slice)
    counts = ids.groupBy("shard", "slice").count()  # shards x slices rows at most
    before = Window.partitionBy("shard").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    first = F.broadcast(counts.select("shard", "slice", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("first")))
    inside = Window.partitionBy("shard", "slice").orderBy(F.col("doc_id").asc_nulls_last(), "size", "text_crc32")
    placed = rows.withColumn("place", F.row_number().over(inside)).join(first, ["shard", "slice"])
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("first") + F.col("place") - 1).cast("long").alias("slot"), "grown_shard")
