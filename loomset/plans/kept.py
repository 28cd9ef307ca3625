"""Registered queries of what is kept between runs: snapshots, the recommendation from edits, written and moved files."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import live, outputs
from ..storage import shared_folder
from ..streaming import snapshots
from .catalogue import _POOL, _TOP, _rows, _s, query


def _folder(spark, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query("SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS event_type, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY user_id")
def merged_snapshot(spark, sf_dir):
    """The last event of each user, from batches that come out of order and again."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "event_id", "event_type", "value", F.struct("ts", "event_id").alias("at"))
    table = snapshots.Snapshots(spark, _folder(spark, "snapshot"), "user_id long, event_id long, event_type string, value double, at struct<ts:timestamp,event_id:long>", "user_id", 8)
    for epoch, part in enumerate((3, 1, 0, 2)):
        batch = rows.where(F.pmod("event_id", F.lit(4)) == part)
        for _ in range(2):  # delivered again
            table.merge(batch, snapshots.newest_by_key("user_id", "at"), "events", epoch)
    return table.read().drop("at")


@query(_s("SELECT s.ord, CASE WHEN chosen.ord IS NOT NULL THEN '推荐' ELSE base END AS auto_status, COALESCE(manual_status, CASE WHEN chosen.ord IS NOT NULL THEN '推荐' ELSE base END) AS status FROM s LEFT JOIN chosen USING (ord)", _POOL, _TOP))
def live_recommendation(spark, sf_dir):
    """The recommendation after edits: wrong and missing samples first, then what they are, then edits that come too late."""
    i, no = F.col("ord"), F.lit(None)
    of = ["person_scale", "angle_class", "duplicate_group", "eligibility", "face_quality", "brisque", "blur", "qualified", "gone"]
    rows = _rows(spark, sf_dir).withColumns({"gone": F.lit(False), "duplicate_group": F.col("duplicate_group").cast("long")})
    right = rows.select("ord", F.lit("analysis").alias("kind"), (1000 + i).alias("seq"), no.cast("string").alias("manual_status"), *of)
    wrong = right.withColumns({"seq": i, "face_quality": F.when(i % 4 == 0, 1 - F.col("face_quality")).otherwise(F.col("face_quality")), "qualified": F.col("qualified") | (i % 7 == 0), "gone": i % 11 == 0, "person_scale": F.when(i % 6 == 0, "半身").otherwise(F.col("person_scale"))})
    said = lambda seq, status: rows.select("ord", F.lit("human").alias("kind"), seq.cast("long").alias("seq"), status.alias("manual_status"), *[no.cast(rows.schema[c].dataType).alias(c) for c in of])
    own = live.LiveRecommendation(spark, _folder(spark, "live"), 60, 8)
    own.apply(wrong.where(i % 9 != 0), 0)
    own.apply(right.where(i % 2 == 0).unionByName(said(2000 + i, F.col("manual_status"))), 1)
    own.apply(right.where(i % 2 == 1).unionByName(wrong.where(i % 5 == 0)).unionByName(said(i, F.lit("淘汰"))), 2)
    return own.statuses()


@query("SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 'even/' ELSE '' END || conv_id || '/' || (turn // 2 * 2 + 1 - turn % 2) || '.txt' AS place, sha256(text) AS digest, octet_length(encode(text)) AS size FROM conversations WHERE text IS NOT NULL")
def written_files(spark, sf_dir):
    """Texts written as files and then moved, those of neighbouring turns to each other's names; read back from where they are."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    folder = _folder(spark, "files")
    name = lambda turn: F.concat(F.col("conv_id").cast("string"), F.lit("/"), turn.cast("string"), F.lit(".txt"))
    outputs.write_all(rows.select(name(F.col("turn")).alias("relative"), F.encode("text", "utf-8").alias("data")), folder)
    other = (F.floor(F.col("turn") / 2) * 2 + 1 - F.col("turn") % 2).cast("long")
    place = F.concat(F.when(F.col("turn") % 2 == 0, "even/").otherwise(""), name(other))
    moved = rows.where("text is not null").select("conv_id", "turn", F.concat(F.lit(f"{folder}/"), name(F.col("turn"))).alias("source"), place.alias("relative"))
    outputs.move_all(moved, folder)
    read = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    found = read.select(F.element_at(F.split("path", folder.rpartition("/")[2] + "/"), 2).alias("place"), F.sha2("content", 256).alias("digest"), F.col("length").alias("size"))
    return moved.select("conv_id", "turn", F.col("relative").alias("place")).join(found, "place").select("conv_id", "turn", "place", "digest", "size")
