"""Scans of image folders, stored snapshots, and the samples that stand in for analysed images."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expressions import base_status, eligibility, hard_rejects, path_key, pitch_class, review_flags, suffix, yaw_class
from ..operators.moves import under_excluded
from ..schema import ANALYSIS_VERSION, CACHE_VERSION, IMAGE_SUFFIXES, READABLE_VERSIONS
from ..streaming.snapshots import Snapshots


def exclusion_set(features: Iterable[Iterable[str]]) -> list[str]:
    """S3: names of all features, the first spelling of each."""
    out: dict[str, str] = {}
    for names in features:
        for n in names:
            out.setdefault(n.casefold(), n)
    return list(out.values())


def scan(spark: SparkSession, root: str, excluded: Iterable[str] = ()) -> DataFrame:
    """S1, S4 (nothing excluded), O9: images below a folder in the order of paths, which case doesn't change; ordered by ranges
    of paths, not in one task. File contents are not read. Spark's readers list no files of no bytes, and nothing whose name, or whose
    folder's, begins with _ or a dot."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length", "modificationTime")
    files = files.withColumn("path", F.regexp_replace("path", "^file:(//)?", ""))
    base = root.removeprefix("file://").rstrip("/")
    relative = F.substring(F.col("path"), len(base) + 2, 1 << 30)
    own = files.where(suffix(F.col("path")).isin(*IMAGE_SUFFIXES) & ~under_excluded(relative, excluded))
    return own.select("path", path_key(F.col("path")).alias("path_key"), F.col("length").alias("file_size"), (F.unix_micros("modificationTime") * 1000).alias("mtime_ns")).orderBy("path_key", "path")


def hashed(spark: SparkSession, root: str, files: DataFrame) -> DataFrame:
    """contents' hashes of these files alone."""
    data = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select(F.regexp_replace("path", "^file:(//)?", "").alias("path"), "content")
    return files.join(data, "path").withColumn("content_sha256", F.sha2("content", 256)).drop("content")


def load_snapshot(table: Snapshots, current_only: bool = True) -> DataFrame:
    """The rows of the current version that are of a readable format. What isn't there or can't be read is empty."""
    rows = table.read()
    try:
        rows.count()  # reads the ends of the files alone
    except Exception:  # noqa: BLE001  whatever is wrong with them
        return table.spark.createDataFrame([], table.schema)
    rows = rows.where(F.col("version").isin(*READABLE_VERSIONS))
    return rows.where((F.col("version") == CACHE_VERSION) & (F.col("analysis_version") == ANALYSIS_VERSION)) if current_only else rows


def legacy_manual(snapshot: DataFrame) -> DataFrame:
    """S10."""
    return snapshot.where("version in (1, 2) and coalesce(manual_status, '') <> ''").select("path_key", "manual_status")


SAMPLES = """
d.doc_id AS ord, {sha}(d.text{bits}) AS content_sha256, d.source AS source, d.lang AS lang,
CAST(256 + d.n_chars % 1500 AS INT) AS width, CAST(256 + (d.n_chars*7) % 1500 AS INT) AS height,
CASE WHEN d.doc_id % 11 = 0 THEN 0 WHEN d.doc_id % 7 = 0 THEN 2 ELSE 1 END AS faces,
CAST(40 + d.n_chars % 400 AS INT) AS face_px,
CAST((40 + d.n_chars % 400)*(40 + d.n_chars % 400) AS DOUBLE) / CAST((256 + d.n_chars % 1500)*(256 + (d.n_chars*7) % 1500) AS DOUBLE) AS face_ratio,
CAST((d.doc_id*7919) % 1000 AS DOUBLE) / CAST(1000 AS DOUBLE) AS face_quality,
CAST((d.doc_id*31 + d.n_chars) % 100 AS DOUBLE) AS brisque, CAST((d.doc_id*17 + d.n_chars) % 400 AS DOUBLE) AS blur,
CAST((d.doc_id*13) % 256 AS DOUBLE) AS brightness,
CAST((d.doc_id*37) % 181 - 90 AS DOUBLE) AS yaw, CAST((d.doc_id*53) % 91 - 45 AS DOUBLE) AS pitch,
CASE WHEN d.n_chars < 800 THEN '近景/头肩' WHEN d.n_chars < 1500 THEN '半身' WHEN d.n_chars < 2700 THEN '大半身' ELSE '全身' END AS person_scale,
CASE WHEN l.toxic = 1 THEN '淘汰' WHEN l.quality = 1 AND d.doc_id % 5 = 0 THEN '推荐' END AS manual_status
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"""


def raw_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stand-in metrics from the documents and labels of a test folder."""
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels")}
    body = SAMPLES.format(sha="sha2", bits=", 256").replace("FROM documents d LEFT JOIN labels l", "FROM {documents} d LEFT JOIN {labels} l")
    return spark.sql("SELECT " + body, **tables)


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """raw_samples with ids, paths, classes, findings, eligibility and base status."""
    rows = raw_samples(spark, sf_dir).withColumns({
        "sample_id": F.concat(F.lit("img_"), F.lpad(F.col("ord").cast("string"), 8, "0")),
        "relative_path": F.concat_ws("/", "source", F.concat(F.col("lang"), F.lit("_frame_"), F.col("ord"), F.lit(".jpg"))),
        "angle_class": yaw_class(F.col("yaw")),
        "pitch_class": pitch_class(F.col("pitch")),
        "roll": F.lit(0.0),
    })
    rows = rows.withColumns({"review_flags": review_flags(), "hard_rejects": hard_rejects()})
    rows = rows.withColumn("eligibility", eligibility(F.col("hard_rejects"), F.col("review_flags")))
    return rows.withColumn("auto_status", base_status(F.col("eligibility")))
