"""Incremental refresh: new files against the stored snapshot, human states and review patches laid over it."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expressions import blank_to_null
from ..schema import BACKUP, ELIGIBILITIES, REJECTED, STATUSES

HUMAN = ("sample_id", "manual_status", "duplicate_ignore", "duplicate_reviewed")


def diff(files: DataFrame, snapshot: DataFrame) -> DataFrame:
    """(path_key, change, sample_id) of files (path_key, file_size, mtime_ns, content_sha256).

    change: unchanged (same path, size and time), touched (same path and content), moved (the content of exactly one row
    of the snapshot that no path has claimed), modified, added. A row of the snapshot is claimed once; among several new
    files of one content the first by path may claim it."""
    old = snapshot.select("path_key", F.col("sample_id").alias("old_id"), F.col("file_size").alias("old_size"), F.col("mtime_ns").alias("old_time"), F.col("content_sha256").alias("old_sha"))
    here = files.join(old, "path_key", "left")
    same = (F.col("file_size") == F.col("old_size")) & (F.col("mtime_ns") == F.col("old_time"))
    here = here.withColumn("change", F.when(F.col("old_id").isNull(), "new").when(same, "unchanged").when(F.col("content_sha256") == F.col("old_sha"), "touched").otherwise("other"))
    claimed = here.where("change in ('unchanged', 'touched')").select(F.col("old_id").alias("sample_id"))
    spare = snapshot.select("sample_id", "content_sha256").join(claimed, "sample_id", "left_anti")
    single = spare.groupBy("content_sha256").agg(F.count(F.lit(1)).alias("n"), F.min("sample_id").alias("moved_id")).where("n = 1").select("content_sha256", "moved_id")
    pending = here.where("change in ('new', 'other')")
    first = pending.groupBy("content_sha256").agg(F.min("path_key").alias("path_key"))
    moved = first.join(single, "content_sha256").select("path_key", "moved_id")
    out = here.join(moved, "path_key", "left")
    change = F.when(F.col("change").isin("unchanged", "touched"), F.col("change")).when(F.col("moved_id").isNotNull(), "moved").when(F.col("change") == "new", "added").otherwise("modified")
    ident = F.when(F.col("change").isin("unchanged", "touched"), F.col("old_id")).otherwise(F.col("moved_id"))
    return out.select("path_key", change.alias("kind"), ident.alias("sample_id")).withColumnRenamed("kind", "change")


def counters(changes: DataFrame, files: DataFrame, snapshot: DataFrame) -> DataFrame:
    """A4: a moved file counts as added and unchanged, and its old path as deleted."""
    keys = snapshot.select("path_key")
    deleted = keys.join(files.select("path_key"), "path_key", "left_anti").agg(F.count(F.lit(1)).alias("deleted"))
    fresh = files.select("path_key").join(keys, "path_key", "left_anti").agg(F.count(F.lit(1)).alias("added"))
    kinds = changes.agg(F.count_if(F.col("change").isin("unchanged", "touched", "moved")).alias("unchanged"), F.count_if(F.col("change") == "modified").alias("modified"), F.count_if(F.col("change").isin("added", "modified")).alias("changed"))
    return fresh.crossJoin(kinds).crossJoin(deleted)  # three single rows


def latest(snapshot: DataFrame) -> DataFrame:
    """The last row of each path."""
    every = F.struct("ord", F.struct(*snapshot.columns).alias("row"))
    return snapshot.groupBy("path_key").agg(F.max_by(every["row"], F.col("ord")).alias("row")).select("row.*")


def overlay_history(rows: DataFrame, history: DataFrame, legacy: DataFrame | None = None) -> DataFrame:
    """Human states of the same path, AI suggestions with them where both sides have the column, come back where the
    content is the same. Elsewhere a row without a manual status gets that of legacy (path_key, manual_status)."""
    human = [c for c in (*HUMAN, "ai_suggestion") if c in rows.columns and c in history.columns]
    old = history.select("path_key", F.col("content_sha256").alias("_sha"), *[F.col(c).alias(f"_{c}") for c in human])
    joined = rows.join(old, "path_key", "left")
    same = F.coalesce((F.col("_sha") != "") & (F.col("content_sha256") == F.col("_sha")), F.lit(False))
    back = {c: F.col(f"_{c}") for c in human} | {"sample_id": F.coalesce(blank_to_null(F.col("_sample_id")), F.col("sample_id"))}
    back |= {c: F.coalesce(f"_{c}", F.lit(False)) for c in ("duplicate_ignore", "duplicate_reviewed") if c in human}
    other = {c: F.col(c) for c in human}
    if legacy is not None:
        joined = joined.join(legacy.select("path_key", F.col("manual_status").alias("_legacy")), "path_key", "left")
        other["manual_status"] = F.coalesce(blank_to_null(F.col("manual_status")), F.col("_legacy"))
    return joined.withColumns({c: F.when(same, back[c]).otherwise(other[c]) for c in human}).select(*rows.columns)


def overlay_pending(rows: DataFrame, pending: DataFrame, version: int) -> DataFrame:
    """Rows made by a composite get the state it gave them and count as scanned."""
    own = pending.groupBy("path_key").agg(F.max("status").alias("_status"))
    joined = rows.join(own, "path_key", "left")
    hit = F.col("_status").isNotNull()
    return joined.withColumns({"manual_status": F.coalesce("_status", "manual_status"), "composite_scan_version": F.when(hit, F.lit(version)).otherwise(F.col("composite_scan_version"))}).drop("_status")


def append_new(rows: DataFrame, more: DataFrame) -> DataFrame:
    """J14."""
    return rows.unionByName(more.join(rows.select("path_key"), "path_key", "left_anti").select(*rows.columns))


def unique_hash(rows: DataFrame) -> DataFrame:
    """Contents that exactly one row has."""
    return rows.groupBy("content_sha256").agg(F.count(F.lit(1)).alias("n"), F.min("sample_id").alias("sample_id")).where("n = 1").drop("n")


def classify_patch(patch: DataFrame, rows: DataFrame) -> DataFrame:
    """Patch rows with `outcome`: unknown, stale, invalid or pending. Rows without a hash are never stale; only rows
    that are neither unknown nor stale are looked at further."""
    own = rows.select("sample_id", F.col("content_sha256").alias("_sha"))
    joined = patch.join(own, "sample_id", "left")
    stale = blank_to_null(F.col("content_sha256")).isNotNull() & (F.col("content_sha256") != F.col("_sha"))
    bad = (F.col("suggested_eligibility").isNotNull() & ~F.col("suggested_eligibility").isin(*ELIGIBILITIES)) | (F.col("suggested_status").isNotNull() & ~F.col("suggested_status").isin(*STATUSES))
    for name in ("flags", "note", "request_full_resolution"):  # null where a patch had another type
        bad = bad | F.col(name).isNull() if name in patch.columns else bad
    return joined.withColumn("outcome", F.when(F.col("_sha").isNull(), "unknown").when(stale, "stale").when(bad, "invalid").otherwise("pending")).drop("_sha")


def check_patch(patch: DataFrame, head: dict, rows: DataFrame | None = None) -> None:
    """J7's checks: version, bundle, ids that are there and unique; with rows, values of suggestions that are neither
    unknown nor stale. The first fault aborts the patch."""
    if head.get("schema_version") != 1:
        raise ValueError(f"unknown schema_version: {head.get('schema_version')}")
    if not str(head.get("bundle_id", "")).strip():
        raise ValueError("no bundle_id")
    if not patch.where("coalesce(sample_id, '') = ''").isEmpty():
        raise ValueError("a suggestion has no sample_id")
    if not patch.groupBy("sample_id").count().where("count > 1").isEmpty():
        raise ValueError("a sample_id is there twice")
    if rows is not None and (bad := classify_patch(patch, rows).where("outcome = 'invalid'").orderBy("sample_id").first()):
        raise ValueError(f"{bad['sample_id']}: a value that isn't known")


def read_patch(spark: SparkSession, text: str) -> tuple[dict, DataFrame]:
    """The head and the suggestions of a patch in JSON; types are checked here, before they are columns."""
    data = json.loads(text)
    if not isinstance(data, dict):
        raise ValueError("a patch must be an object")
    found = data.get("suggestions")
    if not isinstance(found, list) or not all(isinstance(x, dict) and isinstance(x.get("sample_id"), str) for x in found):
        raise ValueError("suggestions must be a list of objects with a sample_id")
    rows = []
    for x in found:
        flags, note, full = x.get("flags", []), x.get("note", ""), x.get("request_full_resolution", False)
        typed = isinstance(flags, list) and all(isinstance(f, str) for f in flags) and isinstance(note, str) and isinstance(full, bool)
        rows.append((x["sample_id"], x.get("content_sha256"), x.get("suggested_eligibility"), x.get("suggested_status"), flags if typed else None, note if typed else None, full if typed else None))
    schema = "sample_id string, content_sha256 string, suggested_eligibility string, suggested_status string, flags array<string>, note string, request_full_resolution boolean"
    return {k: v for k, v in data.items() if k != "suggestions"}, spark.createDataFrame(rows, schema)


def decide_suggestion(rows: DataFrame, decisions: DataFrame) -> DataFrame:
    """M7: decisions (sample_id, action) on pending suggestions. accept: a suggested status becomes the manual one, else
    REJECT rejects and REVIEW keeps back, PASS alone changes nothing; reject only marks; clear drops the suggestion."""
    said = F.col("ai_suggestion")
    status = F.coalesce(blank_to_null(said["suggested_status"]), F.when(said["suggested_eligibility"] == "REJECT", REJECTED).when(said["suggested_eligibility"] == "REVIEW", BACKUP))
    joined = rows.join(decisions.select("sample_id", F.col("action").alias("_do")), "sample_id", "left")
    accept = (F.col("_do") == "accept") & said.isNotNull()
    mark = F.when(accept, said.withField("decision", F.lit("accepted"))).when((F.col("_do") == "reject") & said.isNotNull(), said.withField("decision", F.lit("rejected")))
    suggestion = F.when(F.coalesce(F.col("_do") == "clear", F.lit(False)), F.lit(None)).otherwise(F.coalesce(mark, said))
    manual = F.when(accept, F.coalesce(status, F.col("manual_status"))).otherwise(F.col("manual_status"))
    return joined.withColumns({"manual_status": manual, "ai_suggestion": suggestion}).select(*rows.columns)
