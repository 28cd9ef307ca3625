"""Stored states: records, proposals and settings decoded and written, the parts of a review bundle."""

from __future__ import annotations

import json
import logging
import os
import threading
from collections.abc import Callable
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expressions import path_key
from ..schema import ANALYSIS_VERSION, CACHE_VERSION, COMPOSITE_VERSION, DEFAULT_TARGET, FINDING, PICKED, TARGET_PRESETS
from ..storage import Folder
from .moves import unique_names

DETECTION = "struct<bbox:array<int>,confidence:double,kind:string>"
PROPOSAL = f"struct<version:int,mode:string,output_boxes:array<array<int>>,baseline_boxes:array<array<int>>,manual_triggered:boolean,person_detections:array<{DETECTION}>,head_detections:array<{DETECTION}>,decision:string,detail:string>"
FACE = "struct<detection_id:string,bbox_xywh:array<double>,confidence:double,area_ratio:double,face_px:int,is_primary:boolean,detector:string>"
SUGGESTION = "struct<patch_id:string,bundle_id:string,suggested_eligibility:string,suggested_status:string,flags:array<string>,note:string,request_full_resolution:boolean,decision:string>"
# Fields of a stored record with their types and what they are where the record lacks them.
RECORD = {
    "path": ("string", ""), "file_size": ("bigint", 0), "mtime_ns": ("bigint", 0), "width": ("int", 0), "height": ("int", 0), "sample_id": ("string", ""), "content_sha256": ("string", ""), "faces": ("int", 0),
    "face_detections": (f"array<{FACE}>", []), "primary_face_id": ("string", None), "face_ratio": ("double", 0.0), "face_px": ("int", 0), "blur": ("double", 0.0), "brightness": ("double", 0.0), "face_quality": ("double", 0.0),
    "brisque": ("double", 0.0), "yaw": ("double", 0.0), "pitch": ("double", 0.0), "roll": ("double", 0.0), "angle_class": ("string", "未检测"), "pitch_class": ("string", "未检测"), "person_scale": ("string", "未检测身体"),
    "phash": ("decimal(20,0)", 0), "duplicate_group": ("int", 0), "duplicate_ignore": ("boolean", False), "duplicate_reviewed": ("boolean", False), "analysis_metrics": ("map<string,string>", {}), "review_flags": ("array<string>", []),
    "hard_rejects": ("array<string>", []), "eligibility": ("string", "REVIEW"), "recommendation_reasons": ("array<string>", []), "reasons": ("array<string>", []), "auto_status": ("string", "备选"), "manual_status": ("string", None),
    "ai_suggestion": (SUGGESTION, None), "composite_proposal": ("string", None), "composite_scan_version": ("int", 0), "feature_state": ("map<string,string>", {}),
}
SETTINGS = {"inference_device": ("auto", "gpu", "cpu"), "theme": ("system", "light", "dark")}


# -- records


def decode_finding(text: Column) -> Column:
    """A finding, or a plain string of the first format."""
    legacy = F.struct(text.alias("code"), F.lit("legacy").alias("source"), F.lit(None).cast("double").alias("value"), F.lit(None).cast("double").alias("threshold"), text.alias("detail"))
    return F.when(text.startswith("{"), F.from_json(text, FINDING)).otherwise(legacy)


def _whole(value: Column) -> Column:
    """A whole number from the text of a JSON value: numbers are cut, texts must be whole numbers; true is 1."""
    return F.when(value == "true", 1).when(value == "false", 0).otherwise(value.try_cast("double").cast("int"))


def _sound_texts(text: Column, path: str) -> Column:
    """Whether all texts in a part of a JSON value are whole numbers, as numbers have to be that are written as texts."""
    said = F.regexp_extract_all(F.coalesce(F.get_json_object(text, path), F.lit("")), F.lit('"([^"]*)"'), 1)
    return F.forall(said, lambda v: v.rlike(r"^\s*[+-]?\d+\s*$"))


def decode_proposal(text: Column) -> Column:
    """A stored composite proposal; null where it is no object or a box isn't whole numbers, which may be written as
    texts. Baselines that don't match the boxes in number are the boxes."""
    text = F.ltrim(F.regexp_replace(text, r"^\s+", ""))
    p = F.from_json(text, PROPOSAL.replace("array<int>", "array<string>").replace("version:int", "version:string").replace("confidence:double", "confidence:string"))
    whole = lambda boxes: F.transform(boxes, lambda b: F.transform(b, _whole))
    none = F.array().cast("array<array<int>>")
    boxes, base = F.coalesce(whole(p["output_boxes"]), none), F.coalesce(whole(p["baseline_boxes"]), none)
    there = lambda name: F.get_json_object(text, f"$.{name}").isNull() | p[name].isNotNull()
    numbers = lambda bs: F.forall(bs, lambda b: b.isNotNull() & F.forall(b, lambda v: v.isNotNull()))
    sound = numbers(boxes) & numbers(base) & there("output_boxes") & there("baseline_boxes") & _sound_texts(text, "$.output_boxes") & _sound_texts(text, "$.baseline_boxes")
    seen = lambda name, kind: F.coalesce(F.transform(p[name], lambda d: F.struct(F.coalesce(F.transform(d["bbox"], _whole), F.array().cast("array<int>")).alias("bbox"), F.coalesce(d["confidence"].try_cast("double"), F.lit(0.0)).alias("confidence"), F.coalesce(d["kind"], F.lit(kind)).alias("kind"))), F.array().cast(f"array<{DETECTION}>"))
    made = F.struct(
        F.coalesce(_whole(p["version"]), F.lit(COMPOSITE_VERSION)).alias("version"), F.coalesce(p["mode"], F.lit("")).alias("mode"), boxes.alias("output_boxes"), F.when(F.size(base) == F.size(boxes), base).otherwise(boxes).alias("baseline_boxes"), F.coalesce(p["manual_triggered"], F.lit(False)).alias("manual_triggered"),
        seen("person_detections", "person").alias("person_detections"), seen("head_detections", "head").alias("head_detections"), F.coalesce(p["decision"], F.lit("pending")).alias("decision"), F.coalesce(p["detail"], F.lit("")).alias("detail"),
    )
    return F.when(text.startswith("{") & p.isNotNull() & sound, made)


def decode_records(texts: DataFrame, column: str = "record", version: int = COMPOSITE_VERSION) -> DataFrame:
    """One row for each JSON record, with defaults for what it lacks and findings of either format. A proposal of
    another version is dropped, and the row counts as not scanned."""
    p = F.from_json(F.col(column), "struct<" + ",".join(f"`{k}`:{t}" for k, (t, _) in RECORD.items()) + ">")
    other = lambda t, v: F.from_json(F.lit(json.dumps(v)), t) if t[:3] in ("arr", "map") else F.lit(v).cast(t)
    own = texts.withColumn("_r", p).select("*", *[(F.col(f"_r.{k}") if v is None else F.coalesce(F.col(f"_r.{k}"), other(t, v))).alias(k) for k, (t, v) in RECORD.items()]).drop("_r")
    raw = decode_proposal(F.col("composite_proposal"))
    stale = raw.isNotNull() & (raw["version"] != version)
    findings = {c: F.transform(c, decode_finding) for c in ("review_flags", "hard_rejects")}
    big = lambda v: F.lit(str(v)).cast("decimal(20,0)")
    two = F.when(F.col("phash") >= big(2**63), F.col("phash") - big(2**64)).otherwise(F.col("phash")).cast("long")
    return own.withColumns({**findings, "phash": two, "composite_scan_version": F.when(stale, 0).otherwise(F.col("composite_scan_version")), "composite_proposal": F.when(~stale, raw)})


def encode_records(rows: DataFrame) -> DataFrame:
    """K2: rows as JSON records in one column."""
    return rows.select(F.to_json(F.struct(*rows.columns)).alias("record"))


def by_hash(snapshot: DataFrame) -> DataFrame:
    """(content_sha256, paths) of a current snapshot, paths in order; one content may be at many paths."""
    own = snapshot.where((F.col("version") == CACHE_VERSION) & (F.col("analysis_version") == ANALYSIS_VERSION) & (F.coalesce("content_sha256", F.lit("")) != ""))
    return own.groupBy("content_sha256").agg(F.array_sort(F.collect_list("path_key")).alias("paths"))


# -- text states


def text_states(spark: SparkSession, path: str, folder: str, schema: str) -> DataFrame:
    """The records (path, ...) of a stored text state, with path_key, if it is of this folder; else none."""
    try:
        head = spark.read.schema("folder string").json(f"{path}/head").first()
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
        head = None
    rows = spark.read.schema(schema).parquet(f"{path}/records") if head and head["folder"] == folder.casefold() else spark.createDataFrame([], schema)
    return rows.withColumn("path_key", path_key(F.col("path")))


def save_text_state(records: DataFrame, folder: str, path: str, **parameters) -> None:
    """The records, a row each, and the folder and parameters that they are of, over what was there. The head goes first,
    and comes when the records are there: until then there is no state."""
    spark = records.sparkSession
    Folder(spark, path).delete("head")
    records.write.mode("overwrite").parquet(f"{path}/records")
    spark.createDataFrame([(2, folder.casefold())], "version int, folder string").select("*", *[F.lit(v).alias(k) for k, v in parameters.items()]).coalesce(1).write.json(f"{path}/head")


def filled_size(width: Column, height: Column, decoded: Column) -> Column:
    """The size that is known, else that of the decoded image (width, height), else 1 x 1."""
    one = F.struct(F.lit(1).alias("width"), F.lit(1).alias("height"))
    known = F.struct(width.cast("int").alias("width"), height.cast("int").alias("height"))
    return F.when((width > 0) & (height > 0), known).otherwise(F.coalesce(decoded, one))


# -- composite scans


def composite_shown() -> Column:
    """Recommended rows with a proposal."""
    return (F.col("status") == PICKED) & F.col("composite_decision").isNotNull()


def composite_todo(rows: DataFrame, force: bool = False, version: int = COMPOSITE_VERSION) -> DataFrame:
    """P22, T-8: recommended rows whose scan is of another version; force: all rows given."""
    return rows if force else rows.where((F.col("status") == PICKED) & (F.col("composite_scan_version") != version))


# -- settings, targets, events, cancelling


def settings(data: object) -> dict:
    """Known settings, unknown values as their defaults."""
    data = data if isinstance(data, dict) else {}
    out: dict = {"version": 1}
    for name, allowed in SETTINGS.items():
        value = str(data.get(name, allowed[0])).lower()
        out[name] = value if value in allowed else allowed[0]
    return out | {"background_enrichment": bool(data.get("background_enrichment", True))}


def load_settings(path: str) -> dict:
    """What is not there or can't be read is all defaults."""
    try:
        return settings(json.loads(Path(path).read_text("utf-8")))
    except (OSError, ValueError):
        return settings({})


def target(n: object, mode: str | None = None) -> tuple[int, str]:
    """(target, preset or custom): at least 1; a preset unless asked for as custom."""
    value = max(1, int(n if n is not None else DEFAULT_TARGET))
    return value, "custom" if mode == "custom" or value not in TARGET_PRESETS else "preset"


def available(optional: dict[str, Callable[[], bool]], feature: str) -> bool:
    """A feature that is not optional is there; an optional one if its check finds it."""
    check = optional.get(feature)
    return True if check is None else bool(check())


class Events:
    """Events as lines of JSON with a time, for a logger."""

    def __init__(self, name: str = "loomset"):
        self.log = logging.getLogger(name)

    def __call__(self, event: str, **fields) -> None:
        self.log.info(json.dumps({"time": datetime.now(timezone.utc).isoformat(timespec="milliseconds"), "event": event, **fields}, ensure_ascii=False, default=str))


class Cancel:
    """T-6: jobs started inside run under a tag; cancel() ends them, and what checks() finds out afterwards."""

    def __init__(self, spark: SparkSession, tag: str):
        self.spark, self.tag, self.done = spark, tag, threading.Event()

    def __enter__(self) -> Cancel:
        self.spark.sparkContext.addJobTag(self.tag)
        return self

    def __exit__(self, *_) -> None:
        self.spark.sparkContext.removeJobTag(self.tag)

    def cancel(self) -> None:
        self.done.set()
        self.spark.sparkContext.cancelJobsWithTag(self.tag)

    def check(self) -> None:
        if self.done.is_set():
            raise InterruptedError(self.tag)


# -- copies


def archive(root: str, path: str, archive_name: str) -> str:
    """K8: moves a file below root to the same relative place in the archive folder, under a free name; gives the place."""
    relative = Path(path).relative_to(root)
    folder = Path(root, archive_name, relative.parent)
    folder.mkdir(parents=True, exist_ok=True)
    place = folder / unique_names([relative.name], os.listdir(folder))[0]
    os.replace(path, place)
    return str(place)

