"""Manifests of a review bundle."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import basename, codes, export_source_label
from .archive import write_zip
from .views import chunks, dataset_summary, histograms

# Columns of the flat manifest, in order.
FLAT = ("sample_id", "filename", "relative_path", "width", "height", "effective_status", "manual_status", "eligibility", "face_count", "face_ratio", "face_px", "face_quality", "brisque", "sharpness", "brightness", "yaw", "pitch", "roll", "angle_class", "pitch_class", "person_scale", "duplicate_group", "review_flag_codes", "hard_reject_codes", "recommendation_reasons")


def _flat_columns(rows: DataFrame) -> list[Column]:
    joined = lambda c: F.array_join(c, "|")
    made = {
        "filename": basename(F.col("relative_path")),
        "effective_status": F.col("status"),
        "manual_status": F.coalesce("manual_status", F.lit("")),
        "face_count": F.col("faces"),
        "sharpness": F.col("blur"),
        "review_flag_codes": joined(codes(F.col("review_flags"))),
        "hard_reject_codes": joined(codes(F.col("hard_rejects"))),
        "recommendation_reasons": joined(F.col("recommendation_reasons")),
    }
    return [made.get(c, F.col(c)).alias(c) for c in FLAT]


def flat(rows: DataFrame) -> DataFrame:
    """K11."""
    return rows.select(*_flat_columns(rows))


# Fields of the parts of a nested entry; renamed ones as (name, column).
ANALYSIS = (("face_count", "faces"), "primary_face_id", "face_ratio", "face_px", "face_quality", "brisque", ("sharpness", "blur"), "brightness", "yaw", "pitch", "roll", "angle_class", "pitch_class", "person_scale", "duplicate_group", "duplicate_ignore")
SELECTION = ("auto_status", "manual_status", ("effective_status", "status"), "eligibility")


def nested(rows: DataFrame, root_name: str = "", keep: tuple[str, ...] = ()) -> DataFrame:
    """One struct a sample, with its findings whole; what rows have no column for is null. keep: columns beside it."""

    def part(fields) -> Column:
        named = [f if isinstance(f, tuple) else (f, f) for f in fields]
        return F.struct(*[(F.col(c) if c in rows.columns else F.lit(None).cast("string")).alias(n) for n, c in named])

    relative = F.col("relative_path")
    own = [F.col("sample_id"), F.col("content_sha256"), relative, basename(relative).alias("filename"), export_source_label(relative, F.lit(root_name)).alias("source"), F.col("width"), F.col("height"), part(SELECTION).alias("selection"), part(ANALYSIS).alias("analysis")]
    rest = ("face_detections", "review_flags", "hard_rejects", "recommendation_reasons", "ai_suggestion")
    return rows.select(*keep, F.struct(*own, *[(F.col(c) if c in rows.columns else F.lit(None).cast("string")).alias(c) for c in rest]).alias("sample"))


#: Rows of a manifest that are one piece of its entry.
PIECE_ROWS = 500


def _csv(names: tuple[str, ...]) -> Column:
    """A line of the flat manifest: texts with a comma, quote or line end are quoted."""
    def cell(c: str) -> Column:
        v = F.coalesce(F.col(c).cast("string"), F.lit(""))
        return F.when(v.rlike('[",\\r\\n]'), F.concat(F.lit('"'), F.replace(v, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(v)

    return F.concat(F.concat_ws(",", *[cell(c) for c in names]), F.lit("\r\n"))


def _lines(rows: DataFrame, name: str, line: Column, first: str, between: str, last: str) -> DataFrame:
    """Pieces of an entry whose rows are lines in order of `ord`; each piece has at most PIECE_ROWS of them."""
    least = rows.agg(F.min("ord").alias("m")).first()["m"]
    own = rows.select("ord", F.concat(F.when(F.col("ord") == least, "").otherwise(between), line).alias("line"), F.floor(F.col("ord") / PIECE_ROWS).cast("long").alias("at"))
    texts = own.groupBy("at").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "line"))), lambda r: r["line"]), "").alias("text"))
    ends = rows.sparkSession.createDataFrame([(-(1 << 62), first), (1 << 62, last)], "at long, text string")
    return texts.select("at", "text").unionByName(ends).select(F.lit(name).alias("name"), "at", F.encode("text", "utf-8").alias("data"))


def bundle_pieces(rows: DataFrame, bundle_id: str, views: list[dict] | None = None, description: str = "", originals: DataFrame | None = None) -> DataFrame:
    """K9: what is in a review bundle, as pieces for archive.write_zip: bundle, nested and flat manifest, summary, views, pages of
    the contact sheets (as lists: whoever has the images draws them), and, if they are given, originals (name, data).

    rows have one `ord` each."""
    spark = rows.sparkSession
    count = rows.count()
    text = lambda name, value: (name, 0, bytearray(json.dumps(value, ensure_ascii=False, indent=2).encode()))
    whole = dataset_summary(rows).first().asDict(recursive=True)
    histogram: dict = {}
    for r in histograms(rows).collect():  # a row a value of a few fields of few values
        histogram.setdefault(r["field"], {})[str(r["value"])] = r["n"]
    head = {"schema_version": 1, "bundle_id": bundle_id, "sample_count": count, "view_description": description, "includes_originals": originals is not None}
    small = spark.createDataFrame([text("bundle.json", head), text("views.json", {"saved": views or []}), text("summary.json", {"totals": whole, "histograms": histogram})], "name string, at long, data binary")
    start = json.dumps({"schema_version": 1, "bundle_id": bundle_id}, ensure_ascii=False)[:-1] + ', "samples": [\n'
    samples = _lines(nested(rows, keep=("ord",)), "manifest.json", F.to_json("sample", {"ignoreNullFields": "false"}), start, ",\n", "\n]}")
    table = rows.select("ord", *_flat_columns(rows))
    lines = _lines(table, "manifest.csv", _csv(FLAT), "\ufeff" + ",".join(FLAT) + "\r\n", "", "")
    pages = chunks(rows.select("ord", "sample_id", "relative_path"), 16).groupBy("page").agg(F.array_sort(F.collect_list(F.struct("slot", "sample_id", "relative_path"))).alias("samples"))
    sheets = pages.select(F.concat(F.lit("contact_sheets/page_"), F.lpad((F.col("page") + 1).cast("string"), 4, "0"), F.lit(".json")).alias("name"), F.lit(0).cast("long").alias("at"), F.encode(F.to_json(F.struct("page", "samples")), "utf-8").alias("data"))
    out = small.unionByName(samples).unionByName(lines).unionByName(sheets)
    return out if originals is None else out.unionByName(originals.select(F.concat(F.lit("originals/"), "name").alias("name"), F.lit(0).cast("long").alias("at"), "data"))


def write_bundle(rows: DataFrame, path: str, bundle_id: str, **parts) -> int:
    """K9: the bundle as one ZIP; the number of its entries."""
    return write_zip(bundle_pieces(rows, bundle_id, **parts), path)
