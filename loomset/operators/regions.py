"""Text regions: eligibility, suggestions, repeated overlays, edits and batch repair plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import extent, polygon_area

REGION = "struct<poly:array<array<int>>,selected:boolean,manual:boolean,score:double,suggested:boolean>"


def zipped(boxes: Column, selected: Column, manual: Column, scores: Column, suggested: Column) -> Column:
    """Parallel arrays as one array of regions; missing entries are false, score 1, suggested as selected."""
    at = lambda a, k, other: F.coalesce(F.get(a, k), other)
    one = lambda b, k: F.struct(b.alias("poly"), at(selected, k, F.lit(False)).alias("selected"), at(manual, k, F.lit(False)).alias("manual"), at(scores, k, F.lit(1.0)).alias("score"), at(suggested, k, at(selected, k, F.lit(False))).alias("suggested"))
    return F.transform(boxes, one)


def eligible(region: Column, width: Column, height: Column, min_height: float = 8, min_area: float = 64, min_score: float = 0.5) -> Column:
    """P20."""
    tall = F.greatest(F.lit(1), extent(region["poly"], 1)) >= F.greatest(F.lit(float(min_height)), 0.004 * height)
    large = polygon_area(region["poly"]) >= F.greatest(F.lit(float(min_area)), 1e-5 * height * width)
    return tall & large & (region["score"] >= min_score)


def eligible_regions(regions: Column, width: Column, height: Column, **limits: float) -> Column:
    return F.filter(regions, lambda r: eligible(r, width, height, **limits))


def view_mode(regions: Column, mode: str) -> Column:
    """P21 over eligible regions: all, repair, text, manual."""
    return {"repair": F.exists(regions, lambda r: r["selected"]), "text": F.size(regions) > 0, "manual": F.exists(regions, lambda r: r["manual"])}.get(mode, F.lit(True))


def centre(poly: Column, k: int, side: Column) -> Column:
    total = F.aggregate(poly, F.lit(0.0), lambda s, p: s + p[k])
    return total / F.size(poly) / side


def regions_of(records: DataFrame) -> DataFrame:
    """One row a region of (path, source, width, height, regions), with its centre and bins (rounded half to even, T2)."""
    out = records.select("path", "source", "width", "height", F.posexplode("regions").alias("k", "region"))
    out = out.withColumns({"cx": centre(F.col("region.poly"), 0, F.col("width")), "cy": centre(F.col("region.poly"), 1, F.col("height"))})
    return out.withColumns({"bx": F.bround("cx", 1), "by": F.bround("cy", 1)})


def repeats(regions: DataFrame) -> DataFrame:
    """A7."""
    return regions.groupBy("source", "bx", "by").agg(F.count(F.lit(1)).alias("repeats"))


def suggest(records: DataFrame) -> DataFrame:
    """Regions with `suggested`. Lines near the upper or lower edge, or at the same place of a source twice."""
    regions = regions_of(records)
    joined = regions.join(repeats(regions), ["source", "bx", "by"])
    poly = F.col("region.poly")
    bw, bh = F.greatest(F.lit(1), extent(poly, 0)), F.greatest(F.lit(1), extent(poly, 1))
    edge, share = (F.col("cy") < 0.18) | (F.col("cy") > 0.70), bw / F.col("width")
    line = (share >= 0.12) & (bw / bh >= 1.35)
    return joined.withColumn("suggested", (edge & line) | ((F.col("repeats") >= 2) & edge & (share >= 0.06)))


def totals(records: DataFrame, **limits: float) -> DataFrame:
    """A8."""
    own = records.withColumn("_e", eligible_regions(F.col("regions"), F.col("width"), F.col("height"), **limits))
    return own.agg(F.sum(F.size("_e")).alias("eligible"), F.sum(F.size(F.filter("_e", lambda r: r["selected"]))).alias("selected"), F.count_if(F.exists("regions", lambda r: r["manual"])).alias("manual_records"))


def add_region(regions: Column, poly: Column) -> Column:
    """M11."""
    return F.array_append(regions, F.struct(poly.alias("poly"), F.lit(True).alias("selected"), F.lit(True).alias("manual"), F.lit(1.0).alias("score"), F.lit(False).alias("suggested")))


def delete_region(regions: Column, k: int) -> Column:
    return F.filter(regions, lambda r, i: i != k)


def select_suggested(regions: Column) -> Column:
    return F.transform(regions, lambda r: r.withField("selected", r["suggested"]))


def clear_selected(regions: Column) -> Column:
    return F.transform(regions, lambda r: r.withField("selected", F.lit(False)))


def restore(files: DataFrame, state: DataFrame) -> DataFrame:
    """Files with their stored regions where size and time are the same, else `detect`."""
    own = state.select("path_key", F.col("file_size").alias("_s"), F.col("mtime_ns").alias("_t"), "regions")
    joined = files.join(own, "path_key", "left")
    same = F.coalesce((F.col("file_size") == F.col("_s")) & (F.col("mtime_ns") == F.col("_t")), F.lit(False))
    return joined.withColumn("regions", F.when(same, F.col("regions"))).withColumn("detect", ~same).drop("_s", "_t")
