"""Decisions on composite and crop proposals, gates before an export or a move, and the enrichment plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import let
from ..functions.geometry import clamp
from ..functions.quality import LEAST_ALPHA, PADDING
from ..schema import COMPOSITE_VERSION, CROP_READABLE, CROP_VERSION, PICKED, REJECTED

DONE_WITHOUT = ("no_candidate", "keep_original", "scanned")


def allows_crop(version: int = COMPOSITE_VERSION) -> Column:
    """P16."""
    return (F.col("composite_scan_version") == version) & F.coalesce(F.col("composite_decision") == "rejected", F.lit(True))


def crop_current() -> Column:
    """The stored crop state is of a readable version, with a proposal or a state that needs none."""
    state = F.col("crop_version").isin(*CROP_READABLE) & F.when(F.col("crop_box").isNull(), F.col("crop_state").isin(*DONE_WITHOUT)).otherwise(F.size("crop_box") == 4)
    return F.coalesce(state, F.lit(False))


def enrichment_plan(rows: DataFrame, version: int = COMPOSITE_VERSION, composite: bool = True, crop: bool = True) -> DataFrame:
    """T-2, U2: (stage, sample_id, path), each job once; composite first where its scan is stale."""
    stale = (F.col("composite_scan_version") != version) & F.lit(composite)
    may_crop = (allows_crop(version) | F.lit(not composite)) & ~crop_current() & F.lit(crop)
    jobs = rows.where(F.col("status") == PICKED).withColumn("stage", F.when(stale, "composite").when(may_crop, "auto_crop"))
    return jobs.where("stage is not null").select("stage", "sample_id", "path").dropDuplicates(["stage", "sample_id", "path"])


def gates(rows: DataFrame) -> DataFrame:
    """(place, code, n) of what blocks an export or a move, in order; no rows: go on."""
    picked = F.col("status") == PICKED
    own = rows.agg(
        F.count_if(picked & ~crop_current()).alias("auto_crop_unscanned"),
        F.count_if(picked & F.coalesce(F.col("crop_decision") == "pending", F.lit(False))).alias("auto_crop_pending"),
        F.count_if(picked & F.coalesce(F.col("composite_decision") == "pending", F.lit(False))).alias("composite_pending"),
    )
    codes = ("auto_crop_unscanned", "auto_crop_pending", "composite_pending")
    pairs = F.array(*[F.struct(F.lit(k).alias("place"), F.lit(c).alias("code"), F.col(c).alias("n")) for k, c in enumerate(codes)])
    return own.select(F.inline(pairs)).where("n > 0")


def export_plan(rows: DataFrame) -> DataFrame:
    """Recommended rows in file order with the accepted crop box, null for a plain copy."""
    box = F.when(F.col("crop_decision") == "accepted", F.col("crop_box"))
    return rows.where(F.col("status") == PICKED).select("ord", "path", box.alias("crop_box"))


def crop_badge() -> Column:
    """P27."""
    return F.when((F.col("status") == PICKED) & F.col("crop_decision").isin("accepted", "pending"), F.col("crop_decision")).otherwise("")


def decode_crop(p: Column, width: Column, height: Column) -> Column:
    """A stored crop proposal, read from either version; null where its box is none or its decision unknown."""
    decision = F.coalesce(p["decision"], F.lit("pending"))
    auto = F.when(p["version"] >= CROP_VERSION, F.coalesce(p["auto_box"], p["box"])).otherwise(p["box"])
    valid = (F.size(p["box"]) == 4) & (p["box"][2] > p["box"][0]) & (p["box"][3] > p["box"][1])
    known = decision.isin("pending", "accepted", "keep_original")
    return F.when(valid & known & p["version"].isin(*CROP_READABLE), F.struct(F.lit(CROP_VERSION).alias("version"), auto.alias("auto_box"), p["box"].alias("box"), decision.alias("decision"), (auto != p["box"]).alias("manually_adjusted")))


def edit_crop(p: Column, box: Column, width: Column, height: Column) -> Column:
    """M8: any edit clamps the box and makes the proposal pending again."""
    new = clamp(box, width, height)
    return p.withField("box", new).withField("decision", F.lit("pending")).withField("manually_adjusted", p["auto_box"] != new)


def decide_crop(p: Column, action: str) -> Column:
    """M8: accept, keep_original, restore_pending, reset."""
    if action == "reset":
        return p.withField("box", p["auto_box"]).withField("decision", F.lit("pending")).withField("manually_adjusted", F.lit(False))
    return p.withField("decision", F.lit({"accept": "accepted", "keep_original": "keep_original", "restore_pending": "pending"}[action]))


def scan_result(rows: DataFrame) -> DataFrame:
    """A9 of rows with `outcome`: candidate, no_candidate or skipped_existing."""
    n = lambda o: F.count_if(F.col("outcome") == o)
    return rows.agg((n("candidate") + n("no_candidate")).alias("scanned"), n("candidate").alias("candidates"), n("no_candidate").alias("no_candidate"), n("skipped_existing").alias("skipped_existing"))


def decision_counts(rows: DataFrame) -> DataFrame:
    """A10: anything else than accepted or rejected is pending."""
    own = rows.where("composite_decision is not null")
    return own.agg(F.count_if(~F.col("composite_decision").isin("accepted", "rejected")).alias("pending"), F.count_if(F.col("composite_decision") == "accepted").alias("accepted"), F.count_if(F.col("composite_decision") == "rejected").alias("rejected"))


def materialised(rows: DataFrame) -> DataFrame:
    """One row for each box of a proposal (path, mode, boxes, keep): name, box and the state that it gets."""
    kind = F.when(F.col("mode") == "group_crop", "__group_").otherwise("__split_")
    out = rows.select("path", "stem", kind.alias("kind"), F.posexplode(F.arrays_zip("boxes", "keep")).alias("k", "x"))
    return out.select("path", F.concat("stem", "kind", F.lpad((F.col("k") + 1).cast("string"), 2, "0")).alias("name"), F.col("x.boxes").alias("box"), F.when(F.col("x.keep"), PICKED).otherwise(REJECTED).alias("status"))


# -- M9: edits of a composite proposal p, with the array `keep` of what becomes of each box


def baselines(p: Column) -> Column:
    """Baselines that don't match the boxes in number are the boxes."""
    return F.when(F.size(p["baseline_boxes"]) == F.size(p["output_boxes"]), p["baseline_boxes"]).otherwise(p["output_boxes"])


def _without(values: Column, k: int) -> Column:
    return F.filter(values, lambda v, i: i != k)


def create_box(p: Column, keep: Column, box: Column) -> tuple[Column, Column]:
    """A box that is drawn is its own baseline, and kept; the decision stays."""
    made = p.withField("output_boxes", F.array_append(p["output_boxes"], box)).withField("baseline_boxes", F.array_append(baselines(p), box))
    return made, F.array_append(keep, F.lit(True))


def reset_box(p: Column, k: int) -> Column:
    """Box k, if there is one, back to its baseline."""
    base = baselines(p)
    return p.withField("output_boxes", F.transform(p["output_boxes"], lambda b, i: F.when(i == k, base[k]).otherwise(b))).withField("baseline_boxes", base)


def delete_box(p: Column, keep: Column, k: int) -> tuple[Column, Column]:
    """Box k, if there is one, goes, with its baseline and what was to become of it."""
    return p.withField("output_boxes", _without(p["output_boxes"], k)).withField("baseline_boxes", _without(baselines(p), k)), _without(keep, k)


def redetected(p: Column, found: Column, version: int = COMPOSITE_VERSION) -> tuple[Column, Column, Column]:
    """(proposal, keep, scan version) after another detection: what it found, or an empty split, pending and marked as asked for by hand; all is kept."""
    none = F.array().cast("array<array<int>>")
    boxes = F.coalesce(found["output_boxes"], none)
    made = F.coalesce(found, p.withField("mode", F.lit("split_people")).withField("detail", F.lit("")))
    made = made.withField("output_boxes", boxes).withField("baseline_boxes", boxes).withField("manual_triggered", F.lit(True)).withField("decision", F.lit("pending"))
    return made, F.transform(boxes, lambda b: F.lit(True)), F.lit(version)


def decide_composite(p: Column, decision: str) -> Column:
    """rejected or pending are set; a proposal without boxes can't be accepted (M10 does what accepting does)."""
    return p.withField("decision", F.when(F.lit(decision == "accepted") & (F.size(p["output_boxes"]) == 0), p["decision"]).otherwise(F.lit(decision)))


def parse_box(values: Column) -> Column:
    """F16: four whole numbers from an array of texts or numbers, rounded half to even, of a box with an area; else null."""
    numbers = F.transform(values, lambda v: F.bround(v.try_cast("double"), 0).cast("int"))
    sound = (F.size(values) == 4) & F.forall(numbers, lambda v: v.isNotNull()) & (numbers[2] > numbers[0]) & (numbers[3] > numbers[1])
    return F.when(sound, numbers)


#: The fields of a stored crop proposal, and what those that are missing are.
CROP_FIELDS = "version int, auto_box array<string>, box array<string>, decision string, auto_removed_area_ratio double, removed_area_ratio double, alpha_min double, padding_px int, mask_touches_edge boolean, warnings array<string>, manually_adjusted boolean, image_size array<int>"


def decode_crop_text(text: Column) -> Column:
    """A crop proposal from its JSON, with all that is stored of it. The first version has one box, which is the automatic
    one too, and no size; the second its own. Null where the version or the decision is unknown or the box is none."""
    read = F.from_json(text, CROP_FIELDS)
    # Each is found once, however often it is named below.
    parsed = lambda p: F.struct(p.alias("p"), parse_box(p["box"]).alias("box"), parse_box(p["auto_box"]).alias("second"))
    return let(let(read, parsed), lambda v: _crop_of(v["p"], v["box"], v["second"]))


def _crop_of(p: Column, box: Column, second: Column) -> Column:
    """The proposal of its fields and of its boxes as they are read."""
    first = p["version"] == 1
    auto = F.when(first, box).otherwise(F.coalesce(second, box))
    decision = F.coalesce(p["decision"], F.lit("pending"))
    removed = F.coalesce(p["removed_area_ratio"], F.lit(0.0))
    own = F.when(first | (F.coalesce(p["auto_removed_area_ratio"], F.lit(0.0)) == 0), removed).otherwise(p["auto_removed_area_ratio"])
    size = F.when(~first & (F.size(p["image_size"]) == 2), p["image_size"]).otherwise(F.array().cast("array<int>"))
    made = F.struct(
        F.lit(CROP_VERSION).alias("version"), auto.alias("auto_box"), box.alias("box"), decision.alias("decision"), own.alias("auto_removed_area_ratio"), removed.alias("removed_area_ratio"), F.coalesce(p["alpha_min"], F.lit(LEAST_ALPHA)).alias("alpha_min"),
        F.coalesce(p["padding_px"], F.lit(PADDING)).alias("padding_px"), F.coalesce(p["mask_touches_edge"], F.lit(False)).alias("mask_touches_edge"), F.coalesce(p["warnings"], F.array().cast("array<string>")).alias("warnings"), (~first & (auto != box)).alias("manually_adjusted"), size.alias("image_size"),
    )
    return F.when(p["version"].isin(*CROP_READABLE) & decision.isin("pending", "accepted", "keep_original") & box.isNotNull() & auto.isNotNull(), made)


def exported_bundles(ids: Column, new: Column, most: int = 100) -> Column:
    """The ids of bundles with a new one, the last of them."""
    every = F.array_append(ids, new)
    return F.slice(every, F.greatest(F.lit(1), F.size(every) - most + 1), F.lit(most))
