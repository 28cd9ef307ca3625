"""Saved views, compiled to DataFrame plans, and the summaries of a dataset."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import position, rank_order
from ..schema import ELIGIBILITIES, PICKED, PITCHES, SCALES, STATUSES, YAWS
from .dupes import with_group_rank

ALL = "全部"
FORWARD, BACKWARD = "优先顺序", "反向"
FILTERS = ("status", "person_scale", "angle_class", "pitch_class", "eligibility")
BEST_FIRST = ("质量排序", "Face Quality", "Sharpness", "Face Pixels")
PAGE = 120
# Sort modes of the first format, as (field, direction), and fields that it sorted downwards.
OLD_SORTS = {
    "Face Quality 高 → 低": ("Face Quality", "优先顺序"),
    "Face Quality 低 → 高": ("Face Quality", "反向"),
    "BRISQUE 低 → 高": ("BRISQUE", "优先顺序"),
    "BRISQUE 高 → 低": ("BRISQUE", "反向"),
    "Sharpness 高 → 低": ("Sharpness", "优先顺序"),
    "Sharpness 低 → 高": ("Sharpness", "反向"),
    "状态": ("状态", "优先顺序"),
    "Duplicate Group": ("Duplicate Group", "优先顺序"),
    "来源目录 / 源视频": ("来源目录 / 源视频", "优先顺序"),
    "景别": ("景别", "优先顺序"),
    "Yaw": ("Yaw", "优先顺序"),
    "Pitch": ("Pitch", "优先顺序"),
}
OLD_DOWN = ("Face Quality", "Sharpness", "Face Pixels")


@dataclass(frozen=True)
class ViewSpec:
    name: str = ""
    filters: dict[str, str] = field(default_factory=dict)
    sort_field: str = "默认顺序"
    sort_direction: str = FORWARD
    best_only: bool = False
    quick_mode: str = ""
    limit_n: int = 10
    ranking_basis: str = "综合质量"


def decode(data: dict) -> ViewSpec:
    """A stored view of either format; ascending and descending become natural and reversed order, any other
    direction the natural one. What is no object is the default view."""
    if not isinstance(data, dict):
        return ViewSpec()
    name, direction = str(data.get("sort_field", "默认顺序")), str(data.get("sort_direction", FORWARD))
    if data.get("sort_mode") and "sort_field" not in data:
        name, direction = OLD_SORTS.get(str(data["sort_mode"]), ("默认顺序", FORWARD))
    if direction in ("降序", "升序"):
        direction = FORWARD if (direction == "降序") == (name in OLD_DOWN) else BACKWARD
    text = lambda key, other: str(data.get(key, other))
    return ViewSpec(text("name", ""), dict(data.get("filters", {})), name, direction if direction == BACKWARD else FORWARD, bool(data.get("best_only", False)), text("quick_mode", ""), max(1, int(data.get("limit_n", 10))), text("ranking_basis", "综合质量"))


def upsert(views: list[ViewSpec], view: ViewSpec) -> list[ViewSpec]:
    """M12."""
    return [view if v.name == view.name else v for v in views] if any(v.name == view.name for v in views) else [*views, view]


def delete(views: list[ViewSpec], name: str) -> list[ViewSpec]:
    return [v for v in views if v.name != name]


def accessor(rows: DataFrame, name: str) -> Column:
    """A column, or null where rows have none of that name."""
    return F.col(f"`{name}`") if name in rows.columns else F.lit(None)


def matching(rows: DataFrame, filters: dict[str, str]) -> DataFrame:
    """P5, P6."""
    for name, value in filters.items():
        if value != ALL:
            rows = rows.where(accessor(rows, name).eqNullSafe(F.lit(value)))
    return rows


def sort_keys(name: str, backward: bool = False) -> list[Column]:
    """O1, O2; the file order breaks ties upwards in both directions."""
    c = F.col
    keys = {
        "质量排序": [c("face_quality"), -c("brisque"), c("blur")],
        "Face Quality": [c("face_quality")],
        "BRISQUE": [c("brisque")],
        "Sharpness": [c("blur")],
        "Face Pixels": [c("face_px")],
        "状态": [position(c("status"), STATUSES)],
        "Eligibility": [position(c("eligibility"), ELIGIBILITIES)],
        "Duplicate Group": [(c("duplicate_group") == 0).cast("int"), c("duplicate_group")],
        "来源目录 / 源视频": [c("source")],
        "景别": [position(c("person_scale"), SCALES)],
        "Yaw": [position(c("angle_class"), YAWS)],
        "Pitch": [position(c("pitch_class"), PITCHES)],
    }.get(name)
    if keys is None:
        return [c("ord").asc()]
    down = (name in BEST_FIRST) != backward
    return [*[k.desc() if down else k.asc() for k in keys], c("ord").asc()]


def basis_keys(basis: str, down: bool) -> list[Column]:
    """O3."""
    c = F.col
    keys = {"Face Quality": [c("face_quality")], "BRISQUE": [-c("brisque")], "Sharpness": [c("blur")], "Face Pixels": [c("face_px")]}.get(basis, [c("face_quality"), -c("brisque"), c("blur")])
    return [k.desc() if down else k.asc() for k in keys]


def run_view(rows: DataFrame, spec: ViewSpec) -> tuple[DataFrame, list[Column]]:
    """The rows of a view, and its order. Only a view with a top or bottom is cut, by the engine's top-k."""
    ranked = with_group_rank(rows, qualified=True) if spec.best_only else rows
    out = matching(ranked, spec.filters)
    if spec.best_only:  # O4
        out = out.where("duplicate_group = 0 or group_rank = 1").drop("group_rank", "group_size")
    order = sort_keys(spec.sort_field, spec.sort_direction == BACKWARD)
    if spec.quick_mode:
        order = [*basis_keys(spec.ranking_basis, spec.quick_mode == "view_top"), *order]
        return out.orderBy(*order).limit(spec.limit_n), order
    return out, order


def clamp_page(page: int, rows: int, size: int) -> tuple[int, int]:
    """(page, pages), both from 1: the page kept inside the pages there are."""
    pages = max(1, -(-rows // size))
    return min(max(1, page), pages), pages


def page_of(rows: DataFrame, order: list[Column], page: int, size: int = PAGE) -> DataFrame:
    """W8, one page from 0: top-k of all pages up to it, then the last of them."""
    return rows.orderBy(*order).offset(page * size).limit(size)


def chunks(rows: DataFrame, size: int, by: str | None = None) -> DataFrame:
    """Rows with `page` and `slot` in file order, inside each value of `by`. Rows are numbered in ranges of
    (by, file order), and a value's first number is taken off, so that no value is one task."""
    from .dupes import numbered

    keys = [by, "ord"] if by else ["ord"]
    placed = numbered(rows, *keys)
    if by:
        first = placed.groupBy(by).agg(F.min("number").alias("_least")).withColumnRenamed(by, "_by")
        placed = placed.join(first, F.col(by).eqNullSafe(F.col("_by"))).withColumn("number", F.col("number") - F.col("_least") + 1).drop("_by", "_least")
    place = F.col("number") - 1
    return placed.withColumn("page", F.floor(place / size).cast("int")).withColumn("slot", (place % size).cast("int")).drop("number")


def even_sample(rows: DataFrame, limit: int) -> DataFrame:
    """Rows at evenly spaced places of the file order; one is the middle."""
    from .dupes import numbered

    n = rows.count()
    wanted = range(n) if limit >= n else [n // 2] if limit == 1 else [round(k * (n - 1) / (limit - 1)) for k in range(limit)]
    return numbered(rows, "ord").where(F.col("number").isin([k + 1 for k in wanted])).drop("number")


def histograms(rows: DataFrame) -> DataFrame:
    """A2's five histograms in one pass: (field, value, n)."""
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in FILTERS])
    return rows.select(F.explode(pairs).alias("x")).groupBy("x.field", "x.value").agg(F.count(F.lit(1)).alias("n"))


def dataset_summary(rows: DataFrame) -> DataFrame:
    """A2's counts."""
    return rows.agg(
        F.count(F.lit(1)).alias("total"),
        F.countDistinct(F.when(F.col("duplicate_group") != 0, F.col("duplicate_group"))).alias("groups"),
        F.count_if(F.col("duplicate_group") != 0).alias("group_members"),
        F.count_if(F.col("duplicate_ignore")).alias("ignored"),
        F.count_if(F.exists("review_flags", lambda f: f["code"] == "secondary_faces_detected")).alias("secondary_faces"),
        F.count_if(F.col("faces") == 0).alias("no_face"),
        F.count_if(F.size("hard_rejects") > 0).alias("hard_rejects"),
    )


def picked_histograms(rows: DataFrame) -> DataFrame:
    """A3's counts: of the status over all rows, of scale, yaw and pitch over the recommended ones; one pass."""
    pair = lambda f: F.struct(F.lit(f).alias("field"), F.col(f).alias("value"))
    pairs = F.when(F.col("status") == PICKED, F.array(*[pair(f) for f in FILTERS[:4]])).otherwise(F.array(pair("status")))
    return rows.select(F.explode(pairs).alias("x")).groupBy("x.field", "x.value").agg(F.count(F.lit(1)).alias("n"))


def stats(rows: DataFrame) -> DataFrame:
    """A3: one row of counts; rows have `qualified`."""
    ranked = with_group_rank(rows, qualified=True)
    picked = F.col("status") == PICKED
    taken = rows.where(picked & (F.col("duplicate_group") != 0)).select("duplicate_group").distinct().withColumn("_taken", F.lit(True))
    joined = ranked.join(taken, "duplicate_group", "left")
    lost = ~picked & (F.col("eligibility") != "REJECT") & (F.col("duplicate_group") != 0) & ((F.col("group_rank") > 1) | F.coalesce("_taken", F.lit(False)))
    return joined.agg(
        F.count_if(F.col("auto_status") == PICKED).alias("auto_picked"),
        F.count_if((F.coalesce("manual_status", F.lit("")) == PICKED) & (F.col("auto_status") != PICKED)).alias("manual_added"),
        F.count_if(picked).alias("picked"),
        F.countDistinct("source").alias("sources"),
        F.countDistinct(F.when(F.col("duplicate_group") != 0, F.col("duplicate_group"))).alias("groups"),
        F.count_if(lost).alias("lost_to_copies"),
        F.count_if(F.col("eligibility") == "REVIEW").alias("review"),
        F.count_if(F.col("eligibility") == "REJECT").alias("rejected"),
    )


def reversed_view(spec: ViewSpec) -> ViewSpec:
    return replace(spec, sort_direction=BACKWARD if spec.sort_direction == FORWARD else FORWARD)
