"""Column builders: classes, findings, eligibility, blockers, names, hashes. All stay inside the JVM."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import BACKUP, FINDING, FINDING_TEXTS, REASON_TEXTS, REJECTED

# Review flags that keep a sample out of the automatic selection.
BLOCKING = ("no_face_full_body_review", "secondary_faces_detected", "probable_multi_person", "low_face_pixels", "extreme_exposure", "face_detection_error", "face_quality_error", "head_pose_error", "face_sharpness_error", "brisque_error", "pose_analysis_error")
STAGE_ERRORS = ("pose_analysis_error", "face_detection_error", "face_sharpness_error", "face_quality_error", "head_pose_error", "brisque_error")


def blank_to_null(c: Column) -> Column:
    return F.when(c != "", c)


def effective_status(manual: Column, auto: Column) -> Column:
    """A manual status, where there is one, else the automatic one."""
    return F.coalesce(blank_to_null(manual), auto)


def yaw_class(yaw: Column) -> Column:
    """P7."""
    turned = F.abs(yaw)
    side = lambda left, right: F.when(yaw > 0, left).otherwise(right)
    return F.when(turned < 15, "正脸").when(turned < 45, side("左3/4", "右3/4")).otherwise(side("左侧脸", "右侧脸"))


def pitch_class(pitch: Column) -> Column:
    """P8."""
    return F.when(pitch >= 22, "仰头").when(pitch <= -12, "低头").otherwise("正常")


def person_scale(landmarks: Column) -> Column:
    """P9, of 33 landmarks (x, y, visibility): the lowest pair of joints that can be seen inside the image."""
    seen = lambda first: F.exists(F.slice(landmarks, first + 1, 2), lambda p: p["x"].between(0, 1) & p["y"].between(0, 1) & (p["visibility"] >= 0.45))
    return F.when(landmarks.isNull(), "近景/头肩").when(seen(27), "全身").when(seen(25), "大半身").when(seen(23), "半身").otherwise("近景/头肩")


def finding(code: str, source: str, value: Column | None = None, threshold: float | None = None, detail: Column | None = None) -> Column:
    detail = F.lit(FINDING_TEXTS[code]) if detail is None else detail
    value = F.lit(None).cast("double") if value is None else value.cast("double")
    return F.struct(F.lit(code).alias("code"), F.lit(source).alias("source"), value.alias("value"), F.lit(threshold).cast("double").alias("threshold"), detail.alias("detail"))


def _present(*pairs: tuple[Column, Column]) -> Column:
    return F.array_compact(F.array(*[F.when(cond, f) for cond, f in pairs])).cast(f"array<{FINDING}>")


def review_flags(dark: Column | None = None, bright: Column | None = None) -> Column:
    """P10, the rules that ask for a review, in order; columns as in the sample table."""
    c, face = F.col, F.col("faces") > 0
    zero = F.lit(0.0)
    dark, bright = dark if dark is not None else zero, bright if bright is not None else zero
    exposed = (c("brightness") < 28) | (c("brightness") > 228) | (dark > 0.55) | (bright > 0.55)
    return _present(
        ((c("faces") == 0) & (c("person_scale") == "全身"), finding("no_face_full_body_review", "yunet")),
        (c("faces") > 1, finding("secondary_faces_detected", "yunet", c("faces"), 1.0, F.format_string(FINDING_TEXTS["secondary_faces_detected"], c("faces")))),
        ((c("width") < 512) | (c("height") < 512), finding("low_resolution", "image", F.least("width", "height"), 512.0)),
        (face & (c("face_px") < 120), finding("low_face_pixels", "primary_face", c("face_px"), 120.0)),
        (face & (c("face_ratio") < 0.018), finding("low_face_ratio", "primary_face", c("face_ratio"), 0.018)),
        (face & (c("blur") < 25), finding("severe_face_blur", "primary_face", c("blur"), 25.0)),
        (face & (c("face_quality") < 0.25), finding("low_face_quality", "ediffiqa", c("face_quality"), 0.25)),
        (c("brisque") > 80, finding("high_brisque", "brisque", c("brisque"), 80.0)),
        (exposed, finding("extreme_exposure", "image", c("brightness"), None)),
    )


def hard_rejects() -> Column:
    """P10, the rules that reject."""
    return _present(((F.col("faces") == 0) & (F.col("person_scale") != "全身"), finding("no_face_not_full_body", "yunet")))


def with_stage_errors(flags: Column, errors: Column) -> Column:
    """Flags, then one for each stage that failed. errors: map of stage code to message."""
    own = F.array(*[F.when(errors[code].isNotNull(), finding(code, "analysis", detail=errors[code])) for code in STAGE_ERRORS])
    return F.concat(flags, F.array_compact(own).cast(f"array<{FINDING}>"))


def unless_unreadable(flags: Column, rejects: Column, error: Column) -> tuple[Column, Column]:
    """Flags and rejects, or, of an image that can't be read, only that, as a reject: nothing else is known of it."""
    said = finding("read_error", "image", detail=F.concat(F.lit(FINDING_TEXTS["read_error"]), error))
    none = F.array().cast(f"array<{FINDING}>")
    return F.when(error.isNull(), flags).otherwise(none), F.when(error.isNull(), rejects).otherwise(F.array(said).cast(f"array<{FINDING}>"))


def eligibility(rejects: Column, flags: Column) -> Column:
    """P4."""
    return F.when(F.size(rejects) > 0, "REJECT").when(F.size(flags) > 0, "REVIEW").otherwise("PASS")


def finding_text(f: Column) -> Column:
    """P15."""
    return F.coalesce(blank_to_null(f["detail"]), f["code"])


def codes(findings: Column) -> Column:
    return F.transform(findings, lambda f: f["code"])


def blockers() -> Column:
    """Why a sample is kept out of the automatic selection, in order."""
    flags, side = F.col("review_flags"), F.col("angle_class").isin("左侧脸", "右侧脸")
    said = lambda prefix, fs: F.transform(fs, lambda f: F.concat(F.lit(prefix), finding_text(f)))
    return F.concat(
        said(REASON_TEXTS["rejected"], F.col("hard_rejects")),
        said(REASON_TEXTS["review"], F.filter(flags, lambda f: f["code"].isin(*BLOCKING))),
        F.when(~side, said(REASON_TEXTS["review"], F.filter(flags, lambda f: f["code"] == "low_face_quality"))).otherwise(F.array().cast("array<string>")),
        F.array_compact(F.array(F.when(F.col("brisque") > 70, F.format_string(REASON_TEXTS["noise"], "brisque")), F.when(F.col("blur") < 40, F.format_string(REASON_TEXTS["blur"], "blur")))),
    )


def base_status(eligible: Column) -> Column:
    """P14."""
    return F.when(eligible == "REJECT", REJECTED).otherwise(BACKUP)


def rank_order(order: str = "ord") -> list[Column]:
    """Face quality, then low BRISQUE, then sharpness; file order between equals."""
    return [F.col("face_quality").desc(), F.col("brisque").asc(), F.col("blur").desc(), F.col(order).asc()]


def rank_key() -> Column:
    """W1 as a value that is smallest for the best, in the order of rank_order."""
    quality, noise, sharp = F.col("face_quality"), F.col("brisque"), F.col("blur")
    return F.struct(quality.isNull().alias("a"), (-quality).alias("b"), noise.isNotNull().alias("c"), noise.alias("d"), sharp.isNull().alias("e"), (-sharp).alias("f"), F.col("ord").alias("g"))


def position(c: Column, domain: Iterable[str]) -> Column:
    """O2: place in a domain; anything else comes last."""
    return reduce(lambda w, kv: w.when(c == kv[1], kv[0]), enumerate(domain), F.when(F.lit(False), -1)).otherwise(99)


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stem(path: Column) -> Column:
    return F.regexp_replace(basename(path), r"(?<=.)\.[^.]*$", "")


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(basename(path), r".\.([^.]*)$", 1))


def parent(path: Column) -> Column:
    return F.regexp_replace(path, r"/[^/]*$", "")


def path_key(path: Column) -> Column:
    return F.lower(path)


def source_label(path: Column, origin: Column | None = None) -> Column:
    """The organizer's source, else the name before `_frame_`, else the folder."""
    name = stem(path)
    plain = F.when(F.instr(name, "_frame_") > 0, F.substring_index(name, "_frame_", 1)).otherwise(parent(path))
    return plain if origin is None else F.coalesce(blank_to_null(origin), plain)


def export_source_label(relative: Column, root_name: Column) -> Column:
    """P2c."""
    name = stem(relative)
    folder = F.when(F.instr(relative, "/") > 0, parent(relative)).otherwise(root_name)
    return F.when(F.instr(name, "_frame_") > 0, F.substring_index(name, "_frame_", 1)).otherwise(folder)


def output_suffix(path: Column) -> Column:
    """K7: a known suffix stays, any other (gif too) becomes png."""
    s = suffix(path)
    return F.when(s.isin("jpg", "jpeg", "png", "webp", "bmp", "tif", "tiff"), F.concat(F.lit("."), s)).otherwise(".png")


def cache_digest(key: Column) -> Column:
    """F25."""
    return F.substring(F.sha2(key, 256), 1, 24)


def human_bytes(n: Column) -> Column:
    """F24. Ties go to the even digit, as in C and Python; Java's formats round them up. Null for null."""
    whole = n.cast("double").cast("long")

    def rounded(bits: int, scale: int) -> Column:
        """whole * scale by 2^bits, to the nearest whole number."""
        part = whole.bitwiseAND((1 << bits) - 1) * scale
        low, rest = F.shiftright(whole, bits) * scale + F.shiftright(part, bits), part.bitwiseAND((1 << bits) - 1) * 2
        return low + F.when((rest > 1 << bits) | ((rest == 1 << bits) & (low % 2 == 1)), 1).otherwise(0)

    text = lambda c: c.cast("string")
    tenths = lambda bits, unit: F.concat(text(F.floor(rounded(bits, 10) / 10)), F.lit("."), text(rounded(bits, 10) % 10), F.lit(unit))
    return F.when(n < 1024, F.concat(text(n), F.lit(" B"))).when(n < 1024**2, F.concat(text(rounded(10, 1)), F.lit(" KB"))).when(n < 1024**3, tenths(20, " MB")).when(n.isNotNull(), tenths(30, " GB"))


def hamming(a: Column, b: Column) -> Column:
    """F2, of hashes kept in two's complement."""
    return F.bit_count(a.bitwiseXOR(b))


def let(value: Column, body) -> Column:
    """body(value), with value computed once however often body names it."""
    return F.transform(F.array(value), body)[0]


def hash_bits(values: Column) -> Column:
    """'1' for each value above the median, the first value first."""

    def median(ranked: Column) -> Column:
        n = F.size(ranked)
        low, high = F.element_at(ranked, (F.floor((n + 1) / 2)).cast("int")), F.element_at(ranked, (F.floor(n / 2) + 1).cast("int"))
        return (low.cast("double") + high.cast("double")) / 2

    bits = lambda m: F.array_join(F.transform(values, lambda v: F.when(v.cast("double") > m, "1").otherwise("0")), "")
    return let(let(F.array_sort(values), median), bits)


def bits_to_long(bits: Column) -> Column:
    """64 bits, the first one the highest, as a two's complement number."""
    half = lambda at: F.conv(F.substring(bits, at, 32), 2, 10).cast("long")
    return F.shiftleft(half(1), 32).bitwiseOR(half(33))
