"""Boxes and polygons as array expressions. Faces are [x, y, w, h]; other boxes are [x0, y0, x1, y1]."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .expressions import let


def area(b: Column) -> Column:
    """F8."""
    return F.greatest(F.lit(0), b[2] - b[0]) * F.greatest(F.lit(0), b[3] - b[1])


def intersection(a: Column, b: Column) -> Column:
    w = F.least(a[2], b[2]) - F.greatest(a[0], b[0])
    h = F.least(a[3], b[3]) - F.greatest(a[1], b[1])
    return F.greatest(F.lit(0), w) * F.greatest(F.lit(0), h)


def union_box(boxes: Column) -> Column:
    side = lambda k, f: f(F.transform(boxes, lambda b: b[k]))
    return F.array(side(0, F.array_min), side(1, F.array_min), side(2, F.array_max), side(3, F.array_max))


def contains_centre(box: Column, other: Column) -> Column:
    cx, cy = (other[0] + other[2]) / 2, (other[1] + other[3]) / 2
    return cx.between(box[0], box[2]) & cy.between(box[1], box[3])


def to_corners(xywh: Column) -> Column:
    return F.array(xywh[0], xywh[1], xywh[0] + xywh[2], xywh[1] + xywh[3])


def keep_greedily(items: Column, clashes, kind: str) -> Column:
    """Keeps each item, in order, that clashes with none kept before it."""
    return F.aggregate(items, F.array().cast(f"array<{kind}>"), lambda kept, x: F.when(F.exists(kept, lambda k: clashes(k, x)), kept).otherwise(F.array_append(kept, x)))


def stably(items: Column, *keys) -> Column:
    """items sorted by the keys of each, equals in the order they came in."""
    ranked = F.transform(items, lambda x, k: F.struct(*[key(x).cast("double").alias(f"k{n}") for n, key in enumerate(keys)], k.alias("at"), x.alias("x")))
    return F.transform(F.array_sort(ranked), lambda r: r["x"])


def _by_area_then_confidence(detections: Column) -> Column:
    return stably(detections, lambda d: -area(d["bbox"]), lambda d: -d["confidence"])


def dedupe_faces(faces: Column) -> Column:
    """largest first; a face goes if its IoU with a kept one is 0.45 or more, or 0.82 of the smaller is shared. Areas
    count as 1 at least."""
    one = F.lit(1.0)
    size = lambda f: F.greatest(one, f[2] * f[3])

    def clash(a: Column, b: Column) -> Column:
        shared = intersection(to_corners(a), to_corners(b)).cast("double")
        return (shared / F.greatest(one, size(a) + size(b) - shared) >= 0.45) | (shared / F.greatest(one, F.least(size(a), size(b))) >= 0.82)

    return F.when(F.size(faces) < 2, faces).otherwise(keep_greedily(stably(faces, lambda f: -(f[2] * f[3])), clash, "array<double>"))


def faces_in_roi(faces: Column, roi: Column) -> Column:
    """the centre inside the region [x0, y0, x1, y1], or 0.35 of the face, which counts as 1 at least; without a region all."""
    inside = lambda f: contains_centre(roi, to_corners(f)) | (intersection(roi, to_corners(f)).cast("double") / F.greatest(F.lit(1.0), f[2] * f[3]) >= 0.35)
    return F.when(roi.isNull(), faces).otherwise(F.filter(faces, inside))


def consolidated(faces: Column, roi: Column) -> Column:
    """faces [x, y, w, h, ..., confidence] in the region, each once; with a region only the one whose area times confidence is the
    largest, the first of equals."""
    worth = lambda f: F.greatest(F.lit(1.0), f[2] * f[3]) * F.greatest(F.lit(0.01), F.when(F.size(f) > 14, F.element_at(f, -1)).otherwise(1.0))
    best = lambda fs: F.array_max(F.transform(fs, lambda f, k: F.struct(worth(f).alias("s"), (-k).alias("k"))))["k"]
    return let(dedupe_faces(faces_in_roi(faces, roi)), lambda fs: F.when(roi.isNotNull() & (F.size(fs) > 1), F.array(F.get(fs, -best(fs)))).otherwise(fs))


# Landmarks of the head and of the shoulders, and how well they must be seen; the least sides of a head's region,
# and its sides by the spread of the head's landmarks and by the shoulders; what lies before its middle.
HEAD_MARKS, SHOULDERS, HEAD_SEEN, SHOULDER_SEEN = 11, (11, 12), 0.25, 0.2
HEAD_LEAST, HEAD_SPREAD, HEAD_SHOULDERS, HEAD_BEFORE = (70.0, 90.0), (2.4, 3.2), (0.9, 1.05), (0.5, 0.55)


def head_roi(marks: Column, width: Column, height: Column) -> Column:
    """the region [x0, y0, x1, y1] of a head from landmarks (x, y, visibility), which are shares of the image; null with less
    than two of the head in sight. Marks whose visibility isn't known are seen."""
    seen = lambda p, least: p["x"].between(0, 1) & p["y"].between(0, 1) & (F.coalesce(p["visibility"], F.lit(1.0)) >= least)
    sides = (width.cast("double"), height.cast("double"))
    left, right = (F.get(marks, k) for k in SHOULDERS)
    both = F.coalesce(seen(left, SHOULDER_SEEN) & seen(right, SHOULDER_SEEN), F.lit(False))
    across = F.when(both, F.hypot((left["x"] - right["x"]) * sides[0], (left["y"] - right["y"]) * sides[1])).otherwise(0.0)

    def region(head: Column) -> Column:
        def along(name: str, k: int) -> Column:
            return F.transform(head, lambda p: p[name] * sides[k])

        ends = []
        for k, name in enumerate(("x", "y")):
            at = along(name, k)
            mean = F.aggregate(at, F.lit(0.0), lambda s, v: s + v) / F.size(head)
            side = F.greatest(F.lit(HEAD_LEAST[k]), (F.array_max(at) - F.array_min(at)) * HEAD_SPREAD[k], across * HEAD_SHOULDERS[k])
            ends.append((F.greatest(F.lit(0.0), mean - side * HEAD_BEFORE[k]), F.least(sides[k], mean + side * (1 - HEAD_BEFORE[k]))))
        return F.when(F.size(head) >= 2, F.array(ends[0][0], ends[1][0], ends[0][1], ends[1][1]))

    return let(F.filter(F.slice(marks, 1, HEAD_MARKS), lambda p: seen(p, HEAD_SEEN)), region)


def primary_face(faces: Column) -> Column:
    """index of the face (area, confidence) with the largest area times confidence, the first of equals."""
    scored = F.transform(faces, lambda f, k: F.struct((f["area"] * F.greatest(F.lit(0.01), f["confidence"])).alias("s"), (-k).alias("k")))
    return -F.array_max(scored)["k"]


def suppress_nested(detections: Column, kind: str) -> Column:
    """largest first; a box goes if 0.78 of the smaller of the two is shared with a kept one."""
    clash = lambda a, b: intersection(a["bbox"], b["bbox"]) / F.greatest(F.lit(1), F.least(area(a["bbox"]), area(b["bbox"]))) >= 0.78
    return keep_greedily(_by_area_then_confidence(detections), clash, kind)


def significant(detections: Column, width: Column, height: Column) -> Column:
    """0.03 of the image and 0.2 of the largest."""
    least = lambda ds: F.greatest(0.03 * width * height, 0.2 * F.array_max(F.transform(ds, lambda d: area(d["bbox"]))))
    return let(detections, lambda ds: let(least(ds), lambda bound: F.filter(ds, lambda d: area(d["bbox"]) >= bound)))


def single_head(people: Column, heads: Column) -> Column:
    """with one head, people who hold its centre become the largest of them, put last."""
    head = F.element_at(heads, 1)["bbox"]
    holds = lambda p: contains_centre(p["bbox"], head)

    def merged(ps: Column, own: Column) -> Column:
        best = F.element_at(_by_area_then_confidence(own), 1)
        return F.when(F.size(own) > 1, F.array_append(F.filter(ps, lambda p: ~holds(p)), best)).otherwise(ps)

    return let(people, lambda ps: F.when(F.size(heads) == 1, let(F.filter(ps, holds), lambda own: merged(ps, own))).otherwise(ps))


def is_group(people: Column, heads: Column) -> Column:
    """F12."""
    overlap = lambda a, b: intersection(a["bbox"], b["bbox"]) / F.greatest(F.lit(1), F.least(area(a["bbox"]), area(b["bbox"]))) >= 0.18
    indexed = F.transform(people, lambda p, k: F.struct(p.alias("p"), k.alias("k")))
    pair = let(indexed, lambda ps: F.exists(ps, lambda a: F.exists(ps, lambda b: (a["k"] < b["k"]) & overlap(a["p"], b["p"]))))
    return (F.size(people) >= 2) & (F.size(heads) >= 2) & pair


def expand(box: Column, ratio: float, width: Column, height: Column) -> Column:
    """by a share of each side, rounded half to even, inside the image."""
    dx, dy = F.bround((box[2] - box[0]) * F.lit(ratio), 0).cast("int"), F.bround((box[3] - box[1]) * F.lit(ratio), 0).cast("int")
    return F.array(F.greatest(F.lit(0), box[0] - dx), F.greatest(F.lit(0), box[1] - dy), F.least(width, box[2] + dx), F.least(height, box[3] + dy))


def pad(box: Column, pixels: int, width: Column, height: Column) -> Column:
    return F.array(F.greatest(F.lit(0), box[0] - pixels), F.greatest(F.lit(0), box[1] - pixels), F.least(width, box[2] + pixels), F.least(height, box[3] + pixels))


def reading_order(boxes: Column) -> Column:
    """Along the axis over which the centres spread more."""
    spread = lambda k: F.array_max(F.transform(boxes, lambda b: b[k] + b[k + 2])) - F.array_min(F.transform(boxes, lambda b: b[k] + b[k + 2]))
    along = lambda a, b: F.transform(F.array_sort(F.transform(boxes, lambda x: F.struct((x[a] + x[a + 2]).alias("p"), (x[b] + x[b + 2]).alias("q"), x.alias("x")))), lambda s: s["x"])
    return F.when(spread(0) >= spread(1), along(0, 1)).otherwise(along(1, 0))


def composite_proposal(people: Column, heads: Column, width: Column, height: Column, kind: str) -> Column:
    """null, or (mode, boxes): a crop of the group, or one box a person in reading order."""
    split = lambda boxes: F.struct(F.lit("split_people").alias("mode"), reading_order(boxes).alias("boxes"))
    group = lambda boxes: F.struct(F.lit("group_crop").alias("mode"), let(union_box(boxes), lambda u: F.array(expand(u, 0.08, width, height))).alias("boxes"))

    def proposal(left: Column) -> Column:
        mode = let(F.transform(left, lambda p: p["bbox"]), lambda boxes: F.when(is_group(left, heads), group(boxes)).otherwise(split(boxes)))
        return F.when(F.size(left).between(2, 6), mode)

    left = single_head(significant(suppress_nested(people, kind), width, height), heads)
    return F.when((F.size(people) <= 8) & (F.size(heads) > 0), let(left, proposal))


def crop_proposal(mask_box: Column, width: Column, height: Column, padding: int = 32, least_removed: float = 0.05) -> Column:
    """F15 from the box of the subject: null where too little goes; the edge is looked at before the padding."""
    box = pad(mask_box, padding, width, height)
    removed = F.lit(1.0) - area(box).cast("double") / (width * height).cast("double")
    touches = (mask_box[0] <= 0) | (mask_box[1] <= 0) | (mask_box[2] >= width) | (mask_box[3] >= height)
    return F.when((area(mask_box) > 0) & (removed >= least_removed), F.struct(box.alias("box"), removed.alias("removed"), touches.alias("touches_edge")))


def clamp(box: Column, width: Column, height: Column) -> Column:
    """F16: inside the image and at least one pixel wide and high."""
    x0 = F.least(F.greatest(box[0], F.lit(0)), width - 1)
    y0 = F.least(F.greatest(box[1], F.lit(0)), height - 1)
    return F.array(x0, y0, F.least(F.greatest(box[2], x0 + 1), width), F.least(F.greatest(box[3], y0 + 1), height))


def polygon_area(points: Column) -> Column:
    """F18, the shoelace formula over an array of [x, y]."""
    n = F.size(points)
    term = lambda k: points[k][0] * points[(k + 1) % n][1] - points[(k + 1) % n][0] * points[k][1]
    return F.abs(F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0.0).cast("double"), lambda s, k: s + term(k))) / 2


def extent(points: Column, k: int) -> Column:
    return F.array_max(F.transform(points, lambda p: p[k])) - F.array_min(F.transform(points, lambda p: p[k]))


def order_points(points: Column) -> Column:
    """four corners clockwise: the upper of the two leftmost, the upper and the lower of the two rightmost, the lower of
    the two leftmost. Of equal columns the upper is taken as further left."""
    by = lambda ps, a, b: F.transform(F.array_sort(F.transform(ps, lambda p: F.struct(p[a].alias("a"), p[b].alias("b"), p.alias("p")))), lambda s: s["p"])

    def halves(ps: Column) -> Column:
        left, right = by(F.slice(ps, 1, 2), 1, 0), by(F.slice(ps, 3, 2), 1, 0)
        return let(left, lambda l: let(right, lambda r: F.array(l[0], r[0], r[1], l[1])))

    return let(by(points, 0, 1), halves)


def clipped_points(points: Column, width: Column, height: Column) -> Column:
    """corners inside the image."""
    return F.transform(points, lambda p: F.array(F.least(F.greatest(p[0], F.lit(0)), width - 1), F.least(F.greatest(p[1], F.lit(0)), height - 1)))


def large_enough(points: Column, least: int = 3) -> Column:
    """the sides from the first corner to the second and to the fourth, in whole pixels, are both longer than that."""
    side = lambda k: F.floor(F.sqrt((points[0][0] - points[k][0]).cast("double") * (points[0][0] - points[k][0]) + (points[0][1] - points[k][1]).cast("double") * (points[0][1] - points[k][1])))
    return (side(1) > least) & (side(3) > least)


def nms(detections: Column, threshold: float, kind: str) -> Column:
    """by score, of equal ones the last first, areas counted in whole pixels, IoU above the threshold goes."""
    side = lambda b, k: b[k + 2] - b[k] + 1
    size = lambda b: side(b, 0) * side(b, 1)

    def clash(a: Column, b: Column) -> Column:
        a, b = a["bbox"], b["bbox"]
        w = F.greatest(F.lit(0), F.least(a[2], b[2]) - F.greatest(a[0], b[0]) + 1)
        h = F.greatest(F.lit(0), F.least(a[3], b[3]) - F.greatest(a[1], b[1]) + 1)
        return w * h / (size(a) + size(b) - w * h) > threshold

    return keep_greedily(stably(F.reverse(detections), lambda d: -d["confidence"]), clash, kind)
