"""Queries that have no SQL, against plain loops over the same rows."""

import math
from collections import defaultdict

from pyspark.sql import functions as F

from loomset.functions import kernels
from loomset.plans import catalogue
from loomset.schema import SCALE_WEIGHTS, SCALES, YAW_WEIGHTS, YAWS

SF = "/root/testdata/sf0.001"


def shares(total, names, weights):
    whole = sum(weights[n] for n in names)
    exact = [total * weights[n] / whole for n in names]
    out = [math.floor(e) for e in exact]
    order = sorted(range(len(names)), key=lambda k: (out[k] - exact[k], k))
    for k in order[: total - sum(out)]:
        out[k] += 1
    return dict(zip(names, out))


def chosen_of(rows, target):
    """Rows one by one: quotas of scales, of yaws in them, the rest of a scale, then scales in turn."""
    best = {}
    for r in sorted((r for r in rows if r.qualified), key=lambda r: (-r.face_quality, r.brisque, -r.blur, r.ord)):
        best.setdefault((0, r.ord) if not r.duplicate_group else (r.duplicate_group, 0), r)
    pool = sorted(best.values(), key=lambda r: (-r.face_quality, r.brisque, -r.blur, r.ord))
    if len(pool) <= target:
        return {r.ord for r in pool}
    left = {s: [r for r in pool if r.person_scale == s] for s in SCALES}
    scales = [s for s in SCALES if left[s]]
    quota, taken = shares(target, scales, SCALE_WEIGHTS), {s: [] for s in scales}

    def take(s, row):
        left[s].remove(row)
        taken[s].append(row)

    for s in scales:
        for yaw, n in shares(quota[s], [y for y in YAWS if any(r.angle_class == y for r in left[s])], YAW_WEIGHTS).items():
            for row in [r for r in left[s] if r.angle_class == yaw][:n]:
                take(s, row)
        for row in left[s][: max(0, quota[s] - len(taken[s]))]:
            take(s, row)
    while sum(map(len, taken.values())) < target and any(left.values()):
        for s in sorted(scales, key=lambda s: len(taken[s]) / max(1, quota[s])):
            if left[s] and sum(map(len, taken.values())) < target:
                take(s, left[s][0])
    return {r.ord for rows in taken.values() for r in rows}


def test_recommendation_row_by_row(spark):
    from loomset.operators import quota

    rows = catalogue._rows(spark, SF).select("ord", "qualified", "face_quality", "brisque", "blur", "duplicate_group", "person_scale", "angle_class").collect()
    for target in (1, 7, 20, 30, 36, 60, 230):
        got = {r.ord for r in quota.recommend(catalogue._rows(spark, SF), target).where(F.col("auto_status") == "推荐").collect()}
        assert got == chosen_of(rows, target), target
    got = {r.ord for r in catalogue.queries()["recommend_topup"](spark, SF).collect() if r.auto_status == "推荐"}
    assert got == chosen_of(rows, 230)


def area(b):
    return max(0, b[2] - b[0]) * max(0, b[3] - b[1])


def shared(a, b):
    return max(0, min(a[2], b[2]) - max(a[0], b[0])) * max(0, min(a[3], b[3]) - max(a[1], b[1]))


def unnested(found):
    kept = []
    for box, c in sorted(found, key=lambda d: (-area(d[0]), -d[1])):
        if all(shared(box, k) / max(1, min(area(box), area(k))) < 0.78 for k, _ in kept):
            kept.append((box, c))
    return kept


def proposal(people, heads, width, height):
    if len(people) > 8 or not heads:
        return None
    left = unnested(people)
    least = max(0.03 * width * height, 0.2 * max(area(b) for b, _ in left))
    left = [(b, c) for b, c in left if area(b) >= least]
    if len(heads) == 1:
        h = heads[0][0]
        x, y = (h[0] + h[2]) / 2, (h[1] + h[3]) / 2
        own = [d for d in left if d[0][0] <= x <= d[0][2] and d[0][1] <= y <= d[0][3]]
        if len(own) > 1:
            left = [d for d in left if d not in own] + [sorted(own, key=lambda d: (-area(d[0]), -d[1]))[0]]
    if not 2 <= len(left) <= 6:
        return None
    boxes = [b for b, _ in left]
    if len(heads) >= 2 and any(shared(a, b) / max(1, min(area(a), area(b))) >= 0.18 for k, a in enumerate(boxes) for b in boxes[:k]):
        u = [f(b[k] for b in boxes) for k, f in enumerate((min, min, max, max))]
        dx, dy = round((u[2] - u[0]) * 0.08), round((u[3] - u[1]) * 0.08)
        return "group_crop", [[max(0, u[0] - dx), max(0, u[1] - dy), min(width, u[2] + dx), min(height, u[3] + dy)]]
    centre = lambda b: (b[0] + b[2], b[1] + b[3])
    spread = [max(centre(b)[k] for b in boxes) - min(centre(b)[k] for b in boxes) for k in (0, 1)]
    return "split_people", sorted(boxes, key=lambda b: (centre(b) if spread[0] >= spread[1] else centre(b)[::-1], b))


def written(boxes):
    return ";".join(",".join(map(str, b)) for b in boxes)


def lines(spark, confidence):
    out = defaultdict(list)
    for r in sorted(catalogue._boxes(spark, SF).collect(), key=lambda r: (r.l_orderkey, r.l_linenumber, r.box, confidence(r.l_linenumber))):
        out[r.l_orderkey].append((list(r.box), confidence(r.l_linenumber)))
    return out


def test_composite_geometry_order_by_order(spark):
    found = lines(spark, lambda k: 1 / (k + 1))
    got = {r.l_orderkey: (r.mode, r.boxes) for r in catalogue.queries()["composite_geometry"](spark, SF).collect()}
    assert set(got) == set(found) and any(m == "group_crop" for m, _ in got.values()) and any(m == "split_people" for m, _ in got.values())
    for key, people in found.items():
        want = proposal(people, people[:2], 1000, 600)
        assert got[key] == ((want[0], written(want[1])) if want else (None, None)), key


def test_detections_order_by_order(spark):
    got = {r.l_orderkey: (r.nms, r.nested) for r in catalogue.queries()["detections_kept"](spark, SF).collect()}
    for key, found in lines(spark, lambda k: k * 7 % 5 / 5).items():
        left, kept = [d for _, d in sorted(enumerate(found), key=lambda x: (-x[1][1], -x[0]))], []
        pixels = lambda b: (b[2] - b[0] + 1) * (b[3] - b[1] + 1)
        for box, _ in left:
            both = [max(0, min(box[2], k[2]) - max(box[0], k[0]) + 1) * max(0, min(box[3], k[3]) - max(box[1], k[1]) + 1) for k in kept]
            if all(n / (pixels(box) + pixels(k) - n) <= 0.3 for n, k in zip(both, kept)):
                kept.append(box)
        assert got[key] == (written(kept), written([b for b, _ in unnested(found)])), key


def test_pixel_metrics_image_by_image(spark):
    import numpy as np

    texts = {r.doc_id: r.text.encode() for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect() if r.text}
    got = {r.doc_id: tuple(r)[1:] for r in catalogue.queries()["pixel_metrics"](spark, SF).collect()}
    assert set(got) == set(texts)
    for i, t in texts.items():
        high = -(-len(t) // 72)
        t += bytes(72 * high - len(t))
        plane = [[(t[3 * (24 * y + x)] * 19595 + t[3 * (24 * y + x) + 1] * 38470 + t[3 * (24 * y + x) + 2] * 7471 + 32768) >> 16 for x in range(24)] for y in range(high)]
        flat = [v for row in plane for v in row]
        assert got[i][0] == kernels.phash(np.array(plane, np.uint8))
        assert math.isclose(got[i][1], sum(flat) / len(flat)) and math.isclose(got[i][2], sum(v < 20 for v in flat) / len(flat)) and math.isclose(got[i][3], sum(v > 235 for v in flat) / len(flat))
        if high == 1:  # there the edge itself is doubled
            continue
        mirror = lambda k, n: -k if k < 0 else 2 * n - 2 - k if k >= n else k
        lap = [sum(plane[mirror(y + b, high)][mirror(x + a, 24)] for a, b in ((0, 1), (0, -1), (1, 0), (-1, 0))) - 4 * plane[y][x] for y in range(high) for x in range(24)]
        mean = sum(lap) / len(lap)
        assert math.isclose(got[i][4], sum((v - mean) ** 2 for v in lap) / len(lap), rel_tol=1e-9, abs_tol=1e-9)
