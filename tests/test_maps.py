"""Text regions of maps, masks and repair: against plain loops over pixels, known shapes and known planes."""

import heapq
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomset.functions import geometry, regions_of_maps, repair
from loomset.plans import pixels


def flood(mask, corners):
    label, n = np.zeros(mask.shape, int), 0
    for start in zip(*np.nonzero(mask)):
        if not label[start]:
            n += 1
            label[start], todo = n, [start]
            while todo:
                y, x = todo.pop()
                for dy in (-1, 0, 1):
                    for dx in (-1, 0, 1):
                        v, u = y + dy, x + dx
                        if (corners or not dy or not dx) and 0 <= v < mask.shape[0] and 0 <= u < mask.shape[1] and mask[v, u] and not label[v, u]:
                            label[v, u] = n
                            todo.append((v, u))
    return label, n


@pytest.mark.parametrize("share", [0.2, 0.5, 0.8])
def test_borders_of_regions_and_holes(share):
    rng = np.random.default_rng(int(share * 10))
    for _ in range(40):
        mask = rng.random(rng.integers(1, 13, 2)) < share
        row, first, last = regions_of_maps.runs(mask)
        for corners in (False, True):
            label, n = flood(mask, corners)
            names = regions_of_maps.components(row, first, last, mask.shape[1], int(corners))
            assert len(set(names.tolist())) == n
            assert len({(a, label[y, x]) for a, y, x in zip(names.tolist(), row, first)}) == n
        label, n = flood(mask, True)
        around, holes = flood(np.pad(~mask, 1, constant_values=True), False)
        want = [np.stack(np.nonzero(label == k)[::-1], 1) for k in range(1, n + 1)]
        for k in range(2, holes + 1):
            ys, xs = np.nonzero(around == k)
            holder = label[ys[0] - 1, xs[0] - 2]
            want.append(np.array(sorted({(x - 1 + dx, y - 1 + dy) for y, x in zip(ys.tolist(), xs.tolist()) for dx, dy in ((1, 0), (-1, 0), (0, 1), (0, -1)) if label[y - 1 + dy, x - 1 + dx] == holder})))
        spanned = lambda ps: sorted(regions_of_maps.hull(p).tolist() for p in ps)
        assert spanned(regions_of_maps.borders(mask)) == spanned(want)


def test_borders_come_from_the_last_to_the_first():
    mask = np.zeros((12, 30), bool)
    mask[1:4, 2:6] = mask[1:4, 20:25] = mask[6:11, 5:25] = True
    mask[8, 10:12] = False
    assert [tuple(p.min(0)) for p in regions_of_maps.borders(mask)] == [(9, 7), (5, 6), (20, 1), (2, 1)]


def test_smallest_rectangle():
    rng = np.random.default_rng(3)
    for _ in range(60):
        points = rng.integers(0, 25, (rng.integers(3, 15), 2))
        h = regions_of_maps.hull(points)
        if len(h) < 3:
            continue
        box, short = regions_of_maps.smallest_rectangle(points)
        sides = np.roll(box, -1, 0) - box
        lengths = np.hypot(*sides.T)
        assert abs(sides[0] @ sides[1]) < 1e-6 and short == pytest.approx(lengths.min())
        turned = [np.ptp(h @ [math.cos(a), math.sin(a)]) * np.ptp(h @ [-math.sin(a), math.cos(a)]) for a in np.linspace(0, math.pi / 2, 2000)]
        assert lengths[0] * lengths[1] <= min(turned) + 1e-6
        for a, s in zip(box, sides):  # all points are on one side of each side
            cross = s[0] * (points - a)[:, 1] - s[1] * (points - a)[:, 0]
            assert (cross >= -1e-6).all() or (cross <= 1e-6).all()


def test_smallest_rectangle_of_a_line_or_point():
    assert regions_of_maps.smallest_rectangle(np.array([[3, 4]]))[1] == 0
    assert regions_of_maps.smallest_rectangle(np.array([[3, 4], [5, 6], [9, 10]]))[1] == 0


def test_filled_polygons():
    rng = np.random.default_rng(4)
    for _ in range(40):
        p = rng.integers(-4, 20, (4, 2))
        mask = regions_of_maps.filled(p, 15, 12)
        on = {tuple(v) for v in regions_of_maps.outline(p).tolist()}
        for y in range(12):
            for x in range(15):
                inside = False
                for a, b in zip(p, np.roll(p, -1, 0)):
                    if (a[1] <= y) != (b[1] <= y) and x < a[0] + (y - a[1]) * (b[0] - a[0]) / (b[1] - a[1]):
                        inside = not inside
                if (x, y) in on or inside:
                    assert mask[y, x]
                elif mask[y, x]:  # only where a side runs through the very middle of the pixel
                    assert any(a[1] != b[1] and abs(x - (a[0] + (y - a[1]) * (b[0] - a[0]) / (b[1] - a[1]))) < 1e-6 for a, b in zip(p, np.roll(p, -1, 0)))


def test_grown_box_keeps_its_distance():
    box = np.array([[10, 10], [70, 30], [64, 48], [4, 28]], float)
    wide = regions_of_maps.grown(box)
    area, length = 60 * 18 + 20 * 6, 2 * (math.hypot(60, 20) + math.hypot(6, 18))
    d = area * 1.5 / length
    for a, b in zip(box, np.roll(box, -1, 0)):
        out = ((wide - a) @ np.array([b[1] - a[1], a[0] - b[0]])) / math.hypot(*(b - a))
        assert out.max() == pytest.approx(d, abs=1)
    far = np.array([min(np.hypot(*(p - (a + np.clip((p - a) @ (b - a) / ((b - a) @ (b - a)), 0, 1) * (b - a)))) for a, b in zip(box, np.roll(box, -1, 0))) for p in wide])
    assert (np.abs(far - d) < 1).all()
    assert regions_of_maps.grown(np.array([[1, 1], [5, 1], [5, 1], [1, 1]], float)) is None


def test_decode_of_known_maps():
    plane = np.zeros((60, 200), np.float32)
    plane[10:14, 4:40] = 0.9
    assert regions_of_maps.decode(plane, 400, 120) == [([[4, 16], [82, 16], [82, 30], [4, 30]], pytest.approx(0.9))]
    plane[30:50, 60:180] = 0.55  # not sure enough
    plane[20:22, 10:40] = 1  # too low
    assert len(regions_of_maps.decode(plane, 200, 60)) == 1
    y, x = np.mgrid[:100, :100]
    tilted = ((np.abs((x - 50) * 0.8 + (y - 50) * 0.6) < 30) & (np.abs(-(x - 50) * 0.6 + (y - 50) * 0.8) < 6)).astype(np.float32)
    ((corners, score),) = regions_of_maps.decode(tilted, 100, 100)
    side = np.array(corners[1]) - corners[0]
    assert math.degrees(math.atan2(side[1], side[0])) == pytest.approx(math.degrees(math.atan2(0.6, 0.8)), abs=2) and score > 0.9
    assert regions_of_maps.decode(np.zeros((0, 0), np.float32).reshape(0, 4), 10, 10) == []


def test_scores_are_lost_together_where_a_region_goes():
    plane = np.zeros((40, 40), np.float32)
    plane[0:4, 2:30] = plane[20:24, 2:30] = 0.8
    assert [s for _, s in regions_of_maps.decode(plane, 40, 40)] == pytest.approx([0.8, 0.8])
    small = regions_of_maps.decode(plane, 40, 12)  # a fifth of the height: sides of at most 3 pixels go
    assert all(s == 1.0 for _, s in small) and len(small) < 2


def test_corner_order(spark):
    """The corners that ordering by rows first gets wrong, upright ones, and a square on its tip."""
    cases = [([(0, 3), (10, 0), (11, 2), (1, 5)], [(0, 3), (10, 0), (11, 2), (1, 5)]), ([(9, 9), (0, 0), (0, 9), (9, 0)], [(0, 0), (9, 0), (9, 9), (0, 9)]), ([(5, 0), (10, 5), (5, 10), (0, 5)], [(5, 0), (10, 5), (5, 10), (0, 5)])]
    rows = spark.createDataFrame([(k, [list(p) for p in given]) for k, (given, _) in enumerate(cases)], "k int, p array<array<int>>")
    got = {r["k"]: [tuple(p) for p in r["q"]] for r in rows.select("k", geometry.order_points(F.col("p")).alias("q")).collect()}
    for k, (given, want) in enumerate(cases):
        assert [tuple(p) for p in regions_of_maps.ordered(np.array(given)).tolist()] == got[k]
        if k < 2:
            assert got[k] == want


def test_maps_of_other_kinds(spark):
    floats = np.zeros((20, 30), "<f4")
    floats[5:12, 4:20] = 0.75
    rows = [(1, 30, 20, floats.tobytes()), (2, 30, 20, (floats * 255).astype(np.uint8).tobytes()), (3, 30, 20, b"short"), (4, None, 20, b""), (5, 0, 0, b""), (6, 30, 20, None)]
    df = spark.createDataFrame([(k, (w, h, bytearray(d) if d is not None else None)) for k, w, h, d in rows], "k int, m struct<width:int,height:int,data:binary>")
    got = {r["k"]: r["f"] for r in df.select("k", regions_of_maps.text_regions(F.col("m"), F.lit(30), F.lit(20)).alias("f")).collect()}
    assert len(got[1]) == len(got[2]) == 1 and got[1][0]["poly"] == got[2][0]["poly"] and got[1][0]["score"] == pytest.approx(0.75)
    assert got[3] is None and got[4] is None and got[5] == [] and got[6] is None


# -- repair


@pytest.mark.parametrize("reach", [0, 1, 2, 5])
def test_dilation(reach):
    mask = np.random.default_rng(reach).random((13, 19)) < 0.04
    want = mask.copy()
    for y, x in zip(*np.nonzero(mask)):
        for down, across in repair.ellipse(reach):
            if 0 <= y + down < 13:
                want[y + down, max(0, x - across) : x + across + 1] = True
    assert (repair.dilated(mask, reach) == want).all()


def slow_repair(image, mask, radius, method):
    """The same method, written down pixel by pixel over dictionaries."""
    height, width = mask.shape
    inside = {(y, x) for y in range(height) for x in range(width)}
    todo = {(y, x) for y, x in inside if mask[y, x]}
    value = {p: image[p].astype(float) for p in inside - todo}
    four = lambda y, x: [(y - 1, x), (y, x - 1), (y + 1, x), (y, x + 1)]

    def arrival(known, y, x):
        best = 1e6
        for dy in (-1, 1):
            for dx in (-1, 1):
                a, b = known.get((y + dy, x)), known.get((y, x + dx))
                some = [v for v in (a, b) if v is not None]
                if some:
                    best = min(best, (a + b + math.sqrt(2 - (a - b) ** 2)) / 2 if len(some) == 2 and abs(a - b) < 1 else 1 + min(some))
        return best

    def march(area, known, visit):
        guess, heap = {}, []

        def look(y, x):
            for p in four(y, x):
                if p in area and p not in known:
                    t = arrival(known, *p)
                    if t < guess.get(p, 1e6):
                        guess[p] = t
                        heapq.heappush(heap, (t, *p))

        for p in sorted(known):
            look(*p)
        while heap:
            t, y, x = heapq.heappop(heap)
            if (y, x) not in known:
                if visit(y, x, t, guess, known) is False:
                    break
                known[y, x] = guess[y, x]
                look(y, x)

    outer = {}
    march(inside - todo, dict.fromkeys(todo, 0.0), lambda y, x, t, g, k: False if g[y, x] > 2 * radius + 1 else outer.__setitem__((y, x), 1 - g[y, x]))

    def slope(of, y, x, at):
        out = []
        for a, b in (((y - 1, x), (y + 1, x)), ((y, x - 1), (y, x + 1))):
            ka, kb = of(a), of(b)
            out.append((kb - ka) / 2 if ka is not None and kb is not None else kb - at if kb is not None else at - ka if ka is not None else 0.0 * at)
        return out

    def paint(y, x, t, guess, known):
        t = guess[y, x]
        time = lambda p: guess.get(p) if p in todo else outer.get(p, 0.0)  # noqa: E731  pixels outside the image are at 0
        gy, gx = slope(time, y, x, t)
        top, below = 0.0, 0.0
        for dy in range(-radius, radius + 1):
            for dx in range(-radius, radius + 1):
                q = (y + dy, x + dx)
                if 0 < dy * dy + dx * dx <= radius * radius and q in value:
                    ry, rx, d2 = -dy, -dx, dy * dy + dx * dx
                    iy, ix = slope(value.get, *q, value[q])
                    if method == repair.TELEA:
                        turn = abs(ry * gy + rx * gx) / math.sqrt(d2)
                        w = (1e-6 if turn < 0.01 else turn) / (d2 * (1 + abs(time(q) - t)))
                        top, below = top + w * (value[q] + iy * ry + ix * rx), below + w
                    else:
                        steep = np.sqrt(iy**2 + ix**2) * math.sqrt(d2)
                        along = np.where(steep > 0, np.abs(-ry * ix + rx * iy) / np.where(steep > 0, steep, 1), 0.0)
                        w = np.maximum(along, 1e-6) / (d2 + 1)
                        top, below = top + w * value[q], below + w
        value[y, x] = np.clip(np.floor(top / below + 0.5), 0, 255)

    march(todo, dict.fromkeys(value, 0.0), paint)
    return np.array([[value[y, x] for x in range(width)] for y in range(height)]).astype(np.uint8)


@pytest.mark.parametrize("method", [repair.TELEA, repair.ISOPHOTES])
@pytest.mark.parametrize("seed", range(3))
def test_repair_by_brute_force(method, seed):
    rng = np.random.default_rng(seed)
    image = np.clip(np.cumsum(rng.integers(-9, 10, (17, 21, 3)), 1) + 120, 0, 255).astype(np.uint8)
    mask = regions_of_maps.filled(rng.integers(0, 17, (4, 2)), 21, 17) | (rng.random((17, 21)) < 0.05)
    got, want = repair.repaired(image, mask, 3, method), slow_repair(image, mask, 3, method)
    assert np.abs(got.astype(int) - want).max() <= 1 and (got != want).mean() < 0.01


def test_repair_of_known_planes():
    mask = np.zeros((40, 60), bool)
    mask[10:22, 15:48] = mask[:5, :9] = mask[35:, 50:] = True
    flat = np.full((40, 60, 3), [10, 120, 240], np.uint8)
    y, x = np.mgrid[:40, :60]
    ramp = np.repeat((2 * x + 3 * y)[..., None], 3, 2).astype(np.uint8)
    inner = mask.copy()
    inner[:5, :9] = inner[35:, 50:] = False
    for image, own, methods in ((flat, mask, (repair.TELEA, repair.ISOPHOTES)), (ramp, inner, (repair.TELEA,))):
        spoilt = image.copy()
        spoilt[own] = 0
        for method in methods:
            assert (repair.repaired(spoilt, own, 3, method) == image).all()
    assert (repair.repaired(flat, np.zeros_like(mask), 3) == flat).all() and (repair.repaired(ramp, np.ones_like(mask), 3) == ramp).all()


def test_repair_column(spark):
    image = np.full((9, 12, 3), 50, np.uint8)
    image[3:6, 4:8] = 255
    data, box = bytearray(image.tobytes()), [[[4, 3], [7, 3], [7, 5], [4, 5]]]
    rows = [(1, (12, 9, data), box), (2, (12, 9, data), []), (3, (12, 9, data), None), (4, (12, 9, bytearray(b"x")), box), (5, None, box), (6, (12, 9, data), [[[40, 3], [50, 3], [50, 9]]])]
    df = spark.createDataFrame(rows, "k int, p struct<width:int,height:int,data:binary>, c array<array<array<int>>>")
    got = {r["k"]: r["r"] for r in df.select("k", repair.repair(F.col("p"), F.col("c"), 0, 3).alias("r")).collect()}
    assert set(got[1]["data"]) == {50} and (got[1]["width"], got[1]["height"]) == (12, 9)
    assert all(got[k]["data"] == data for k in (2, 3, 6))
    assert all(got[k] is None or got[k]["data"] is None for k in (4, 5))


def test_repaired_images_by_brute_force(spark):
    """The registered query on a small table, its images rebuilt pixel by pixel."""
    import hashlib
    import tempfile

    folder = tempfile.mkdtemp()
    texts = [(1, 0, "u", "The quick brown fox jumps over the lazy dog. " * 12), (1, 1, "a", "ab"), (2, 0, "u", ""), (3, 0, "u", None), (4, 0, "u", "Ünïcode 漢字 " * 40)]
    spark.createDataFrame(texts, "conv_id long, turn long, role string, text string").write.parquet(f"{folder}/conversations.parquet")
    rows = {(r["conv_id"], r["turn"]): r for r in pixels.repaired_images(spark, folder).collect()}
    assert set(rows) == {(1, 0), (1, 1), (4, 0)}
    for c, t, _, text in texts:
        if (c, t) in rows:
            raw = text.encode()
            h = -(-len(raw) // 72)
            image = np.frombuffer(raw + bytes(-len(raw) % 72), np.uint8).reshape(h, 24, 3)
            half = lambda v: math.floor(h / 2 + v)
            mask = repair.mask_of([np.array([(7, half(-2)), (15, half(-1)), (14, half(2)), (6, half(1))])], 24, h, 1)
            for name, method in (("telea", repair.TELEA), ("isophotes", repair.ISOPHOTES)):
                want = slow_repair(image, mask, 3, method) if mask.any() else image
                assert rows[c, t][name] == hashlib.sha256(want.tobytes()).hexdigest()
