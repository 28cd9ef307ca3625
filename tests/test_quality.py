"""Alignment by known turns, features against plain loops, angles of known rotations, boxes of masks by brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomset.functions import quality


def turned(degrees, scale, shift):
    a = math.radians(degrees)
    return np.array([[scale * math.cos(a), -scale * math.sin(a), shift[0]], [scale * math.sin(a), scale * math.cos(a), shift[1]]])


@pytest.mark.parametrize("degrees,scale,shift", [(0, 1, (0, 0)), (37, 2.5, (100, -20)), (-150, 0.3, (5, 500)), (180, 1, (0.5, 0.5))])
def test_known_turns(degrees, scale, shift):
    target = np.array(quality.UPRIGHT)
    there = turned(degrees, scale, shift)
    source = target @ there[:, :2].T + there[:, 2]
    back = quality.similarity(source, target)
    assert np.allclose(source @ back[:, :2].T + back[:, 2], target)
    source[2] += [40, -70]  # a point that is wrong
    back = quality.robust_similarity(source, target)
    good = [0, 1, 3, 4]
    assert np.allclose((source @ back[:, :2].T + back[:, 2])[good], target[good], atol=1e-6)
    assert quality.similarity(np.ones((5, 2)), target) is None and quality.robust_similarity(np.ones((5, 2)), target) is None


def test_least_squares_is_least():
    rng = np.random.default_rng(2)
    source, target = rng.normal(size=(5, 2)) * 20, rng.normal(size=(5, 2)) * 20
    m = quality.similarity(source, target)
    loss = lambda m: ((source @ m[:, :2].T + m[:, 2] - target) ** 2).sum()
    for _ in range(300):
        other = turned(rng.normal(math.degrees(math.atan2(m[1, 0], m[0, 0])), 5), math.hypot(*m[:, 0]) * rng.normal(1, 0.05), m[:, 2] + rng.normal(size=2))
        assert loss(m) <= loss(other) + 1e-9
    assert np.linalg.det(m[:, :2]) > 0  # never mirrored


def test_warp_round_trip():
    y, x = np.mgrid[:90, :80]
    image = np.stack([2 * x, 2 * y, x + y], -1).astype(np.uint8)
    there = turned(20, 1.2, (30, 5))
    out = quality.warped(image, there, 200, 200)
    inverse = np.linalg.inv(np.vstack([there, [0, 0, 1]]))[:2]
    back = quality.warped(out, inverse, 80, 90)
    assert np.abs(back[8:-8, 8:-8].astype(int) - image[8:-8, 8:-8]).max() <= 2
    assert (quality.warped(image, turned(0, 1, (0, 0)), 80, 90) == image).all()
    assert (quality.warped(image, turned(0, 1, (500, 0)), 80, 90) == 0).all()


def test_upright_column(spark):
    y, x = np.mgrid[:150, :150]
    image = np.stack([x, y, (x + y) // 2], -1).astype(np.uint8)
    there = turned(15, 1.0, (20, 0))
    points = (np.array(quality.UPRIGHT) @ there[:, :2].T + there[:, 2]).tolist()
    rows = [(1, (150, 150, bytearray(image.tobytes())), points), (2, (150, 150, bytearray(b"x")), points), (3, None, points), (4, (150, 150, bytearray(image.tobytes())), None), (5, (150, 150, bytearray(image.tobytes())), [[1.0, 1.0]] * 5)]
    df = spark.createDataFrame(rows, "k int, p struct<width:int,height:int,data:binary>, m array<array<double>>")
    got = {r["k"]: r["u"] for r in df.select("k", quality.upright(F.col("p"), F.col("m")).alias("u")).collect()}
    face = np.frombuffer(got[1]["data"], np.uint8).reshape(112, 112, 3).astype(float)
    v, u = np.mgrid[:112, :112]
    want = np.stack([u, v], -1) @ there[:, :2].T + there[:, 2]
    inside = (want > 1).all(-1) & (want < 148).all(-1)
    assert np.abs(face[..., :2] - want)[inside].max() <= 1
    assert all(got[k] is None or got[k]["data"] is None for k in (2, 3, 4, 5))


# -- features of scenes


def test_contrasts_by_loops():
    plane = np.random.default_rng(0).random((9, 11))
    k = [math.exp(-((j - 3) ** 2) / (2 * (7 / 6) ** 2)) for j in range(7)]
    got = quality.contrasts(plane)
    for y in range(9):
        for x in range(11):
            near = [(k[a] * k[b] / sum(k) ** 2, plane[min(8, max(0, y + a - 3)), min(10, max(0, x + b - 3))]) for a in range(7) for b in range(7)]
            mean = sum(w * v for w, v in near)
            assert got[y, x] == pytest.approx((plane[y, x] - mean) / (math.sqrt(abs(sum(w * v * v for w, v in near) - mean * mean)) + 1 / 255))


@pytest.mark.parametrize("shape", [0.6, 1.0, 2.0, 4.0])
def test_fits_find_the_shape_again(shape):
    """Samples of generalised Gaussians by their quantile, the left side twice as wide."""
    rng = np.random.default_rng(1)
    size = rng.gamma(1 / shape, 1, 400_000) ** (1 / shape)
    sign = rng.choice([-1, 1], 400_000)
    alpha, variance = quality.symmetric_fit(sign * size)
    assert alpha == pytest.approx(shape, rel=0.05) and variance == pytest.approx(math.gamma(3 / shape) / math.gamma(1 / shape), rel=0.05)
    left = rng.random(400_000) < 2 / 3  # as wide as it is often
    alpha, mean, low, high = quality.skewed_fit(np.where(left, -2 * size, size))
    assert alpha == pytest.approx(shape, rel=0.05) and low / high == pytest.approx(4, rel=0.05)
    assert mean == pytest.approx(-math.gamma(2 / shape) / math.gamma(1 / shape), rel=0.06)


def test_features_of_flat_and_tiny_planes():
    assert quality.scene_features(np.full((20, 20), 7, np.uint8))[0] >= 0 and len(quality.scene_features(np.full((20, 20), 7, np.uint8))) == 36
    assert quality.scene_features(np.zeros((1, 5), np.uint8)) == [0.0] * 36
    half = quality.halved(np.arange(64, dtype=float).reshape(8, 8))
    assert half.shape == (4, 4) and half[1, 1] == pytest.approx(2.5 * 8 + 2.5)


def test_noise_and_blur_have_other_features():
    rng = np.random.default_rng(3)
    noise = rng.integers(0, 256, (64, 64)).astype(np.uint8)
    soft = np.clip(quality._blurred(quality._blurred(noise.astype(float))), 0, 255).astype(np.uint8)
    a, b = quality.scene_features(noise), quality.scene_features(soft)
    assert a[3] < 0.1 and b[3] > a[3] + 0.2  # neighbours are alike once it is blurred: the products' mean grows
    assert len(a) == len(b) == 36


# -- angles


@pytest.mark.parametrize("yaw,pitch,roll", [(0, 0, 0), (30, -20, 10), (-75, 44, -120), (89.9999, 0, 0)])
def test_angles_of_known_rotations(spark, yaw, pitch, roll):
    """A rotation with these angles, its rows scaled and shifted as a face model gives them."""
    a, b, c = map(math.radians, (yaw, pitch, roll))
    z = np.array([[math.cos(c), -math.sin(c), 0], [math.sin(c), math.cos(c), 0], [0, 0, 1]])
    y = np.array([[math.cos(a), 0, -math.sin(a)], [0, 1, 0], [math.sin(a), 0, math.cos(a)]])
    x = np.array([[1, 0, 0], [0, math.cos(b), -math.sin(b)], [0, math.sin(b), math.cos(b)]])
    r = z @ y @ x
    given = [*(7.0 * r[0]), 100.0, *(3.0 * r[1]), -5.0, 0.0, 0.0, 0.0, 1.0, 42.0]
    df = spark.createDataFrame([([float(v) for v in given],), ([0.0] * 12,), ([1.0],), (None,)], "p array<double>")
    got = [r["a"] for r in df.select(quality.head_angles(F.col("p")).alias("a")).collect()]
    assert got[0]["yaw"] == pytest.approx(yaw, abs=1e-3)
    if abs(yaw) < 89:
        assert got[0]["pitch"] == pytest.approx(pitch, abs=1e-6) and got[0]["roll"] == pytest.approx(roll, abs=1e-6)
    assert got[1:] == [None, None, None]


# -- masks


@pytest.mark.parametrize("width,height,side", [(30, 20, 16), (20, 30, 16), (7, 7, 21), (50, 3, 32), (1, 40, 16)])
def test_subject_box_by_loops(width, height, side):
    rng = np.random.default_rng(width)
    for _ in range(12):
        square = np.where(rng.random((side, side)) < 0.02, rng.random((side, side)), 0).astype(np.float32)
        x0, y0, w, h = quality.letterbox(width, height, side)
        assert (max(w, h) == side) and x0 == (side - w) // 2 and y0 == (side - h) // 2
        hit = []
        for y in range(height):
            for x in range(width):
                u, v = min(max((x + 0.5) * w / width - 0.5, 0), w - 1), min(max((y + 0.5) * h / height - 0.5, 0), h - 1)
                a, b = int(u), int(v)
                at = lambda p, q: float(square[y0 + min(q, h - 1), x0 + min(p, w - 1)])
                value = (at(a, b) * (1 - u + a) + at(a + 1, b) * (u - a)) * (1 - v + b) + (at(a, b + 1) * (1 - u + a) + at(a + 1, b + 1) * (u - a)) * (v - b)
                if value >= 0.1 + 1e-6 or value > 0.1 - 1e-6 and (hit.append(None) or False):
                    hit.append((x, y))
        if None in hit:  # too near the threshold to tell
            continue
        want = [min(p[0] for p in hit), min(p[1] for p in hit), max(p[0] for p in hit) + 1, max(p[1] for p in hit) + 1] if hit else None
        assert quality.subject_box(square, width, height) == want


def test_proposals_of_boxes(spark):
    rows = [(1, [100, 100, 200, 200]), (2, [0, 5, 390, 290]), (3, None), (4, [0, 100, 50, 200])]
    df = spark.createDataFrame(rows, "k int, b array<int>")
    got = {r["k"]: r["p"] for r in df.select("k", quality.proposed_crop(F.col("b"), F.lit(400), F.lit(300)).alias("p")).collect()}
    assert got[1]["box"] == got[1]["auto_box"] == [68, 68, 232, 232] and got[1]["removed_area_ratio"] == pytest.approx(1 - 164 * 164 / 120000)
    assert got[1]["warnings"] == [] and not got[1]["mask_touches_edge"] and got[1]["image_size"] == [400, 300] and got[1]["decision"] == "pending"
    assert got[2] is None and got[3] is None and got[4]["warnings"] == [quality.EDGE_WARNING]


# -- the registered queries, their images taken apart pixel by pixel

TEXTS = [(7, 1, "u", "The quick brown fox jumps over the lazy dog, again and again. " * 9), (200, 3, "a", "ab"), (5, 0, "u", ""), (41, 2, "u", "Ünïcode 漢字 " * 30)]


@pytest.fixture(scope="module")
def talks(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("talks")
    spark.createDataFrame(TEXTS, "conv_id long, turn long, role string, text string").write.parquet(f"{folder}/conversations.parquet")
    images = {}
    for c, t, _, text in TEXTS:
        raw = text.encode()
        if raw:
            images[c, t] = np.frombuffer(raw + bytes(-len(raw) % 72), np.uint8).reshape(-1, 24, 3)
    return str(folder), images


def slow_features(image):
    """The features as they are written down: sums over pixels, and shapes tried one by one."""
    luma = [[int((19595 * int(r) + 38470 * int(g) + 7471 * int(b) + 32768) >> 16) for r, g, b in row] for row in image]
    plane, out = np.array(luma, float) / 255, []
    shapes = [0.2 + 0.001 * k for k in range(9801)]
    ratio = [math.gamma(2 / g) ** 2 / (math.gamma(1 / g) * math.gamma(3 / g)) for g in shapes]
    nearest = lambda r: shapes[min(range(len(shapes)), key=lambda k: abs(ratio[k] - r))]
    weight = [math.exp(-((j - 3) ** 2) / (2 * (7 / 6) ** 2)) for j in range(7)]
    for scale in (0, 1):
        if scale:
            h, w = plane.shape[0] // 2, plane.shape[1] // 2
            k = (-0.09375, 0.59375, 0.59375, -0.09375)
            get = lambda y, x, p=plane: p[min(max(y, 0), p.shape[0] - 1), min(max(x, 0), p.shape[1] - 1)]
            plane = np.array([[sum(k[a] * k[b] * get(2 * y + a - 1, 2 * x + b - 1) for a in range(4) for b in range(4)) for x in range(w)] for y in range(h)]).reshape(h, w)
        h, w = plane.shape
        if min(h, w) < 2:
            out += [0.0] * 18
            continue
        c = np.zeros((h, w))
        for y in range(h):
            for x in range(w):
                near = [(weight[a] * weight[b] / sum(weight) ** 2, plane[min(max(y + a - 3, 0), h - 1), min(max(x + b - 3, 0), w - 1)]) for a in range(7) for b in range(7)]
                mean = sum(p * v for p, v in near)
                c[y, x] = (plane[y, x] - mean) / (math.sqrt(abs(sum(p * v * v for p, v in near) - mean * mean)) + 1 / 255)
        square = sum(v * v for v in c.flat) / c.size
        out += [nearest((sum(abs(v) for v in c.flat) / c.size) ** 2 / square), square]
        for dy, dx in ((0, 1), (1, 0), (1, 1), (1, -1)):
            pairs = [c[y, x] * c[y + dy, x + dx] for y in range(h - dy) for x in range(max(0, -dx), w - max(0, dx))]
            low, high = [v for v in pairs if v < 0], [v for v in pairs if v > 0]
            a, b = (math.sqrt(sum(v * v for v in s) / len(s)) if s else 0.0 for s in (low, high))
            g = a / b
            square = sum(v * v for v in pairs) / len(pairs)
            shape = nearest((sum(map(abs, pairs)) / len(pairs)) ** 2 / square * (g**3 + 1) * (g + 1) / (g * g + 1) ** 2)
            out += [shape, (b - a) * math.sqrt(math.gamma(1 / shape) / math.gamma(3 / shape)) * math.gamma(2 / shape) / math.gamma(1 / shape), a * a, b * b]
    return out


def test_scene_features_by_brute_force(spark, talks):
    from loomset.plans import pixels

    folder, images = talks
    rows = {(r["conv_id"], r["turn"]): r["features"] for r in pixels.scene_features(spark, folder).collect()}
    assert set(rows) == set(images)
    for key, image in images.items():
        got = [float(v) for v in rows[key].split(",")]
        want = slow_features(image)
        shapes = {k for base in (0, 18) for k in (base, base + 2, base + 6, base + 10, base + 14)}
        for k, (a, b) in enumerate(zip(got, want)):
            assert a == pytest.approx(b, abs=0.0011 if k in shapes else 2e-3 * max(1, abs(b))), (key, k)


def test_upright_faces_by_brute_force(spark, talks):
    """Every pixel from where it was, by the inverse of the turn that the points were made with."""
    import hashlib

    from loomset.plans import pixels

    folder, images = talks
    rows = {(r["conv_id"], r["turn"]): r for r in pixels.upright_faces(spark, folder).collect()}
    assert set(rows) == set(images)
    for (conv, turn), image in images.items():
        a, size = math.radians(conv % 360), (turn % 5 + 3) / 10
        out = np.zeros((112, 112, 3), np.uint8)
        h, w = image.shape[:2]
        for y in range(112):
            for x in range(112):
                u, v = 12 + size * (math.cos(a) * (x - 56) - math.sin(a) * (y - 72)), 12 + size * (math.sin(a) * (x - 56) + math.cos(a) * (y - 72))
                total = np.zeros(3)
                for q in (math.floor(v), math.floor(v) + 1):
                    for p in (math.floor(u), math.floor(u) + 1):
                        if 0 <= p < w and 0 <= q < h:
                            total += (1 - abs(u - p)) * (1 - abs(v - q)) * image[q, p]
                out[y, x] = np.clip(np.floor(total + 0.5), 0, 255)
        found = quality.warped(image, quality.robust_similarity(np.array([[12 + size * (math.cos(a) * (x - 56) - math.sin(a) * (y - 72)), 12 + size * (math.sin(a) * (x - 56) + math.cos(a) * (y - 72))] for x, y in quality.UPRIGHT]), np.array(quality.UPRIGHT)), 112, 112)
        assert np.abs(found.astype(int) - out).max() <= 1 and (found != out).mean() < 0.01
        assert rows[conv, turn]["digest"] == hashlib.sha256(found.tobytes()).hexdigest() and rows[conv, turn]["width"] == 112
