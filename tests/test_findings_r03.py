"""What the third round of findings asked for."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomset.functions import repair


@pytest.mark.parametrize("expand", [0, 1, 2, 5])
def test_masked_rows_of_many_images(expand):
    """Runs against planes; images may be lower than the ellipse."""
    rng = np.random.default_rng(expand)
    for _ in range(60):
        n = int(rng.integers(1, 6))
        widths, heights = rng.integers(1, 30, n), rng.integers(1, 25, n)
        polygons = [(k, rng.integers(-6, 30, (int(rng.integers(0, 7)), 2))) for k in range(n) for _ in range(rng.integers(0, 4))]
        of = np.repeat(np.arange(len(polygons)), [len(p) for _, p in polygons]).astype(np.int64)
        points = np.concatenate([np.zeros((0, 2), np.int64), *[p for _, p in polygons]])
        found = repair.masked_rows(np.array([k for k, _ in polygons], np.int64), of, points[:, 0], points[:, 1], widths, heights, expand)
        got = list(zip(*(c.tolist() for c in found)))
        want = [repair.mask_of([p for j, p in polygons if j == k], int(widths[k]), int(heights[k]), expand).sum(1) for k in range(n)]
        assert got == [(k, y, c) for k, rows in enumerate(want) for y, c in enumerate(rows.tolist()) if c]


def test_masked_pixels_in_parts(spark, monkeypatch):
    box = lambda x, y: [[x, y], [x + 9, y + 2], [x + 7, y + 6]]
    rows = [(1, [box(3, 4), box(20, 1)], 40, 20), (2, None, 40, 20), (3, [], 40, 20), (4, [box(60, 4)], 40, 20), (5, [box(-3, -2)], 8, 3), (6, [box(1, 1)], None, 3)]
    df = spark.createDataFrame(rows, "k int, c array<array<array<int>>>, w int, h int")
    monkeypatch.setattr(repair, "MASK_WORK", 10)
    got = {r["k"]: r["m"] if r["m"] is None else [tuple(x) for x in r["m"]] for r in df.select("k", repair.masked_pixels(F.col("c"), F.col("w"), F.col("h"), 5).alias("m")).collect()}
    for k, cover, w, h in rows:
        if cover is None or w is None:
            assert got[k] is None
        else:
            dense = repair.mask_of([np.array(p) for p in cover], w, h, 5).sum(1)
            assert got[k] == [(y, int(n)) for y, n in enumerate(dense) if n]


@pytest.mark.parametrize("method", [repair.TELEA, repair.ISOPHOTES])
def test_images_with_one_mask_are_repaired_together(method, monkeypatch):
    """Steps that don't depend on the image are found once for all images with the same mask, and each image is as if alone."""
    rng = np.random.default_rng(8)
    masks = [np.zeros((h, 24), bool) for h in (7, 30, 30, 31, 7)]
    for m in masks:
        m[len(m) // 2 - 1 : len(m) // 2 + 2, 6:15] = True
    images = [rng.integers(0, 256, (len(m), 24, 3)).astype(np.uint8) for m in masks]
    alone = [repair.repaired(i, m, 3, method) for i, m in zip(images, masks)]
    marched, steps = [], repair._steps
    monkeypatch.setattr(repair, "_steps", lambda todo, *a: marched.append(todo.shape) or steps(todo, *a))
    repair._kept_steps.cache_clear()
    together = repair.repaired_alike(images, masks, 3, method)
    assert all((a == b).all() for a, b in zip(alone, together)) and len(marched) < len(images)
    monkeypatch.setattr(repair, "KEPT_PIXELS", 0)
    assert all((a == b).all() for a, b in zip(alone, repair.repaired_alike(images, masks, 3, method)))


def test_pieces_of_pixels(monkeypatch):
    import pandas as pd

    from loomset.functions import kernels

    monkeypatch.setattr(kernels, "PIECE_BYTES", 10)
    batch = pd.DataFrame({"data": [b"1234567", None, b"12345678", b"1", b"", b"1" * 40, b"12"]})
    cuts = list(kernels.pieces(batch))
    assert [i for c in cuts for i in range(*c.indices(len(batch)))] == list(range(len(batch))) and len(cuts) > 2
    assert all(sum(len(d or b"") for d in batch["data"][c][1:]) <= 10 for c in cuts)
    assert list(kernels.pieces(batch[:0])) == [slice(0, 0)]


def test_upright_regions_by_kinds(spark):
    """Rectangles of one size grow once, however many there are; the result is that of every contour by itself."""
    from loomset.functions import regions_of_maps as maps

    rng = np.random.default_rng(6)
    for trial in range(60):
        plane = np.zeros(rng.integers(20, 90, 2), np.float32)
        for _ in range(12):
            y, x = rng.integers(0, plane.shape[0]), rng.integers(0, plane.shape[1])
            plane[y : y + rng.integers(1, 12), x : x + rng.integers(1, 30)] = rng.choice([0.9, 0.7, 0.4]) if trial % 2 else 0.9
        want = []
        for points in maps.borders(plane > maps.LEAST):
            box, short = maps.smallest_rectangle(points)
            if short >= maps.LEAST_SIDE and (score := maps.mean_inside(plane, box)) >= maps.LEAST_MEAN and (wide := maps.grown(box)) is not None:
                box, short = maps.smallest_rectangle(wide)
                if short >= maps.LEAST_SIDE + 2:
                    h, w = plane.shape
                    own = np.clip(np.round(box.astype(np.float32)), 0, [w, h]).astype(np.int64)
                    own = np.clip(maps.ordered(own), 0, [w - 1, h - 1])
                    want.append((own, score, min(int(np.hypot(*(own[0] - own[k]))) for k in (1, 3)) > 3))
        scores = [s if all(w[2] for w in want) else 1.0 for _, s, keep in want if keep]
        got = maps.decode(plane, plane.shape[1], plane.shape[0], None)
        assert got == [(own.tolist(), s) for (own, _, _), s in zip([w for w in want if w[2]], scores)]
    plane = np.zeros((600, 400), np.float32)
    for y in range(5, 590, 10):
        for x in range(5, 380, 40):
            plane[y : y + 4, x : x + 24] = 0.9
    maps._grown_upright.cache_clear()
    assert len(maps.decode(plane, 400, 600, None)) == 590 and maps._grown_upright.cache_info().misses < 10


def test_pairs_of_a_wide_threshold_by_blocks(spark, monkeypatch):
    """Blocks of hashes against all pairs; each hash's bands agree with most others, so they are no help."""
    from loomset.operators import dupes

    rng = np.random.default_rng(2)
    hashes = rng.integers(1, 1 << 62, 300).tolist() + [-5, 0, 0]
    rows = list(enumerate(hashes + hashes[:20]))
    df = spark.createDataFrame(rows, "id long, phash long")
    first = {h: k for k, h in reversed(rows)}
    apart = lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count()
    want = {(a, b, apart(h, g)) for h, a in first.items() for g, b in first.items() if a < b and h and g and apart(h, g) <= 22}
    want |= {(first[h], k, 0) for k, h in rows if h and first[h] != k}
    for block, pairs in ((32_768, 500_000), (40, 3)):
        monkeypatch.setattr(dupes, "BLOCK", block)
        monkeypatch.setattr(dupes, "PAIRS", pairs)
        got = [tuple(r) for r in dupes.hamming_pairs(df, 22).collect()]
        assert len(got) == len(set(got)) and set(got) == want


@pytest.mark.parametrize("ahead, bits", [(16_384, 62), (40, 62), (7, 24), (20, 12)])
def test_groups_settled_ahead(spark, monkeypatch, ahead, bits):
    """The sequential rule, with many close pairs and with few; with and without the second way to be close."""
    from loomset.operators import dupes

    monkeypatch.setattr(dupes, "AHEAD", ahead)
    rng = np.random.default_rng(bits)
    rows = [(k, (k * 7919) % 1000 * 1000 + k, int(h), None if k % 13 == 0 else k % 3, k % 2, float(k * 37 % 181 - 90), None if k % 29 == 0 else float(k * 53 % 91 - 45)) for k, h in enumerate(rng.integers(0, 1 << 62, 250) & int(rng.integers(1 << 61, 1 << 62) if bits > 30 else (1 << bits) - 1 << 20))]
    df = spark.createDataFrame(rows, "id long, pri long, phash long, source long, person_scale long, yaw double, pitch double")
    for adjacent in (None, 26):
        limit = 20 if bits > 30 else 13
        apart = lambda a, b: (a[2] ^ b[2]).bit_count()
        beside = lambda a, b: adjacent is not None and a[3:5] == b[3:5] and None not in (a[6], b[6]) and abs(a[5] - b[5]) <= 25 and abs(a[6] - b[6]) <= 25 and apart(a, b) <= adjacent
        left, groups, number = sorted((r for r in rows if r[2]), key=lambda r: r[1]), {r[0]: 0 for r in rows}, 0
        while left:
            mine = [r for r in left if apart(left[0], r) <= limit or beside(left[0], r)]
            if len(mine) > 1:
                number += 1
                groups |= {r[0]: number for r in mine}
            left = [r for r in left if r not in mine]
        got = {r["id"]: r["duplicate_group"] for r in dupes.greedy_groups(df, limit, adjacent).collect()}
        assert got == groups and number


def test_readable_sizes_round_ties_to_even(spark):
    from loomset.functions import expressions as x

    def want(n):
        for unit, form in ((1024**3, "%.1f GB"), (1024**2, "%.1f MB"), (1024, "%.0f KB")):
            if n >= unit:
                return form % (n / unit)
        return f"{n} B"

    sizes = [0, 1, 1023, 1024, 1536, 2560, 3584, 1024**2 - 1, 5 << 18, 7 << 18, (5 << 18) + 1, (1 << 30) - 1, 5 << 28, 7 << 28, 13 << 28, 9999991 * 20000, (1 << 53) + 1, (1 << 60) + 12345]
    sizes += np.random.default_rng(1).integers(0, 1 << 40, 300).tolist() + [512 * k for k in range(2, 300)] + [k << 18 for k in range(1, 60)]
    got = spark.createDataFrame([(n,) for n in [*sizes, None]], "n long").select("n", x.human_bytes(F.col("n")).alias("s")).collect()
    assert {r["n"]: r["s"] for r in got} == {n: want(n) for n in sizes} | {None: None}


def test_op9_stores_only_what_its_features_are_read_from(spark, monkeypatch):
    """No table is packed that is only unpacked again."""
    from loomset.llm import telephony

    stored, write = [], telephony._stored
    monkeypatch.setattr(telephony, "_stored", lambda df, name: stored.append(name) or write(df, name))
    rows = telephony.store_and_read(spark.createDataFrame([(1, "a" * 99), (2, None), (None, "b")], "doc_id long, text string")).collect()
    assert stored == ["audio"] and {r["doc_id"] for r in rows} == {1, 2, None}
    features = {f"{r['media_sha256']}": r["feature"] for r in rows}
    for r in telephony.pcm_table(telephony.media_table(spark.createDataFrame([(1, "a" * 99), (2, None), (None, "b")], "doc_id long, text string"))).collect():
        assert telephony.feature(telephony.unpack_pcm(bytes(r["pcm"]))[1]) == features[r["media_sha256"]]


def test_upright_faces_in_pieces(monkeypatch):
    """What a worker holds is bounded by bytes made, not by rows of a batch."""
    import pandas as pd

    from loomset.functions import kernels, quality

    made = {}
    monkeypatch.setattr(quality.F, "pandas_udf", lambda kind: lambda f: made.setdefault("f", f) and (lambda *a: None))
    quality.upright(None, None)
    monkeypatch.setattr(kernels, "PIECE_BYTES", 5 * 3 * quality.UPRIGHT_SIDE**2)
    n = 23
    batch = pd.DataFrame({"width": 4, "height": 4, "data": [bytes(range(k, k + 48)) for k in range(n)]})
    marks = pd.Series([[list(p) for p in quality.UPRIGHT]] * n)
    out = list(made["f"](iter([(batch, marks)])))
    assert sum(map(len, out)) == n and max(map(len, out)) <= 6
    assert pd.concat(out)["data"].iloc[7][:12] == bytes(range(7, 19))


def test_boxes_of_many_masks(spark):
    """Masks of several kinds and sizes in one batch, each as by itself: resampled in float32, at least a tenth."""
    from loomset.functions import quality

    rng = np.random.default_rng(4)
    rows, want = [], {}
    for n in range(80):
        k, w, h = ((8, 8, 5), (6, 13, 9), (5, 5, 5), (7, 3, 20))[n % 4]
        mask = np.where(rng.random((k, k)) < 0.06, rng.integers(20, 256, (k, k)), rng.integers(0, 25, (k, k))).astype(np.uint8)
        share = mask.astype(np.float32) / np.float32(255)
        rows.append((n, k, bytearray(mask.tobytes() if n % 3 else share.astype("<f4").tobytes()), w, h))
        x, y, a, b = quality.letterbox(w, h, k)
        plane = share[y : y + b, x : x + a]
        for n_ in (w, h):
            at = np.clip((np.arange(n_) + 0.5) * plane.shape[1] / n_ - 0.5, 0, plane.shape[1] - 1)
            low = np.minimum(at.astype(int), max(0, plane.shape[1] - 2))
            part = (at - low).astype(np.float32)
            plane = (plane[:, low] * (1 - part) + plane[:, np.minimum(low + 1, plane.shape[1] - 1)] * part).T
        ys, xs = np.nonzero(plane >= np.float32(0.1))
        want[n] = [int(xs.min()), int(ys.min()), int(xs.max()) + 1, int(ys.max()) + 1] if len(xs) else None
    rows += [(100, 8, None, 3, 3), (101, None, bytearray(b"x"), 3, 3), (102, 8, bytearray(b"x"), 3, 3), (103, 1, bytearray(b"\xff"), 0, 3)]
    df = spark.createDataFrame(rows, "n int, k int, d binary, w int, h int").coalesce(1)
    got = {r["n"]: r["b"] for r in df.select("n", quality.mask_box(F.col("k"), F.col("d"), F.col("w"), F.col("h")).alias("b")).collect()}
    assert got == want | dict.fromkeys((100, 101, 102, 103))


def test_a_crop_text_is_parsed_once(spark):
    from loomset.operators import decisions

    df = spark.createDataFrame([('{"version":1,"box":[1,2,3,4]}',)], "t string").select(decisions.decode_crop_text(F.col("t")).alias("p")).select("p.box", "p.auto_box", "p.warnings", "p.padding_px")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") <= 4 and plan.count("bround") <= 16  # at most once a field that is asked for, each box twice at most
    assert tuple(df.first()) == ([1, 2, 3, 4], [1, 2, 3, 4], [], decisions.PADDING)


def test_edits_of_a_stratum_are_no_window(spark, tmp_path, monkeypatch):
    """Whether an edited row belongs to a head is asked row by row: only the ranks of a head, which are bounded, are windows."""
    from loomset.operators import live

    plans, top = [], live.LiveRecommendation._top

    def seen(self, pool):
        plans.append(pool._jdf.queryExecution().optimizedPlan().toString())
        return top(self, pool)

    monkeypatch.setattr(live.LiveRecommendation, "_top", seen)
    rows = [(k, "analysis", 1, None, "半身", "正脸", 0, "PASS", k / 50, 1.0, 1.0, True, False) for k in range(40)]
    own = live.LiveRecommendation(spark, f"file://{tmp_path}/live", 2, 2)
    own.apply(spark.createDataFrame(rows, live.EDITS))
    own.apply(spark.createDataFrame([(5, "analysis", 2, None, *rows[5][4:8], 0.99, *rows[5][9:])], live.EDITS))
    assert len(plans) > 1 and not any("Window" in p for p in plans)
    assert {r["ord"] for r in own.chosen().collect()} == {5, 39}
