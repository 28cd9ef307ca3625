"""Cases with known numbers: decoding, gates, geometry, kernels and the recommendation on a few rows."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomset.functions import expressions as x
from loomset.functions import geometry as g
from loomset.functions import kernels
from loomset.operators import decisions, dupes, quota, refresh, regions, states, views

FINDINGS = "array<struct<code:string,source:string,value:double,threshold:double,detail:string>>"


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def boxes(*rows):
    return F.array(*[F.array(*map(F.lit, r)) for r in rows])


def photos(spark, rows):
    """rows: (ord, quality, brisque, blur, yaw class, scale, manual status, flags)"""
    own = spark.createDataFrame([(*r[:7], [(c, "s", None, None, "") for c in r[7]]) for r in rows], f"ord long, face_quality double, brisque double, blur double, angle_class string, person_scale string, manual_status string, review_flags {FINDINGS}")
    own = own.withColumns({"hard_rejects": F.array().cast(FINDINGS), "duplicate_group": F.lit(0)})
    return own.withColumn("eligibility", x.eligibility(F.col("hard_rejects"), F.col("review_flags")))


def test_crop_from_a_mask(spark):
    p = value(spark, g.crop_proposal(F.array(*map(F.lit, (20, 10, 70, 60))), F.lit(100), F.lit(80), padding=8))
    assert p.box == [12, 2, 78, 68] and p.removed > 0.40 and not p.touches_edge
    assert value(spark, g.crop_proposal(F.array(*map(F.lit, (0, 0, 100, 80))), F.lit(100), F.lit(80))) is None


def test_manual_crop_box(spark):
    p = F.struct(F.array(*map(F.lit, (12, 2, 78, 68))).alias("auto_box"), F.array(*map(F.lit, (12, 2, 78, 68))).alias("box"), F.lit("accepted").alias("decision"), F.lit(False).alias("manually_adjusted"))
    got = value(spark, decisions.edit_crop(p, F.array(*map(F.lit, (-20, 4, 95, 120))), F.lit(100), F.lit(80)))
    assert (got.box, got.decision, got.manually_adjusted) == ([0, 4, 95, 80], "pending", True)


def test_crop_of_the_first_version(spark):
    p = F.struct(F.lit(1).alias("version"), F.array(*map(F.lit, (1, 2, 30, 40))).alias("box"), F.lit(None).cast("array<int>").alias("auto_box"), F.lit("accepted").alias("decision"))
    got = value(spark, decisions.decode_crop(p, F.lit(100), F.lit(80)))
    assert (got.version, got.auto_box, got.box, got.decision, got.manually_adjusted) == (2, [1, 2, 30, 40], [1, 2, 30, 40], "accepted", False)


def test_two_people_are_split(spark):
    kind = "struct<bbox:array<int>,confidence:double>"
    found = lambda *bs: F.array(*[F.struct(F.array(*map(F.lit, b)).alias("bbox"), F.lit(0.9).alias("confidence")) for b in bs])
    got = value(spark, g.composite_proposal(found((10, 10, 110, 230), (150, 12, 250, 232)), found((35, 20, 75, 65), (175, 22, 215, 67)), F.lit(300), F.lit(260), kind))
    assert got.mode == "split_people" and len(got.boxes) == 2


def test_faces(spark):
    faces = lambda *fs: F.array(*[F.array(*[F.lit(float(v)) for v in f]) for f in fs])
    assert value(spark, g.dedupe_faces(faces((10, 10, 100, 100), (35, 35, 25, 25)))) == [[10, 10, 100, 100]]
    same = faces((50, 0, 10, 10), (0, 0, 10, 10), (25, 0, 10, 10))
    assert [f[0] for f in value(spark, g.dedupe_faces(same))] == [50, 0, 25]  # equals in the order they came in
    roi = F.array(*[F.lit(float(v)) for v in (0, 0, 80, 80)])
    assert value(spark, g.faces_in_roi(faces((10, 10, 30, 30), (200, 200, 30, 30)), roi)) == [[10, 10, 30, 30]]
    assert len(value(spark, g.dedupe_faces(g.faces_in_roi(faces((10, 10, 60, 60), (12, 12, 58, 58)), F.array(*[F.lit(float(v)) for v in (0, 0, 100, 100)]))))) == 1


def test_low_quality_profile_qualifies(spark):
    rows = photos(spark, [(1, 0.2, 10.0, 100.0, "左侧脸", "半身", None, ["low_face_quality"]), (2, 0.2, 10.0, 100.0, "正脸", "半身", None, ["low_face_quality"])])
    assert [r.q for r in rows.orderBy("ord").select((F.size(x.blockers()) == 0).alias("q")).collect()] == [True, False]


def test_recommendation_of_two(spark):
    rows = photos(spark, [(1, 0.9, 10.0, 100.0, "正脸", "半身", None, []), (2, 0.8, 10.0, 100.0, "左侧脸", "半身", None, []), (3, 0.7, 82.0, 100.0, "正脸", "半身", None, [])])
    got = {r.ord: r for r in quota.recommend(rows, 2).collect()}
    assert [got[k].auto_status for k in (1, 2, 3)] == ["推荐", "推荐", "备选"]
    assert any("BRISQUE" in reason for reason in got[3].recommendation_reasons)
    manual = rows.withColumn("manual_status", F.when(F.col("ord") == 1, "淘汰"))
    assert {r.ord: r.auto_status for r in quota.recommend(manual, 2).collect()} == {k: r.auto_status for k, r in got.items()}


def test_ignored_rows_have_no_group(spark):
    rows = [("d1", 1, 12345, False), ("d2", 2, 12345, False), ("d3", 3, 12345, True), ("d4", 4, 99, False)]
    got = dupes.greedy_groups(spark.createDataFrame(rows, "id string, pri long, phash long, duplicate_ignore boolean"), 0)
    assert dict(map(tuple, got.collect())) == {"d1": 1, "d2": 1, "d3": 0, "d4": 0}


def test_pages_and_targets():
    assert views.clamp_page(2, 250, 120) == (2, 3) and views.clamp_page(2, 121, 120) == (2, 2) and views.clamp_page(9, 100, 120) == (1, 1)
    assert states.target(60) == (60, "preset") and states.target(61) == (61, "custom") and states.target(60, "custom") == (60, "custom") and states.target(-3) == (1, "custom")


def test_views_of_the_first_format():
    old = lambda mode, **more: views.decode({"sort_mode": mode, **more})
    assert (old("BRISQUE 低 → 高").sort_field, old("BRISQUE 低 → 高").sort_direction) == ("BRISQUE", "优先顺序")
    assert (old("Face Quality 低 → 高").sort_field, old("Face Quality 低 → 高").sort_direction) == ("Face Quality", "反向")
    assert old("unknown").sort_field == "默认顺序" and old("Yaw", sort_field="Pitch").sort_field == "Pitch"
    new = lambda **d: views.decode(d)
    assert new(sort_field="BRISQUE", sort_direction="降序").sort_direction == "反向"
    assert new(sort_field="Sharpness", sort_direction="降序").sort_direction == "优先顺序"
    assert new(sort_direction="sideways").sort_direction == "优先顺序" and new().limit_n == 10 and new(limit_n=0).limit_n == 1
    assert views.decode("none") == views.ViewSpec()
    one, two = views.ViewSpec("a"), views.ViewSpec("a", best_only=True)
    assert views.upsert([one], two) == [two] and views.delete([one], "a") == []


def test_unknown_field_is_null(spark):
    rows = spark.createDataFrame([(1, "x")], "ord long, source string")
    assert views.matching(rows, {"source": "x"}).count() == 1 and views.matching(rows, {"nothing": "x"}).count() == 0


def test_suggested_text(spark):
    poly = boxes((20, 75), (140, 75), (140, 88), (20, 88))
    region = F.struct(poly.alias("poly"), F.lit(False).alias("selected"), F.lit(False).alias("manual"), F.lit(0.95).alias("score"), F.lit(False).alias("suggested"))
    rows = spark.range(1).select(F.lit("p").alias("path"), F.lit("s").alias("source"), F.lit(160).alias("width"), F.lit(100).alias("height"), F.array(region).alias("regions"))
    assert [r.suggested for r in regions.suggest(rows).collect()] == [True]


def test_enrichment_plan(spark):
    rows = [("stale", "推荐", 0, None), ("clear", "推荐", 2, None), ("pending", "推荐", 2, "pending"), ("rejected", "推荐", 2, "rejected"), ("cached", "推荐", 2, None), ("backup", "备选", 0, None)]
    own = spark.createDataFrame([(i, i, s, v, d, 2 if i == "cached" else None) for i, s, v, d in rows], "sample_id string, path string, status string, composite_scan_version int, composite_decision string, crop_version int")
    own = own.withColumns({"crop_box": F.lit(None).cast("array<int>"), "crop_state": F.lit("no_candidate")})
    got = sorted((r.stage, r.sample_id) for r in decisions.enrichment_plan(own).collect())
    assert got == [("auto_crop", "clear"), ("auto_crop", "rejected"), ("composite", "stale")]


def test_patch_aborts_on_a_bad_value(spark):
    rows = spark.createDataFrame([("a", "h")], "sample_id string, content_sha256 string")
    read = lambda **s: refresh.read_patch(spark, json.dumps({"schema_version": 1, "bundle_id": "b", "suggestions": [{"sample_id": "a", **s}]}))
    head, good = read(suggested_status="推荐", flags=["x"])
    refresh.check_patch(good, head, rows)
    for bad in ({"suggested_status": "?"}, {"suggested_eligibility": "MAYBE"}, {"flags": "x"}, {"note": 3}, {"request_full_resolution": "yes"}):
        head, patch = read(**bad)
        with pytest.raises(ValueError):
            refresh.check_patch(patch, head, rows)
        refresh.check_patch(read(content_sha256="other", **bad)[1], head, rows)  # stale rows are not looked at
    for text in ("[]", '{"suggestions": 3}', '{"suggestions": [{}]}'):
        with pytest.raises(ValueError):
            refresh.read_patch(spark, text)


def test_settings(tmp_path):
    assert states.settings({"inference_device": "GPU", "theme": "pink", "background_enrichment": 0}) == {"version": 1, "inference_device": "gpu", "theme": "system", "background_enrichment": False}
    assert states.load_settings(str(tmp_path / "none")) == states.settings(None)
    (tmp_path / "s").write_text("{bad")
    assert states.load_settings(str(tmp_path / "s")) == states.settings({})


def test_archive_keeps_the_place(tmp_path):
    for k in range(2):
        (tmp_path / "a").mkdir(exist_ok=True)
        (tmp_path / "a" / "x.png").write_text(str(k))
        assert states.archive(str(tmp_path), str(tmp_path / "a" / "x.png"), "done") == str(tmp_path / "done" / "a" / ("x.png" if not k else "x_1.png"))


def test_proposals(spark):
    box = [[1, 2, 3, 4]]
    decoded = lambda d: value(spark, states.decode_proposal(F.lit(json.dumps(d) if d is not None else None)))
    got = decoded({"output_boxes": box, "baseline_boxes": [], "person_detections": [{"bbox": [0, 0, 5, 5]}]})
    assert (got.version, got.output_boxes, got.baseline_boxes, got.decision, got.person_detections[0].kind) == (2, box, box, "pending", "person")
    assert decoded(None) is None and decoded([1]) is None and decoded({"output_boxes": [["a"]]}) is None


# -- kernels


def test_phash_of_simple_planes():
    """By the definition of the DCT, term by term; a plane and its brighter copy have one hash."""
    rng = np.random.default_rng(3)
    plane = rng.integers(0, 200, (32, 32)).astype(np.uint8)
    low = [[sum(float(plane[i, j]) * math.cos(math.pi * (2 * i + 1) * u / 64) * math.cos(math.pi * (2 * j + 1) * v / 64) for i in range(32) for j in range(32)) * (math.sqrt(1 / 32) if u == 0 else math.sqrt(2 / 32)) * (math.sqrt(1 / 32) if v == 0 else math.sqrt(2 / 32)) for v in range(8)] for u in range(8)]
    weight = [2 * math.sqrt(32)] + [8.0] * 7
    flat = [low[u][v] * weight[u] * weight[v] for u in range(8) for v in range(8)]
    middle = sorted(flat)[31:33]
    bits = "".join("1" if f > sum(middle) / 2 else "0" for f in flat)
    assert kernels.phash(plane) & (2**64 - 1) == int(bits, 2)
    assert kernels.phash(plane) == kernels.phash((plane + 50).astype(np.uint8))


def test_pixel_kernels():
    flat = np.full((10, 12), 10, np.uint8)
    assert kernels.exposure(flat) == (10.0, 1.0, 0.0) and kernels.sharpness(flat) == 0.0
    spot = flat.copy()
    spot[4, 5] = 250
    lap = np.zeros((10, 12))
    lap[4, 5], lap[3, 5], lap[5, 5], lap[4, 4], lap[4, 6] = -960, 240, 240, 240, 240
    assert kernels.sharpness(spot) == pytest.approx(lap.var())
    assert kernels.gray(np.array([[[255, 255, 255], [0, 0, 0], [255, 0, 0]]], np.uint8)).tolist() == [[255, 0, 76]]
    assert (kernels.resized(flat, 5, 7) == 10).all() and kernels.resized(flat, 5, 7).shape == (7, 5)


def test_head_region(spark):
    points = [(0.5, 0.2, 1.0), (0.6, 0.2, 1.0)] + [(2.0, 0.0, 1.0)] * 9 + [(0.4, 0.5, 0.3), (0.7, 0.5, 0.3)]
    rows = spark.createDataFrame([(1, points), (2, points[:1]), (3, None), (4, [(x, y, None) for x, y, _ in points])], "k int, p array<struct<x:double,y:double,visibility:double>>")
    got = {r["k"]: r["r"] for r in rows.select("k", g.head_roi(F.col("p"), F.lit(1000), F.lit(1000)).alias("r")).collect()}
    assert got[1] == pytest.approx([550 - 135, 200 - 0.55 * 315, 550 + 135, 200 + 0.45 * 315]) and got[4] == got[1]
    assert got[2] is None and got[3] is None


def test_consolidated_faces(spark):
    """Faces with a confidence at their end: in the region, once, and then the most probable large one."""
    face = lambda x, y, w, h, c: [float(v) for v in (x, y, w, h, *[0] * 10, c)]
    faces = [face(150, 100, 40, 40, 0.9), face(152, 102, 38, 38, 0.8), face(400, 400, 90, 90, 0.99), face(210, 150, 60, 60, 0.2)]
    rows = spark.createDataFrame([(1, faces, [100.0, 50.0, 300.0, 250.0]), (2, faces, None), (3, faces[:1], [0.0, 0.0, 10.0, 10.0]), (4, [[f[0], f[1], f[2], f[3]] for f in faces], [100.0, 50.0, 300.0, 250.0])], "k int, f array<array<double>>, r array<double>")
    got = {r["k"]: [f[:2] for f in r["c"]] for r in rows.select("k", g.consolidated(F.col("f"), F.col("r")).alias("c")).collect()}
    assert got == {1: [[150, 100]], 2: [[400, 400], [210, 150], [150, 100]], 3: [], 4: [[210, 150]]}


def test_detections():
    labels = ["person", "head"]
    rows = np.array([[10, 10, 50, 50, 0.9, 0], [12, 12, 50, 50, 0.8, 0], [100, 100, 160, 160, 0.7, 1], [0, 0, 9, 9, 0.2, 0]], float)
    want = [((20, 10, 100, 50), "person", 0.9), ((200, 100, 320, 160), "head", 0.7)]
    assert kernels.decode_detections(rows, labels, 0.3, 0.5, (640, 320), (320, 320)) == want
    columns = np.array([[30, 30, 40, 40, 0.9, 0.0], [31, 31, 38, 38, 0.8, 0.0], [130, 130, 60, 60, 0.0, 0.7], [5, 5, 9, 9, 0.2, 0.0]], float).T
    columns = np.concatenate([columns, np.zeros((6, 1))], 1)
    assert kernels.decode_detections(columns, labels, 0.3, 0.5, (640, 320), (320, 320)) == want
    assert kernels.decode_detections(columns * 0, labels, 0.3, 0.5, (640, 320), (320, 320)) == []
    with pytest.raises(ValueError):
        kernels.decode_detections(np.zeros((3, 3)), labels, 0.3, 0.5, (1, 1), (1, 1))


def test_metrics_column(spark):
    rng = np.random.default_rng(1)
    image = rng.integers(0, 256, (16, 24, 3)).astype(np.uint8)
    rows = spark.createDataFrame([(24, 16, bytearray(image.tobytes())), (24, 16, bytearray(b"x")), (None, None, None)], "width int, height int, data binary")
    got = rows.select(kernels.metrics(F.struct("width", "height", "data")).alias("m")).select("m.*").collect()
    plane = kernels.gray(image)
    assert tuple(got[0]) == (kernels.phash(plane), *kernels.exposure(plane), kernels.sharpness(plane))
    assert tuple(got[1]) == tuple(got[2]) == (None,) * 5
