"""Archives that the standard library reads again, of any sizes; the parts of a review bundle; small stored states."""

import csv
import io
import json
import random
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from loomset.operators import archive, decisions, manifest, states
from loomset.plans import catalogue

SF = "/root/testdata/sf0.001"


def table(spark, pieces):
    return spark.createDataFrame([(n, a, None if d is None else bytearray(d)) for n, a, d in pieces], "name string, at long, data binary")


@pytest.mark.parametrize("sizes", [(0, 0), (1, 1), (5, 0), (3, 1000), (70_000, 131_071)])
def test_joined_checksums(sizes):
    rng = random.Random(sizes[0])
    a, b = (rng.randbytes(n) for n in sizes)
    assert archive.joined_crc(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


@pytest.mark.parametrize("short", [archive.SHORT, 40])
def test_archives(spark, tmp_path, short):
    rng = random.Random(1)
    pieces = [("b/多.txt", k, bytes(rng.choices(b"abc ", k=3000))) for k in range(25)] + [("a.bin", -5, rng.randbytes(200_000)), ("a.bin", 7, b"end"), ("empty", 0, None), ("z", 0, b"")]
    want: dict = {}
    for name, _, data in sorted(pieces, key=lambda p: p[:2]):
        want[name] = want.get(name, b"") + (data or b"")
    rng.shuffle(pieces)
    path = tmp_path / "out.zip"
    path.write_bytes(b"old")
    assert archive.write_zip(table(spark, pieces).repartition(5), str(path), short) == 4
    with zipfile.ZipFile(path) as z:
        assert z.testzip() is None and z.namelist() == sorted(want)
        assert {n: z.read(n) for n in z.namelist()} == want
        assert all(i.file_size == len(want[i.filename]) and i.CRC == zlib.crc32(want[i.filename]) for i in z.infolist())
    assert sorted(p.name for p in tmp_path.iterdir()) == ["out.zip"] or all(p.suffix == ".crc" for p in tmp_path.iterdir() if p.name != "out.zip")


def test_an_archive_of_nothing(spark, tmp_path):
    assert archive.write_zip(table(spark, [("a", 0, b"")]).limit(0), str(tmp_path / "e.zip")) == 0
    with zipfile.ZipFile(tmp_path / "e.zip") as z:
        assert z.namelist() == []


def test_archives_that_cannot_be(spark, tmp_path):
    for pieces in ([("a", 0, b"x"), ("a", 0, b"y")], [("", 0, b"x")], [(None, 0, b"x")]):
        with pytest.raises(ValueError, match="no name"):
            archive.write_zip(table(spark, pieces), str(tmp_path / "x.zip"))
    assert list(tmp_path.iterdir()) == []


def test_bundle(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(manifest, "PIECE_ROWS", 30)
    rows = catalogue._rows(spark, SF).withColumns({"duplicate_ignore": F.lit(False), "recommendation_reasons": F.array(F.lit('a "b", c'))})
    originals = spark.createDataFrame([("img__1.jpg", bytearray(b"pixels"))], "name string, data binary")
    n = manifest.write_bundle(rows, str(tmp_path / "b.zip"), "bundle_1", views=[{"name": "v"}], description="all", originals=originals)
    held = sorted(rows.collect(), key=lambda r: r["ord"])
    with zipfile.ZipFile(tmp_path / "b.zip") as z:
        names = z.namelist()
        assert z.testzip() is None and len(names) == n
        assert {"bundle.json", "manifest.json", "manifest.csv", "summary.json", "views.json", "originals/img__1.jpg", "contact_sheets/page_0001.json"} <= set(names)
        assert json.loads(z.read("bundle.json"))["sample_count"] == len(held)
        samples = json.loads(z.read("manifest.json"))
        assert samples["bundle_id"] == "bundle_1" and [s["sample_id"] for s in samples["samples"]] == [r["sample_id"] for r in held]
        assert samples["samples"][3]["analysis"]["yaw"] == held[3]["yaw"] and "manual_status" in samples["samples"][0]["selection"]
        text = z.read("manifest.csv").decode("utf-8-sig")
        lines = list(csv.DictReader(io.StringIO(text)))
        assert tuple(lines[0]) == manifest.FLAT and [r["sample_id"] for r in lines] == [r["sample_id"] for r in held]
        assert all(r["recommendation_reasons"] == 'a "b", c' for r in lines)
        sheets = [json.loads(z.read(x)) for x in names if x.startswith("contact_sheets/")]
        assert [s["sample_id"] for sheet in sheets for s in sheet["samples"]] == [r["sample_id"] for r in held] and all(len(s["samples"]) <= 16 for s in sheets)
        assert json.loads(z.read("summary.json"))["totals"]["total"] == len(held) and json.loads(z.read("views.json")) == {"saved": [{"name": "v"}]}
        assert z.read("originals/img__1.jpg") == b"pixels"


def test_last_bundles(spark):
    df = spark.createDataFrame([([f"b{k}" for k in range(n)],) for n in (0, 3, 99, 100)], "ids array<string>")
    got = [r[0] for r in df.select(decisions.exported_bundles(F.col("ids"), F.lit("new"))).collect()]
    assert [len(g) for g in got] == [1, 4, 100, 100] and all(g[-1] == "new" for g in got) and got[3][0] == "b1"


def test_text_states(spark, tmp_path):
    path, schema = f"file://{tmp_path}/state", "path string, n int"
    assert states.text_states(spark, path, "/Folder", schema).collect() == []
    states.save_text_state(spark.createDataFrame([("/A.jpg", 1), ("/b.jpg", 2)], schema), "/Folder", path, min_height=8)
    assert sorted((r["path_key"], r["n"]) for r in states.text_states(spark, path, "/FOLDER", schema).collect()) == [("/a.jpg", 1), ("/b.jpg", 2)]
    assert states.text_states(spark, path, "/other", schema).collect() == []
    states.save_text_state(spark.createDataFrame([("/c.jpg", 3)], schema), "/Folder", path)
    assert [r["n"] for r in states.text_states(spark, path, "/Folder", schema).collect()] == [3]


def test_boxes_from_anything(spark):
    cases = [(["1", "2", "10.5", "9"], [1, 2, 10, 9]), (["1", "2", "11.5", "9"], [1, 2, 12, 9]), (["1", "2", "1", "9"], None), (["1", "2", "x", "9"], None), (["1", "2", "3"], None), (None, None), (["1", None, "3", "4"], None)]
    df = spark.createDataFrame([(k, v) for k, (v, _) in enumerate(cases)], "k int, v array<string>")
    got = {r["k"]: r["b"] for r in df.select("k", decisions.parse_box(F.col("v")).alias("b")).collect()}
    assert [got[k] for k in range(len(cases))] == [want for _, want in cases]
