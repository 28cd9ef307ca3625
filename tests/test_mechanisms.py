"""Scans, enrichment, cancelling, events and the other mechanisms around the plans."""

import json
import logging
import os
import threading
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from loomset.functions import geometry
from loomset.operators import regions, states
from loomset.sources import images
from loomset.streaming import enrichment, snapshots


@pytest.fixture
def folder(tmp_path):
    root = tmp_path / "set"
    for name, data in (("B.jpg", b"one"), ("a/c.PNG", b"two"), ("a/note.txt", b"no"), ("Gone/d.jpg", b"one"), ("a/e.webp", b"e"), ("a/none.gif", b"")):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(data)
        os.utime(root / name, (1_700_000_000, 1_700_000_000))
    return root


def test_scan_and_hashes(spark, folder):
    found = images.scan(spark, str(folder), images.exclusion_set([["gone"], ["GONE", "Other"]]))
    names = [r["path"].removeprefix(f"{folder}/") for r in found.collect()]
    assert names == ["a/c.PNG", "a/e.webp", "B.jpg"]  # the order of paths, whatever their case
    row = {r["path"].rpartition("/")[2]: r for r in images.hashed(spark, str(folder), found).collect()}
    assert row["B.jpg"]["content_sha256"] == "7692c3ad3540bb803c020b3aee66cd8887123234ea0c6e7143c0add73ff431ed"
    assert row["c.PNG"]["file_size"] == 3 and row["c.PNG"]["mtime_ns"] == 1_700_000_000 * 10**9 and row["e.webp"]["file_size"] == 1
    assert images.scan(spark, str(folder)).count() == 4
    assert images.exclusion_set([["gone"], ["GONE", "Other"]]) == ["gone", "Other"]


def test_snapshots_of_readable_versions(spark, tmp_path):
    schema = "path_key string, version int, analysis_version int"
    table = snapshots.Snapshots(spark, f"file://{tmp_path}/s", schema, "path_key", 4)
    assert images.load_snapshot(table).collect() == []
    table.replace(spark.createDataFrame([("/a", 3, 4), ("/b", 2, 4), ("/c", 9, 4), ("/d", 3, 3)], schema))
    assert [r["path_key"] for r in images.load_snapshot(table).collect()] == ["/a"]
    assert sorted(r["path_key"] for r in images.load_snapshot(table, current_only=False).collect()) == ["/a", "/b", "/d"]
    for path in tmp_path.rglob("*.parquet"):
        path.write_bytes(b"broken")
    for path in tmp_path.rglob("*.crc"):
        path.unlink()
    assert images.load_snapshot(table).collect() == []  # what can't be read is empty


# -- enrichment


def load_model():
    """A model that is slow to load and fails on some images."""

    def detect(content):
        if content == b"bad":
            raise ValueError("cannot decode")
        return {"size": len(content)}

    return enrichment.guarded(detect, ["size"])


def test_enrich_with_failures(spark):
    rows = spark.createDataFrame([("a", bytearray(b"xy")), ("b", bytearray(b"bad")), ("c", bytearray(b""))], "sample_id string, content binary")
    got = {r["sample_id"]: (r["size"], r["error"]) for r in enrichment.enrich(rows, load_model, "sample_id string, size double, error string").collect()}
    assert got["a"] == (2, None) and got["c"] == (0, None)
    assert got["b"][1] == "ValueError: cannot decode" and (got["b"][0] is None or pd.isna(got["b"][0]))
    assert enrichment.enrich(rows.limit(0), load_model, "sample_id string, size double, error string").collect() == []


def test_two_stages(spark):
    plan = spark.createDataFrame([("composite", "a"), ("composite", "b"), ("composite", "c"), ("auto_crop", "d"), ("auto_crop", "b")], "stage string, sample_id string")
    composite = lambda jobs: jobs.select("sample_id", (F.col("sample_id") == "a").alias("found"), F.when(F.col("sample_id") == "c", "failed").alias("error"))
    crop = lambda jobs: jobs.select("sample_id", F.lit(True).alias("found"), F.lit(None).cast("string").alias("error"))
    rows = sorted((r["stage"], r["sample_id"]) for r in enrichment.staged(plan, composite, crop).collect())
    assert rows == [("auto_crop", "b"), ("auto_crop", "d"), ("composite", "a"), ("composite", "b"), ("composite", "c")]


def test_scan_batches(spark):
    todo = spark.createDataFrame([("a",), ("b",)], "sample_id string")
    found = spark.createDataFrame([("a", 2)], "sample_id string, n_boxes int")
    assert sorted(map(tuple, enrichment.scan_batch(todo, found).collect())) == [("a", "pending", 2), ("b", None, None)]
    assert sorted(map(tuple, enrichment.scan_batch(todo, found, manual=True).collect())) == [("a", "pending", 2), ("b", "pending", 0)]


def test_cancelling_a_running_job(spark):
    """A job under way ends when it is cancelled, others go on, and what checks finds out."""
    cancel = states.Cancel(spark, "scan")

    def slow(frames):
        for f in frames:
            time.sleep(60)
            yield f

    cancel.check()
    seen = []

    def work():
        with cancel:
            try:
                spark.range(4).mapInPandas(slow, "id long").collect()
            except Exception as e:  # noqa: BLE001
                seen.append(e)

    t = threading.Thread(target=work)
    began = time.time()
    t.start()
    while not spark.sparkContext.statusTracker().getActiveJobsIds() and time.time() - began < 30:
        time.sleep(0.1)
    time.sleep(1)
    cancel.cancel()
    t.join(40)
    assert not t.is_alive() and len(seen) == 1 and time.time() - began < 55
    with pytest.raises(InterruptedError, match="scan"):
        cancel.check()
    assert spark.range(3).count() == 3


def test_events_and_features(caplog):
    with caplog.at_level(logging.INFO, "loomset"):
        states.Events()("scan_done", count=3, name="目录")
    said = json.loads(caplog.records[0].getMessage())
    assert said["event"] == "scan_done" and said["count"] == 3 and said["name"] == "目录" and said["time"].endswith("+00:00")
    assert states.available({}, "scan") and not states.available({"crop": lambda: False}, "crop") and states.available({"crop": lambda: True}, "crop")


def test_primary_face(spark):
    df = spark.createDataFrame([(1, [(0.2, 0.5), (0.1, 1.0), (0.3, 0.0)]), (2, [])], "k int, f array<struct<area:double,confidence:double>>")
    got = {r["k"]: r["p"] for r in df.select("k", geometry.primary_face(F.col("f")).alias("p")).collect()}
    assert got == {1: 0, 2: None}  # the first of equals; the confidence counts as a hundredth at least


def test_zipped_regions(spark):
    df = spark.createDataFrame([([[[0, 0], [1, 1]], [[2, 2]], [[3, 3]]], [True, False], [True], [0.5], [False])], "b array<array<array<int>>>, s array<boolean>, m array<boolean>, c array<double>, g array<boolean>")
    rows = df.select(regions.zipped(*[F.col(c) for c in "bsmcg"]).alias("r")).first()["r"]
    assert [(r["selected"], r["manual"], r["score"], r["suggested"]) for r in rows] == [(True, True, 0.5, False), (False, False, 1.0, False), (False, False, 1.0, False)]
