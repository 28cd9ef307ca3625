"""Outputs in two phases and moves, failing between any two steps; snapshots that a stream is merged into."""

import os
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from loomset.operators import outputs
from loomset.streaming import snapshots


def tree(folder):
    """Every file with what is in it, and every folder."""
    root = Path(folder)
    return {str(p.relative_to(root)): p.read_bytes() if p.is_file() else None for p in root.rglob("*") if not p.name.endswith(".crc")} if root.exists() else None


class Fault:
    """Raises before one step of one file."""

    def __init__(self, step, relative):
        self.at = (step, relative)

    def __call__(self, step, relative):
        if (step, relative) == self.at:
            raise OSError(f"fault before {step} of {relative}")


FILES = [("a.txt", b"new a"), ("sub/b.txt", b"new b"), ("sub/deep/c.txt", b"new c"), ("d.txt", None)]
STEPS = [("mark", m) for m in ("begun", "staged", "ended")] + [(s, r) for s in ("stage", "place") for r, d in FILES if d] + [("backup", "a.txt")]


def rows_of(spark, files=FILES, parts=2):
    return spark.createDataFrame([(r, bytearray(d) if d is not None else None) for r, d in files], "relative string, data binary").repartition(parts, "relative")


def output_with(folder):
    folder.mkdir()
    (folder / "a.txt").write_bytes(b"old a")
    (folder / "other.txt").write_bytes(b"stays")
    return folder


def test_write_all(spark, tmp_path):
    out = output_with(tmp_path / "out")
    assert outputs.write_all(rows_of(spark), str(out), str(tmp_path / "source")) == 3
    assert tree(out) == {"a.txt": b"new a", "sub": None, "sub/b.txt": b"new b", "sub/deep": None, "sub/deep/c.txt": b"new c", "other.txt": b"stays"}
    assert outputs.write_all(rows_of(spark).limit(0), str(out)) == 0


@pytest.mark.parametrize("step,relative", STEPS)
def test_a_fault_leaves_the_output_as_it_was(spark, tmp_path, step, relative):
    out = output_with(tmp_path / "out")
    before = tree(out)
    with pytest.raises(Exception, match="fault before"):
        outputs.write_all(rows_of(spark), str(out), before=Fault(step, relative))
    assert tree(out) == before
    with pytest.raises(Exception, match="fault before"):
        outputs.write_all(rows_of(spark), str(tmp_path / "none"), before=Fault(step, "a.txt" if step == "backup" else relative) if step != "backup" else Fault("place", "a.txt"))
    assert tree(tmp_path / "none") is None


@pytest.mark.parametrize("step,relative", [s for s in STEPS if s != ("mark", "begun")])
def test_a_crash_is_recovered_from(spark, tmp_path, monkeypatch, step, relative):
    """The driver dies with the fault, so that nobody undoes anything; the next one recovers."""
    out = output_with(tmp_path / "out")
    before = tree(out)
    with monkeypatch.context() as m:
        m.setattr(outputs.Run, "undo", lambda self: None)
        with pytest.raises(Exception, match="fault before"):
            outputs.write_all(rows_of(spark), str(out), before=Fault(step, relative))
    assert tree(out) != before
    assert outputs.recover(spark, str(out)) == 1 and tree(out) == before
    assert outputs.recover(spark, str(out)) == 0 and outputs.recover(spark, str(tmp_path / "nothing")) == 0


def test_a_crash_after_the_end_is_only_cleared(spark, tmp_path, monkeypatch):
    out = output_with(tmp_path / "out")
    with monkeypatch.context() as m:
        m.setattr(outputs.Run, "_clear", lambda self: None)
        assert outputs.write_all(rows_of(spark), str(out)) == 3
    assert outputs.recover(spark, str(out)) == 1
    assert tree(out)["a.txt"] == b"new a" and not [n for n in os.listdir(out) if n.startswith(outputs.RUN)]


def test_a_lost_task_is_tried_again(spark, tmp_path):
    """Placing twice, as a second attempt does, changes nothing."""
    out = output_with(tmp_path / "out")
    run = outputs.Run(spark, str(out))
    run.begin()
    run._stage(rows_of(spark).where("data is not null"), lambda system, staged, data: (outputs._write(system, staged, bytes(data)), (None, len(data), ""))[1], "data")
    run._mark("staged")
    assert run.place() == 3 and run.place() == 3
    run.undo()
    assert tree(out) == {"a.txt": b"old a", "other.txt": b"stays"}


def test_outputs_that_are_refused(spark, tmp_path):
    source = tmp_path / "source"
    source.mkdir()
    for bad in (source, source / "below", source / "x" / ".." / "y"):
        with pytest.raises(ValueError, match="outside the source"):
            outputs.write_all(rows_of(spark), str(bad), str(source))
    assert tree(source) == {}
    assert not outputs.inside(str(tmp_path / "source2"), str(source))
    for name in ("../up.txt", "/abs.txt", "", ".run-x/y"):
        with pytest.raises(ValueError, match="not a place"):
            outputs.write_all(rows_of(spark, [(name, b"x")]), str(tmp_path / "out"))
    with pytest.raises(ValueError, match="more than one"):
        outputs.write_all(rows_of(spark, [("a", b"1"), ("a", b"2")]), str(tmp_path / "out"))
    assert tree(tmp_path / "out") is None


@pytest.mark.parametrize("ask", [1, 2])
def test_cancelling(spark, tmp_path, ask):
    out, asked = output_with(tmp_path / "out"), []
    before = tree(out)

    def cancelled():
        asked.append(1)
        if len(asked) == ask:
            raise InterruptedError

    with pytest.raises(InterruptedError):
        outputs.write_all(rows_of(spark), str(out), cancelled=cancelled)
    assert tree(out) == before


# -- moves

MOVES = [("a.jpg", "keep/a.jpg"), ("x/b.jpg", "x/c.jpg"), ("x/c.jpg", "x/b.jpg")]
MOVE_STEPS = [("mark", m) for m in ("begun", "staged", "ended")] + [(s, r) for s in ("stage", "place") for _, r in MOVES]


def moved_from(folder):
    (folder / "x").mkdir(parents=True)
    for name in ("a.jpg", "x/b.jpg", "x/c.jpg", "stay.jpg"):
        (folder / name).write_bytes(name.encode())
    return folder


def moves_of(spark, root, moves=MOVES):
    return spark.createDataFrame([(f"{root}/{s}", d) for s, d in moves], "source string, relative string").repartition(2)


def test_moves_with_two_files_that_change_places(spark, tmp_path):
    root = moved_from(tmp_path / "r")
    assert outputs.move_all(moves_of(spark, root), str(root)) == 3
    assert tree(root) == {"keep": None, "keep/a.jpg": b"a.jpg", "x": None, "x/c.jpg": b"x/b.jpg", "x/b.jpg": b"x/c.jpg", "stay.jpg": b"stay.jpg"}


@pytest.mark.parametrize("step,relative", MOVE_STEPS)
@pytest.mark.parametrize("crash", [False, True])
def test_a_fault_in_moves(spark, tmp_path, monkeypatch, step, relative, crash):
    root = moved_from(tmp_path / "r")
    before = tree(root)
    with monkeypatch.context() as m:
        if crash:
            m.setattr(outputs.Run, "undo", lambda self: None)
        with pytest.raises(Exception, match="fault before"):
            outputs.move_all(moves_of(spark, root), str(root), before=Fault(step, relative))
    if crash:
        assert outputs.recover(spark, str(root)) == 1
    assert tree(root) == before


@pytest.mark.parametrize("moves,error", [([("a.jpg", "stay.jpg"), ("x/b.jpg", "n/b.jpg")], "FileExistsError"), ([("x/b.jpg", "n/b.jpg"), ("gone.jpg", "n/g.jpg")], "FileNotFoundError")])
def test_moves_that_cannot_be(spark, tmp_path, moves, error):
    root = moved_from(tmp_path / "r")
    before = tree(root)
    with pytest.raises(Exception, match=error):
        outputs.move_all(moves_of(spark, root, moves), str(root))
    assert tree(root) == before


# -- snapshots


@pytest.fixture
def table(spark, tmp_path):
    return snapshots.Snapshots(spark, f"file://{tmp_path}/table", "k long, v string, at long", "k", buckets=8, files=2)


def batch(spark, *rows):
    return spark.createDataFrame(list(rows), "k long, v string, at long")


def held(table, number=None):
    return sorted(tuple(r) for r in table.read(number).collect())


def test_versions(spark, table):
    merge = snapshots.newest_by_key("k", "at")
    assert held(table) == [] and table.current()["number"] == 0
    assert table.merge(batch(spark, (1, "a", 1), (2, "b", 1), (2, "c", 0)), merge) == 1
    assert table.merge(batch(spark, (2, "d", 5), (3, "e", 5)), merge) == 2
    assert held(table) == [(1, "a", 1), (2, "d", 5), (3, "e", 5)] and held(table, 1) == [(1, "a", 1), (2, "b", 1)]
    one = table.read().where("k = 1").select(F.input_file_name()).first()[0]
    assert "0000000001-" in one  # a bucket that no later batch has touched is not written again
    assert table.merge(batch(spark), merge) == 3 and held(table) == held(table, 2)
    assert table.replace(batch(spark, (9, "z", 9))) == 4 and held(table) == [(9, "z", 9)]
    assert table.expire(1) > 0 and held(table) == [(9, "z", 9)]
    with pytest.raises(LookupError):
        table.read(2)


@pytest.mark.parametrize("when", ["before", "after"])
def test_a_batch_that_comes_again(spark, table, monkeypatch, when):
    """A stream dies before or after the switch, and delivers the batch again."""
    count = lambda old, new: old.unionByName(new)  # noqa: E731  not idempotent by itself
    table.merge(batch(spark, (1, "a", 1)), count, "s", 0)

    def die():
        raise KeyboardInterrupt

    if when == "before":
        with pytest.raises(KeyboardInterrupt):
            table.merge(batch(spark, (2, "b", 1)), count, "s", 1, before_switch=die)
        assert held(table) == [(1, "a", 1)]
    else:
        table.merge(batch(spark, (2, "b", 1)), count, "s", 1)
    again = snapshots.Snapshots(spark, table.path, table.schema, "k")  # a new process, whose own number of buckets is not asked
    again.merge(batch(spark, (2, "b", 1)), count, "s", 1)
    again.merge(batch(spark, (1, "a", 1)), count, "s", 0)
    again.merge(batch(spark, (5, "x", 1)), count, "other", 0)
    assert held(again) == [(1, "a", 1), (2, "b", 1), (5, "x", 1)] and again.buckets == 8


def test_two_writers_of_a_version(spark, table):
    merge = snapshots.newest_by_key("k", "at")

    def other():
        snapshots.Snapshots(spark, table.path, table.schema, "k", 8).merge(batch(spark, (7, "o", 1)), merge)

    with pytest.raises(RuntimeError, match="another writer"):
        table.merge(batch(spark, (1, "a", 1)), merge, before_switch=other)
    assert held(table) == [(7, "o", 1)]


def test_a_log_file_that_is_broken(spark, table):
    table.merge(batch(spark, (1, "a", 1)), snapshots.newest_by_key("k", "at"))
    Path(table.path.removeprefix("file://"), "log", "0000000002.json").write_text('{"of": 8, "pla')
    assert held(table) == [(1, "a", 1)] and table.current()["number"] == 1


def test_a_stream_of_files_with_failures(spark, tmp_path, monkeypatch):
    """New, changed and touched files through a real stream that dies before and after a switch and starts again."""
    images, where = tmp_path / "images", f"file://{tmp_path}/snapshot"
    images.mkdir()
    table = snapshots.Snapshots(spark, where, snapshots.FILES, "path_key", 4)
    deaths = {}

    def run(die_at=None):
        real = table._put

        def put(entry, rows, touched, stream, epoch, before_switch):
            if die_at == "before":
                raise RuntimeError("dies before the switch")
            number = real(entry, rows, touched, stream, epoch, before_switch)
            if die_at == "after":
                raise RuntimeError("dies after the switch")
            return number

        with monkeypatch.context() as m:
            m.setattr(table, "_put", put)
            query = snapshots.keep_refreshed(spark, str(images), table, f"{tmp_path}/checkpoint")
            try:
                query.processAllAvailable()
            except Exception as e:  # noqa: BLE001
                deaths[die_at] = str(e)
            finally:
                query.stop()

    def write(name, data, time):
        (images / name).write_bytes(data)
        os.utime(images / name, (time, time))

    write("a.jpg", b"one", 1_700_000_000)
    write("note.txt", b"no image", 1_700_000_000)
    run()
    first = {r["path_key"].rpartition("/")[2]: r for r in table.read().collect()}
    assert set(first) == {"a.jpg"} and first["a.jpg"]["change"] == "added"
    write("B.png", b"two", 1_700_000_001)
    run("before")
    assert {r["path_key"] for r in table.read().collect()} == {first["a.jpg"]["path_key"]}
    run("after")
    assert len(deaths) == 2
    run()
    rows = table.read().collect()
    assert sorted(r["path_key"].rpartition("/")[2] for r in rows) == ["a.jpg", "b.png"]
    assert len({r["sample_id"] for r in rows}) == 2
    assert table.current()["number"] == 2  # the batch went in once


def test_refreshed_by_path(spark):
    old = spark.createDataFrame([("/a", "/a", 1, 1, "s1", "id1", "推荐", "added"), ("/b", "/b", 1, 1, "s2", "id2", None, "added"), ("/c", "/c", 1, 1, "s3", "id3", "备选", "added")], snapshots.FILES)
    new = spark.createDataFrame([("/A", 1, 1, "s1"), ("/b", 9, 2, "s2"), ("/c", 5, 5, "s9"), ("/c", 5, 4, "s8"), ("/d", 1, 1, "s1")], "path string, file_size long, mtime_ns long, content_sha256 string")
    rows = {r["path_key"]: r for r in snapshots.refreshed(old, new).collect()}
    assert {k: r["change"] for k, r in rows.items()} == {"/a": "added", "/b": "touched", "/c": "modified", "/d": "added"}
    assert rows["/a"]["sample_id"] == "id1" and rows["/a"]["path"] == "/a" and rows["/b"]["sample_id"] == "id2" and rows["/b"]["mtime_ns"] == 2
    assert rows["/c"]["content_sha256"] == "s9" and rows["/c"]["manual_status"] is None and rows["/c"]["sample_id"] != "id3"
