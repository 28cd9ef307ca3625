"""Files written or moved all or none, by the executors: K3 and K13 (outputs in two phases), G5 and G6 (moves).

A run has a folder beside what it changes, with a manifest of its files. First every file is brought into the run's folder,
under a name that no other attempt of a task uses: only those of attempts that ended well are in the manifest. Then each is
brought to its place; what was there before goes into the run's folder first. Until the mark of the end is written the run
can be undone, from the manifest and from where the files are; after it only the run's folder is left to clear. So a
failure, a cancelled run, and a driver or executor that is lost leave the folder as it was, or finished: recover() sees to it.

Folders are URIs or paths that driver and executors share (pyarrow.fs)."""

from __future__ import annotations

import hashlib
import json
import posixpath
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "relative string, staged string, origin string, size long, sha256 string, depth int"
RUN = ".run-"
Step = Callable[[str, str], None]


def _quiet(step: str, relative: str) -> None:
    """What is called before each step; tests and observers put their own in."""


def _system(uri: str) -> tuple[pafs.FileSystem, str]:
    system, path = pafs.FileSystem.from_uri(uri if ":" in uri else f"file://{uri}")
    return system, path.rstrip("/")


def _there(system: pafs.FileSystem, path: str) -> bool:
    return system.get_file_info(path).type != pafs.FileType.NotFound


def _put(system: pafs.FileSystem, source: str, target: str) -> None:
    system.create_dir(posixpath.dirname(target), recursive=True)
    system.move(source, target)


def _write(system: pafs.FileSystem, path: str, data: bytes) -> None:
    system.create_dir(posixpath.dirname(path), recursive=True)
    with system.open_output_stream(path) as out:
        out.write(data)


def _depth(system: pafs.FileSystem, root: str, relative: str) -> int:
    """How many folders on the way to a file are there already, the root itself among them."""
    parts = posixpath.dirname(relative).split("/") if posixpath.dirname(relative) else []
    depth = 0
    for k in range(len(parts) + 1):
        if not _there(system, posixpath.join(root, *parts[:k])):
            break
        depth = k + 1
    return depth


def inside(folder: str, source: str) -> bool:
    """Whether an output folder is the source folder or lies in it."""
    a, b = (posixpath.normpath(_system(f)[1]) for f in (folder, source))
    return a == b or a.startswith(b.rstrip("/") + "/")


class Run:
    """One change of the files below a folder."""

    def __init__(self, spark: SparkSession, root: str, name: str | None = None, before: Step = _quiet):
        self.spark, self.root, self.before = spark, root.rstrip("/"), before
        self.folder, self.existed = f"{self.root}/{RUN}{name or uuid.uuid4().hex}", True
        self.system, self.path = _system(self.folder)

    def _mark(self, name: str, text: str = "") -> None:
        self.before("mark", name)
        _write(self.system, f"{self.path}/{name}.part", text.encode())
        self.system.move(f"{self.path}/{name}.part", f"{self.path}/{name}")

    def _marked(self, name: str) -> bool:
        return _there(self.system, f"{self.path}/{name}")

    def begin(self) -> None:
        self.existed = _there(self.system, _system(self.root)[1])
        self.system.create_dir(self.path, recursive=True)
        self._mark("begun", json.dumps({"existed": self.existed}))

    def manifest(self) -> DataFrame:
        return self.spark.read.schema(MANIFEST).parquet(f"{self.folder}/manifest")

    def _stage(self, rows: DataFrame, bring: Callable[[pafs.FileSystem, str, object], tuple[str | None, int, str]], source: str, by_name: bool = False) -> None:
        """A manifest of rows (relative, source), each brought into the run's folder by bring(system, staged, source). Names in
        there are of the attempt of a task, or, for files that are there only once, of the file, so that the next attempt finds them."""
        root, folder, before = self.root, self.folder, self.before

        def stage(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            context = TaskContext.get()
            system, top = _system(root)
            top_staged = f"{_system(folder)[1]}/files"
            base, n = f"{top_staged}/{context.partitionId()}-{context.taskAttemptId()}", 0
            for f in frames:
                out = []
                for relative, given in zip(f["relative"], f[source]):
                    before("stage", relative)
                    staged = f"{top_staged}/{hashlib.sha256(relative.encode()).hexdigest()}" if by_name else f"{base}/{n}"
                    n += 1
                    origin, size, digest = bring(system, staged, given)
                    out.append((relative, staged, origin, size, digest, _depth(system, top, relative)))
                yield pd.DataFrame(out, columns=[c.split()[0] for c in MANIFEST.split(", ")])

        rows.select("relative", source).mapInPandas(stage, MANIFEST).write.parquet(f"{self.folder}/manifest")

    def each(self, step: Callable[[pafs.FileSystem, str, str, object], int]) -> int:
        """step(system, root, folder, row) for every file of the manifest, by the executors; the sum of what it gives."""
        root, folder = self.root, self.folder

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            (system, top), own = _system(root), _system(folder)[1]
            for f in frames:
                yield pd.DataFrame({"n": [sum(step(system, top, own, r) for r in f.itertuples(index=False))]})

        return self.manifest().mapInPandas(run, "n long").agg(F.sum("n")).first()[0] or 0

    def place(self) -> int:
        """Every staged file to its place, after what is there has gone into the run's folder. A file that has been placed by
        an attempt that was lost is left as it is."""
        before = self.before

        def step(system: pafs.FileSystem, root: str, folder: str, r) -> int:
            place, backup = f"{root}/{r.relative}", f"{folder}/backup/{r.relative}"
            if not _there(system, r.staged):
                return 1
            if _there(system, place):
                if _there(system, backup):
                    raise FileExistsError(place)
                before("backup", r.relative)
                _put(system, place, backup)
            before("place", r.relative)
            _put(system, r.staged, place)
            return 1

        return self.each(step)

    def undo(self) -> None:
        """The folder as it was before the run. What is in its place and what is staged is seen from where the files are."""
        began = json.loads(self.system.open_input_stream(f"{self.path}/begun").read()) if self._marked("begun") else {"existed": self.existed}
        if _there(self.system, f"{self.path}/manifest/_SUCCESS"):
            moved = self._marked("staged")

            def back(system: pafs.FileSystem, root: str, folder: str, r) -> int:
                place, backup = f"{root}/{r.relative}", f"{folder}/backup/{r.relative}"
                if moved and not _there(system, r.staged) and _there(system, place):
                    _put(system, place, r.staged)
                if _there(system, backup):
                    _put(system, backup, place)
                return 0

            def home(system: pafs.FileSystem, root: str, folder: str, r) -> int:
                if r.origin and _there(system, r.staged):
                    _put(system, r.staged, r.origin)
                return 0

            def tidy(system: pafs.FileSystem, root: str, folder: str, r) -> int:
                parts = posixpath.dirname(r.relative).split("/") if posixpath.dirname(r.relative) else []
                for k in range(len(parts), max(0, r.depth - 1), -1):
                    where = posixpath.join(root, *parts[:k])
                    try:
                        if not system.get_file_info(pafs.FileSelector(where)):
                            system.delete_dir(where)
                    except FileNotFoundError:  # not made, or another task was first
                        continue
                return 0

            self.each(back)
            self.each(home)  # once all places are free again: two files may have changed places
            self.each(tidy)
        else:
            self._return_strays()
        self._clear()
        if not began["existed"] and not self.system.get_file_info(pafs.FileSelector(_system(self.root)[1])):
            self.system.delete_dir(_system(self.root)[1])

    def _return_strays(self) -> None:
        """Files that were moved into the run's folder when no manifest was written: each has a note of its origin beside it."""
        if not _there(self.system, f"{self.path}/files"):
            return
        for info in self.system.get_file_info(pafs.FileSelector(f"{self.path}/files", recursive=True)):
            if info.path.endswith(".origin"):
                staged = info.path[: -len(".origin")]
                origin = self.system.open_input_stream(info.path).read().decode()
                if _there(self.system, staged) and not _there(self.system, origin):
                    _put(self.system, staged, origin)

    def _clear(self) -> None:
        if _there(self.system, self.path):
            self.system.delete_dir(self.path)

    def finish(self) -> int:
        """From staged files to the end: place them all, mark the end, clear the run's folder."""
        self._mark("staged")
        n = self.place()
        self._mark("ended", str(n))
        self._clear()
        return n


def _once(rows: DataFrame) -> None:
    twice = rows.groupBy("relative").count().where("count > 1").select("relative").head(1)
    if twice:
        raise ValueError(f"more than one file for {twice[0]['relative']}")


def _checked(rows: DataFrame) -> DataFrame:
    _once(rows)
    bad = rows.where(F.col("relative").startswith("/") | F.array_contains(F.split("relative", "/"), "..") | F.col("relative").startswith(RUN) | (F.col("relative") == "")).select("relative").head(1)
    if bad:
        raise ValueError(f"not a place in the folder: {bad[0]['relative']!r}")
    return rows


def _guard(run: Run, body: Callable[[], int]) -> int:
    try:
        return body()
    except BaseException:
        run.undo()
        raise


def write_all(rows: DataFrame, output: str, source: str | None = None, cancelled: Callable[[], None] = lambda: None, before: Step = _quiet, name: str | None = None) -> int:
    """Rows (relative, data) as files below output, all or none; how many. Rows without data are left out.

    cancelled() is asked between the phases and raises to stop. The output must not be the source folder or lie in it."""
    if source is not None and inside(output, source):
        raise ValueError("the output must be a new folder outside the source")
    own = _checked(rows.where("relative is not null and data is not null").select("relative", "data"))
    run = Run(rows.sparkSession, output, name, before)

    def bring(system: pafs.FileSystem, staged: str, data: object) -> tuple[str | None, int, str]:
        _write(system, staged, bytes(data))
        return None, len(data), hashlib.sha256(data).hexdigest()

    def body() -> int:
        cancelled()
        run.begin()
        run._stage(own, bring, "data")
        cancelled()
        n = run.finish()
        return n

    return _guard(run, body)


def move_all(rows: DataFrame, root: str, cancelled: Callable[[], None] = lambda: None, before: Step = _quiet, name: str | None = None) -> int:
    """Rows (source, relative) of files that go to their places below root, all or none; how many. Files may change
    places with each other; a place that is taken by a file that stays is an error, and so is a source that isn't there (G2)."""
    own = _checked(rows.select("source", "relative"))
    run = Run(rows.sparkSession, root, name, before)

    def bring(system: pafs.FileSystem, staged: str, source: object) -> tuple[str | None, int, str]:
        origin = _system(str(source))[1]
        if not _there(system, staged):  # an attempt that was lost may have brought it
            if not _there(system, origin):
                raise FileNotFoundError(origin)
            _write(system, f"{staged}.origin", origin.encode())
            _put(system, origin, staged)
        return origin, system.get_file_info(staged).size, ""

    def taken(system: pafs.FileSystem, top: str, folder: str, r) -> int:
        if _there(system, f"{top}/{r.relative}"):
            raise FileExistsError(f"{top}/{r.relative}")
        return 0

    def body() -> int:
        cancelled()
        run.begin()
        run._stage(own, bring, "source", by_name=True)
        cancelled()
        run.each(taken)
        return run.finish()

    return _guard(run, body)


def recover(spark: SparkSession, root: str) -> int:
    """Ends what runs a crash has left below root: those with the mark of the end are cleared, the others undone; how many."""
    system, path = _system(root)
    if not _there(system, path):
        return 0
    left = [i.base_name for i in system.get_file_info(pafs.FileSelector(path)) if i.base_name.startswith(RUN)]
    for found in left:
        run = Run(spark, root, found[len(RUN) :])
        if run._marked("ended"):
            run._clear()
        else:
            run.undo()
    return len(left)
