"""Versioned snapshots: tables that a stream or a batch is merged into, with an atomic switch of the current version.

A snapshot's rows lie in buckets by the hash of their key. A version is a small file of the log: of each bucket the folder
that holds it, and of each stream the last epoch that has gone in. A merge reads the buckets that a batch touches, writes
them anew, and then creates the next file of the log, which is the switch: before it readers see the old version, after
it the new one, and never a part. A batch that comes again, since its stream failed before or after the switch, finds its
epoch in the log or not there. There is one writer of a snapshot at a time; two that race for a version are told so.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.expressions import path_key
from ..storage import Folder
from .enrichment import watch

FILES = "path_key string, path string, file_size long, mtime_ns long, content_sha256 string, sample_id string, manual_status string, change string"
Merge = Callable[[DataFrame, DataFrame], DataFrame]


class Snapshots:
    """A table of `schema` in a folder, whose rows are told apart by `key`. buckets is fixed by the first version; each is
    written as so many `files`, by as many tasks."""

    def __init__(self, spark: SparkSession, folder: str, schema: str, key: str, buckets: int = 64, files: int = 1):
        self.spark, self.schema, self.key, self.files = spark, schema, key, files
        self.folder = Folder(spark, folder)
        self.path = self.folder.path
        found = self.log()
        self.buckets = found[-1]["of"] if found else buckets

    def log(self) -> list[dict]:
        """The versions in order. A file that can't be read counts as not there."""
        out = []
        for name in self.folder.names("log"):
            if name.endswith(".json"):
                try:
                    entry = json.loads(self.folder.read(f"log/{name}"))
                    out.append(entry | {"number": int(name[:-5])})
                except ValueError:
                    continue
        return out

    def current(self) -> dict:
        """The newest version; version 0, without rows, before the first."""
        return (self.log() or [{"number": 0, "of": self.buckets, "places": {}, "epochs": {}}])[-1]

    def read(self, number: int | None = None, only: Iterable[int] | None = None) -> DataFrame:
        """The rows of a version, the current one if none is named; `only`: those of some buckets."""
        entry = self.current() if number is None else next((e for e in self.log() if e["number"] == number), None)
        if entry is None:
            raise LookupError(f"{self.path} has no version {number}")
        wanted = entry["places"] if only is None else {b: entry["places"][b] for b in map(str, only) if b in entry["places"]}
        paths = [f"{self.path}/{place}/bucket={b}" for b, place in sorted(wanted.items())]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def _bucket(self, df: DataFrame):
        return F.pmod(F.xxhash64(df[self.key]), F.lit(self.buckets)).cast("int")

    def merge(self, batch: DataFrame, combine: Merge, stream: str | None = None, epoch: int | None = None, before_switch: Callable[[], None] = lambda: None) -> int:
        """combine(rows of the buckets that the batch touches, batch) takes their place; the number of the version that holds
        them. A batch of a stream whose epoch has gone in already changes nothing, and neither does an empty one."""
        entry = self.current()
        if stream is not None and entry["epochs"].get(stream, -1) >= epoch:
            return entry["number"]
        batch = batch.persist()
        try:
            touched = sorted(r[0] for r in batch.select(self._bucket(batch)).distinct().collect())  # at most as many as there are buckets
            return self._put(entry, combine(self.read(entry["number"] or None, touched) if entry["number"] else self.spark.createDataFrame([], self.schema), batch), touched, stream, epoch, before_switch)
        finally:
            batch.unpersist()

    def replace(self, rows: DataFrame) -> int:
        """K1: a version of these rows alone."""
        return self._put(self.current() | {"places": {}}, rows, list(range(self.buckets)), None, None, lambda: None)

    def _put(self, entry: dict, rows: DataFrame, touched: list[int], stream: str | None, epoch: int | None, before_switch: Callable[[], None]) -> int:
        place = f"data/{entry['number'] + 1:010d}-{uuid.uuid4().hex}"
        written: list[int] = []
        if touched:
            own = rows.select(*self.spark.createDataFrame([], self.schema).columns)
            part = F.pmod(F.hash(own[self.key]), F.lit(self.files))  # another hash than that of the bucket
            own.withColumn("bucket", self._bucket(own)).repartition(len(touched) * self.files, "bucket", part).write.partitionBy("bucket").parquet(f"{self.path}/{place}")
            written = [int(n.partition("=")[2]) for n in self.folder.names(place) if n.startswith("bucket=")]
            if not set(written) <= set(touched):
                raise ValueError(f"a merge of buckets {touched} gave rows of {sorted(set(written) - set(touched))}")
        places = {b: p for b, p in entry["places"].items() if int(b) not in set(touched)} | {str(b): place for b in written}
        epochs = entry["epochs"] | ({stream: epoch} if stream is not None else {})
        before_switch()
        number = entry["number"] + 1
        try:
            self.folder.create(f"log/{number:010d}.json", json.dumps({"of": self.buckets, "places": places, "epochs": epochs}))
        except FileExistsError:
            raise RuntimeError(f"another writer has made version {number} of {self.path}") from None
        return number

    def expire(self, keep: int = 2) -> int:
        """Leaves the newest versions alone and deletes the others, with folders that no version names; how many folders.
        Not while a merge or a reader of an older version is under way."""
        log = self.log()
        for old in log[:-keep]:
            self.folder.delete(f"log/{old['number']:010d}.json")
        named = {p for e in log[-keep:] for p in e["places"].values()}
        gone = [n for n in self.folder.names("data") if f"data/{n}" not in named]
        for n in gone:
            self.folder.delete(f"data/{n}")
        return len(gone)


def newest_by_key(key: str, order: str) -> Merge:
    """T-5: of rows with the same key the last by `order`, whichever batch it came in; of equal ones that of the batch."""

    def combine(old: DataFrame, batch: DataFrame) -> DataFrame:
        row = F.struct(*[F.col(f"`{c}`") for c in old.columns]).alias("row")
        both = old.select(F.lit(0).alias("late"), row).unionByName(batch.select(F.lit(1).alias("late"), row))
        return both.groupBy(F.col(f"row.{key}").alias("k")).agg(F.max_by("row", F.struct(F.col(f"row.{order}").alias("order"), "late")).alias("row")).select("row.*")

    return combine


def refreshed(old: DataFrame, batch: DataFrame) -> DataFrame:
    """T-1 by path: files (path, file_size, mtime_ns, content_sha256) laid over a snapshot of FILES.

    Same size and time: nothing changes. Same content: the row keeps its id and manual status and gets the new size and
    time (touched). Other content: a new id and no manual status (modified), as for a new path (added). Of a path that comes several times
    the last counts. Moves need a listing of all files: see operators.refresh.diff."""
    file = F.struct("path", "file_size", "mtime_ns", "content_sha256")
    new = batch.groupBy(path_key(F.col("path")).alias("key")).agg(F.max_by(file, F.struct("mtime_ns", "content_sha256", "path")).alias("f"))
    was = old.select(F.col("path_key").alias("was"), F.struct(*old.columns).alias("o"))
    both = new.join(was, F.col("key") == F.col("was"), "full_outer")
    o, f = F.col("o"), F.col("f")
    kept = f.isNull() | ((o["file_size"] == f["file_size"]) & (o["mtime_ns"] == f["mtime_ns"]))
    same = o["content_sha256"] == f["content_sha256"]
    fresh = F.concat(F.lit("img_"), F.substring(F.sha2(F.concat_ws("|", "key", f["content_sha256"], f["mtime_ns"]), 256), 1, 24))
    change = F.when(kept, o["change"]).when(same, "touched").when(o.isNotNull(), "modified").otherwise("added")
    pick = lambda c: F.when(kept, o[c]).otherwise(f[c]).alias(c)
    human = lambda c, other: F.when(kept | same, o[c]).otherwise(other).alias(c)
    return both.select(F.coalesce("key", "was").alias("path_key"), pick("path"), pick("file_size"), pick("mtime_ns"), pick("content_sha256"), human("sample_id", fresh), human("manual_status", F.lit(None).cast("string")), change.alias("change"))


def files_of(images: DataFrame) -> DataFrame:
    """The batch of a stream of images as files, with the key of their path."""
    own = images.select(F.regexp_replace("path", "^file:(//)?", "").alias("path"), F.col("length").alias("file_size"), (F.unix_micros("modificationTime") * 1000).alias("mtime_ns"), "content_sha256")
    return own.withColumn("path_key", path_key(F.col("path")))


def keep_refreshed(spark: SparkSession, images: str, table: Snapshots, checkpoint: str, name: str = "images", **options) -> StreamingQuery:
    """T-1, T-5, K1: new files of a folder go into the snapshot, batch by batch. The stream can be started again with its
    checkpoint after any failure: no file is lost or goes in twice."""

    def merge(batch: DataFrame, epoch: int) -> None:
        table.merge(files_of(batch), refreshed, name, epoch)

    return watch(spark, images, merge, checkpoint, **options)
