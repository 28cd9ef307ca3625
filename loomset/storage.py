"""Tables that end lineage, in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset, a local session has a folder of its own; on a cluster that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = _local_folder()
    return found.rstrip("/")


@lru_cache(maxsize=1)
def _local_folder() -> str:
    return "file://" + tempfile.mkdtemp(prefix="loomset-curation-")


def cut(df: DataFrame, name: str) -> DataFrame:
    """df as a written table, so that rounds don't pile up lineage."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Folder:
    """A folder of any file system that Spark reads, for the driver: small files, listings and atomic renames."""

    def __init__(self, spark: SparkSession, path: str):
        self._jvm, self.path = spark._jvm, path.rstrip("/")
        self._conf = spark._jsc.hadoopConfiguration()
        self._fs = self._path("").getFileSystem(self._conf)

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def names(self, sub: str = "") -> list[str]:
        """Names in the folder, sorted; none where it isn't there."""
        where = self._path(sub)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(where)) if self._fs.exists(where) else []

    def read(self, name: str) -> str:
        stream = self._fs.open(self._path(name))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, name: str, text: str) -> None:
        """A new file, which is there whole or not at all. FileExistsError where the name is taken."""
        part = self._path(f"{name}.{uuid.uuid4().hex}.part")
        stream = self._fs.create(part, False)
        stream.write(text.encode())
        stream.close()
        options = self._jvm.org.apache.hadoop.fs.Options
        kinds = self._jvm.java.lang.reflect.Array.newInstance(getattr(options, "Rename").NONE.getClass(), 1)
        kinds[0] = getattr(options, "Rename").NONE
        try:
            self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(part.toUri(), self._conf).rename(part, self._path(name), kinds)
        except Exception as e:
            self._fs.delete(part, False)
            if "FileAlreadyExists" in str(e):
                raise FileExistsError(f"{self.path}/{name}") from e
            raise

    def delete(self, name: str) -> None:
        """A file or a folder with all in it; nothing where it isn't there."""
        self._fs.delete(self._path(name), True)
