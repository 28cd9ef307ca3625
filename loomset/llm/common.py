"""Helpers shared by the text operators: the shared folder, hashing of words, sizes of a table."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
import zlib
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir). Where it is unset, a local session, whose driver
    and executors are one process, has one of its own; on a cluster that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = _local_dir()
    return found.rstrip("/")


@lru_cache(maxsize=1)
def _local_dir() -> str:
    return "file://" + tempfile.mkdtemp(prefix="loomset-")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: Has Spark delete the shuffle files of a job when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def cleaned(spark: SparkSession) -> Iterator[None]:
    """Jobs in here leave no shuffle files: what they write is a table, which ends their lineage."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def stored(df: DataFrame, name: str, packed: bool = False) -> DataFrame:
    """df written as a Parquet table in the shared folder and read again: lineage ends here, and lost executors cost nothing.

    packed: its columns are compressed as they are, so Parquet doesn't try again, which takes buffers of a page beside the heap."""
    spark = df.sparkSession
    path = new_path(spark, name)
    with cleaned(spark):
        (df.write.option("compression", "none") if packed else df.write).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Empties tables of stored() that nothing reads any more: their files go, by an overwrite with no rows."""
    for t in tables:
        t.sparkSession.range(0).coalesce(1).write.mode("overwrite").parquet(t._stored_at)


_KINDS = {"string": pa.string(), "long": pa.int64(), "double": pa.float64()}


def small_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """Few rows of the driver, as createDataFrame makes them, but through Arrow: rows of a list are passed through Python
    workers on every executor, which stay there."""
    fields = [field.split() for field in schema.split(", ")]
    return spark.createDataFrame(pa.table({name: pa.array([r[k] for r in rows], _KINDS[kind]) for k, (name, kind) in enumerate(fields)}), schema)


def trim() -> None:
    """Gives memory that numpy and Arrow have freed back to the system: a worker lives on between tasks."""
    pa.default_memory_pool().release_unused()
    if _libc() is not None:
        _libc().malloc_trim(0)


@lru_cache(maxsize=1)
def _libc() -> ctypes.CDLL | None:
    try:
        libc = ctypes.CDLL("libc.so.6")
        return libc if hasattr(libc, "malloc_trim") else None
    except OSError:  # another C library: memory stays with the worker
        return None


def size_of(docs: DataFrame, text: str = "text") -> tuple[int, int]:
    """(rows, UTF-8 bytes of the texts) over the whole table."""
    row = docs.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length(text)).alias("b")).first()
    return row["n"], row["b"] or 0


#: A key is hot when it holds more than one row in HOT; so there are fewer than HOT of them.
HOT = 1000


def hot_keys(rows: DataFrame, key: str) -> DataFrame:
    """The hot keys of rows: below HOT of them, whatever the table's size; written, since they are read twice."""
    total = rows.count()
    return stored(rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") * HOT > total).select(key), "hot")


def join_hot(rows: DataFrame, right: DataFrame, key: str, hot: DataFrame, how: str = "left") -> DataFrame:
    """rows joined to right, which has one row a key at most. Rows of hot keys stay where they are and meet a broadcast
    of below HOT rows, so that no task gets all rows of one key; the others are shuffled. how: left or inner."""
    few = F.broadcast(right.join(F.broadcast(hot), key, "left_semi"))
    near = rows.join(F.broadcast(hot), key, "left_semi").join(few, key, how)
    return near.unionByName(rows.join(F.broadcast(hot), key, "left_anti").join(right, key, how))


#: ASCII white space, and so bytes.split(), is exactly [\x20\x09-\x0D].
_WS = np.zeros(256, bool)
_WS[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """One odd 64-bit value for each byte; A-Z have those of a-z, white space has 0."""
    table = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)) | np.uint64(1)
    table[0x41:0x5B] = table[0x61:0x7B]
    table[_WS] = 0
    return table


_powers: dict[str, np.ndarray] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        size = max(1 << 18, 1 << (n - 1).bit_length())
        for key, base in (("up", _BASE), ("down", _INVERSE)):
            table = np.full(size, np.uint64(base))
            table[0] = 1
            _powers[key] = np.multiply.accumulate(table)
    return _powers["up"][:n], _powers["down"]


def _hash_chunk(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, hash) of each white-space separated word; data begins and ends with white space."""
    space = _WS[data]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    starts, ends = edge[::2], edge[1::2]
    up, down = _power_tables(len(data))
    total = np.cumsum(_letters()[data] * up, dtype=np.uint64)
    h = (total[ends - 1] - total[starts - 1]) * down[starts]
    return starts, mix(h + (ends - starts).astype(np.uint64) * np.uint64(0xA0761D6478BD642F))


def word_hashes(texts: list[bytes | None], chunk: int = 1 << 18) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words [^\\x20\\x09-\\x0D]+ of each text, A-Z lower-cased, and the number of words of each text.

    All texts of a chunk are hashed at once: a word's hash is a difference of prefix sums of a polynomial over its bytes."""
    out, counts = [], np.zeros(len(texts), np.int64)
    i = 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (j == i or size < chunk):
            size += len(texts[j] or b"") + 1
            j += 1
        data = np.frombuffer(b" " + b"".join((x or b"") + b" " for x in texts[i:j]), np.uint8)
        begin = np.cumsum([1] + [len(x or b"") + 1 for x in texts[i:j]])
        starts, h = _hash_chunk(data)
        counts[i:j] = np.diff(np.searchsorted(starts, begin))
        out.append(h)
        i = j
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), counts


def ranked(keys: np.ndarray) -> np.ndarray:
    """The stable order of keys that are not negative: numpy sorts plain numbers much faster than it finds their order, so
    the first bits of each key are sorted with its place, which nearly always is the order of the whole keys."""
    n = len(keys)
    room = max(1, n.bit_length())
    wide = keys.astype(np.uint64, copy=False)
    cut = max(0, (int(wide.max()).bit_length() if n else 0) + room - 64)
    order = (np.sort((wide >> np.uint64(cut)) << np.uint64(room) | np.arange(n, dtype=np.uint64)) & np.uint64((1 << room) - 1)).astype(np.int64)
    if cut:
        found = wide[order]
        if (found[1:] < found[:-1]).any():
            return np.argsort(wide, kind="stable")
    return order


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys, and of each key its place among them."""
    order = ranked(keys)
    found = keys[order]
    first = np.ones(len(keys), bool)
    np.not_equal(found[1:], found[:-1], out=first[1:])
    place = np.empty(len(keys), np.int64)
    place[order] = np.cumsum(first) - 1
    return found[first], place


def pack_sorted(keys: np.ndarray) -> bytes:
    """Sorted distinct 64-bit keys, by Elias and Fano: of each key's distance from the first the low bits as they are, as
    many as leave some two bits a key, and the others, which ascend, as a bitmap of key number plus value."""
    if not len(keys):
        return b""
    x = keys - keys[0]
    n = len(x)
    low = max(0, (int(x[-1]) // n).bit_length() - 1)
    head = n.to_bytes(8, "little") + bytes([low]) + int(keys[0]).to_bytes(8, "little")
    bits = np.unpackbits(x.astype("<u8").view(np.uint8).reshape(n, 8), axis=1, count=low, bitorder="little") if low else np.zeros((n, 0), np.uint8)
    high = (x >> np.uint64(low)).astype(np.int64) + np.arange(n)
    marks = np.zeros(int(high[-1]) + 1, np.uint8)
    marks[high] = 1
    return head + np.packbits(bits, bitorder="little").tobytes() + np.packbits(marks).tobytes()


def unpack_sorted(blob: bytes) -> np.ndarray:
    if not blob:
        return np.zeros(0, np.uint64)
    n, low = int.from_bytes(blob[:8], "little"), blob[8]
    mid = 17 + (n * low + 7) // 8
    x = (np.flatnonzero(np.unpackbits(np.frombuffer(blob, np.uint8, offset=mid)))[:n] - np.arange(n)).astype(np.uint64) << np.uint64(low)
    if low:  # the eight bytes from where a key's low bits begin; where these may be more than eight bytes' worth, bit by bit
        start = np.arange(n, dtype=np.int64) * low
        if low <= 57:
            eight = np.ndarray(mid - 17 + 1, "<u8", blob[17:mid] + bytes(8), strides=(1,))
            x |= (eight[start >> 3] >> (start & 7).astype(np.uint64)) & np.uint64((1 << low) - 1)
        else:
            bits = np.unpackbits(np.frombuffer(blob, np.uint8, mid - 17, 17), count=n * low, bitorder="little").reshape(n, low)
            full = np.zeros((n, 8), np.uint8)
            full[:, : (low + 7) // 8] = np.packbits(bits, axis=1, bitorder="little")
            x |= full.reshape(-1).view("<u8")
    return x + np.uint64(int.from_bytes(blob[9:17], "little"))


def pack_counts(counts: np.ndarray) -> bytes:
    """Counts, nearly all of which are small: a byte each, 255 for what is no less, then these as they are; compressed."""
    large = np.flatnonzero(counts >= 255)
    small = counts.astype(np.uint8)
    small[large] = 255
    return zlib.compress(small.tobytes() + counts[large].astype("<i8").tobytes() + len(large).to_bytes(8, "little"), 1)


def unpack_counts(blob: bytes) -> np.ndarray:
    data = zlib.decompress(blob)
    rest = 8 * int.from_bytes(data[-8:], "little")
    out = np.frombuffer(data, np.uint8, len(data) - 8 - rest).astype(np.int64)
    out[out == 255] = np.frombuffer(data, "<i8", rest // 8, len(out))
    return out
