"""K9: one ZIP file from pieces of entries that tasks compress.

An entry is its pieces one after another: (name, at, data), in order of `at`. Each task compresses its pieces on their own,
up to a byte, into a file of its attempt in a folder beside the archive, and gives for each its place there, sizes and
checksum; the table of these counts only attempts that ended well. Compressed pieces put together are a valid stream, and
checksums are put together too, so that an entry of any size is never in one place. One process then strings the pieces
together, a chunk at a time, at places that sum up what is before them, and ends with the directory: a ZIP is one file."""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .outputs import _system

#: Bytes that are copied at once.
CHUNK = 4 << 20
#: Fixed values of the format: what fits into its short fields; a final empty block; names are UTF-8; deflated; versions; midnight of 1980-01-01.
SHORT, END_BLOCK, UTF8, DEFLATED, VERSION, DATE = 0xFFFFFFFF, b"\x03\x00", 0x800, 8, 45, 0x21
#: Fixed value: the polynomial of the checksum, the lowest power in the highest bit.
POLYNOMIAL = 0xEDB88320
PIECES = "name string, at long, part string, place long, packed long, size long, crc long"


def _product(a: int, b: int) -> int:
    """The product of two polynomials without carries, modulo POLYNOMIAL; bit 31 is the power 0."""
    out = 0
    for power in range(32):
        if a >> (31 - power) & 1:
            out ^= b
        b = b >> 1 ^ (POLYNOMIAL if b & 1 else 0)
    return out


def joined_crc(first: int, second: int, size: int) -> int:
    """The checksum of two pieces put together; size: of the second."""
    shift, square, n = 1 << 31, 1 << 30, 8 * size  # x to the powers 0 and 1
    while n:
        shift = _product(shift, square) if n & 1 else shift
        square, n = _product(square, square), n >> 1
    return _product(first, shift) ^ second


def _packed(pieces: DataFrame, folder: str) -> DataFrame:
    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        context = TaskContext.get()
        system, path = _system(folder)
        part, place = f"{context.partitionId()}-{context.taskAttemptId()}", 0
        system.create_dir(path, recursive=True)
        with system.open_output_stream(f"{path}/{part}") as out:
            for f in frames:
                rows = []
                for name, at, data in zip(f["name"], f["at"], f["data"]):
                    own = zlib.compressobj(6, zlib.DEFLATED, -15)
                    raw = own.compress(data) + own.flush(zlib.Z_FULL_FLUSH)
                    out.write(raw)
                    rows.append((name, at, part, place, len(raw), len(data), zlib.crc32(data)))
                    place += len(raw)
                yield pd.DataFrame(rows, columns=[c.split()[0] for c in PIECES.split(", ")])

    pieces.select("name", "at", "data").mapInPandas(pack, PIECES).write.parquet(f"{folder}.pieces")
    return pieces.sparkSession.read.schema(PIECES).parquet(f"{folder}.pieces")


def _wide(short: int, *values: int) -> tuple[list[int], bytes]:
    """Values as they go into short fields, and the extra field that has those which don't fit."""
    far = [v for v in values if v >= short]
    extra = struct.pack(f"<HH{len(far)}Q", 1, 8 * len(far), *far) if far else b""
    return [SHORT if v >= short else v for v in values], extra


def _header(name: bytes, crc: int, packed: int, size: int, short: int) -> bytes:
    far = max(packed, size) >= short  # both or none, as readers want it
    extra = struct.pack("<HHQQ", 1, 16, size, packed) if far else b""
    own = (SHORT, SHORT) if far else (packed, size)
    return struct.pack("<4s5H3L2H", b"PK\x03\x04", VERSION, UTF8, DEFLATED, 0, DATE, crc, *own, len(name), len(extra)) + name + extra


def _entry(name: bytes, crc: int, packed: int, size: int, place: int, short: int) -> bytes:
    (s, p, o), extra = _wide(short, size, packed, place)
    return struct.pack("<4s6H3L5H2L", b"PK\x01\x02", VERSION, VERSION, UTF8, DEFLATED, 0, DATE, crc, p, s, len(name), len(extra), 0, 0, 0, 0, o) + name + extra


def _ending(entries: int, size: int, place: int, short: int) -> bytes:
    out = b""
    if entries >= 0xFFFF or size >= short or place >= short:
        out = struct.pack("<4sQ2H2L4Q", b"PK\x06\x06", 44, VERSION, VERSION, 0, 0, entries, entries, size, place)
        out += struct.pack("<4sLQL", b"PK\x06\x07", 0, place + size, 1)
    n = min(entries, 0xFFFF)
    return out + struct.pack("<4s4H2LH", b"PK\x05\x06", 0, 0, n, n, SHORT if size >= short else size, SHORT if place >= short else place, 0)


def write_zip(pieces: DataFrame, path: str, short: int = SHORT) -> int:
    """The archive of pieces (name, at, data), over what was at the path; the number of entries. short: from which on numbers go
    into the long fields of the format.

    Pieces of an entry that have the same `at` are an error, and so is a name that is null or empty. Null data are empty. Until it
    is whole the archive has another name."""
    bad = pieces.where("name is null or name = ''").head(1) or pieces.groupBy("name", "at").count().where("count > 1").head(1)
    if bad:
        raise ValueError(f"no name, or two pieces at one place: {bad[0]}")
    run = f"{path}.{uuid.uuid4().hex}"
    system, target = _system(path)
    parts = _system(f"{run}.parts")[1]
    filled = pieces.select("name", "at", F.coalesce("data", F.lit(b"")).alias("data"))
    try:
        table = _packed(filled, f"{run}.parts").orderBy("name", "at")
        directory: list[bytes] = []
        with system.open_output_stream(f"{_system(run)[1]}.zip") as out:
            place = 0
            for name, own in _by_name(table):
                crc, size = 0, 0
                for p in own:
                    crc, size = joined_crc(crc, p["crc"], p["size"]), size + p["size"]
                packed = sum(p["packed"] for p in own) + len(END_BLOCK)
                head = _header(name.encode(), crc, packed, size, short)
                directory.append(_entry(name.encode(), crc, packed, size, place, short))
                out.write(head)
                for p in own:
                    _copy(system, f"{parts}/{p['part']}", p["place"], p["packed"], out)
                out.write(END_BLOCK)
                place += len(head) + packed
            for record in directory:
                out.write(record)
            out.write(_ending(len(directory), sum(map(len, directory)), place, short))
        system.move(f"{_system(run)[1]}.zip", target)
        return len(directory)
    finally:
        for left in (parts, f"{parts}.pieces"):
            if system.get_file_info(left).type != pafs.FileType.NotFound:
                system.delete_dir(left)
        if system.get_file_info(f"{_system(run)[1]}.zip").type != pafs.FileType.NotFound:
            system.delete_file(f"{_system(run)[1]}.zip")


def _by_name(table: DataFrame) -> Iterator[tuple[str, list]]:
    """Entries with the list of their pieces, a partition of the ordered table at a time."""
    name, own = None, []
    for r in table.toLocalIterator():
        if r["name"] != name:
            if own:
                yield name, own
            name, own = r["name"], []
        own.append(r)
    if own:
        yield name, own


def _copy(system: pafs.FileSystem, part: str, place: int, size: int, out) -> None:
    with system.open_input_file(part) as source:
        source.seek(place)
        while size:
            data = source.read(min(CHUNK, size))
            if not data:
                raise EOFError(part)
            out.write(data)
            size -= len(data)
