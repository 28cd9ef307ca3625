"""WARC revisit resolution: archives with one response for each payload and revisits that refer to it.

Headers (page_id, url, digest, length), not payloads, are shuffled by payload digest to find each group's response, the
record with the largest page_id. Revisits are written from headers alone. Responses are written where their pages are
scanned, less the pages that are revisits: these meet a broadcast of (page_id, digest) of up to BROADCAST_ROWS revisits,
and only where there are more of them a shuffle by both. Archives are gzipped WARC/1.1 files by Spark's own committed
text writer (a record ends with CR LF CR LF, which is the line separator), so that a lost executor leaves no half file;
then the files are read back piece by piece and every record is taken apart by its Content-Length.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cleaned, hot_keys, join_hot, new_path, stored

#: Bytes of an archive before compression: records are written by classes of payload lengths, and a file of a class gets
#: so many of them that the longest would fit. A file of the last class has one record.
ARCHIVE_BYTES = 64 << 20
CLASSES = (1 << 14, 1 << 18, 1 << 22)
#: Revisits that are broadcast: some 40 MB.
BROADCAST_ROWS = 400_000
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2000-01-01T00:00:00Z"


def base32_of_hex(h: Column) -> Column:
    """Upper-case base32 of 40 hexadecimal digits: five of these are 20 bits, four letters."""
    out = []
    for k in range(8):
        bits = F.conv(F.substring(h, 1 + 5 * k, 5), 16, 10).cast("int")
        out += [F.substring(F.lit(_BASE32), F.shiftright(bits, 15 - 5 * j).bitwiseAND(31) + 1, F.lit(1)) for j in range(4)]
    return F.concat(*out)


def _payload() -> Column:
    return F.coalesce(F.encode("html", "utf-8"), F.lit(b""))


def headers(pages: DataFrame) -> DataFrame:
    """(page_id, url, digest, length) of each page."""
    return pages.select("page_id", "url", F.sha1(_payload()).alias("digest"), F.octet_length(_payload()).cast("long").alias("length"))


def revisits(heads: DataFrame) -> DataFrame:
    """The headers that are no response, with `response`, the largest page_id of an equal payload. Digests of one page
    need no answer, and common ones are met by a broadcast (see join_hot)."""
    best = heads.groupBy("digest").agg(F.max("page_id").alias("response"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "response")
    told = join_hot(heads, stored(best, "best"), "digest", hot_keys(heads, "digest"), "inner")
    return told.where(~F.col("page_id").eqNullSafe(F.col("response"))).select(*heads.columns, "response")


def _record(first: bool) -> Column:
    """The WARC record of a header, a response with its payload, as binary without its last CR LF CR LF."""
    line = lambda name, value: F.concat(F.lit(name + ": "), value, F.lit("\r\n"))
    clean = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"[\r\n]+", " ")
    id_of = lambda p: F.concat(F.lit("<urn:page:"), F.coalesce(p.cast("string"), F.lit("null")), F.lit(">"))
    again = [] if first else [line("WARC-Profile", F.lit(PROFILE)), line("WARC-Refers-To", id_of(F.col("response")))]
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.lit("response" if first else "revisit")),
        line("WARC-Record-ID", id_of(F.col("page_id"))),
        line("WARC-Date", F.lit(DATE)),
        line("WARC-Target-URI", clean(F.col("url"))),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32_of_hex(F.col("digest")))),
        line("X-Payload-Length", F.col("length").cast("string")),
        *again,
        line("Content-Type", F.lit("text/html")),
        line("Content-Length", (F.col("length") if first else F.lit(0)).cast("string")),
        F.lit("\r\n"),
    )
    return F.concat(F.encode(head, "utf-8"), F.col("payload")) if first else F.encode(head, "utf-8")


def _write(records: DataFrame, path: str, longest: int | None) -> None:
    per_file = max(1, ARCHIVE_BYTES // (longest + 2048)) if longest else 1
    with cleaned(records.sparkSession):
        records.select(F.col("value").cast("string")).write.mode("append").option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", per_file).text(path)


def write_archives(pages: DataFrame, path: str) -> None:
    """Payloads are written from the partitions in which they are scanned, a class of lengths at a time."""
    heads = stored(headers(pages), "headers")
    again = stored(revisits(heads), "revisits")
    lengths = [r[0] for r in heads.select(sum(((F.col("length") >= c).cast("int") for c in CLASSES), F.lit(0)).alias("c")).distinct().collect()]
    gone = again.select(F.col("page_id").alias("gone_id"), F.col("digest").alias("gone_digest")).distinct()
    if (n := gone.count()) <= BROADCAST_ROWS:
        gone = F.broadcast(gone)
    own = pages.select("page_id", "url", _payload().alias("payload"))
    own = own.select("*", F.sha1("payload").alias("digest"), F.octet_length("payload").cast("long").alias("length"))
    for c in sorted(lengths):
        least, most = (0, *CLASSES)[c], (*CLASSES, None)[c]
        rows = own.where(F.col("length") >= least) if most is None else own.where((F.col("length") >= least) & (F.col("length") < most))
        if n:
            rows = rows.join(gone, F.col("page_id").eqNullSafe(F.col("gone_id")) & (F.col("digest") == F.col("gone_digest")), "left_anti")
        _write(rows.select(_record(True).alias("value")), path, most)
    if n:
        _write(again.select(_record(False).alias("value")), path, CLASSES[0])


_FIELD = re.compile(rb"([\w-]+): ([^\r]*)\r\n")


def _inflated(content: bytes, piece: int = 1 << 20) -> Iterator[bytes]:
    """A gzip file, of one member or many, in pieces."""
    unzip = zlib.decompressobj(31)
    while content:
        yield unzip.decompress(content, piece)
        content = unzip.unconsumed_tail
        while unzip.eof and unzip.unused_data or not content and not unzip.eof:
            if unzip.eof:
                content, unzip = unzip.unused_data, zlib.decompressobj(31)
                break
            rest = unzip.decompress(b"", piece)
            if not rest:
                break
            yield rest


def parse(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields, block) of each record of a gzipped archive; no more than a record and a piece is held."""
    data = bytearray()
    for more in _inflated(content):
        data += more
        at = 0
        while (end := data.find(b"\r\n\r\n", at) + 4) > 3:
            fields = {k.decode(): v.decode("utf-8", "replace") for k, v in _FIELD.findall(data, at, end - 2)}
            size = int(fields["Content-Length"])
            if len(data) < end + size + 4:
                break
            if data[end + size : end + size + 4] != b"\r\n\r\n":
                raise ValueError(f"{fields['WARC-Record-ID']} doesn't end after its Content-Length")
            yield fields, bytes(data[end : end + size])
            at = end + size + 4
        del data[:at]
    if data:
        raise ValueError(f"an archive ends inside a record, {len(data)} bytes after the last one")


def _page(uri: str | None) -> int | None:
    text = re.fullmatch("<urn:page:(.*)>", uri)[1] if uri else "null"
    return None if text == "null" else int(text)


def read_archives(spark, path: str, payload: bool = False) -> DataFrame:
    """The records of all archives in a folder (READ). The digest of a response is that of the bytes read; a revisit has
    none, and the digest and length that its header holds. payload: with the bytes too."""

    def frame(rows: list[tuple]) -> pd.DataFrame:
        columns = [list(c) for c in zip(*rows)]
        whole = lambda k: pd.array(columns[k], "Int64")  # noqa: E731  a list with nulls would become floating-point numbers
        return pd.DataFrame({"page_id": whole(0), "payload_bytes": columns[1], "payload_digest": columns[2], "record_type": columns[3], "refers_to": whole(4), "payload": columns[5]})

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for content in f["content"]:
                out = []
                for h, block in parse(content):
                    said = h["WARC-Payload-Digest"].removeprefix("sha1:")
                    if h["WARC-Type"] == "response" and base64.b32encode(hashlib.sha1(block).digest()).decode() != said:
                        raise ValueError(f"{h['WARC-Record-ID']}: the payload doesn't have the digest of its header")
                    if len(out) == (64 if payload else 8192):
                        yield frame(out)
                        out = []
                    out.append((_page(h["WARC-Record-ID"]), int(h["X-Payload-Length"]), said, h["WARC-Type"], _page(h.get("WARC-Refers-To")), block if payload else None))
                if out:  # else an archive of an empty partition
                    yield frame(out)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).where("length > 0").select("content")
    return files.mapInPandas(read, READ)


def deduplicate(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Writes the archives of pages to a folder and returns what they hold, read back.

    Columns of READ without payload, one row for each row of pages. A null html is an empty payload; a null page_id is
    kept as null and is a response only where all its group's ids are null. Repeated rows of the response are responses
    too: they are one record. A very long page is an archive of its own. No pages: no files and no rows. Other columns
    than page_id, url and html are not read."""
    spark = pages.sparkSession
    path = path or new_path(spark, "warc")
    write_archives(pages, path)
    spark.createDataFrame([], "value string").write.mode("append").text(path)  # the folder is there without pages too
    return read_archives(spark, path).drop("payload")
