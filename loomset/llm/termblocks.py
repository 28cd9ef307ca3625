"""Documents as blocks of counted terms: each block has its own dictionary and, of every document, its terms with counts.

Terms are runs of up to `most` consecutive words joined by a space; words are [0-9a-z and all of U+0080 on], A-Z
lower-cased, which on UTF-8 bytes is [0-9a-z\\x80-\\xff]+. Documents are packed as they are scanned, so that no key decides
which block one goes to. A block is one row of a written table:

block; n_docs, documents with a term; n_terms, all terms with repeats; terms, the distinct ones, those in most documents
first; df and cf, of each term the documents that hold it and its occurrences; docs, an Arrow stream of (doc_id, n_words,
n_terms, distinct); data, the documents' postings one after another, see pack.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored, trim

#: Bytes of text of a block: it holds one text more at most.
BLOCK_BYTES = 12 << 20
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
SCHEMA = "block long, n_docs long, n_terms long, terms array<string>, df array<long>, cf array<long>, docs binary, data binary"
_ZSTD = pa.Codec("zstd", compression_level=3)


def words(text: bytes | None) -> list[bytes]:
    return _WORD.findall((text or b"").lower())


def runs(own: list[bytes], most: int) -> list[bytes]:
    """All runs of 1 to `most` consecutive words, joined by one space."""
    if most == 1:
        return own
    return list(chain(own, *([b" ".join(own[i : i + n]) for i in range(len(own) - n + 1)] for n in range(2, most + 1))))


def _planes(x: np.ndarray) -> bytes:
    """Numbers below 2^32, byte by byte of all of them, compressed: the upper bytes of small numbers cost nothing."""
    raw = np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()
    return len(raw).to_bytes(8, "little") + _ZSTD.compress(raw, asbytes=True)


def _numbers(blob: bytes) -> np.ndarray:
    size = int.from_bytes(blob[:8], "little")
    raw = np.frombuffer(_ZSTD.decompress(blob[8:], size, asbytes=True) if size else b"", np.uint8)
    return np.ascontiguousarray(raw.reshape(4, -1).T).view("<u4").reshape(-1)


def pack(doc: np.ndarray, term: np.ndarray, tf: np.ndarray) -> bytes:
    """Postings in order of document and term: steps from term to term within a document, and counts less one."""
    step = np.diff(term, prepend=0)
    first = np.flatnonzero(np.diff(doc, prepend=-1))
    step[first] = term[first]
    steps = _planes(step)
    return len(steps).to_bytes(8, "little") + steps + _planes(tf - 1)


def unpack(blob: bytes, distinct: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, term, count) of every posting; distinct: how many each document has."""
    cut = 8 + int.from_bytes(blob[:8], "little")
    step, tf = _numbers(blob[8:cut]).astype(np.int64), _numbers(blob[cut:]).astype(np.int64) + 1
    doc = np.repeat(np.arange(len(distinct)), distinct)
    total = np.cumsum(step)
    first = np.cumsum(distinct) - distinct
    some = distinct > 0
    before = np.zeros(len(distinct), np.int64)
    before[some] = total[first[some]] - step[first[some]]
    return doc, total - np.repeat(before, distinct), tf


def _block(number: int, ids: list[str | None], texts: list[bytes | None], most: int) -> pa.RecordBatch:
    places: defaultdict[bytes, int] = defaultdict()
    places.default_factory = places.__len__
    n_words, n_terms, parts = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64), []
    for i, t in enumerate(texts):
        own = words(t)
        n_words[i] = len(own)
        found = runs(own, most)
        n_terms[i] = len(found)
        parts.append(np.fromiter(map(places.__getitem__, found), np.int32, len(found)))
    tokens = np.concatenate(parts) if parts else np.zeros(0, np.int32)
    size = max(1, len(places))
    keys, tf = np.unique(np.repeat(np.arange(len(ids)), n_terms) * size + tokens, return_counts=True)
    doc, term = keys // size, keys % size
    df, cf = np.bincount(term, minlength=len(places)), np.bincount(tokens, minlength=len(places))
    rank = np.argsort(-df, kind="stable")  # frequent terms get small numbers
    renamed = np.empty(len(places), np.int64)
    renamed[rank] = np.arange(len(places))
    order = np.argsort(doc * size + renamed[term])
    doc, term, tf = doc[order], renamed[term[order]], tf[order]
    names = list(places)
    frame = pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(n_words), pa.array(n_terms), pa.array(np.bincount(doc, minlength=len(ids)))], ["doc_id", "n_words", "n_terms", "distinct"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, frame.schema, options=pa.ipc.IpcWriteOptions(compression=_ZSTD)) as out:
        out.write_batch(frame)
    cells = [[number], [int((n_terms > 0).sum())], [int(n_terms.sum())], [[names[k].decode() for k in rank.tolist()]], [df[rank].tolist()], [cf[rank].tolist()], [sink.getvalue().to_pybytes()], [pack(doc, term, tf)]]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cells, kinds)], [c.split()[0] for c in SCHEMA.split(", ")])


def blocks(docs: DataFrame, most: int = 1, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The blocks of docs (doc_id, text), written. Null and empty texts are documents without terms; a very long text may be a
    block of its own; repeated rows are documents of their own; other columns are not read. Without rows: no blocks."""
    own = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.encode("text", "utf-8").alias("text"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, done, ids, texts, load = TaskContext.get().partitionId() << 32, 0, [], [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                ids.append(doc_id.as_py())
                texts.append(text.as_py())
                load += len(texts[-1] or b"")
                if load >= block_bytes:
                    yield _block(base + done, ids, texts, most)
                    done, ids, texts, load = done + 1, [], [], 0
                    trim()
        if ids:
            yield _block(base + done, ids, texts, most)
        trim()

    return stored(own.mapInArrow(rows, SCHEMA), "terms")


def docs_of(blob: bytes) -> pa.Table:
    with pa.ipc.open_stream(blob) as stream:
        return stream.read_all()
