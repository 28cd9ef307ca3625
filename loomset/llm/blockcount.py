"""Corpus-wide counts of 64-bit keys, brought back to the blocks of documents that ask for them.

Documents are packed into blocks as they are scanned, each block one compressed row of a written table; no key decides
which block a document goes to, so none can be hot. Each block sends every distinct key it holds, with its own count, as
one packed blob to each range of keys; a range adds the counts of all blocks; what the others hold goes back to the
block in the order in which the keys were sent, so that no key travels twice. No step holds more than a block or a
range, whatever the corpus holds, and a key that is in every document is one entry of each block (pre-aggregated).

Keys are of two kinds, each with its own number of bits and its own ranges.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pack_counts, pack_sorted, ranked, stored, trim, unpack_counts, unpack_sorted

#: Bytes of text in a block, and keys in a range of keys.
BLOCK_BYTES = 5 << 20
RANGE_KEYS = 1_200_000
#: Bits of a key as the kinds have them, and keys that all blocks together may send, by kind.
Kinds = list[tuple[int, int]]
Keys = list[tuple[np.ndarray, np.ndarray]]


def dealt(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, int]:
    """(block, load, data), written, and the UTF-8 bytes of all texts. data is an Arrow stream of (doc_id, text, row_text),
    read by frame_of; row_text is a hash of the text. A block is full at block_bytes: it holds one text more at most."""
    own = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.encode("text", "utf-8").alias("text"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("row_text"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, done, held, load = TaskContext.get().partitionId() << 32, 0, [], 0

        def block() -> pa.RecordBatch:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, held[0].schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=3))) as out:
                for part in held:
                    out.write_batch(part)
            return pa.RecordBatch.from_arrays([pa.array([first + done]), pa.array([load]), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["block", "load", "data"])

        for batch in batches:
            ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            at = 0
            while at < batch.num_rows:
                before = int(ends[at - 1]) if at else 0
                stop = min(batch.num_rows, int(np.searchsorted(ends, before + block_bytes - load)) + 1)
                held.append(batch.slice(at, stop - at))
                load += int(ends[stop - 1]) - before
                at = stop
                if load >= block_bytes:
                    yield block()
                    done, held, load = done + 1, [], 0
        if held:
            yield block()
        trim()

    blocks = stored(own.mapInArrow(pack, "block long, load long, data binary"), "blocks", packed=True)
    return blocks, blocks.agg(F.sum("load")).first()[0] or 0


def frame_of(data: bytes) -> tuple[list[int | None], list[bytes | None], np.ndarray]:
    """Ids, texts and hashes of the texts of a block."""
    with pa.ipc.open_stream(data) as stream:
        rows = stream.read_all()
    return [None if x is None else int(x) for x in rows["doc_id"].to_pylist()], rows["text"].to_pylist(), rows["row_text"].to_numpy()


def _asks(block: int, keys: Keys, kinds: Kinds) -> pd.DataFrame:
    """The rows (block, part, keys, own) that a block sends."""
    out, base = [], 0
    for (own_keys, counts), (bits, expected) in zip(keys, kinds):
        ranges = ranges_of(expected)
        cuts = np.searchsorted(own_keys, np.array([(k << bits) // ranges for k in range(1, ranges)], np.uint64)).tolist()
        for k, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(own_keys)])):
            if b > a:
                out.append((block, base + k, pack_sorted(own_keys[a:b]), pack_counts(counts[a:b])))
        base += ranges
    return pd.DataFrame(out, columns=["block", "part", "keys", "own"])


def ranges_of(expected: int) -> int:
    return max(1, math.ceil(expected / RANGE_KEYS))


def _add(frame: pd.DataFrame) -> pd.DataFrame:
    """Of a range, for each block and each of its keys in order: four times the count that the other blocks have, plus 2
    where another block asks for the key, plus 1 where this block is the first of all that have any. The row of block -1
    holds how many keys have a count, and their sum."""
    asked = [unpack_sorted(x) for x in frame["keys"]]
    sizes, every = [len(x) for x in asked], np.concatenate(asked)
    del asked  # each of these arrays has all keys of the range: none stays longer than it is read
    order = ranked(every)
    found = every[order]
    del every
    first = np.flatnonzero(np.concatenate([[True], found[1:] != found[:-1]]))
    del found
    counts = np.concatenate([unpack_counts(x) for x in frame["own"]])[order]
    lengths = np.diff(np.append(first, len(counts)))
    some = np.cumsum(counts > 0)
    some -= np.repeat(some[first] - (counts[first] > 0), lengths)
    leads = (counts > 0) & (some == 1)
    del some
    sums = np.add.reduceat(counts, first)
    del first
    told = np.repeat(sums, lengths)
    told -= counts
    del counts
    told *= 4
    told += np.repeat(2 * (lengths > 1).astype(np.int8), lengths)
    told += leads
    del lengths, leads
    answer = np.empty(len(told), np.int64)
    answer[order] = told
    del order, told
    back, at, part = [], 0, int(frame["part"].iloc[0])
    for block, n in zip(frame["block"], sizes):
        back.append((int(block), part, pack_counts(answer[at : at + n])))
        at += n
    back.append((-1, part, np.array([(sums > 0).sum(), sums.sum()], "<i8").tobytes()))
    del answer, sums
    trim()
    return pd.DataFrame(back, columns=["block", "part", "counts"])


def counted(asks: DataFrame, name: str) -> DataFrame:
    """(block, part, counts), written, from rows of _asks: see _add."""
    return stored(asks.groupBy("part").applyInPandas(_add, "block long, part int, counts binary"), name, packed=True)


ASKS = "block long, part int, keys binary, own binary"


def ask(blocks: DataFrame, keys_of: Callable[[list, list], Keys], kinds: Kinds) -> DataFrame:
    """What each block asks for: keys_of(ids, texts) gives of each kind the sorted distinct keys and the block's own counts."""

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for block, data in zip(f["block"], f["data"]):
                yield _asks(int(block), keys_of(*frame_of(data)[:2]), kinds)
                trim()

    return blocks.select("block", "data").mapInPandas(rows, ASKS)


def totals(answers: DataFrame, kinds: Kinds) -> tuple[int, int]:
    """Of the first kind: keys that are counted at all, and the sum of their counts."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            pairs = [np.frombuffer(x, "<i8") for x in f["counts"]]
            yield pd.DataFrame({"v": [int(sum(p[0] for p in pairs))], "n": [int(sum(p[1] for p in pairs))]})

    own = answers.where((F.col("block") == -1) & (F.col("part") < ranges_of(kinds[0][1])))
    row = own.select("counts").mapInPandas(read, "v long, n long").agg(F.sum("v"), F.sum("n")).first()
    return row[0] or 0, row[1] or 0


def _answer(parts: list[tuple[int, bytes]], kinds: Kinds) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of each kind: what the other blocks count, whether one of them asks, and whether this block is the first that has the key."""
    out, base = [], 0
    for _, expected in kinds:
        mine = sorted((p, c) for p, c in parts if base <= p < base + ranges_of(expected))
        both = np.concatenate([unpack_counts(c) for _, c in mine]) if mine else np.zeros(0, np.int64)
        out.append((both >> 2, both & 2 > 0, both & 1 > 0))
        base += ranges_of(expected)
    return out


def with_answers(blocks: DataFrame, answers: list[tuple[DataFrame, Kinds]], use: Callable[..., pd.DataFrame], schema: str) -> DataFrame:
    """use(block, ids, texts, hashes of texts, answer of each round ...), block by block; see _answer."""
    every = None
    for k, (table, _) in enumerate(answers):
        own = table.where("block >= 0").select("block", F.lit(k).alias("round"), "part", "counts")
        every = own if every is None else every.unionByName(own)
    shapes = [kinds for _, kinds in answers]

    def both(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        for block, data in zip(left["block"], left["data"]):
            told = [_answer([(p, c) for r, p, c in zip(right["round"], right["part"], right["counts"]) if r == k], kinds) for k, kinds in enumerate(shapes)]
            out.append(use(int(block), *frame_of(data), *told))
        trim()
        return out[0] if out else pd.DataFrame(columns=[c.split()[0] for c in schema.split(", ")])

    return blocks.select("block", "data").groupBy("block").cogroup(every.groupBy("block")).applyInPandas(both, schema)
