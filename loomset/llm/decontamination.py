"""Benchmark decontamination: one Aho-Corasick automaton over the windows of all items, one scan of each text.

Words are [0-9a-z and all of U+0080 on], A-Z lower-cased; on UTF-8 bytes that is [0-9a-z\\x80-\\xff]+. A benchmark word
is one symbol of the automaton's alphabet and all other words are symbol 1, so that a text is a string of symbols, a
window a pattern of `width` symbols, and a match's place is a place among the words of the text.

The automaton holds up to ITEM_BYTES of items, which is checked; a larger benchmark is scanned in passes, each with its part
of the items, and what the passes hit is united.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hot_keys, join_hot, stored, trim

WIDTH = 13
#: Bytes of items in the automaton of a pass, about; an item is never split.
ITEM_BYTES = 8 << 20
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
SCHEMA = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
PART = "n_words long, runs array<struct<a: bigint, b: bigint>>, items array<string>"


def words(text: bytes) -> list[bytes]:
    return _WORD.findall(text.lower())


class Windows:
    """The automaton of some items: [(item_id, text)]. Symbols are numbers, 0 is any word that no item has."""

    def __init__(self, items: list[tuple[object, bytes]], width: int = WIDTH):
        self.symbols: dict[bytes, int] = {}
        patterns: dict[tuple[int, ...], set[str]] = defaultdict(set)
        for item, text in items:
            own = tuple(self.symbols.setdefault(w, len(self.symbols) + 1) for w in words(text))
            for at in range(max(1, len(own) - width + 1) if own else 0):
                patterns[own[at : at + width]].add(str(item))
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for p, ids in patterns.items():
            self.automaton.add_word(p, (len(p), frozenset(ids)))
        if patterns:
            self.automaton.make_automaton()
        self.empty = not patterns

    def scan(self, text: bytes) -> tuple[int, np.ndarray, set[str], list[bytes]]:
        """Number of words, a mark for each word that is inside an occurrence, the items that occur, the words."""
        own = words(text)
        hit, found = np.zeros(len(own) + 1, np.int32), set()
        if own and not self.empty:
            get = self.symbols.get
            for end, (length, ids) in self.automaton.iter(tuple([get(w, 0) for w in own])):
                hit[end - length + 1] += 1
                hit[end + 1] -= 1
                found |= ids
        return len(own), np.cumsum(hit[:-1]) > 0, found, own


def _runs(marks: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], marks.astype(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist()))


def hit_spans(text: bytes, windows: Windows) -> list[tuple[int, int]]:
    """Byte offsets (start, end) in the original text of the runs of hit words."""
    _, marks, _, _ = windows.scan(text)
    spans = [m.span() for m in _WORD.finditer(text.lower())]
    return [(spans[a][0], spans[b - 1][1]) for a, b in _runs(marks)]


def passes_of(benchmark: DataFrame) -> int:
    size = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(1, -(-size // ITEM_BYTES))


def load_items(benchmark: DataFrame, passes: int = 1, k: int = 0) -> list[tuple[object, bytes]]:
    """The items of pass k, those with equal texts together; null texts left out."""
    own = benchmark.where("text is not null").select("item_id", F.encode("text", "utf-8").alias("t"))
    if passes > 1:
        own = own.where(F.pmod(F.xxhash64("t"), F.lit(passes)) == k)
    return [(r["item_id"], bytes(r["t"])) for r in own.collect()]


def _scanned(benchmark: DataFrame, width: int, passes: int, k: int, schema: str, row: Callable[[int, np.ndarray, set[str]], tuple]):
    """A column function over binary texts: row(words, marks, items) of the scan of pass k. Each Python worker builds the automaton once."""
    held = benchmark.sparkSession.sparkContext.broadcast(load_items(benchmark, passes, k))
    names = [c.split()[0] for c in re.split(r", (?![^<]*>)", schema)]

    @F.pandas_udf(schema)
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        windows = Windows(held.value, width)
        for batch in batches:
            yield pd.DataFrame([row(*windows.scan(t or b"")[:3]) for t in batch], columns=names)
        trim()

    return scan


def judged(rows: DataFrame, benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """rows, which have a binary column `data` and any others, with `judged`, a struct of SCHEMA."""

    def whole(n: int, marks: np.ndarray, items: set[str]) -> tuple:
        k = int(marks.sum())
        return n, k, len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), k > 0 and 20 * k >= n

    def part(n: int, marks: np.ndarray, items: set[str]) -> tuple:
        return n, [{"a": a, "b": b} for a, b in _runs(marks)], sorted(items)

    passes = passes_of(benchmark)
    if passes == 1:
        return rows.withColumn("judged", _scanned(benchmark, width, 1, 0, SCHEMA, whole)("data"))
    texts = stored(rows.select(F.sha2(F.coalesce("data", F.lit(b"")), 256).alias("key"), "data"), "texts")
    one = texts.dropDuplicates(["key"])
    hits = None
    for k in range(passes):
        scan = _scanned(benchmark, width, passes, k, PART, part)
        found = stored(one.select("key", scan("data").alias("p")).select("key", "p.*").where(F.lit(k == 0) | (F.size("items") > 0)), "hits")
        hits = found if hits is None else hits.unionByName(found)
    runs = F.array_sort(F.flatten(F.collect_list("runs")))
    items = F.array_sort(F.array_distinct(F.flatten(F.collect_list("items"))))
    every = hits.groupBy("key").agg(F.max("n_words").alias("n_words"), runs.alias("runs"), items.alias("items"))
    # The runs of all passes in order: each adds what lies beyond those before it.
    add = lambda s, r: F.struct((s["n"] + F.greatest(F.lit(0), r["b"] - F.greatest(r["a"], s["end"]))).alias("n"), F.greatest(s["end"], r["b"]).alias("end"))
    n = F.aggregate("runs", F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end")), add, lambda s: s["n"])
    every = every.select("key", "n_words", n.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"))
    answer = every.select("key", F.struct("n_words", "n_hit", "n_items", "items_sha256", F.expr("n_hit > 0 and 20 * n_hit >= n_words").alias("contaminated")).alias("judged"))
    own = rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row"), F.sha2(F.coalesce("data", F.lit(b"")), 256).alias("key"))
    return join_hot(own, stored(answer, "judged"), "key", hot_keys(texts, "key")).select("row.*", "judged")


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id and the columns of SCHEMA, one row for each row of docs.

    A null or empty text has no words, no hits and the digest of the empty string. A very long text is scanned once, whole.
    Items without words match nothing; items with equal texts each count. Repeated rows are judged alike. An empty table
    gives an empty result. Other columns are not read."""
    own = docs.select("doc_id", F.encode("text", "utf-8").alias("data"))
    return judged(own, benchmark, width).select("doc_id", "judged.*")
