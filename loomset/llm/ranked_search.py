"""Ranked lexical search by Fagin's threshold algorithm over blocks of documents.

The index is the blocks of termblocks: of each document its terms with counts (the forward index), and per block a
dictionary with document frequencies. Numbers of the whole corpus (documents, terms, document frequencies) are added up
from the blocks. A block's inverted lists, of the terms that are asked for, are sorted by impact, the highest first.

A query goes down its lists in step: every new document that a list shows is looked up in the forward index and gets its
whole score. The threshold is what a document could score that no list has shown: the sum of the impacts where the lists
stand. Once it is strictly below the k-th best score, the search in the block ends. Lists are read some places at a time,
twice as many in each round. The k best found so far go on from block to block of a task, so that later blocks end sooner;
the k best of all tasks are merged by ranks, first in slices of tasks.

Queries are broadcast, which is checked: QUERY_BYTES of text at a time, each part of them in its own pass over the index.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import termblocks
from .common import stored, trim

BEST = 10
#: Bytes of the texts of the queries of one pass, about.
QUERY_BYTES = 4 << 20
#: Places of each list that the first round reads.
DEPTH = 16
#: Slices of tasks in which the best are merged first.
SLICES = 64
#: An impact is 10^9 tf / (1000 tf + 8 m), m = 100 - 90 + 90 n N / L; a weight is 1000 ln((2N + 2) / (2df + 1)).
SCALE, SATURATION, FLAT, SLOPE = 1_000_000_000, 8, 10, 90
#: An impact is below 2^20.
_IMPACT_BITS = 20


class Segment:
    """A block's postings of the terms that are asked for. `lists` are the postings by term and falling impact, those of term
    t from first[t] to first[t + 1]; the forward index has those of document d from row[d] to row[d + 1]."""

    def __init__(self, doc: np.ndarray, term: np.ndarray, tf: np.ndarray, m: np.ndarray, n_terms: int):
        self.term, self.impact = term, SCALE * tf // (1000 * tf + SATURATION * m[doc])
        self.row = np.searchsorted(doc, np.arange(len(m) + 1))
        order = np.argsort((term << _IMPACT_BITS) + ((1 << _IMPACT_BITS) - 1 - self.impact), kind="stable")
        self.list_doc, self.list_impact = doc[order], self.impact[order]
        self.first = np.searchsorted(term[order], np.arange(n_terms + 1))
        self.seen = np.zeros(len(m), bool)

    def look_up(self, docs: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Whole scores of documents, each of which has a posting, from the forward index."""
        a, n = self.row[docs], self.row[docs + 1] - self.row[docs]
        starts = np.cumsum(n) - n
        at = np.repeat(a - starts, n) + np.arange(int(n.sum()))
        return np.add.reduceat(weight[self.term[at]] * self.impact[at], starts)

    def search(self, terms: np.ndarray, weight: np.ndarray, best: Best, depth: int = DEPTH) -> int:
        """Takes up into `best` what the block has for a query of these terms, whose weights are not 0 and stand in `weight`.
        Returns how many documents it looked up."""
        first, size = self.first[terms], self.first[terms + 1] - self.first[terms]
        worth = weight[terms]
        at, looked, longest = 0, [], int(size.max()) if len(size) else 0
        while at < longest:
            end = np.minimum(size, at + depth)
            new = np.concatenate([self.list_doc[a + at : a + e] for a, e in zip(first.tolist(), end.tolist()) if e > at])
            new = np.unique(new[~self.seen[new]])
            if len(new):
                self.seen[new] = True
                looked.append(new)
                best.add(new, self.look_up(new, weight))
            at += depth
            left = np.flatnonzero(size > at)
            threshold = int((worth[left] * self.list_impact[first[left] + at - 1]).sum())
            if best.floor() > threshold:
                break
            depth *= 2
        for new in looked:
            self.seen[new] = False
        return sum(map(len, looked))


class Best:
    """The k best (score, id) of a query, equal scores by ascending id, rows without an id last. ids and none are of the block."""

    def __init__(self, k: int):
        self.k, self.score, self.id, self.none = k, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
        self.ids = self.nones = None

    def floor(self) -> int:
        """The k-th best score; -1 where there are fewer than k."""
        return int(self.score[-1]) if len(self.score) == self.k else -1

    def add(self, docs: np.ndarray, scores: np.ndarray) -> None:
        keep = np.flatnonzero((scores > 0) & (scores >= self.floor()))
        if not len(keep):
            return
        if len(keep) > 4 * self.k:  # those below the k-th of them are out
            keep = keep[scores[keep] >= np.partition(scores[keep], len(keep) - self.k)[len(keep) - self.k]]
        score, ids, none = np.append(self.score, scores[keep]), np.append(self.id, self.ids[docs[keep]]), np.append(self.none, self.nones[docs[keep]])
        order = np.lexsort((ids, none, -score))[: self.k]
        self.score, self.id, self.none = score[order], ids[order], none[order]


def _queries(items: DataFrame, passes: int, k: int) -> list[tuple[int, object, list[str]]]:
    """(row, item_id, distinct terms) of the items of pass k that have terms."""
    rows = items.where(F.pmod(F.xxhash64("row"), F.lit(passes)) == k).collect()
    own = ((r["row"], r["item_id"], sorted({w.decode() for w in termblocks.words(bytes(r["t"]))})) for r in rows)
    return [q for q in own if q[2]]


def _frequencies(index: DataFrame, names: list[str]) -> np.ndarray:
    """Of each term the documents that hold it, over all blocks; each task sends its sums."""
    held = index.sparkSession.sparkContext.broadcast(names)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, total = pa.array(held.value, pa.string()), np.zeros(len(held.value), np.int64)
        for batch in batches:
            at = pc.index_in(batch.column(0).flatten(), asked)
            hit = pc.is_valid(at).to_numpy(zero_copy_only=False)
            np.add.at(total, at.drop_null().to_numpy(), batch.column(1).flatten().to_numpy(zero_copy_only=False)[hit])
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["term", "df"])
        trim()

    out = np.zeros(len(names), np.int64)
    for r in index.select("terms", "df").mapInArrow(sums, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():
        out[r["term"]] = r["df"]
    return out


def _pass(index: DataFrame, asked: list[tuple[int, object, list[str]]], n_docs: int, n_terms: int, best: int) -> DataFrame:
    """(slice, row, doc_id, score): of each query the best of each task."""
    names = sorted({t for _, _, terms in asked for t in terms})
    place = {t: i for i, t in enumerate(names)}
    df = _frequencies(index, names)
    weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(d) + 1))) for d in df], np.int64)
    useful = (df > 0) & (weight > 0)
    wanted = [(row, np.array([place[t] for t in terms], np.int64)) for row, _, terms in asked]
    held = index.sparkSession.sparkContext.broadcast((names, weight, [(row, t[useful[t]]) for row, t in wanted]))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, weight, queries = held.value
        asked_terms, own = pa.array(names, pa.string()), np.zeros(len(names), np.int64)
        found = [Best(best) for _ in queries]
        for batch in batches:
            for terms, docs, data in zip(batch.column(0), batch.column(1), batch.column(2)):
                table = termblocks.docs_of(docs.as_py())
                n, distinct = table["n_terms"].to_numpy(), table["distinct"].to_numpy()
                doc, term, tf = termblocks.unpack(data.as_py(), distinct)
                at = pc.fill_null(pc.index_in(terms.values, asked_terms), -1).to_numpy(zero_copy_only=False).astype(np.int64)
                term = at[term] if len(at) else term
                keep = term >= 0
                whole, rest = divmod(SLOPE * n_docs, n_terms) if n_terms else (0, 0)
                m = FLAT + whole * n + rest * n // max(1, n_terms)  # 90 n N div L, where 90 n N may not fit 64 bits
                segment = Segment(doc[keep], term[keep], tf[keep], m, len(names))
                ids = pc.cast(table["doc_id"], pa.int64())
                nones = pc.is_null(ids).to_numpy()
                ids = pc.fill_null(ids, 0).to_numpy()
                for (_, t), mine in zip(queries, found):
                    own[t] = weight[t]
                    mine.ids, mine.nones = ids, nones
                    segment.search(t, own, mine)
                    own[t] = 0
                del doc, term, tf, keep, segment
        part = TaskContext.get().partitionId() % SLICES
        rows = [(part, row, None if none else int(i), int(s)) for (row, _), mine in zip(queries, found) for s, i, none in zip(mine.score, mine.id, mine.none)]
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kind) for c, kind in enumerate((pa.int32(), pa.int64(), pa.int64(), pa.int64()))], ["slice", "row", "doc_id", "score"])
        trim()

    return index.select("terms", "docs", "data").mapInArrow(search, "slice int, row long, doc_id long, score long")


def search(index: DataFrame, items: DataFrame, best: int = BEST) -> DataFrame:
    """(item_id, rank, doc_id, score): of each row of items (item_id, text) its best documents of the index, a table of
    termblocks.blocks with single words.

    Null texts and texts without a term find nothing, and so do terms that no document holds; null texts among the documents
    are never found and count in no number. Equal scores are ranked by ascending doc_id, rows without an id last; repeated
    rows of documents are found each, and of items each get their rows. An item or document may be of any length. Empty
    tables give an empty result. Other columns are not read."""
    spark = index.sparkSession
    own = items.where("text is not null").select(F.monotonically_increasing_id().alias("row"), "item_id", F.encode("text", "utf-8").alias("t"))
    own = stored(own, "items")
    total = index.agg(F.sum("n_docs").alias("n"), F.sum("n_terms").alias("l")).first()
    passes = max(1, -(-(own.agg(F.sum(F.octet_length("t"))).first()[0] or 0) // QUERY_BYTES))
    found = spark.createDataFrame([], "slice int, row long, doc_id long, score long")
    for k in range(passes):
        asked = _queries(own, passes, k)
        if asked and total["n"]:
            found = found.unionByName(_pass(index, asked, total["n"], total["l"], best)) if k else _pass(index, asked, total["n"], total["l"], best)
    order = [F.desc("score"), F.col("doc_id").asc_nulls_last()]
    top = lambda df, *by: df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= best)
    ranked = top(top(found, "row", "slice").drop("rank"), "row")
    return ranked.join(own.select("row", "item_id"), "row").select("item_id", "rank", "doc_id", "score")


def rank(docs: DataFrame, items: DataFrame, best: int = BEST) -> DataFrame:
    """search over an index of docs (doc_id, text) that is built for it."""
    return search(termblocks.blocks(docs), items, best)
