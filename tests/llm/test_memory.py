"""What the pipeline holds beside the heap of an executor: batches, pages and arrays are bounded, and idle workers not started."""

import tracemalloc

import numpy as np
import pandas as pd
import pyarrow.parquet as pq
from pyspark.sql import functions as F

import corpus_pipeline
from loomset.llm import blockcount, common, language_id, mixing


def test_batches_of_long_rows(spark):
    """Rows of 1.5 MB, as blocks of texts are, go to a worker one at a time."""
    before = {k: spark.conf.get(k) for k in corpus_pipeline.BATCHES}
    try:
        corpus_pipeline._small_batches(spark)
        rows = spark.range(0, 6, 1, 1).select(F.repeat(F.lit("x"), 1_500_000).alias("data"))
        sizes = rows.mapInPandas(lambda frames: (pd.DataFrame({"n": [len(f)]}) for f in frames), "n long").collect()
        assert [r.n for r in sizes] == [1] * 6
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_plan_of_mixing_needs_no_workers(spark, docs):
    sized = docs.select("doc_id", "source", mixing.size_column().alias("size"))
    assert "ExistingRDD" not in mixing.mix(sized)._jdf.queryExecution().toString()
    assert common.small_table(spark, [], "s string, n long").collect() == []
    assert [tuple(r) for r in common.small_table(spark, [(None, 1, 0.5), ("a", None, None)], "s string, n long, x double").collect()] == [(None, 1, 0.5), ("a", None, None)]


def test_blocks_are_not_compressed_twice(spark, docs):
    blocks, _ = blockcount.dealt(docs)
    files = [f.removeprefix("file://").removeprefix("file:") for f in blocks.inputFiles()]
    found = {pq.ParquetFile(f).metadata.row_group(0).column(2).compression for f in files}
    assert found == {"UNCOMPRESSED"}


def test_groups_of_pieces():
    """Short texts are taken in small groups, long ones in the same pieces as ever; grouping changes no digit."""
    texts = ["a few words of text " * 100] * 300 + ["long " * 120_000, "x" * 600_000, ""]
    groups = list(language_id._pieces(texts))
    assert max(sum(map(len, parts)) for _, parts in groups if max(map(len, parts)) < 10_000) < (1 << 16) + 10_000
    assert max(len(p) for _, parts in groups for p in parts) == 1 << 18
    assert ["".join(p for which, parts in groups for i, p in zip(which, parts) if i == k) for k in range(len(texts))] == texts


def _frame(blocks: int, keys: int) -> tuple[pd.DataFrame, list, list]:
    rng = np.random.default_rng(1)
    asked = [np.unique(rng.integers(0, 3 * keys, keys).astype(np.uint64) << np.uint64(20)) for _ in range(blocks)]
    own = [rng.integers(0, 3, len(x)) for x in asked]
    return pd.DataFrame({"block": range(blocks), "part": 0, "keys": [common.pack_sorted(x) for x in asked], "own": [common.pack_counts(x) for x in own]}), asked, own


def test_add_of_a_range():
    """Counts of a range by brute force, and the arrays that are held at once: below 10 of all its keys."""
    frame, asked, own = _frame(5, 40)
    told = {int(r.block): r.counts for r in blockcount._add(frame).itertuples()}
    for b, keys in enumerate(asked):
        got = common.unpack_counts(told[b])
        for k, key in enumerate(keys):
            others = [(c, int(own[c][asked[c] == key][0])) for c in range(5) if c != b and key in asked[c]]
            lead = own[b][k] > 0 and not any(n for c, n in others if c < b)
            assert got[k] == 4 * sum(n for _, n in others) + 2 * bool(others) + lead
    every = np.unique(np.concatenate(asked))
    sums = [sum(int(own[c][asked[c] == key].sum()) for c in range(5)) for key in every]
    assert np.frombuffer(told[-1], "<i8").tolist() == [sum(n > 0 for n in sums), sum(sums)]

    frame, asked, _ = _frame(10, 50_000)
    blockcount._add(frame)  # what is made once
    tracemalloc.start()
    blockcount._add(frame)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 10 * 8 * sum(map(len, asked)), peak / (8 * sum(map(len, asked)))
