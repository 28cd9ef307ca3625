"""The pipeline's stages on small tables, and the SQL of the operators that have one."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest

import corpus_pipeline
from loomset.llm import decontamination, language_id, queries

from .test_operators import join_brute, jump_brute, mix_brute, tokens, windows_brute


def same(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return math.isclose(a, b, rel_tol=1e-12)
    return a == b


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, sf, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark", "pages"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
    want = con.execute(queries.oracle_sql()[name])
    columns = sorted(d[0] for d in want.description)
    order = [[d[0] for d in want.description].index(c) for c in columns]
    want = sorted((tuple(r[k] for k in order) for r in want.fetchall()), key=repr)
    got = queries.queries()[name](spark, sf)
    assert sorted(got.columns) == columns
    got = sorted((tuple(r) for r in got.select(*columns).collect()), key=repr)
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert all(map(same, a, b)), (a, b)


def test_stages(spark, corpus, sf):
    docs, kept = corpus, {r.doc_id: r for r in corpus.collect()}
    stages = dict(corpus_pipeline.STAGES)
    assert len(corpus_pipeline.STAGES) == 5
    named = stages["language ID"](spark, docs, sf)
    assert named.columns == docs.columns
    assert {r.doc_id for r in named.collect()} == {r.doc_id for r in language_id.identify(docs).collect() if not r.rejected}

    distinct = stages["n-gram Jaccard join"](spark, docs, sf)
    assert distinct.columns == docs.columns
    want = {i for i, _, c in join_brute([(i, r.text) for i, r in kept.items()]) if c == i}
    assert Counter(r.doc_id for r in distinct.collect()) == Counter(want)

    clean = stages["benchmark decontamination"](spark, docs, sf)
    assert clean.columns == docs.columns
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert {r.doc_id for r in clean.collect()} == {r[0] for r in windows_brute([(i, r.text) for i, r in kept.items()], items) if not r[-1]}

    mixed = stages["mixing sources to target weights"](spark, docs, sf)
    assert mixed.columns == docs.columns
    sizes = {i: len(tokens(r.text)) for i, r in kept.items()}
    _, target = mix_brute([(i, r.source, sizes[i]) for i, r in kept.items()])
    rows = mixed.collect()
    assert max(Counter(r.doc_id for r in rows).values()) <= 2
    taken = Counter()
    for r in rows:
        assert r == kept[r.doc_id]
        taken[r.source] += sizes[r.doc_id]
    for s, t in target.items():
        assert abs(taken[s] - t) <= max(sizes[i] for i, r in kept.items() if r.source == s) / 2 + 1


def test_edge_rows(spark, docs, sf):
    """Nulls, repeated rows and clashing names pass through each stage."""
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, sf)
        assert got.columns == docs.columns, name
        assert stage(spark, docs.limit(0), sf).count() == 0
    left = Counter(r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, sf).collect())
    assert left == Counter({1: 1, 3: 1, 4: 1, 5: 1, 6: 1, 7: 1, 8: 1, 9: 1, 10: 1, None: 1})
    twice = docs.where("doc_id = 11").unionByName(docs.where("doc_id is null"))
    assert Counter(r.doc_id for r in corpus_pipeline.drop_near_copies(spark, twice, sf).collect()) == Counter({11: 1, None: 1})


def pipeline_brute(docs, items, model):
    """All stages over rows in lists; the classifier is the one that the stage trains."""
    rejected = model.judge([r.text for r in docs])[2]
    docs = [r for r, no in zip(docs, rejected) if not no]
    docs = [r for r, (i, _, c) in zip(docs, join_brute([(r.doc_id, r.text) for r in docs])) if i == c]
    docs = [r for r, x in zip(docs, windows_brute([(r.doc_id, r.text) for r in docs], items)) if not x[-1]]
    sizes = {r.doc_id: len(tokens(r.text)) for r in docs}
    total, target = mix_brute([(r.doc_id, r.source, sizes[r.doc_id]) for r in docs])
    rows = []
    for s, n in total.items():
        whole = int(target[s] // n) if n else 0
        room = math.floor(target[s] - whole * n + 0.5)
        for r in sorted((r for r in docs if r.source == s), key=lambda r: hashlib.md5(f"mix-1:{r.doc_id}".encode()).hexdigest()):
            more = max(0, min(sizes[r.doc_id], room))
            room -= sizes[r.doc_id]
            rows += [r] * (whole + (2 * more >= max(sizes[r.doc_id], 1)))
    text = lambda r: (r.text or "").encode()
    return Counter((r.doc_id, len(text(r)) + 8, zlib.crc32(text(r)), "key", jump_brute(r.doc_id, 24), jump_brute(r.doc_id, 25)) for r in rows)


def test_run(spark, corpus, sf):
    rows = corpus_pipeline.run(spark, sf).collect()
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    want = pipeline_brute(corpus.collect(), items, language_id.train(language_id.sample(corpus)))
    assert Counter((r.doc_id, r.size, r.text_crc32, r.law, r.shard, r.grown_shard) for r in rows) == want
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_shard_stage(spark, docs, sf):
    got = corpus_pipeline.shard(spark, docs, sf)
    assert got.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    rows = got.collect()
    assert len(rows) == docs.count() and {r.doc_id: r.shard for r in rows}[None] == jump_brute("null", 24)
    assert all(r.shard == jump_brute(r.doc_id, 24) for r in rows if r.doc_id is not None)
    assert corpus_pipeline.shard(spark, docs.limit(0), sf).count() == 0


def test_decontamination_in_passes(spark, corpus, docs, sf, monkeypatch):
    bench = spark.read.parquet(f"{sf}/benchmark.parquet").unionByName(spark.createDataFrame([(901, "the DOG that"), (902, "looked at the dog that was there"), (903, "the dog that")], "item_id long, text string"))
    whole = [sorted(map(tuple, decontamination.decontaminate(t, bench).collect()), key=repr) for t in (corpus, docs)]
    monkeypatch.setattr(decontamination, "ITEM_BYTES", 2000)
    assert decontamination.passes_of(bench) > 2
    assert [sorted(map(tuple, decontamination.decontaminate(t, bench).collect()), key=repr) for t in (corpus, docs)] == whole
