"""Ranked search, toxicity and importance resampling against brute force, on small tables with every odd case."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from loomset.llm import queries, ranked_search, resampling, termblocks, toxicity

ITEMS = [
    (1, "the cat and the DOG of the house"),
    (2, "Katze, Hund! haus"),
    (3, None),
    (4, " \n+"),
    (5, "zzz nobody has this"),
    (2, "Katze, Hund! haus"),
    (None, "word of the long text"),
]


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(i, t, 3, "x") for i, t in ITEMS], "item_id long, text string, rank int, doc_id string")


def own_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


# -- blocks of terms


@pytest.mark.parametrize("most", [1, 2, 3])
def test_blocks_hold_every_count(docs, corpus, most):
    rows = corpus.select("doc_id", "text").limit(60).collect() + docs.select("doc_id", "text").collect()
    table = corpus.sparkSession.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    found = []
    blocks = termblocks.blocks(table, most, block_bytes=20_000).collect()
    assert len(blocks) > 3
    for b in blocks:
        frame = termblocks.docs_of(b["docs"])
        doc, term, tf = termblocks.unpack(b["data"], frame["distinct"].to_numpy())
        own = [Counter() for _ in range(frame.num_rows)]
        for d, t, n in zip(doc.tolist(), term.tolist(), tf.tolist()):
            own[d][b["terms"][t]] += n
        found += [(None if i is None else int(i), n, c) for i, n, c in zip(frame["doc_id"].to_pylist(), frame["n_words"].to_pylist(), own)]
        assert b["df"] == [sum(t in c for c in own) for t in b["terms"]] and b["cf"] == [sum(c[t] for c in own) for t in b["terms"]]
        assert b["n_docs"] == sum(bool(c) for c in own) and b["n_terms"] == sum(b["cf"])
    want = []
    for i, text in rows:
        w = own_words(text)
        want.append((i, len(w), Counter(" ".join(w[k : k + n]) for n in range(1, most + 1) for k in range(len(w) - n + 1))))
    order = lambda x: (str(x[0]), x[1], sorted(x[2].items()))
    assert sorted(found, key=order) == sorted(want, key=order)


# -- 11: ranked search


def ranked(docs, items, best=10):
    counts = [(i, Counter(own_words(t))) for i, t in docs]
    n_docs, n_terms = sum(bool(c) for _, c in counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c in counts:
            m = 100 - 90 + 90 * sum(c.values()) * n_docs // max(1, n_terms)
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in set(own_words(text)) if c[t])
            scored += [(-score, i is None, i)] * (score > 0)
        out += [(item, k, i, -s) for k, (s, _, i) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:best], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("block_bytes,query_bytes,best", [(12 << 20, 4 << 20, 10), (50, 60, 3), (300, 1, 1)])
def test_search(spark, docs, items, monkeypatch, block_bytes, query_bytes, best):
    monkeypatch.setattr(ranked_search, "QUERY_BYTES", query_bytes)
    index = termblocks.blocks(docs, block_bytes=block_bytes)
    found = sorted((tuple(r) for r in ranked_search.search(index, items, best).collect()), key=str)
    assert found == ranked([(r["doc_id"], r["text"]) for r in docs.collect()], ITEMS, best)


def test_search_query_over_its_table(spark, corpus, sf):
    found = sorted((tuple(r) for r in queries.op11_ranked_search(spark, sf).collect()), key=str)
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert found == ranked([(r["doc_id"], r["text"]) for r in corpus.collect()], items)


def test_search_of_nothing(docs, no_docs, items):
    assert ranked_search.rank(no_docs, items).collect() == []
    assert ranked_search.rank(docs, items.limit(0)).columns == ["item_id", "rank", "doc_id", "score"]
    assert ranked_search.rank(docs, items.limit(0)).collect() == []


def _segment(rng, n_docs, n_terms, size):
    """Random postings: terms of falling frequency."""
    pairs = np.unique(np.minimum(rng.zipf(1.3, n_docs * size) - 1, n_terms - 1) + rng.integers(0, n_docs, n_docs * size) * n_terms)
    doc, term = pairs // n_terms, pairs % n_terms
    tf, m = rng.integers(1, 6, len(doc)), rng.integers(10, 400, n_docs)
    df = np.bincount(term, minlength=n_terms)
    weight = np.floor(1000 * np.log((2 * n_docs + 2) / (2 * df + 1))).astype(np.int64)
    return ranked_search.Segment(doc, term, tf, m, n_terms), doc, term, ranked_search.SCALE * tf // (1000 * tf + 8 * m[doc]), weight, df


@pytest.mark.parametrize("seed", range(4))
def test_threshold_ends_a_search_early_and_loses_nothing(seed):
    rng = np.random.default_rng(seed)
    segment, doc, term, impact, weight, df = _segment(rng, 5000, 400, 30)
    looked = reached = 0
    for _ in range(20):
        terms = rng.choice(np.flatnonzero((df > 0) & (weight > 0)), 6, replace=False)
        own = np.zeros(400, np.int64)
        own[terms] = weight[terms]
        best = ranked_search.Best(10)
        best.ids, best.nones = np.arange(5000) // 2 * 3, np.zeros(5000, bool)  # pairs of equal ids
        looked += segment.search(terms, own, best, depth=4)
        total = np.zeros(5000, np.int64)
        np.add.at(total, doc, own[term] * impact)
        reached += int((total > 0).sum())
        want = sorted((-int(s), int(i)) for s, i in zip(total, best.ids) if s > 0)[:10]
        assert list(zip((-best.score).tolist(), best.id.tolist())) == want
        assert not segment.seen.any()
    assert looked < 0.8 * reached


def test_equal_scores_at_the_border_go_to_the_smallest_ids():
    doc = np.arange(100)
    segment = ranked_search.Segment(doc, np.zeros(100, np.int64), np.ones(100, np.int64), np.full(100, 50), 1)
    best = ranked_search.Best(5)
    best.ids, best.nones = 1000 - doc, doc == 97
    segment.search(np.array([0]), np.array([7]), best, depth=1)
    assert best.id.tolist() == [901, 902, 904, 905, 906]  # 903 is the row without an id


# -- 12: toxicity

MEAN, KIND = ["idiot", "moron", "clown"], ["house", "garden", "river", "window", "letter", "summer", "market", "bridge"]


def spoken(rng, toxic, n=60):
    w = [str(x) + "abc"[k % 3] for k, x in enumerate(rng.choice(KIND, n))]
    for k in rng.choice(n, 4 if toxic else 0, replace=False):
        w[k] = str(rng.choice(MEAN))
    return " ".join(w)


@pytest.fixture(scope="module")
def talk(spark):
    rng = np.random.default_rng(5)
    rows = [(i, i % 5 < 2, spoken(rng, i % 5 < 2)) for i in range(400)]
    docs = spark.createDataFrame([(i, t, "en", "toxic", None) for i, _, t in rows] + [(None, "you idiot moron clown", "x", "y", 1), (900, None, "en", "a", 1), (901, "", "en", "a", 1), (902, "+ !", "en", "a", 1), (903, "the river " * 50_000 + "moron clown idiot " * 3000, "en", "a", 1), (903, "the river", "en", "a", 1)], "doc_id long, text string, lang string, source string, score long")
    labels = spark.createDataFrame([(i, 1, int(y)) for i, y, _ in rows] + [(7, 0, None), (None, 1, 1), (5000, 1, 1), (8, 1, 7)], "doc_id long, quality int, toxic int")
    return docs, labels, {i: y for i, y, _ in rows}


def test_toxicity(talk):
    docs, labels, truth = talk
    rows = toxicity.score(docs, labels).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert r["held_out"] == (r["doc_id"] is None or zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
    held = [r for r in rows if r["held_out"] and r["doc_id"] in truth]
    assert len(held) > 50 and all(r["predicted"] == truth[r["doc_id"]] for r in held)
    other = {r["doc_id"]: r for r in rows if r["doc_id"] is None or r["doc_id"] in (900, 901, 902)}
    assert other[None]["predicted"] == 1 and [other[i]["evidence"] for i in (900, 901, 902)] == [0.0] * 3
    assert len({other[i]["score"] for i in (900, 901, 902)}) == 1 and other[900]["predicted"] == 0
    assert sorted(r["predicted"] for r in rows if r["doc_id"] == 903) == [0, 1]  # the long one whole, the short one for itself
    assert rows and sorted(map(tuple, toxicity.score(docs.repartition(7), labels).collect()), key=str) == sorted(map(tuple, rows), key=str)


def test_toxicity_counts_are_of_different_words_before(spark):
    texts = [("a b a b a b c", 0), ("a b a b a b c", 2), ("c b", 3)]
    rows = {(r["level"], r["history"], r["key"]): r.asDict() for r in toxicity.count(spark.createDataFrame(texts, "text string, slot int")).collect()}
    every = toxicity.FOLDS
    n = lambda level, history, key, m=every: (rows[level, history, key][f"n{m}0"], rows[level, history, key][f"n{m}1"])
    assert n(1, "", "b") == (1, 1) and n(1, "", "a") == (2, 0) and n(1, "", "c") == (1, 1)
    assert n(0, "a", "b") == (2, 0)  # after the beginning, and after b
    assert n(0, "a", "b", m=0) == (2, 0) and n(1, "", "c", m=1) == (1, 0) and n(0, "c", "b", m=1) == (0, 0)


def test_toxicity_by_brute_force(talk, spark):
    """Models and evidence as they are written down, from the same sample."""
    docs, labels, _ = talk
    sample, share = toxicity.sampled(docs, labels)
    texts = [(r["text"], r["slot"] % 2) for r in sample.collect()]
    before, pair = [{}, {}], [{}, {}]
    for t, c in texts:
        w = re.findall(r"\w+", t.lower())
        for x, h, v in zip(["", "", *w], ["", *w], w):
            before[c].setdefault(v, set()).add(h)
            pair[c].setdefault((h, v), set()).add(x)
    n = [{v: len(s) for v, s in b.items()} for b in before]
    both = [{k: len(s) for k, s in p.items()} for p in pair]
    vocabulary, total = set(n[0]) | set(n[1]), [sum(x.values()) for x in n]
    pairs = set(both[0]) | set(both[1])

    def told(a, b, x, y, kinds):
        if not (x and y):
            return False
        g = 2 * sum(k * math.log(k * (x + y) / ((a + b) * m)) for k, m in ((a, x), (b, y)) if k)
        here, there = (b + 0.5) * x, (a + 0.5) * y
        return g >= 2 * math.log(10 * kinds) and max(here, there) >= 3 * min(here, there)

    word = {}
    for v in vocabulary:
        a, b = n[0].get(v, 0), n[1].get(v, 0)
        if told(a, b, *total, len(vocabulary)):
            rest = 0.75 * len(vocabulary) / sum(total) * (a + b) / sum(total)
            word[v] = (max(a - 0.75, 0) / total[0] + rest, max(b - 0.75, 0) / total[1] + rest)
    ratio = {v: math.log(p[1] / p[0]) for v, p in word.items()}
    phrase = {}
    for h, v in pairs:
        a, b = both[0].get((h, v), 0), both[1].get((h, v), 0)
        follow = {k for k in pairs if k[0] == h}
        x, y = (sum(s.get(k, 0) for k in follow) for s in both)
        if told(a, b, x, y, len(pairs)):
            low = word.get(v, ((a + b) / (x + y),) * 2)
            gamma = 0.75 * len(follow) / (x + y)
            phrase[h, v] = math.log((max(b - 0.75, 0) / y + gamma * low[1]) / (max(a - 0.75, 0) / x + gamma * low[0]))
    model, curve = toxicity.train(docs, labels)
    assert set(MEAN) <= set(ratio)
    assert model.levels[1] == pytest.approx(ratio) and model.levels[0] == pytest.approx(phrase)
    for r in toxicity.score(docs, labels).where("length(text) < 1000").collect():
        text = docs.where(docs["doc_id"].eqNullSafe(r["doc_id"])).orderBy("score").first()["text"] if r["doc_id"] in (None, 4, 9, 11) else None
        if text:
            w = re.findall(r"\w+", text.lower())
            want = sum(phrase.get((h, v), ratio.get(v, model.ratio(v))) for h, v in zip(["", *w], w)) / len(w)
            assert r["evidence"] == pytest.approx(want) and r["score"] == pytest.approx(float(curve.score(np.array([want]))[0]))


@pytest.mark.parametrize("scale,least,false", [("sf0.01", 0.99, 0), ("sf0.1", 0.92, 0.01)])
def test_toxicity_on_held_out_labels(spark, scale, least, false):
    d = f"/root/testdata/{scale}"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    rows = queries.op12_toxicity(spark, d).where("held_out").join(labels, "doc_id").collect()
    toxic = [r["predicted"] for r in rows if r["toxic"]]
    clean = [r["predicted"] for r in rows if not r["toxic"]]
    assert sum(toxic) >= least * len(toxic) and sum(clean) <= false * len(clean), (sum(toxic), len(toxic), sum(clean), len(clean))


def test_toxicity_without_a_class_or_rows(spark, docs, no_docs):
    labels = spark.createDataFrame([(1, 0), (2, 0), (3, 0)], "doc_id long, toxic int")
    assert {(r["score"] < 1e-6, r["predicted"]) for r in toxicity.score(docs, labels).collect()} == {(True, 0)}
    assert toxicity.score(docs, labels.limit(0)).count() == docs.count()
    assert toxicity.score(no_docs, labels).collect() == []


# -- 13: importance resampling


def resampled(docs, target, most=1, buckets=10_000, percent=10, least=20):
    grams = lambda w: [" ".join(w[k : k + n]) for n in range(1, most + 1) for k in range(len(w) - n + 1)]
    bucket = lambda g: zlib.crc32(g.encode()) % buckets
    own = [(i, own_words(t)) for i, t in docs]
    s = Counter(bucket(g) for _, w in own for g in grams(w))
    t = Counter(bucket(g) for text in target for g in grams(own_words(text)))
    a, b = sum(s.values()), sum(t.values())
    gain = {k: math.floor(1000 * math.log((t[k] + 1) * (a + buckets) / ((s[k] + 1) * (b + buckets)))) for k in s}
    rows = []
    for i, w in own:
        weight = sum(gain[bucket(g)] for g in grams(w))
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(grams(w)), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(w)])
    fit = sorted((r for r in rows if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(fit[: percent * len(fit) // 100], 1):
        r[4] = k
    return sorted((tuple(r[:5]) for r in rows), key=str)


@pytest.mark.parametrize("most", [1, 2])
def test_resampling(spark, docs, items, monkeypatch, most):
    monkeypatch.setattr(resampling, "PERCENT", 50)
    source = docs.withColumnRenamed("size", "score").withColumnRenamed("shard", "rank")
    found = sorted((tuple(r) for r in resampling.resample(source, items, most).collect()), key=str)
    assert found == resampled([(r["doc_id"], r["text"]) for r in docs.collect()], [t for _, t in ITEMS], most)


def test_resampling_query_over_its_table(spark, corpus, sf):
    found = sorted((tuple(r) for r in queries.op13_importance_resampling(spark, sf).collect()), key=str)
    target = [r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert found == resampled([(r["doc_id"], r["text"]) for r in corpus.collect()], target)
    assert sum(r[4] is not None for r in found) > 5


@pytest.mark.parametrize("slice_rows", [1, 7, 1000])
def test_draw_in_slices(spark, slice_rows):
    rng = np.random.default_rng(slice_rows)
    rows = [(int(i) if i else None, int(n), int(s)) for i, n, s in zip(rng.integers(0, 300, 500), rng.integers(10, 40, 500), rng.integers(-20, 20, 500))]
    found = resampling.draw(spark.createDataFrame(rows, "doc_id long, n_words long, score long"), 30, 20, slice_rows)
    fit = sorted((r for r in rows if r[1] >= 20), key=lambda r: (-r[2], r[0] is None, r[0] or 0))
    got = sorted(((r["rank"], r["score"], r["doc_id"]) for r in found.collect() if r["rank"]))
    assert got == [(k, r[2], r[0]) for k, r in enumerate(fit[: 30 * len(fit) // 100], 1)] and found.count() == len(rows)


def test_resampling_of_nothing(docs, no_docs, items):
    assert resampling.resample(no_docs, items).collect() == []
    rows = resampling.resample(docs, items.limit(0)).collect()
    assert len(rows) == docs.count() and all(r["rank"] is None or r["n_features"] >= 20 for r in rows)


def test_each_string_is_hashed_once(spark, docs, items):
    """The dictionary has a row for each distinct string, whatever many blocks and documents hold it."""
    source, target = termblocks.blocks(docs, block_bytes=50), termblocks.blocks(items.select("doc_id", "text"))
    rows = resampling.dictionary(source, target).collect()
    own, aim = Counter(), Counter()
    for r in docs.collect():
        own.update(own_words(r["text"]))
    for _, t in ITEMS:
        aim.update(own_words(t))
    assert sorted((r["term"], r["bucket"], r["in_source"], r["in_target"]) for r in rows) == sorted((t, zlib.crc32(t.encode()) % 10_000, own[t], aim[t]) for t in {*own, *aim})
