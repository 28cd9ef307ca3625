"""N-gram Jaccard join by signature trees, exact.

1. Each text becomes its set of hashed word shingles. The corpus-wide number of texts that hold a shingle comes back to
   each block of texts (see blockcount). It is counted by the first bits of the hash, as many as tell nearly all shingles
   apart: a number is never too small, and it is one for each hash, which is all that step 2 needs.
2. Prefix filter: of a set of n shingles in order of (that number, hash), a linked partner shares at least one of the
   first n - ceil(t n) + 1. Shingles that only one text holds can't be shared, so nearly all of these fall away, and
   passages that many texts share come last in the order, so that they seldom bring two texts together.
3. Sets that share such a shingle are joined to the smallest of them, and components of these edges are blocks: links
   lie inside blocks. A large block is dealt into parts, and every two parts are a block of their own.
4. In a block a signature tree is traversed against itself. Nodes hold OR-combined bitmaps of their sets, ranges of
   sizes and the most shingles that share bits of a bitmap; a pair of nodes is dropped when its maximum possible overlap
   is below what its sizes need, or when it is one component already. What is left is compared exactly.
5. Components of the links.

Equal sets are one set from step 3 on. No pairs within a group are emitted, only edges of a spanning forest.
"""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blockcount import Kinds, ask, counted, dealt, with_answers
from .common import discard, distinct, hot_keys, join_hot, mix, stored, trim, word_hashes

WORDS = 4
PERCENT = 85
#: A block of more sets than PART_SETS is dealt into up to PARTS parts, and one of more shingles into as many as it takes.
BLOCK_SHINGLES, PART_SETS, PARTS = 4_000_000, 128, 12
#: Bytes of text in a block of texts: a worker holds several arrays of a number for each word of a block.
BLOCK_BYTES = 3 << 20
#: Blocks of several parts whose numbers are broadcast.
BROADCAST_BLOCKS = 200_000
#: Bits by which counted hashes are longer than the length in bits of the number of bytes of all texts.
SPARE_BITS = 8
BITS, LEAF, FAN = 2048, 16, 4
PIECES = "kind int, doc_id long, row_text long, key binary, n long, token long, shingles binary"


def shingle_sets(texts: list[bytes | None], words: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, one after another, and their numbers."""
    h, n = word_hashes(texts)
    sets, at = [], 0
    for k in n.tolist():
        own = h[at : at + k]
        at += k
        if k >= words:
            s = own[: k - words + 1].copy()
            for j in range(1, words):
                s = mix(s * np.uint64(0x9E3779B97F4A7C15)) + own[j : k - words + 1 + j]
            s = np.unique(mix(s))
        elif k:
            s = own[:1].copy()
            for j in range(1, k):
                s = mix(s * np.uint64(0x9E3779B97F4A7C15)) + own[j : j + 1]
            s = mix(s + np.uint64(k))
        else:
            s = own
        sets.append(s)
    sizes = np.array([len(s) for s in sets], np.int64)
    return (np.concatenate(sets) if sets else np.zeros(0, np.uint64)), sizes


def set_key(s: np.ndarray) -> bytes:
    """128 bits of a set."""
    with np.errstate(over="ignore"):
        a, b = mix(s ^ np.uint64(0x8CB92BA72F3D8DD7)).sum(dtype=np.uint64), mix(s + np.uint64(0x2545F4914F6CDD1D)).sum(dtype=np.uint64)
    return int(a).to_bytes(8, "big") + int(b).to_bytes(8, "big")


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 |a & b| >= percent |a | b| of sorted distinct arrays."""
    if min(len(a), len(b)) * 100 < percent * max(len(a), len(b)):
        return False
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    both = int((b[at] == a).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


class SignatureTree:
    """A tree over sets: levels[0] are leaves of up to LEAF sets, and a node of level k + 1 has up to FAN of level k."""

    def __init__(self, sets: list[np.ndarray]):
        sizes = np.array([len(s) for s in sets], np.int64)
        low = np.array([s[0] if len(s) else 0 for s in sets], np.uint64)
        order = np.lexsort((low, (np.log2(np.maximum(sizes, 1)) * 4).astype(int)))  # sets of like sizes, then like first hashes
        self.sets, self.sizes, self.order = [sets[i] for i in order], sizes[order], order
        self.bits = np.zeros((len(sets), BITS // 64), np.uint64)
        for i, s in enumerate(self.sets):
            place = np.unique((s >> np.uint64(20)) % np.uint64(BITS)).astype(np.int64)
            np.bitwise_or.at(self.bits[i], place >> 6, np.uint64(1) << (place & 63).astype(np.uint64))
        self.lost = self.sizes - np.bitwise_count(self.bits).sum(1).astype(np.int64)  # shingles that share a bit
        n = np.arange(0, len(sets), LEAF)
        self.levels = [(np.bitwise_or.reduceat(self.bits, n, 0), np.minimum.reduceat(self.sizes, n), np.maximum.reduceat(self.sizes, n), np.maximum.reduceat(self.lost, n))]
        while len(self.levels[-1][1]) > 1:
            bits, least, most, lost = self.levels[-1]
            n = np.arange(0, len(least), FAN)
            self.levels.append((np.bitwise_or.reduceat(bits, n, 0), np.minimum.reduceat(least, n), np.maximum.reduceat(most, n), np.maximum.reduceat(lost, n)))

    def may_link(self, level: int, a: int, b: np.ndarray, percent: int) -> np.ndarray:
        """Of node a and nodes b of a level: whether sizes and maximum possible overlap allow a link."""
        bits, least, most, lost = self.levels[level]
        sizes = (100 * most[a] >= percent * least[b]) & (100 * most[b] >= percent * least[a])
        overlap = np.bitwise_count(bits[a] & bits[b]).sum(1).astype(np.int64) + np.minimum(lost[a], lost[b])
        return sizes & ((100 + percent) * overlap >= percent * (least[a] + least[b]))


def forest(sets: list[np.ndarray], percent: int, only_across: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that span the components of the sets. only_across: a side, 0 or 1, of each set; links are sought between sides."""
    if len(sets) < 2:
        return []
    tree = SignatureTree(sets)
    side = only_across[tree.order] if only_across is not None else None
    label, of = np.arange(len(sets)), {k: [k] for k in range(len(sets))}
    links = []
    top = len(tree.levels) - 1
    stack = [(top, 0, 0)]
    width = LEAF * FAN ** np.arange(len(tree.levels))
    while stack:
        level, a, b = stack.pop()
        ra, rb = slice(a * width[level], (a + 1) * width[level]), slice(b * width[level], (b + 1) * width[level])
        la, lb = label[ra], label[rb]
        if la[0] == lb[0] and (la == la[0]).all() and (lb == la[0]).all():
            continue
        if level:
            below = len(tree.levels[level - 1][1])
            nodes_b = np.arange(b * FAN, min(below, (b + 1) * FAN))
            for x in range(min(below, (a + 1) * FAN) - 1, a * FAN - 1, -1):
                ys = nodes_b[nodes_b >= x]
                if len(ys):
                    stack += [(level - 1, x, int(y)) for y in ys[tree.may_link(level - 1, x, ys, percent)][::-1]]
            continue
        for i in range(ra.start, min(ra.stop, len(sets))):
            js = np.arange(max(i + 1, rb.start), min(rb.stop, len(sets)))
            js = js[label[js] != label[i]]
            if side is not None:
                js = js[side[js] != side[i]]
            if not len(js):
                continue
            overlap = np.minimum(tree.sizes[i] - np.bitwise_count(tree.bits[i] & ~tree.bits[js]).sum(1).astype(np.int64), tree.sizes[js] - np.bitwise_count(tree.bits[js] & ~tree.bits[i]).sum(1).astype(np.int64))
            for j in js[(100 + percent) * overlap >= percent * (tree.sizes[i] + tree.sizes[js])].tolist():
                if label[i] != label[j] and linked(tree.sets[i], tree.sets[j], percent):
                    links.append((int(tree.order[i]), int(tree.order[j])))
                    more, less = sorted((int(label[i]), int(label[j])), key=lambda k: -len(of[k]))
                    label[of[less]] = more
                    of[more] += of.pop(less)
    return links


def components(edges: DataFrame) -> DataFrame:
    """(id, root) of edges (u, v): root is the smallest id of the component. Alternating large and small stars; each
    round is a written table, and rounds grow with the logarithm of the longest path."""
    both = lambda e: e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))

    def star(e: DataFrame, large: bool) -> DataFrame:
        near = both(e) if large else e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        out = near.join(least, "u")
        far = out.where("v > u") if large else out
        hooked = far.select(F.col("v").alias("u"), F.col("m").alias("v"))
        if not large:
            hooked = hooked.unionByName(least.select("u", F.col("m").alias("v")))
        return hooked.where("u <> v").distinct()

    spread = lambda e: e.agg(F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40)))).first()
    now = stored(edges.select("u", "v").where("u <> v").distinct(), "edges")
    mark = spread(now)
    while True:
        old, now = now, stored(star(star(now, True), False), "edges")
        discard(old)
        mark, last = spread(now), mark
        if mark == last:
            return now.select(F.col("u").alias("id"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct())


def _pieces(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """PIECES, written: kind 0 a row of docs, with its set where that may have a partner; kind 1 a shingle of a prefix
    that other texts hold too."""
    blocks, size = dealt(docs, BLOCK_BYTES)
    bits = min(64, max(32, size.bit_length() + SPARE_BITS))
    kinds: Kinds = [(64, 1), (bits, size // 6 + 1)]
    none = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def keys_of(ids: list, texts: list) -> list[tuple[np.ndarray, np.ndarray]]:
        return [none, np.unique(shingle_sets(texts, words)[0] >> np.uint64(64 - bits), return_counts=True)]

    def use(block: int, ids: list, texts: list, hashes: np.ndarray, answer: list) -> pd.DataFrame:
        every, sizes = shingle_sets(texts, words)
        _, which = distinct(every >> np.uint64(64 - bits))
        held = (np.bincount(which, minlength=len(answer[1][0])) + answer[1][0])[which]
        ends = np.cumsum(sizes)
        keys, keep, tokens, of = [], [], [], []
        done = set()
        for i, n in enumerate(sizes.tolist()):
            s, c = every[ends[i] - n : ends[i]], held[ends[i] - n : ends[i]]
            key = set_key(s) if n else None
            keys.append(key)
            keep.append(None)
            if n and key not in done:
                done.add(key)
                first = n - (percent * n + 99) // 100 + 1
                near = np.lexsort((s, c))[:first] if first < n else np.arange(n)
                shared = s[near[c[near] > 1]]
                if len(shared):
                    keep[-1] = s.tobytes()
                    tokens.append(shared.view(np.int64))
                    of.append(np.full(len(shared), i))
        of, tokens = np.concatenate(of or [np.zeros(0, np.int64)]), np.concatenate(tokens or [np.zeros(0, np.int64)])
        rows = pd.DataFrame({"kind": 0, "doc_id": pd.array(ids, "Int64"), "row_text": pd.array(hashes, "Int64"), "key": keys, "n": sizes, "token": pd.array([None] * len(ids), "Int64"), "shingles": keep})
        if not len(of):
            return rows
        blank = pd.array([None] * len(of), "Int64")
        return pd.concat([rows, pd.DataFrame({"kind": 1, "doc_id": blank, "row_text": blank, "key": np.array(keys, object)[of], "n": sizes[of], "token": pd.array(tokens, "Int64"), "shingles": None})])

    counts = counted(ask(blocks, keys_of, kinds), "shingles")
    pieces = stored(with_answers(blocks, [(counts, kinds)], use, PIECES), "pieces")
    discard(blocks, counts)
    return pieces


def join(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of docs.

    Texts of fewer words than a shingle are one shingle, the whole; null texts and texts without words have none and link
    with nothing, so that component_id is their own id. Equal texts link. Repeated rows stay and have the id's component.
    Rows without an id take part; component_id is the smallest id there is, null where the component has none. Other
    columns are not read. An empty table gives an empty result."""
    return members(docs, words, percent, block_shingles).select("doc_id", "n_shingles", "component_id")


def keepers(docs: DataFrame, **how) -> tuple[DataFrame, DataFrame]:
    """Tables of (doc_id, row_text): rows to drop so that of each component the row with the smallest id stays (rows
    without an id last, then by hash of the text), and rows that stay but are there more than once."""
    found = stored(members(docs, **how).where("root is not null").select("doc_id", "row_text", "root"), "members")
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_text")
    best = found.groupBy("root").agg(F.min(rank).alias("best"), F.count(F.lit(1)).alias("n")).where("n > 1")
    mine = F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("row_text") == F.col("best.row_text"))
    told = join_hot(found, stored(best, "best"), "root", hot_keys(found, "root"), "inner").groupBy("doc_id", "row_text", "root").agg(F.first(mine).alias("mine"), F.count(F.lit(1)).alias("n"))
    return told.where("not mine").select("doc_id", "row_text").distinct(), told.where("mine and n > 1").select("doc_id", "row_text")


def members(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """The columns of join(), row_text, a hash of the text, and root, a key of the component (null without words)."""
    pieces = _pieces(docs, words, percent)
    own = pieces.where("kind = 0")
    tokens = pieces.where("kind = 1").select("token", "key").distinct()
    firsts = tokens.groupBy("token").agg(F.min("key").alias("v"), F.max("key").alias("w")).where("v <> w").select("token", "v")
    near = tokens.join(firsts, "token").select(F.col("key").alias("u"), "v")
    near = components(near).select(F.col("id").alias("key"), F.col("root").alias("near"))
    sets = own.where("shingles is not null").select("key", "n", "shingles").dropDuplicates(["key"]).join(near, "key")
    sets = stored(sets, "sets")
    loads = sets.groupBy("near").agg(F.sum("n").alias("load"), F.count(F.lit(1)).alias("sets"))
    by_number = F.least(F.ceil(F.col("sets") / F.lit(PART_SETS)), F.lit(PARTS))
    loads = loads.select("near", F.greatest(by_number, F.ceil(F.col("load") / F.lit(block_shingles))).cast("int").alias("parts"))
    large = stored(loads.where("parts > 1"), "large")
    large = F.broadcast(large) if large.count() <= BROADCAST_BLOCKS else large
    sets = sets.join(large, "near", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    part = F.pmod(F.xxhash64("key"), F.col("parts")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda k: F.struct(F.least(k, part).alias("a"), F.greatest(k, part).alias("b")))
    dealt_sets = sets.select("near", "key", "shingles", part.alias("part"), F.explode(pairs).alias("p")).select("near", "p.a", "p.b", "part", "key", "shingles")

    def links(frame: pd.DataFrame) -> pd.DataFrame:
        got = [np.frombuffer(x, np.uint64) for x in frame["shingles"]]
        keys, a, b = list(frame["key"]), int(frame["a"].iloc[0]), int(frame["b"].iloc[0])
        side = None if a == b else (frame["part"].to_numpy() == b).astype(int)
        found = forest(got, percent, only_across=side)
        if len(got) > PART_SETS:
            trim()
        return pd.DataFrame([(keys[i], keys[j]) for i, j in found], columns=["u", "v"])

    edges = dealt_sets.groupBy("near", "a", "b").applyInPandas(links, "u binary, v binary")
    roots = components(edges).select(F.col("id").alias("key"), "root")
    ids = own.groupBy("key").agg(F.min("doc_id").alias("first")).where("key is not null")
    named = ids.join(roots, "key", "left").withColumn("root", F.coalesce("root", "key"))
    smallest = named.groupBy("root").agg(F.min("first").alias("component_id"))
    of = stored(named.join(smallest, "root").select("key", "root", "component_id"), "classes")
    out = own.select("doc_id", "row_text", F.col("n").alias("n_shingles"), "key")
    out = join_hot(out, of, "key", hot_keys(own.where("key is not null"), "key"))
    alone = F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "row_text", "n_shingles", "root", alone.alias("component_id"))
