"""Near copies by hash: pairs, greedy groups, ranks in groups and decisions on groups."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import hamming, rank_key, rank_order
from ..schema import BACKUP, IGNORED_GROUP, PICKED, REJECTED
from ..storage import cut

BANDS_UP_TO = 12
#: Rows and edges, of some 20 bytes, that one task settles.
TAIL_EDGES = 1_000_000
#: Hashes of a block that is compared whole with others, and fewest blocks of many hashes; pairs that are in hand at once.
BLOCK, LEAST_BLOCKS, PAIRS = 32_768, 16, 500_000
#: Rows that are settled in order before all others are held against their anchors.
AHEAD = 16_384


def numbered(df: DataFrame, *order: str) -> DataFrame:
    """df with `number`, from 1 in order: rows are numbered inside ranges, and ranges by their counts."""
    ranges = cut(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    counts = ranges.groupBy("_range").count()  # one row a partition
    first = counts.select("_range", F.coalesce(F.sum("count").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_first"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return ranges.withColumn("_k", inside).join(F.broadcast(first), "_range").withColumn("number", (F.col("_first") + F.col("_k")).cast("long")).drop("_range", "_k", "_first")


def hamming_pairs(rows: DataFrame, threshold: int) -> DataFrame:
    """(a, b, distance) of rows (id, phash) with a < b and at most `threshold` bits apart; hash 0 is none.

    Pairs are between the smallest ids of different hashes, and of each copy with the smallest id of its hash. Two hashes within t bits agree in one of t + 1 bands of bits. Up to BANDS_UP_TO
    bands are joined on; above that bands are so narrow that most pairs would agree in one, and blocks of hashes are compared whole."""
    own = rows.where("phash <> 0").select("id", "phash")
    firsts = own.groupBy("phash").agg(F.min("id").alias("first"))
    copies = own.join(firsts, "phash").where("id <> first").select(F.col("first").alias("a"), F.col("id").alias("b"), F.lit(0).alias("distance"))
    if threshold > BANDS_UP_TO:
        return _blockwise(firsts, threshold).unionByName(copies)
    hashes = firsts.select("phash")
    n = threshold + 1
    edges = [round(64 * k / n) for k in range(n + 1)]
    band = lambda k: F.shiftrightunsigned(F.col("phash"), edges[k]).bitwiseAND((1 << (edges[k + 1] - edges[k])) - 1 if edges[k + 1] - edges[k] < 64 else -1)
    keyed = hashes.select("phash", F.posexplode(F.array(*[band(k) for k in range(n)])).alias("k", "v"))
    left, right = keyed.select(F.col("phash").alias("p"), "k", "v"), keyed.select(F.col("phash").alias("q"), "k", "v")
    near = left.join(right, ["k", "v"]).where((F.col("p") < F.col("q")) & (hamming(F.col("p"), F.col("q")) <= threshold)).select("p", "q").distinct()
    apart = near.join(firsts.select(F.col("phash").alias("p"), F.col("first").alias("x")), "p").join(firsts.select(F.col("phash").alias("q"), F.col("first").alias("y")), "q")
    apart = apart.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), hamming(F.col("p"), F.col("q")).cast("int").alias("distance"))
    return apart.unionByName(copies)


def _blockwise(firsts: DataFrame, threshold: int) -> DataFrame:
    """(a, b, distance) of (phash, first) with different hashes: a task compares two blocks, a tile at a time."""
    kept = cut(firsts, "hashes")
    n = kept.count()
    blocks = max(-(-n // BLOCK), min(LEAST_BLOCKS, -(-n // 1024)), 1)
    block = F.pmod(F.xxhash64("phash"), F.lit(blocks)).cast("int")
    listed = cut(kept.groupBy(block.alias("i")).agg(F.collect_list("phash").alias("h"), F.collect_list("first").alias("x")), "blocks")
    left = listed.select("i", "h", "x", F.explode(F.sequence("i", F.lit(blocks - 1))).alias("j"))
    both = left.join(listed.select(F.col("i").alias("j"), F.col("h").alias("g"), F.col("x").alias("y")), "j")
    kind = dict(firsts.dtypes)["first"]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, g = (batch.column(batch.schema.get_field_index(c)) for c in "hg")
            x, y = (batch.column(batch.schema.get_field_index(c)) for c in "xy")
            for k, same in enumerate(np.equal(batch.column(batch.schema.get_field_index("i")), batch.column(batch.schema.get_field_index("j")))):
                p, q = (c[k].values.to_numpy().view(np.uint64) for c in (h, g))
                found, held = [], 0
                for u in range(0, len(p), 256):
                    for v in range(u if same else 0, len(q), 2048):
                        apart = np.bitwise_count(p[u : u + 256, None] ^ q[None, v : v + 2048])
                        hit = apart <= threshold
                        if same:
                            hit &= np.arange(v, v + hit.shape[1]) > np.arange(u, u + hit.shape[0])[:, None]
                        r, c = np.nonzero(hit)
                        found.append((r + u, c + v, apart[r, c]))
                        held += len(r)
                        if held >= PAIRS:
                            yield pairs(found, x[k].values, y[k].values)
                            found, held = [], 0
                if held:
                    yield pairs(found, x[k].values, y[k].values)

    def pairs(found: list, x: pa.Array, y: pa.Array) -> pa.RecordBatch:
        r, c, apart = (np.concatenate(v) for v in zip(*found))
        return pa.RecordBatch.from_arrays([x.take(pa.array(r)), y.take(pa.array(c)), pa.array(apart.astype(np.int32))], ["x", "y", "distance"])

    every = both.repartition(max(1, min(blocks * (blocks + 1) // 2, 2048)), "i", "j").mapInArrow(compare, f"x {kind}, y {kind}, distance int")
    return every.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "distance")


def adjacent_pairs(rows: DataFrame, threshold: int, degrees: float = 25.0) -> DataFrame:
    """J9's second way to be close: same source and scale, hashes, yaw and pitch near. Rows are joined on cells of yaw and
    pitch with their neighbours, so that a source and scale, however large, is not joined with itself whole."""
    own = rows.where("phash <> 0").select("id", "phash", "source", "person_scale", "yaw", "pitch")
    own = own.withColumns({"cell_yaw": F.floor(F.col("yaw") / degrees), "cell_pitch": F.floor(F.col("pitch") / degrees)})
    around = lambda c: F.explode(F.array(*[F.col(c) + k for k in (-1, 0, 1)]))
    probe = own.withColumn("cell_yaw", around("cell_yaw")).withColumn("cell_pitch", around("cell_pitch"))
    side = lambda t, s: t.select(*[F.col(c).alias(c + s) for c in own.columns])
    a, b = side(own, "_a"), side(probe, "_b")
    on = [F.col(c + "_a").eqNullSafe(F.col(c + "_b")) for c in ("source", "person_scale", "cell_yaw", "cell_pitch")]
    near = (F.abs(F.col("yaw_a") - F.col("yaw_b")) <= degrees) & (F.abs(F.col("pitch_a") - F.col("pitch_b")) <= degrees)
    distance = hamming(F.col("phash_a"), F.col("phash_b")).cast("int")
    return a.join(b, [*on, F.col("id_a") < F.col("id_b")]).where(near & (distance <= threshold)).select(F.col("id_a").alias("a"), F.col("id_b").alias("b"), distance.alias("distance"))


def _both(pairs: DataFrame) -> DataFrame:
    return pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _settle(batches):
    """Heads of the free rows in order: kind 0 is a row (priority, hash), 1 two hashes that are near, 2 two rows that are."""
    every = pd.concat([pd.DataFrame({"kind": [], "a": [], "b": []}, dtype="int64"), *batches])
    part = lambda k: every[every["kind"] == k]
    near, adjacent, of_hash = ({k: list(v) for k, v in part(kind).groupby(key)[value]} for kind, key, value in ((1, "a", "b"), (2, "a", "b"), (0, "b", "a")))
    gone, heads, rows = set(), [], part(0).sort_values("a")
    for p, h in zip(rows["a"].tolist(), rows["b"].tolist()):
        if p not in gone:
            heads.append(p)
            for x in (h, *near.get(h, ())):
                gone.update(of_hash.pop(x, ()))
            gone.update(adjacent.get(p, ()))
    yield pd.DataFrame({"p": pd.Series(heads, dtype="int64")})


def anchors_of(rows: DataFrame, near: DataFrame, adjacent: DataFrame) -> DataFrame:
    """(p, anchor) of rows (p, phash): anchors with their own, the others with the first anchor that they are close to.

    near holds pairs (a, b) of hashes and adjacent pairs of rows, both ways round; rows of equal hash are close too.

    In order of priority an anchor takes all that is close and still free. That is the lexicographically first maximal
    independent set: in each round a free row whose free neighbours all come later is an anchor, and its neighbours are
    taken. What is between hashes is done on hashes, so that many rows of one hash are no clique of edges. Rounds go on
    while more than TAIL_EDGES rows and edges are left; those few are settled in order by one task."""
    free, heads = rows, None
    while True:  # each round has a head: the first free row
        left = near.join(free.select(F.col("phash").alias("a")).distinct(), "a", "left_semi")
        edges = adjacent.join(free.select(F.col("p").alias("a")), "a", "left_semi").join(free.select(F.col("p").alias("b")), "b", "left_semi")
        tagged = free.select(F.lit(0).alias("kind"), F.col("p").alias("a"), F.col("phash").alias("b"))
        tagged = tagged.unionByName(left.select(F.lit(1).alias("kind"), "a", "b")).unionByName(edges.select(F.lit(2).alias("kind"), "a", "b"))
        if tagged.limit(TAIL_EDGES + 1).count() <= TAIL_EDGES:
            last = cut(tagged.coalesce(1).mapInPandas(_settle, "p long"), "heads")
            heads = last if heads is None else heads.unionByName(last)
            break
        least = free.groupBy("phash").agg(F.min("p").alias("p"))
        around = near.join(least.select(F.col("phash").alias("b"), F.col("p").alias("q")), "b").groupBy(F.col("a").alias("phash")).agg(F.min("q").alias("q"))
        first = edges.groupBy(F.col("a").alias("p")).agg(F.min("b").alias("r"))
        found = least.join(around, "phash", "left").join(first, "p", "left").where("(q is null or p < q) and (r is null or p < r)")
        found = cut(found.select("p", "phash"), "heads")
        hashes = found.select("phash").unionByName(near.join(found.select(F.col("phash").alias("a")), "a").select(F.col("b").alias("phash"))).distinct()
        taken = edges.join(found.select(F.col("p").alias("b")), "b").select(F.col("a").alias("p")).distinct()
        free = cut(free.join(hashes, "phash", "left_anti").join(taken, "p", "left_anti"), "free")
        heads = found.select("p") if heads is None else heads.unionByName(found.select("p"))
    heads = cut(rows.join(heads, "p"), "anchors")
    least = heads.groupBy("phash").agg(F.min("p").alias("q"))
    reach = least.unionByName(near.join(least.withColumnRenamed("phash", "b"), "b").select(F.col("a").alias("phash"), "q")).groupBy("phash").agg(F.min("q").alias("q"))
    beside = adjacent.join(heads.select(F.col("p").alias("b")), "b").groupBy(F.col("a").alias("p")).agg(F.min("b").alias("r"))
    mine = heads.select("p", F.lit(True).alias("own"))
    out = rows.join(reach, "phash", "left").join(beside, "p", "left").join(mine, "p", "left")
    return out.select("p", F.when(F.col("own"), F.col("p")).otherwise(F.least("q", "r")).alias("anchor"))


def _by_edges(live: DataFrame, threshold: int, adjacent: int | None) -> DataFrame:
    """(p, anchor) of live rows from all pairs that are close."""
    rows = live.select(F.col("pri").alias("p"), "phash")
    hashes = live.select(F.col("phash").alias("id"), "phash").distinct()
    near = cut(_both(hamming_pairs(hashes, threshold)), "near")
    beside = cut(_both(adjacent_pairs(live.drop("id").withColumnRenamed("pri", "id"), adjacent)), "adjacent") if adjacent is not None else near.limit(0)
    return anchors_of(rows, near, beside)


def _first_close(rows: pd.DataFrame, heads: pd.DataFrame, threshold: int, adjacent: int | None, degrees: float) -> np.ndarray:
    """Of each row the place of the first head that it is close to, or -1."""
    code = {v: k for k, v in enumerate(heads["place"].unique())}
    own, other = (d["place"].map(code).fillna(-1).to_numpy(np.int64) for d in (rows, heads))
    bits = lambda d: d["phash"].to_numpy(np.int64).view(np.uint64)
    p, q, (yaw, pitch), (yaws, pitches) = bits(rows), bits(heads), *([d[c].to_numpy(float) for c in ("yaw", "pitch")] for d in (rows, heads))
    out = np.full(len(rows), -1)
    for u in range(0, len(rows), 1024):
        left = np.arange(u, min(len(rows), u + 1024))
        for v in range(0, len(heads), 512):
            w = slice(v, v + 512)
            apart = np.bitwise_count(p[left, None] ^ q[None, w])
            close = apart <= threshold
            if adjacent is not None:
                r, c = np.nonzero((apart <= adjacent) & (own[left, None] == other[None, w]))
                close[r, c] |= (np.abs(yaw[left[r]] - yaws[w][c]) <= degrees) & (np.abs(pitch[left[r]] - pitches[w][c]) <= degrees)
            some = close.any(1)
            out[left[some]] = close[some].argmax(1) + v
            left = left[~some]
            if not len(left):
                break
    return out


def _heads_of(rows: pd.DataFrame, threshold: int, adjacent: int | None, degrees: float) -> pd.DataFrame:
    """The anchors among rows, in order."""
    rows, heads = rows.sort_values("p", ignore_index=True), []
    while len(rows):  # a stretch at a time: what is close to its anchors goes, from all that follow
        part, mine = rows[:256].reset_index(drop=True), []
        gone = np.zeros(len(part), bool)
        for k in range(len(part)):
            if not gone[k]:
                mine.append(k)
                gone |= _first_close(part, part[k : k + 1], threshold, adjacent, degrees) >= 0
        heads.append(part.iloc[mine])
        rows = rows[256:].reset_index(drop=True)
        rows = rows[_first_close(rows, heads[-1], threshold, adjacent, degrees) < 0].reset_index(drop=True)
    return pd.concat(heads, ignore_index=True)


def _ahead(live: DataFrame, threshold: int, adjacent: int | None, degrees: float = 25.0) -> DataFrame:
    """(p, anchor) of live rows where many pairs are close: the first AHEAD free rows are settled in order by one task, and all other
    rows are held against their anchors, without the pairs between the others. Once a round leaves most rows free, few of them
    are close to each other, and their pairs are made."""
    both = ["yaw", "pitch"] if adjacent is not None else []
    place = F.to_json(F.struct("source", "person_scale"), {"ignoreNullFields": "false"}) if adjacent is not None else F.lit("")
    more = [F.col(c).cast("double").alias(c) if c in both else F.lit(None).cast("double").alias(c) for c in ("yaw", "pitch")]
    kind = dict(live.dtypes)["pri"]
    free = live.select(F.col("pri").alias("p"), "phash", place.alias("place"), *more)
    names, out, many = free.columns, None, free.count()
    schema = ", ".join(f"{c} {t}" for c, t in free.dtypes)
    while many:

        def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            own = [b for b in batches if len(b)]
            if own:
                yield _heads_of(pd.concat(own, ignore_index=True), threshold, adjacent, degrees)

        # At most AHEAD rows of some 60 bytes go to every worker.
        heads = free.sparkSession.sparkContext.broadcast(free.orderBy("p").limit(AHEAD).coalesce(1).mapInPandas(first, schema).toPandas())

        def settle(batches: Iterator[pd.DataFrame], heads=heads) -> Iterator[pd.DataFrame]:
            for b in batches:
                at = _first_close(b, heads.value, threshold, adjacent, degrees)
                anchor = heads.value["p"].to_numpy()[np.maximum(at, 0)]
                yield b.assign(anchor=pd.Series(anchor, index=b.index, dtype="Int64").mask(at < 0))

        held = cut(free.mapInPandas(settle, f"{schema}, anchor {kind}"), "held")
        done = held.where("anchor is not null").select("p", "anchor")
        out = done if out is None else out.unionByName(done)
        free = held.where("anchor is null").select(*names)
        before, many = many, free.count()
        if many > max(AHEAD, before // 2):
            rest = live.join(free.select(F.col("p").alias("pri")), "pri", "left_semi")
            return out.unionByName(_by_edges(cut(rest, "rest"), threshold, adjacent))
    return out if out is not None else free.select("p", F.lit(None).cast(kind).alias("anchor"))


def greedy_groups(nodes: DataFrame, threshold: int, adjacent: int | None = None) -> DataFrame:
    """W5 over nodes (id, pri, phash): (id, duplicate_group). pri is unique, the best is the smallest.

    Two rows are close by their hashes alone, or, if adjacent is given, as adjacent_pairs has it; nodes then have source,
    person_scale, yaw and pitch too. Rows without a hash and rows with `duplicate_ignore`, where nodes have it, take no
    part. Groups of two or more rows are numbered from 1 in order of their anchors; 0 is no group."""
    more = ["source", "person_scale", "yaw", "pitch"] if adjacent is not None else []
    ignored = F.coalesce("duplicate_ignore", F.lit(False)) if "duplicate_ignore" in nodes.columns else F.lit(False)
    nodes = cut(nodes.select("id", "pri", "phash", ignored.alias("ignored"), *more), "nodes")  # hashes are costly, and read several times
    live = nodes.where("phash <> 0 and not ignored")
    found = _ahead(live, threshold, adjacent) if threshold > BANDS_UP_TO else _by_edges(live, threshold, adjacent)
    rows = live.select("id", F.col("pri").alias("p")).join(found, "p").select("id", "anchor")
    groups = rows.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("anchor")
    placed = rows.join(numbered(groups, "anchor"), "anchor").select("id", "number")
    return nodes.select("id").join(placed, "id", "left").select("id", F.coalesce("number", F.lit(0)).cast("int").alias("duplicate_group"))


def exact_groups(rows: DataFrame, key: str = "content_sha256") -> DataFrame:
    """W5 at threshold 0: rows with duplicate_group, groups of equal keys numbered by their best row."""
    best = F.struct((-F.col("face_quality")).alias("q"), F.col("brisque").alias("b"), (-F.col("blur")).alias("s"), F.col("ord").alias("o"))
    groups = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.min(best).alias("first")).where("n > 1")
    groups = numbered(groups.select(key, "first"), "first").select(key, F.col("number").cast("int").alias("duplicate_group"))
    return rows.drop("duplicate_group").join(groups, key, "left").withColumn("duplicate_group", F.coalesce("duplicate_group", F.lit(0)))


def _apart() -> Column:
    """A partition for each group, and one for each row without a group."""
    return F.when(F.col("duplicate_group") == 0, -F.col("ord") - 1).otherwise(F.col("duplicate_group").cast("long"))


def with_group_rank(rows: DataFrame, qualified: bool = False) -> DataFrame:
    """group_rank and group_size. qualified: over members without blockers, or all where none is; 0 for the others.

    Members are numbered in ranges of (group, rank), and a group's first number is taken off, so that no group is one task."""
    grouped = rows.where("duplicate_group <> 0").withColumn("_key", rank_key())
    if qualified:
        some = grouped.groupBy("duplicate_group").agg(F.max("qualified").alias("_some"))
        grouped = grouped.join(some, "duplicate_group").withColumn("_in", F.col("qualified") | ~F.col("_some")).drop("_some")
    else:
        grouped = grouped.withColumn("_in", F.lit(True))
    placed = numbered(grouped.where("_in"), "duplicate_group", "_key")
    first = placed.groupBy("duplicate_group").agg(F.min("number").alias("_first"), F.count(F.lit(1)).alias("group_size"))
    ranked = placed.join(first, "duplicate_group").withColumn("group_rank", (F.col("number") - F.col("_first") + 1).cast("int")).drop("number", "_first")
    if qualified:
        ranked = ranked.unionByName(grouped.where("not _in").join(first.drop("_first"), "duplicate_group").withColumn("group_rank", F.lit(0)))
    alone = rows.where("duplicate_group = 0").withColumn("group_rank", F.lit(1)).withColumn("group_size", F.lit(1).cast("long"))
    return ranked.drop("_in", "_key").unionByName(alone)


def best_per_group(rows: DataFrame) -> DataFrame:
    """Rows without a group, and the best of each group."""
    top = Window.partitionBy("duplicate_group").orderBy(*rank_order())
    grouped = rows.where("duplicate_group <> 0").withColumn("_k", F.row_number().over(top)).where("_k = 1").drop("_k")
    return rows.where("duplicate_group = 0").unionByName(grouped)


def group_ids(rows: DataFrame) -> DataFrame:
    """W7."""
    return rows.where("duplicate_group <> 0").select("duplicate_group").distinct().orderBy("duplicate_group")


def group_members(rows: DataFrame, group: int) -> DataFrame:
    """The ignored rows in file order for group -1, else the members by rank."""
    if group == IGNORED_GROUP:
        return rows.where("duplicate_ignore").orderBy("ord")
    return rows.where(F.col("duplicate_group") == group).orderBy(*rank_order())


def group_reviewed(rows: DataFrame) -> DataFrame:
    """A11."""
    return rows.where("duplicate_group <> 0").groupBy("duplicate_group").agg(F.every("duplicate_reviewed").alias("reviewed"))


def _decide(rows: DataFrame, touched: Column, manual: Column, reviewed: bool) -> DataFrame:
    return rows.withColumns({"manual_status": F.when(touched, manual).otherwise(F.col("manual_status")), "duplicate_reviewed": F.when(touched, F.lit(reviewed)).otherwise(F.col("duplicate_reviewed"))})


def keep_best(rows: DataFrame, group: int) -> DataFrame:
    """M3: the best is picked and the others rejected; nothing happens to the ignored group."""
    if group == IGNORED_GROUP:
        return rows
    return _decide(with_group_rank(rows), F.col("duplicate_group") == group, F.when(F.col("group_rank") == 1, PICKED).otherwise(REJECTED), True).drop("group_rank", "group_size")


def apply_checked(rows: DataFrame, checked: DataFrame, group: int | None = None) -> DataFrame:
    """M4: rows of the group (of all groups) that are in checked (sample_id) are picked, the others rejected."""
    marks = checked.select("sample_id").distinct().withColumn("_on", F.lit(True))
    touched = F.col("duplicate_group") == group if group is not None else F.col("duplicate_group") != 0
    return _decide(rows.join(marks, "sample_id", "left"), touched, F.when(F.col("_on"), PICKED).otherwise(REJECTED), True).drop("_on")


def keep_all(rows: DataFrame, group: int) -> DataFrame:
    """M5."""
    return _decide(rows, F.col("duplicate_group") == group, F.lit(PICKED), True)


def restore_auto(rows: DataFrame, group: int) -> DataFrame:
    """M5."""
    return _decide(rows, F.col("duplicate_group") == group, F.lit(None).cast("string"), False)


def set_ignored(rows: DataFrame, ids: DataFrame, ignored: bool = True) -> DataFrame:
    """M6: rows with the flag set and `changed`, true where it was otherwise; groups are to be made anew."""
    marks = ids.select("sample_id").distinct().withColumn("_on", F.lit(True))
    joined = rows.join(marks, "sample_id", "left")
    changed = F.coalesce("_on", F.lit(False)) & (F.col("duplicate_ignore") != ignored)
    return joined.withColumn("changed", changed).withColumn("duplicate_ignore", F.when(F.col("_on"), F.lit(ignored)).otherwise(F.col("duplicate_ignore"))).drop("_on")


def toggle(status: Column) -> Column:
    """M2."""
    return F.when(status == PICKED, BACKUP).when(status == BACKUP, PICKED).otherwise(BACKUP)
