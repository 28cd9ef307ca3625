"""Mixing sources to target weights: capped water-filling, then seeded whole and fractional repetitions.

The budget is dealt to sources by weight; a source whose share exceeds max_epochs times its size is clamped there and
the excess is dealt again by weight, until no share is above its cap. A source with target t and size s takes each of
its documents floor(t / s) times, and once more those with the smallest seeded hashes whose sizes add up to the rest.
The document on the border is taken in part, its first words, so that a source takes its target to the word.
The border is found by histograms over the hash, so that no source, however large, is sorted or windowed as a whole.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import small_table, stored

WEIGHTS = (5, 2, 1)
BUDGET = Fraction(3, 2)
MAX_EPOCHS = 2
SEED = "mix-1"
#: A mixture names its sources one by one; more than this many is an error, not a mixture.
MAX_SOURCES = 100_000
WORD = r"[^\x20\x09-\x0D]+"


def water_fill(sizes: list[int], weights: list[int], budget: Fraction, max_epochs: int) -> list[Fraction]:
    """Shares of the budget by weight, none above max_epochs times its size; exact.

    A budget above all caps fills them; a source of weight 0 gets nothing."""
    share, free, left = [Fraction(0)] * len(sizes), [i for i, w in enumerate(weights) if w > 0], Fraction(budget)
    while free:
        total = sum(weights[i] for i in free)
        full = [i for i in free if left * weights[i] > max_epochs * sizes[i] * total]
        for i in full or free:
            share[i] = Fraction(max_epochs * sizes[i]) if full else left * weights[i] / total
        if not full:
            break
        left -= sum(share[i] for i in full)
        free = [i for i in free if i not in set(full)]
    return share


def targets(sized: DataFrame, weights: tuple[int, ...], budget: Fraction, max_epochs: int) -> DataFrame:
    """(source, source_size, target, whole, rest): one row for each source, from one partial aggregation."""
    spark = sized.sparkSession
    rows = sized.groupBy("source").agg(F.sum("size").alias("s")).limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    rows.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    sizes = [r["s"] for r in rows]
    share = water_fill(sizes, [weights[i % len(weights)] for i in range(len(rows))], budget * sum(sizes), max_epochs)
    out = []
    for r, t in zip(rows, share):
        whole = int(t // r["s"]) if r["s"] else 0
        out.append((r["source"], r["s"], float(t), whole, int((t - whole * r["s"] + Fraction(1, 2)) // 1)))
    return small_table(spark, out, "source string, source_size long, target double, whole long, rest long")


def _bucket(k: int) -> Column:
    """Digit k, of three hexadecimal digits, of the hash of a document."""
    return F.substring("h", 1 + 3 * k, 3)


def mix(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: Fraction = BUDGET, max_epochs: int = MAX_EPOCHS, seed: str = SEED, carry: tuple[str, ...] = ()) -> DataFrame:
    """sized: (doc_id, source, size) and columns to carry. Adds source_size, target, whole, more and taken: the document
    is taken `whole` times and `more` words of it again, taken words in all.

    A null source is a source, the last one; a null size is 0. Repeated rows are documents of their own. An empty table
    gives an empty result. Ties of the hash are broken by id, then size; equal rows may change places, which no one can
    see. Carried columns are not looked at. Only counts are shuffled, and the few documents at a border."""
    own = sized.select("doc_id", "source", F.coalesce("size", F.lit(0)).cast("long").alias("size"), *carry)
    own = own.withColumn("h", F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))))
    slim = stored(own.select("doc_id", "source", "size", "h"), "sizes")
    own = own if carry else slim
    aim = targets(slim, weights, budget, max_epochs)

    # The bucket of hashes in which the sum of sizes passes the rest; then, inside it, a bucket of a bucket.
    border = aim.select("source", F.col("rest").alias("room"))
    for k in range(2):
        mine = slim
        if k:
            cut = F.broadcast(border.select(F.col("source").alias("s"), "b0"))
            mine = slim.join(cut, slim["source"].eqNullSafe(F.col("s")) & (_bucket(0) == F.col("b0")), "left_semi")
        sums = mine.groupBy("source", _bucket(k).alias("b")).agg(F.sum("size").alias("n"))  # at most 4096 rows a source
        earlier = Window.partitionBy("source").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
        upto = sums.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
        room = border.select(F.col("source").alias("s"), "room", *[f"b{i}" for i in range(k)])
        found = upto.join(F.broadcast(room), upto["source"].eqNullSafe(F.col("s"))).where("before <= room")
        found = found.groupBy("source", *[f"b{i}" for i in range(k)]).agg(F.max(F.struct("b", "before", "room")).alias("x"))
        border = found.select("source", *[f"b{i}" for i in range(k)], F.col("x.b").alias(f"b{k}"), (F.col("x.room") - F.col("x.before")).alias("room"))
    # One row a source, no more than targets() allows.
    edges = {r["source"]: (r["edge"], r["room"]) for r in border.select("source", F.concat("b0", "b1").alias("edge"), "room").collect()}
    facts = {r["source"]: r for r in aim.collect()}
    plan = [(k, r["source_size"], r["target"], r["whole"], *edges.get(k, (None, None))) for k, r in facts.items()]
    plan = small_table(sized.sparkSession, plan, "s string, source_size long, target double, whole long, edge string, room long")
    rows = own.join(F.broadcast(plan), own["source"].eqNullSafe(F.col("s")))
    key = F.substring("h", 1, 6)
    part = rows.where(key == F.col("edge"))  # some 2^-24 of a source
    order = Window.partitionBy("source").orderBy("h", F.col("doc_id").asc_nulls_last(), "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    part = part.withColumn("more", F.greatest(F.lit(0), F.least("size", F.col("room") - F.sum("size").over(order) + F.col("size"))))
    rest = rows.where((key != F.col("edge")) | F.col("edge").isNull()).withColumn("more", F.when(key < F.col("edge"), F.col("size")).otherwise(F.lit(0)))
    taken = (F.col("size") * F.col("whole") + F.col("more")).cast("long").alias("taken")
    return rest.unionByName(part).select("doc_id", "source", "size", "source_size", "target", "whole", "more", taken, *carry)


def size_column(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")
