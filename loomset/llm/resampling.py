"""Importance resampling towards a target distribution over hashed n-gram features, with a dictionary of distinct features.

Features are the n-gram strings of termblocks. Their occurrences are added up by string over all blocks of the source and
of the target, which gives a dictionary with one row for each distinct feature; each is hashed to its bucket there, once.
The dictionary's counts are added up by bucket, a bucket's gain is the log ratio of its smoothed shares, and the gains go
back over the dictionary to the blocks' own terms and so to the documents' counts. A block sends each of its distinct
terms once, whatever many of its documents hold it.

Documents are drawn without replacement by the Gumbel trick: those with the highest sums of weight and noise. The noise
comes from a hash of the id, so that reruns agree. Ranks are numbered in slices of the scores.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import termblocks
from .common import stored, trim

MOST, BUCKETS, SEED = 1, 10_000, "2024"
LEAST_WORDS, PERCENT = 20, 10
#: Documents of a slice of ranks, about, and slices at most.
SLICE_ROWS, SLICES = 50_000, 4096
#: Fixed value: what weights and noise are multiplied by before they are rounded down.
UNIT = 1000


def dictionary(source: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(term, bucket, in_source, in_target), one row for each distinct term of two tables of blocks, written."""
    own = lambda b, a, c: b.select(F.explode(F.arrays_zip("terms", "cf")).alias("x")).select(F.col("x.terms").alias("term"), a.alias("in_source"), c.alias("in_target"))
    zero, cf = F.lit(0).cast("long"), F.col("x.cf")
    both = own(source, cf, zero).unionByName(own(target, zero, cf))
    every = both.groupBy("term").agg(F.sum("in_source").alias("in_source"), F.sum("in_target").alias("in_target"))
    return stored(every.withColumn("bucket", F.pmod(F.crc32(F.encode("term", "utf-8")), F.lit(buckets)).cast("int")), "dictionary")


def gains(terms: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, gain) of the buckets that have a term: floor(1000 ln((t + 1)(S + B) / ((s + 1)(T + B)))); written, a row a bucket."""
    own = stored(terms.groupBy("bucket").agg(F.sum("in_source").alias("s"), F.sum("in_target").alias("t")), "buckets")
    total = own.agg(F.sum("s").alias("s"), F.sum("t").alias("t")).first()
    one, b = F.lit(1.0), F.lit(float(buckets))
    ratio = (F.col("t") + one) * (F.lit(float(total["s"] or 0)) + b) / ((F.col("s") + one) * (F.lit(float(total["t"] or 0)) + b))
    return own.select("bucket", F.floor(F.lit(float(UNIT)) * F.log(ratio)).cast("long").alias("gain"))


def weights(source: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of every document of a table of blocks: weight is the sum of its features' gains."""
    terms = dictionary(source, target, buckets)
    known = terms.where("in_source > 0").join(F.broadcast(gains(terms, buckets)), "bucket").select("term", "gain")
    asked = source.select(F.col("block").alias("of"), F.posexplode("terms").alias("place", "term"))
    told = asked.join(known, "term").select("of", "place", "gain")

    def add(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left):
            return pd.DataFrame(columns=["doc_id", "n_words", "n_features", "weight"])
        table = termblocks.docs_of(left["docs"].iloc[0])
        distinct = table["distinct"].to_numpy()
        doc, term, tf = termblocks.unpack(left["data"].iloc[0], distinct)
        gain = np.zeros(int(right["place"].max()) + 1 if len(right) else 1, np.int64)
        gain[right["place"].to_numpy()] = right["gain"].to_numpy()
        total = np.concatenate([[0], np.cumsum(gain[term] * tf)])  # whole numbers: differences of sums are exact
        ends = np.cumsum(distinct)
        out = pd.DataFrame({"doc_id": table["doc_id"].to_pandas(), "n_words": table["n_words"].to_numpy(), "n_features": table["n_terms"].to_numpy(), "weight": total[ends] - total[ends - distinct]})
        trim()
        return out

    own = source.select("block", "docs", "data")
    found = own.groupBy("block").cogroup(told.groupBy("of")).applyInPandas(add, "doc_id string, n_words long, n_features long, weight long")
    return found.withColumn("doc_id", F.col("doc_id").cast("long"))


def noise(doc_id, seed: str = SEED):
    """Gumbel noise of an id, in thousandths, rounded down; of no id that of the empty text."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-float(UNIT)) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


def draw(rows: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """rows (doc_id, n_words, score and others) with `rank`: percent of those with so many words, rounded down, have one.

    Highest scores first, equal ones by ascending id, rows without an id last. rows are read more than once: a written table."""
    fit = rows.where(F.col("n_words") >= least_words)
    n = fit.count()
    wanted = percent * n // 100
    slices = max(1, min(SLICES, n // slice_rows))
    cuts = sorted(set(fit.stat.approxQuantile("score", [k / slices for k in range(1, slices)], 1 / (4 * slices)))) if slices > 1 else []
    # Slice 0 has the scores above the last cut; a score that is a cut is in the slice below it.
    at = F.lit(len(cuts)) - F.expr(f"size(filter(array({', '.join(f'{int(c)}L' for c in cuts)}), c -> c < score))") if cuts else F.lit(0)
    cut = rows.withColumn("slice", F.when(F.col("n_words") >= least_words, at).cast("int"))
    sizes = {r["slice"]: r["count"] for r in cut.where("slice is not null").groupBy("slice").count().collect()}  # a row a slice
    before, first = 0, []
    for k in range(len(cuts) + 1):
        if before < wanted:
            first.append((k, before))
        before += sizes.get(k, 0)
    starts = F.broadcast(rows.sparkSession.createDataFrame(first, "slice int, before long"))
    inside = Window.partitionBy("slice").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    near = cut.join(starts, "slice", "left_semi").withColumn("place", F.row_number().over(inside)).join(starts, "slice")
    place = F.col("before") + F.col("place")
    near = near.withColumn("rank", F.when(place <= wanted, place).cast("long")).drop("before", "place")
    far = cut.join(starts, "slice", "left_anti").withColumn("rank", F.lit(None).cast("long"))
    return near.unionByName(far).drop("slice")


def resample(docs: DataFrame, target: DataFrame, most: int = MOST, buckets: int = BUCKETS) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) for each row of docs; target: any table with texts.

    A null text has no features, weight 0 and its noise as score; it is drawn only where no words are asked for. Repeated
    rows count as often as they are there and have ranks of their own. Very long texts are blocks of their own, counted
    whole. An empty target makes every gain that of its absence; without rows of docs none come out. Equal scores are
    ranked by id. Other columns are not read."""
    source = termblocks.blocks(docs, most)
    aim = termblocks.blocks(target.select(F.lit(None).cast("string").alias("doc_id"), "text"), most)
    scored = weights(source, aim, buckets).withColumn("score", F.col("weight") + noise(F.col("doc_id")))
    return draw(stored(scored, "scored")).select("doc_id", "n_features", "weight", "score", "rank")
