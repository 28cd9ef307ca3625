"""The corpus pipeline: five operators, one after another, over documents.

Each stage takes (spark, docs, sf_dir), where docs is what the stage before wrote, and returns a DataFrame that is
written as Parquet in the shared folder and read again. All but the last keep the columns of documents as they are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomset.llm import decontamination, jaccard_join, language_id, mixing, sharding
from loomset.llm.common import stored


#: Rows and bytes that go to a Python worker at once, at most.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": 1000, "spark.sql.execution.arrow.maxBytesPerBatch": 1 << 20}


def _small_batches(spark: SparkSession) -> None:
    """Whole texts go to Python workers few at a time: a batch lies beside the heap of an executor, whose buffers keep the size
    of the largest. The session keeps the setting, since a stage's table is written after its function returns."""
    for name, most in BATCHES.items():
        spark.conf.set(name, str(most))


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the classifier rejects go: null texts, texts without a letter, texts that are like no label.

    Very long texts are judged whole and repeated rows alike; without rows none come out. Other columns, whatever their
    names, are passed on as they are."""
    _small_batches(spark)
    predict = language_id.predictor(docs)
    return docs.where(~predict("text")["rejected"])


def _row(docs: DataFrame):
    """A whole row as one column, so that its names, whatever they are, meet no others."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of the n-gram Jaccard join the row with the smallest id stays; texts without words all stay.

    Near copies are op10's: word shingles and the share of them as in its contract, jaccard_join.WORDS (4) and PERCENT (85), so
    that the stage and the query name the same components. Texts that are alike only by looser measures (five words, 0.8) both stay.

    Rows are matched by id and hash of the text. The list of rows to drop is broadcast up to BROADCAST_ROWS rows and
    else joined by a shuffle."""
    _small_batches(spark)
    drop, repeated = jaccard_join.keepers(docs)
    drop = stored(drop, "drop")
    rows = docs.select(_row(docs), F.col("doc_id").alias("i"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("t"))

    def match(a: DataFrame, b: DataFrame, how: str) -> DataFrame:
        b = F.broadcast(b) if b.count() <= BROADCAST_ROWS else b
        return a.join(b, a["i"].eqNullSafe(b["doc_id"]) & (a["t"] == b["row_text"]), how)

    left = match(rows, drop, "left_anti")
    repeated = stored(repeated, "repeated")
    if not repeated.isEmpty():
        left = match(left, repeated, "left_anti").unionByName(match(left, repeated, "left_semi").dropDuplicates(["i", "t"]))
    return left.select("row.*")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the contamination rule finds contaminated go; null and empty texts are clean and stay.

    Very long texts are scanned whole and repeated rows judged alike; without rows none come out. Other columns, whatever
    their names, are passed on as they are."""
    _small_batches(spark)
    rows = docs.select(_row(docs), F.encode("text", "utf-8").alias("data"))
    judged = decontamination.judged(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return judged.where("not judged.contaminated").select("row.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated, or left out, as the mixture takes them, whole: the document at a source's border is taken
    once more if the mixture takes at least half of it.

    A null source is a source; a null text or one without words has size 0 and stays as often as its source's documents
    are taken whole. Repeated rows are documents of their own; without rows none come out. Other columns, whatever their
    names, are passed on as they are."""
    sized = docs.select("doc_id", "source", mixing.size_column().alias("size"), _row(docs))
    taken = mixing.mix(sized, carry=("row",))
    copies = F.col("whole") + F.when(2 * F.col("more") >= F.greatest(F.col("size"), F.lit(1)), 1).otherwise(0)
    return taken.select("row", copies.cast("int").alias("copies")).where("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document gets its shard and its slot there: the columns of op6. Nulls, repeated rows and empty tables are as
    there (see sharding.shard); a very long text is only measured; other columns are not read."""
    return sharding.shard(docs)


#: Rows of (id, hash) that are broadcast: 24 MB.
BROADCAST_ROWS = 1_000_000

STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language ID", identify_language),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", decontaminate),
    ("mixing sources to target weights", mix_sources),
    ("sharding", shard),
]

#: SQL expresses neither the classifier nor components of the join at this size: the tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stored(docs, f"stage{k}")
    return docs
