"""Enrichment: models over changed rows, as a batch or over a stream of new files, with late results left out."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.expressions import path_key
from ..schema import IMAGE_SUFFIXES, PICKED


def enrich(rows: DataFrame, make_model: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]], schema: str) -> DataFrame:
    """X1 to X11's frame: make_model() runs once in a Python worker, on its first batch; the model turns batches of rows
    into rows of `schema`. Put raw metrics out here: classes and findings are column expressions."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = None
        for f in frames:
            if len(f):
                model = model or make_model()
                yield model(f)

    return rows.mapInPandas(run, schema)


def guarded(detect: Callable[[bytes], dict], columns: list[str]) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """P11, T-3: a model from a function of one image. A failure fills `error` and leaves the rest of the row null."""

    def model(frame: pd.DataFrame) -> pd.DataFrame:
        out = []
        for i, content in zip(frame["sample_id"], frame["content"]):
            try:
                out.append({"sample_id": i, "error": None, **detect(content)})
            except Exception as e:  # noqa: BLE001  one image must not stop the others
                out.append({"sample_id": i, "error": f"{type(e).__name__}: {e}"})
        return pd.DataFrame(out, columns=["sample_id", *columns, "error"])

    return model


def staged(plan: DataFrame, composite: Callable[[DataFrame], DataFrame], crop: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """T-3: composite jobs, then the crop jobs with those that the composite stage cleared; (stage, sample_id, found, error)."""
    first = composite(plan.where("stage = 'composite'")).select(F.lit("composite").alias("stage"), "sample_id", "found", "error")
    clear = first.where("not found and error is null").select("sample_id")
    jobs = plan.where("stage = 'auto_crop'").select("sample_id").unionByName(clear).distinct()
    second = crop(jobs).select(F.lit("auto_crop").alias("stage"), "sample_id", "found", "error")
    return first.unionByName(second)


def current_results(results: DataFrame, rows: DataFrame, epoch: int) -> DataFrame:
    """T-4, J11: results of this epoch whose row is still there and still recommended, with the id of that row.

    A row is found by its id; where no row has it, by the key of the path, if the results have a path. Of several rows
    at a path it is the first by id."""
    own = results.where(F.col("epoch") == epoch)
    live = rows.select("sample_id", (F.col("status") == PICKED).alias("_live"))
    found = own.join(live, "sample_id", "left")
    if "path" not in results.columns:
        return found.where("_live").drop("_live")
    by_path = rows.groupBy(path_key(F.col("path")).alias("_key")).agg(F.min_by(F.struct("sample_id", (F.col("status") == PICKED).alias("live")), "sample_id").alias("_row"))
    lost = found.where("_live is null").withColumn("_key", path_key(F.col("path"))).join(by_path, "_key").where("_row.live")
    lost = lost.withColumn("sample_id", F.col("_row.sample_id")).select(*results.columns)
    return found.where("_live").select(*results.columns).unionByName(lost)


def scan_batch(todo: DataFrame, found: DataFrame, manual: bool = False) -> DataFrame:
    """T-8: (sample_id, decision, n_boxes); with manual a row where nothing was found gets an empty pending proposal."""
    joined = todo.select("sample_id").join(found.select("sample_id", "n_boxes"), "sample_id", "left")
    decision = F.when(F.col("n_boxes").isNotNull() | F.lit(manual), "pending")
    return joined.select("sample_id", decision.alias("decision"), F.coalesce("n_boxes", F.when(F.lit(manual), 0)).alias("n_boxes"))


def watch(spark: SparkSession, folder: str, merge: Callable[[DataFrame, int], None], checkpoint: str, every: str = "200 milliseconds") -> StreamingQuery:
    """T-1, T-5: new images of a folder as a stream; merge(batch, epoch) lays each batch over the snapshot. A batch that
    is delivered again after a failure has the same epoch, so merge can leave it out."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", True).load(folder)
    images = files.select("path", "modificationTime", "length", F.sha2("content", 256).alias("content_sha256"))
    images = images.where(F.lower(F.regexp_extract("path", r"\.([^.]*)$", 1)).isin(*IMAGE_SUFFIXES))
    return images.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()
