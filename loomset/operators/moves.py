"""Move plans and their conflicts; operators.outputs carries them out."""

from __future__ import annotations

import os
from collections.abc import Iterable
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import path_key, source_label
from ..schema import STATUSES


def under_excluded(relative: Column, excluded: Iterable[str]) -> Column:
    """A folder on the way, not the name itself, is an excluded one; case doesn't matter."""
    names = [n.casefold() for n in excluded]
    if not names:
        return F.lit(False)
    parts = F.split(F.lower(relative), "/")
    return F.exists(F.slice(parts, 1, F.size(parts) - 1), lambda p: p.isin(*names))


def origin(relative: Column, stored: Column) -> Column:
    """G1: the stored origin, else the path without a leading folder of a status."""
    status = F.split(relative, "/")[0].isin(*STATUSES) & (F.instr(relative, "/") > 0)
    return F.coalesce(F.when(stored != "", stored), F.when(status, F.regexp_replace(relative, "^[^/]*/", "")).otherwise(relative))


def move_plan(rows: DataFrame, root: str, excluded: Iterable[str] = ()) -> DataFrame:
    """Rows (sample_id, path, status, origin_relative_path) with destination and outcome: move, unchanged or skipped.

    error marks origins that are absolute or leave the root."""
    relative = F.substring(F.col("path"), len(root) + 2, 1 << 30)
    own = rows.withColumn("relative", relative).withColumn("origin", origin(F.col("relative"), F.col("origin_relative_path")))
    skip = under_excluded(F.col("relative"), excluded) | ~F.coalesce(F.col("status").isin(*STATUSES), F.lit(False))
    own = own.withColumn("destination", F.concat_ws("/", F.lit(root), F.col("status"), F.col("origin")))
    outcome = F.when(skip, "skipped").when(path_key(F.col("path")) == path_key(F.col("destination")), "unchanged").otherwise("move")
    error = F.col("origin").startswith("/") | F.array_contains(F.split("origin", "/"), "..")
    return own.select("sample_id", "path", "status", "destination", "origin", source_label(F.concat_ws("/", F.lit(root), F.col("origin"))).alias("origin_source"), outcome.alias("outcome"), (error & ~skip).alias("error"))


def move_counts(plan: DataFrame) -> DataFrame:
    """A5: a row for each status, 0 where nothing moves."""
    domain = plan.sparkSession.createDataFrame([(s,) for s in STATUSES], "status string")
    own = plan.where("outcome = 'move'").groupBy("status").agg(F.count(F.lit(1)).alias("n"))
    return domain.join(own, "status", "left").select("status", F.coalesce("n", F.lit(0)).alias("n"))


def conflicts(plan: DataFrame, existing: DataFrame) -> DataFrame:
    """(kind, destination_key): two moves to one place, or a place taken by a file that doesn't move away."""
    ends = F.array(F.struct(path_key(F.col("path")).alias("key"), F.lit("source").alias("is")), F.struct(path_key(F.col("destination")).alias("key"), F.lit("destination").alias("is")))
    tagged = plan.where("outcome = 'move'").select(F.inline(ends)).unionByName(existing.select(path_key(F.col("path")).alias("key"), F.lit("there").alias("is")))
    n = lambda what: F.count_if(F.col("is") == what)
    places = tagged.groupBy(F.col("key").alias("destination_key")).agg(n("destination").alias("come"), n("source").alias("go"), n("there").alias("there"))
    kinds = F.array_compact(F.array(F.when(F.col("come") > 1, "duplicate"), F.when((F.col("come") > 0) & (F.col("there") > 0) & (F.col("go") == 0), "exists")))
    return places.select(F.explode(kinds).alias("kind"), "destination_key")  # one pass over all three


def unique_names(names: Iterable[str], taken: Iterable[str] = ()) -> list[str]:
    """Each name in turn, with _1, _2 ... until it is free."""
    seen, out = {t.casefold() for t in taken}, []
    for name in names:
        base, dot, ext = name.rpartition(".") if "." in name[1:] else (name, "", "")
        new, k = name, 0
        while new.casefold() in seen:
            k += 1
            new = f"{base}_{k}{dot}{ext}"
        seen.add(new.casefold())
        out.append(new)
    return out


def write_atomically(path: Path, text: str) -> None:
    """K1, K15."""
    part = path.with_name(path.name + ".tmp")
    part.write_text(text, encoding="utf-8")
    os.replace(part, path)
