"""M1: the recommendation kept up to date from a log of edits, without choosing anew from all rows.

Samples lie in a versioned snapshot. An edit is of one of two kinds, human (a manual status, set or cleared) or analysis
(metrics, whether the sample qualifies, whether it is gone), and has a number; of each sample and kind the edit with the
highest number holds, whichever comes first. So edits may come in any order, late, or again.

What the choice is made from is kept beside it, as one state that is switched like a version: how many rows of the pool
each stratum (scale, yaw) has, and its best ones, the head: always all that are not worse than some row. A batch of edits
takes the pool's rows that it touches out of the heads and puts their new ones in, where they aren't worse than the head's
last. A head that has got too short for the target is filled up from the rows of its stratum alone; a group's best row
is found anew where a member was edited. The quotas and ranks of quota.choose then run over the heads."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.expressions import base_status, effective_status, rank_key
from ..schema import PICKED, SCALES, YAWS
from ..storage import Folder
from ..streaming.snapshots import Snapshots
from . import quota

ANALYSIS = "person_scale string, angle_class string, duplicate_group long, eligibility string, face_quality double, brisque double, blur double, qualified boolean, gone boolean"
ROWS = f"ord long, {ANALYSIS}, seq_analysis long, manual_status string, seq_human long"
EDITS = f"ord long, kind string, seq long, manual_status string, {ANALYSIS}"
POOL = "ord long, person_scale string, angle_class string, face_quality double, brisque double, blur double"
_OF = [c.split()[0] for c in ANALYSIS.split(", ")]
_POOL = [c.split()[0] for c in POOL.split(", ")]
#: A head is filled up to this many times the target, and again where fewer than LEAST times are left: a choice never takes more
#: than twice the target from a stratum.
MOST, LEAST = 4, 2


def latest_edits(old: DataFrame, edits: DataFrame) -> DataFrame:
    """Rows of ROWS with edits of EDITS laid over them."""
    analysis, human = F.struct(*_OF), F.struct("manual_status")
    part = lambda df, sa, a, sh, h: df.select("ord", sa.cast("long").alias("sa"), a.alias("a"), sh.cast("long").alias("sh"), h.alias("h"))
    is_human = F.col("kind") == "human"
    both = part(old, F.col("seq_analysis"), analysis, F.col("seq_human"), human).unionByName(part(edits, F.when(~is_human, F.col("seq")), F.when(~is_human, analysis), F.when(is_human, F.col("seq")), F.when(is_human, human)))
    last = both.groupBy("ord").agg(F.max(F.struct("sa", "a")).alias("x"), F.max(F.struct("sh", "h")).alias("y"))
    return last.select("ord", *[F.col(f"x.a.{c}").alias(c) for c in _OF], F.col("x.sa").alias("seq_analysis"), F.col("y.h.manual_status").alias("manual_status"), F.col("y.sh").alias("seq_human"))


def pool_of(rows: DataFrame) -> DataFrame:
    """The pool: qualified rows without a group, and of each group the best qualified one. Groups are pre-aggregated, so that
    one of any size is no task's."""
    own = rows.where("qualified and not coalesce(gone, false)")
    grouped = own.where("duplicate_group <> 0").groupBy("duplicate_group").agg(F.min_by(F.struct(*_POOL), rank_key()).alias("r")).select("r.*")
    return own.where("duplicate_group = 0").select(*_POOL).unionByName(grouped)


def _stratum() -> list[Column]:
    return [F.col("person_scale"), F.when(F.col("angle_class").isin(*YAWS), F.col("angle_class")).otherwise("").alias("yaw")]


class LiveRecommendation:
    """A recommendation of `target` samples that edits keep up to date. One writer at a time."""

    def __init__(self, spark: SparkSession, folder: str, target: int, buckets: int = 64):
        self.spark, self.target = spark, max(0, target)
        self.rows = Snapshots(spark, f"{folder}/rows", ROWS, "ord", buckets)
        self.folder = Folder(spark, f"{folder}/state")

    def state(self) -> dict:
        """The newest state of these rows for this target, or the number 0."""
        for name in reversed([n for n in self.folder.names("log") if n.endswith(".json")]):
            try:
                return json.loads(self.folder.read(f"log/{name}")) | {"number": int(name[:-5])}
            except ValueError:
                continue
        return {"number": 0, "rows": 0, "target": None, "counts": [], "heads": None}

    def _heads(self, state: dict) -> DataFrame:
        return self.spark.read.schema(POOL).parquet(f"{self.folder.path}/{state['heads']}") if state["heads"] else self.spark.createDataFrame([], POOL)

    def _keep(self, state: dict, heads: DataFrame, counts: dict[tuple[str, str], int], version: int) -> None:
        place = f"heads/{state['number'] + 1:010d}-{uuid.uuid4().hex}"
        heads.select(*_POOL).coalesce(1).write.parquet(f"{self.folder.path}/{place}")  # MOST times the target of each stratum at most
        entry = {"rows": version, "target": self.target, "counts": [[s, y, n] for (s, y), n in sorted(counts.items()) if n], "heads": place}
        self.folder.create(f"log/{state['number'] + 1:010d}.json", json.dumps(entry, ensure_ascii=False))

    def _top(self, pool: DataFrame) -> DataFrame:
        """The best of each stratum, as many as a head may have."""
        own = pool.select("*", *_stratum()[1:])
        ranked = own.withColumn("place", F.row_number().over(Window.partitionBy("person_scale", "yaw").orderBy(rank_key())))
        return ranked.where(F.col("place") <= max(1, MOST * self.target)).select(*_POOL)

    def _counts(self, pool: DataFrame) -> dict[tuple[str, str], int]:
        own = pool.where(F.col("person_scale").isin(*SCALES))
        return {(r["person_scale"], r["yaw"]): r["count"] for r in own.groupBy(*_stratum()).count().collect()}  # a row a stratum

    def rebuild(self) -> None:
        """Heads and counts anew from all rows, as after a new grouping or for another target."""
        version = self.rows.current()["number"]
        pool = pool_of(self.rows.read())
        self._keep(self.state(), self._top(pool.where(F.col("person_scale").isin(*SCALES))), self._counts(pool), version)

    def apply(self, edits: DataFrame, epoch: int | None = None) -> None:
        """Edits (EDITS) go in. A group of a sample must stay what it is: after a new grouping, rebuild()."""
        before, state = self.rows.current()["number"], self.state()
        edits = edits.select(*[c.split()[0] for c in EDITS.split(", ")]).persist()
        try:
            after = self.rows.merge(edits, latest_edits, "edits" if epoch is not None else None, epoch)
            if state["rows"] != before or state["target"] != self.target:
                return self.rebuild()  # the last writer died between the two switches, or the target is another
            if after != before:
                self._carry(state, edits, before, after)
        finally:
            edits.unpersist()

    def _touched(self, edits: DataFrame, version: int) -> DataFrame:
        """The pool's rows of a version that edits may have changed: edited samples, and the best of their groups."""
        if not version:
            return self.spark.createDataFrame([], POOL)
        rows, ids = self.rows.read(version), F.broadcast(edits.where("kind <> 'human'").select("ord").distinct())
        own = rows.join(ids, "ord", "left_semi")
        groups = F.broadcast(self._groups)
        return pool_of(own.where("duplicate_group = 0").unionByName(rows.join(groups, "duplicate_group", "left_semi").select(*rows.columns)))

    def _carry(self, state: dict, edits: DataFrame, before: int, after: int) -> None:
        self._groups = edits.where("kind <> 'human' and duplicate_group <> 0").select("duplicate_group").distinct().persist()
        strata = F.col("person_scale").isin(*SCALES)
        old, new = (self._touched(edits, v).where(strata).persist() for v in (before, after))
        try:
            counts = {(s, y): n for s, y, n in state["counts"]}
            was = dict(counts)
            for pool, sign in ((old, -1), (new, 1)):
                for k, n in self._counts(pool).items():
                    counts[k] = counts.get(k, 0) + sign * n
            heads = self._heads(state)
            whole = self._whole(heads, was)
            mixed = heads.select("*", F.lit(True).alias("was")).unionByName(new.select("*", F.lit(False).alias("was"))).select("*", *_stratum()[1:])
            mixed = mixed.join(F.broadcast(old.select("ord", F.lit(True).alias("out"))), "ord", "left").join(F.broadcast(whole), ["person_scale", "yaw"], "left")
            # Not worse than the old head's last row, or the old head had all rows: then it is known to be among the best. Heads
            # are short, so their last rows are found beforehand and no stratum is one task.
            last = heads.select("*", *_stratum()[1:]).groupBy("person_scale", "yaw").agg(F.max(rank_key()).alias("last"))
            mixed = mixed.withColumn("key", rank_key()).join(F.broadcast(last), ["person_scale", "yaw"], "left")
            mixed = mixed.withColumn("known", F.coalesce("whole", F.lit(True)) | F.coalesce(F.col("key") <= F.col("last"), F.lit(False)))
            left = mixed.where("known and not (was and coalesce(out, false))")
            left = self._top(left.select(*_POOL)).persist()
            have = self._sizes(left)
            short = [k for k, n in counts.items() if have.get(k, 0) < min(n, max(1, LEAST * self.target))]
            heads = left
            if short:
                keys = F.broadcast(self.spark.createDataFrame(short, "person_scale string, yaw string"))
                pool = pool_of(self.rows.read(after)).where(strata).select("*", *_stratum()[1:])
                mine = pool.join(keys, ["person_scale", "yaw"], "left_semi").select(*_POOL)
                heads = left.select("*", *_stratum()[1:]).join(keys, ["person_scale", "yaw"], "left_anti").select(*_POOL).unionByName(self._top(mine))
            self._keep(state, heads, counts, after)
            left.unpersist()
        finally:
            for t in (old, new, self._groups):
                t.unpersist()

    def _sizes(self, heads: DataFrame) -> dict[tuple[str, str], int]:
        return {(r["person_scale"], r["yaw"]): r["count"] for r in heads.groupBy(*_stratum()).count().collect()}  # a row a stratum

    def _whole(self, heads: DataFrame, counts: dict[tuple[str, str], int]) -> DataFrame:
        """(person_scale, yaw, whole): whether a head has all rows of its stratum."""
        have = self._sizes(heads)
        rows = [(s, y, have.get((s, y), 0) >= n) for (s, y), n in counts.items()]
        return self.spark.createDataFrame(rows, "person_scale string, yaw string, whole boolean")

    def chosen(self) -> DataFrame:
        """(ord): what is recommended now."""
        state = self.state()
        if state["rows"] != self.rows.current()["number"] or state["target"] != self.target:
            self.rebuild()
            state = self.state()
        counts = {(s, y): n for s, y, n in state["counts"]}
        return quota.choose(self._heads(state), self.target, counts).select("ord")

    def statuses(self) -> DataFrame:
        """(ord, auto_status, status) of every sample that isn't gone."""
        rows = self.rows.read().where("not coalesce(gone, false) and eligibility is not null")
        own = rows.join(F.broadcast(self.chosen().select("ord", F.lit(True).alias("chosen"))), "ord", "left")
        own = own.withColumn("auto_status", F.when(F.col("chosen"), PICKED).otherwise(base_status(F.col("eligibility"))))
        return own.select("ord", "auto_status", effective_status(F.col("manual_status"), F.col("auto_status")).alias("status"))
