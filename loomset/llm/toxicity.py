"""Toxicity: Kneser-Ney models of toxic and of ordinary texts, compared by log-likelihood per word.

Both models are backoff models of order 2 over words, and share what tells nothing about the class. An expression is a word
after another, a word, or (of a word that isn't told apart itself) the letters that it begins with. Its counts are told
apart by class only where chance, or a shift of topics or languages between the classes, doesn't explain how they differ:
their likelihood ratio statistic G is above 2 ln(GUARD times the number of expressions of its kind), and their rates
differ by RATIO. Then, with counts less the discount D,

p_c(w) = (n_c(w) - D) / N_c + gamma p(w),   p_c(w | h) = (n_c(h w) - D) / n_c(h) + gamma(h) p_c(w),

where p(w), gamma and gamma(h) come from the counts of both classes together; of a word that isn't told apart the last term
is gamma(h) p(w | h). All other expressions back off to those shared counts, with the same weight in both models, so they
add nothing to the comparison, however rare they are and whichever class has them by accident. All counts are Kneser's and
Ney's: n_c(w) is the number of different words before w, n_c(h w) of those before h w, and that of a beginning the number of
different words that it begins. So a text, or a group of copies, that says something many times says it once.

A text's evidence is its mean log ratio by word. A logistic curve takes it to a score; the curve is fitted on evidence
that each part of the sample gets from models of the other parts, and shifted to the share of toxic rows among all labels.

The sample is bounded: about SAMPLE labelled rows of each class, chosen by hash of the id, of texts up to SAMPLE_CHARS
characters, and at most ORDINARY ordinary ones for each toxic one. Spark counts it; what the driver and each worker hold is the expressions that are told apart.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored, trim

SAMPLE, SAMPLE_CHARS, ORDINARY = 4000, 20_000, 4
FOLDS = 4
D, GUARD, RATIO = 0.75, 10.0, 3.0
#: Letters of the beginnings of words, longest first.
BEGINNINGS = (6, 4)
#: Evidence by word that counts as little; ridge of the logistic curve.
LITTLE, RIDGE = 1e-3, 1.0
#: Sequences that a task holds before it sends them on, and words that a worker remembers.
HELD, REMEMBERED = 300_000, 1_000_000
PAIR, WORD = 0, 1
_WORD = re.compile(r"\w+")
#: Models: one without each fold, and one of all.
_MODELS = [*range(FOLDS), -1]


def words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def triples(own: list[str]) -> set[tuple[str, str, str]]:
    """The different words after two others; before the first word there are empty ones."""
    return set(zip(["", "", *own], ["", *own], own))


def _mask(leave: int, toxic: int) -> int:
    """Slots of a class in all folds but one. Slot 2 f is of ordinary texts of fold f, 2 f + 1 of toxic ones."""
    return sum(1 << (2 * f + toxic) for f in range(FOLDS) if f != leave)


def _names(prefix: str) -> list[str]:
    return [f"{prefix}{m}{c}" for m in range(len(_MODELS)) for c in (0, 1)]


def _different(prefix: str) -> list[F.Column]:
    """Of each model and class how many rows of a group have a slot of it in their mask."""
    return [F.sum((F.col("mask").bitwiseAND(F.lit(_mask(m, c))) != 0).cast("long")).alias(n) for n, (m, c) in zip(_names(prefix), [(m, c) for m in _MODELS for c in (0, 1)])]


def count(sample: DataFrame) -> DataFrame:
    """(level, history, key, n...) of a sample (text, slot), written: counts of different words before, of each model and class."""

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: set = set()
        flush = lambda: pd.DataFrame(list(held), columns=["x", "h", "w", "slot"])
        for f in frames:
            for text, slot in zip(f["text"], f["slot"]):
                held.update((*t, slot) for t in triples(words(text)))
                if len(held) > HELD:
                    yield flush()
                    held.clear()
        yield flush()
        trim()

    found = sample.select("text", "slot").mapInPandas(rows, "x string, h string, w string, slot int")
    merged = F.bit_or(F.expr("shiftleft(1, slot)")).alias("mask")
    pairs = found.groupBy("x", "h", "w").agg(merged).groupBy("h", "w").agg(F.bit_or("mask").alias("mask_"), *_different("n"))
    pairs = stored(pairs.withColumnRenamed("mask_", "mask"), "pairs")
    single = pairs.groupBy("w").agg(*_different("n"))
    kinds = [pairs.select(F.lit(PAIR).alias("level"), F.col("h").alias("history"), F.col("w").alias("key"), *_names("n")), single.select(F.lit(WORD).alias("level"), F.lit("").alias("history"), F.col("w").alias("key"), *_names("n"))]
    for k, size in enumerate(BEGINNINGS):
        long = single.where(F.length("w") >= size).groupBy(F.substring("w", 1, size).alias("key")).agg(*[F.sum((F.col(n) > 0).cast("long")).alias(n) for n in _names("n")])
        kinds.append(long.select(F.lit(WORD + 1 + k).alias("level"), F.lit("").alias("history"), "key", *_names("n")))
    every = kinds[0]
    for more in kinds[1:]:
        every = every.unionByName(more)
    return stored(every, "expressions")


def told_apart(counts: DataFrame) -> tuple[list, dict[int, int]]:
    """Rows of the expressions that any of the models tells apart, with the counts h... of all that follows the same history
    and the number of followers; and the numbers of expressions by level."""
    sizes = {r["level"]: r["count"] for r in counts.groupBy("level").count().collect()}  # a row a level
    of = lambda df: df.agg(*[F.sum(n).alias(h) for n, h in zip(_names("n"), _names("h"))], F.count(F.lit(1)).alias("followers"))
    pairs = counts.where(F.col("level") == PAIR)
    alone = counts.where(F.col("level") != PAIR)
    columns = [*counts.columns, *_names("h"), "followers"]
    alone = alone.join(F.broadcast(of(alone.groupBy("level"))), "level")  # a row a level
    every = pairs.join(of(pairs.groupBy("history")), "history").select(columns).unionByName(alone.select(columns))
    least = F.when(F.col("level") == PAIR, _least(sizes.get(PAIR, 0))).otherwise(_least(sizes.get(WORD, 0)))

    def differs(m: int) -> F.Column:
        a, b, x, y = (F.col(f"{k}{m}{c}").cast("double") for k in "nh" for c in (0, 1))
        part = lambda n, of: F.when(n > 0, n * F.log(n * (x + y) / ((a + b) * of))).otherwise(0.0)
        here, there = (b + 0.5) * x, (a + 0.5) * y
        return (x > 0) & (y > 0) & (2 * (part(a, x) + part(b, y)) >= least) & (F.greatest(here, there) >= RATIO * F.least(here, there))

    any_ = differs(0)
    for m in range(1, len(_MODELS)):
        any_ = any_ | differs(m)
    return every.where(any_).orderBy("level", "history", "key").collect(), sizes


def _least(expressions: int) -> float:
    return 2 * math.log(GUARD * max(1, expressions))


def _apart(own: tuple[int, int], of: tuple[int, int], least: float) -> bool:
    if min(of) <= 0:
        return False
    g = 2 * sum(n * math.log(n * sum(of) / (sum(own) * m)) for n, m in zip(own, of) if n)
    here, there = (own[1] + 0.5) * of[0], (own[0] + 0.5) * of[1]
    return g >= least and max(here, there) >= RATIO * min(here, there)


class Model:
    """Log ratios of told expressions, by level and key; those of pairs by history and word."""

    def __init__(self, rows: list, sizes: dict[int, int], m: int = FOLDS):
        self.levels: list[dict] = [{} for _ in range(2 + len(BEGINNINGS))]
        told: dict[str, tuple[float, float]] = {}
        for r in sorted(rows, key=lambda r: -r["level"]):
            own, of = ((r[f"{k}{m}0"], r[f"{k}{m}1"]) for k in "nh")
            level = r["level"]
            if not _apart(own, of, _least(sizes.get(PAIR if level == PAIR else WORD, 0))):
                continue
            gamma = D * r["followers"] / max(r["followers"], sum(of))
            share = (sum(own) / sum(of),) * 2
            lower = told.get(r["key"], share) if level == PAIR else share
            p = [max(n - D, 0) / k + gamma * q for n, k, q in zip(own, of, lower)]
            if level == WORD:
                told[r["key"]] = (p[0], p[1])
            self.levels[level][(r["history"], r["key"]) if level == PAIR else r["key"]] = math.log(p[1] / p[0])
        self.last = {w for _, w in self.levels[PAIR]}

    def ratio(self, word: str) -> float:
        """Of a word alone; one that isn't told apart has that of its beginning, the longest that is."""
        for level, key in ((WORD, word), *((WORD + 1 + k, word[:size]) for k, size in enumerate(BEGINNINGS) if len(word) >= size)):
            if (found := self.levels[level].get(key)) is not None:
                return found
        return 0.0


class Memory(dict):
    """Ratios of the words that a worker has met."""

    def __init__(self, model: Model):
        super().__init__()
        self.model = model

    def __missing__(self, word: str) -> float:
        if len(self) >= REMEMBERED:
            self.clear()
        found = self[word] = self.model.ratio(word)
        return found


def evidence(text: str | None, memory: Memory) -> float:
    """Mean log ratio by word of a whole text; 0 without words."""
    own = words(text)
    if not own:
        return 0.0
    total, pairs, last = sum(map(memory.__getitem__, own)), memory.model.levels[PAIR], memory.model.last
    if last:
        for i in [i for i, w in enumerate(own) if w in last]:
            if (found := pairs.get((own[i - 1] if i else "", own[i]))) is not None:
                total += found - memory[own[i]]
    return total / len(own)


class Curve:
    """score = 1 / (1 + exp(-(a + b g(x)))) of evidence x, g its signed logarithm."""

    def __init__(self, a: float, b: float):
        self.a, self.b = a, b

    @staticmethod
    def _bent(x: np.ndarray) -> np.ndarray:
        return np.sign(x) * np.log1p(np.abs(x) / LITTLE)

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, share: float) -> Curve:
        """share: of toxic rows among all; the fit is shifted from their share among y to it."""
        f = np.column_stack([np.ones(len(x)), cls._bent(x)])
        w = np.zeros(2)
        for _ in range(100):
            p = 1 / (1 + np.exp(-(f @ w)))
            step = np.linalg.solve((f * (p * (1 - p))[:, None]).T @ f + np.diag([1e-6, RIDGE]), f.T @ (y - p) - np.array([0.0, RIDGE]) * w)
            w = w + np.clip(step, -2, 2)
            if np.abs(step).max() < 1e-9:
                break
        own = y.mean()
        return cls(float(w[0] + math.log(share / (1 - share)) - math.log(own / (1 - own))), float(max(w[1], 0.0)))

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.a + self.b * self._bent(x), -500, 500)))


def _held_out(doc_id: F.Column) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def sampled(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE) -> tuple[DataFrame | None, float]:
    """The bounded sample (text, slot), written, and the share of toxic rows among all labels to learn from. No sample where
    a class is missing. An id that has several labels is toxic if one of them says so, and so is a text of several ids; of several texts an id has the first."""
    own = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~_held_out(F.col("doc_id")))
    own = own.groupBy(F.col("doc_id").alias("label_id")).agg(F.max("toxic").alias("toxic"))
    number = {r["toxic"]: r["count"] for r in own.groupBy("toxic").count().collect()}
    share = number.get(1, 0) / max(1, sum(number.values()))
    if len(number) < 2:
        return None, share
    place = F.pmod(F.xxhash64("label_id", F.lit(12)), F.lit(1 << 30))
    wanted = {1: min(rows, number[1])}
    wanted[0] = min(rows, ORDINARY * wanted[1], number[0])
    most = F.when(F.col("toxic") == 1, int(wanted[1] / number[1] * (1 << 30))).otherwise(int(wanted[0] / number[0] * (1 << 30)))
    chosen = F.broadcast(own.where(place < most))  # about 2 * rows ids at most
    fit = docs.where(F.length("text") <= SAMPLE_CHARS).join(chosen, F.col("doc_id") == F.col("label_id")).groupBy("label_id", "toxic").agg(F.min("text").alias("text"))
    fit = fit.groupBy("text").agg(F.max("toxic").alias("toxic"))
    fold = F.pmod(F.xxhash64("text", F.lit(13)), F.lit(FOLDS))
    return stored(fit.select("text", (2 * fold + F.col("toxic")).cast("int").alias("slot")), "sample"), share


def _no_model(share: float) -> tuple[Model, Curve]:
    return Model([], {}), Curve(math.log(max(share, 1e-9) / max(1 - share, 1e-9)), 0.0)


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE) -> tuple[Model, Curve]:
    sample, share = sampled(docs, labels, rows)
    if sample is None:
        return _no_model(share)
    told, sizes = told_apart(count(sample))
    held = docs.sparkSession.sparkContext.broadcast([Model(told, sizes, m) for m in range(FOLDS)])

    def judge(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memories = [Memory(m) for m in held.value]
        for f in frames:
            yield pd.DataFrame({"slot": f["slot"], "x": [evidence(t, memories[s // 2]) for t, s in zip(f["text"], f["slot"])]})

    pairs = sorted((r["slot"] % 2, r["x"]) for r in sample.mapInPandas(judge, "slot int, x double").collect())  # a number a row of the sample
    y, x = np.array([p[0] for p in pairs], float), np.array([p[1] for p in pairs])
    if len(set(y)) < 2:
        return _no_model(share)
    return Model(told, sizes), Curve.fit(x, y, share)


def score(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, score, predicted, evidence) for each row of docs; labels: (doc_id, toxic).

    A null text is empty; texts without words get the score of no evidence. Very long texts are judged whole, repeated rows
    alike. A row without an id is held out. Where the labels to learn from lack a class every score is their share of toxic
    ones; an empty table gives an empty result. Labels of ids that no document has, null labels and labels other than 0 and
    1 are not learned from. Other columns are not read."""
    held = docs.sparkSession.sparkContext.broadcast(train(docs, labels, rows))

    @F.pandas_udf("score double, predicted int, evidence double")
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model, curve = held.value
        memory = Memory(model)
        for texts in batches:
            x = np.array([evidence(t, memory) for t in texts])
            s = curve.score(x)
            yield pd.DataFrame({"score": s, "predicted": (s >= 0.5).astype(np.int32), "evidence": x})
        trim()

    return docs.select("doc_id", _held_out(F.col("doc_id")).alias("held_out"), judge("text").alias("x")).select("doc_id", "held_out", "x.*")
