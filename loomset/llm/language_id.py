"""Language ID: averaged hashed subword embeddings, a linear softmax on them, SGD in numpy, calibrated rejection.

A text's letters are lower-cased and all else is a word border. Features are the 1- to 4-grams of the letters of each
word with its borders, hashed into BUCKETS rows of an embedding; a text is the mean over all its features, of the whole
text. As embedding and classifier are linear, a trained model is one table of logits by bucket.

Training reads a bounded sample: at most SAMPLE texts of each label and SAMPLE_ROWS in all, those with the smallest hashes,
of up to SAMPLE_CHARS characters; only a label with too few of these learns from LONG of its shortest longer texts too.
A fifth of the sample is held back. On it, whole, in short pieces and in pieces of two labels, a temperature is fitted, so
that scores are calibrated. A text is rejected by its likeness: the mean log-likelihood of its features under the label
that they fit best. The threshold is calibrated on labels left out: OTHER of the held-back texts, judged as if their own
label had not been learned, lie below it; but never more than REJECT of them (and of their pieces) judged with it. The
score plays no part: the softmax is sure of many texts in languages that it has not learned, and unsure of a text that
mixes two learned ones, which stays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import trim

BUCKETS = 1 << 15
DIM = 12
GRAMS = (1, 2, 3, 4)
SAMPLE, SAMPLE_ROWS, SAMPLE_CHARS, LONG = 500, 20_000, 20_000, 20
EPOCHS, RATE = 5, 2.0
REJECT, OTHER = 0.001, 0.6
#: Added to counts of features for likelihoods; characters of the pieces that calibration judges.
ADD, PIECE = 0.01, (20, 60, 200)
#: Labels that are learned; where there are more, the most frequent ones.
MAX_LABELS = 200
NONE = "und"
#: Characters of a piece of a long text, at most, and of the pieces whose features are taken together, about.
_CHUNK, _GROUP = 1 << 18, 1 << 16

_letters: list[np.ndarray] = []


def _is_letter(points: np.ndarray) -> np.ndarray:
    if not _letters:
        _letters.append(np.array([0xD800 > c or c > 0xDFFF for c in range(0x10000)]) & np.array([chr(c).isalpha() if not 0xD800 <= c <= 0xDFFF else False for c in range(0x10000)]))
    out = _letters[0][np.minimum(points, 0xFFFF)]
    far = np.flatnonzero(points > 0xFFFF)
    if len(far):
        out[far] = [chr(c).isalpha() for c in points[far].tolist()]
    return out


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, text) of every feature of the texts, and whether each text has a letter."""
    joined = "\n".join(t.lower() for t in texts) + "\n"
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum([len(t.lower()) + 1 for t in texts])
    return _features(points, ends)


def _features(points: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    letter = _is_letter(points)
    near = letter.copy()  # letters and the borders beside them; runs of other characters shrink to their ends
    near[1:] |= letter[:-1]
    near[:-1] |= letter[1:]
    owner = np.searchsorted(ends, np.flatnonzero(near), side="right")
    has = np.zeros(len(ends), bool)
    code = np.where(letter, points, 32)[near].astype(np.uint32)
    border = code == 32
    has[owner[~border]] = True
    buckets, of = [], []
    h = np.zeros(len(code), np.uint32)
    inside = np.ones(len(code), bool)
    for n in range(1, max(GRAMS) + 1):
        m = len(code) - n + 1
        if m <= 0:
            break
        h = h[:m] * np.uint32(0x01000193) + (code[n - 1 :] + np.uint32(1)) * np.uint32(0x9E3779B1)
        inside = inside[:m] if n < 3 else inside[:m] & ~border[n - 2 : n - 2 + m]  # no border but the first and the last
        keep = inside & ~(border[:m] & border[n - 1 :]) & (owner[:m] == owner[n - 1 :]) if n > 1 else ~border
        if n in GRAMS:
            x = h[keep] ^ (h[keep] >> np.uint32(15))
            buckets.append((x * np.uint32(0x85EBCA6B) >> np.uint32(17)) % np.uint32(BUCKETS))
            of.append(owner[:m][keep])
    return np.concatenate(buckets or [np.zeros(0, np.uint32)]), np.concatenate(of or [np.zeros(0, np.int64)]), has


class Model:
    """labels, a table by bucket (logits of the labels, then log-likelihoods under them), bias, temperature and the
    likeness below which a text is rejected."""

    def __init__(self, labels: list[str], table: np.ndarray, bias: np.ndarray, heat: float, least: float = 0.0):
        self.labels, self.table, self.bias, self.heat, self.least = labels, table, bias, heat, least

    def _mean(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Mean of the table's rows over each text, and whether it has a letter. Long texts are taken in pieces, all of them."""
        total, count, any_letter = np.zeros((len(texts), self.table.shape[1])), np.zeros(len(texts)), np.zeros(len(texts), bool)
        for which, parts in _pieces(texts):
            bucket, of, has = features(parts)
            for c in range(self.table.shape[1]):
                np.add.at(total[:, c], which, np.bincount(of, self.table[bucket, c], len(parts)))
            np.add.at(count, which, np.bincount(of, minlength=len(parts)))
            np.logical_or.at(any_letter, which, has)
        return total / np.maximum(count, 1)[:, None], any_letter

    def judge(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Label, score and whether it is rejected, of each text."""
        if not self.labels:
            return [NONE] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        mean, has = self._mean([t or "" for t in texts])
        k = len(self.labels)
        p = _softmax((mean[:, :k] + self.bias) / self.heat)
        best, score = p.argmax(1), np.where(has, p.max(1), 0.0)
        return [self.labels[k] if h else NONE for k, h in zip(best, has)], score, ~has | (mean[:, k:].max(1) < self.least)

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        return self.judge(texts)[:2]


def _pieces(texts: list[str]) -> Iterator[tuple[list[int], list[str]]]:
    which, parts, size = [], [], 0
    for i, t in enumerate(texts):
        at = 0
        while at < len(t) or at == 0:
            end = at + _CHUNK
            if end < len(t):  # cut at a space, or in a word that has none
                space = t.rfind(" ", at + 1, end)
                end = space if space > at else end
            which.append(i)
            parts.append(t[at:end])
            size += len(parts[-1])
            at = max(end, at + 1)
            if size >= _GROUP:
                yield which, parts
                which, parts, size = [], [], 0
    if parts:
        yield which, parts


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def train(rows: list[tuple[str, str]], seed: int = 7) -> Model:
    """rows: (text, label). No rows: a model without labels, which rejects everything."""
    labels = sorted({y for _, y in rows})
    if not labels:
        return Model([], np.zeros((BUCKETS, 0)), np.zeros(0), 1.0)
    rng, rows = np.random.default_rng(seed), sorted(rows)
    rows = [rows[i] for i in rng.permutation(len(rows))]
    held = len(rows) // 5
    bags = []
    for text, y in rows:
        bucket, _, _ = features([text])
        ids, n = np.unique(bucket, return_counts=True)
        bags.append((ids, (n / max(1, n.sum())).astype(np.float64), labels.index(y)))
    embed = rng.normal(0, 0.1, (BUCKETS, DIM))
    out, bias = rng.normal(0, 0.1, (DIM, len(labels))), np.zeros(len(labels))
    learn = bags[held:]
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        for i in rng.permutation(len(learn)):
            ids, share, y = learn[i]
            x = share @ embed[ids]
            p = _softmax((x @ out + bias)[None])[0]
            p[y] -= 1
            grad = out @ p
            out -= rate * 0.1 * np.outer(x, p)
            bias -= rate * 0.01 * p
            embed[ids] -= rate * len(ids) * 0.05 * share[:, None] * grad[None]
    counts = np.zeros((BUCKETS, len(labels)))
    for text, y in rows[held:]:
        bucket = features([text])[0]
        counts[:, labels.index(y)] += np.bincount(bucket, minlength=BUCKETS)
    model = Model(labels, np.column_stack([embed @ out, np.log((counts + ADD) / (counts.sum(0) + ADD * BUCKETS))]), bias, 1.0)
    _calibrate(model, rows[:held] or rows, rng)
    return model


def _calibrate(model: Model, check: list[tuple[str, str]], rng: np.random.Generator) -> None:
    """Sets the temperature and the threshold of rejection from texts that were held back."""
    k, number = len(model.labels), {y: i for i, y in enumerate(model.labels)}

    def piece(text: str, size: int) -> str:
        at = int(rng.integers(0, max(1, len(text) - size + 1)))
        return text[at : at + size]

    short = [(piece(t, n), y) for t, y in check for n in PIECE]
    mixed = [(piece(t, 120) + " " + piece(u, 60), y) for (t, y), (u, _) in zip(check, check[1:])]

    def means(texts: list[tuple[str, str]]) -> tuple[np.ndarray, np.ndarray]:
        mean, has = model._mean([t for t, _ in texts])
        return mean[has], np.array([number[y] for _, y in texts], int)[has]

    mean, y = means([*check, *short, *mixed])
    if not len(y):
        return
    z = mean[:, :k] + model.bias
    loss = lambda heat: -np.log(_softmax(z / heat)[np.arange(len(y)), y] + 1e-12).mean()
    model.heat = float(min(np.geomspace(0.01, 20, 100), key=loss))
    like = np.sort(means([*check, *short[2::3]])[0][:, k:].max(1))
    model.least = float(like[int(REJECT * len(like))])
    whole, y = means(check)
    if k > 1 and len(y):
        other = whole[:, k:].copy()
        other[np.arange(len(y)), y] = -np.inf
        model.least = min(model.least, float(np.quantile(other.max(1), OTHER)))


def sample(docs: DataFrame) -> list[tuple[str, str]]:
    """The bounded training sample; the share of each label to read comes from the label's count over all rows. Rows that
    are there many times are one."""
    key = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    fit = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & (key % 4 != 2))
    fit = fit.select("lang", "text", F.length("text").alias("n"), F.pmod(F.xxhash64("doc_id", "text", F.lit(11)), F.lit(1 << 30)).alias("d"))
    short = F.col("n") <= SAMPLE_CHARS
    labels = fit.groupBy("lang").agg(F.count(F.when(short, 1)).alias("few"), F.count(F.lit(1)).alias("all")).orderBy(F.desc("all"), "lang").limit(MAX_LABELS).collect()
    each = min(SAMPLE, SAMPLE_ROWS // max(1, len(labels)))
    pick = F.lit(False)
    for r in labels:
        if r["few"]:
            pick = pick | ((F.col("lang") == r["lang"]) & (F.col("d") < int(min(1.0, 1.3 * each / r["few"]) * (1 << 30))))
    rows = fit.where(short & pick).distinct().orderBy("d", "lang", "text").limit(2 * each * max(1, len(labels))).collect() if labels else []
    scarce = [r["lang"] for r in labels if r["few"] < min(each, r["all"])]
    if scarce:
        rows += fit.where(~short & F.col("lang").isin(scarce)).distinct().orderBy("n", "d", "text").limit(LONG).collect()
    taken: dict[str, list] = {}
    for r in rows:
        if len(mine := taken.setdefault(r["lang"], [])) < each:
            mine.append((r["text"], r["lang"]))
    return [x for mine in taken.values() for x in mine]


def predictor(docs: DataFrame, model: Model | None = None):
    """A column function: text -> struct(lang_pred, score, rejected). The model is a broadcast of fixed size."""
    held = docs.sparkSession.sparkContext.broadcast(model or train(sample(docs)))

    @F.pandas_udf("lang_pred string, score double, rejected boolean")
    def predict(text: pd.Series) -> pd.DataFrame:
        lang, score, rejected = held.value.judge([None if t is None else t for t in text])
        trim()
        return pd.DataFrame({"lang_pred": lang, "score": score, "rejected": rejected})

    return predict


def identify(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, rejected) for each row.

    A null text, a text without a letter, and any text where nothing is labelled: `und`, score 0, rejected. Very long texts
    are taken in pieces, all of them. Repeated rows are predicted alike. An empty table gives an empty result. Other
    columns than doc_id, text and lang are not read; lang is read only for the sample."""
    predict = predictor(docs)
    key = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    held = F.coalesce(key % 4 == 2, F.lit(True))
    return docs.select("doc_id", held.alias("held_out"), predict("text").alias("x")).select("doc_id", "held_out", "x.*")
