"""Token counts through a digest cache.

A cache is a Parquet table (tokenizer, digest, n_tokens) in a folder of the caller's, or a fresh one. Texts are joined
to it by their SHA-256 and the SHA-256 of the tokenizer's file; one copy of each text that it lacks is encoded and its
count appended; then every row is joined to the cache. Normalised content is the text as it stands, null as empty: this
tokenizer's own normaliser changes nothing, and any other rewriting would change counts.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hot_keys, join_hot, new_path

LIMIT = 4096
CACHE = "tokenizer string, digest binary, n_tokens long"
#: Distinct words whose counts a Python worker keeps, and the longest such word.
MEMO, MEMO_WORD = 150_000, 64
_PART = re.compile(" +[^ ]*")


class Counter:
    """Token counts of a sentencepiece model or a tokenizers file, without added tokens.

    Where no piece of a sentencepiece model goes on after a word into the next space, a text's count is the sum over
    its words, each with the spaces before it, and counts of words are remembered. That is looked up in the vocabulary;
    else, and for a text that holds the space's own sign, whole texts are encoded."""

    def __init__(self, path: str):
        self.memo: dict[str, int] = {}
        if path.endswith(".model"):
            import sentencepiece
            from sentencepiece import sentencepiece_model_pb2 as proto

            spec = proto.ModelProto()
            with open(path, "rb") as f:
                spec.ParseFromString(f.read())
            n = spec.normalizer_spec
            plain = n.name == "identity" and n.add_dummy_prefix and not n.remove_extra_whitespaces and not spec.trainer_spec.treat_whitespace_as_suffix
            self.by_word = plain and spec.trainer_spec.model_type == spec.trainer_spec.BPE and not any(re.search("[^▁]▁", p.piece) or p.type == 4 for p in spec.pieces)
            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.encode = lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
            self.space = self.encode(["a "])[0] - self.encode(["a"])[0]  # a last space; alone, it would be an empty text
        else:
            from tokenizers import Tokenizer

            model = Tokenizer.from_file(path)
            model.no_truncation()
            model.no_padding()
            self.by_word = False
            self.encode = lambda texts: [len(x.ids) for x in model.encode_batch(texts, add_special_tokens=False)]

    def count(self, text: str) -> int:
        if not text:
            return 0
        if not self.by_word or "▁" in text:
            return self.encode([text])[0]
        memo, total, new = self.memo, 0, {}
        for part in _PART.findall(" " + text):
            n = memo.get(part)
            if part == " ":
                total += self.space
            elif n is None:
                new[part] = new.get(part, 0) + 1
            else:
                total += n
        if new:
            if len(memo) > MEMO:
                memo.clear()
            for part, n in zip(new, self.encode([p[1:] for p in new])):
                total += n * new[part]
                if len(part) <= MEMO_WORD:
                    memo[part] = n
        return total


def file_digest(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def count_tokens(docs: DataFrame, tokenizer_path: str, cache: str | None = None, limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for each row.

    A null text is empty and has 0 tokens. Equal texts, repeated rows among them, are encoded once. An empty table gives
    an empty result. Other columns are not read. A cache written twice after a failure holds a count twice; it is read
    as a set."""
    spark = docs.sparkSession
    cache = cache or new_path(spark, "tokens")
    version = file_digest(tokenizer_path)
    spark.sparkContext.addFile(tokenizer_path)
    name = tokenizer_path.rsplit("/", 1)[-1]

    text = F.coalesce("text", F.lit(""))
    own = docs.select("doc_id", F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    spark.createDataFrame([], CACHE).write.mode("append").parquet(cache)  # a new cache is an empty one
    known = spark.read.schema(CACHE).parquet(cache).where(F.col("tokenizer") == version).select("digest", "n_tokens")
    misses = own.select("digest", "text").dropDuplicates(["digest"]).join(known.select("digest").distinct(), "digest", "left_anti")

    def encode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counter = None
        for f in frames:
            counter = counter or Counter(SparkFiles.get(name))
            yield pd.DataFrame({"tokenizer": version, "digest": f["digest"], "n_tokens": [counter.count(t) for t in f["text"]]})

    misses.mapInPandas(encode, CACHE).write.mode("append").parquet(cache)
    counts = spark.read.schema(CACHE).parquet(cache).where(F.col("tokenizer") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    own = own.select("doc_id", "digest", "n_bytes")
    out = join_hot(own, counts, "digest", hot_keys(own, "digest"))
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
