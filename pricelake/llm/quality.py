"""Quality by importance resampling: hashed n-gram models of target and raw text.

Two generative models draw a text's n-grams (words, word pairs, pairs of word
shapes) from hash buckets: the target's, counted on a bounded sample of documents
labelled good, and the raw one, counted on every document.  A text's weight is
the log ratio of its probabilities under the two, summed over its n-grams.
Documents are drawn without replacement, with odds that follow the ratio, by
Gumbel top-k: a document's key is its weight plus Gumbel noise from a hash of its
identifier, and those with the k largest keys stay.  k is a share of the
documents: a parameter, or by default the share of good ones among the labelled.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricelake.llm import memory
from pricelake.llm.common import checkpointed, scratch, text_of

#: Hash buckets of each of the three n-gram orders (word, word pair, shape pair).
BUCKETS = 1 << 16
ORDERS = 3
#: Labelled rows that fitting reads at most: those whose identifiers hash lowest.
LABELLED_MOST = 20_000
#: Distinct tokens that a worker remembers.
TOKENS_MOST = 400_000
#: Keys that may meet on the driver when the k-th largest is sought.
EXACT_MOST = 20_000
_TOKENS = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+").findall
_REPEAT = 255


def _shape(token: str) -> int:
    """0 to 4: lower, capital, upper, mixed, digits; other tokens by their characters; 255: as the token before."""
    if token.isalpha():
        return 0 if token.islower() else 1 if token[:1].isupper() and (token[1:].islower() or len(token) == 1) else 2 if token.isupper() else 3
    return 4 if token.isdigit() else 5 + zlib.crc32(token.encode("utf-8", "surrogatepass")) % 250


class _Tokens(dict):
    """token -> hash << 8 | shape; bounded."""

    def __missing__(self, token: str) -> int:
        if len(self) > TOKENS_MOST:
            self.clear()
        word = zlib.crc32(token.lower().encode("utf-8", "surrogatepass"))
        self[token] = value = word << 8 | _shape(token)
        return value

    def forget(self) -> None:
        self.clear()


_known = _Tokens()


def ngrams(text: str) -> list[np.ndarray]:
    """For each order, the buckets of the text's n-grams."""
    memory.use(_known)
    found = _TOKENS(text)
    codes = np.fromiter(map(_known.__getitem__, found), dtype=np.int64, count=len(found))
    words, shapes = codes >> 8, codes & 255
    shapes[1:][words[1:] == words[:-1]] = _REPEAT
    pairs = (words[:-1] * 0x9E3779B1 + words[1:] * 0x85EBCA6B & 0xFFFFFFFF) >> 16
    return [words % BUCKETS, pairs % BUCKETS, shapes[:-1] * 256 + shapes[1:]]


def _counts(texts: DataFrame) -> np.ndarray:
    """(order, bucket) -> n-grams in all texts; what travels is bounded by the buckets for each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((ORDERS, BUCKETS), dtype=np.int64)
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                each = [ngrams(x) for x in batch.column("text").slice(low, 256).to_pylist()]
                for order, got in enumerate(zip(*each, strict=True)):
                    total[order] += np.bincount(np.concatenate(got), minlength=BUCKETS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total.reshape(-1)[at])], names=["at", "n"])

    rows = texts.mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(ORDERS * BUCKETS, dtype=np.int64)
    for r in rows:
        out[r["at"]] = r["n"]
    return out.reshape(ORDERS, BUCKETS)


@dataclass
class Model:
    """The log ratio of each order's buckets, and the share of documents to draw."""

    ratios: np.ndarray
    share: float

    def weights(self, texts: pd.Series) -> np.ndarray:
        """The log of each text's probability under the target's model over that under the raw one."""
        return np.array([sum(float(self.ratios[k][got].sum()) for k, got in enumerate(ngrams(x or ""))) for x in texts])

    def weight(self, text: Column) -> Column:
        """A column of weights; a text without tokens weighs 0."""
        own = self

        @F.pandas_udf("double")
        def weigh(texts: pd.Series) -> pd.Series:
            return pd.Series(own.weights(texts), dtype="float64")

        return weigh(text)


def good_share(good: int, labelled: int) -> float:
    """The share of good documents in a labelled sample plus one standard error, as a clean document lost weighs more than a bad one kept."""
    if not 0 < good < labelled:
        return 1.0
    share = good / labelled
    return min(1.0, share + math.sqrt(share * (1 - share) / labelled))


def fit(docs: DataFrame, labels: DataFrame, keep: float | None = None, text_col: str = "text", id_col: str = "doc_id") -> Model:
    """Counts the models.  labels: (doc_id, quality); rows with a null in either count for nothing.

    keep: the share of documents to draw; by default good_share() of the labelled
    sample.  Without labels of both kinds every text is drawn.
    """
    marks = labels.select(F.col("doc_id").alias("id"), (F.col("quality") > 0).alias("good")).dropna()
    marks = marks.groupBy("id").agg(F.min("good").alias("good")).orderBy(F.xxhash64("id"), "id").limit(LABELLED_MOST)
    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    sample = checkpointed(rows.join(F.broadcast(marks), "id"))
    target, raw = _counts(sample.where("good").select("text")), _counts(rows.select("text"))
    share = lambda c: (c + 0.5) / (c.sum(axis=1, keepdims=True) + 0.5 * BUCKETS)
    # A bucket as rare as one in the target says nothing: both counts are smoothed on the target's scale.
    scaled = raw * (np.maximum(1, target.sum(axis=1, keepdims=True)) / np.maximum(1, raw.sum(axis=1, keepdims=True)))
    seen = sample.agg(F.count_if("good").alias("good"), F.count("*").alias("labelled")).first()
    return Model(np.log(share(target)) - np.log(share(scaled)), good_share(seen.good, seen.labelled) if keep is None else keep)


def _key(weight: Column, ident: Column) -> Column:
    """The weight plus standard Gumbel noise."""
    uniform = (F.shiftrightunsigned(F.xxhash64(ident, F.lit(2024)), 11) + F.lit(0.5)) / F.lit(float(2**53))
    return weight - F.log(-F.log(uniform))


def _kth_largest(keys: DataFrame, k: int) -> float:
    """The k-th largest of a column named key, exactly, by halving its range in counts of 1,024 parts."""
    low, high = keys.agg(F.min("key"), F.max("key")).first()
    above = 0
    while True:
        inside = keys.where(F.col("key").between(low, high))
        n = inside.count()
        if n <= EXACT_MOST or high <= low:
            got = sorted((r.key for r in inside.select("key").collect()), reverse=True) if n <= EXACT_MOST else [high] * n
            return got[k - above - 1]
        step = (high - low) / 1024
        part = F.least(F.floor((F.col("key") - low) / step), F.lit(1023)).alias("part")
        parts = inside.groupBy(part).agg(F.count("*").alias("n"), F.min("key").alias("low"), F.max("key").alias("high")).collect()
        for r in sorted(parts, key=lambda r: -r["part"]):
            if above + r.n >= k:
                low, high = r.low, r.high
                break
            above += r.n


def _draw(keys: DataFrame, share: float) -> float:
    """The least key that stays, for rows of key."""
    k = round(share * keys.count())
    return _kth_largest(keys, k) if k else float("inf")


def quality_weights(docs: DataFrame, labels: DataFrame, keep: float | None = None, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """For each row: doc_id, weight, key, kept.

    A null text counts as empty and weighs 0; a null identifier has noise like
    any other.  Rows alike in text and identifier have one key, and all of the
    rows at the k-th largest key stay.  An empty table gives no rows.  A very
    long text is weighed whole, by all of its n-grams.  Other columns play no
    part, whatever their names.
    """
    model = fit(docs, labels, keep, text_col, id_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), model.weight(text_of(text_col)).alias("weight"))
    scored = checkpointed(rows.withColumn("key", _key(F.col("weight"), F.col("doc_id"))))
    return scored.withColumn("kept", F.col("key") >= F.lit(_draw(scored.select("key"), model.share)))


def keep_quality(docs: DataFrame, labels: DataFrame, keep: float | None = None, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The rows of docs that quality_weights keeps, all columns unchanged; each text is weighed once."""
    spark = docs.sparkSession
    model = fit(docs, labels, keep, text_col, id_col)
    path = scratch(spark, "weighed")
    key = _key(model.weight(text_of(text_col)), F.col(id_col))
    docs.select(F.struct("*").alias("row"), key.alias("key")).write.parquet(path)
    weighed = spark.read.parquet(path)
    return weighed.where(F.col("key") >= F.lit(_draw(weighed.select("key"), model.share))).select("row.*")
