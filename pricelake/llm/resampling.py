"""Importance resampling towards a target's distribution.

Every text is a bag of features (runs of words) in hash buckets.  A bucket's
gain tells how much more frequent it is in the target's texts than in all
documents; a document's weight is the mean gain of its features, read from one
array of gains.  Documents are drawn without replacement by weight plus Gumbel
noise from a hash of their identifier: those with the highest scores, which a
distributed radix sort puts in order.

Sizes: counts are arrays of a fixed number of buckets, summed in each task; only
they reach the driver, and only the gains are broadcast.  The sort moves five
integers a document, never texts.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricelake.llm import memory
from pricelake.llm.common import checkpointed, text_of
from pricelake.llm.radix import ranked

#: Hash buckets of features, and the seed of the noise.
BUCKETS = 10_000
SEED = 2024
#: Bytes of a text that are split into words at a time.
STRETCH = 1 << 20
#: Distinct words that a worker remembers.
REMEMBERED = 400_000
#: A-Z in lower case; digits, letters and all bytes beyond ASCII as they are; anything else is a blank.
_PLAIN = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


class _Codes(dict):
    """word -> crc32; bounded."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = value = zlib.crc32(word)
        return value

    def forget(self) -> None:
        self.clear()


_known = _Codes()


def _stretches(text: str | None) -> Iterator[list[bytes]]:
    """A text's words, a stretch at a time."""
    raw, low = (text or "").encode("utf-8", "surrogatepass").translate(_PLAIN), 0
    while low < len(raw):
        high = raw.find(b" ", low + STRETCH)
        high = len(raw) if high < 0 else high
        yield raw[low:high].split()
        low = high


def features(text: str | None, width: int, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """(words, buckets of features) of each stretch of a text; features are all runs of 1 to width words."""
    memory.use(_known)
    last: list[bytes] = []
    for words in _stretches(text):
        codes = [np.fromiter(map(_known.__getitem__, words), dtype=np.int64, count=len(words))]
        if width > 1:
            before, words_in = len(last), [*last, *words]
            for k in range(2, width + 1):
                # Runs that end in this stretch; those that began before it reach back into the last words.
                ends = range(max(before, k - 1), len(words_in))
                codes.append(np.fromiter((zlib.crc32(b" ".join(words_in[e - k + 1 : e + 1])) for e in ends), dtype=np.int64, count=len(ends)))
            last = words_in[-(width - 1) :]
        yield len(words), np.concatenate(codes) % buckets


def bucket_counts(texts: DataFrame, width: int = 1, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of a column named text are in each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for text in batch.column("text"):
                for _, got in features(text.as_py(), width, buckets):
                    total += np.bincount(got, minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["at", "n"])

    out = np.zeros(buckets, dtype=np.int64)
    for r in texts.select("text").mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():
        out[r["at"]] = r["n"]
    return out


def gains(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """1,000 times the log ratio of a bucket's smoothed shares, floored."""
    all_raw, all_target, size = int(raw.sum()), int(target.sum()), len(raw)
    ratio = lambda t, s: float((t + 1) * (all_raw + size)) / float((s + 1) * (all_target + size))
    return np.array([math.floor(1000 * math.log(ratio(int(t), int(s)))) for t, s in zip(target, raw, strict=True)], dtype=np.int64)


def noise(ident: int, seed: int = SEED) -> int:
    """1,000 times a standard Gumbel variate of the identifier, floored."""
    h = int(hashlib.sha256(f"{seed}:{ident}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


_SCORED = "doc_id long, n_features long, n_words long, weight long, score long, text_key long"


def _scores(docs: DataFrame, gain: np.ndarray, width: int, seed: int) -> DataFrame:
    """Every row's features, words, weight and score (null where the identifier is)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for ident, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                words = n = total = 0
                for k, got in features(text.as_py(), width, len(gain)):
                    words, n, total = words + k, n + len(got), total + int(gain[got].sum())
                weight = total // n if n else 0
                rows.append((ident, n, words, weight, None if ident is None else weight + noise(ident, seed)))
            columns = [pa.array(x, pa.int64()) for x in zip(*rows, strict=True)] if rows else [pa.array([], pa.int64())] * 5
            yield pa.RecordBatch.from_arrays([*columns, batch.column("text_key")], names=["doc_id", "n_features", "n_words", "weight", "score", "text_key"])

    return docs.mapInArrow(run, _SCORED)


def resample(
    docs: DataFrame, target: DataFrame, share: int = 10, of: int = 100, least_words: int = 20, width: int = 1, buckets: int = BUCKETS, seed: int = SEED,
    text_col: str = "text", id_col: str = "doc_id", target_col: str = "text",
) -> DataFrame:
    """Each row's doc_id, n_features, weight, score, rank, text_key (its text's hash); rank is null for rows that are not drawn.

    Of the N rows with at least least_words words, floor(share * N / of) are
    drawn: those with the highest scores, ties to the smaller identifier.  A null
    text has no features and weighs 0, like an empty one.  A row without
    identifier has no score, is not counted in N and is never drawn.  Rows of one
    identifier have the same noise and are drawn each for itself; those with equal
    scores rank in any order.  An empty table gives no rows, an empty target
    equal shares of buckets.  Texts are read whole, a stretch at a time.  Other
    columns play no part, whatever their names.
    """
    text = text_of(text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_key"))
    gain = gains(bucket_counts(target.select(F.col(target_col).alias("text")), width, buckets), bucket_counts(rows, width, buckets))
    scored = checkpointed(_scores(rows, gain, width, seed))
    fits = (F.col("n_words") >= least_words) & F.col("doc_id").isNotNull()
    order = ranked(scored.where(fits).withColumn("falling", -F.col("score")), ["falling", "doc_id"], ["n_features", "weight", "text_key"])
    drawn = share * scored.where(fits).count() // of
    columns = ["doc_id", "n_features", "weight", "score", "rank", "text_key"]
    order = order.withColumn("score", -F.col("falling")).withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    return order.select(columns).union(scored.where(~fits).withColumn("rank", F.lit(None).cast("long")).select(columns))


def drawn_rows(docs: DataFrame, ranks: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The rows of docs that resample() has drawn, all columns unchanged; rows alike in identifier and text go together."""
    drawn = ranks.where("rank IS NOT NULL").select(F.col("doc_id").alias("id"), F.col("text_key").alias("key")).distinct()
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).cast("long").alias("id"), F.xxhash64(text_of(text_col)).alias("key"))
    return rows.join(drawn, ["id", "key"], "left_semi").select("row.*")
