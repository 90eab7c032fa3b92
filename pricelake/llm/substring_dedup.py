"""Removal of passages that stand in an earlier document.

Documents are dealt to chunks by ranges of their identifier, so that an earlier
chunk holds smaller identifiers only.  Blocks of half a window that do not
overlap index each document; every rolling block of every document probes them.
Any passage of a whole window holds one indexed block of its earlier copy, so the
hits mark all places where a passage may repeat; there each hit is extended to
windows, whose hashes are matched exactly: maximal repeats are the unions of
windows that match.  What travels is packed: a row for each (chunk, bucket of the
hash space), never one for each window, and never a list of pairs; a passage that
thousands of documents share is sent once by each chunk.

The text is shuffled once; the three steps that need it share that exchange.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricelake.llm.common import partitions, text_of, words_of
from pricelake.llm.hashing import mixed, rolling, word_hashes
from pricelake.llm.packed import PACKED, bucket_of_task, by_bucket, packed_frame, replies

#: Chunks for each shuffle partition: small enough to be held, many enough to be even.
CHUNKS_PER_PARTITION = 4
_LAST = 2**63 - 1
_REST = np.uint64((1 << 46) - 1)


def _six(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values, dtype="<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _unsix(body: bytes) -> np.ndarray:
    out = np.zeros((len(body) // 6, 8), dtype=np.uint8)
    out[:, :6] = np.frombuffer(body, np.uint8).reshape(-1, 6)
    return out.reshape(-1).view("<u8")


def _split(h: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """A block hash as (bucket, the 46 bits that travel)."""
    return ((h >> np.uint64(46)) % np.uint64(buckets)).astype(np.int64), h & _REST


def _window_bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    """From a second hash of the run of words, so that the bucket adds to the 64 bits."""
    return (mixed(h ^ np.uint64(0x5851F42D4C957F2D)) % np.uint64(buckets)).astype(np.int64)


def _least(h: np.ndarray, by: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unique hashes, the least of by for each, and each row's place among the unique."""
    unique, place = np.unique(h, return_inverse=True)
    least = np.full(len(unique), _LAST, dtype=np.int64)
    np.minimum.at(least, place, by)
    return unique, least, place


class _Chunk:
    """A chunk's documents as arrays of word hashes."""

    def __init__(self, texts: pd.Series, idents: pd.Series):
        self.words = [words_of(x) for x in texts]
        self.hashes = [word_hashes(x) for x in self.words]
        self.ids = idents.to_numpy(dtype=np.int64)

    def runs(self, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of all documents: the rolling hashes, the document's identifier, the position."""
        each = [rolling(x, width) for x in self.hashes]
        sizes = [len(x) for x in each]
        none = np.empty(0, dtype=np.uint64)
        return (
            np.concatenate([none, *each]),
            np.repeat(self.ids, sizes),
            np.concatenate([np.empty(0, dtype=np.int64), *map(np.arange, sizes)]),
        )


def _chunks(docs: DataFrame, text_col: str, id_col: str, count: int, carry: bool) -> DataFrame:
    """(chunk, id, text[, row]): chunks by ranges of the identifier; rows of one identifier share a chunk."""
    ident = F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST))
    bounds = docs.select(ident.cast("double").alias("d")).approxQuantile("d", [i / count for i in range(1, count)], 1 / (4 * count))
    bounds = sorted({int(x) for x in bounds})

    @F.pandas_udf("int")
    def chunk(idents: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(np.array(bounds, dtype=np.int64), idents.to_numpy(dtype=np.int64)).astype(np.int32))

    rows = [F.struct("*").alias("row")] if carry else []
    return docs.select(ident.alias("id"), text_of(text_col).alias("text"), *rows).withColumn("chunk", chunk("id"))


def _passages(docs: DataFrame, window: int, text_col: str, id_col: str, carry: bool, schema: str, emit) -> DataFrame:
    """emit(rows of a chunk, its words, a removal mask for each document) -> the chunk's result."""
    n = partitions(docs.sparkSession)
    block = max(1, window // 2)
    chunks = _chunks(docs, text_col, id_col, n * CHUNKS_PER_PARTITION, carry)

    def probes(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        """Every rolling block once for the chunk; flags: in two of its documents, an indexed block."""
        h, ids, at = _Chunk(rows["text"], rows["id"]).runs(block)
        unique, least, place = _least(h, ids)
        flags = np.zeros(len(unique), dtype=np.uint64)
        np.bitwise_or.at(flags, place, (ids > least[place]).astype(np.uint64) | (at % block == 0).astype(np.uint64) << np.uint64(1))
        bucket, rest = _split(unique, n)
        return packed_frame(by_bucket(bucket, rest << np.uint64(2) | flags, int(key[0]), _six))

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """In a bucket: blocks indexed in one document and found in another, told to each chunk that has them."""
        for bucket, whose, bodies in bucket_of_task(batches, _unsix):
            h, flags = bodies >> np.uint64(2), bodies & np.uint64(3)
            order = np.argsort(h, kind="stable")
            h, flags, whose = h[order], flags[order], whose[order]
            starts = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.empty(0, np.int64)
            size = np.diff(np.append(starts, len(h)))
            seen = np.bitwise_or.reduceat(flags, starts) if len(h) else flags
            hit = np.repeat((seen & np.uint64(2) > 0) & ((size > 1) | (seen & np.uint64(1) > 0)), size)
            yield from replies(bucket, whose[hit], h[hit], _six)

    def windows(key: tuple, rows: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        """Hashes of the windows around hits."""
        if rows.empty or found.empty:
            return packed_frame([])
        chunk = _Chunk(rows["text"], rows["id"])
        known = np.concatenate([_unsix(b) * np.uint64(n) + np.uint64(k) for k, b in zip(found["bucket"], found["body"], strict=True)])
        known.sort()
        out = [np.empty(0, dtype=np.uint64)]
        for words in chunk.hashes:
            if len(words) < window:
                continue
            bucket, rest = _split(rolling(words, block), n)
            value = rest * np.uint64(n) + bucket.astype(np.uint64)
            hit = known[np.minimum(np.searchsorted(known, value), len(known) - 1)] == value
            if hit.any():
                sums = np.concatenate([[0], np.cumsum(hit)])
                last = len(words) - window + 1
                near = sums[window - block + 1 : window - block + 1 + last] > sums[:last]
                out.append(rolling(words, window)[near])
        unique = np.unique(np.concatenate(out))
        return packed_frame(by_bucket(_window_bucket(unique, n), unique, int(key[0]), lambda x: x.astype("<u8").tobytes()))

    def earlier(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """In a bucket: windows told to every chunk but the first that has them."""
        for bucket, whose, h in bucket_of_task(batches, lambda b: np.frombuffer(b, "<u8")):
            _, least, place = _least(h, whose.astype(np.int64))
            later = whose > least[place]
            yield from replies(bucket, whose[later], h[later], lambda x: x.astype("<u8").tobytes())

    def removed(key: tuple, rows: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        if rows.empty:
            return emit(rows, [], [])
        chunk = _Chunk(rows["text"], rows["id"])
        h, ids, at = chunk.runs(window)
        unique, least, place = _least(h, ids)
        before = ids > least[place]
        if len(found):
            known = np.unique(np.concatenate([np.frombuffer(b, "<u8") for b in found["body"]]))
            before |= (known[np.minimum(np.searchsorted(known, unique), len(known) - 1)] == unique)[place]
        masks, low = [], 0
        for words in chunk.words:
            size = max(0, len(words) - window + 1)
            starts = np.flatnonzero(before[low : low + size])
            low += size
            cover = np.zeros(len(words) + 1, dtype=np.int64)
            np.add.at(cover, starts, 1)
            np.add.at(cover, starts + window, -1)
            masks.append(np.cumsum(cover)[:-1] > 0)
        return emit(rows, chunk.words, masks)

    told = chunks.groupBy("chunk").applyInPandas(probes, PACKED).repartitionById(n, F.col("bucket")).mapInArrow(hits, PACKED)
    near = chunks.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInPandas(windows, PACKED)
    late = near.repartitionById(n, F.col("bucket")).mapInArrow(earlier, PACKED)
    return chunks.groupBy("chunk").cogroup(late.groupBy("chunk")).applyInPandas(removed, schema)


def repeat_digests(docs: DataFrame, window: int = 50, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """For each row: doc_id, n_words, n_removed, kept_sha256 (of the kept words, joined by a space).

    A word goes if it lies in a window whose words also start in a document with
    a smaller identifier, judged on the input.  A null text has no words; a null
    identifier counts as larger than all; rows that share an identifier do not
    remove from one another; texts shorter than a window lose nothing.
    """

    def emit(rows: pd.DataFrame, words: list[list[bytes]], masks: list[np.ndarray]) -> pd.DataFrame:
        out = [
            (i, len(w), int(m.sum()), hashlib.sha256(b" ".join(np.array(w, dtype=object)[~m] if m.any() else w)).hexdigest())
            for i, w, m in zip(rows["id"], words, masks, strict=True)
        ]
        return pd.DataFrame(out, columns=["doc_id", "n_words", "n_removed", "kept_sha256"])

    found = _passages(docs, window, text_col, id_col, False, "doc_id long, n_words long, n_removed long, kept_sha256 string", emit)
    return found.withColumn("doc_id", F.when(F.col("doc_id") != _LAST, F.col("doc_id")))


def remove_repeats(docs: DataFrame, window: int = 50, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """docs with the repeated words taken out of the text; the rules are those of repeat_digests.

    A text that loses words becomes its kept words joined by a space; others, and
    all other columns, stay as they are.
    """
    row = docs.select(F.struct("*").alias("row")).schema
    schema = row.add("kept", "string")

    def emit(rows: pd.DataFrame, words: list[list[bytes]], masks: list[np.ndarray]) -> pd.DataFrame:
        kept = [b" ".join(np.array(w, dtype=object)[~m]).decode("utf-8", "surrogatepass") if m.any() else None for w, m in zip(words, masks, strict=True)]
        return pd.DataFrame({"row": rows["row"], "kept": pd.Series(kept, dtype=object, index=rows.index)})

    done = _passages(docs, window, text_col, id_col, True, schema, emit)
    return done.select(
        *(F.coalesce("kept", f"row.`{c}`").alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in docs.columns)
    )
