"""Exact deduplication by a distributed content sort.

Rows are keyed by the first bytes of the text and its SHA-256, so a splitter
stays small however long the texts are.  Splitters sampled from (key, identifier)
range-partition the rows: a text that a third of all rows share is dealt to as
many tasks as it needs.  Spark's external sort brings equals together in each
range, and a scan compares every text with the one before it.  A splitter is a
row of the range below it, so a range that opens with its lower splitter's key
continues that range's group; no exchange between ranges is needed to know.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricelake.llm.common import checkpointed, partitions, text_of

#: Bytes of the text that lead the sort key.
PREFIX = 16
#: Rows sampled for each splitter, and at most in all (they meet on the driver).
SAMPLE_PER_SPLIT, SAMPLE_MOST = 64, 400_000


def _keyed(docs: DataFrame, text_col: str, id_col: str, keep: str) -> DataFrame:
    """(key, ord, row): in a group the row to keep has the least ord.  The text travels in its row only."""
    text, ident = text_of(text_col), F.col(id_col).cast("long")
    low = F.lit(-(2**63)).cast("long")
    order = F.bitwise_not(F.coalesce(ident, low)) if keep == "max" else F.coalesce(ident, F.bitwise_not(low))
    raw = text.cast("binary")
    return docs.select(F.concat(F.substring(raw, 1, PREFIX), F.unhex(F.sha2(raw, 256))).alias("key"), order.alias("ord"), F.struct("*").alias("row"))


def _splitters(keyed: DataFrame, n: int) -> list[tuple[bytes, int]]:
    """At most n - 1 rows' (key, ord), evenly spaced in a sample's order."""
    rows = keyed.select("ord").count()
    want = min(SAMPLE_PER_SPLIT * n, SAMPLE_MOST)
    if n < 2 or not rows:
        return []
    taken = keyed.sample(fraction=min(1.0, 1.2 * want / rows), seed=7).select("key", "ord").collect()
    taken = sorted((bytes(r.key), r.ord) for r in taken)
    return sorted({taken[len(taken) * i // n] for i in range(1, n)}) if taken else []


def _sorted(keyed: DataFrame, splitters: list[tuple[bytes, int]], text_col: str) -> DataFrame:
    @F.pandas_udf("int")
    def bucket(key: pd.Series, order: pd.Series) -> pd.Series:
        return pd.Series([bisect_left(splitters, x) for x in zip(map(bytes, key), order, strict=True)], dtype="int32")

    dealt = keyed.withColumn("bucket", bucket("key", "ord"))
    return dealt.repartitionById(len(splitters) + 1, F.col("bucket")).sortWithinPartitions("key", F.coalesce(F.col("row")[text_col], F.lit("")), "ord")


def _begins(batch: pa.RecordBatch, text_col: str, last: tuple) -> tuple[list[bool], tuple]:
    """Whether each row's text differs from the text before it (a null is empty); the last row."""
    keys, texts = batch.column("key").to_pylist(), batch.column("row").field(text_col)
    out = []
    for i, key in enumerate(keys):
        if key != last[0]:
            out.append(True)
        else:
            text = texts[i].as_py() or ""
            out.append(text != (last[1] if i == 0 else texts[i - 1].as_py() or ""))
        last = (key, None)
    return out, (keys[-1], texts[len(keys) - 1].as_py() or "") if keys else last


def exact_dedup(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", keep: str = "max") -> DataFrame:
    """The rows of docs, one for each distinct text, all columns unchanged.

    keep: "max" or "min", the identifier that stays.  A null text counts as
    empty; a null identifier stays only if all of its group are null.  Of rows
    alike in text and identifier one stays.  An empty table gives none.
    """
    keyed = _keyed(docs, text_col, id_col, keep)
    splitters = _splitters(keyed, partitions(docs.sparkSession))

    def first_of_group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, opening = (None, None), True
        for batch in batches:
            if not batch.num_rows:
                continue
            begins, last = _begins(batch, text_col, last)
            if opening:
                at = batch.column("bucket")[0].as_py()
                begins[0] = not (at and splitters[at - 1][0] == batch.column("key")[0].as_py())
                opening = False
            yield batch.select(["row"]).filter(pa.array(begins))

    kept = _sorted(keyed, splitters, text_col).mapInArrow(first_of_group, keyed.select("row").schema)
    return kept.select("row.*")


def duplicate_groups(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", keep: str = "max") -> DataFrame:
    """For each row of docs: id, text_sha256, keep_id, group_size, kept.

    The rules are those of exact_dedup.
    """
    keyed = _keyed(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), "text", "id", keep)
    splitters = _splitters(keyed, partitions(docs.sparkSession))

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Emits a group once it ends; it holds identifiers only, no texts."""
        last, ids, sha, edge, opened, more = (None, None), [], "", False, True, False

        def out() -> pa.RecordBatch:
            n = len(ids)
            return pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array([sha] * n), pa.array([ids[0]] * n, pa.int64()), pa.array([n] * n, pa.int64()),
                 pa.array([i == 0 and not more for i in range(n)]), pa.array([edge] * n), pa.array([i == 0 for i in range(n)])],
                names=["id", "text_sha256", "keep_id", "group_size", "kept", "edge", "head"],
            )

        for batch in batches:
            if not batch.num_rows:
                continue
            keys, own = batch.column("key").to_pylist(), batch.column("row").field("id").to_pylist()
            at = batch.column("bucket")[0].as_py()
            begins, last = _begins(batch, "text", last)
            done = []
            for i, begin in enumerate(begins):
                if begin:
                    if ids:
                        done.append(out())
                    above = at < len(splitters) and splitters[at][0] == keys[i]
                    more = opened and at > 0 and splitters[at - 1][0] == keys[i]
                    ids, sha, edge, opened = [], keys[i][-32:].hex(), above or more, False
                ids.append(own[i])
            if done:
                yield pa.Table.from_batches(done).combine_chunks().to_batches()[0]
        if ids:
            yield out()

    schema = "id long, text_sha256 string, keep_id long, group_size long, kept boolean, edge boolean, head boolean"
    runs = checkpointed(_sorted(keyed, splitters, "text").mapInArrow(groups, schema))
    # A group that meets a splitter is summed over its ranges: at most two rows for each range.
    best = F.max if keep == "max" else F.min
    whole = (
        runs.where("edge and head")
        .groupBy(F.col("text_sha256").alias("sha"))
        .agg(F.sum("group_size").alias("size"), best("keep_id").alias("best"))
    )
    joined = runs.join(F.broadcast(whole), F.col("edge") & (F.col("text_sha256") == F.col("sha")), "left")
    return joined.select(
        "id",
        "text_sha256",
        F.when(F.col("sha").isNull(), F.col("keep_id")).otherwise(F.col("best")).alias("keep_id"),
        F.coalesce("size", "group_size").alias("group_size"),
        "kept",
    )


def sha256(text: str | None) -> str:
    """What text_sha256 holds for a text."""
    return hashlib.sha256((text or "").encode()).hexdigest()
