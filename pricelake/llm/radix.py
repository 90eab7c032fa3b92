"""A distributed LSD radix sort over records of 64-bit integers.

Records travel in blocks: one row holds a block's records packed as bytes.  A
pass is a stable counting sort by one digit of the composite key: every block
counts its digits, global prefix offsets (over digits, then over blocks) give
each record its destination, and records are sent to the block that holds their
destination, where they are placed without comparing.  After the last pass a
record's place is its rank.

Sizes: a block holds at most BLOCK records, a pass sends every record once.  The
offsets are scanned in groups of about the square root of the number of blocks,
so that no task and not the driver holds more than that many arrays of RADIX.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricelake.llm.common import delete, partitions, scratch

#: Bits of a digit, and how many values it has.
BITS = 11
RADIX = 1 << BITS
#: Records of a block at most.
BLOCK = 1 << 18
#: A first block's number is its partition's times this, plus its place there.
_STEP = 1 << 24
_STATE = "block long, body binary"


class _Key:
    """The composite key: fields (column, least value, first bit, bits), the last column's field lowest."""

    def __init__(self, spans: list[tuple[int, int]]) -> None:
        self.fields, low = [], 0
        for column in range(len(spans) - 1, -1, -1):
            least, most = spans[column]
            bits = (most - least).bit_length()
            if bits:
                self.fields.append((column, least, low, bits))
            low += bits
        self.bits = low

    def digit(self, records: np.ndarray, low: int) -> np.ndarray:
        """The digit that starts at a bit, of every record."""
        out = np.zeros(len(records), dtype=np.uint64)
        for column, least, at, bits in self.fields:
            if at < low + BITS and low < at + bits:
                value = records[:, column].astype(np.uint64) - np.uint64(least % (1 << 64))
                out |= value >> np.uint64(low - at) if low >= at else value << np.uint64(at - low)
        return (out & np.uint64(RADIX - 1)).astype(np.uint16)


def _batch(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], names=["block", "body"])


def _records(body: bytes, width: int) -> np.ndarray:
    return np.frombuffer(body, dtype=np.int64).reshape(-1, width)


def _first_blocks(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The records of each partition, in their order there, in blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, waiting, n = TaskContext.get().partitionId() * _STEP, [], 0
        for batch in batches:
            waiting.append(np.stack([batch.column(c).to_numpy() for c in columns], axis=1).astype(np.int64))
            n += batch.num_rows
            while n >= BLOCK:
                together = np.concatenate(waiting)
                yield _batch([(block, together[:BLOCK].tobytes())])
                block, waiting, n = block + 1, [together[BLOCK:]], n - BLOCK
        if n:
            yield _batch([(block, np.concatenate(waiting).tobytes())])

    return rows.select(*(F.col(c).cast("long").alias(c) for c in columns)).mapInArrow(run, _STATE)


def _counts(state: DataFrame, key: _Key, low: int, width: int) -> DataFrame:
    """(block, body): the digits that occur in a block (16 bits each), then how often (64 bits each)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                count = np.bincount(key.digit(_records(body.as_py(), width), low), minlength=RADIX)
                yield _batch([(block, _sparse(count))])

    return state.mapInArrow(run, _STATE)


def _sparse(values: np.ndarray, at: np.ndarray | None = None) -> bytes:
    at = np.flatnonzero(values) if at is None else at
    return at.astype(np.uint16).tobytes() + values[at].astype(np.int64).tobytes()


def _at(body: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(body) // 10
    return np.frombuffer(body, dtype=np.uint16, count=n), np.frombuffer(body, dtype=np.int64, offset=2 * n)


def _scan(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of one group of blocks: for each block what stands before it in the group, by digit; then (block null) the group's total."""
    total, out = np.zeros(RADIX, dtype=np.int64), []
    for block, body in sorted(zip(pdf["block"], pdf["body"], strict=True)):
        digits, counts = _at(body)
        out.append((block, _sparse(total, digits)))
        total[digits] += counts
    out.append((None, _sparse(total)))
    got = pd.DataFrame(out, columns=["block", "before"]).astype({"block": "Int64"})
    got["part"] = int(pdf["part"].iloc[0])
    return got


def _moved(state: DataFrame, scanned: DataFrame, starts: dict[int, np.ndarray], key: _Key, low: int, width: int, size: int) -> DataFrame:
    """Every record with its destination, in pieces for the blocks that hold them: (block, body), body: places, then records."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, before, body in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                records = _records(body.as_py(), width)
                digit = key.digit(records, low)
                order = np.argsort(digit, kind="stable")
                digit, records = digit[order], records[order]
                start = starts[part].copy()
                at, n = _at(before.as_py())
                start[at] += n
                first = np.searchsorted(digit, digit)
                place = start[digit] + np.arange(len(digit)) - first
                block = place // size
                cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(block)]
                yield _batch([(int(block[a]), (place[a:b] % size).astype(np.int64).tobytes() + records[a:b].tobytes()) for a, b in zip(cuts, cuts[1:], strict=False) if a < b])

    return state.join(scanned, "block").select("part", "before", "body").mapInArrow(run, _STATE)


def _placed(pieces: DataFrame, width: int) -> DataFrame:
    def place(pdf: pd.DataFrame) -> pd.DataFrame:
        each = [np.frombuffer(b, dtype=np.int64) for b in pdf["body"]]
        places = np.concatenate([x[: len(x) // (width + 1)] for x in each])
        out = np.empty((len(places), width), dtype=np.int64)
        out[places] = np.concatenate([x[len(x) // (width + 1) :].reshape(-1, width) for x in each])
        return pd.DataFrame({"block": [int(pdf["block"].iloc[0])], "body": [out.tobytes()]})

    return pieces.groupBy("block").applyInPandas(place, _STATE)


def ranked(rows: DataFrame, keys: list[str], carried: list[str] | None = None) -> DataFrame:
    """The columns keys and carried of every row, and rank: 1, 2, 3... in ascending order of the keys, the first key foremost.

    rows: a written table or a checkpoint (it is read several times and must keep
    its order).  All columns are integers, keys without nulls; nulls among the
    carried ones are refused.  Rows with equal keys keep their order in the table
    and have ranks of their own.  An empty table gives no rows.
    """
    spark, columns = rows.sparkSession, [*keys, *(carried or [])]
    width = len(columns)
    if rows.where(" OR ".join(f"`{c}` IS NULL" for c in columns)).take(1):
        raise ValueError("a radix sort takes no nulls")
    seen = rows.agg(F.count("*"), *(f(c) for c in keys for f in (F.min, F.max))).first()
    n = seen[0]
    schema = ", ".join(f"`{c}` long" for c in [*columns, "rank"])
    if not n:
        return spark.createDataFrame([], schema)
    key = _Key([(int(seen[1 + 2 * i]), int(seen[2 + 2 * i])) for i in range(len(keys))])
    size = math.ceil(n / max(partitions(spark), math.ceil(n / BLOCK)))
    state, path = _first_blocks(rows, columns), None
    for low in range(0, max(key.bits, 1), BITS):
        now = scratch(spark, "radix")
        state.write.parquet(f"{now}/from")
        state = spark.read.parquet(f"{now}/from")
        if path:
            delete(spark, path)
        path = now
        # First blocks stand _STEP apart by partition, later ones are numbered through.
        number = F.col("block") if low else F.expr(f"block div {_STEP}")
        last = state.agg(F.max(number)).first()[0]
        group = F.floor(number / F.lit(math.isqrt(last) + 1)).alias("part")
        counts = _counts(state, key, low, width)
        counts.select("block", "body", group).groupBy("part").applyInPandas(_scan, "block long, before binary, part long").write.parquet(f"{now}/offsets")
        scanned = spark.read.parquet(f"{now}/offsets")
        totals = {r.part: _at(r.before) for r in scanned.where("block IS NULL").collect()}
        each = np.zeros((len(totals), RADIX), dtype=np.int64)
        for i, part in enumerate(sorted(totals)):
            each[i, totals[part][0]] = totals[part][1]
        # Digit by digit, and within a digit group by group.
        flat = each.T.reshape(-1)
        start = (np.cumsum(flat) - flat).reshape(RADIX, -1).T
        starts = {part: start[i] for i, part in enumerate(sorted(totals))}
        state = _placed(_moved(state, scanned.where("block IS NOT NULL"), starts, key, low, width, size), width)

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                records = _records(body.as_py(), width)
                rank = block * size + 1 + np.arange(len(records))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (*records.T, rank)], names=[*columns, "rank"])

    return state.mapInArrow(unpack, schema)
