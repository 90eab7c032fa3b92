"""Packed exchange: what chunks of documents ask of buckets of a hash space, and what they are told.

A row is (bucket, chunk, body); the body holds all values that the chunk has in
the bucket, so that millions of small values travel as a few large rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa

PACKED = "bucket int, chunk int, body binary"


def by_bucket(buckets: np.ndarray, bodies: np.ndarray, chunk: int, pack: Callable[[np.ndarray], bytes]) -> list[tuple[int, int, bytes]]:
    """The values of each bucket, packed: (bucket, chunk, body)."""
    order = np.argsort(buckets, kind="stable")
    buckets, bodies = buckets[order], bodies[order]
    cuts = np.flatnonzero(np.diff(buckets)) + 1
    starts = [0, *cuts.tolist()] if len(buckets) else []
    return [(int(buckets[a]), chunk, pack(bodies[a:b])) for a, b in zip(starts, [*cuts.tolist(), len(buckets)], strict=False)]


def packed_frame(rows: list[tuple[int, int, bytes]]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["bucket", "chunk", "body"]).astype({"bucket": "int32", "chunk": "int32"})


def bucket_of_task(batches: Iterator[pa.RecordBatch], unpack: Callable[[bytes], np.ndarray]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """A task's bucket (one in all): its number, each value's chunk, the values."""
    chunks, bodies, bucket = [], [], None
    for batch in batches:
        for b, c, body in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            values = unpack(body)
            bucket = b
            chunks.append(np.full(len(values), c, dtype=np.int32))
            bodies.append(values)
    if bodies:
        yield bucket, np.concatenate(chunks), np.concatenate(bodies)


def replies(bucket: int, whose: np.ndarray, values: np.ndarray, pack) -> Iterator[pa.RecordBatch]:
    rows = [(bucket, chunk, body) for chunk, _, body in by_bucket(whose, values, 0, pack)]
    if rows:
        yield pa.RecordBatch.from_arrays(
            [pa.array(x, k) for x, k in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.binary()), strict=True)],
            names=["bucket", "chunk", "body"],
        )
