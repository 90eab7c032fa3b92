"""Packing of token sequences by the sum-of-squares rule.

Each task packs its own documents online.  A level array counts the partly
filled windows of each fill; a remainder goes where the sum of the squared counts
grows least.  What is still open at a task's end is poured together, so that no
task leaves more than one partial window, and that one is cut at powers of two,
which need no padding; a column tells which windows the pour has filled.  No
shuffle, and no state beyond a task.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricelake.llm.common import text_of
from pricelake.llm.tokens import encoder

#: Open windows beyond which a task pours them together and goes on: some 2 KB each, so that memory has a bound.
OPEN_MOST = 1 << 14
#: Texts encoded at a time.
SLICE = 1024
_SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, poured boolean"

#: (doc_id, start, identifiers as bytes, tokens of the document)
Piece = tuple[int | None, int, bytes, int]


class SumOfSquares:
    """Windows of one task.  emit(window number, pieces, poured) is called once for each."""

    def __init__(self, capacity: int, emit: Callable[[int, list[Piece], bool], None], width: int = 4):
        self.capacity, self.emit, self.width = capacity, emit, width
        self.level = np.zeros(capacity + 1, dtype=np.int64)
        self.open: list[list[list[Piece]]] = [[] for _ in range(capacity + 1)]
        self.windows = self.opened = 0
        self.pouring = False

    def _close(self, pieces: list[Piece]) -> None:
        self.emit(self.windows, pieces, self.pouring)
        self.windows += 1

    def _fill_for(self, size: int) -> int:
        """The fill (0: a new window) whose use adds least to the squared counts; of equals the fullest."""
        fills = np.flatnonzero(self.level[: self.capacity - size + 1])
        if not len(fills):
            return 0
        onto = fills + size
        cost = np.where(onto < self.capacity, 2 * self.level[onto] + 1, 0) - (2 * self.level[fills] - 1)
        best = len(cost) - 1 - int(np.argmin(cost[::-1]))
        return int(fills[best]) if cost[best] <= 2 * self.level[size] + 1 else 0

    def add(self, doc: int | None, ids: bytes) -> None:
        """Takes a document: whole windows first, then the rest by the rule."""
        n, step = len(ids) // self.width, self.capacity
        whole = n - n % step
        for at in range(0, whole, step):
            self._close([(doc, at, ids[at * self.width : (at + step) * self.width], n)])
        if n > whole:
            size = n - whole
            fill = self._fill_for(size)
            pieces = self.open[fill].pop() if fill else []
            pieces.append((doc, whole, ids[whole * self.width :], n))
            if fill:
                self.level[fill] -= 1
                self.opened -= 1
            self._keep(fill + size, pieces)
            if self.opened > OPEN_MOST:
                self._pour()

    def _keep(self, fill: int, pieces: list[Piece]) -> None:
        if fill == self.capacity:
            self._close(pieces)
        elif fill:
            self.level[fill] += 1
            self.opened += 1
            self.open[fill].append(pieces)

    def _pour(self) -> None:
        """Fills the fullest open windows from the emptiest, cutting freely: at most one stays."""
        self.pouring = True
        waiting = deque((fill, pieces) for fill, some in enumerate(self.open) for pieces in some)
        self.level[:] = 0
        self.open, self.opened = [[] for _ in range(self.capacity + 1)], 0
        supply: list[Piece] = []
        while waiting:
            fill, pieces = waiting.pop()
            while fill < self.capacity and (supply or waiting):
                if not supply:
                    supply = waiting.popleft()[1]
                doc, start, ids, n = supply.pop()
                take = min(self.capacity - fill, len(ids) // self.width)
                if take * self.width < len(ids):
                    supply.append((doc, start + take, ids[take * self.width :], n))
                pieces.append((doc, start, ids[: take * self.width], n))
                fill += take
            self._keep(fill, pieces)
        if supply:
            # The last window filled up: the rest is the one that stays.
            self._keep(sum(len(x[2]) for x in supply) // self.width, supply)
        self.pouring = False

    def finish(self) -> None:
        """Closes all windows; the last is cut so that each part's size is a power of two."""
        self._pour()
        self.pouring = True
        for some in self.open:
            for pieces in some:
                left, size = list(reversed(pieces)), sum(len(x[2]) for x in pieces) // self.width
                for bit in reversed(range(size.bit_length())):
                    room, part = size & 1 << bit, []
                    while room:
                        doc, start, ids, n = left.pop()
                        take = min(room, len(ids) // self.width)
                        if take * self.width < len(ids):
                            left.append((doc, start + take, ids[take * self.width :], n))
                        part.append((doc, start, ids[: take * self.width], n))
                        room -= take
                    if part:
                        self._close(part)
        self.open = [[] for _ in range(self.capacity + 1)]
        self.level[:] = 0
        self.opened = 0


def pack(
    docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 0, text_col: str = "text", id_col: str = "doc_id"
) -> DataFrame:
    """Pieces of windows: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset, poured.

    A document's identifiers are its text's by the tokenizers file, then end_id;
    a null text counts as empty and so has end_id alone.  Each identifier lies in
    one piece.  Repeated rows are packed as rows of their own; an empty table
    gives no pieces.  sequence_id holds the task's number above the window's.  A
    very long text is encoded whole and fills windows of its own but for its
    rest; other columns play no part, whatever their names.  poured: whether the
    window was filled by the pour at a task's end and not by the rule.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = encoder(tokenizer)
        task = TaskContext.get().partitionId() << 40
        done: list[tuple] = []

        def emit(window: int, pieces: list[Piece], poured: bool) -> None:
            at = 0
            for doc, start, ids, n in pieces:
                done.append((doc, start, len(ids) // 4, ids, n, task | window, at, poured))
                at += len(ids) // 4

        packer = SumOfSquares(capacity, emit)

        def out() -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()]
            columns = [pa.array(x, k) for x, k in zip(zip(*done, strict=True), kinds, strict=True)]
            done.clear()
            return pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in _SCHEMA.split(", ")])

        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                ids, starts = of.encode_all(part.column("text"), end_id)
                for doc, a, b in zip(part.column("id").to_pylist(), starts, starts[1:], strict=False):
                    packer.add(doc, ids[a:b].tobytes())
                if done:
                    yield out()
        packer.finish()
        if done:
            yield out()

    return docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text")).mapInArrow(run, _SCHEMA)


def piece_digests(pieces: DataFrame) -> DataFrame:
    """pack()'s rows with the checksum of each piece in place of its identifiers; no pieces give none, nulls and repeats stay as they are."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "poured")
