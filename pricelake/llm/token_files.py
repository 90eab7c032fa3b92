"""Token identifiers in ORC, ordered by document, and counts from flat token files.

ORC: run-length encoded integers, a row index, Bloom filters on the document
identifier, and stripes that tasks read apart; a lookup of few documents reads
the metadata and skips all other stripes.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricelake.llm.common import partitions, text_of
from pricelake.llm.tokens import encoder

#: Texts encoded at a time.
SLICE = 1024
_SCHEMA = "part int, doc_id long, part_start long, n_tokens long, ids array<int>"
#: ORC settings: stripes small enough for many readers, an index entry for every 1,000 rows.
ORC_OPTIONS = {
    "orc.bloom.filter.columns": "doc_id",
    "orc.bloom.filter.fpp": "0.01",
    "orc.create.index": "true",
    "orc.row.index.stride": "1000",
    "orc.stripe.size": str(16 << 20),
    "compression": "zstd",
}


def write_orc(docs: DataFrame, path: str, tokenizer: str, end_id: int = 1, text_col: str = "text", id_col: str = "doc_id") -> None:
    """Writes each row's identifiers, then end_id, in ascending order of id_col.

    A null text counts as empty; rows with a null identifier come first;
    repeated rows are written as often as they occur, ordered by their text.  An
    empty table gives files without rows.  Texts are encoded whole; other columns
    play no part, whatever their names.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, at = encoder(tokenizer), 0
        task = TaskContext.get().partitionId()
        for batch in batches:
            for low in range(0, batch.num_rows, SLICE):
                rows = batch.slice(low, SLICE)
                flat, ends = of.encode_all(rows.column("text"), end_id)
                sizes, ids = np.diff(ends), pa.array(flat.view("<i4"))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([task] * len(sizes), pa.int32()), rows.column("id"), pa.array(at + ends[:-1]), pa.array(sizes),
                     pa.ListArray.from_arrays(pa.array(ends, pa.int32()), ids)],
                    names=["part", "doc_id", "part_start", "n_tokens", "ids"],
                )
                at += int(ends[-1])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text"))
    # Ranges of (identifier, first characters), so that rows of one identifier need not share a task.
    ordered = rows.repartitionByRange(partitions(docs.sparkSession), "id", F.substring("text", 1, 16)).sortWithinPartitions("id", "text")
    ordered.mapInArrow(run, _SCHEMA).write.options(**ORC_OPTIONS).orc(path)


def read_orc(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (identifiers before the document's in the whole order), n_tokens, ids.

    Rows are those that write_orc() has written, null and repeated identifiers
    among them; no rows give none.
    """
    rows = spark.read.schema(_SCHEMA).orc(path)
    sizes = rows.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()  # a row for each file's task
    base, at = [], 0
    for r in sorted(sizes):
        base.append((r.part, at))
        at += r.n
    bases = spark.createDataFrame(base, "part int, base long")
    return rows.join(F.broadcast(bases), "part").select("doc_id", (F.col("base") + F.col("part_start")).alias("start"), "n_tokens", "ids")


def with_crc32(rows: DataFrame) -> DataFrame:
    """read_orc()'s rows with the checksum of the identifiers, as unsigned 32-bit, in their place; one for each row, whatever its doc_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("ids")
            flat, ends = ids.values.to_numpy(zero_copy_only=False).astype("<u4"), ids.offsets.to_numpy()
            sums = [zlib.crc32(flat[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"]
            )

    return rows.select("doc_id", "start", "n_tokens", "ids").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
