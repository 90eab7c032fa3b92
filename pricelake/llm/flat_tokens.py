"""Flat token files and the counts of their documents.

A file is nothing but unsigned 16-bit identifiers, little-endian, each document
followed by a separator; there is no index.  Counting splits each file into
blocks of a fixed size, finds the separators of a block in one vectorised search,
and stitches documents that cross blocks by a prefix scan over the blocks: how
many separators stand before a block, and where the last of them is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pricelake.llm.common import partitions, text_of
from pricelake.llm.tokens import encoder

SLICE = 1024
#: Identifiers in a block.
BLOCK = 1 << 18


def write_flat(docs: DataFrame, folder: str, tokenizer: str, separator: int, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Lazily writes a file for each partition to folder, a shared URI or path; gives the manifest.

    The manifest, (file, ordinal, doc_id), tells which document is a file's n-th.
    Reading it again writes the same files again; write it out once.  A null text
    counts as empty: its document is the separator alone.  Repeated rows are
    documents of their own; an empty table gives no file.  Texts are encoded
    whole.  Other columns play no part, whatever their names.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        of, task, ordinal = encoder(tokenizer), TaskContext.get(), 0
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root)
        name = f"part-{task.partitionId():06d}.tokens"
        own = f"{root}/_{name}.{task.taskAttemptId()}"
        with store.open_output_stream(own) as out:
            for batch in batches:
                for low in range(0, batch.num_rows, SLICE):
                    part = batch.slice(low, SLICE)
                    n = part.num_rows
                    tokens, _ = of.encode_all(part.column("text"), separator)
                    if tokens.max(initial=0) > 0xFFFF or np.count_nonzero(tokens == separator) != n:
                        raise ValueError("an identifier is the separator, or beyond 16 bits")
                    out.write(tokens.astype("<u2").tobytes())
                    yield pa.RecordBatch.from_arrays([pa.array([name] * n), pa.array(range(ordinal, ordinal + n)), part.column("doc_id")], names=["file", "ordinal", "doc_id"])
                    ordinal += n
        if ordinal:
            store.move(own, f"{root}/{name}")
        else:
            store.delete_file(own)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    return rows.mapInArrow(run, "file string, ordinal long, doc_id long")


def count_flat(spark: SparkSession, folder: str, separator: int, block: int = BLOCK) -> DataFrame:
    """For each document: file, ordinal, start, n_tokens (with its separator), ended.

    Only names and lengths of files are listed; blocks are dealt to tasks, each
    of which reads its own ranges, so that neither a task nor a row grows with a
    file.  What follows a file's last separator counts as a document that has not
    ended.  Empty files have no documents.
    """

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name, low, total in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                with store.open_input_file(f"{root}/{name}") as file:
                    body = file.read_at(2 * min(block, total - low), 2 * low)
                ends = low + np.flatnonzero(np.frombuffer(body, "<u2") == separator)
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([low]), pa.array([total]), pa.array([ends], pa.list_(pa.int64()))], names=["file", "low", "total", "ends"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.tokens").load(folder)
    files = files.select(F.element_at(F.split("path", "/"), -1).alias("file"), (F.col("length") / 2).cast("long").alias("total"))
    blocks = files.where("total > 0").withColumn("low", F.explode(F.sequence(F.lit(0), F.col("total") - 1, F.lit(block).cast("long"))))
    dealt = blocks.select("file", "low", "total").repartition(partitions(spark), "file", "low")
    found = dealt.mapInArrow(find, "file string, low long, total long, ends array<long>")
    before = Window.partitionBy("file").orderBy("low").rowsBetween(Window.unboundedPreceding, -1)
    scanned = found.select(
        "file",
        "low",
        "total",
        "ends",
        F.coalesce(F.sum(F.size("ends")).over(before), F.lit(0)).alias("base"),
        F.coalesce(F.max(F.array_max("ends")).over(before), F.lit(-1)).alias("previous"),
    )
    starts = F.concat(F.array(F.col("previous") + 1), F.transform("ends", lambda x: x + 1))
    done = scanned.select("file", "base", starts.alias("starts"), F.posexplode("ends").alias("k", "end"))
    done = done.select("file", (F.col("base") + F.col("k")).alias("ordinal"), F.get("starts", F.col("k")).alias("start"), "end", F.lit(True).alias("ended"))
    last = scanned.groupBy("file").agg(F.sum(F.size("ends")).alias("ordinal"), F.coalesce(F.max(F.array_max("ends")), F.lit(-1)).alias("end"), F.max("total").alias("total"))
    rest = last.where("end < total - 1").select("file", "ordinal", (F.col("end") + 1).alias("start"), (F.col("total") - 1).alias("end"), F.lit(False).alias("ended"))
    return done.union(rest).select("file", "ordinal", "start", (F.col("end") - F.col("start") + 1).alias("n_tokens"), "ended")


def counts_by_document(counts: DataFrame, manifest: DataFrame) -> DataFrame:
    """doc_id, file, start, n_tokens for each row of the manifest, a repeated document or a null doc_id like any other.

    An empty manifest gives no rows; the manifest's other columns play no part.
    """
    # Both sides grow with the documents; what Spark guesses from the listing of files alone is far too small.
    return manifest.join(counts.hint("merge"), ["file", "ordinal"]).select("doc_id", "file", "start", "n_tokens")
