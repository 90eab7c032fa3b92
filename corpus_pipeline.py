"""The corpus pipeline: from documents to packed token windows.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next stage's docs.  All but the last return the
columns of documents.  A stage works on every row that its predecessor kept.

Every stage takes whole texts, however long; a null text counts as empty; rows
are never cut off, whatever group they belong to; an empty table gives an empty
one; further columns come through unchanged, whatever their names, but for the
last stage, whose columns are those of pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pricelake.llm.common import delete, release, scratch, table
from pricelake.llm.exact_dedup import exact_dedup
from pricelake.llm.near_dedup import keep_one_of_each
from pricelake.llm.packing import pack, piece_digests
from pricelake.llm.quality import keep_quality
from pricelake.llm.registry import tokenizer_path
from pricelake.llm.substring_dedup import remove_repeats


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on the labels table, draws: as many as that table's share of good ones.

    An empty text weighs 0 and is drawn by chance like others of that weight.
    Without labels of both kinds all stay.  Of rows alike in identifier and text
    all stay or none; at equal keys all of the last stay.
    """
    return keep_quality(docs, table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each distinct text, that with the largest identifier.

    Null and empty texts are one text.  A null identifier stays only if its whole
    group has none; of rows alike in both one stays.
    """
    release(spark, "weighed")  # docs has been written, so what it was drawn from is read no more
    return exact_dedup(docs, keep="max")


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component (five words, 0.8), that with the least identifier.

    Documents without words, or without identifier, all stay.
    """
    return keep_one_of_each(docs, width=5, threshold=0.8)


def substring(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of 50 words and more that stand in an earlier document; n_chars follows the text.

    Earlier: with a smaller identifier; a null one is later than all, and rows of
    one identifier do not take from each other.  A null text stays null.
    """
    from pyspark.sql import functions as F

    cut = remove_repeats(docs, window=50)
    return cut.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))) if "n_chars" in docs.columns else cut


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of windows of at most 1,024 tokens; an empty text is its end token, a repeated row is packed again."""
    return piece_digests(pack(docs, tokenizer_path("byte_bpe_50k.json"), capacity=1024, end_id=0))


STAGES = [("quality", quality), ("exact", exact), ("near", near), ("substring", substring), ("packing", packing)]

#: The classifier and the packing are beyond SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; each result is written to the shared folder and read again."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = scratch(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            delete(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
