"""What the operators share: input tables, words, scratch space, chunks."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Spark's setting to drop a query's shuffle files when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: A word is a run of characters other than the six ASCII blanks.
WORD = r"[^\x20\x09-\x0D]+"


def words_of(text: str | None, lower: bool = False) -> list[bytes]:
    """A text's words in UTF-8; lower: with A-Z, and no other letter, in lower case.

    Bytes split at just those six blanks, and lower-case just those letters.
    """
    raw = (text or "").encode("utf-8", "surrogatepass")
    return (raw.lower() if lower else raw).split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    """How many partitions a shuffle of this session has."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    ``spark.checkpoint.dir`` names it; only where that is unset and all runs in
    one process (tests) a new temporary folder takes its place.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(named)
        return named
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="pricelake-"))
    return sc.getCheckpointDir()


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared store through Spark's own file system."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


_scratch: dict[str, list[str]] = {}


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; it goes when the driver's Python ends, or by release()."""
    path = f"{shared_dir(spark).rstrip('/')}/pricelake/{name}-{uuid.uuid4().hex}"
    if not _scratch:

        def drop() -> None:
            if spark.sparkContext._jsc is not None:
                for x in list(_scratch):
                    release(spark, x)

        atexit.register(drop)
    _scratch.setdefault(name, []).append(path)
    return path


def release(spark: SparkSession, name: str) -> None:
    """Deletes all scratch paths of a name; only for results that nobody will read any more."""
    for path in _scratch.get(name, []):
        delete(spark, path)
    _scratch[name] = []


def checkpointed(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a reliable checkpoint in the shared folder.

    The shuffle files behind it are not needed any more; Spark drops them as
    soon as the checkpoint is written, not when the driver collects its garbage.
    """
    spark = df.sparkSession
    shared_dir(spark)
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        return df.select("*").checkpoint()  # a new DataFrame takes the setting as it is now
    finally:
        spark.conf.set(CLEANUP, before)


def text_of(name: str = "text") -> Column:
    """The text, a null counting as empty."""
    return F.coalesce(F.col(name), F.lit(""))


def chunked(df: DataFrame, id_col: str, chunks: int) -> Column:
    """A chunk number from the row's own identifier: the same in every run."""
    return F.pmod(F.xxhash64(F.col(id_col)), F.lit(chunks)).cast("int")
