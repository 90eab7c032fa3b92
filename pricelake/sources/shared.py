"""Files of the shared store, through Spark's own file systems."""

from __future__ import annotations

import atexit
import os
import uuid

from pyspark.sql import DataFrame, SparkSession


def workspace(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share (spark.checkpoint.dir); it goes when the driver's Python ends.

    Where that is unset and all runs in one process (tests), it is in the warehouse.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = spark.conf.get("spark.sql.warehouse.dir")
    path = f"{named.rstrip('/')}/pricelake/{name}-{uuid.uuid4().hex}"

    def drop() -> None:
        if spark.sparkContext._jsc is not None:
            Store(spark, path).delete("")

    atexit.register(drop)
    return path


def many_tasks(spark: SparkSession) -> int:
    """How many tasks costly rows are dealt out to: a table that is small as a file would be read, and worked through, in one or two."""
    return max(24, 4 * spark.sparkContext.defaultParallelism)


def dealt_out(df: DataFrame, *key: str) -> DataFrame:
    """The same rows in many tasks, by their key: without a sort, as a deal in turns would need it."""
    return df.repartition(many_tasks(df.sparkSession), *key)


class Store:
    """A folder of a store that Spark can reach."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self._jvm, self.root = spark.sparkContext._jvm, root.rstrip("/")
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path("").getFileSystem(self._conf)

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def names(self, folder: str) -> list[str]:
        """What is in a folder; nothing where there is none."""
        at = self._path(folder)
        return sorted(x.getPath().getName() for x in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def read(self, name: str) -> str:
        stream = self._fs.open(self._path(name))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, name: str, content: str) -> bool:
        """Writes a file that isn't there yet, whole or not at all; False if another writer was first.

        The content is written aside and moved into place by a rename that does
        not overwrite, which is atomic in HDFS; a local folder takes a hard link.
        """
        folder, _, last = name.rpartition("/")
        aside = self._path(f"{folder}/.{last}.{uuid.uuid4().hex}")
        out = self._fs.create(aside, False)
        out.write(bytearray(content.encode()))
        out.close()
        try:
            if self._fs.getScheme() == "file":
                os.link(aside.toUri().getPath(), self._path(name).toUri().getPath())
            else:
                context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path("").toUri(), self._conf)
                options = self._jvm.org.apache.hadoop.fs.Options
                context.rename(aside, self._path(name), self._sc_array(options))
            return True
        except FileExistsError:
            return False
        except Exception:
            if self._fs.exists(self._path(name)):
                return False
            raise
        finally:
            self._fs.delete(aside, False)

    def _sc_array(self, options):
        """An empty array of rename options: not to overwrite is what a rename does without any."""
        from pyspark import SparkContext

        kind = getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename")
        return SparkContext._gateway.new_array(kind, 0)

    def delete(self, name: str) -> None:
        self._fs.delete(self._path(name), True)
