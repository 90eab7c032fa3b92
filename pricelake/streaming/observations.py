"""Observations and run items as they arrive: each taken once, counters kept up with them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pricelake.operators.comparison import latest_of
from pricelake.sources.snapshots import Conflict, SnapshotLog

#: How often a change is computed anew when other writers were first.
TRIES = 10


def append_observations(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends a stream of observations to Parquet, by the day observed; once for what is there."""
    dated = stream.withColumn("observed_on", F.to_date("observed_at"))
    writer = dated.writeStream.format("parquet").partitionBy("observed_on").option("path", path)
    return writer.option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def append_batch(observations: DataFrame, path: str) -> None:
    """A run's observations in Parquet, by run: a run that is written again takes the place of what it wrote before."""
    _by_run(observations, path)


def append_items(items: DataFrame, path: str) -> None:
    """A run's items in Parquet, by run, in the same way."""
    _by_run(items, path)


def _by_run(rows: DataFrame, path: str) -> None:
    if not rows.where("run_id IS NULL").isEmpty():
        raise ValueError("rows without run can't be told from those written before")
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(path)


def _started(stream: DataFrame, mode: str, checkpoint: str, take: Callable[[DataFrame, int], None]) -> StreamingQuery:
    writer = stream.writeStream.foreachBatch(take).outputMode(mode)
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def append_once(stream: DataFrame, log: SnapshotLog, table: str, checkpoint: str, writer: str | None = None) -> StreamingQuery:
    """Appends a stream to a table of a snapshot log, each batch once.

    Spark offers a batch again that failed, or that was committed just before the
    stream broke off.  The log keeps the number of a writer's last batch in the
    same commit as its rows, so it knows.
    """
    name = writer or f"append {table}"
    return _started(stream, "append", checkpoint, lambda rows, batch: log.append(table, rows, writer=name, batch=batch) and None)


def _merged(log: SnapshotLog, table: str, schema: str, writer: str, taken_over: Callable[[DataFrame, DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """What takes a batch of rows over into a table: anew from the version that won, where another writer was first.

    The table is the state: the log holds each batch once, so none is kept by the
    stream, whose rows must come from a stream without state of its own.
    """

    def take(rows: DataFrame, batch: int) -> None:
        for _ in range(TRIES):
            if log.taken(writer, batch):
                return
            base = log.version()
            known = table in log.manifest(base)["tables"]
            before = log.read(table, base) if known else log.spark.createDataFrame([], schema)
            try:
                log.commit(f"{writer}, batch {batch}", {table: taken_over(before, rows).select(*before.columns)}, base=base, writer=writer, batch=batch)
                return
            except Conflict:
                continue
        raise Conflict(f"{writer}: other writers were first {TRIES} times")

    return take


COUNTERS = "run_id long, ok long, error long, skipped long"


def counters_of(items: DataFrame) -> DataFrame:
    """(run_id, ok, error, skipped) of run items, of a table or of a stream."""
    return items.groupBy(F.col("run_id").cast("long").alias("run_id")).agg(*(F.count_if(F.col("status") == s).alias(s) for s in ("ok", "error", "skipped")))


def live_counters(items: DataFrame, log: SnapshotLog, table: str, checkpoint: str, writer: str | None = None) -> StreamingQuery:
    """Keeps a table of a snapshot log at the counters of all run items that a stream has brought.

    A batch's counts are added to the table's in one commit.
    """

    def added(before: DataFrame, rows: DataFrame) -> DataFrame:
        both = before.unionByName(counters_of(rows))
        return both.groupBy("run_id").agg(*(F.sum(c).alias(c) for c in ("ok", "error", "skipped")))

    return _started(items, "append", checkpoint, _merged(log, table, COUNTERS, writer or f"counters {table}", added))


def live_latest(observations: DataFrame, log: SnapshotLog, table: str, checkpoint: str, order: Column, writer: str | None = None) -> StreamingQuery:
    """Keeps a table of a snapshot log at the last observation of every pair, whatever order they arrive in.

    A late observation does not win: the order decides, not the arrival.
    """
    schema = observations.schema.simpleString().removeprefix("struct<").removesuffix(">")
    take = _merged(log, table, schema, writer or f"latest {table}", lambda before, rows: latest_of(before.unionByName(rows), order))
    return _started(observations, "append", checkpoint, take)


def hourly_prices(stream: DataFrame, late: str = "1 day") -> DataFrame:
    """Observations and the lowest price of each product and hour; rows later than late are left out."""
    hours = stream.withWatermark("observed_at", late).groupBy(F.window("observed_at", "1 hour"), "product_id")
    return hours.agg(F.count("*").alias("observations"), F.min("price").alias("lowest"))
