"""Streams: tails of an event log, progress counts and windowed activity, with Structured Streaming.

Tails and counts are delivered batch by batch into tables of the shared folder. A batch writes into a folder of its own number,
which a repetition of the batch after a failure overwrites, so what was delivered once is there once. Nothing goes through the driver but statuses.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Statuses in which a job does no more.
TERMINAL = ("succeeded", "partial_failed", "failed", "canceled")


def read_log(spark: SparkSession, folder: str, schema: str, pattern: str = "*.parquet", files_per_batch: int = 1) -> DataFrame:
    """A folder of Parquet files as a stream of its appended files."""
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def tail(log: DataFrame, job_id: object, cursor: int = 0) -> DataFrame:
    """A job's events after a cursor; id grows within the log."""
    return log.where((F.col("job_id") == job_id) & (F.col("id") > cursor))


def progress(items: DataFrame) -> DataFrame:
    """Running counts by input: found, done and failed."""
    done, failed = F.count_if(F.col("status") == "succeeded"), F.count_if(F.col("status") == "failed")
    return items.groupBy("input").agg(F.count("*").alias("found"), done.alias("done"), failed.alias("failed"))


def activity(log: DataFrame, width: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Counts by type and window of event time, final once the watermark has passed the window."""
    windows = log.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return windows.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def batch_folder(folder: str, number: int) -> str:
    return f"{folder}/batch={number:012d}"


def numbers(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the batches that a folder holds whole, ascending."""
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(where):
        return []
    found = [(x.getPath().getName(), x.getPath()) for x in files.listStatus(where)]
    done = [name for name, path in found if name.startswith("batch=") and files.exists(spark._jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS"))]
    return sorted(int(name.removeprefix("batch=")) for name in done)


def read_batches(spark: SparkSession, folder: str, schema: str, after: int = -1) -> DataFrame:
    """Rows of a folder's batches beyond a number, with their batch."""
    paths = [batch_folder(folder, n) for n in numbers(spark, folder) if n > after]
    rows = spark.read.schema(schema).option("basePath", folder).parquet(*paths) if paths else spark.createDataFrame([], schema)
    return rows if paths else rows.withColumn("batch", F.lit(0).cast("int"))


def run_all(stream: DataFrame, fold: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append", timeout_s: float | None = None) -> bool:
    """Run a stream over all there is; False if it was stopped by the time-out."""
    query = stream.writeStream.foreachBatch(fold).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    if timeout_s is None:
        query.awaitTermination()
        return True
    over = query.awaitTermination(timeout_s)
    if not over:
        query.stop()
    return bool(over)


class Watched(NamedTuple):
    """How a watch ended: the job's status, whether time ran out, and the exit code (0 done, 1 failed or canceled, 2 timed out)."""

    status: str
    timed_out: bool

    @property
    def code(self) -> int:
        return 2 if self.timed_out else 1 if self.status in ("failed", "canceled") else 0


def delivered(log: DataFrame, job_id: object, folder: str, checkpoint: str, cursor: int = 0, timeout_s: float | None = None) -> bool:
    """Append a job's events beyond a cursor to ``folder``, each once, as far as the log goes now; False for a time-out.

    The cursor is the largest id that stands in the folder, ``cursor`` while there is none: a delivery that begins
    anew, even with a new checkpoint, repeats nothing.
    """
    spark = log.sparkSession
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in log.schema)

    def fold(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        known = [n for n in numbers(session, folder) if n != base + number]  # a repeated batch is written anew
        seen = session.read.schema(schema).parquet(*(batch_folder(folder, n) for n in known)).agg(F.max("id")).first()[0] if known else None
        tail(batch, job_id, cursor if seen is None else max(cursor, seen)).write.mode("overwrite").parquet(batch_folder(folder, base + number))

    # A new checkpoint counts from zero again; its batches come after those that are there.
    marked = spark._jvm.org.apache.hadoop.fs.Path(checkpoint)
    files = marked.getFileSystem(spark._jsc.hadoopConfiguration())
    start = spark._jvm.org.apache.hadoop.fs.Path(f"{checkpoint}-start")
    if not files.exists(start):
        files.mkdirs(start)
        files.mkdirs(spark._jvm.org.apache.hadoop.fs.Path(start, str(max(numbers(spark, folder), default=-1) + 1)))
    base = int(files.listStatus(start)[0].getPath().getName())
    return run_all(log, fold, checkpoint, timeout_s=timeout_s)


def watched(log: DataFrame, statuses: Callable[[], DataFrame], job_id: object, folder: str, checkpoint: str, interval_s: float = 2.0, timeout_s: float | None = None) -> Watched:
    """Deliver a job's events as they come until its status is terminal or time runs out.

    ``statuses`` reads rows (id, status) anew. A status is read before the events, so all that was logged before a job ended is delivered.
    """
    if interval_s < 0 or (timeout_s is not None and timeout_s < 0):
        raise ValueError("interval and time-out are not below zero")
    deadline = None if timeout_s is None else time.monotonic() + timeout_s
    while True:
        row = statuses().where(F.col("id") == job_id).select("status").first()
        if row is None:
            raise ValueError(f"Unknown job: {job_id}")
        left = None if deadline is None else max(0.05, deadline - time.monotonic())
        whole = delivered(log, job_id, folder, checkpoint, timeout_s=left)
        if row.status in TERMINAL and whole:
            return Watched(row.status, False)
        now = time.monotonic()
        if deadline is not None and now >= deadline:
            return Watched(row.status, True)
        time.sleep(interval_s if deadline is None else min(interval_s, max(0.0, deadline - now)))


def discovered(items: DataFrame, folder: str, checkpoint: str, compact_every: int = 20) -> None:
    """Keep running counts by input in a table, by update mode: a batch writes the inputs that it changed, and no others.

    ``folder``/changes has a batch's changed rows, ``folder``/base all rows as of some batch; every ``compact_every`` batches a new base is written.
    ``discovery`` reads the table.
    """

    def fold(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(batch_folder(f"{folder}/changes", number))
        if (number + 1) % compact_every == 0:
            discovery(batch.sparkSession, folder, upto=number).write.mode("overwrite").parquet(batch_folder(f"{folder}/base", number))

    run_all(progress(items), fold, checkpoint, "update")


PROGRESS = "input string, found long, done long, failed long"


def discovery(spark: SparkSession, folder: str, upto: int | None = None) -> DataFrame:
    """The counts by input that ``discovered`` has written, as of a batch."""
    bases = [n for n in numbers(spark, f"{folder}/base") if upto is None or n < upto]
    base = max(bases, default=-1)
    rows = read_batches(spark, f"{folder}/changes", PROGRESS, base)
    if bases:
        rows = rows.unionByName(spark.read.schema(PROGRESS).parquet(batch_folder(f"{folder}/base", base)).withColumn("batch", F.lit(base)))
    if upto is not None:
        rows = rows.where(F.col("batch") <= upto)
    return rows.groupBy("input").agg(F.max_by(F.struct("found", "done", "failed"), "batch").alias("_last")).select("input", "_last.*")


def drained(stream: DataFrame, folder: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run a stream over all there is into ``folder`` and return what it wrote; in complete mode the last batch's rows."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stream.schema)

    def fold(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(batch_folder(folder, number))

    run_all(stream, fold, checkpoint, mode)
    last = max(numbers(stream.sparkSession, folder), default=-1)
    return read_batches(stream.sparkSession, folder, schema, last - 1 if mode == "complete" else -1).drop("batch")


def appended(stream: DataFrame, folder: str, checkpoint: str) -> None:
    """Run a stream over all there is and append it to Parquet, each batch once."""
    stream.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def latest_into(stream: DataFrame, folder: str, keys: list[str], order: list[str], checkpoint: str) -> None:
    """Keep the last row of each key in a folder of numbered versions, each batch folded into the one before."""
    from spindrift.operators.library import latest

    def fold(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch if number == 0 else spark.read.parquet(f"{folder}/v{number - 1}").unionByName(batch)
        latest(rows, keys, order).write.mode("overwrite").parquet(f"{folder}/v{number}")

    stream.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
