"""Shared helpers: shared-folder tables, bounded slices of Arrow batches, column hygiene."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text is worked on in slices of about this many bytes, so a task's Python memory does not depend on its partition.
SLICE_BYTES = 2 << 20


#: Folders handed out inside each ``scratch`` that is open in this thread.
_scratch: ContextVar[tuple[list[str], ...]] = ContextVar("scratch", default=())


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder below the cluster's spark.checkpoint.dir; only local sessions that leave it unset (tests) get a temporary one."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[[^]]*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spindrift-"))
        base = sc.getCheckpointDir()
    path = f"{base.rstrip('/')}/spindrift-{uuid.uuid4().hex}"
    for taken in _scratch.get()[-1:]:
        taken.append(path)
    return path


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Delete at the end, also after an error, the folders that operators took inside; what they return must have been written elsewhere by then."""
    taken: list[str] = []
    token = _scratch.set((*_scratch.get(), taken))
    try:
        yield
    finally:
        _scratch.reset(token)
        for path in taken:
            removed(spark, path)


def written(df: DataFrame, path: str, **options: str) -> DataFrame:
    """Cut the lineage: write a table into the shared folder and read it back."""
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, columns: str | tuple[str, ...], path: str, ordered: bool = False) -> DataFrame:
    """Cut the lineage by a table bucketed by ``columns``, and sorted by them if asked for, so that joins by these leave the rows where they are.

    The catalog's entry goes at once; the plan that is returned has read its files and buckets.
    """
    spark, name = df.sparkSession, f"bucketed_{uuid.uuid4().hex}"
    columns = (columns,) if isinstance(columns, str) else columns
    writer = df.write.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), *columns)
    (writer.sortBy(*columns) if ordered else writer).option("path", path).saveAsTable(name)
    table = spark.table(name)
    table.schema  # analysed while the entry is there
    spark.sql(f"DROP TABLE {name}")
    return table


def removed(spark: SparkSession, path: str) -> None:
    """Delete a superseded table of the shared folder."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


#: A side of a join is broadcast only while it takes up no more than this.
BROADCAST_BYTES = 64 << 20


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for helper columns that ``df`` has none of."""
    taken = {c.lower() for c in df.columns}
    tag = next(t for t in map("_{}".format, range(len(taken) + 1)) if not any(n + t in taken for n in names))
    return [n + tag for n in names]


def places_for(n: Column, total: int, spark: SparkSession) -> Column:
    """Places that a key with ``n`` of ``total`` rows is dealt out to: more than one where it holds over a quarter of a partition's even share."""
    share = max(1, total // (4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    return F.greatest(F.ceil(n / share), F.lit(1)).cast("int")


def dealt_join(big: DataFrame, small: DataFrame, keys: list[str], n: str, total: int, how: str = "inner") -> DataFrame:
    """Join where ``small`` has a row for each key and in ``n`` the number of ``big``'s rows with it, of ``total``.

    Keys that hold more than a quarter of a partition's even share of rows are dealt out to several places, so that none makes
    a task of its own; there are at most four such keys for each partition, and these are broadcast.
    """
    places = places_for(F.col(n), total, big.sparkSession)
    hot = F.broadcast(small.where(places > 1).select(*keys, places.alias("places")))
    dealt = big.join(hot, keys, "left").withColumn("place", F.pmod(F.xxhash64(*big.columns), F.coalesce("places", F.lit(1))).cast("int")).drop("places")
    return dealt.join(small.withColumn("place", F.explode(F.sequence(F.lit(0), places - 1))).drop(n), [*keys, "place"], how).drop("place")


def bytes_of(rows: DataFrame) -> int:
    """What rows of plain columns take up in a broadcast, about: their values as text, and 24 bytes for each."""
    sizes = [F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) + 24 for c in rows.columns]
    return rows.agg(F.sum(reduce(lambda a, b: a + b, sizes)).cast("long")).first()[0] or 0


def without(docs: DataFrame, columns: list[Column], dropped: DataFrame) -> DataFrame:
    """``docs`` but the rows whose ``columns`` stand in ``dropped`` (as many columns, null equal to null), which is broadcast below a size."""
    size = bytes_of(dropped)
    names = fresh(docs, *(f"out{k}" for k in range(len(columns))))
    out = dropped.toDF(*names)
    same = reduce(lambda a, b: a & b, (c.eqNullSafe(F.col(name)) for c, name in zip(columns, names, strict=True)))
    return docs.join(F.broadcast(out) if size <= BROADCAST_BYTES else out, same, "left_anti")


def text_or_empty(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def given_back() -> None:
    """Give the system back what Arrow's pool keeps of freed memory: a worker outlives its task, and an executor pays for all its workers."""
    pa.default_memory_pool().release_unused()


def parts_of(batches: Iterator[pa.RecordBatch], column: str | int, limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Batches cut into parts whose ``column`` (text) has about ``limit`` bytes, and that column; a longer text is a part of its own.

    Freed memory of Arrow's goes back to the system after each part.
    """
    for batch in batches:
        texts = batch.column(column)
        sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends, a = np.cumsum(sizes), 0
        while a < batch.num_rows:
            before = int(ends[a - 1]) if a else 0
            b = max(a + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(a, b - a), texts.slice(a, b - a)
            given_back()
            a = b
        del batch, texts  # else the next batch is read while this one is held


def byte_parts(batches: Iterator[pa.RecordBatch], column: str | int) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Bounded parts of batches, and their texts as UTF-8 bytes, null as empty."""
    for part, texts in parts_of(batches, column):
        yield part, [x or b"" for x in texts.cast(pa.binary()).to_pylist()]


def text_parts(batches: Iterator[pa.RecordBatch], column: str | int) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    """Bounded parts of batches, and their texts."""
    for part, texts in parts_of(batches, column):
        yield part, texts.to_pylist()
