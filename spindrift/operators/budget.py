"""Budgets of calls: ordered turns that spend or give back, with refusal.

A turn that spends is refused where less than its cost remains, and then costs nothing; one that costs nothing is a question, allowed
while something remains. A refund gives back what an earlier turn consumed, up to the budget at first. What remains after a
turn depends on all turns before, but a stretch of turns is a function from what remains before it to what remains after it, a table
with a place for each value up to the budget. So turns are dealt out in ranges of group and order; only of groups that
several partitions share are such tables made, and these, combined from partition to partition, give each stretch its start.
A group of any length is thus worked on by many tasks, and a task keeps one number, or one table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spindrift.sources.folders import shared_folder, written


def after(remaining: np.ndarray, cost: int, refund: int, budget: int) -> np.ndarray:
    """What remains after a turn, for each value before it."""
    if refund > 0:
        return np.minimum(remaining + refund, budget)
    return np.where((cost > 0) & (remaining >= cost), remaining - cost, remaining)


def _tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """group, part and the table of each stretch of rows (group, part, cost, refund, budget), which are sorted."""
    key, table, budget = None, None, 0

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.string()), pa.array([key[1]], pa.int32()), pa.array([table.tolist()], pa.list_(pa.int64()))], ["group", "part", "after"])

    for batch in batches:
        for group, part, cost, refund, first in zip(*(batch.column(c).to_pylist() for c in ("group", "part", "cost", "refund", "budget")), strict=True):
            if key != (group, part):
                if key is not None:
                    yield row()
                key, budget = (group, part), first
                table = np.arange(budget + 1)
            table = after(table, cost, refund, budget)
    if key is not None:
        yield row()


def _starts(found: pa.Table) -> pa.Table:
    """What remains at the start of each stretch of a group; there are as many as partitions at most."""
    rows = sorted(found.to_pylist(), key=lambda r: r["part"])
    remaining, starts = len(rows[0]["after"]) - 1, []
    for r in rows:
        starts.append(remaining)
        remaining = r["after"][remaining]
    return pa.table({"group": pa.array([r["group"] for r in rows], pa.string()), "part": pa.array([r["part"] for r in rows], pa.int32()), "start": pa.array(starts, pa.int64())})


def spending(turns: DataFrame, budget: Column, group: list[str], order: list[str], cost: str = "cost", refund: str | None = None) -> DataFrame:
    """Turns with before, remaining (after), consumed and allowed.

    ``budget`` is of the group, below zero as zero; ``cost`` below zero is a question as zero is. A row whose ``refund`` is above zero
    gives back that much and spends nothing; it is allowed. Null costs and refunds count as zero, null groups are one group. Rows of equal ``order``
    are taken by a hash of all their columns, so an ambiguous order is still the same in every run.
    """
    spark, names = turns.sparkSession, turns.columns
    given = F.coalesce(F.col(refund), F.lit(0)).cast("long") if refund else F.lit(0).cast("long")
    key = F.to_json(F.struct(*group), {"ignoreNullFields": "false"})
    keyed = turns.withColumns({"_group": key, "_cost": F.coalesce(F.col(cost), F.lit(0)).cast("long"), "_refund": given, "_budget": F.greatest(budget.cast("long"), F.lit(0).cast("long")), "_tie": F.xxhash64(*names)})
    sorting = ["_group", *order, "_tie"]
    # Numbers that grow from row to row, with the partition's in the upper bits.
    placed = keyed.repartitionByRange(*sorting).sortWithinPartitions(*sorting).withColumn("_place", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_place", 33).cast("int"))
    base = shared_folder(spark)
    rows = written(placed.drop("_tie"), f"{base}/turns")
    several = rows.groupBy("_group").agg(F.count_distinct("_part").alias("n")).where("n > 1").select("_group")  # two a partition at most
    shared = rows.join(F.broadcast(several), "_group").select(F.col("_place").alias("place"), F.col("_group").alias("group"), F.col("_part").alias("part"), F.col("_cost").alias("cost"), F.col("_refund").alias("refund"), F.col("_budget").alias("budget"))
    tables = written(shared.repartition("part").sortWithinPartitions("place").mapInArrow(_tables, "group string, part int, after array<long>"), f"{base}/tables")
    starts = tables.groupBy("group").applyInArrow(_starts, "group string, part int, start long")
    started = rows.join(F.broadcast(starts.select(F.col("group").alias("_group"), F.col("part").alias("_part"), F.col("start").alias("_start"))), ["_group", "_part"], "left")
    schema = T.StructType([*turns.schema.fields, *(T.StructField(c, T.LongType()) for c in ("before", "remaining", "consumed")), T.StructField("allowed", T.BooleanType())])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, remaining = None, 0
        for batch in batches:
            before, consumed, allowed, left = [], [], [], []
            for g, part, c, r, b, start in zip(*(batch.column(x).to_pylist() for x in ("_group", "_part", "_cost", "_refund", "_budget", "_start")), strict=True):
                if (g, part) != now:
                    now, limit = (g, part), b
                    remaining = b if start is None else start
                before.append(remaining)
                if r > 0:
                    remaining, ok, used = min(limit, remaining + r), True, 0
                elif c <= 0:
                    ok, used = remaining > 0, 0
                else:
                    ok = remaining >= c
                    used = c if ok else 0
                    remaining -= used
                consumed.append(used)
                allowed.append(ok)
                left.append(remaining)
            new = [pa.array(before, pa.int64()), pa.array(left, pa.int64()), pa.array(consumed, pa.int64()), pa.array(allowed, pa.bool_())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *new], schema.names)

    return started.repartition("_part").sortWithinPartitions("_place").select(*names, "_group", "_part", "_cost", "_refund", "_budget", "_start").mapInArrow(walk, schema)
