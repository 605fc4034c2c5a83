"""Places in an order over a whole table, without a task that sees all of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spindrift.sources.folders import shared_folder, written


def placed(rows: DataFrame, order: list[Column | str], name: str = "place") -> DataFrame:
    """Rows with their place (from 1) in ``order``, which should leave no ties.

    Rows go to ranges of the order and are numbered inside; a range's rows come after those of the ranges before it, whose
    numbers of rows are one number a partition. An empty table gives an empty one.
    """
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())  # the partition in the upper bits
    kept = written(ranged, f"{shared_folder(rows.sparkSession)}/ranges")
    part, inside = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    sizes = kept.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each partition
    offsets = sizes.select("_part", before.alias("_before"))
    return kept.join(F.broadcast(offsets), part == F.col("_part")).withColumn(name, F.col("_before") + inside + 1).drop("_at", "_part", "_before")
