"""Connected components of an edge list, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.llm.common import dealt_join, removed, written


def components(edges: DataFrame, base: str) -> DataFrame:
    """Return vertex, root (smallest vertex of its component) for every vertex of edges (u, v).

    Each step links neighbours to the smallest one around: large-star the larger neighbours of every vertex, small-star
    the smaller. Sums and minima combine before their shuffle, and a vertex with very many neighbours is dealt out to several
    places in the join that follows. The driver sees a count and a checksum per round. No edges give no rows.
    """
    now = written(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), f"{base}/edges0")
    total, seen, k = now.count(), None, 0
    while True:
        k += 1
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"))
        large = dealt_join(both, least, ["u"], "n", 2 * total).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = dealt_join(large, low, ["u"], "n", total).where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", "m"))
        after = written(small.where("u != v").distinct(), f"{base}/edges{k}")
        mark = tuple(after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
        removed(edges.sparkSession, f"{base}/edges{k - 1}")
        now, total = after, mark[0]
        if mark == seen:
            return now.select(F.col("u").alias("vertex"), F.col("v").alias("root")).union(now.select("v", "v").distinct())
        seen = mark
