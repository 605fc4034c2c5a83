"""Evaluation: precision and recall of cases, and their averages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def by_case(expected: DataFrame, actual: DataFrame, case: str = "case_id") -> DataFrame:
    """Per case of ``expected`` (case, track) against ``actual``: sizes, hits, precision and recall; no tracks count as one in denominators."""
    e = expected.select(case, F.lower(F.trim("track")).alias("track")).distinct().withColumn("e", F.lit(1))
    a = actual.select(case, "track").distinct().withColumn("a", F.lit(1))
    sums = e.join(a, [case, "track"], "full").groupBy(case).agg(F.count("e").alias("n_expected"), F.count("a").alias("n_actual"), F.count_if(F.col("e").isNotNull() & F.col("a").isNotNull()).alias("n_hit"))
    return sums.withColumns({"precision": F.col("n_hit") / F.greatest(F.lit(1), "n_actual"), "recall": F.col("n_hit") / F.greatest(F.lit(1), "n_expected")})


def macro(cases: DataFrame) -> DataFrame:
    """One row of averages; zeros for no cases."""
    mean = lambda c: F.coalesce(F.avg(c), F.lit(0.0)).alias(f"avg_{c}")
    return cases.agg(F.count("*").alias("case_count"), mean("precision"), mean("recall"))


def retry_counters(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """retried, matched and remaining of segments tried again."""
    rows = before.select(*keys, F.col("kind").alias("old")).join(after.select(*keys, F.col("kind").alias("new")), keys)
    open_ = F.col("old") == "music_unresolved"
    return rows.agg(F.count_if(open_).alias("retried"), F.count_if(open_ & (F.col("new") == "matched_track")).alias("matched"), F.count_if(F.col("new") == "music_unresolved").alias("remaining"))
