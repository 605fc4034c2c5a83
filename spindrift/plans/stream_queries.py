"""Streaming queries: each drains a stream of the shared tables and returns the final table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.plans.registry import query
from spindrift.sources.folders import shared_folder
from spindrift.streaming import events as S

_EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.read_log(spark, sf_dir, _EVENTS, "events.parquet")


@query("select event_type, count(*) as n, round(sum(value), 4) as total from events group by 1")
def stream_event_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts, base = _log(spark, sf_dir).groupBy("event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")), shared_folder(spark)
    return S.drained(counts, f"{base}/counts", f"{base}/stream", "complete").select("event_type", "n", F.round("total", 4).alias("total"))


_TAILED = "id long, job_id long, event_type string"


@query("select event_id as id, event_type from events where user_id = 7 and event_id > 0")
def stream_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A job's events, watched until its status is terminal; statuses are read from the job's last event."""
    log = _log(spark, sf_dir).select(F.col("event_id").alias("id"), F.col("user_id").alias("job_id"), "event_type")
    statuses = lambda: spark.read.parquet(f"{sf_dir}/events.parquet").groupBy(F.col("user_id").alias("id")).agg(F.lit("succeeded").alias("status"))
    base = shared_folder(spark)
    S.watched(log, statuses, 7, f"{base}/tail", f"{base}/stream")
    return S.read_batches(spark, f"{base}/tail", _TAILED).select("id", "event_type")


@query("select 'input-' || user_id % 20 as input, count(*) as found, count(*) filter (event_type != 'error') as done, count(*) filter (event_type = 'error') as failed from events group by 1")
def stream_discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items found, done and failed while inputs are read: changed counts only, merged by input."""
    items = _log(spark, sf_dir).select(F.concat(F.lit("input-"), F.col("user_id") % 20).alias("input"), F.when(F.col("event_type") == "error", "failed").otherwise("succeeded").alias("status"))
    base = shared_folder(spark)
    S.discovered(items, f"{base}/discovery", f"{base}/stream")
    return S.discovery(spark, f"{base}/discovery")
