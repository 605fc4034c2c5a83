"""Queries over jobs, items and stored files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.operators import library as L
from spindrift.operators import ordering
from spindrift.plans import views
from spindrift.plans.registry import query

_STAMP = "yyyy-MM-dd HH:mm:ss"
_ENTRIES = f"""{views.JOBS}, {views.ITEMS}, {views.ARTIFACTS},
entries as (
  select j.id, coalesce(j.title, j.playlist, regexp_extract(j.input, '[^/]+$'), j.id::varchar) as title, j.status, j.pinned, coalesce(i.n_items, 0)::bigint as n_items, coalesce(i.n_segments, 0)::bigint as n_segments,
    coalesce(i.n_matched, 0)::bigint as n_matched, coalesce(a.bytes, 0)::bigint as bytes
  from jobs j left join (select job_id, count(*) as n_items, sum(n_segments) as n_segments, sum(n_matched) as n_matched from items group by 1) i on i.job_id = j.id
    left join (select job_id, sum(size_bytes) as bytes from artifacts group by 1) a on a.job_id = j.id)"""


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.library_entries(views.jobs(spark, sf_dir), views.items(spark, sf_dir), views.artifacts(spark, sf_dir))


@query(f"with {_ENTRIES} select * from entries")
def library_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _entries(spark, sf_dir).drop("updated_at")


@query(f"with {_ENTRIES} select id, title, status from entries where status in ('succeeded', 'partial_failed', 'failed', 'canceled') and not pinned and bytes = 0 and n_segments = 0")
def library_zombies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.zombies(_entries(spark, sf_dir)).select("id", "title", "status")


@query(f"with {views.JOBS} select id, status, strftime(created_at, '%Y-%m-%d %H:%M:%S') as created_at from jobs order by jobs.created_at desc, id limit 50")
def recent_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.recent(views.jobs(spark, sf_dir)).select("id", "status", F.date_format("created_at", _STAMP).alias("created_at"))


@query(f"with {views.JOBS} select id, title, pinned, row_number() over (order by pinned desc, updated_at desc, id) as place from jobs")
def pinned_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole library with each job's place, pinned jobs before others."""
    return ordering.placed(views.jobs(spark, sf_dir), [F.desc("pinned"), F.desc("updated_at"), "id"]).select("id", "title", "pinned", "place")


@query(f"with {views.ARTIFACTS}, once as (select * from artifacts qualify row_number() over (partition by path order by job_id, id) = 1) select category, count(*) as files, sum(size_bytes)::bigint as bytes from once group by 1")
def storage_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files stored once, where first seen."""
    return L.storage_by_category(L.first_seen(views.artifacts(spark, sf_dir), "path", "job_id", "id"))


@query(f"with {views.ARTIFACTS} select category, count(*) as files, sum(size_bytes)::bigint as bytes from artifacts group by rollup(category)")
def storage_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.storage_rollup(views.artifacts(spark, sf_dir))


@query(f"with {views.JOBS} select id, status from jobs where status in ('queued', 'running') and epoch_us(timestamp '1998-06-01' - updated_at) >= 86400000000 * 90")
def stale_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.stale(views.jobs(spark, sf_dir), F.lit("1998-06-01").cast("timestamp_ntz"), 90 * 86_400).select("id", "status")


@query(f"with {views.JOBS} select case when status in ('queued', 'running') and epoch_us(timestamp '1998-06-01' - updated_at) >= 86400000000 then 'failed' else status end as status, count(*) as n from jobs group by 1")
def recovered_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = L.recovered(views.jobs(spark, sf_dir), F.lit("1998-06-01").cast("timestamp_ntz"), "worker lost")
    return rows.groupBy("status").agg(F.count("*").alias("n"))


@query(f"with {views.JOBS} select case when status in ('succeeded', 'failed') then status else 'canceled' end as status, status not in ('succeeded', 'failed') as changed, count(*) as n from jobs group by 1, 2")
def guarded_cancel(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = L.guarded_update(views.jobs(spark, sf_dir), "canceled", unless=("succeeded", "failed"))
    return rows.groupBy("status", "changed").agg(F.count("*").alias("n"))


@query(f"with {views.JOBS}, {views.ITEMS} select status, count(*) as n from items where job_id not in (select id from jobs where status = 'failed') group by 1")
def cascade_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items left when failed jobs are deleted."""
    left = L.without(views.items(spark, sf_dir), views.jobs(spark, sf_dir).where("status = 'failed'"))
    return left.groupBy("status").agg(F.count("*").alias("n"))


@query(f"with {views.JOBS}, {views.ITEMS} select i.id, i.job_id from items i where not exists (select 1 from jobs j where j.id = i.job_id and j.id % 10 != 0)")
def orphan_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.orphans(views.items(spark, sf_dir), views.jobs(spark, sf_dir).where("id % 10 != 0")).select("id", "job_id")


@query(f"with {views.JOBS} select case when pinned then 'skipped' when status in ('queued', 'running') then 'canceled' else 'deleted' end as action, count(*) as n from jobs group by 1")
def bulk_delete_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.bulk_delete_plan(views.jobs(spark, sf_dir)).groupBy("action").agg(F.count("*").alias("n"))


@query(f"with {views.JOBS} select id, case when status in ('queued', 'running') then 'canceled' else 'deleted' end as action from jobs where id % 20 = 0")
def delete_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The jobs asked for, pinned ones too; an id that is no job's would be an error."""
    jobs = views.jobs(spark, sf_dir)
    return L.delete_plan(jobs, jobs.where("id % 20 = 0").select("id"))


@query(f"""with {views.ITEMS} select job_id, case when count(error) = 0 then 'succeeded' when count(error) < count(*) then 'partial_failed' else 'failed' end as status, count(error) as n_failed,
  (list(error order by seq, id) filter (error is not null))[1] as first_error, coalesce(array_to_string((list(error order by seq, id) filter (error is not null))[1:3], chr(10)), '') as summary from items group by 1""")
def item_status_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.status_rollup(views.items(spark, sf_dir))


@query("select user_id, event_type, max_by(value, event_id) as value, max(event_id) as event_id from events group by 1, 2")
def latest_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.table(spark, sf_dir, "events").select("user_id", "event_type", "value", "event_id")
    return L.latest(rows, ["user_id", "event_type"], ["event_id"])


@query("select user_id, 'merged' as event_type, count(*) as n from events where user_id % 5 = 0 group by 1 union all select user_id, event_type, count(*) from events where user_id % 5 != 0 group by 1, 2")
def replace_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by user and type, those of every fifth user replaced by one sum."""
    rows = views.table(spark, sf_dir, "events")
    counts = rows.groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    new = rows.where("user_id % 5 = 0").groupBy("user_id").agg(F.lit("merged").alias("event_type"), F.count("*").alias("n"))
    return L.replaced(counts, new, ["user_id"])
