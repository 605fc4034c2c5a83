"""Library, storage and lifecycle of jobs: roll-ups, upserts, deletes and recovery, on immutable tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Job states.
TERMINAL = ("succeeded", "partial_failed", "failed", "canceled")
ACTIVE = ("queued", "running")


def blank_as_null(text: Column) -> Column:
    return F.nullif(F.trim(text), F.lit(""))


def resolved_title(title: Column, playlist: Column, source: Column, key: Column) -> Column:
    """Title, else playlist, else the input's last path part, else the id."""
    return F.coalesce(blank_as_null(title), blank_as_null(playlist), blank_as_null(F.substring_index(source, "/", -1)), key.cast("string"))


def library_entries(jobs: DataFrame, items: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Per job: title, status, pinned, counts of items, segments and matches, and bytes. Children are summed before they are joined."""
    counts = items.groupBy("job_id").agg(F.count("*").alias("n_items"), F.sum("n_segments").alias("n_segments"), F.sum("n_matched").alias("n_matched"))
    sizes = artifacts.groupBy("job_id").agg(F.sum("size_bytes").alias("bytes"))
    joined = jobs.join(counts, jobs["id"] == counts["job_id"], "left").join(sizes, jobs["id"] == sizes["job_id"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return joined.select("id", resolved_title(F.col("title"), F.col("playlist"), F.col("input"), F.col("id")).alias("title"), "status", "pinned", "updated_at", *map(zero, ("n_items", "n_segments", "n_matched", "bytes")))


def zombies(entries: DataFrame) -> DataFrame:
    """Ended jobs that are not pinned and hold neither bytes nor segments."""
    return entries.where(F.col("status").isin(*TERMINAL) & ~F.col("pinned") & (F.col("bytes") == 0) & (F.col("n_segments") == 0))


def recent(jobs: DataFrame, limit: int = 50) -> DataFrame:
    return jobs.orderBy(F.desc("created_at"), F.asc("id")).limit(limit)


def first_seen(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """One row for each key, the first in order."""
    first = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return rows.withColumn("_row", first).where("_row = 1").drop("_row")


def storage_by_category(artifacts: DataFrame) -> DataFrame:
    return artifacts.groupBy("category").agg(F.count("*").alias("files"), F.sum("size_bytes").alias("bytes"))


def storage_rollup(artifacts: DataFrame) -> DataFrame:
    """Categories and, with a null category, their total."""
    return artifacts.rollup("category").agg(F.count("*").alias("files"), F.sum("size_bytes").alias("bytes"))


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Upsert: the last row of each key."""
    others = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*others), F.struct(*order)).alias("_last"))
    return best.select(*keys, "_last.*")


def replaced(rows: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of the keys that ``new`` holds give way to those of ``new``."""
    return rows.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def guarded_update(jobs: DataFrame, new_status: str, unless: tuple[str, ...] = ()) -> DataFrame:
    """Compare and set: status is ``new_status`` except where it is one of ``unless``; changed tells which rows."""
    guarded = F.col("status").isin(*unless) if unless else F.lit(False)
    return jobs.withColumn("changed", ~guarded).withColumn("status", F.when(guarded, F.col("status")).otherwise(new_status))


def without(children: DataFrame, deleted: DataFrame, key: str = "job_id") -> DataFrame:
    """Cascade: children whose job is not deleted; children of no job stay."""
    return children.join(deleted.select(F.col("id").alias(key)), key, "left_anti")


def orphans(children: DataFrame, jobs: DataFrame, key: str = "job_id") -> DataFrame:
    """Children that name a job there is not."""
    return children.where(F.col(key).isNotNull()).join(jobs.select(F.col("id").alias(key)), key, "left_anti")


def stale(jobs: DataFrame, now: Column, older_than_seconds: int | None = 86_400) -> DataFrame:
    """Active jobs not updated for so long (just as long counts too); no age asks for all active jobs."""
    found = jobs.where(F.col("status").isin(*ACTIVE))
    if older_than_seconds is None:
        return found
    if older_than_seconds < 0:
        raise ValueError("older_than_seconds must not be negative")
    return found.where(F.timestamp_diff("SECOND", F.col("updated_at"), now) >= older_than_seconds)


def recovered(jobs: DataFrame, now: Column, reason: str, older_than_seconds: int | None = 86_400, dry_run: bool = False) -> DataFrame:
    """Jobs with stale ones failed for a reason; a dry run only flags them."""
    ids = stale(jobs, now, older_than_seconds).select(F.col("id").alias("_id"))
    rows = jobs.join(ids, jobs["id"] == ids["_id"], "left").withColumn("recovered", F.col("_id").isNotNull()).drop("_id")
    if dry_run:
        return rows
    return rows.withColumns({"error": F.when(F.col("recovered"), reason), "status": F.when(F.col("recovered"), "failed").otherwise(F.col("status"))})


def bulk_delete_plan(jobs: DataFrame, include_pinned: bool = False) -> DataFrame:
    """What a bulk delete does with each job: skipped, canceled (then deleted) or deleted."""
    skip = F.col("pinned") & F.lit(not include_pinned)
    return jobs.select("id", F.when(skip, "skipped").when(F.col("status").isin(*ACTIVE), "canceled").otherwise("deleted").alias("action"))


def delete_plan(jobs: DataFrame, asked: DataFrame, include_pinned: bool = True, strict: bool = True) -> DataFrame:
    """As ``bulk_delete_plan`` for the jobs that ``asked`` (id) names; an unknown one is an error when the rows are read, or left out if not ``strict``."""
    wanted = asked.select("id").distinct()
    if not strict:
        return bulk_delete_plan(jobs.join(wanted, "id", "left_semi"), include_pinned)
    found = wanted.join(jobs.select("id", "pinned", "status", F.lit(True).alias("_there")), "id", "left")
    unknown = F.raise_error(F.concat(F.lit("Unknown job: "), F.col("id").cast("string"))).cast(jobs.schema["id"].dataType)
    return bulk_delete_plan(found.withColumn("id", F.when(F.col("_there").isNull(), unknown).otherwise(F.col("id"))), include_pinned)


def status_rollup(items: DataFrame, shown: int = 3) -> DataFrame:
    """Job status from its items: none failed, some, or all; and the first errors, a line each; no more than these are kept of a job."""
    first = Window.partitionBy("job_id").orderBy("seq", "id")
    kept = items.where("error is not null").select("job_id", "error", F.row_number().over(first).alias("_place")).where(F.col("_place") <= shown)
    errors = kept.groupBy("job_id").agg(F.array_sort(F.collect_list(F.struct("_place", "error"))).alias("_errors"))
    counts = items.groupBy("job_id").agg(F.count("*").alias("n"), F.count_if(F.col("status") == "failed").alias("n_failed"))
    status = F.when(F.col("n_failed") == 0, "succeeded").when(F.col("n_failed") < F.col("n"), "partial_failed").otherwise("failed")
    text = F.transform(F.coalesce("_errors", F.array().cast("array<struct<_place:int,error:string>>")), lambda e: e["error"])
    return counts.join(errors, "job_id", "left").select("job_id", status.alias("status"), "n_failed", F.get(text, F.lit(0)).alias("first_error"), F.array_join(text, "\n").alias("summary"))


def path_depth_first(paths: DataFrame, column: str = "path") -> DataFrame:
    """Deepest paths first, so that children go before their folder."""
    return paths.orderBy(F.desc(F.size(F.split(column, "/"))), F.asc(column))
