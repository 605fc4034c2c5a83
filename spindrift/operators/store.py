"""Scans, appends and payloads of the job store, on immutable tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.operators import ledger


def known(jobs: DataFrame, job_id: object) -> DataFrame:
    """The job; an error where there is none."""
    found = by_id(jobs, job_id)
    if found.isEmpty():
        raise ValueError(f"no job {job_id!r}")
    return found


def by_id(jobs: DataFrame, job_id: object) -> DataFrame:
    """The job of an id, or no row."""
    return jobs.where(F.col("id") == job_id)


def scan(rows: DataFrame, order: list[Column | str], job_id: object = None) -> DataFrame:
    """Rows of one job, or of all, in order."""
    return (rows if job_id is None else rows.where(F.col("job_id") == job_id)).orderBy(*order)


def discovery_states(rows: DataFrame, job_id: object) -> DataFrame:
    """Discovery states of a job by item."""
    return scan(rows, ["source_item_id"], job_id)


def storage_order() -> list[Column]:
    """Stored files by job, those of none first, then category and label."""
    return [F.coalesce(F.col("job_id").cast("string"), F.lit("")), F.col("category"), F.col("label")]


def catalog_order() -> list[Column]:
    """Catalog tracks by artist, title and path, missing ones first."""
    return [F.asc_nulls_first(c) for c in ("artist", "title", "path")]


def by_ids(tracks: DataFrame, ids: DataFrame, key: str = "track_id") -> DataFrame:
    """The tracks whose ids are asked for."""
    return tracks.join(ids.select(F.col(ids.columns[0]).alias(key)), key, "left_semi")


def cancel_requested(jobs: DataFrame, job_id: object) -> bool:
    """Whether the job is to be canceled; a job there is not isn't."""
    row = jobs.where(F.col("id") == job_id).select(F.coalesce("cancel_requested", F.lit(False))).first()
    return bool(row and row[0])


def appended(rows: DataFrame, new: DataFrame, jobs: DataFrame, key: str = "job_id") -> DataFrame:
    """Rows and those new ones whose job there is; others are ignored."""
    return rows.unionByName(new.join(jobs.select(F.col("id").alias(key)), key, "left_semi").select(*rows.columns))


def inserted(jobs: DataFrame, new: DataFrame) -> DataFrame:
    """Jobs with new ones; an id there already is an error when the rows are read."""
    both = jobs.withColumn("_new", F.lit(False)).unionByName(new.select(*jobs.columns).withColumn("_new", F.lit(True)))
    others = [c for c in jobs.columns if c != "id"]
    one = both.groupBy("id").agg(F.count("*").alias("_n"), F.first(F.struct(*others)).alias("_row"))
    checked = F.when(F.col("_n") > 1, F.raise_error(F.concat(F.lit("there is a job "), F.col("id").cast("string")))).otherwise(F.col("id"))
    return one.select(checked.cast(jobs.schema["id"].dataType).alias("id"), *(F.col(f"_row.{c}") for c in others))


def replaced_files(rows: DataFrame, new: DataFrame, job_id: object = None, key: str = "path") -> DataFrame:
    """A job's stored files give way to the new ones; without a job, only files with the same key do."""
    kept = rows if job_id is None else rows.where(~F.col("job_id").eqNullSafe(F.lit(job_id)))
    return kept.join(new.select(key).distinct(), key, "left_anti").select(*rows.columns).unionByName(new)


def pinned(jobs: DataFrame, pins: DataFrame) -> DataFrame:
    """Jobs with whether they stand in the table of pins (job_id)."""
    marks = pins.select(F.col("job_id").alias("id"), F.lit(True).alias("pinned")).distinct()
    return jobs.drop("pinned").join(marks, "id", "left").withColumn("pinned", F.coalesce("pinned", F.lit(False)))


def toggled(pins: DataFrame, changes: DataFrame) -> DataFrame:
    """Pins (job_id) after changes (job_id, pin): set ones are in, taken ones out."""
    kept = pins.select("job_id").join(changes.where("not pin").select("job_id"), "job_id", "left_anti")
    return kept.unionByName(changes.where("pin").select("job_id")).distinct()


def cleaned_inputs(inputs: Column) -> Column:
    """Inputs without white space around them; none at all, or a blank one, is an error when the row is read."""
    trimmed = F.transform(inputs, lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    blank = F.coalesce(F.size(trimmed) == 0, F.lit(True)) | F.exists(trimmed, lambda x: F.coalesce(x == "", F.lit(True)))
    return F.when(blank, F.raise_error(F.lit("inputs must not be blank")).cast("array<string>")).otherwise(trimmed)


def job_context(jobs: DataFrame) -> DataFrame:
    """The seven fields of a job that a metrics payload names."""
    option = lambda c: F.col("options")[c].alias(c)
    return jobs.select("id", "status", "created_at", "updated_at", option("max_provider_calls"), option("budget_autoscale"), F.coalesce(F.col("options.provider_order"), F.array().cast("array<string>")).alias("provider_order"))


def locations(settings: DataFrame, *keys: str) -> DataFrame:
    """Name and place of each folder of a store, for each row of settings, with the row's ``keys``."""
    names = {"cache": "cache_dir", "data": "data_dir", "config": "config_dir", "database": "db_path", "temporary_recordings": "temporary_dir"}
    pairs = F.array(*(F.struct(F.lit(k).alias("name"), F.col(c).cast("string").alias("location")) for k, c in names.items()))
    return settings.select(*keys, F.inline(pairs))


def metrics_payload(rows: DataFrame, job: DataFrame, summary_only: bool = False, **filters: object) -> DataFrame:
    """One row for a job's ledger: its context, filters (null where none is set), totals, and the rows unless only the summary is asked for."""
    wanted = {k: v for k, v in filters.items() if v not in (None, [], ())}
    found = ledger.faceted(rows, **wanted) if wanted else rows
    shown = {k: ",".join(v) if isinstance(v, (list, tuple)) else str(v) for k, v in wanted.items()}
    given = F.create_map(*(F.lit(x) for pair in sorted(shown.items()) for x in pair)) if wanted else F.lit(None).cast("map<string,string>")
    body = job_context(job).select(F.struct("*").alias("job")).crossJoin(ledger.totals(found).select(F.struct("*").alias("summary"))).withColumn("filters", given)
    if summary_only:
        return body
    # The rows of one job; they are its payload, so they are one value.
    listed = found.agg(F.array_sort(F.collect_list(F.struct("id", *(c for c in found.columns if c != "id")))).alias("metrics"))
    return body.crossJoin(listed)


def metrics_pieces(rows: DataFrame, job: DataFrame, **filters: object) -> DataFrame:
    """The payload of ``metrics_payload`` as pieces of a JSON text: section, id and text, in this order; a job of any number of rows."""
    head = metrics_payload(rows, job, summary_only=True, **filters)
    wanted = {k: v for k, v in filters.items() if v not in (None, [], ())}
    found = ledger.faceted(rows, **wanted) if wanted else rows
    body = F.to_json(F.struct("id", *(c for c in found.columns if c != "id")))
    least = found.agg(F.min("id").alias("_least"))
    lines = found.crossJoin(F.broadcast(least)).select(F.lit(1).alias("section"), F.col("id").cast("long").alias("id"), F.concat(F.when(F.col("id") == F.col("_least"), "").otherwise(","), body).alias("text"))
    begin = F.regexp_replace(F.to_json(F.struct("job", "summary", "filters")), r"\}$", ',"metrics":[')
    first = head.select(F.lit(0).alias("section"), F.lit(0).cast("long").alias("id"), begin.alias("text"))
    last = head.select(F.lit(2).alias("section"), F.lit(0).cast("long").alias("id"), F.lit("]}").alias("text"))
    return first.unionByName(lines).unionByName(last)
