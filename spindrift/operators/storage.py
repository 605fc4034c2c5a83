"""Stored files of source items: paths by kind, entries, clean-up and references to what is gone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Name prefixes of recordings made by the application; a parameter, since they carry its name.
RECORDINGS = ("recording-mic-", "recording-system-")


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def is_recording(path: Column, prefixes: tuple[str, ...] = RECORDINGS) -> Column:
    found = F.lit(False)
    for prefix in prefixes:
        found = found | file_name(path).startswith(prefix)
    return F.coalesce(found, F.lit(False))


def is_recording_source(value: Column, local_path: Column, prefixes: tuple[str, ...] = RECORDINGS) -> Column:
    return is_recording(value, prefixes) | is_recording(local_path, prefixes)


def is_inside(path: Column, folder: Column | str) -> Column:
    """Whether a path is a folder or below it; both canonical."""
    base = F.regexp_replace(folder if isinstance(folder, Column) else F.lit(folder), "/+$", "")
    return F.coalesce((path == base) | path.startswith(F.concat(base, F.lit("/"))), F.lit(False))


def item_paths(items: DataFrame, cache: str, prefixes: tuple[str, ...] = RECORDINGS) -> DataFrame:
    """Up to seven typed paths per item: job_id, source_item_id, category, label, path, folder (counts only if there).

    items: id, job_id, input_value, local_path, normalized_path.
    """
    base = cache.rstrip("/")
    work = F.concat_ws("/", F.lit(f"{base}/normalized"), "job_id", "id")
    spec = lambda category, label, path, folder: F.struct(F.lit(category).alias("category"), F.lit(label).alias("label"), path.alias("path"), F.lit(folder).alias("folder"))
    value, local = F.nullif("input_value", F.lit("")), F.nullif("local_path", F.lit(""))
    upload = lambda p: is_inside(p, f"{base}/uploads")
    # Categories and labels.
    given = F.when(upload(value), spec("upload", "Hochgeladene Datei", value, False)).when(is_recording(value, prefixes), spec("recording", "Temporäre Aufnahme", value, False))
    own = F.when(is_recording(local, prefixes), spec("recording", "Temporäre Aufnahme", local, False)).when(upload(local), spec("upload", "Hochgeladene Datei", local, False))
    specs = F.array(
        spec("download", "Quellcache", F.concat(F.lit(f"{base}/sources/"), F.col("id")), True), given, own,
        F.when(F.coalesce("normalized_path", F.lit("")) != "", spec("normalized", "Normalisierte Audiodatei", F.col("normalized_path"), False)), spec("stem", "Musikstems", F.concat(work, F.lit("/stems")), True),
        spec("excerpt", "Probe-Clips", F.concat(work, F.lit("/clips")), True), spec("excerpt", "Segment-Probes", F.concat(work, F.lit("/segment-clips")), True),
    )
    return items.select("job_id", F.col("id").alias("source_item_id"), F.inline(F.filter(specs, lambda s: s.isNotNull())))


def entries(paths: DataFrame, files: DataFrame, temporary: bool = True) -> DataFrame:
    """Stored entries of paths (job_id, source_item_id, category, label, path), sized by files (path, size_bytes).

    A folder's size is that of the files below it. Temporary paths that are not there give no entry.
    """
    parts = F.split("path", "/")
    parents = F.filter(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/")), lambda p: p != "")
    sizes = files.select(F.explode(parents).alias("_at"), "size_bytes").groupBy("_at").agg(F.sum("size_bytes").alias("_bytes"))
    # Spark takes what a row is exploded into for no more than the row and would send all sizes to the driver to broadcast them.
    rows = paths.join(sizes.hint("merge"), F.col("path") == F.col("_at"), "left")
    there = F.col("_at").isNotNull()
    rows = rows.where(there) if temporary else rows
    return rows.select(
        F.concat_ws(":", F.coalesce(F.col("job_id").cast("string"), F.lit("global")), "category", "path").alias("id"), "job_id", "source_item_id", "category", "label", "path",
        F.coalesce("_bytes", F.lit(0)).cast("long").alias("size_bytes"), there.alias("exists_flag"), F.lit(temporary).alias("temporary"),
    )


def without_references(items: DataFrame, cache: str, prefixes: tuple[str, ...] = RECORDINGS) -> DataFrame:
    """Items that point at no file a clean-up removes: normalised and instrumental paths go, local ones if temporary."""
    local = F.col("local_path")
    gone = is_recording(local, prefixes) | is_inside(local, cache)
    return items.withColumns({"local_path": F.when(~gone, local), "normalized_path": F.lit(None).cast("string"), "instrumental_path": F.lit(None).cast("string")})


def cleaned(stored: DataFrame, jobs: DataFrame, force: bool = False) -> DataFrame:
    """What a clean-up of temporary entries does with each: kept, where its job is pinned (unless forced) or it isn't temporary, else deleted.

    Entries of no known job are orphans and deleted.
    """
    known = jobs.select(F.col("id").alias("_job"), F.col("pinned").alias("_pinned"))
    rows = stored.join(known, F.col("job_id") == F.col("_job"), "left")
    kept = ~F.col("temporary") | (F.coalesce("_pinned", F.lit(False)) & F.lit(not force))
    return rows.withColumn("action", F.when(kept, "kept").when(F.col("_job").isNull(), "orphan").otherwise("deleted")).drop("_job", "_pinned")


def files_below(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """path and size_bytes of the files below a folder whose names match; contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    return found.select("path", F.col("length").alias("size_bytes"))
