"""Inputs of jobs resolved to source items: local files, direct media, and what an extractor says about other addresses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.functions import urls as U
from spindrift.sources.folders import shared_folder, written
from spindrift.sources.readers import extractor_items, flattened, input_kind

ITEM = ("id", "job_id", "place", "entry_index", "value", "kind", "status", "error", "title", "artist", "album", "duration_ms", "webpage_url", "download_url", "local_path")


def existing(paths: DataFrame, files: DataFrame) -> DataFrame:
    """Rows (path, ...) with there and is_file. files: path of each file there is; what a file lies below is a folder."""
    known = files.select(F.col("path").alias("_file")).distinct()
    parts = F.split("_file", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    folders = known.select(F.explode(above).alias("_file")).where("_file != ''").distinct()
    kinds = known.withColumn("_is_file", F.lit(True)).unionByName(folders.withColumn("_is_file", F.lit(False)))
    kinds = kinds.groupBy("_file").agg(F.max("_is_file").alias("_is_file"))
    rows = paths.join(kinds, F.col("path") == F.col("_file"), "left")
    return rows.withColumns({"there": F.col("_file").isNotNull(), "is_file": F.coalesce("_is_file", F.lit(False))}).drop("_file", "_is_file")


def last_name(path: Column) -> Column:
    return F.substring_index(F.regexp_replace(path, "/+$", ""), "/", -1)


def resolved(inputs: DataFrame, files: DataFrame, answers: DataFrame) -> DataFrame:
    """Source items (``ITEM``) of inputs (job_id, place, value), in order of job, place and entry.

    A local input is one item, or a failed one where there is no such file; an address of media is one item under its canonical form; other
    addresses have the items of their extractor's answer (url, canonical; body), a playlist's leaves each. An address of a host that must not be asked, and
    one without an answer, is a failed item. Ids follow from job, place and entry, so that a repeated run gives the same ones.
    """
    trimmed = F.regexp_replace(F.coalesce("value", F.lit("")), r"^\s+|\s+$", "")
    # Addresses are parsed and judged once; what follows asks for them many times.
    rows = inputs.select("job_id", "place", "value", trimmed.alias("_text")).withColumn("kind", input_kind(F.col("_text"))).withColumn("_url", U.canonical(F.col("_text")))
    rows = rows.withColumns({"kind": F.when((F.col("kind") == "yt_dlp") & U.is_direct_media(F.col("_url")), "direct_http").otherwise(F.col("kind")), "_host": U.host(F.col("_url"))})
    rows = rows.withColumn("_blocked", (F.col("kind") != "local_file") & U.unsafe_address(F.col("_host")))
    rows = written(rows, f"{shared_folder(inputs.sparkSession)}/inputs")
    none = lambda kind="string": F.lit(None).cast(kind)

    def item(frame: DataFrame, **values: Column) -> DataFrame:
        given = {"entry_index": none("int"), "error": none(), "title": none(), "artist": none(), "album": none(), "duration_ms": none("long"), "webpage_url": none(), "download_url": none(), "local_path": none()} | values
        found = frame.withColumns(given).withColumn("status", F.when(F.col("error").isNull(), "queued").otherwise("failed"))
        return found.withColumn("id", F.sha1(F.concat_ws(":", "job_id", "place", F.coalesce("entry_index", F.lit(0))))).select(*ITEM)

    local = existing(rows.where("kind = 'local_file'").withColumn("path", F.col("_text")), files)
    fault = F.when(~F.col("there"), F.concat(F.lit("Input file does not exist: "), "path")).when(~F.col("is_file"), F.concat(F.lit("Input path is not a file: "), "path"))
    found = item(local, error=fault, title=last_name(F.col("path")), local_path=F.when(fault.isNull(), F.col("path")))

    asked, blocked = rows.where("kind != 'local_file'"), F.col("_blocked")
    found = found.unionByName(item(asked.where(blocked), error=F.concat(F.lit("Address not allowed: "), "_host")))
    name = F.coalesce(F.nullif(last_name(U.path(F.col("_url"))), F.lit("")), F.sha1("_url"))
    direct = asked.where(~blocked & (F.col("kind") == "direct_http"))
    found = found.unionByName(item(direct, title=name, webpage_url=F.col("_url"), download_url=F.col("_url")))

    others = asked.where(~blocked & (F.col("kind") == "yt_dlp")).join(answers.select(F.col("url").alias("_url"), "body"), "_url", "left")
    found = found.unionByName(item(others.where("body is null"), error=F.concat(F.lit("No answer for "), "_url")))
    keyed = others.where("body is not null").select(F.struct("job_id", "place", "value", "kind", "_url").alias("id"), "body")
    entries = extractor_items(flattened(keyed), F.col("id._url"))
    entry = entries.select("id.*", "title", "artist", "album", "duration_ms", "webpage_url", "download_url", "entry_index")
    own = {c: F.col(c) for c in ("title", "artist", "album", "duration_ms", "webpage_url", "download_url")}
    return found.unionByName(item(entry, entry_index=F.col("entry_index").cast("int"), **own))
