"""Exports of timelines: CSV columns, chapter lines, JSON of a job."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spindrift.functions.text import stamp

FORMATS = ("json", "csv", "chapters")


def csv_rows(segments: DataFrame) -> DataFrame:
    """The thirteen CSV columns: nulls empty, lists joined, confidences with four decimals."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    four = lambda c: F.coalesce(F.format_string("%.4f", F.col(c)), F.lit(""))
    joined = lambda c, by: F.coalesce(F.array_join(c, by), F.lit(""))
    return segments.select(
        "source_item_id", "start_ms", "end_ms", "kind", four("confidence").alias("confidence"), F.when(F.col("uncertainty").isNull(), "").otherwise(four("uncertainty")).alias("uncertainty"), *(text(c).alias(c) for c in ("title", "artist", "album")),
        joined("providers", ", ").alias("providers"), text("repeat_group_id").alias("repeat_group_id"), joined("metadata_hints", " | ").alias("metadata_hints"), joined("explanation", " | ").alias("explanation"),
    )


def chapter_title(kind: Column, artist: Column, title: Column) -> Column:
    named = F.when(F.coalesce(artist, F.lit("")) != "", F.concat(artist, F.lit(" - "), title)).otherwise(title)
    return F.when(title.isNotNull(), named).when(kind == "music_unresolved", "[Unresolved music]").when(kind == "speech_only", "[Speech only]").otherwise("[Silence / FX]")


def chapters(segments: DataFrame) -> DataFrame:
    """One text of chapter lines per item."""
    line = F.concat(stamp(F.col("start_ms")), F.lit(" "), chapter_title(F.col("kind"), F.col("artist"), F.col("title")))
    ordered = F.array_sort(F.collect_list(F.struct("start_ms", "seq", line.alias("line"))))
    return segments.groupBy("item").agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("chapters"))


def job_json(jobs: DataFrame, items: DataFrame, segments: DataFrame) -> DataFrame:
    """One JSON text per job with its items and segments."""
    listed = lambda df, name: df.groupBy("job_id").agg(F.array_sort(F.collect_list(F.struct("seq", F.struct(*(c for c in df.columns if c != "job_id")).alias("row")))).alias(name))
    rows = jobs.join(listed(items, "items").withColumnRenamed("job_id", "_i"), F.col("id") == F.col("_i"), "left")
    rows = rows.join(listed(segments, "segments").withColumnRenamed("job_id", "_s"), F.col("id") == F.col("_s"), "left")
    own = F.struct(*jobs.columns)
    body = F.to_json(F.struct(own.alias("job"), F.transform("items", lambda x: x["row"]).alias("items"), F.transform("segments", lambda x: x["row"]).alias("segments")))
    return rows.select("id", body.alias("body"))


def job_pieces(jobs: DataFrame, items: DataFrame, segments: DataFrame) -> DataFrame:
    """The JSON text of ``job_json`` as pieces: job_id, section, seq and text, dealt out by job and sorted in this order. No job's rows are put into one value.

    ``sources.pieces.write_files`` makes a file of each job and ``write_lines`` a line; a job without items or segments has empty arrays.
    Items and segments of jobs there are not are left out: a job's own piece is its first, so it is seen before them. All rows are dealt out once.
    """
    def listed(rows: DataFrame, section: int) -> DataFrame:
        return rows.select("job_id", F.lit(section).alias("section"), F.col("seq").cast("long").alias("_at"), F.to_json(F.struct(*(c for c in rows.columns if c != "job_id"))).alias("text"))

    mark = lambda section, text: jobs.select(F.col("id").alias("job_id"), F.lit(section).alias("section"), F.lit(0).cast("long").alias("_at"), text.alias("text"))
    head = mark(0, F.concat(F.lit('{"job":'), F.to_json(F.struct(*jobs.columns)), F.lit(',"items":[')))
    parts = [head, listed(items, 1), mark(2, F.lit('],"segments":[')), listed(segments, 3), mark(4, F.lit("]}"))]
    rows = reduce(DataFrame.unionByName, parts).repartition("job_id").sortWithinPartitions("job_id", "section", "_at", "text")
    own = Window.partitionBy("job_id").orderBy("section", "_at", "text").rowsBetween(Window.unboundedPreceding, 0)
    place = F.row_number().over(Window.partitionBy("job_id", "section").orderBy("_at", "text"))
    known = rows.withColumns({"_known": F.min("section").over(own), "_place": place}).where("_known = 0")
    inner = F.col("section").isin(1, 3)
    return known.select("job_id", "section", F.when(inner, F.col("_place")).otherwise(0).cast("long").alias("seq"), F.when(inner & (F.col("_place") > 1), F.concat(F.lit(","), "text")).otherwise(F.col("text")).alias("text"))


def export(segments: DataFrame, fmt: str) -> DataFrame:
    """Segments in a format; an unknown one is an error."""
    fmt = fmt.lower()
    if fmt not in FORMATS:
        raise ValueError(f"Unsupported export format: {fmt}")
    return {"csv": csv_rows, "chapters": chapters, "json": lambda s: s.select("item", F.to_json(F.struct(*s.columns)).alias("body"))}[fmt](segments)
