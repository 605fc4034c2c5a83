"""From drafts and candidates to segments: what to probe, accepted and open segments, repeats, retries, metadata-only and failed items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spindrift.functions.text import search_links
from spindrift.functions.urls import is_url

#: Confidence of a match that rests on metadata, and the length it gets where none is known.
METADATA_CONFIDENCE, METADATA_MS = 0.52, 30_000
STRONG_FREE = ("local_catalog", "vibra")


def skips_probing(kind: Column, music_ratio: Column) -> Column:
    """Silence is not probed, nor speech with next to no music."""
    return (kind == "silence_or_fx") | ((kind == "speech_only") & (music_ratio < 0.15))


def open_kind(speech_ratio: Column, music_ratio: Column) -> Column:
    return F.when((speech_ratio >= 0.70) & (music_ratio < 0.35), "speech_only").otherwise("music_unresolved")


def strong_free_hit(hits: Column, least: float = 0.80) -> Column:
    """Whether an array of (provider, confidence) holds a strong hit of a free recognizer."""
    return F.coalesce(F.exists(hits, lambda h: h["provider"].isin(*STRONG_FREE) & (h["confidence"] >= least)), F.lit(False))


def accepted(rows: DataFrame, least: float = 0.60, retried: bool = False) -> DataFrame:
    """Drafts joined with their best candidate as segments.

    rows: draft columns with speech_ratio and music_ratio; key, provider, confidence, score, n_evidence (null for none),
    gate (null: rejected) and reused. A reused match gains 0.03, up to 0.95, and counts as gate REUSED where it has
    none; on a retry a rejected candidate is accepted from a score of ``least``.
    """
    reused = F.coalesce(F.col("reused"), F.lit(False))
    taken = F.col("key").isNotNull() & (F.col("gate").isNotNull() | reused | (F.lit(retried) & (F.col("score") >= least)))
    yes = lambda a, b: F.when(taken, a).otherwise(b)
    raised = F.when(reused, F.least(F.lit(0.95), F.col("confidence") + 0.03)).otherwise(F.col("confidence"))
    rows = rows.withColumn("_taken", taken)
    return rows.select(
        *(c for c in rows.columns if c not in ("key", "provider", "confidence", "score", "n_evidence", "gate", "reused", "speech_ratio", "music_ratio", "_taken")),
        yes(F.lit("matched_track"), open_kind(F.col("speech_ratio"), F.col("music_ratio"))).alias("kind"), yes(F.col("key"), F.lit(None)).alias("key"), yes(F.col("provider"), F.lit(None)).alias("provider"),
        yes(raised, F.lit(0.0)).alias("confidence"), yes(F.greatest(F.lit(0.0), 1 - F.col("score")), F.lit(1.0)).alias("uncertainty"), yes(F.greatest(F.lit(1), F.col("n_evidence")), F.lit(0)).cast("long").alias("evidence_count"),
        yes(F.coalesce(F.nullif("gate", F.lit("")), F.when(reused, "REUSED")), F.lit(None)).alias("acceptance_gate"),
    )


def with_group_match(drafts: DataFrame) -> DataFrame:
    """Add first_key, the first match of a draft's repeat group, and reused, whether it comes from an earlier draft.

    drafts: item, seq, repeat_group, key.
    """
    w = Window.partitionBy("item", "repeat_group").orderBy("seq")
    earlier = F.first("key", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    known = F.when(F.col("repeat_group").isNotNull(), earlier)
    return drafts.withColumns({"first_key": F.coalesce(known, F.col("key")), "reused": known.isNotNull()})


def without_seen_frames(frames: DataFrame) -> DataFrame:
    """Frames of overlapping chunks, each start once: that of the first chunk. frames: item, chunk, start_ms."""
    first = F.row_number().over(Window.partitionBy("item", "start_ms").orderBy("chunk"))
    return frames.withColumn("_n", first).where("_n = 1").drop("_n")


def retry_did_work(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """Keys with did_work: more probes or attempts than before, or another kind or track."""
    new = after.select(*keys, *(F.col(c).alias(f"_{c}") for c in ("probe_count", "provider_attempts", "kind", "key")))
    rows = before.join(new, keys)
    worked = (F.col("_probe_count") > F.col("probe_count")) | (F.col("_provider_attempts") > F.col("provider_attempts")) | ~F.col("_kind").eqNullSafe(F.col("kind")) | ~F.col("_key").eqNullSafe(F.col("key"))
    return rows.select(*keys, worked.alias("did_work"))


def metadata_segments(items: DataFrame) -> DataFrame:
    """Segments of items known by metadata alone: marked so, with a title, and an artist or a playlist.

    items: id, metadata_only, title, artist, album, duration_ms, playlist_id, playlist_title.
    """
    text = lambda c: F.nullif(F.trim(F.coalesce(c, F.lit(""))), F.lit(""))
    title, artist = text("title"), text("artist")
    rows = items.where(F.coalesce("metadata_only", F.lit(False)) & title.isNotNull() & (artist.isNotNull() | (F.coalesce("playlist_id", F.lit("")) != "")))
    length = F.when(F.coalesce("duration_ms", F.lit(0)) == 0, METADATA_MS).otherwise(F.col("duration_ms")).cast("long")
    hints = F.when(F.coalesce("playlist_title", F.lit("")) != "", F.array("playlist_title")).otherwise(F.array().cast("array<string>"))
    return rows.select(
        F.col("id").alias("source_item_id"), F.lit(0).cast("long").alias("start_ms"), length.alias("end_ms"), F.lit("matched_track").alias("kind"), F.lit(METADATA_CONFIDENCE).alias("confidence"), F.lit(1).alias("evidence_count"),
        title.alias("title"), artist.alias("artist"), text("album").alias("album"), hints.alias("metadata_hints"), search_links(title, artist).alias("external_links"),
    )


def failed_items(inputs: DataFrame) -> DataFrame:
    """Items of inputs that could not be resolved (id, job_id, input_value, error): kind, status and a title."""
    value = F.col("input_value")
    title = F.when(is_url(value), value).otherwise(F.coalesce(F.nullif(F.substring_index(value, "/", -1), F.lit("")), value))
    return inputs.select("id", "job_id", "input_value", F.when(is_url(value), "yt_dlp").otherwise("local_file").alias("kind"), F.lit("failed").alias("status"), title.alias("title"), "error")


def progress_marks(done: DataFrame, every: int = 12) -> DataFrame:
    """Progress events: of the segments done (item, seq) in order, every twelfth with counts so far and in all."""
    w = Window.partitionBy("item")
    rows = done.withColumns({"done": F.row_number().over(w.orderBy("seq")), "total": F.count("*").over(w)})
    return rows.where(F.col("done") % every == 0)


def kind_label(kind: Column) -> Column:
    return F.when(kind == "matched_track", "Song").when(kind == "music_unresolved", "Music").when(kind == "speech_only", "Speech").when(kind == "silence_or_fx", "Silence/FX").otherwise(F.replace(kind, F.lit("_"), F.lit(" ")))


def quality_band(confidence: Column) -> Column:
    return F.when(confidence >= 0.85, "High").when(confidence >= 0.65, "Good").when(confidence >= 0.01, "Low")


def job_context(jobs: DataFrame) -> DataFrame:
    """Counts of active and ended jobs by status."""
    return jobs.agg(F.count("*").alias("jobs"), F.count_if(F.col("status").isin("queued", "running")).alias("active"), F.count_if(F.col("status") == "running").alias("running"))


def by_item(segments: DataFrame, *order: str) -> DataFrame:
    """Segments by item: item, place (from 1) and the segment's columns, in order; rows and not lists, so that an item may be of any length."""
    place = F.row_number().over(Window.partitionBy("item").orderBy(*(order or ("start_ms", "end_ms"))))
    return segments.withColumn("place", place).select("item", "place", *(c for c in segments.columns if c != "item"))
