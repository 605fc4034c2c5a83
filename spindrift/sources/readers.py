"""Readers: recognizer answers, extractor entries, manifests, fingerprints, catalog folders, ledgers of JSON."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.functions.urls import download_url, is_direct_media, is_url

AUDD = "status string, result struct<artist string, title string, album string, song_link string, spotify struct<external_ids struct<isrc string>, external_urls struct<spotify string>>, apple_music struct<url string>>"
ACRCLOUD = "metadata struct<score double, music array<struct<title string, acrid string, artists array<struct<name string>>, album struct<name string>, external_ids struct<isrc string>>>>"
VIBRA = "track struct<title string, subtitle string, key string, share struct<href string>, sections array<struct<metadata array<struct<text string>>>>>"
ENTRY = "id string, title string, track string, extractor_key string, extractor string, webpage_url string, original_url string, url string, channel string, uploader string, artist string, album string, duration double, description string, chapters array<struct<start_time double, end_time double, title string>>"
MEDIA_FILES = "*.{mp3,wav,m4a,flac,ogg,mp4,mkv}"


def _blank(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def _candidate(title: Column, artist: Column, album: Column, isrc: Column, provider: str, own_id: Column, id_name: str, confidence: Column) -> list[Column]:
    ids = F.map_filter(F.create_map(F.lit(id_name), F.coalesce(own_id, F.lit(""))), lambda k, v: v != "")
    return [title.alias("title"), artist.alias("artist"), album.alias("album"), isrc.alias("isrc"), ids.alias("provider_ids"), F.lit(provider).alias("provider"), confidence.cast("double").alias("confidence")]


def audd(answers: DataFrame, column: str = "body") -> DataFrame:
    """Candidates of audd answers; one without a title is none."""
    r = F.col("_r.result")
    rows = answers.withColumn("_r", F.from_json(column, AUDD)).where(_blank(r["title"]).isNotNull())
    return rows.select(*(c for c in answers.columns if c != column), *_candidate(r["title"], r["artist"], r["album"], r["spotify"]["external_ids"]["isrc"], "audd", r["song_link"], "audd", F.lit(0.83)))


def acrcloud(answers: DataFrame, column: str = "body") -> DataFrame:
    """Candidates of acrcloud answers: the first music hit, its confidence from the answer's score."""
    top = F.get(F.col("_r.metadata.music"), F.lit(0))
    rows = answers.withColumn("_r", F.from_json(column, ACRCLOUD)).where(_blank(top["title"]).isNotNull())
    artists = _blank(F.array_join(F.filter(F.transform(top["artists"], lambda a: a["name"]), lambda n: _blank(n).isNotNull()), ", "))
    confidence = F.greatest(F.lit(0.5), F.least(F.lit(0.95), F.coalesce(F.col("_r.metadata.score"), F.lit(80.0)) / 100))
    return rows.select(*(c for c in answers.columns if c != column), *_candidate(top["title"], artists, top["album"]["name"], top["external_ids"]["isrc"], "acrcloud", top["acrid"], "acrcloud", confidence))


def vibra(answers: DataFrame, column: str = "body") -> DataFrame:
    """Candidates of vibra answers."""
    t = F.col("_r.track")
    album = F.get(F.filter(F.flatten(F.transform(t["sections"], lambda s: F.transform(s["metadata"], lambda m: m["text"]))), lambda x: _blank(x).isNotNull()), F.lit(0))
    rows = answers.withColumn("_r", F.from_json(column, VIBRA)).where(t.isNotNull())
    return rows.select(*(c for c in answers.columns if c != column), *_candidate(F.coalesce(_blank(t["title"]), F.lit("Unknown track")), t["subtitle"], album, F.lit(None).cast("string"), "vibra", t["key"], "shazam", F.lit(0.72)))


def leaves(body: str | None, children: str) -> Iterator[tuple[str | None, list[int]]]:
    """Leaves of a nested playlist in order, each with its places on the way down; nulls are dropped.

    A body that is no JSON, or is nested deeper than the parser goes (some thousand levels), is a leaf by itself.
    """
    if body is None:
        return
    try:
        top = json.loads(body)
    except (ValueError, RecursionError):
        yield body, []
        return
    stack: list[tuple[object, list[int]]] = [(top, [])]
    while stack:
        entry, path = stack.pop()
        if entry is None:
            continue
        inner = entry.get(children) if isinstance(entry, dict) else None
        if isinstance(inner, list) and inner:
            stack.extend((x, [*path, k]) for k, x in reversed(list(enumerate(inner))))
        else:
            yield body if entry is top else entry if isinstance(entry, str) else json.dumps(entry, separators=(",", ":"), ensure_ascii=False), path


def flattened(entries: DataFrame, children: str = "entries") -> DataFrame:
    """Leaves of nested playlists in order: id, entry (JSON) and path (places on the way); nulls are dropped.

    entries: id, body (JSON object with, perhaps, an array of objects named ``children``). Playlists of any depth are opened in one pass over their parsed trees.
    """
    rows = entries.select("id", F.col("body").cast("string").alias("body"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):  # playlists at a time
                part = batch.slice(at, 256)
                found = [(k, *leaf) for k, body in enumerate(part.column("body").to_pylist()) for leaf in leaves(body, children)]
                ids = part.column("id").take(pa.array([k for k, _, _ in found], pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, pa.array([e for _, e, _ in found], pa.string()), pa.array([p for _, _, p in found], pa.list_(pa.int32()))], ["id", "entry", "path"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, entry string, path array<int>")


def extractor_items(entries: DataFrame, source_url: Column, playlist_id: Column | None = None) -> DataFrame:
    """Source items of extractor entries (id, entry as JSON, path)."""
    rows = entries.withColumn("e", F.from_json("entry", ENTRY)).withColumn("entry_index", F.get(F.col("path"), F.lit(0)) + 1)
    e, playlist = F.col("e"), F.lit(None).cast("string") if playlist_id is None else playlist_id
    link = download_url(e, source_url, playlist)
    return rows.select(
        "id", "entry_index", F.coalesce(_blank(e["track"]), e["title"]).alias("title"), F.coalesce(_blank(e["extractor_key"]), e["extractor"]).alias("extractor"), F.coalesce(_blank(e["webpage_url"]), source_url).alias("webpage_url"),
        F.coalesce(_blank(e["artist"]), _blank(e["uploader"]), e["channel"]).alias("artist"), e["album"].alias("album"), F.when(e["duration"] > 0, (e["duration"] * 1000).cast("long")).alias("duration_ms"),
        e["chapters"].alias("chapters"), e["description"].alias("description"), link.alias("download_url"), (_blank(e["title"]).isNotNull() & link.isNull()).alias("metadata_only"),
    )


def input_kind(value: Column) -> Column:
    """local_file, direct_http or yt_dlp."""
    return F.when(~is_url(value), "local_file").when(is_direct_media(value), "direct_http").otherwise("yt_dlp")


def filename_track(path: Column) -> Column:
    """(artist, title) of a file's name, parted once at `` - ``; the artist is null where there is no such part."""
    stem = F.regexp_replace(F.substring_index(path, "/", -1), r"(?<=.)\.[^.]*$", "")
    parts = F.split(stem, " - ", 2)
    return F.struct(F.when(F.size(parts) == 2, F.get(parts, F.lit(0))).alias("artist"), F.get(parts, F.size(parts) - 1).alias("title"))


def catalog_files(spark: SparkSession, folder: str) -> DataFrame:
    """Media files below a folder: path, size_bytes, artist, title. Contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", MEDIA_FILES).load(folder)
    return files.select("path", F.col("length").alias("size_bytes"), F.sha1("path").alias("track_id"), filename_track(F.col("path")).alias("_t")).select("path", "size_bytes", "track_id", "_t.*")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """Cases of an evaluation manifest: a list, or an object with ``cases``."""
    case = "struct<id:string,input_value:string,expected_tracks:array<string>>"
    text = spark.read.text(path, wholetext=True)
    body = F.coalesce(F.get_json_object("value", "$.cases"), F.col("value"))
    return text.select(F.explode(F.from_json(body, f"array<{case}>")).alias("c")).select("c.*")


def fingerprint_lines(spark: SparkSession, path: str) -> DataFrame:
    """Fingerprint chunks of JSON lines; faulty lines and empty fingerprints are skipped."""
    rows = spark.read.schema("timestamp double, duration double, fingerprint array<int>").option("mode", "PERMISSIVE").json(path)
    return rows.where("size(fingerprint) > 0").select((F.col("timestamp") * 1000).cast("long").alias("timestamp_ms"), (F.col("duration") * 1000).cast("long").alias("duration_ms"), "fingerprint")


def events_after(events: DataFrame, job_id: object, cursor: int = 0) -> DataFrame:
    """Events of a job after a cursor, in order."""
    return events.where((F.col("job_id") == job_id) & (F.col("id") > cursor)).orderBy("id")
