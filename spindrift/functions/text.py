"""Text of times, sizes, names and links, as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: a time of day in running text, hours optional.
STAMP = r"(?<!\d)(?:(\d{1,2}):)?([0-5]?\d):([0-5]\d)(?!\d)"


def stamp(ms: Column) -> Column:
    """mm:ss, with hours only where there are any."""
    s = F.floor(ms / 1000)
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    hours = F.floor(s / 3600)
    hh = F.when(hours < 100, two(hours)).otherwise(hours.cast("string"))
    rest = F.concat(two(F.floor(s % 3600 / 60)), F.lit(":"), two(s % 60))
    return F.when(hours > 0, F.concat(hh, F.lit(":"), rest)).otherwise(rest)


def human_bytes(size: Column) -> Column:
    """B, KB, MB or GB, one decimal but for bytes."""
    unit = lambda power, name: F.concat(F.format_string("%.1f", size / 1024**power), F.lit(f" {name}"))
    return F.when(size < 1024, F.concat(size.cast("long").cast("string"), F.lit(" B"))).when(size < 1024**2, unit(1, "KB")).when(size < 1024**3, unit(2, "MB")).otherwise(unit(3, "GB"))


def line_stamps(text: Column) -> Column:
    """Milliseconds of the first stamp of each line, in order."""
    lines = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"\r\n|\r|\n"), lambda x: F.trim(x)), lambda x: x.rlike(STAMP))
    part = lambda line, k: F.coalesce(F.nullif(F.regexp_extract(line, STAMP, k), F.lit("")).cast("long"), F.lit(0).cast("long"))
    return F.transform(lines, lambda x: (part(x, 1) * 3600 + part(x, 2) * 60 + part(x, 3)) * 1000)


def seconds_to_ms(seconds: Column) -> Column:
    return (seconds.cast("double") * 1000).cast("long")


def display_name(artist: Column, title: Column) -> Column:
    blank = lambda c: F.nullif(c, F.lit(""))
    return F.concat(F.coalesce(blank(artist), F.lit("Unknown artist")), F.lit(" - "), F.coalesce(blank(title), F.lit("Unknown title")))


def segment_key(item: Column, start: Column, end: Column, title: Column) -> Column:
    return F.concat_ws(":", item, start, end, F.coalesce(title, F.lit("")))


def plus_encoded(text: Column) -> Column:
    """Form encoding: letters, digits and _.-~ stay, a space is a plus."""
    return F.replace(F.replace(F.url_encode(text), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def percent_encoded(text: Column) -> Column:
    """Path encoding: like the form's, but a space is %20 and slashes stay."""
    return F.replace(F.replace(plus_encoded(text), F.lit("+"), F.lit("%20")), F.lit("%2F"), F.lit("/"))


def search_links(title: Column, artist: Column) -> Column:
    """Map of search addresses by service, empty for no title and artist."""
    query = F.trim(F.concat_ws(" ", F.nullif(artist, F.lit("")), F.nullif(title, F.lit(""))))
    path, form = percent_encoded(query), plus_encoded(query)
    links = F.create_map(
        F.lit("spotify"), F.concat(F.lit("https://open.spotify.com/search/"), path), F.lit("youtube_music"), F.concat(F.lit("https://music.youtube.com/search?q="), form),
        F.lit("deezer"), F.concat(F.lit("https://www.deezer.com/search/"), path), F.lit("apple_music"), F.concat(F.lit("https://music.apple.com/us/search?term="), form),
    )
    return F.when(query == "", F.create_map().cast("map<string,string>")).otherwise(links)


def extract_between(text: Column, start: str, end: str) -> Column:
    """What follows the first ``start``, up to ``end`` or to the end; null where there is no ``start``."""
    tail = F.substring(text, F.locate(start, text) + len(start), F.length(text))
    return F.when(F.locate(start, text) > 0, F.when(F.locate(end, tail) > 0, F.substring_index(tail, end, 1)).otherwise(tail))


def normalized_link(uri: Column, fallback: Column) -> Column:
    """Addresses of search schemes as plain ones; others as they are if secure, else the fallback."""
    spotify = F.concat(F.lit("https://open.spotify.com/search/"), percent_encoded(F.url_decode(F.replace(F.substring_index(uri, "spotify:search:", -1), F.lit("+"), F.lit("%2B")))))
    unquoted = lambda c: F.url_decode(F.replace(F.coalesce(c, F.lit("")), F.lit("+"), F.lit("%2B")))
    deezer = search_links(unquoted(extract_between(uri, "track%3A%27", "%27")), unquoted(extract_between(uri, "artist%3A%27", "%27")))["deezer"]
    return F.when(uri.startswith("https://"), uri).when(uri.startswith("spotify:search:"), spotify).when(uri.startswith("deezer-query://"), F.coalesce(deezer, fallback)).otherwise(fallback)


def metadata_hints(chapters: Column, description: Column, start_ms: Column, end_ms: Column) -> Column:
    """At most six hints for a span: chapters that overlap it, then addresses and timed lines of the description.

    chapters: array of (start_time, end_time, title), times in seconds.
    """
    empty = F.array().cast("array<string>")
    inside = F.filter(chapters, lambda c: (seconds_to_ms(F.coalesce(c["start_time"], F.lit(0.0))) <= end_ms) & (c["end_time"].isNull() | (seconds_to_ms(c["end_time"]) >= start_ms)))
    named = F.transform(inside, lambda c: F.concat(F.lit("chapter:"), F.coalesce(F.nullif(c["title"], F.lit("")), F.lit("chapter"))))
    lines = F.filter(F.transform(F.split(F.coalesce(description, F.lit("")), r"\r\n|\r|\n"), lambda x: F.trim(x)), lambda x: x != "")

    def hint(line: Column) -> Column:
        first = F.get(line_stamps(line), F.lit(0))
        timed = line.rlike("[:•-]") & (F.length(line) <= 120) & first.between(start_ms, end_ms + 30_000)
        return F.when(line.rlike(r"https?://\S+"), F.concat(F.lit("url:"), line)).when(timed, F.concat(F.lit("tracklist:"), line))

    return F.slice(F.concat(F.coalesce(named, empty), F.filter(F.transform(lines, hint), lambda h: h.isNotNull())), 1, 6)


def upload_name(name: Column) -> Column:
    """A file name without folders and odd characters."""
    base = F.substring_index(F.replace(F.coalesce(name, F.lit("")), F.lit("\\"), F.lit("/")), "/", -1)
    return F.coalesce(F.nullif(F.regexp_replace(base, r"[^A-Za-z0-9._-]+", "_"), F.lit("")), F.lit("upload"))


def explanation(gate: Column, providers: Column, best: Column) -> Column:
    """Why a segment was accepted."""
    agreed = F.concat(F.lit("Agreed by "), F.array_join(F.sort_array(F.array_distinct(providers)), ", "), F.lit("."))
    scored = F.concat(F.lit("Best score "), F.format_string("%.2f", best), F.lit("."))
    return F.filter(F.array(F.when(F.size(providers) > 1, agreed), F.when(gate.isNotNull(), F.concat(F.lit("Accepted by gate "), gate, F.lit("."))), scored), lambda x: x.isNotNull())


def canonical_json(members: Column) -> Column:
    """A map as JSON with sorted keys and no spaces."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(members))))
