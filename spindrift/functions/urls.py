"""Canonical addresses of media pages, as Columns."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from ipaddress import ip_network

from pyspark.sql import Column
from pyspark.sql import functions as F

from spindrift.functions.text import plus_encoded

# Names of tracking parameters, and hosts that stand for one.
TRACKING = (
    "fbclid", "gclid", "igsh", "mc_cid", "mc_eid", "rdt", "si", "spm", "s", "share_id", "share_app_id",
)
HOSTS = {
    "www.youtube.com": ("youtube.com", "www.youtube.com", "m.youtube.com"),
    "www.instagram.com": ("instagram.com", "www.instagram.com", "m.instagram.com"),
    "www.tiktok.com": ("tiktok.com", "www.tiktok.com", "m.tiktok.com"),
    "x.com": ("twitter.com", "www.twitter.com", "mobile.twitter.com", "x.com", "www.x.com", "mobile.x.com"),
    "open.spotify.com": ("spotify.com", "www.spotify.com", "open.spotify.com"),
    "www.deezer.com": ("deezer.com", "www.deezer.com"),
    "listen.tidal.com": ("tidal.com", "www.tidal.com", "listen.tidal.com"),
    "www.reddit.com": ("reddit.com", "www.reddit.com", "old.reddit.com", "new.reddit.com"),
    "www.pornhub.com": ("pornhub.com", "www.pornhub.com"),
    "vimeo.com": ("vimeo.com", "www.vimeo.com"),
    "soundcloud.com": ("soundcloud.com", "www.soundcloud.com", "m.soundcloud.com"),
}
MEDIA_TYPES = "mp3 wav m4a flac ogg oga opus aac aif aiff wma mp4 m4v mkv webm mov avi mpg mpeg".split()
_URL = r"^([A-Za-z][A-Za-z0-9+.-]*)://(?:[^/?#@]*@)?([^/?#:]*)(?::\d+)?([^?#]*)(?:\?([^#]*))?"


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, however often it is asked for."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.trim(url), _URL, 1))


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.trim(url), _URL, 2))


def path(url: Column) -> Column:
    return F.regexp_extract(F.trim(url), _URL, 3)


def query_items(url: Column) -> Column:
    """Decoded (key, value) pairs of the query, those without a value left out."""
    pairs = F.filter(F.split(F.coalesce(F.regexp_extract(F.trim(url), _URL, 4), F.lit("")), "&"), lambda p: F.locate("=", p).between(1, F.length(p) - 1))
    return F.transform(pairs, lambda p: F.struct(F.coalesce(F.try_url_decode(F.substring_index(p, "=", 1)), F.lit("")).alias("key"), F.coalesce(F.try_url_decode(F.substring(p, F.locate("=", p) + 1, F.length(p))), F.lit("")).alias("value")))


def is_url(url: Column) -> Column:
    return F.coalesce(scheme(url).isin("http", "https"), F.lit(False))


def is_direct_media(url: Column) -> Column:
    return is_url(url) & F.lower(F.regexp_extract(path(url), r"\.([A-Za-z0-9]+)$", 1)).isin(*MEDIA_TYPES)


def canonical_host(name: Column) -> Column:
    out = name
    for canonical, others in HOSTS.items():
        out = F.when(name.isin(*others), canonical).otherwise(out)
    return out


def without_tracking(items: Column) -> Column:
    return F.filter(items, lambda i: ~(i["key"].startswith("utm_") | i["key"].isin(*TRACKING)))


def _query(items: Column) -> Column:
    return F.array_join(F.transform(items, lambda i: F.concat(plus_encoded(i["key"]), F.lit("="), plus_encoded(i["value"]))), "&")


def _parts(p: Column) -> Column:
    return F.filter(F.split(p, "/"), lambda x: x != "")


def _from(parts: Column, n: int | None = None) -> Column:
    return F.concat(F.lit("/"), F.array_join(parts if n is None else F.slice(parts, 1, n), "/"))


def canonical(url: Column) -> Column:
    """Secure scheme, one host for each site, trimmed path, and of the query only what a site's rule keeps."""
    parts = F.struct(host(url).alias("host"), path(url).alias("path"), _parts(path(url)).alias("parts"), query_items(url).alias("items"))
    return F.when(is_url(url), once(parts, _rebuilt)).otherwise(url)


def _rebuilt(address: Column) -> Column:
    """The canonical form of an address taken apart (host, path, parts, items)."""
    h, p, parts, items = (address[c] for c in ("host", "path", "parts", "items"))
    kept = without_tracking(items)
    only = lambda *keys: F.filter(kept, lambda i: i["key"].isin(*keys))
    none = F.filter(items, lambda i: F.lit(False))
    first = F.coalesce(F.get(parts, F.lit(0)), F.lit(""))
    has = lambda n: F.size(parts) >= n
    at = lambda k: F.coalesce(F.get(parts, F.lit(k)), F.lit(""))
    on = lambda name: h.contains(name)
    video = F.coalesce(F.try_element_at(F.transform(F.filter(items, lambda i: i["key"] == "v"), lambda i: i["value"]), F.lit(-1)), F.lit(""))
    embedded = F.regexp_extract(p, "^/(?:shorts|embed|live)/([^/]+)", 1)
    watch = lambda v: F.filter(F.array(F.struct(F.lit("v").alias("key"), v.alias("value"))), lambda i: i["value"] != "")
    tube = on("youtube.") | on("youtu.be")
    short = F.trim(F.concat(F.lit(""), F.regexp_replace(p, "^/+|/+$", "")))
    # For each site: (condition, path, query).
    rules = [
        (on("youtu.be") & (short != ""), F.concat(F.lit("/"), short), none),
        (tube & (p == "/watch") & (video != ""), F.lit("/watch"), watch(video)),
        (tube & (embedded != ""), F.lit("/watch"), watch(embedded)),
        (tube & (p == "/playlist"), p, only("list", "index")),
        (tube, p, kept),
        (on("instagram.") & has(2) & first.isin("p", "reel", "reels", "tv"), _from(parts, 2), only("img_index")),
        (on("instagram."), p, kept),
        (on("tiktok.") & has(3) & first.startswith("@") & (at(1) == "video"), _from(parts, 3), none),
        (on("tiktok."), p, none),
        (h.isin(*HOSTS["x.com"]) & has(3) & (at(1) == "status"), _from(parts, 3), none),
        (h.isin(*HOSTS["x.com"]), p, none),
        (on("spotify."), F.when(first.startswith("intl-"), _from(F.slice(parts, 2, 1_000))).otherwise(_from(parts)), kept),
        (on("deezer."), F.when(has(2) & (F.length(first) == 2), _from(F.slice(parts, 2, 1_000))).otherwise(_from(parts)), kept),
        (on("tidal."), F.when(first == "browse", _from(F.slice(parts, 2, 1_000))).otherwise(_from(parts)), kept),
        (h.isin(*HOSTS["www.reddit.com"], "redd.it"), p, none),
        (on("pornhub.") & (p == "/view_video.php"), p, only("viewkey")),
        (on("pornhub.") | on("vimeo.") | on("soundcloud."), p, kept),
    ]
    # Other sites keep no query. The first rule that fits gives path and query at once.
    result = F.struct(p.alias("path"), none.alias("items"))
    for condition, new_path, new_items in reversed(rules):
        result = F.when(condition, F.struct(new_path.alias("path"), new_items.alias("items"))).otherwise(result)
    ends = once(result, lambda r: F.struct(r["path"].alias("path"), F.regexp_replace(r["path"], "/+$", "").alias("trimmed"), _query(r["items"]).alias("query")))
    return once(ends, lambda e: F.concat(F.lit("https://"), canonical_host(h), F.when(e["trimmed"] == "", F.when(F.length(e["path"]) > 1, "").otherwise("/")).otherwise(e["trimmed"]), F.when(e["query"] == "", "").otherwise(F.concat(F.lit("?"), e["query"]))))


def unwrapped(url: Column) -> Column:
    """The target of a link shim, or the address itself."""
    target = F.try_element_at(F.transform(F.filter(query_items(url), lambda i: (i["key"] == "u") & i["value"].rlike("^https?://")), lambda i: i["value"]), F.lit(1))
    return F.when(host(url) == "l.instagram.com", F.coalesce(target, url)).otherwise(url)


#: The IPv4 blocks that are no public addresses.
UNSAFE_V4 = (
    "0.0.0.0/8", "10.0.0.0/8", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24", "192.0.2.0/24", "192.168.0.0/16", "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24",
    "224.0.0.0/4", "240.0.0.0/4",
)


def unsafe_address(name: Column) -> Column:
    """Literal IPv4 and IPv6 hosts that are loopback, private, link-local, multicast, reserved, for documentation or unspecified; IPv4 ones within IPv6 too."""
    mapped = F.regexp_extract(name, r"(?i)^\[?(?:::ffff:|64:ff9b:1?:*)(\d{1,3}(?:\.\d{1,3}){3})\]?$", 1)
    plain = F.when(mapped != "", mapped).otherwise(F.regexp_replace(name, r"^\[|\]$", ""))
    octets = F.transform(F.split(plain, r"\."), lambda x: x.try_cast("long"))
    number = F.aggregate(octets, F.lit(0).cast("long"), lambda total, x: total * 256 + x)
    v4 = plain.rlike(r"^\d{1,3}(\.\d{1,3}){3}$")
    ranges = [(int(n[0]), int(n[-1])) for n in map(ip_network, UNSAFE_V4)]
    blocked = once(number, lambda n: reduce(lambda a, b: a | b, (n.between(*r) for r in ranges)))
    v6 = plain.rlike("(?i)^(::1?|100::.*|2001:(0?db8|0?0?0?[0-9a-f]?|0?0?1[0-9a-f]|0?02):.*|3fff:.*|f[cd][0-9a-f]{2}:.*|fe[89ab-f][0-9a-f]:.*|ff[0-9a-f]{2}:.*)$")
    return F.coalesce((v4 & blocked) | v6 | (plain == "localhost"), F.lit(False))


def download_url(entry: Column, source: Column, playlist_id: Column) -> Column:
    """First address of an extractor's entry, or one built from its id.

    entry: struct with webpage_url, original_url, url, id, extractor_key, extractor.
    """
    own = F.get(F.filter(F.array(entry["webpage_url"], entry["original_url"], entry["url"]), lambda u: F.coalesce(u.rlike("^https?://"), F.lit(False))), F.lit(0))
    by = F.lower(F.coalesce(F.nullif(entry["extractor_key"], F.lit("")), entry["extractor"], F.lit("")))
    music = F.coalesce(source.contains("music"), F.lit(False)) | by.contains("music")
    tube = F.concat(F.lit("https://"), F.when(music, "music.youtube.com").otherwise("www.youtube.com"), F.lit("/watch?v="), entry["id"], F.when(playlist_id.isNotNull(), F.concat(F.lit("&list="), playlist_id)).otherwise(""))
    built = F.when(entry["id"].isNotNull() & by.contains("youtube"), tube).when(entry["id"].isNotNull() & by.contains("vimeo"), F.concat(F.lit("https://vimeo.com/"), entry["id"]))
    return F.coalesce(own, built)
