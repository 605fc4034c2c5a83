"""URL filters by a temporal list join.

Lists change by dated entries (list, pattern, action, at): ``block`` and ``allow`` list a pattern, ``remove`` takes it off.
Entries become validity intervals [since, until), and from these every pattern gets a timeline: at each change the entry
that decides among the lists active then, or none. Each capture is judged by an as-of join on every pattern that covers its address: its
host, the domains above it, and each of them with path prefixes as deep as any list entry goes. Captures and timelines
are sorted together by pattern and time, and a capture takes the last change before it or at its time. The most specific pattern
decides; then the latest entry, then the list's name, allow before block.

Captures are reduced to distinct (host, path prefix, time) first, so that the join moves no addresses, and to patterns that
are listed at all. A pattern that very many captures fall under, such as a top domain, is dealt out to several places with a copy of its timeline in each.

Null addresses have no host, and null times no active entry: both are unlisted. Entries with a null field or another action
are left out; of entries of one list, pattern and time the last action in ``ACTIONS`` counts. Repeated captures are judged each, empty
tables give empty ones, and other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spindrift.llm.common import BROADCAST_BYTES, dealt_join, places_for, shared_dir, written

ACTIONS = ("remove", "block", "allow")
#: Bytes of a pattern in a broadcast.
PATTERN_BYTES = 200


def host_of(url: Column) -> Column:
    """Lower-case host of an address, null for none."""
    host = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.when(host != "", host)


def path_of(url: Column, deepest: int) -> Column:
    """Lower-case path prefix of an address of at most ``deepest`` segments, empty for none."""
    path = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^?#]*)", 1)
    segments = F.slice(F.split(F.lower(path), "/"), 1, max(1, deepest))
    return F.rtrim(F.array_join(segments, "/"), F.lit("/")) if deepest else F.lit("")


def intervals(entries: DataFrame) -> DataFrame:
    """Return list, pattern, action, since, until (null: still valid) for the entries that list a pattern."""
    known = entries.select(F.col("list"), F.lower("pattern").alias("pattern"), F.col("action"), F.col("at").cast("timestamp").alias("at")).dropna()
    order = F.array_position(F.array(*map(F.lit, ACTIONS)), F.col("action"))
    one = known.where(order > 0).groupBy("list", "pattern", "at").agg(F.max_by("action", order).alias("action"))
    until = F.lead("at").over(Window.partitionBy("list", "pattern").orderBy("at"))
    return one.select("list", "pattern", "action", F.col("at").alias("since"), until.alias("until")).where("action != 'remove'")


def timelines(entries: DataFrame) -> DataFrame:
    """Return pattern, at, entry per change of a pattern: entry holds, in ``by``, the deciding list, action and since, or null where none is active."""
    valid = intervals(entries)
    changes = entries.select(F.lower("pattern").alias("p"), F.col("at").cast("timestamp").alias("t")).dropna().distinct()
    active = (F.col("p") == F.col("pattern")) & (F.col("t") >= F.col("since")) & (F.col("until").isNull() | (F.col("t") < F.col("until")))
    by = F.struct("since", "list", F.when(F.col("action") == "allow", 1).otherwise(0).alias("allow"))
    found = changes.join(valid, active, "left").groupBy("p", "t").agg(F.max(F.when(F.col("list").isNotNull(), by)).alias("by"))
    return found.select(F.col("p").alias("pattern"), F.col("t").alias("at"), F.struct("by").alias("entry"))


def patterns_of(host: Column, path: Column) -> Column:
    """Every pattern that covers an address."""
    labels, segments = F.split(host, r"\."), F.split(path, "/")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    prefixes = F.transform(F.sequence(F.lit(1), F.size(segments)), lambda k: F.concat(F.lit("/"), F.array_join(F.slice(segments, F.lit(1), k), "/")))
    below = F.concat(F.array(F.lit("")), F.when(path != "", prefixes).otherwise(F.array().cast("array<string>")))
    return F.flatten(F.transform(domains, lambda d: F.transform(below, lambda p: F.concat(d, p))))


def judge(captures: DataFrame, entries: DataFrame, id_col: str = "page_id", url_col: str = "url", at_col: str = "fetched_at") -> DataFrame:
    """Return ``id_col``, ``url_col``, ``at_col``, host, verdict (blocked, allowed, unlisted), list, pattern, since per row of ``captures``."""
    spark = captures.sparkSession
    base = shared_dir(spark)
    lines = written(timelines(entries), f"{base}/timelines")
    deepest = lines.agg(F.max(F.size(F.split("pattern", "/")) - 1)).first()[0] or 0
    rows = captures.select(F.col(id_col).alias("key"), F.col(url_col).alias("address"), F.col(at_col).cast("timestamp").alias("at"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col), deepest).alias("path"))
    asked = written(rows.dropna(subset=["host", "at"]).groupBy("host", "path", "at").agg(F.count("*").alias("n")), f"{base}/asked")
    covering = asked.select("host", "path", "at", F.explode(patterns_of(F.col("host"), F.col("path"))).alias("pattern"))
    listed = lines.select("pattern").distinct()
    if listed.count() * PATTERN_BYTES <= BROADCAST_BYTES:
        covering = covering.join(F.broadcast(listed), "pattern", "left_semi")
    else:
        counts = covering.groupBy("pattern").agg(F.count("*").alias("m"))
        covering = dealt_join(covering, listed.join(counts, "pattern"), ["pattern"], "m", asked.count())
    covering = written(covering, f"{base}/covering")
    by_key = dealt_join(rows, asked.join(deciding(covering, lines), ["host", "path", "at"]), ["host", "path", "at"], "n", asked.agg(F.sum("n")).first()[0] or 0, "left")
    verdict = F.when(F.col("by").isNull(), "unlisted").when(F.col("by.allow") == 1, "allowed").otherwise("blocked")
    return by_key.select(F.col("key").alias(id_col), F.col("address").alias(url_col), F.col("at").alias(at_col), "host", verdict.alias("verdict"), F.col("by.list").alias("list"), F.col("by.pattern").alias("pattern"), F.col("by.since").alias("since"))


def deciding(covering: DataFrame, lines: DataFrame) -> DataFrame:
    """host, path, at and by (the deciding entry) of rows (host, path, at, pattern) that one is active for."""
    places = places_for(F.col("m"), covering.count(), covering.sparkSession)
    counts = covering.groupBy("pattern").agg(F.count("*").alias("m")).select("pattern", places.alias("places"))
    hot = F.broadcast(counts.where("places > 1"))  # four for each partition at most
    asked = covering.join(hot, "pattern", "left").withColumn("place", F.pmod(F.xxhash64("host", "path", "at"), F.coalesce("places", F.lit(1))).cast("int"))
    copied = lines.join(counts, "pattern").withColumn("place", F.explode(F.sequence(F.lit(0), F.col("places") - 1)))
    both = copied.select("pattern", "place", "at", F.lit(0).alias("captured"), "entry", F.lit("").alias("host"), F.lit("").alias("path"))
    both = both.unionByName(asked.select("pattern", "place", "at", F.lit(1).alias("captured"), "host", "path"), allowMissingColumns=True)
    order = Window.partitionBy("pattern", "place").orderBy("at", "captured").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    as_of = both.withColumn("entry", F.last("entry", ignorenulls=True).over(order)).where("captured = 1 and entry.by is not null")
    first = F.struct(F.length("pattern").alias("specific"), F.col("entry.by.since"), F.col("entry.by.list"), F.col("entry.by.allow"), F.col("pattern"))
    return as_of.groupBy("host", "path", "at").agg(F.max(first).alias("by"))
