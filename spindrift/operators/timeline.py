"""Timelines: hits fused into islands and segments, clamped, stitched and drawn."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GAP_MS = 2_000


def islands(hits: DataFrame, gap_ms: int = GAP_MS) -> DataFrame:
    """Add island: hits of an item and key, in order of start, part where one starts over ``gap_ms`` after the end of the one before."""
    w = Window.partitionBy("item", "key").orderBy("start_ms", "seq")
    opens = (F.lag("end_ms").over(w).isNull() | (F.col("start_ms") > F.lag("end_ms").over(w) + gap_ms)).cast("int")
    return hits.withColumn("_opens", opens).withColumn("island", F.sum("_opens").over(w)).drop("_opens")


def fused(hits: DataFrame, gap_ms: int = GAP_MS) -> DataFrame:
    """Segments: per island its span, confidence (mean plus 0.05 for every further provider, at most 1), providers and evidence."""
    providers = F.sort_array(F.collect_set("provider"))
    grouped = islands(hits, gap_ms).groupBy("item", "key", "island").agg(
        F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.avg("confidence").alias("mean"), providers.alias("providers"),
        F.sum(F.greatest(F.lit(1), F.col("n_evidence"))).alias("evidence_count"), F.count("*").alias("probe_count"), F.max_by("seq", F.struct("confidence", -F.col("seq"))).alias("primary_seq"),
    )
    confidence = F.least(F.lit(1.0), F.col("mean") + 0.05 * (F.size("providers") - 1))
    return grouped.withColumns({"confidence": confidence, "uncertainty": F.greatest(F.lit(0.0), 1 - confidence), "acceptance_gate": F.lit("FUSION")}).drop("mean")


def alternates(candidates: DataFrame, group: list[str], limit: int = 5) -> DataFrame:
    """Per group, the other keys in order of their best confidence: the first of all is the primary and left out."""
    best = candidates.groupBy(*group, "key").agg(F.max(F.struct("confidence", -F.col("seq"))).alias("best"))
    order = Window.partitionBy(*group).orderBy(F.desc("best"))
    ranked = best.withColumn("place", F.row_number().over(order)).where(F.col("place").between(2, limit + 1))
    return ranked.groupBy(*group).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "key"))), lambda x: x["key"]).alias("alternates"))


def clamped(segments: DataFrame) -> DataFrame:
    """Ends cut back to the next start of their item; what is empty then goes."""
    following = F.lead("start_ms").over(Window.partitionBy("item").orderBy("start_ms", "end_ms", "kind", "seq"))
    end = F.when(F.col("end_ms") > following, F.greatest("start_ms", following)).otherwise(F.col("end_ms"))
    return segments.withColumn("end_ms", end).where("end_ms > start_ms")


#: Lengths (ms) below which a step of a gap rule counts; the last step is for longer ones.
LENGTHS = (10_000, 60_000, 600_000)


def merge_steps(option_ms: int = 12_000) -> tuple[int, int, int, int]:
    """Gaps across which hits of one track join, by the longer one's length."""
    return 2_000, 5_000, max(5_000, option_ms), 30_000


def bridge_steps(option_ms: int = 8_000) -> tuple[int, int, int, int]:
    """Gaps, and lengths of a segment between, that hits of one track may span, by the longer one's length."""
    return min(2_000, option_ms), min(5_000, option_ms), option_ms, max(option_ms, 19_000)


def gap_for(longer: Column, steps: tuple[int, int, int, int]) -> Column:
    return F.when(longer < LENGTHS[0], steps[0]).when(longer < LENGTHS[1], steps[1]).when(longer < LENGTHS[2], steps[2]).otherwise(steps[3])


def with_attempts(segments: DataFrame, attempts: DataFrame, bucket_ms: int = 60_000) -> DataFrame:
    """Sum the calls of attempts that overlap each segment (item, seq) of their item.

    Both sides are laid out in time buckets, so the join is on item and bucket; an overlap counts in its first common bucket only.
    """
    spread = lambda df: df.withColumn("bucket", F.explode(F.sequence(F.expr(f"start_ms div {bucket_ms}"), F.expr(f"greatest(start_ms, end_ms - 1) div {bucket_ms}"))))
    s = spread(segments.select("item", "seq", "start_ms", "end_ms")).alias("s")
    a = spread(attempts.select("item", "start_ms", "end_ms", "calls")).alias("a")
    overlap = (F.col("a.start_ms") < F.col("s.end_ms")) & (F.col("a.end_ms") > F.col("s.start_ms"))
    first = F.col("s.bucket") == F.expr(f"greatest(s.start_ms, a.start_ms) div {bucket_ms}")
    found = s.join(a, (F.col("s.item") == F.col("a.item")) & (F.col("s.bucket") == F.col("a.bucket")) & overlap & first)
    sums = found.groupBy(F.col("s.item").alias("item"), F.col("s.seq").alias("seq")).agg(F.sum("calls").alias("provider_attempts"))
    return segments.join(sums, ["item", "seq"], "left").withColumn("provider_attempts", F.coalesce("provider_attempts", F.lit(0)).cast("long"))


STITCHED = "item long, seq long, start_ms long, end_ms long, kind string, key string, confidence double, providers array<string>, evidence_count long, parts long"


def _gap(longer: int, steps: tuple[int, int, int, int]) -> int:
    return steps[bisect_right(LENGTHS, longer)]


def stitched(segments: DataFrame, merge_ms: int = 12_000, bridge_ms: int = 8_000) -> DataFrame:
    """Bridge short gaps between parts of one track, merge neighbours, and clamp overlaps.

    Each step only looks at what it has last built of an item, so rows sorted by item stream through with a few rows
    of state. Segments: item, seq, start_ms, end_ms, kind, key (null unless matched), confidence, providers, evidence_count;
    and, as far as there are such columns, alternates, hints, explanation (joined, each once), uncertainty (the least, where
    none or zero counts as one), probe_count and provider_attempts (summed).
    """
    lists = [c for c in ("alternates", "hints", "explanation") if c in segments.columns]
    sums = [c for c in ("probe_count", "provider_attempts") if c in segments.columns]
    least = [c for c in ("uncertainty",) if c in segments.columns]
    to_merge, to_bridge = merge_steps(merge_ms), bridge_steps(bridge_ms)
    length = lambda s: s["end_ms"] - s["start_ms"]
    one_track = lambda a, b: a["kind"] == b["kind"] == "matched_track" and a["key"] is not None and a["key"] == b["key"]

    def joined(a: dict, b: dict) -> dict:
        return a | {"end_ms": max(a["end_ms"], b["end_ms"]), "confidence": max(a["confidence"], b["confidence"]), "providers": sorted({*a["providers"], *b["providers"]}), "evidence_count": a["evidence_count"] + b["evidence_count"], "parts": a["parts"] + b["parts"],
            **{c: list(dict.fromkeys([*a[c], *b[c]])) for c in lists}, **{c: a[c] + b[c] for c in sums}, **{c: min(a[c] or 1.0, b[c] or 1.0) for c in least}}

    def bridged(rows: Iterator[dict]) -> Iterator[dict]:
        held: list[dict] = []
        for row in rows:
            if held and held[0]["item"] != row["item"]:
                yield from held
                held = []
            held.append(row)
            if len(held) < 3:
                continue
            a, between, b = held
            budget = _gap(max(length(a), length(b)), to_bridge)
            gaps = max(0, between["start_ms"] - a["end_ms"]), max(0, b["start_ms"] - between["end_ms"])
            if one_track(a, b) and between["kind"] != "matched_track" and max(gaps) <= budget and length(between) <= budget:
                both = joined(a, b)
                if "explanation" in lists:
                    note = f"Bridged across a {between['kind'].replace('_', ' ')} gap of {sum(gaps)} ms."
                    both["explanation"] = list(dict.fromkeys([*both["explanation"], note]))
                yield both
                held = []
            else:
                yield held.pop(0)
        yield from held

    def merged(rows: Iterator[dict]) -> Iterator[dict]:
        last = None
        for row in rows:
            if last is not None and last["item"] == row["item"]:
                gap = max(0, row["start_ms"] - last["end_ms"])
                longer = max(length(last), length(row))
                same = gap <= _gap(longer, to_merge) if one_track(last, row) else row["kind"] == last["kind"] != "matched_track" and row["key"] is None and last["key"] is None and gap <= _gap(longer, to_bridge)
                if same:
                    last = joined(last, row)
                    continue
            if last is not None:
                yield last
            last = row
        if last is not None:
            yield last

    def cut(rows: Iterator[dict]) -> Iterator[dict]:
        last = None
        for row in _ending(rows):
            if last is not None:
                if row is not None and row["item"] == last["item"] and last["end_ms"] > row["start_ms"]:
                    last = last | {"end_ms": max(last["start_ms"], row["start_ms"])}
                if last["end_ms"] > last["start_ms"]:
                    yield last
            last = row

    further = [*lists, *sums, *least]
    schema = STITCHED + "".join(f", {c} array<string>" for c in lists) + "".join(f", {c} long" for c in sums) + "".join(f", {c} double" for c in least)
    kinds = {"long": pa.int64(), "double": pa.float64(), "string": pa.string(), "array<string>": pa.list_(pa.string())}
    arrow = pa.schema([(name, kinds[kind]) for name, kind in (part.split() for part in schema.split(", "))])
    names = arrow.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r | {"parts": 1} | {c: r[c] or [] for c in ("providers", *lists)} | {c: r[c] or 0 for c in (*sums, *least)} for b in batches for r in b.to_pylist())
        out: list[dict] = []
        for row in _ending(cut(merged(bridged(rows)))):
            if row is not None:
                out.append(row)
            if len(out) == 5_000 or row is None:
                yield pa.RecordBatch.from_pylist([{c: r[c] for c in names} for r in out], schema=arrow)
                out = []

    rows = segments.select("item", "seq", "start_ms", "end_ms", "kind", "key", "confidence", "providers", "evidence_count", *further)
    return rows.repartition("item").sortWithinPartitions("item", "start_ms", "end_ms", "kind", "seq").mapInArrow(run, schema)


def _ending(rows: Iterator[dict]) -> Iterator[dict | None]:
    yield from rows
    yield None


def only_songs(segments: DataFrame) -> DataFrame:
    """Matched segments of items that have some, all segments of the others."""
    matched = F.count_if(F.col("kind") == "matched_track").over(Window.partitionBy("item"))
    return segments.withColumn("_n", matched).where((F.col("_n") == 0) | (F.col("kind") == "matched_track")).drop("_n")


def timeline_bar(segments: DataFrame, width: int = 80) -> DataFrame:
    """A line of ``width`` cells per item: each shows the last segment that covers it.

    Fills: matched 'M', unresolved 'u', speech 's', nothing or silence '.'.
    """
    total = F.greatest(F.lit(1), F.max("end_ms").over(Window.partitionBy("item")))
    first = F.floor(F.col("start_ms") / total * width).cast("int")
    fill = F.when(F.col("kind") == "matched_track", "M").when(F.col("kind") == "music_unresolved", "u").when(F.col("kind") == "speech_only", "s").otherwise(".")
    rows = segments.withColumn("_first", first).withColumn("_last", F.greatest(F.col("_first") + 1, F.floor(F.col("end_ms") / total * width).cast("int"))).withColumn("_fill", fill)
    cells = rows.withColumn("cell", F.explode(F.filter(F.sequence(F.col("_first"), F.col("_last") - 1), lambda c: c < width)))
    filled = cells.groupBy("item", "cell").agg(F.max_by("_fill", F.struct("start_ms", "end_ms", "kind", "seq")).alias("fill"))
    by_cell = filled.groupBy("item").agg(F.map_from_entries(F.collect_list(F.struct("cell", "fill"))).alias("cells"))
    bar = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda c: F.coalesce(F.try_element_at("cells", c), F.lit("."))), "")
    return by_cell.select("item", bar.alias("bar"))


#: Fixed value: the first line of the explanation of a corrected segment.
CORRECTED = "Manually corrected by the user."


def corrected(segments: DataFrame, corrections: DataFrame, strict: bool = False) -> DataFrame:
    """Manual corrections of exact intervals: the new key becomes the match, the old one the first of at most five alternates.

    segments: item, start_ms, end_ms, kind, key, confidence, uncertainty, alternates and, if there, metadata_hints and explanation, which
    then name the correction; corrections: item, start_ms, end_ms, new_key. A correction of a segment that is not there is left out, or, if ``strict``, an
    error when the rows are read.
    """
    spot = ["item", "start_ms", "end_ms"]
    trimmed = corrections.withColumn("new_key", F.trim("new_key"))
    rows = segments.withColumn("_there", F.lit(True)).join(trimmed, spot, "full_outer" if strict else "left")
    if strict:
        missing = F.raise_error(F.concat_ws(" ", F.lit("Segment not found:"), *spot)).cast(segments.schema["item"].dataType)
        rows = rows.withColumn("item", F.when(F.col("_there").isNull(), missing).otherwise(F.col("item")))
    fixed = F.col("new_key").isNotNull()
    others = F.array_distinct(F.filter(F.concat(F.array("key"), "alternates"), lambda k: k.isNotNull() & (k != F.col("new_key"))))
    found = {
        "alternates": F.when(fixed, F.slice(others, 1, 5)).otherwise(F.col("alternates")), "kind": F.when(fixed, "matched_track").otherwise(F.col("kind")), "key": F.coalesce("new_key", "key"),
        "confidence": F.when(fixed, F.greatest(F.lit(0.99), F.col("confidence"))).otherwise(F.col("confidence")), "uncertainty": F.when(fixed, 0.0).otherwise(F.col("uncertainty")),
    }
    given = lambda c: F.coalesce(c, F.array().cast("array<string>"))
    if "metadata_hints" in segments.columns:
        found["metadata_hints"] = F.when(fixed, F.array_distinct(F.concat(given("metadata_hints"), F.array(F.concat(F.lit("manual:"), F.col("new_key")))))).otherwise(F.col("metadata_hints"))
    if "explanation" in segments.columns:
        found["explanation"] = F.when(fixed, F.concat(F.array(F.lit(CORRECTED)), F.filter(given("explanation"), lambda x: x != CORRECTED))).otherwise(F.col("explanation"))
    return rows.withColumns(found).drop("new_key", "_there")
