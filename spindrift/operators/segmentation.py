"""From feature frames to segments: scores, labels, novelty, boundaries, short segments, repeat groups."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spindrift.functions.vectors import norm


def min_max(column: str, group: str = "item") -> Column:
    """Scaled to 0..1 over the item; 0 where all are equal."""
    w = Window.partitionBy(group)
    low, high = F.min(column).over(w), F.max(column).over(w)
    return F.when(high == low, 0.0).otherwise((F.col(column) - low) / (high - low))


def z_score(column: str, group: str = "item") -> Column:
    w = Window.partitionBy(group)
    return (F.col(column) - F.avg(column).over(w)) / F.greatest(F.stddev_pop(column).over(w), F.lit(1e-6))


def standardized(frames: DataFrame) -> DataFrame:
    """Frames with every component of ``vector`` z-scored over its item."""
    parts = frames.select("item", "idx", F.posexplode("vector").alias("pos", "x"))
    stats = parts.groupBy("item", "pos").agg(F.avg("x").alias("m"), F.greatest(F.stddev_pop("x"), F.lit(1e-6)).alias("s"))
    by_item = stats.groupBy("item").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m", "s"))), lambda x: F.struct(x["m"].alias("m"), x["s"].alias("s"))).alias("_stats"))
    scaled = F.zip_with("vector", "_stats", lambda x, t: (x - t["m"]) / t["s"])
    return frames.join(by_item, "item").withColumn("vector", scaled).drop("_stats")


def novelty(frames: DataFrame) -> DataFrame:
    """Add novelty: distance of each vector from the one before, 0 for the first."""
    w = Window.partitionBy("item").orderBy("idx")
    step = norm(F.zip_with("vector", F.col("_before"), lambda a, b: a - b))
    return frames.withColumn("_before", F.lag("vector").over(w)).withColumn("novelty", F.coalesce(step, F.lit(0.0))).drop("_before")


def local_maximum(column: str) -> Column:
    """Not below either neighbour; ends are none."""
    w = Window.partitionBy("item").orderBy("idx")
    return F.coalesce((F.col(column) >= F.lag(column).over(w)) & (F.col(column) >= F.lead(column).over(w)), F.lit(False))


def thresholds(frames: DataFrame, column: str = "novelty", percent: float = 82.0) -> DataFrame:
    """item, threshold: the percentile of its frames, 0 with fewer than five."""
    return frames.groupBy("item").agg(F.when(F.count("*") > 4, F.percentile(column, percent / 100)).otherwise(0.0).alias("threshold"))


def bounded(frames: DataFrame, percent: float = 82.0, column: str = "novelty") -> DataFrame:
    """Add segment: a frame opens one if it is the first, is marked (``marked``), or follows a peak over the threshold."""
    w = Window.partitionBy("item").orderBy("idx")
    rows = frames.join(thresholds(frames, column, percent), "item").withColumn("_peak", local_maximum(column) & (F.col(column) >= F.col("threshold")))
    opens = (F.col("idx") == 0) | F.coalesce(F.lag("_peak").over(w), F.lit(False))
    if "marked" in frames.columns:
        opens = opens | F.col("marked")
    return rows.withColumn("_opens", opens.cast("int")).withColumn("segment", F.sum("_opens").over(w)).drop("_opens", "_peak", "threshold")


def smoothed(frames: DataFrame, column: str, context: int) -> DataFrame:
    """Add ``smooth``: the mean of ``context`` frames from context // 2 before, the ends repeated beyond them."""
    if context <= 1:
        return frames.withColumn("smooth", F.col(column))
    before, after = context // 2, context - 1 - context // 2
    order = Window.partitionBy("item").orderBy("idx")
    whole = Window.partitionBy("item")
    total = F.sum(column).over(order.rowsBetween(-before, after))
    rows = frames.withColumns({"_n": F.count("*").over(whole), "_i": F.row_number().over(order) - 1, "_first": F.min_by(column, "idx").over(whole), "_last": F.max_by(column, "idx").over(whole), "_sum": total})
    low, high = F.greatest(F.lit(0), before - F.col("_i")), F.greatest(F.lit(0), F.col("_i") + after - F.col("_n") + 1)
    return rows.withColumn("smooth", (F.col("_sum") + low * F.col("_first") + high * F.col("_last")) / context).drop("_n", "_i", "_first", "_last", "_sum")


def scores(frames: DataFrame) -> DataFrame:
    """Add music_score, speech_score and no_music_score, weighted sums of features scaled to 0..1, clipped to 0..1.

    frames: rms, flatness, rolloff, zcr, onset, chroma and contrast.
    """
    clip = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    rms, flat, rolloff, zcr, onset, chroma, contrast = map(F.col, ("rms", "flatness", "rolloff", "zcr", "onset", "chroma", "contrast"))
    voice = clip(0.7 * rolloff + 0.3 * zcr)
    return frames.withColumns({
        "music_score": clip(0.34 * chroma + 0.20 * onset + 0.16 * (1 - flat) + 0.18 * contrast + 0.12 * rms),
        "speech_score": clip(0.34 * voice + 0.22 * zcr + 0.18 * rms + 0.26 * (1 - chroma)), "no_music_score": clip(0.65 * (1 - rms) + 0.35 * flat),
    })


def frame_label(music: Column, speech: Column, no_music: Column, rms: Column, chroma: Column) -> Column:
    return (
        F.when((rms < 0.06) | (no_music >= 0.72), "silence_or_fx").when((music >= 0.48) & (chroma >= 0.22) & (speech < 0.70), "matched_track")
        .when((speech >= 0.70) & (music < 0.48), "speech_only").when(music >= 0.32, "music_unresolved").otherwise("speech_only")
    )


def segments_of(frames: DataFrame, vectors: bool = False) -> DataFrame:
    """Segments of labelled frames (item, segment, label, start_ms, end_ms): span, ratios and kind, and mean vectors if asked for."""
    music = F.avg(F.col("label").isin("matched_track", "music_unresolved").cast("int"))
    speech, silence = F.avg((F.col("label") == "speech_only").cast("int")), F.bool_and(F.col("label") == "silence_or_fx")
    found = frames.groupBy("item", "segment").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.count("*").alias("n_frames"), music.alias("music_ratio"), speech.alias("speech_ratio"), silence.alias("_silence"))
    kind = F.when(F.col("_silence"), "silence_or_fx").when((F.col("speech_ratio") >= 0.65) & (F.col("music_ratio") < 0.35), "speech_only").otherwise("music_unresolved")
    found = found.withColumn("kind", kind).drop("_silence")
    for column in ("vector", "chroma") if vectors else ():
        if column in frames.columns:
            found = found.join(mean_vectors(frames, column), ["item", "segment"])
    return found


def mean_vectors(frames: DataFrame, column: str = "vector") -> DataFrame:
    """item, segment and the mean of its frames' vectors."""
    parts = frames.select("item", "segment", F.posexplode(column).alias("pos", "x")).groupBy("item", "segment", "pos").agg(F.avg("x").alias("x"))
    return parts.groupBy("item", "segment").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda p: p["x"]).alias(column))


def analyzed(frames: DataFrame, percent: float = 82.0, least_ms: int = 8_000, repeats: bool = True, **likeness: float) -> DataFrame:
    """The whole chain: labelled frames (item, idx, start_ms, end_ms, label, vector, chroma) to segments with their repeat groups.

    Boundaries by novelty, ratios and mean vectors by segment, short segments merged, and like ones grouped (null groups if not asked for).
    """
    marked = bounded(novelty(standardized(frames)).select(*(c for c in frames.columns if c not in ("vector",)), "novelty"), percent)
    own = marked.select("item", "idx", "segment").join(frames, ["item", "idx"])
    merged = merge_short(segments_of(own, vectors=True), least_ms)
    if not repeats:
        return merged.withColumn("repeat_group", F.lit(None).cast("long"))
    groups = repeat_groups(merged.withColumns({c: F.col(c).cast("long") for c in ("item", "segment")}), **likeness).select("item", "segment", "repeat_group")
    return merged.join(groups, ["item", "segment"])


def _by_item(rows: DataFrame, *order: str) -> DataFrame:
    return rows.repartition("item").sortWithinPartitions("item", *order)


def merge_short(segments: DataFrame, least_ms: int) -> DataFrame:
    """Neighbours of which one is shorter than ``least_ms`` become one, never across silence or speech; ratios, and vectors there are, are weighed by length.

    Rows sorted by item stream through with one segment of state.
    """
    vectors = [c for c in ("vector", "chroma") if c in segments.columns]
    apart = ("silence_or_fx", "speech_only")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, out = None, []
        for row in (r for b in batches for r in b.to_dict("records")):
            if last is not None and last["item"] == row["item"] and last["kind"] not in apart and row["kind"] not in apart and min(last["end_ms"] - last["start_ms"], row["end_ms"] - row["start_ms"]) < least_ms:
                a, b = (max(1, x["end_ms"] - x["start_ms"]) for x in (last, row))
                mean = lambda c: (last[c] * a + row[c] * b) / (a + b)  # noqa: B023, E731
                last |= {"start_ms": min(last["start_ms"], row["start_ms"]), "end_ms": max(last["end_ms"], row["end_ms"]), "kind": last["kind"] if last["kind"] == row["kind"] else "music_unresolved", "music_ratio": mean("music_ratio"), "speech_ratio": mean("speech_ratio"), **{c: mean(c) for c in vectors}}
                continue
            if last is not None:
                out.append(last)
            last = row
            if len(out) >= 5_000:
                yield pd.DataFrame(out)
                out = []
        out += [last] * (last is not None)
        if out:
            yield pd.DataFrame(out)

    rows = segments.select("item", "segment", "start_ms", "end_ms", "kind", "music_ratio", "speech_ratio", *vectors)
    return _by_item(rows, "start_ms", "segment").mapInPandas(run, rows.schema)


def _unit(vector: np.ndarray) -> np.ndarray:
    """Of length one, or zero where there is next to nothing."""
    size = float(np.linalg.norm(vector))
    return vector / size if size > 1e-6 else np.zeros(len(vector))


def _nearest(marks: list[int], at: int) -> int:
    """Distance to the nearest of sorted marks."""
    k = bisect_left(marks, at)
    return min(abs(at - m) for m in marks[max(0, k - 1) : k + 1])


def repeat_groups(segments: DataFrame, feature: float = 0.88, chroma: float = 0.82, ratio: float = 0.35, certain: float = 0.96) -> DataFrame:
    """Add repeat_group (the first member's segment): greedy, a segment joins the first group whose representative is alike.

    Segments far from every member in time need to be all but equal. State per item: a row for each group.
    segments: item, segment, start_ms, end_ms, kind, vector, chroma.
    """
    musical = F.col("kind").isin("music_unresolved", "matched_track")
    from spindrift.functions.vectors import upper_median

    median = upper_median(F.collect_list(F.when(musical, F.col("end_ms") - F.col("start_ms"))))
    rows = segments.join(segments.groupBy("item").agg(median.alias("_median")), "item").select("item", "segment", "start_ms", "end_ms", "kind", "vector", "chroma", "_median")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        item, known = None, []
        for b in batches:
            found = []
            for row in b.itertuples(index=False, name=None):
                own, segment, start, end, kind, vector, colour, middle_length = row
                if own != item:
                    item, known = own, []
                if kind not in ("music_unresolved", "matched_track"):
                    found.append(None)
                    continue
                length = max(1, end - start)
                middle, reach = start + length // 2, max(120_000, 4 * int(middle_length))
                vector, colour = _unit(vector), _unit(colour)
                group = None
                if known:
                    # All representatives at once; the first that is alike in every way counts.
                    alike, hue = np.array([g[1] for g in known]) @ vector, np.array([g[2] for g in known]) @ colour
                    lengths = np.array([g[3] for g in known])
                    close = (alike >= feature) & (hue >= chroma) & (np.minimum(length, lengths) / np.maximum(length, lengths) >= ratio)
                    for k in np.flatnonzero(close).tolist():
                        if alike[k] >= certain or _nearest(known[k][4], middle) <= reach:
                            group = known[k][0]
                            insort(known[k][4], middle)
                            break
                if group is None:
                    group = segment
                    known.append((segment, vector, colour, length, [middle]))
                found.append(group)
            yield b[["item", "segment", "start_ms", "end_ms", "kind"]].assign(repeat_group=pd.array(found, dtype="Int64"))

    return _by_item(rows, "start_ms", "segment").mapInPandas(run, "item long, segment long, start_ms long, end_ms long, kind string, repeat_group long")
