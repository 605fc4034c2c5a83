"""Similarity search: vectors within groups, nearest frames, fingerprint index and catalog matches."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spindrift.functions.vectors import POSITIONS, cosine, fingerprint_similarity


def cosine_pairs(frames: DataFrame, least: float, reach: int) -> DataFrame:
    """Frames of one item at most ``reach`` places apart whose cosine is at least ``least``.

    Frames are dealt out by item and block of ``reach`` places and compared with their own block and the next one.
    """
    rows = frames.withColumn("block", F.expr(f"idx div {reach}"))
    a = rows.select("item", "block", F.col("idx").alias("a"), F.col("vector").alias("va"))
    b = rows.withColumn("block", F.explode(F.array("block", F.col("block") - 1))).select("item", "block", F.col("idx").alias("b"), F.col("vector").alias("vb"))
    near = a.join(b, ["item", "block"]).where((F.col("b") > F.col("a")) & (F.col("b") - F.col("a") <= reach))
    return near.withColumn("similarity", cosine(F.col("va"), F.col("vb"))).where(F.col("similarity") >= least).select("item", "a", "b", "similarity")


def nearest_frame(marks: DataFrame, frames: DataFrame, step_ms: int = 1_000) -> DataFrame:
    """The frame of its item that starts nearest to each mark, the earlier of two as near.

    The last frame at or before a mark and the first after it come from marks and frames sorted by time, once in each direction: frames
    of a window that only grow are taken in once, where those that shrink are gone through again for each row.
    """
    both = frames.select("item", F.col("start_ms").alias("at"), F.struct(F.col("start_ms").alias("s"), "idx").alias("frame"), F.lit(None).cast("long").alias("mark_ms")).unionByName(
        marks.select("item", F.col("mark_ms").alias("at"), F.lit(None).cast("struct<s:bigint,idx:int>").alias("frame"), F.col("mark_ms")))
    last = lambda time: F.last("frame", ignorenulls=True).over(Window.partitionBy("item").orderBy(time, F.col("mark_ms").isNotNull().cast("int"), F.desc("frame")).rowsBetween(Window.unboundedPreceding, 0))
    placed = both.withColumns({"_before": last(F.asc("at")), "_after": last(F.desc("at"))}).where("mark_ms is not null")
    far = lambda f: F.when(f.isNotNull(), F.struct(F.abs(f["s"] - F.col("mark_ms")).alias("d"), f["idx"].alias("idx")))
    return placed.withColumn("_best", F.least(far(F.col("_before")), far(F.col("_after")))).select("item", "mark_ms", F.col("_best.idx").alias("idx"), F.col("_best.d").alias("distance_ms"))


def fingerprint_index(tracks: DataFrame, width: int = 12) -> DataFrame:
    """track_id, bucket, position, value for the positions that count."""
    rows = tracks.select("track_id", F.posexplode(F.slice("fingerprint", 1, POSITIONS)).alias("position", "value"))
    return rows.withColumn("bucket", F.format_string("b%02d", F.expr(f"position div {width}")))


#: Most queries and tracks of one task of a comparison of all with all, and values compared at a time.
QUERY_BLOCK, TRACK_BLOCK, SLAB = 32_768, 16_384, 1 << 18


def _compared(queries: DataFrame, tracks: DataFrame, compare: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """Every query with every track, block by block: a task gets one block of each and keeps the best of it, so no pairs are written.

    Rows (query_id or track_id, fingerprint, ...) are dealt out by a hash of their id, queries to all blocks of tracks and tracks to all blocks of queries.
    """
    across, down = (max(1, math.ceil(df.count() / size)) for df, size in ((queries, QUERY_BLOCK), (tracks, TRACK_BLOCK)))
    part = lambda key, n: F.pmod(F.xxhash64(key), F.lit(n))
    cells = lambda first, step, n: F.explode(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: first + k * step))
    q = queries.withColumn("_cell", cells(part("query_id", across) * down, 1, down))
    t = tracks.withColumn("_cell", cells(part("track_id", down), down, across))
    return q.groupBy("_cell").cogroup(t.groupBy("_cell")).applyInArrow(compare, schema)


def _matrix(table: pa.Table, key: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Order of rows by key, keys in order, values by position (a row each) and where there are any; positions that count only."""
    column = table.column("fingerprint").combine_chunks()
    column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    keys = table.column(key).to_numpy()
    order = np.argsort(keys, kind="stable")
    lengths = np.minimum(pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False), POSITIONS)
    values = np.zeros((int(lengths.max(initial=0)), len(keys)), np.int64)
    there = np.zeros(values.shape, bool)
    flat, starts = column.values, column.offsets.to_numpy()[:-1].astype(np.int64)
    valid, flat = pc.is_valid(flat).to_numpy(zero_copy_only=False), pc.fill_null(flat, 0).to_numpy()
    for p in range(len(values)):
        own = np.flatnonzero(lengths[order] > p)
        at = starts[order[own]] + p
        values[p, own], there[p, own] = flat[at], valid[at]
    return order, keys[order], values, there


def _near_counts(q: np.ndarray, q_there: np.ndarray, t: np.ndarray, t_there: np.ndarray, band: int) -> Iterator[tuple[slice, np.ndarray]]:
    """For a few queries after the other, at how many positions each track's value is within ``band`` of theirs.

    Values are moved into a narrow unsigned range, in which one subtraction and one comparison tell whether they are near; what is missing or
    beyond all values of the other side is set to numbers that nothing is near.
    """
    n = min(len(q), len(t))
    q, q_there, t, t_there = q[:n], q_there[:n], t[:n], t_there[:n]
    low, high = (int(t[t_there].min()), int(t[t_there].max())) if t_there.any() else (0, 0)
    q_there = q_there & (q >= low - band) & (q <= high + band)
    kind = np.uint16 if high - low + 8 * band + 8 < 1 << 16 else np.uint32 if high - low + 8 * band + 8 < 1 << 32 else np.uint64
    shift = 3 * band + 2 - low
    q, t = np.where(q_there, q + shift, 0).astype(kind), np.where(t_there, t + shift, high + shift + 3 * band + 2).astype(kind)
    rows = max(1, SLAB // max(1, t.shape[1]))
    for first in range(0, q.shape[1], rows):
        own = slice(first, min(first + rows, q.shape[1]))
        counts = np.zeros((own.stop - own.start, t.shape[1]), np.uint8)
        apart, near = np.empty(counts.shape, kind), np.empty(counts.shape, bool)
        for p in np.flatnonzero(q_there[:, own].any(axis=1)):
            np.subtract(t[p][None, :], q[p, own, None] - kind(band), out=apart)
            np.less_equal(apart, kind(2 * band), out=near)
            np.add(counts, near.view(np.uint8), out=counts)
        yield own, counts


def shortlist(queries: DataFrame, index: DataFrame, limit: int = 24, band: int = 10) -> DataFrame:
    """The tracks that share most values with each query at equal positions, within ``band``; of as many, those of the smallest ids.

    index: tracks with their fingerprints, or ``fingerprint_index`` of them. Most pairs share values, so each query is held against all
    tracks, in blocks that keep ``limit`` tracks of each query. Rows of equal id count together.
    """
    if "fingerprint" not in index.columns:
        ordered = F.transform(F.array_sort(F.collect_list(F.struct("position", "value"))), lambda x: x["value"])
        index = index.groupBy("track_id").agg(ordered.alias("fingerprint"))
    whole = lambda df, key: df.select(F.col(key).cast("long").alias(key), F.col("fingerprint").cast("array<long>").alias("fingerprint"))

    def compare(asked: pa.Table, given: pa.Table) -> pa.Table:
        _, q_ids, q, q_there = _matrix(asked, "query_id")
        _, t_ids, t, t_there = _matrix(given, "track_id")
        t_once, t_first = np.unique(t_ids, return_index=True)
        found: list[tuple[np.ndarray, ...]] = []
        for own, counts in _near_counts(q, q_there, t, t_there, band) if len(t_ids) else ():
            shared = counts.astype(np.int64) if len(t_once) == len(t_ids) else np.add.reduceat(counts, t_first, axis=1, dtype=np.int64)
            rank = shared * len(t_once) + np.arange(len(t_once))[::-1]
            best = np.argpartition(rank, -limit, axis=1)[:, -limit:] if len(t_once) > limit else np.broadcast_to(np.arange(len(t_once)), shared.shape)
            n = np.take_along_axis(shared, best, axis=1)
            row, place = np.nonzero(n)
            found.append((q_ids[own][row], t_once[best[row, place]], n[row, place]))
        columns = [np.concatenate(c) for c in zip(*found, strict=True)] if found else [np.empty(0, np.int64)] * 3
        return pa.table(columns, names=["query_id", "track_id", "shared"])

    counts = _compared(whole(queries, "query_id"), whole(index, "track_id"), compare, "query_id long, track_id long, shared long")
    order = Window.partitionBy("query_id").orderBy(F.desc("shared"), "track_id")
    return counts.withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit)


def length_weight(a: Column, b: Column) -> Column:
    """How far two lengths agree, as a weight from 0.7 to 1; 1 where either is not known, that is null or zero."""
    known = (F.coalesce(a, F.lit(0)) > 0) & (F.coalesce(b, F.lit(0)) > 0)
    return F.when(known, 0.7 + 0.3 * F.least(a, b) / F.greatest(a, b)).otherwise(1.0)


def best_of(pairs: DataFrame, queries: DataFrame, tracks: DataFrame, least: float) -> DataFrame:
    """query_id, track_id, score and confidence of the best of each query's pairs (query_id, track_id), if it reaches ``least`` and is above zero.

    Scores are held against each other to nine decimals, so that equal ones are equal whatever they were worked out from.
    """
    rows = pairs.join(queries.select("query_id", F.col("fingerprint").alias("_q"), F.col("duration_ms").alias("_qd")), "query_id")
    rows = rows.join(tracks.select("track_id", F.col("fingerprint").alias("_t"), F.col("duration_ms").alias("_td")), "track_id")
    scored = rows.withColumn("score", fingerprint_similarity(F.col("_q"), F.col("_t")) * length_weight(F.col("_qd"), F.col("_td")))
    return _best(scored.withColumn("nines", F.round(F.col("score") * 10**9).cast("long")), least)


def _best(scored: DataFrame, least: float) -> DataFrame:
    best = scored.where((F.col("nines") >= round(least * 10**9)) & (F.col("nines") > 0)).groupBy("query_id").agg(F.max_by(F.struct("track_id", "score"), F.struct(F.col("nines"), -F.col("track_id"))).alias("_best"))
    return best.select("query_id", "_best.track_id", "_best.score", F.greatest(F.lit(0.25), F.least(F.lit(0.95), F.col("_best.score"))).alias("confidence"))


def catalog_matches(queries: DataFrame, tracks: DataFrame, listed: DataFrame, least: float = 0.20) -> DataFrame:
    """The best track of each query's shortlist: similarity, weighed by how far the lengths agree.

    A query with an empty shortlist shares no value with any track within the band, so its likeness to all of them is zero
    and it has no match; the catalog need not be looked through for it.
    """
    return best_of(listed.select("query_id", "track_id"), queries, tracks, least)


def catalog_search(queries: DataFrame, tracks: DataFrame, least: float = 0.20, tolerance: int = 10) -> DataFrame:
    """The best track of the whole catalog for each query that has one of a score of ``least`` (above zero).

    Most tracks agree with a query somewhere, so an index of values finds next to all pairs, which then are dealt out; instead each query is held
    against all tracks in blocks that keep its best track. Null values and queries without values find nothing.
    """
    whole = lambda df, key: df.select(F.col(key).cast("long").alias(key), F.col("fingerprint").cast("array<long>").alias("fingerprint"), F.coalesce("duration_ms", F.lit(0)).cast("long").alias("duration_ms"))

    def compare(asked: pa.Table, given: pa.Table) -> pa.Table:
        q_order, q_ids, q, q_there = _matrix(asked, "query_id")
        t_order, t_ids, t, t_there = _matrix(given, "track_id")
        size = lambda table, order: np.minimum(pc.fill_null(pc.list_value_length(table.column("fingerprint")), 0).to_numpy(), POSITIONS)[order].astype(np.float64)
        q_size, t_size = size(asked, q_order), size(given, t_order)
        q_long, t_long = asked.column("duration_ms").to_numpy()[q_order].astype(np.float64), given.column("duration_ms").to_numpy()[t_order].astype(np.float64)
        found: list[tuple[np.ndarray, ...]] = []
        for own, counts in _near_counts(q, q_there, t, t_there, tolerance - 1) if len(t_ids) else ():
            score = counts / np.maximum(np.minimum(q_size[own, None], t_size[None, :]), 1)
            a, b = q_long[own, None], t_long[None, :]
            weight = 0.7 + 0.3 * np.minimum(a, b) / np.maximum(np.maximum(a, b), 1)
            score *= np.where((a > 0) & (b > 0), weight, 1.0)
            nines = np.floor(score * 1e9 + 0.5).astype(np.int64)
            best = nines.argmax(axis=1)  # the first of equals has the smallest id
            row = np.arange(len(best))
            found.append((q_ids[own], t_ids[best], score[row, best], nines[row, best]))
        columns = [np.concatenate(c) for c in zip(*found, strict=True)] if found else [np.empty(0, k) for k in (np.int64, np.int64, np.float64, np.int64)]
        return pa.table(columns, names=["query_id", "track_id", "score", "nines"])

    return _best(_compared(whole(queries, "query_id"), whole(tracks, "track_id"), compare, "query_id long, track_id long, score double, nines long"), least)
