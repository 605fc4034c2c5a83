"""Exact dedup with a log-structured merge index of digests, in DataFrame operations only.

Digests and identifiers of all rows are written once, as members. ``MergeIndex`` takes them in flushes and holds, in levels of sorted
runs, for each digest its smallest (or largest) identifier and the number of its rows. Flush: each task's memtable of at most ``memtable_rows``
rows goes to level 0, sorted by digest. Compaction merges level 0 to a run of level 1, bucketed by digest and sorted, in which one identifier of each
digest is left; two runs of a level merge to one of the next, bucket by bucket by a sort-merge join without a shuffle. Every run has a filter,
the bits of its digests' slots, and a look-up opens only the runs whose filter lets one of its digests through; each flush looks its digests up first.

Digests of more than one row are hits. Their filter is asked before a text moves: texts that it lets through are compared as bytes, by grouping
on digest and text, in which copies within a task pass as one row; of each text the extreme identifier stays.

Null text counts as empty. Of rows with equal ids and texts one stays, that with the least other columns. Null ids lose
against others. A digest shared by unequal texts parts them by their bytes. An empty table gives an empty one;
further columns of any type and name are carried along by ``deduplicated`` and not looked at by ``mark``.
"""

from __future__ import annotations

import uuid
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spindrift.llm.common import ascii_lower, bucketed, dealt_join, fresh, removed, scratch, shared_dir, text_or_empty, without, written

#: Slots of a filter for each digest, and 64-slot words of a filter at most: a filter is broadcast, and a fuller one lets more through.
SLOTS = 16
FILTER_WORDS = 4 << 20


def normalised(text_col: str) -> Column:
    return ascii_lower(text_or_empty(text_col))


def digest_of(norm: Column) -> Column:
    return F.unhex(F.sha2(norm, 256))


class Filter(NamedTuple):
    """One bit for each slot that a digest falls into: rows (word, bits), a row for each word that is not empty."""

    words: DataFrame
    slots: int

    def passing(self, rows: DataFrame) -> DataFrame:
        """Rows (digest, ...) whose digest may be among the filter's."""
        slot = slot_of(F.col("digest"), self.slots)
        return rows.join(F.broadcast(self.words), (F.col("word") == F.shiftright(slot, 6)) & (F.getbit(F.col("bits"), F.pmod(slot, F.lit(64)).cast("int")) == 1), "left_semi")


def slot_of(digest: Column, slots: int) -> Column:
    return F.pmod(F.xxhash64(digest), F.lit(slots).cast("long"))


def filter_of(digests: DataFrame, rows: int, path: str) -> Filter:
    """The filter of rows (digest) of which there are ``rows``."""
    slots = 64 * min(FILTER_WORDS, max(1, SLOTS * rows // 64))
    slot = slot_of(F.col("digest"), slots)
    bits = digests.select(F.shiftright(slot, 6).alias("word"), F.expr(f"shiftleft(1L, int(pmod(xxhash64(digest), {slots}L) % 64))").alias("bit"))
    return Filter(written(bits.groupBy("word").agg(F.bit_or("bit").alias("bits")), path), slots)


class Run(NamedTuple):
    """A sorted run: digest, known and id (whether there is a key, and the key or a zero), copies, and keys where one identifier is kept."""

    rows: DataFrame
    filter: Filter
    path: str


SORTED = ("digest", "known", "id")
EXTREME = {"smallest": F.min, "largest": F.max}
OF_TWO = {"smallest": F.least, "largest": F.greatest}


class MergeIndex:
    """Levels of runs below ``path``; level 0 are memtables as flushed. Keys are whole numbers or strings.

    keep: compaction keeps one identifier of a digest, the smallest or the largest (null only where there is no other), with the
    number of its rows and of its flushed entries; None keeps all identifiers.
    """

    def __init__(self, docs: DataFrame, path: str, memtable_rows: int = 2_000_000, keep: str | None = None) -> None:
        self.spark, self.path, self.memtable_rows, self.keep = docs.sparkSession, path, memtable_rows, keep
        self.sorted = SORTED if keep is None else ("digest",)
        self.memtables: list[str] = []
        self.levels: dict[int, Run] = {}

    def flush(self, rows: DataFrame) -> None:
        """Write rows (key, digest and perhaps copies, else one each) as sorted memtables."""
        path, key = f"{self.path}/memtables-{uuid.uuid4().hex}", F.col("key")
        copies = F.col("copies") if "copies" in rows.columns else F.lit(1).cast("long")
        keyed = rows.select("digest", key.isNotNull().alias("known"), F.coalesce(key, F.lit(0).cast(rows.schema["key"].dataType)).alias("id"), copies.alias("copies"))
        keyed.sortWithinPartitions(*SORTED).write.option("maxRecordsPerFile", self.memtable_rows).parquet(path)
        self.schema = keyed.schema
        self.memtables.append(path)

    def _one(self, rows: DataFrame) -> DataFrame:
        """Rows (digest, known, id, copies) with one row for each digest."""
        least = EXTREME[self.keep](F.when(F.col("known"), F.col("id")))
        found = rows.groupBy("digest").agg(least.alias("key"), F.sum("copies").alias("copies"), F.sum(F.col("keys") if "keys" in rows.columns else F.lit(1)).cast("long").alias("keys"))
        return found.select("digest", *parted("key", self.schema["id"].dataType), "copies", "keys")

    def compact(self) -> None:
        """Merge the memtables to a run of level 1, and two runs of one level to one of the next."""
        if self.memtables:
            rows = self.spark.read.schema(self.schema).parquet(*self.memtables)
            merged = rows.groupBy(*SORTED).agg(F.sum("copies").alias("copies")) if self.keep is None else self._one(rows)
            run, level = self._run(merged, 1), 1
            while level in self.levels:
                other, level = self.levels.pop(level), level + 1
                merged = self._run(self._both(run.rows, other.rows), level)
                for old in (run, other):
                    removed(self.spark, old.path)
                run = merged
            self.levels[level] = run
            for path in self.memtables:
                removed(self.spark, path)
            self.memtables = []

    def _both(self, a: DataFrame, b: DataFrame) -> DataFrame:
        """Two runs as one, bucket by bucket."""
        added = lambda c: (F.coalesce(a[c], F.lit(0)) + F.coalesce(b[c], F.lit(0))).alias(c)
        joined = a.join(b, [*self.sorted], "full_outer")
        if self.keep is None:
            return joined.select(*SORTED, added("copies"))
        key = OF_TWO[self.keep](F.when(a["known"], a["id"]), F.when(b["known"], b["id"]))  # null only if both are
        return joined.select("digest", key.alias("key"), added("copies"), added("keys")).select("digest", *parted("key", self.schema["id"].dataType), "copies", "keys")

    def _run(self, rows: DataFrame, level: int) -> Run:
        path = f"{self.path}/level{level}-{uuid.uuid4().hex}"
        table = bucketed(rows, self.sorted, f"{path}/rows", ordered=True)
        return Run(table, filter_of(table.select("digest"), table.count(), f"{path}/filter"), path)

    def _keyed(self, found: list[DataFrame]) -> DataFrame:
        rows = reduce(DataFrame.union, found)
        if self.keep is None:
            return keyed(rows, len(found))
        rows = rows if len(found) == 1 else self._one(rows)
        return rows.select("digest", F.when(F.col("known"), F.col("id")).alias("key"), "copies", "keys")

    def rows(self) -> DataFrame:
        """digest, key, copies (and, where one identifier is kept, keys) of all runs."""
        return self._keyed([run.rows for run in self.levels.values()])

    def opened(self, digests: DataFrame) -> list[tuple[Run, DataFrame]]:
        """The runs whose filters let one of distinct rows (digest) through, with what they let through."""
        found = [(run, run.filter.passing(digests)) for run in self.levels.values()]
        return [(run, passing) for run, passing in found if not passing.isEmpty()]

    def known(self, digests: DataFrame) -> DataFrame | None:
        """What ``rows`` has for those of distinct rows (digest) that the index has; None where no filter lets one through."""
        found = [run.rows.join(passing.select("digest"), "digest", "left_semi") for run, passing in self.opened(digests)]
        return self._keyed(found) if found else None


def parted(key: str, kind: T.DataType) -> list[Column]:
    """A key as known and id."""
    return [F.col(key).isNotNull().alias("known"), F.coalesce(F.col(key), F.lit(0).cast(kind)).alias("id")]


def keyed(rows: DataFrame, runs: int) -> DataFrame:
    """digest, key, copies of the rows of some runs."""
    rows = rows.select("digest", F.when(F.col("known"), F.col("id")).alias("key"), "copies")
    return rows if runs == 1 else rows.repartition("digest", "key").groupBy("digest", "key").agg(F.sum("copies").alias("copies"))


def by_digest(merged: DataFrame, keep: str = "smallest") -> DataFrame:
    """digest, keep_key, group_size and keys (rows of ``merged``); ``keep`` is smallest or largest."""
    extreme = {"smallest": F.min, "largest": F.max}[keep]
    return merged.groupBy("digest").agg(extreme("key").alias("keep_key"), F.sum("copies").alias("group_size"), F.count("*").alias("keys"))


def verified(texts: DataFrame, hits: Filter, keep: str) -> DataFrame:
    """digest, norm, keep_key, group_size per distinct text that the hits' filter lets through, compared by bytes."""
    extreme = {"smallest": F.min, "largest": F.max}[keep]
    return hits.passing(texts).groupBy("digest", "norm").agg(extreme("key").alias("keep_key"), F.count("*").alias("group_size"))


def groups(docs: DataFrame, keep: str = "smallest", id_col: str = "doc_id", text_col: str = "text", memtable_rows: int = 2_000_000, digest=digest_of, flush_rows: int = 500_000_000) -> DataFrame:
    """Return key, digest, tag, keep_key, group_size, copies, kept_rows per distinct key and text.

    tag parts unequal texts of one digest (null where the digest is one text's alone); kept_rows is 1 for the key and
    text that stay, else 0, of ``copies`` equal rows. The index takes identifiers in two flushes at least, of about ``flush_rows`` rows.
    """
    base = shared_dir(docs.sparkSession)
    texts = docs.select(F.col(id_col).alias("key"), normalised(text_col).alias("norm")).withColumn("digest", digest(F.col("norm")))
    members = written(texts.groupBy("digest", "key").agg(F.count("*").alias("copies")), f"{base}/members")
    total = members.count()
    index, batches = MergeIndex(docs, f"{base}/index", memtable_rows, keep), max(2, -(-total // flush_rows))
    for k in range(batches):
        batch = members.where(F.pmod(F.xxhash64("key", "digest"), F.lit(batches)) == k)
        # Hits: digests that an older run has, if its filter lets them through, and those that the batch has twice.
        met = index.known(batch.select("digest").distinct()) if index.levels else None
        if met is not None:
            met.select("digest").write.parquet(f"{base}/met/{k}")
        index.flush(batch)
        inside = batch.groupBy("digest").agg(F.sum("copies").alias("n")).where("n > 1")
        inside.select("digest").write.parquet(f"{base}/met/{k}-inside")
        index.compact()
    met = docs.sparkSession.read.schema("digest binary").option("recursiveFileLookup", "true").parquet(f"{base}/met").distinct()
    found = index.known(met)
    hits = written(members.select("digest", F.lit(0).cast("long").alias("keys")).limit(0) if found is None else found.select("digest", "keys"), f"{base}/hits")
    n_hits = hits.count()
    compared = verified(texts, filter_of(hits.select("digest"), n_hits, f"{base}/filter"), keep)
    compared = compared.select("digest", F.xxhash64("norm").alias("tag"), F.octet_length("norm").alias("n_bytes"), "keep_key", "group_size")
    compared = written(compared.join(hits, "digest"), f"{base}/compared")  # but what the filter let through for nothing
    clashing = written(compared.groupBy("digest").agg(F.count("*").alias("texts")).where("texts > 1").select("digest"), f"{base}/clashing")
    result = ["digest", "key", "copies", "keep_key", "group_size", "tag"]
    rest, whole, apart = members, compared, None
    if not clashing.isEmpty():  # unequal texts of one digest: their rows are told apart by the text itself
        tagged = texts.join(clashing, "digest", "left_semi").groupBy("digest", "key", F.xxhash64("norm").alias("tag"), F.octet_length("norm").alias("n_bytes")).agg(F.count("*").alias("copies"))
        apart = tagged.join(compared, ["digest", "tag", "n_bytes"]).select(*result)
        rest, whole = members.join(clashing, "digest", "left_anti"), compared.join(clashing, "digest", "left_anti")
    found = dealt_join(rest, whole.select("digest", "keep_key", "group_size", "keys"), ["digest"], "keys", total, "left")
    alone = F.col("group_size").isNull()
    found = found.select("digest", "key", "copies", F.when(alone, F.col("key")).otherwise(F.col("keep_key")).alias("keep_key"), F.coalesce("group_size", "copies").alias("group_size"), F.lit(None).cast("long").alias("tag"))
    found = found if apart is None else found.unionByName(apart)
    return found.withColumn("kept_rows", F.col("key").eqNullSafe(F.col("keep_key")).cast("int"))


def mark(docs: DataFrame, keep: str = "smallest", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Return ``id_col``, keep_id, group_size, kept, text_sha256 per row of ``docs``."""
    found = groups(docs, keep, id_col, text_col)
    rows = found.withColumn("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    kept = (F.col("kept_rows") == 1) & (F.col("row") == 1)
    return rows.select(F.col("key").alias(id_col), F.col("keep_key").alias("keep_id"), "group_size", kept.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def deduplicated(docs: DataFrame, keep: str = "smallest", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; what goes is a table of digests and ids, and texts move only where rows are equal."""
    path = shared_dir(docs.sparkSession)
    with scratch(docs.sparkSession):
        found = groups(docs, keep, id_col, text_col)
        found = written(found.where("kept_rows = 0 or copies > 1").select("key", "digest", "tag", "kept_rows"), f"{path}/rows")
    norm = normalised(text_col)
    key, digest, tag = F.col(id_col), digest_of(norm), F.xxhash64(norm)

    def but(rows: DataFrame, some: DataFrame) -> DataFrame:
        left = without(rows, [key, digest], some.where("tag is null").select("key", "digest"))
        return without(left, [key, digest, tag], some.where("tag is not null").select("key", "digest", "tag"))

    left = but(docs, found.where("kept_rows = 0"))
    repeated = found.where("kept_rows = 1")
    if repeated.isEmpty():
        return left
    # Of equal rows one stays.
    k, d, t, row, first = fresh(docs, "key", "digest", "tag", "row", "first")
    others = [c for c in docs.columns if c not in (id_col, text_col)]
    order = F.to_json(F.struct(*others)) if others else F.lit("")
    equal = docs.withColumns({k: key, d: digest, t: tag}).join(repeated.select(F.col("key").alias("k"), F.col("digest").alias("d"), F.col("tag").alias("t")).toDF(f"{k}_", f"{d}_", f"{t}_"), F.col(k).eqNullSafe(F.col(f"{k}_")) & (F.col(d) == F.col(f"{d}_")) & F.coalesce(F.col(t) == F.col(f"{t}_"), F.lit(True)), "left_semi")
    one = equal.withColumns({row: F.struct(*docs.columns), first: order}).groupBy(k, d, t).agg(F.min_by(row, first).alias(row))
    return but(left, repeated).unionByName(one.select(f"{row}.*"))
