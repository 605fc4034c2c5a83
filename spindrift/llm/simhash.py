"""Near-duplicate detection by SimHash with a segment-popcount embedding.

A fingerprint is embedded as the bit counts of its 32 two-bit segments; written in unary those counts are a word of 64
bits, so that the Manhattan distance of two embeddings is the number of bits in which their words differ. It never
passes the Hamming distance of the fingerprints. Fingerprints within ``3`` of each other agree fully in one of four groups
of eight segments, and then in one of four parts of the remaining 24: the grid has a cell for each of these 16 choices
and the 14 counts in it, and pairs are sought within cells, first by Manhattan distance, then exactly.

Only distinct fingerprints enter the join. A cell yields links that span its components, not all its pairs; a cell
over ``cell_rows`` is cut into blocks and its pairs of blocks are dealt out. Components come from star steps on links.

A fingerprint that very many rows share, and a component of very many fingerprints, is dealt out in the joins that
give rows their component. Null and empty text has fingerprint zero. Component ids are the smallest non-null id
reachable. Repeated rows and ids get a row each, an empty table an empty result; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.llm.common import byte_parts, dealt_join, shared_dir, text_or_empty, written
from spindrift.llm.connected import components

MAX_DISTANCE = 3
EVEN = 0x5555555555555555
CELL_ROWS = 8192
#: Neighbours of a sorted cell that are compared at once; cells with more rows are searched from their members.
LAGS = 8


def masks() -> list[int]:
    """The 16 choices of 28 bits: a group of 16, and a quarter of the other 48."""
    chosen = []
    for i in range(4):
        rest = [b for b in range(64) if b // 16 != i]
        for j in range(4):
            bits = [*range(16 * i, 16 * i + 16), *rest[12 * j : 12 * j + 12]]
            chosen.append(sum(1 << b for b in bits))
    return chosen


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def embedded(fp: Column) -> Column:
    """Unary counts of the two-bit segments."""
    high = F.shiftrightunsigned(fp, 1)
    even = F.lit(signed(EVEN)).cast("long")
    one = fp.bitwiseOR(high).bitwiseAND(even)
    two = fp.bitwiseAND(high).bitwiseAND(even)
    return one.bitwiseOR(F.shiftleft(two, 1))


def embedded_array(fp: np.ndarray) -> np.ndarray:
    high, even = fp >> np.uint64(1), np.uint64(EVEN)
    return ((fp | high) & even) | ((fp & high & even) << np.uint64(1))


def fingerprint(raw: bytes, shingle: int, seed: int) -> int:
    """SimHash of one text's bytes; ASCII letters are lower-cased, words part at ASCII white space."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    words = raw.lower().split()
    n = len(words) - shingle + 1
    if not words:
        return 0
    joined = b" ".join(words)
    if n <= 1:
        return digest(joined, seed)
    stops = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1)
    ends = (stops[shingle - 1 :] - 1).tolist()
    starts = [0, *stops[: n - 1].tolist()]
    set_bits = np.zeros(64, dtype=np.int64)
    for a in range(0, n, 1 << 16):
        hashes = np.array([digest(joined[s:e], seed) for s, e in zip(starts[a : a + (1 << 16)], ends[a : a + (1 << 16)], strict=True)], dtype="<u8")
        set_bits += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * set_bits > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, seed: int = 42) -> DataFrame:
    """Return key, fp long (the 64 bits) per row."""
    rows = docs.select(F.col(id_col).alias("key"), text_or_empty(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in byte_parts(batches, "text"):
            found = np.array([fingerprint(raw, shingle, seed) for raw in texts], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(found.view(np.int64))], ["key", "fp"])

    return rows.mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, fp long")


def close(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Manhattan distance of the embeddings first, then the exact one of what is left."""
    near = np.bitwise_count(embedded_array(a) ^ embedded_array(b)) <= MAX_DISTANCE
    near[near] = np.bitwise_count(a[near] ^ b[near]) <= MAX_DISTANCE
    return near


def spanning(fps: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links from members to others, enough to join each component of one cell: what is linked isn't looked for again."""
    links, rest = [], fps
    while len(rest) > 1:
        todo, rest = [rest[:1]], rest[1:]
        while todo and len(rest):
            of = todo.pop()
            hit = close(rest, np.broadcast_to(of, rest.shape))
            if hit.any():
                found = rest[hit]
                links.append((np.repeat(of, len(found)), found))
                todo += np.split(found, len(found))
                rest = rest[~hit]
    return links


def links_of(batches: Iterator[pa.RecordBatch], cell_rows: int = CELL_ROWS, lags: int = LAGS) -> Iterator[pa.RecordBatch]:
    """Rows (cell, code, fp) sorted by cell and code -> links (u, v), and rows of overfull cells (cell set)."""
    names = ["cell", "code", "u", "v"]
    none = np.zeros(0, dtype=np.int64)
    held = (none, none, none)

    def out(u: np.ndarray, v: np.ndarray, cell: np.ndarray | None = None, code: np.ndarray | None = None) -> pa.RecordBatch:
        empty = pa.nulls(len(u), pa.int64())
        return pa.RecordBatch.from_arrays([empty if cell is None else pa.array(cell), empty if code is None else pa.array(code), pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], names)

    def settle(cell: np.ndarray, code: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        if not len(fp):
            return
        first = np.flatnonzero(np.r_[True, (cell[1:] != cell[:-1]) | (code[1:] != code[:-1])])
        size = np.diff(np.r_[first, len(fp)])
        group = np.repeat(np.arange(len(first)), size)
        few = size[group] <= lags + 1
        x = fp.view(np.uint64)
        for lag in range(1, lags + 1):
            at = np.flatnonzero(few[lag:] & (group[lag:] == group[:-lag]))
            at = at[close(x[at + lag], x[at])] if len(at) else at
            if len(at):
                yield out(x[at], x[at + lag])
        for k in np.flatnonzero(size > lags + 1):
            a, b = first[k], first[k] + size[k]
            for u, v in spanning(x[a:b]):
                yield out(u, v)

    passing: tuple[int, int] | None = None  # an overfull cell whose rows go by
    for batch in batches:
        cell, code, fp = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("cell", "code", "fp"))
        if passing is not None:
            same = (cell == passing[0]) & (code == passing[1])
            if same.any():
                yield out(fp[same], fp[same], cell[same], code[same])
                cell, code, fp = cell[~same], code[~same], fp[~same]
            if not len(fp):
                continue
            passing = None
        if not len(fp):
            continue
        cell, code, fp = (np.concatenate(x) for x in zip(held, (cell, code, fp), strict=True))
        last = np.flatnonzero((cell != cell[-1]) | (code != code[-1]))
        cut = last[-1] + 1 if len(last) else 0
        yield from settle(cell[:cut], code[:cut], fp[:cut])
        held = cell[cut:], code[cut:], fp[cut:]
        if len(held[2]) > cell_rows:
            passing = int(held[0][0]), int(held[1][0])
            yield out(held[2], held[2], held[0], held[1])
            held = none, none, none
    yield from settle(*held)


LINKS = "cell long, code long, u long, v long"


def sorted_cells(cells: DataFrame) -> DataFrame:
    parts = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cells.repartition(parts, "cell", "code").sortWithinPartitions("cell", "code").select("cell", "code", "fp")


def near_links(fps: DataFrame, base: str, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Links (u, v) that join every two fingerprints (column fp, distinct) within the distance, directly or by others so joined."""
    word = embedded(F.col("fp"))
    cells = fps.select("fp", F.posexplode(F.array(*(word.bitwiseAND(F.lit(signed(m)).cast("long")) for m in masks()))).alias("cell", "code"))
    found = written(sorted_cells(cells.withColumn("cell", F.col("cell").cast("long"))).mapInArrow(lambda batches: links_of(batches, cell_rows), LINKS), f"{base}/links")
    links = found.where("cell is null").select("u", "v")
    over = found.where("cell is not null").select("cell", "code", F.col("u").alias("fp"))
    sizes = over.groupBy("cell", "code").agg(F.count("*").alias("n"))
    if over.isEmpty():
        return links
    # Blocks of an overfull cell, and a place for each pair of blocks.
    half = cell_rows // 2
    blocks = over.join(sizes, ["cell", "code"]).withColumn("blocks", F.ceil(F.col("n") * 1.25 / half).cast("int")).withColumn("block", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    paired = blocks.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    place = F.xxhash64("code", F.least("block", "other"), F.greatest("block", "other"))
    dealt = paired.select("cell", place.alias("code"), "fp").repartition(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), "cell", "code")
    more = dealt.sortWithinPartitions("cell", "code").mapInArrow(block_links, LINKS)
    return links.union(more.select("u", "v"))


def block_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Like links_of for pairs of blocks, which are of bounded size."""
    held: list[np.ndarray] = []
    at: tuple[int, int] | None = None

    def settle() -> Iterator[pa.RecordBatch]:
        if held:
            for u, v in spanning(np.concatenate(held).view(np.uint64)):
                empty = pa.nulls(len(u), pa.int64())
                yield pa.RecordBatch.from_arrays([empty, empty, pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["cell", "code", "u", "v"])

    for batch in batches:
        cell, code, fp = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("cell", "code", "fp"))
        first = np.flatnonzero(np.r_[True, (cell[1:] != cell[:-1]) | (code[1:] != code[:-1])]) if len(fp) else []
        for a, b in zip(first, [*first[1:], len(fp)], strict=True):
            here = int(cell[a]), int(code[a])
            if here != at:
                yield from settle()
                held, at = [], here
            held.append(fp[a:b])
    yield from settle()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, seed: int = 42) -> DataFrame:
    """Return key, fp and component_id (smallest id reachable) per row of ``docs``."""
    base = shared_dir(docs.sparkSession)
    prints = written(fingerprints(docs, id_col, text_col, shingle, seed), f"{base}/prints")
    fps = written(prints.groupBy("fp").agg(F.min("key").alias("least"), F.count("*").alias("rows")), f"{base}/fps")
    roots = components(near_links(fps.select("fp"), base), base)
    linked = fps.join(roots.select(F.col("vertex").alias("fp"), "root"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    linked = written(linked, f"{base}/linked")
    named = linked.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("members"))
    of_print = dealt_join(linked.select("fp", "root", "rows"), named, ["root"], "members", linked.count()).select("fp", "component_id", "rows")
    return dealt_join(prints, of_print, ["fp"], "rows", prints.count()).select("key", "fp", "component_id")
