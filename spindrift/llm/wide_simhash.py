"""Near duplicates of a given similarity, by SimHash fingerprints of several words.

The same steps as in ``simhash``, for texts that share about eight shingles in ten or more: such texts differ in too many
of 64 bits for a grid that loses nothing, so fingerprints have ``64 * n_words`` bits, and the grid has several tables of cells for
them. A cell is the counts of sampled one-bit segments; their number grows with the logarithm of the number
of fingerprints, so that strangers in a cell stay as few at any size, and the number of tables grows with it, so that
a pair of the given similarity is found with probability ``RECALL`` at any size (``tables_for``). Within a cell pairs are taken by the Manhattan
distance of the two-bit segments' counts, a lower bound, and then exactly. Two texts of Jaccard similarity s differ in
about ``acos(2 s / (1 + s)) / pi`` of the bits, since each shingle of a text counts once however often it is repeated: 39 +- 6 of 256 at 0.8. ``distance`` 46 covers nine in ten such pairs, 56 nearly all.
The links of ``simhash`` within three bits of its narrow fingerprints are taken in too; both come from one pass over the texts.

Bits only propose groups: within each, texts are joined by pairs whose sets of shingles have the ``similarity``, compared
exactly (``verified_links``); only the texts of proposed groups are read once more for that.

Only distinct fingerprints enter the join. A cell gives each of its members one link, to the first of those it is joined
to there; a cell over ``cell_rows`` is cut into blocks and its pairs of blocks are dealt out.

Null and empty text has fingerprint zero, and all such texts are one group. Rows with null ids have the smallest id of their group.
An empty table gives an empty one; other columns are carried along by ``one_per_group``, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spindrift.llm import simhash
from spindrift.llm.common import BROADCAST_BYTES, byte_parts, bytes_of, dealt_join, given_back, parts_of, scratch, shared_dir, text_or_empty, without, written
from spindrift.llm.connected import components
from spindrift.llm.simhash import embedded_array

CELL_ROWS = 8192
#: Strangers that a cell holds at most, on average.
STRANGERS = 64
LAGS = 128
#: Tables at least, and the share of pairs at SIMILARITY that share a cell and are within the distance.
TABLES = 32
RECALL = 0.95
SIMILARITY = 0.8
#: Rows and shingles of a group that are compared in one place at most; of larger groups each pair of blocks has up to about twice that.
BLOCK_ROWS = 2048
BLOCK_SHINGLES = 2_000_000
#: Words of the bits that stand for a set of shingles.
SKETCH_WORDS = 64
STEP = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def hashes_of(raw: bytes, shingle: int, seed: int) -> np.ndarray:
    """The distinct hashes of a text's shingles, ascending."""
    return fingerprint_and_set(raw, shingle, seed, 0)[1]


def fingerprint_and_set(raw: bytes, shingle: int, seed: int, n_words: int) -> tuple[np.ndarray, np.ndarray]:
    """SimHash of a text's set of shingles (the first word from their XXH64, the others from that hash mixed further), and the distinct hashes, ascending."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    words = raw.lower().split()
    if not words:
        return np.zeros(n_words, dtype=np.uint64), np.zeros(0, dtype=np.uint64)
    joined = b" ".join(words)
    n = max(1, len(words) - shingle + 1)
    stops = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1)
    ends = (stops[len(words) - n :] - 1).tolist()
    starts = [0, *stops[: n - 1].tolist()]
    own = np.unique(np.fromiter((digest(joined[s:e], seed) for s, e in zip(starts, ends, strict=True)), dtype=np.uint64, count=n))
    set_bits = np.zeros(64 * n_words, dtype=np.int64)
    more = (np.arange(n_words, dtype=np.uint64) * STEP)[None, :]
    for a in range(0, len(own) if n_words else 0, 1 << 14):
        hashes = own[a : a + (1 << 14)]
        wide = np.where(more == 0, hashes[:, None], mixed(hashes[:, None] + more)).astype("<u8")
        set_bits += np.unpackbits(wide.view(np.uint8).reshape(-1, 8 * n_words), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * set_bits > len(own), bitorder="little").view("<u8").astype(np.uint64)[:n_words], own


def prints_of(docs: DataFrame, id_col: str, text_col: str, shingle: int, seed: int, n_words: int) -> DataFrame:
    """Return key, fp (narrow), w0, w1, ..., digest (128 bits of the set of shingles) and size (of that set) per row."""
    import xxhash

    rows = docs.select(F.col(id_col).alias("key"), text_or_empty(text_col).alias("text"))
    names = [f"w{k}" for k in range(n_words)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in byte_parts(batches, "text"):
            narrow = np.array([simhash.fingerprint(raw, 3, seed) for raw in texts], dtype=np.uint64).view(np.int64)
            words, digests, sizes = [], [], []
            for raw in texts:
                found, own = fingerprint_and_set(raw, shingle, seed, n_words)
                words.append(found)
                digests.append(xxhash.xxh3_128_digest(own.astype("<u8").tobytes()))
                sizes.append(len(own))
            wide = np.array(words).reshape(-1, n_words).view(np.int64)
            columns = [part.column("key"), pa.array(narrow), *(pa.array(np.ascontiguousarray(wide[:, k])) for k in range(n_words)), pa.array(digests, pa.binary()), pa.array(sizes, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["key", "fp", *names, "digest", "size"])

    return rows.mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, fp long, " + ", ".join(f"{c} long" for c in names) + ", digest binary, size long")


def sets_of(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str, shingle: int, seed: int) -> DataFrame:
    """Sets of shingles of the documents in ``wanted`` (least: a key, digest, and further columns): these columns and shingles, eight bytes each."""
    import xxhash

    keep = [c for c in wanted.columns if c != "least"]
    side = F.broadcast(wanted) if bytes_of(wanted) <= BROADCAST_BYTES else wanted
    rows = docs.select(F.col(id_col).alias("key"), text_or_empty(text_col).alias("text")).join(side, F.col("key").eqNullSafe(F.col("least"))).select(*keep, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in byte_parts(batches, "text"):
            at, sets = [], []
            for k, (raw, digest) in enumerate(zip(texts, part.column("digest").to_pylist(), strict=True)):
                own = hashes_of(raw, shingle, seed).astype("<u8").tobytes()
                if xxhash.xxh3_128_digest(own) == digest:  # ids need not be unique
                    at.append(k)
                    sets.append(own)
            yield pa.RecordBatch.from_arrays([*part.take(pa.array(at, pa.int64())).columns[:-1], pa.array(sets, pa.binary())], [*keep, "shingles"])

    return rows.mapInArrow(run, T.StructType([*(wanted.schema[c] for c in keep), T.StructField("shingles", T.BinaryType())]))


def close(a: np.ndarray, b: np.ndarray, ea: np.ndarray, eb: np.ndarray, distance: int) -> np.ndarray:
    """Rows of a and b within the distance; ea and eb are their embeddings."""
    near = np.bitwise_count(ea ^ eb).sum(axis=1, dtype=np.int64) <= distance
    near[near] = np.bitwise_count(a[near] ^ b[near]).sum(axis=1, dtype=np.int64) <= distance
    return near


def spanning(x: np.ndarray, distance: int) -> Iterator[tuple[int, np.ndarray]]:
    """(member, others it joins): enough to join each component of one cell; what is joined isn't looked for again."""
    rest, e = np.arange(len(x)), embedded_array(x)
    while len(rest) > 1:
        todo, rest = [rest[0]], rest[1:]
        while todo and len(rest):
            of = todo.pop()
            hit = close(x[rest], np.broadcast_to(x[of], (len(rest), x.shape[1])), e[rest], e[of], distance)
            if hit.any():
                yield of, rest[hit]
                todo += rest[hit].tolist()
                rest = rest[~hit]


def first_of(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The first member that each of n is joined to by pairs (u, v)."""
    label = np.arange(n)
    while True:
        least = np.minimum(label[u], label[v])
        after = label.copy()
        np.minimum.at(after, u, least)
        np.minimum.at(after, v, least)
        after = after[after]
        if (after == label).all():
            return label
        label = after


def chosen_bits(n_words: int, tables: int, bits: int, seed: int = 1) -> np.ndarray:
    """The sampled one-bit segments of each table, as masks."""
    rng = np.random.default_rng(seed)
    chosen = np.zeros((tables, n_words), dtype=np.uint64)
    for t in range(tables):
        for b in rng.choice(64 * n_words, bits, replace=False).tolist():
            chosen[t, b // 64] |= np.uint64(1) << np.uint64(b % 64)
    return chosen


def coded(batches: Iterator[pa.RecordBatch], n_words: int, chosen: np.ndarray) -> Iterator[pa.RecordBatch]:
    names = ["vertex", *(f"w{k}" for k in range(n_words))]
    for batch in batches:
        x = words_of(batch, n_words)
        for t in range(len(chosen)):
            code = np.full(len(x), mixed(np.array([t + 1], dtype=np.uint64) * STEP)[0])
            for k in range(n_words):
                code = mixed(code + (x[:, k] & chosen[t, k]) * STEP)
            yield pa.RecordBatch.from_arrays([pa.array(code.view(np.int64)), *(batch.column(c) for c in names)], ["code", *names])


def cells_of(fps: DataFrame, n_words: int, tables: int, bits: int, seed: int = 1) -> DataFrame:
    """(code, vertex, w0, ...) for each table: code stands for the table and the counts of its ``bits`` one-bit segments."""
    chosen = chosen_bits(n_words, tables, bits, seed)
    names = ["vertex", *(f"w{k}" for k in range(n_words))]
    return fps.select(*names).mapInArrow(lambda batches: coded(batches, n_words, chosen), "code long, " + ", ".join(f"{c} long" for c in names))


def words_of(batch: pa.RecordBatch, n_words: int) -> np.ndarray:
    return np.stack([batch.column(f"w{k}").to_numpy(zero_copy_only=False) for k in range(n_words)], axis=1).view(np.uint64)


def links_of(batches: Iterator[pa.RecordBatch], n_words: int, distance: int, cell_rows: int | None = CELL_ROWS, lags: int = LAGS) -> Iterator[pa.RecordBatch]:
    """Rows sorted by code -> links (u, v), and the vertices of overfull cells (code set, u and v the vertex); cell_rows None: no cell is."""
    none = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, n_words), np.uint64))
    held = none
    passing: int | None = None  # an overfull cell whose rows go by

    def out(u: np.ndarray, v: np.ndarray, code: np.ndarray | None = None) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.nulls(len(u), pa.int64()) if code is None else pa.array(code), pa.array(u), pa.array(v)], ["code", "u", "v"])

    def settle(code: np.ndarray, vertex: np.ndarray, x: np.ndarray) -> Iterator[pa.RecordBatch]:
        if not len(code):
            return
        first = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
        size = np.diff(np.r_[first, len(code)])
        group = np.repeat(np.arange(len(first)), size)
        few = size[group] <= lags + 1
        e = embedded_array(x)
        pairs: list[tuple[np.ndarray, np.ndarray]] = []
        for lag in range(1, min(lags, int(size.max()) - 1) + 1):
            at = np.flatnonzero(few[lag:] & (group[lag:] == group[:-lag]))
            at = at[close(x[at + lag], x[at], e[at + lag], e[at], distance)] if len(at) else at
            if len(at):
                pairs.append((at, at + lag))
        if pairs:
            label = first_of(len(code), *map(np.concatenate, zip(*pairs, strict=True)))
            own = np.flatnonzero(label != np.arange(len(code)))
            yield out(vertex[own], vertex[label[own]])
        for k in np.flatnonzero(size > lags + 1):
            a, b = first[k], first[k] + size[k]
            for of, others in spanning(x[a:b], distance):
                yield out(np.repeat(vertex[a + of], len(others)), vertex[a + others])

    for batch in batches:
        given_back()
        code, vertex, x = batch.column("code").to_numpy(zero_copy_only=False), batch.column("vertex").to_numpy(zero_copy_only=False), words_of(batch, n_words)
        if passing is not None:
            same = code == passing
            if same.any():
                yield out(vertex[same], vertex[same], code[same])
                code, vertex, x = code[~same], vertex[~same], x[~same]
            if not len(code):
                continue
            passing = None
        if not len(code):
            continue
        code, vertex, x = (np.concatenate(p) for p in zip(held, (code, vertex, x), strict=True))
        before = np.flatnonzero(code != code[-1])
        cut = before[-1] + 1 if len(before) else 0
        yield from settle(code[:cut], vertex[:cut], x[:cut])
        held = code[cut:], vertex[cut:], x[cut:]
        if cell_rows is not None and len(held[0]) > cell_rows:
            passing = int(held[0][0])
            yield out(held[1], held[1], held[0])
            held = none
    yield from settle(*held)


def bits_for(n: int) -> int:
    """One-bit segments of a cell for n fingerprints."""
    return max(4, math.ceil(math.log2(max(1, n / STRANGERS))))


def recall_of(bits: int, tables: int, distance: int, n_words: int, similarity: float = SIMILARITY) -> float:
    """Probability that a pair of this similarity is within the distance and shares a cell; bits count as independent."""
    size = 64 * n_words
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    total = 0.0
    for d in range(min(distance, size) + 1):
        same = math.comb(size - d, bits) / math.comb(size, bits)
        total += math.comb(size, d) * p**d * (1 - p) ** (size - d) * (1 - (1 - same) ** tables)
    return total


def tables_for(n: int, distance: int, n_words: int) -> int:
    """The fewest tables, from TABLES on, with the stated recall for n fingerprints, or as near to it as the distance allows."""
    bits = bits_for(n)
    within = recall_of(0, 1, distance, n_words)
    aim = min(RECALL, 0.99 * within)
    return next(t for t in count(TABLES) if recall_of(bits, t, distance, n_words) >= aim)


def near_links(fps: DataFrame, base: str, n_words: int, distance: int, tables: int | None = None, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Links (u, v) of rows (vertex, w0, ...) that are within the distance and share a cell, or are joined by others so linked."""
    spark = fps.sparkSession
    n = fps.count()
    bits, tables = bits_for(n), tables or tables_for(n, distance, n_words)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # The smallest vertex comes first, so that the cells of all tables link a dense group to the same few.
    by_code = lambda df: df.repartition(parts, "code").sortWithinPartitions("code", "vertex")
    kind = "code long, u long, v long"
    found = written(by_code(cells_of(fps, n_words, tables, bits)).mapInArrow(lambda batches: links_of(batches, n_words, distance, cell_rows), kind), f"{base}/links")
    links = found.where("code is null").select("u", "v")
    over = found.where("code is not null").select("code", F.col("u").alias("vertex"))
    if over.isEmpty():
        return links
    # Blocks of an overfull cell, and a place for each pair of blocks.
    blocks = F.ceil(F.col("n") * 1.25 / (cell_rows // 2)).cast("int")
    sizes = over.groupBy("code").agg(F.count("*").alias("n"))
    cut = over.join(sizes, "code").withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("vertex"), F.col("blocks")).cast("int"))
    paired = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    place = F.xxhash64("code", F.least("block", "other"), F.greatest("block", "other"))
    dealt = paired.select(place.alias("code"), "vertex").join(fps, "vertex")
    more = by_code(dealt).mapInArrow(lambda batches: links_of(batches, n_words, distance, None), kind)
    return links.union(more.select("u", "v"))


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """A set as bits, one for each member; sets that differ in few members differ in no more bits."""
    out = np.zeros((len(sets), SKETCH_WORDS), dtype=np.uint64)
    for row, x in zip(out, sets, strict=True):
        np.bitwise_or.at(row, (x >> np.uint64(6)) % np.uint64(SKETCH_WORDS), np.uint64(1) << (x & np.uint64(63)))
    return out


def similar_links(vertex: np.ndarray, sets: list[np.ndarray], similarity: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links that join each component of one group by exact Jaccard similarity; each of them is similar enough itself."""
    size = np.array([len(x) for x in sets], dtype=np.int64)
    empty = np.flatnonzero(size == 0)
    if len(empty) > 1:
        yield np.repeat(vertex[empty[0]], len(empty) - 1), vertex[empty[1:]]
    rest = np.flatnonzero(size > 0)
    rest = rest[np.argsort(size[rest], kind="stable")]
    if len(rest) < 2:
        return
    distinct, place = np.unique(np.concatenate(sets), return_inverse=True)
    at = np.r_[0, np.cumsum(size)]
    bits = sketches(sets)
    marked = np.zeros(len(distinct), dtype=bool)
    while len(rest) > 1:
        todo, rest = [rest[0]], rest[1:]
        while todo and len(rest):
            of = todo.pop()
            # Sizes ascend: none outside these bounds can be similar enough.
            a = np.searchsorted(size[rest], math.floor(similarity * size[of] - 1e-9))
            b = np.searchsorted(size[rest], math.ceil(size[of] / similarity + 1e-9), "right")
            if a == b:
                continue
            # Nor can those that differ in too many members.
            both = size[rest[a:b]] + size[of]
            near = a + np.flatnonzero(np.bitwise_count(bits[rest[a:b]] ^ bits[of]).sum(axis=1, dtype=np.int64) <= both * (1 - similarity) / (1 + similarity) + 1e-6)
            if not len(near):
                continue
            own = place[at[of] : at[of + 1]]
            marked[own] = True
            common = np.array([np.count_nonzero(marked[place[at[k] : at[k + 1]]]) for k in rest[near].tolist()])
            marked[own] = False
            hit = np.zeros(len(rest), dtype=bool)
            hit[near] = common >= similarity * (size[of] + size[rest[near]] - common) - 1e-9
            if hit.any():
                yield np.repeat(vertex[of], hit.sum()), vertex[rest[hit]]
                todo += rest[hit].tolist()
                rest = rest[~hit]


def placed_blocks(groups: DataFrame, total: int, block_rows: int = BLOCK_ROWS, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """Rows (vertex, root, size, ...) -> a row for each place (root, low, high) where they are compared.

    A group over a block's rows or shingles is cut into blocks and its pairs of blocks are dealt out.
    """
    sizes = groups.groupBy("root").agg(F.count("*").alias("n"), F.sum("size").alias("m"))
    blocks = F.when((F.col("n") <= block_rows) & (F.col("m") <= block_shingles), 1).otherwise(1 + F.ceil(1.25 * F.greatest(F.col("n") / block_rows, F.col("m") / block_shingles))).cast("int")
    cut = dealt_join(groups, sizes.select("root", "n", blocks.alias("blocks")), ["root"], "n", total).withColumn("block", F.pmod(F.xxhash64("vertex"), F.col("blocks")).cast("int"))
    # A pair of blocks holds both whole, so a block by itself is covered too.
    dealt = cut.withColumn("others", F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: (F.col("blocks") == 1) | (x != F.col("block"))))
    return dealt.drop("blocks", "size", "n")


def verified_links(sets: DataFrame, similarity: float) -> DataFrame:
    """Links (u, v) that join the components by exact similarity within each group of rows (root, vertex, block, others, shingles)."""
    place = ["root", "low", "high"]
    dealt = sets.withColumn("other", F.explode("others")).select("root", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "vertex", "shingles")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, bytes] = {}
        now = None

        def settle() -> Iterator[pa.RecordBatch]:
            if len(held) > 1:
                for u, v in similar_links(np.array(list(held), dtype=np.int64), [np.frombuffer(x, "<u8") for x in held.values()], similarity):
                    yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

        for batch, _ in parts_of(batches, "shingles"):
            for r, low, high, vertex, x in zip(*(batch.column(c).to_pylist() for c in (*place, "vertex", "shingles")), strict=True):
                if (r, low, high) != now:
                    yield from settle()
                    held, now = {}, (r, low, high)
                held[vertex] = x
        yield from settle()

    parts = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(parts, *place).sortWithinPartitions(*place).mapInArrow(run, "u long, v long")


def narrow_links(fps: DataFrame, base: str, total: int) -> DataFrame:
    """Links (u, v) between the vertices of rows (vertex, fp) whose narrow fingerprints are equal or joined by three bits or fewer."""
    reps = written(fps.groupBy("fp").agg(F.min("vertex").alias("rep"), F.count("*").alias("n")), f"{base}/reps")
    roots = components(simhash.near_links(reps.select("fp"), f"{base}/narrow"), f"{base}/narrow")
    joined = written(reps.join(roots.withColumnRenamed("vertex", "fp"), "fp"), f"{base}/joined")
    hubs = joined.groupBy("root").agg(F.min("rep").alias("hub"), F.count("*").alias("m"))
    to_hub = dealt_join(joined.select("root", "rep"), hubs, ["root"], "m", joined.count())
    to_rep = dealt_join(fps.select("fp", "vertex"), reps, ["fp"], "n", total)
    return to_hub.select(F.col("rep").alias("u"), F.col("hub").alias("v")).union(to_rep.select("vertex", "rep"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, distance: int = 56, n_words: int = 4, tables: int | None = None, seed: int = 42, similarity: float = SIMILARITY, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Return key and component_id (smallest id reachable by links of the ``similarity``) per row of ``docs``."""
    base = shared_dir(docs.sparkSession)
    names = [f"w{k}" for k in range(n_words)]
    same = ["fp", *names, "digest"]  # texts of one fingerprint need not have the same shingles
    prints = written(prints_of(docs, id_col, text_col, shingle, seed, n_words), f"{base}/prints")
    fps = prints.groupBy(*same).agg(F.min("key").alias("least"), F.count("*").alias("rows"), F.first("size").alias("size"))
    fps = written(fps.withColumn("vertex", F.monotonically_increasing_id()), f"{base}/fps")
    total = fps.count()
    links = near_links(fps.select("vertex", *names), base, n_words, distance, tables).union(narrow_links(fps, base, total))
    proposed = written(fps.select("vertex", "least", "digest", "size").join(components(links, base), "vertex"), f"{base}/proposed")
    wanted = written(placed_blocks(proposed, proposed.count(), block_rows), f"{base}/wanted")
    found = written(verified_links(sets_of(docs, wanted, id_col, text_col, shingle, seed), similarity), f"{base}/similar")
    roots = components(found, f"{base}/verified")
    linked = written(fps.join(roots, "vertex", "left").select(*same, "least", "rows", F.coalesce("root", "vertex").alias("root")), f"{base}/linked")
    named = linked.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("members"))
    of_print = dealt_join(linked.drop("least"), named, ["root"], "members", total).drop("root")
    return dealt_join(prints.drop("size"), of_print, same, "rows", prints.count()).select("key", "component_id")


def one_per_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how: float | None) -> DataFrame:
    """The rows that stay: of each group the one with its smallest id (rows that share that id stay together)."""
    keep = shared_dir(docs.sparkSession)
    with scratch(docs.sparkSession):
        found = written(near_duplicates(docs, id_col, text_col, **how), f"{shared_dir(docs.sparkSession)}/found")
        own = F.col("key").eqNullSafe(F.col("component_id"))
        stay = found.where(own).select(F.col("key").alias("stay")).distinct()
        gone = found.where(~own).select("key").distinct().join(stay, F.col("key").eqNullSafe(F.col("stay")), "left_anti")
        gone = written(gone, f"{keep}/gone")
    return without(docs, [F.col(id_col)], gone)
