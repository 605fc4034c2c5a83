"""Vector code compression: product codes of whole-number vectors, their codebooks fitted by Lloyd rounds over heaps.

Each component x becomes floor(1024 x); a vector is cut into equal parts, and each part position has a codebook. A part that is
looked at gets its exact distances to all entries; the gap between the nearest and the second (lower minus upper bound) is its slack. Entries
then move, and a part can only change its entry once the moves of its own entry and of the fastest other have used the slack up. Vectors
lie in blocks. A block keeps a heap for each part position and entry, with slack plus the entry's drift so far as key, so
that a round pops from the top only the parts whose key the entry's drift has passed; these are compared
with all entries again and pushed to the heap of what they chose. All others are not looked at.

A round writes blocks with their heaps into the shared folder and what changed in each entry's sum and count; these changes are added up over
blocks in Spark. The driver holds codebooks, sums and drifts only (parts x entries x length numbers). Distances and sums are exact whole numbers.

Vectors that are null, empty or hold a null or non-finite component are left out, and so are vectors of another length than that with the
smallest identifier; lengths that the parts do not divide are filled up with zeros. Null identifiers come after all others, equal
ones are ordered by their vectors. Fewer vectors than entries give fewer entries. Components are held within 2**40 in size, errors
and their sums within a long. Repeated rows count each; an empty table gives an empty one. Further columns are not looked at, whatever their names.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from decimal import Decimal
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.llm.common import BROADCAST_BYTES, dealt_join, removed, shared_dir, written

SCALE = 1024
LARGEST = 1 << 40
#: Share of a bound by which rounding may be off, many times over.
SLOPE = 1e-9


def whole(vectors: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(vectors.astype(np.float64) * SCALE), -LARGEST, LARGEST).astype(np.int64)


def cut(values: np.ndarray, parts: int) -> np.ndarray:
    """Rows x length -> parts x rows x length of a part, filled up with zeros."""
    width = -(-values.shape[1] // parts)
    full = np.zeros((len(values), parts * width), dtype=np.int64)
    full[:, : values.shape[1]] = values
    return np.ascontiguousarray(full.reshape(len(values), parts, width).transpose(1, 0, 2))


def exact(x: np.ndarray, book: np.ndarray) -> type:
    """A type in which squared distances come out exactly: floats below 2**53, else Python's integers."""
    size = max((int(np.abs(a).max(initial=0)) for a in (x, book)), default=0)
    return np.float64 if 4 * x.shape[1] * size * size < 1 << 53 else object


def scanned(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest entry of each part (the lower of equals), and the slack to the second."""
    kind = exact(x, book)
    a, c = x.astype(kind), book.astype(kind)
    squares = (a * a).sum(axis=1)[:, None] + (c * c).sum(axis=1)[None, :] - 2 * (a @ c.T)
    nearest = squares.argmin(axis=1)
    if len(book) == 1:
        return nearest, np.full(len(x), np.inf)
    first = np.sqrt(np.take_along_axis(squares, nearest[:, None], 1)[:, 0].astype(np.float64))
    np.put_along_axis(squares, nearest[:, None], 1 << 200 if kind is object else np.inf, 1)
    second = np.sqrt(squares.min(axis=1).astype(np.float64))
    return nearest, (second - first) - SLOPE * (second + first) - SLOPE


class Heaps(NamedTuple):
    """A block's heaps of one part position, one after the other: keys and rows in heap order, and where each entry's begins."""

    keys: np.ndarray
    rows: np.ndarray
    starts: np.ndarray

    def heap(self, entry: int) -> list[tuple[float, int]]:
        a, b = self.starts[entry : entry + 2]
        return list(zip(self.keys[a:b].tolist(), self.rows[a:b].tolist(), strict=True))


def joined(heaps: list[tuple[np.ndarray, np.ndarray]]) -> Heaps:
    starts = np.cumsum([0, *(len(k) for k, _ in heaps)])
    return Heaps(np.concatenate([k for k, _ in heaps]), np.concatenate([r for _, r in heaps]), starts)


def as_arrays(heap: list[tuple[float, int]]) -> tuple[np.ndarray, np.ndarray]:
    return np.array([k for k, _ in heap], dtype=np.float64), np.array([r for _, r in heap], dtype=np.int32)


def advanced(x: np.ndarray, book: np.ndarray, drift: np.ndarray, codes: np.ndarray | None, heaps: Heaps | None) -> tuple[np.ndarray, Heaps, np.ndarray]:
    """One round of a block at one part position: codes, heaps and the rows that were looked at."""
    opened: dict[int, list[tuple[float, int]]] = {}
    if codes is None or heaps is None:
        codes, popped = np.zeros(len(x), dtype=np.int32), np.arange(len(x))
        opened = {e: [] for e in range(len(book))}
    else:
        found: list[int] = []
        for e in range(len(book)):
            a, b = heaps.starts[e : e + 2]
            if a < b and heaps.keys[a] <= drift[e]:  # the top
                heap = opened[e] = heaps.heap(e)
                while heap and heap[0][0] <= drift[e]:
                    found.append(heapq.heappop(heap)[1])
        codes, popped = codes.copy(), np.array(sorted(found), dtype=np.int64)
    if len(popped):
        nearest, slack = scanned(x[popped], book)
        codes[popped] = nearest
        for e, key, row in zip(nearest.tolist(), (slack + drift[nearest]).tolist(), popped.tolist(), strict=True):
            if e not in opened:
                opened[e] = heaps.heap(e)
            heapq.heappush(opened[e], (key, row))
    if heaps is None:
        return codes, joined([as_arrays(opened[e]) for e in range(len(book))]), popped
    parted = [as_arrays(opened[e]) if e in opened else (heaps.keys[heaps.starts[e] : heaps.starts[e + 1]], heaps.rows[heaps.starts[e] : heaps.starts[e + 1]]) for e in range(len(book))]
    return codes, joined(parted), popped


def packed(values: np.ndarray) -> bytes:
    """Whole numbers in the smallest type that holds them."""
    kind = next(t for t in ("<i2", "<i4", "<i8") if not values.size or (np.iinfo(t).min <= values.min() and values.max() <= np.iinfo(t).max))
    return kind.encode() + values.astype(kind).tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, raw[:3].decode(), offset=3).astype(np.int64)


STATE = ("codes", "keys", "rows", "starts", "changes")


def blocks(rows: DataFrame, parts: int, length: int, block_rows: int) -> DataFrame:
    """Rows (key, label, vector) -> one row for each block of vectors: keys, labels, values and an empty state."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            for at in range(0, batch.num_rows, block_rows):
                held.append(batch.slice(at, block_rows))
                if sum(b.num_rows for b in held) >= block_rows:
                    yield block(held)
                    held = []
        if held:
            yield block(held)

    def block(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        flat = pa.compute.list_flatten(table.column("vector").combine_chunks()).to_numpy(zero_copy_only=False)
        values = cut(whole(flat.reshape(-1, length)), parts)
        lists = [pa.ListArray.from_arrays(pa.array([0, table.num_rows], pa.int32()), table.column(c).combine_chunks()) for c in ("key", "label")]
        return pa.RecordBatch.from_arrays([*lists, pa.array([packed(values)], pa.binary()), *(pa.array([None], pa.binary()) for _ in STATE)], ["key", "label", "vectors", *STATE])

    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("key", "label")}
    schema = f"key array<{kinds['key']}>, label array<{kinds['label']}>, vectors binary, " + ", ".join(f"{c} binary" for c in STATE)
    return rows.mapInArrow(run, schema)


class Books(NamedTuple):
    """Codebooks (parts x entries x length), and each entry's drift so far."""

    entries: np.ndarray
    drift: np.ndarray

    @property
    def parts(self) -> int:
        return len(self.entries)

    def values(self, raw: bytes) -> np.ndarray:
        return unpacked(raw).reshape(self.parts, -1, self.entries.shape[2])

    def round(self, row: dict) -> tuple[np.ndarray, np.ndarray, list[Heaps], np.ndarray]:
        """values, codes, heaps and the codes before of a block, after a round."""
        x = self.values(row["vectors"])
        n, k = x.shape[1], self.entries.shape[1]
        before = np.full((self.parts, n), -1) if row["codes"] is None else unpacked(row["codes"]).reshape(self.parts, n)
        codes, heaps = np.empty_like(before), []
        if row["codes"] is not None:
            old_keys, old_rows = np.frombuffer(row["keys"]).reshape(self.parts, n), unpacked(row["rows"]).reshape(self.parts, n)
            starts = unpacked(row["starts"]).reshape(self.parts, k + 1)
        for p in range(self.parts):
            old = None if row["codes"] is None else Heaps(old_keys[p], old_rows[p], starts[p])
            codes[p], now, _ = advanced(x[p], self.entries[p], self.drift[p], None if old is None else before[p], old)
            heaps.append(now)
        return x, codes, heaps, before


def changes(x: np.ndarray, before: np.ndarray, after: np.ndarray, entries: int) -> np.ndarray:
    """What a round changed: parts x entries x (count, sums)."""
    found = np.zeros((len(x), entries, x.shape[2] + 1), dtype=np.int64)
    for p in range(len(x)):
        moved = np.flatnonzero(before[p] != after[p])
        lines = np.concatenate([np.ones((len(moved), 1), dtype=np.int64), x[p][moved]], axis=1)
        np.add.at(found[p], after[p][moved], lines)
        known = before[p][moved] >= 0
        np.subtract.at(found[p], before[p][moved][known], lines[known])
    return found


def one_round(table: DataFrame, books: Books, path: str) -> DataFrame:
    """Blocks after a round, written to ``path``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                part = batch.slice(at, 1)
                x, codes, heaps, before = books.round({c: part.column(c)[0].as_py() for c in ("vectors", *STATE)})
                state = (
                    packed(codes), np.concatenate([h.keys for h in heaps]).tobytes(), packed(np.concatenate([h.rows for h in heaps])), packed(np.concatenate([h.starts for h in heaps])),
                    packed(changes(x, before, codes, books.entries.shape[1])),
                )
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("key", "label", "vectors")), *(pa.array([s], pa.binary()) for s in state)], part.schema.names)

    return written(table.mapInArrow(run, table.schema), path)


def summed(table: DataFrame, shape: tuple[int, int, int]) -> np.ndarray:
    """Changes of all blocks added up: parts x entries x (count, sums) of whole numbers."""
    parts, entries, width = shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((parts, entries, width), dtype=object)
        for batch in batches:
            for raw in batch.column("changes").to_pylist():
                total += unpacked(raw).reshape(parts, entries, width)
        some = np.argwhere((total != 0).any(axis=2))
        values = [[Decimal(int(v)) for v in total[p, e]] for p, e in some]
        yield pa.RecordBatch.from_arrays([pa.array(some[:, 0], pa.int32()), pa.array(some[:, 1], pa.int32()), pa.array(values, pa.list_(pa.decimal128(38, 0)))], ["part", "entry", "changed"])

    found = table.select("changes").mapInArrow(run, "part int, entry int, changed array<decimal(38,0)>")
    sums = found.groupBy("part", "entry").agg(*(F.sum(F.col("changed")[k]).alias(f"s{k}") for k in range(width)))
    total = np.zeros(shape, dtype=object)
    for row in sums.collect():  # a row for each entry
        total[row[0], row[1]] = [int(v) for v in row[2:]]
    return total


def moved(books: Books, total: np.ndarray) -> Books:
    """Each entry to the mean of its parts, rounded down; unused ones stay."""
    entries = books.entries.copy()
    for p, e in np.argwhere(total[:, :, 0] != 0):
        entries[p, e] = [v // total[p, e, 0] for v in total[p, e, 1:]]
    steps = np.sqrt(((entries - books.entries).astype(np.float64) ** 2).sum(axis=2)) * (1 + SLOPE)
    order = np.sort(steps, axis=1)
    fastest = order[:, -1:]
    others = np.where(steps == fastest, order[:, -2:-1] if steps.shape[1] > 1 else 0.0, fastest)
    return Books(entries, (books.drift + steps + others) * (1 + SLOPE))


def coded(table: DataFrame, books: Books) -> DataFrame:
    """key, label, codes (one for each part) and error (squared distance, summed over parts) per vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                part = batch.slice(at, 1)
                x, codes, _, _ = books.round({c: part.column(c)[0].as_py() for c in ("vectors", *STATE)})
                error = np.zeros(x.shape[1], dtype=object)
                for p in range(books.parts):
                    gap = x[p] - books.entries[p][codes[p]]
                    error += (gap.astype(exact(x[p], books.entries[p])) ** 2).sum(axis=1).astype(object)
                largest = np.iinfo(np.int64).max
                values = [pa.array(codes.T.tolist(), pa.list_(pa.int32())), pa.array([min(int(e), largest) for e in error], pa.int64())]
                yield pa.RecordBatch.from_arrays([part.column("key").flatten(), part.column("label").flatten(), *values], ["key", "label", "codes", "error"])

    kinds = {c: table.schema[c].dataType.elementType.simpleString() for c in ("key", "label")}
    return table.mapInArrow(run, f"key {kinds['key']}, label {kinds['label']}, codes array<int>, error long")


def compressed(
    vectors: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", block_rows: int = 8192,
) -> tuple[DataFrame, Books]:
    """Return rows (``id_col``, ``label_col``, codes, error) and the codebooks after ``rounds`` rounds."""
    spark = vectors.sparkSession
    usable = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & (F.size("vector") > 0)
    rows = vectors.select(F.col(id_col).alias("key"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("vector")).where("vector is not null").where(usable)
    first = rows.orderBy(F.col("key").asc_nulls_last(), "vector").limit(1).collect()
    if not first:
        empty = spark.createDataFrame([], f"key {rows.schema['key'].dataType.simpleString()}, label {rows.schema['label'].dataType.simpleString()}, codes array<int>, error long")
        return empty.withColumnsRenamed({"key": id_col, "label": label_col}), Books(np.zeros((parts, 0, 0), dtype=np.int64), np.zeros((parts, 0)))
    length = len(first[0].vector)
    rows = rows.where(F.size("vector") == length)
    start = rows.orderBy(F.col("key").asc_nulls_last(), "vector").limit(entries).collect()  # as many rows as entries
    books = cut(whole(np.array([row.vector for row in start])), parts)
    books = Books(books, np.zeros(books.shape[:2]))
    base = shared_dir(spark)
    table, path = written(blocks(rows, parts, length, block_rows), f"{base}/round0"), f"{base}/round0"
    total = np.zeros((*books.entries.shape[:2], books.entries.shape[2] + 1), dtype=object)
    for k in range(1, rounds + 1):
        after = one_round(table, books, f"{base}/round{k}")
        total = total + summed(after, total.shape)
        books = moved(books, total)
        removed(spark, path)
        table, path = after, f"{base}/round{k}"
    found = written(coded(table, books), f"{base}/codes")
    removed(spark, path)
    return found.withColumnsRenamed({"key": id_col, "label": label_col}), books


def with_label_error(found: DataFrame, label_col: str = "label") -> DataFrame:
    """Add label_error, the error summed over rows of equal label, nulls together."""
    known, value = F.col(label_col).isNotNull().alias("known"), F.coalesce(F.col(label_col).cast("string"), F.lit("")).alias("value")
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(np.iinfo(np.int64).max).cast("decimal(38,0)")).cast("long")
    sums = found.groupBy(known, value).agg(total.alias("label_error"), F.count("*").alias("n"))
    size = sums.agg(F.sum(F.octet_length("value") + 32), F.sum("n")).first()
    rows = found.withColumns({"known": known, "value": value})
    if (size[0] or 0) <= BROADCAST_BYTES:
        return rows.join(F.broadcast(sums.drop("n")), ["known", "value"]).drop("known", "value")
    return dealt_join(rows, sums, ["known", "value"], "n", size[1]).drop("known", "value")


def digest(books: Books) -> str:
    """SHA-256 of all entries' components in decimal, by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(map(str, books.entries.ravel().tolist())).encode()).hexdigest()
