"""Substring dedup: prefix-partitioned suffix trees over words.

Every word position starts a suffix. Texts are packed into slices once, in a table bucketed by slice, so that what later
steps find out comes back to the words without moving them:

1. A leaf of a tree that no other document passes gives nothing, so such suffixes are left out first. Each slice sends
   the fingerprints of its windows, sorted and as steps from one to the next, to bins of equal ranges; a bin
   answers with those that two slices have. Fingerprints are a filter only: what passes is compared by words.
2. The suffixes left are sent, with their words to the window's depth, to groups by prefix. Prefixes are of variable
   length: sampled suffixes are sorted, and every so often one of them is cut to the words that set it off from the one before; these
   prefixes part the sorted suffixes into groups of about ``group_suffixes``. Equal suffixes of a slice travel as one.
3. A group sorts its suffixes by their words; neighbours that agree to the depth of ``window`` words are below one internal
   node. Such a node is a repeat; it belongs to the smallest document below it, and its suffixes in others start words that
   are removed. Runs of such starts are the maximal repeats; nodes below cover no further words, so the tree ends there.
4. Each slice gets its starts back and cuts its words.

A passage that many documents share arrives once for each slice. Prefixes and bins are small arrays: ``SPLITTERS`` prefixes
at most are sent along with tasks; beyond, groups grow.

Null text has no words. Null ids come after all others. Rows with equal ids never cut each other; each is trimmed alone.
An empty table gives an empty one. Further columns are not looked at, whatever their names.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.llm.common import bucketed, byte_parts, shared_dir, text_or_empty

#: Base of the polynomial that fingerprints are; odd, so that it has an inverse among 64-bit numbers.
BASE = 0x9E3779B97F4A7C15
BLOCK = 1 << 16
LAST = np.iinfo(np.int64).max
#: Sampled suffixes for each group.
SAMPLES = 20
#: Prefixes at most, and bytes of one.
SPLITTERS = 4_000_000
PREFIX_BYTES = 64
#: Fingerprints that a bin holds, about.
BIN_PRINTS = 4_000_000
#: Bits of a fingerprint beyond those that number all suffixes: about one suffix in 2**SPARE passes for nothing.
SPARE = 8


def pack(values: np.ndarray) -> bytes:
    """Ascending or small integers: steps, byte planes apart, compressed."""
    import zstandard

    steps = np.diff(values.astype(np.int64), prepend=np.int64(0)).astype("<i8")
    return zstandard.compress(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def unpack(raw: bytes) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.decompress(raw), np.uint8)
    return np.cumsum(np.ascontiguousarray(planes.reshape(8, -1).T).view("<i8").ravel())


def sliced(rows: DataFrame, window: int, slice_bytes: int, sample_every: int) -> DataFrame:
    """Rows (key, text) -> one row for each slice: its documents' keys, numbers of words and words, and sampled suffixes."""

    def packed(number: int, keys: list, lines: list[bytes]) -> pa.RecordBatch:
        import zstandard

        sizes = np.array([line.count(b" ") + 1 if line else 0 for line in lines], dtype=np.int64)
        ends = np.cumsum(np.maximum(sizes - window + 1, 0))
        sample = []
        for at in range(number * 7919 % sample_every, int(ends[-1]), sample_every):
            doc = int(np.searchsorted(ends, at, side="right"))
            first = at - int(ends[doc - 1]) if doc else at
            sample.append(b" ".join(lines[doc].split(b" ")[first : first + window]))
        columns = [
            pa.array([number], pa.int64()), pa.array([int(ends[-1])], pa.int64()), pa.array([keys], pa.list_(pa.int64())), pa.array([pack(sizes)], pa.binary()),
            pa.array([zstandard.compress(b"\n".join(lines), 1)], pa.binary()), pa.array([sample], pa.list_(pa.binary())),
        ]
        return pa.RecordBatch.from_arrays(columns, ["slice", "suffixes", "keys", "sizes", "words", "sample"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, size = TaskContext.get().partitionId() << 32, 0
        keys: list = []
        lines: list[bytes] = []
        for part, texts in byte_parts(batches, "text"):
            for key, text in zip(part.column("key").to_pylist(), texts, strict=True):
                if size and size + len(text) > slice_bytes:
                    yield packed(number, keys, lines)
                    number, size, keys, lines = number + 1, 0, [], []
                keys.append(key)
                lines.append(b" ".join(text.split()))  # ASCII white space only
                size += len(text) + 16
        if keys:
            yield packed(number, keys, lines)

    return rows.mapInArrow(run, "slice long, suffixes long, keys array<long>, sizes binary, words binary, sample array<binary>")


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def prefix_hashes(text: np.ndarray) -> np.ndarray:
    """Sum of each byte by its power of BASE, up to every place of the text."""
    out, base = np.zeros(len(text) + 1, dtype=np.uint64), powers(BASE, BLOCK)
    scale, step = 1, pow(BASE, BLOCK, 1 << 64)
    for a in range(0, len(text), BLOCK):
        part = text[a : a + BLOCK] * base[: len(text) - a]
        np.cumsum(part, out=part)
        out[a + 1 : a + 1 + len(part)] = part * np.uint64(scale) + out[a]
        scale = scale * step % (1 << 64)
    return out


class Slice:
    """Words of a slice (where each begins and ends in its text), the words where a whole window starts, and the window's fingerprint at each."""

    def __init__(self, sizes: bytes, words: bytes, window: int, bits: int) -> None:
        import zstandard

        self.text, self.sizes = zstandard.decompress(words), unpack(sizes)
        raw = np.frombuffer(self.text, np.uint8)
        gap = np.concatenate([[True], (raw == 32) | (raw == 10), [True]])
        self.begins, self.ends = np.flatnonzero(gap[:-1] & ~gap[1:]), np.flatnonzero(gap[1:] & ~gap[:-1])
        self.doc_of_word = np.repeat(np.arange(len(self.sizes)), self.sizes)
        self.starts = np.flatnonzero(np.arange(len(self.begins)) + window <= np.cumsum(self.sizes)[self.doc_of_word])
        a, b = self.begins[self.starts], self.ends[self.starts + window - 1]
        sums, inverse = prefix_hashes(raw), pow(BASE, -1, 1 << 64)
        path = (sums[b] - sums[a]) * powers(inverse, BLOCK)[a % BLOCK] * powers(pow(inverse, BLOCK, 1 << 64), len(raw) // BLOCK + 1)[a // BLOCK]
        path = (path ^ (path >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        path = (path ^ (path >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        self.prints = ((path ^ (path >> np.uint64(31))) >> np.uint64(64 - bits)).astype(np.int64)


def shared_prints(texts: DataFrame, window: int, bits: int, bin_bits: int) -> DataFrame:
    """slice, shared: packed fingerprints of the slice that another slice has too."""
    low = (1 << (bits - bin_bits)) - 1

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, sizes, words in zip(*(batch.column(c).to_pylist() for c in ("slice", "sizes", "words")), strict=True):
                prints = np.sort(Slice(sizes, words, window, bits).prints)
                prints = prints[np.r_[True, prints[1:] != prints[:-1]]] if len(prints) else prints
                edges = np.flatnonzero(np.r_[True, (prints[1:] >> (bits - bin_bits)) != (prints[:-1] >> (bits - bin_bits)), True]) if len(prints) else [0]
                parts = [prints[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([int(p[0] >> (bits - bin_bits)) for p in parts], pa.int64()), pa.array([number] * len(parts), pa.int64()), pa.array([pack(p & low) for p in parts], pa.binary())], ["bin", "slice", "prints"])

    def answer(table: pa.Table) -> pa.Table:
        found = [unpack(p) for p in table.column("prints").to_pylist()]
        every = np.sort(np.concatenate(found))
        twice = np.unique(every[1:][every[1:] == every[:-1]])
        high = table.column("bin")[0].as_py() << (bits - bin_bits)
        both = [np.intersect1d(f, twice, assume_unique=True) for f in found]
        return pa.table({"slice": table.column("slice"), "shared": pa.array([pack(b | high) if len(b) else None for b in both], pa.binary())})

    sent = texts.select("slice", "sizes", "words").mapInArrow(send, "bin long, slice long, prints binary")
    return sent.groupBy("bin").applyInArrow(answer, "slice long, shared binary").where("shared is not null")


def splitters(texts: DataFrame, suffixes: int, group_suffixes: int) -> list[bytes]:
    """Prefixes of variable length that part the sorted suffixes into groups."""
    if suffixes <= group_suffixes:
        return []
    groups = -(-suffixes // group_suffixes)
    every = SAMPLES * groups // min(groups, SPLITTERS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, before = 0, b""
        for batch in batches:
            found = []
            for line in batch.column("line").to_pylist():
                n += 1
                if n % every == 0:
                    words, other = line.split(b" "), before.split(b" ")
                    common = next((k for k, (x, y) in enumerate(zip(words, other, strict=False)) if x != y), min(len(words), len(other)))
                    found.append(b" ".join(words[: common + 1])[:PREFIX_BYTES])  # parts the sorted suffixes as well
                before = line
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary())], ["prefix"])

    lines = texts.select(F.explode("sample").alias("line")).orderBy("line")
    return sorted({bytes(row.prefix) for row in lines.mapInArrow(run, "prefix binary").collect()})  # SPLITTERS at most


def repeated_suffixes(texts: DataFrame, shared: DataFrame, window: int, bits: int, prefixes: list[bytes]) -> DataFrame:
    """Suffixes that may have an equal one in another document, by group: sorted lines of words, their smallest ids and places.

    A place is a word's number in the slice. gone: places of suffixes that a smaller document of the slice has.
    """
    spark = texts.sparkSession
    known = spark.sparkContext.broadcast(prefixes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield of_slice(row)

    def of_slice(row: dict) -> pa.RecordBatch:
        import zstandard

        part = Slice(row["sizes"], row["words"], window, bits)
        keys = np.array([LAST if k is None else k for k in row["keys"]], dtype=np.int64)
        owner = keys[part.doc_of_word[part.starts]]
        elsewhere, many = np.zeros(len(owner), dtype=bool), np.zeros(len(owner), dtype=bool)
        order = np.argsort(part.prints, kind="stable")
        if len(order):
            ascending, owners = part.prints[order], owner[order]
            first = np.flatnonzero(np.r_[True, ascending[1:] != ascending[:-1]])
            differ = np.minimum.reduceat(owners, first) != np.maximum.reduceat(owners, first)
            many[order] = np.repeat(differ, np.diff(np.r_[first, len(order)]))
            if row["shared"]:
                known_ones = np.sort(np.concatenate([unpack(x) for x in row["shared"]]))
                at = np.minimum(np.searchsorted(known_ones, ascending), len(known_ones) - 1)
                elsewhere[order] = known_ones[at] == ascending
        some = np.flatnonzero(elsewhere | many)
        # Lines of words, each once.
        text, at = part.text, part.starts[some]
        lines: dict[bytes, int] = {}
        line = np.fromiter((lines.setdefault(text[a:b], len(lines)) for a, b in zip(part.begins[at].tolist(), part.ends[at + window - 1].tolist(), strict=True)), dtype=np.int64, count=len(some))
        least = np.full(len(lines), LAST, dtype=np.int64)
        np.minimum.at(least, line, owner[some])
        own = owner[some] == least[line]
        sent = np.zeros(len(lines), dtype=bool)
        sent[line[elsewhere[some]]] = True
        names = list(lines)
        by_words = sorted(np.flatnonzero(sent).tolist(), key=names.__getitem__)
        rank = np.full(len(lines), -1, dtype=np.int64)
        rank[by_words] = np.arange(len(by_words))
        use = np.flatnonzero(own & sent[line])
        use = use[np.argsort(rank[line[use]], kind="stable")]  # places by line
        of, place = rank[line[use]], at[use]
        group = np.array([bisect_right(known.value, names[k]) for k in by_words], dtype=np.int64)
        edges = np.flatnonzero(np.r_[True, group[1:] != group[:-1], True]) if len(group) else np.zeros(1, dtype=np.int64)
        out: tuple[list, ...] = ([], [], [], [], [], [])
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            i, j = np.searchsorted(of, [a, b])
            values = (int(group[a]), zstandard.compress(b"\n".join([names[k] for k in by_words[a:b]]), 3), pack(least[by_words[a:b]]), pack(of[i:j] - a), pack(place[i:j]), None)
            for column, value in zip(out, values, strict=True):
                column.append(value)
        if not own.all():
            for column, value in zip(out, (int(row["slice"]) % (len(known.value) + 1), None, None, None, None, pack(np.sort(at[~own]))), strict=True):
                column.append(value)
        return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array([row["slice"]] * len(out[0]), pa.int64()), *(pa.array(c, pa.binary()) for c in out[1:])], ["prefix", "slice", "lines", "owners", "of", "places", "gone"])

    answers = shared.groupBy("slice").agg(F.collect_list("shared").alias("shared"))  # a fingerprint of each of the slice's suffixes at most
    joined = texts.select("slice", "keys", "sizes", "words").join(answers.hint("shuffle_hash"), "slice", "left")
    return joined.mapInArrow(run, "prefix long, slice long, lines binary, owners binary, of binary, places binary, gone binary")


def deep_nodes(lines: list[bytes]) -> list[tuple[int, int]]:
    """Ranges of the sorted suffixes below each internal node at the window's depth: neighbours that agree in all words to there."""
    nodes, first = [], 0
    for k in range(1, len(lines) + 1):
        if k == len(lines) or lines[k] != lines[first]:
            if k - first > 1:
                nodes.append((first, k))
            first = k
    return nodes


def removals(suffixes: DataFrame) -> DataFrame:
    """slice, gone: packed places of suffixes that a smaller document has."""

    def subtree(table: pa.Table) -> pa.Table:
        import zstandard

        lines: list[bytes] = []
        owners, begins = [np.zeros(0, dtype=np.int64)], []
        rows = table.select(["lines", "owners", "of", "places", "gone"]).to_pylist()
        for row in rows:
            begins.append(len(lines))
            if row["lines"] is not None:
                lines += zstandard.decompress(row["lines"]).split(b"\n")
                owners.append(unpack(row["owners"]))
        owner = np.concatenate(owners)
        order = sorted(range(len(lines)), key=lines.__getitem__)  # runs of sorted lines merge
        taken = np.zeros(len(lines), dtype=bool)
        for a, b in deep_nodes([lines[k] for k in order]):
            below = np.array(order[a:b])
            taken[below] = owner[below] > owner[below].min()
        found = []
        for begin, row in zip(begins, rows, strict=True):
            gone = unpack(row["gone"]) if row["gone"] is not None else np.zeros(0, dtype=np.int64)
            if row["lines"] is not None:
                place = unpack(row["places"])
                gone = np.concatenate([gone, place[taken[begin + unpack(row["of"])]]])
            found.append(pack(np.sort(gone)) if len(gone) else None)
        return pa.table({"slice": table.column("slice"), "gone": pa.array(found, pa.binary())})

    return suffixes.groupBy("prefix").applyInArrow(subtree, "slice long, gone binary").where("gone is not null")


def cut_out(texts: DataFrame, gone: DataFrame, window: int) -> DataFrame:
    """key, n_words, n_removed, text: each text's words but those in removed windows, joined by a space; spans of the removed ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        for batch in batches:
            for row in batch.to_pylist():
                sizes, lines = unpack(row["sizes"]), zstandard.decompress(row["words"]).split(b"\n")
                edge = np.zeros(int(sizes.sum()) + 1, dtype=np.int64)
                for x in row["gone"] or ():
                    at = unpack(x)
                    np.add.at(edge, at, 1)
                    np.add.at(edge, at + window, -1)
                covered = np.cumsum(edge[:-1]) > 0
                ends = np.cumsum(sizes)
                n_removed = np.r_[0, np.cumsum(covered)][ends] - np.r_[0, np.cumsum(covered)][ends - sizes]
                spans: list[list] = [[] for _ in lines]
                for k in np.flatnonzero(n_removed).tolist():
                    inside = covered[ends[k] - sizes[k] : ends[k]]
                    turns = np.flatnonzero(np.diff(np.r_[False, inside, False].astype(np.int8)))
                    spans[k] = [{"first": int(a), "n": int(b - a)} for a, b in zip(turns[::2], turns[1::2], strict=True)]
                    words = lines[k].split(b" ")
                    lines[k] = b" ".join([words[i] for i in np.flatnonzero(~inside).tolist()])
                columns = [pa.array(row["keys"], pa.int64()), pa.array(sizes), pa.array(n_removed), pa.array(lines, pa.binary()).cast(pa.string()), pa.array(spans, pa.list_(pa.struct([("first", pa.int64()), ("n", pa.int64())])))]
                yield pa.RecordBatch.from_arrays(columns, ["key", "n_words", "n_removed", "text", "spans"])

    places = gone.groupBy("slice").agg(F.collect_list("gone").alias("gone"))  # a place for each of the slice's suffixes at most
    joined = texts.select("slice", "keys", "sizes", "words").join(places.hint("shuffle_hash"), "slice", "left")
    return joined.mapInArrow(run, "key long, n_words long, n_removed long, text string, spans array<struct<first:long,n:long>>")


def trimmed(docs: DataFrame, window: int = 13, group_suffixes: int = 1_500_000, slice_bytes: int = 6 << 20, id_col: str = "doc_id", text_col: str = "text", print_bits: int | None = None) -> DataFrame:
    """Return ``id_col``, n_words, n_removed, text (what is left, joined by spaces) and spans (of the removed words) per row of ``docs``.

    ``print_bits``: bits of the filter's fingerprints, by default as many as the number of suffixes asks for; the result does not depend on it.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("key"), text_or_empty(text_col).alias("text"))
    texts = bucketed(sliced(rows, window, slice_bytes, max(1, group_suffixes // SAMPLES)), "slice", f"{shared_dir(docs.sparkSession)}/slices")
    suffixes = texts.agg(F.sum("suffixes")).first()[0] or 0
    bits = min(62, print_bits or max(16, suffixes.bit_length() + SPARE))
    bin_bits = min(bits - 1, max(0, (suffixes // BIN_PRINTS).bit_length()))
    shared = shared_prints(texts, window, bits, bin_bits)
    left = repeated_suffixes(texts, shared, window, bits, splitters(texts, suffixes, group_suffixes))
    return cut_out(texts, removals(left), window).withColumnRenamed("key", id_col)
