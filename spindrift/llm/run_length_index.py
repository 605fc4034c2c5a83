"""Suffix-array dedup of bytes: run-length indexes of routed lines, whose sampled run ends give the matching statistics.

A window is ``length`` consecutive bytes of one text. Its anchor is the least fingerprint of the ``gram``-byte strings inside, so equal windows have
equal anchors. Consecutive windows of one anchor make a line of text that holds these windows and no others.

1. Texts are packed into slices once, with their anchors, in a table bucketed by slice, so that what is found out comes back to them.
   Each slice sends its anchors to bins of equal ranges; a bin answers with those that two slices have.
2. Lines of anchors that occur once stay behind. The others are routed by anchor, equal lines of a slice as one. An anchor of more than
   ``hot_lines`` lines is split: fingerprints of its windows are exchanged in the same way, and windows that two places share are routed by themselves.
3. A group sorts the suffixes of its distinct lines, keeps the Burrows-Wheeler transform as runs, and samples both
   ends of every run: the suffix there and how far it agrees with the suffix across the border. Inside a run the agreement falls by one from byte to
   byte, so one pass over the text turns the samples into the longest match of every byte with any other place. Windows whose match reaches
   ``length`` are marked; a line that has several places is marked whole. Fingerprints only route: what is marked was compared by bytes.
4. Each slice gets its marked windows back and cuts their bytes.

Null text counts as empty. Rows with equal ids are judged like others; ids may be null. An empty table gives an empty one.
Further columns are not looked at, whatever their names. A text longer than a slice is a slice of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.llm.common import bucketed, byte_parts, shared_dir, text_or_empty, written
from spindrift.llm.substring_dedup import BASE, BLOCK, pack, powers, prefix_hashes, unpack

#: Positions whose fingerprints are worked out at once; their number fits into the low bits of a key.
PLACE_BITS = 20
#: Windows of a line at most.
LINE_WINDOWS = 4096
#: Fingerprints that a bin holds, about.
BIN_PRINTS = 4_000_000
#: No byte of UTF-8.
BETWEEN = 0xFF


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prints(raw: np.ndarray, places: np.ndarray, size: int) -> np.ndarray:
    """Fingerprints of the ``size`` bytes from each place on."""
    sums, inverse = prefix_hashes(raw), pow(BASE, -1, 1 << 64)
    found = (sums[places + size] - sums[places]) * powers(inverse, BLOCK)[places % BLOCK]
    return mixed(found * powers(pow(inverse, BLOCK, 1 << 64), len(raw) // BLOCK + 1)[places // BLOCK])


def anchored(raw: np.ndarray, ends: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lines of texts that end at ``ends``: first window, number of windows, anchor, and whether the anchor occurs in the line more than once."""
    width, step = length - gram + 1, (1 << PLACE_BITS) - length
    low = np.uint64((1 << PLACE_BITS) - 1)
    found: list[tuple[np.ndarray, ...]] = []
    for a in range(0, max(0, len(raw) - length + 1), step):
        n = min(step, len(raw) - length + 1 - a)
        part = raw[a : a + n + length - 1]
        grams = prints(part, np.arange(len(part) - gram + 1), gram)
        keys = np.full(-(-len(grams) // width) * width, np.iinfo(np.uint64).max, dtype=np.uint64)
        keys[: len(grams)] = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
        # The least key of every ``width`` consecutive ones: of what is left of a block, and of what has begun of the next.
        cells = keys.reshape(-1, width)
        rest = np.minimum.accumulate(cells[:, ::-1], axis=1)[:, ::-1].ravel()
        begun = np.minimum.accumulate(cells, axis=1).ravel()
        least = (np.minimum(rest[:n], begun[width - 1 : width - 1 + n]) & low).astype(np.int64)
        end = ends[np.searchsorted(ends, np.arange(a, a + n), side="right")]
        whole = np.flatnonzero(np.arange(a, a + n) + length <= end)
        found.append((whole + a, least[whole] + a, grams[least[whole]]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, bool)
    window, place, value = (np.concatenate(x) for x in zip(*found, strict=True))
    if not len(window):
        return window, window, value, window > 0
    new = np.r_[True, (value[1:] != value[:-1]) | (window[1:] != window[:-1] + 1)]
    since = np.arange(len(window)) - np.maximum.accumulate(np.where(new, np.arange(len(window)), 0))
    first = np.flatnonzero(new | (since % LINE_WINDOWS == 0))
    moves = np.cumsum(np.r_[0, place[1:] != place[:-1]])
    counts = np.diff(np.r_[first, len(window)])
    return window[first], counts, mixed(value[first]), moves[first + counts - 1] > moves[first]


def sliced(rows: DataFrame, length: int, gram: int, slice_bytes: int) -> DataFrame:
    """Rows (key, text) -> one row for each slice: its texts and their lines."""
    key = rows.schema["key"].dataType.simpleString()

    def packed(number: int, keys: list[pa.Array], texts: list[bytes]) -> pa.RecordBatch:
        import xxhash
        import zstandard

        blob, sizes = b"".join(texts), np.array([len(t) for t in texts], dtype=np.int64)
        first, n, value, inner = anchored(np.frombuffer(blob, np.uint8), np.cumsum(sizes), length, gram)
        lines = np.fromiter((xxhash.xxh3_64_intdigest(blob[a : a + k + length - 1]) for a, k in zip(first.tolist(), n.tolist(), strict=True)), dtype=np.uint64, count=len(first))
        # Anchors of the slice with their numbers of different lines.
        order = np.lexsort((lines, value))
        differ = np.r_[True, (value[order][1:] != value[order][:-1]) | (lines[order][1:] != lines[order][:-1])] if len(order) else np.zeros(0, bool)
        of = value[order][differ]
        head = np.flatnonzero(np.r_[True, of[1:] != of[:-1]]) if len(of) else np.zeros(0, np.int64)
        state = [zstandard.compress(blob, 1), pack(sizes), pack(first), pack(n), value.tobytes(), np.packbits(inner).tobytes(), of[head].tobytes(), pack(np.diff(np.r_[head, len(of)]))]
        all_keys = pa.concat_arrays(keys)
        listed = pa.ListArray.from_arrays(pa.array([0, len(all_keys)], pa.int32()), all_keys)
        columns = [pa.array([number], pa.int64()), pa.array([len(blob)], pa.int64()), pa.array([len(head)], pa.int64()), listed, *(pa.array([x], pa.binary()) for x in state)]
        return pa.RecordBatch.from_arrays(columns, ["slice", "bytes", "n_anchors", "keys", *STATE])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, size = TaskContext.get().partitionId() << 32, 0
        keys: list[pa.Array] = []
        held: list[bytes] = []
        for part, texts in byte_parts(batches, "text"):
            for at, text in enumerate(texts):
                if held and size + len(text) > slice_bytes:
                    yield packed(number, keys, held)
                    number, size, keys, held = number + 1, 0, [], []
                keys.append(part.column("key").slice(at, 1))
                held.append(text)
                size += len(text) + 16
        if held:
            yield packed(number, keys, held)

    return rows.mapInArrow(run, f"slice long, bytes long, n_anchors long, keys array<{key}>, " + ", ".join(f"{c} binary" for c in STATE))


STATE = ("blob", "sizes", "first", "n", "value", "inner", "anchors", "lines")


def exchanged(sent: DataFrame, bin_bits: int, hot_lines: int) -> DataFrame:
    """Rows (slice, values ascending, lines of each) -> slice, shared, hot: the values of a slice that others have, and which of them have too many lines."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                values, lines = np.frombuffer(row["anchors"], np.uint64), unpack(row["lines"])
                bins = (values >> np.uint64(64 - bin_bits)).astype(np.int64) if bin_bits else np.zeros(len(values), dtype=np.int64)
                edges = np.flatnonzero(np.r_[True, bins[1:] != bins[:-1], True]) if len(bins) else np.zeros(1, dtype=np.int64)
                parts = list(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True))
                columns = [pa.array([int(bins[a]) for a, _ in parts], pa.int64()), pa.array([row["slice"]] * len(parts), pa.int64())]
                packed = [[values[a:b].tobytes() for a, b in parts], [pack(lines[a:b]) for a, b in parts]]
                yield pa.RecordBatch.from_arrays([*columns, *(pa.array(x, pa.binary()) for x in packed)], ["bin", "slice", "values", "lines"])

    def answer(table: pa.Table) -> pa.Table:
        found = [np.frombuffer(v, np.uint64) for v in table.column("values").to_pylist()]
        every = np.concatenate(found)
        lines = np.concatenate([unpack(x) for x in table.column("lines").to_pylist()])
        order = np.argsort(every, kind="stable")
        first = np.flatnonzero(np.r_[True, every[order][1:] != every[order][:-1]])
        slices, total = np.diff(np.r_[first, len(order)]), np.add.reduceat(lines[order], first)
        both, many = np.zeros(len(every), dtype=bool), np.zeros(len(every), dtype=bool)
        both[order], many[order] = np.repeat(slices > 1, slices), np.repeat(total > hot_lines, slices)
        ends = np.cumsum([len(f) for f in found])
        out: tuple[list, list] = ([], [])
        for column, taken in zip(out, (both, many), strict=True):
            for f, b in zip(found, ends.tolist(), strict=True):
                some = f[taken[b - len(f) : b]]
                column.append(some.tobytes() if len(some) else None)
        return pa.table({"slice": table.column("slice"), "shared": pa.array(out[0], pa.binary()), "hot": pa.array(out[1], pa.binary())})

    rows = sent.select("slice", "anchors", "lines").mapInArrow(send, "bin long, slice long, values binary, lines binary")
    return rows.groupBy("bin").applyInArrow(answer, "slice long, shared binary, hot binary").where("shared is not null or hot is not null")


def among(values: np.ndarray, listed: list[bytes] | None) -> np.ndarray:
    """Which values are in packed ascending pieces."""
    if not listed:
        return np.zeros(len(values), dtype=bool)
    return np.isin(values, np.concatenate([np.frombuffer(x, np.uint64) for x in listed]))


class Lines:
    """A slice's text and lines, and which of them can have an equal window elsewhere."""

    def __init__(self, row: dict) -> None:
        import zstandard

        self.blob = zstandard.decompress(row["blob"])
        self.first, self.n, value = unpack(row["first"]), unpack(row["n"]), np.frombuffer(row["value"], np.uint64)
        inner = np.unpackbits(np.frombuffer(row["inner"], np.uint8), count=len(value)).astype(bool)
        _, back, counts = np.unique(value, return_inverse=True, return_counts=True)
        self.value, self.hot = value, among(value, row["hot"])
        self.open = inner | (counts[back] > 1) | among(value, row["shared"])

    def windows(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Windows of hot anchors, and their fingerprints."""
        some = np.flatnonzero(self.hot)
        n = self.n[some]
        places = np.repeat(self.first[some] - np.cumsum(n) + n, n) + np.arange(n.sum())
        return places, prints(np.frombuffer(self.blob, np.uint8), places, length)


def with_answers(texts: DataFrame, answers: DataFrame, columns: list[str], *names: str) -> DataFrame:
    """Slices, where they are, with all answers that they got."""
    found = answers.groupBy("slice").agg(*(F.collect_list(c).alias(c) for c in names))  # as many values as the slice asked for at most
    return texts.select("slice", *columns).join(found.hint("shuffle_hash"), "slice", "left")


def hot_prints(texts: DataFrame, answers: DataFrame, length: int) -> DataFrame:
    """slice, anchors, lines: ascending fingerprints of the windows of hot anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                found = np.unique(Lines(row).windows(length)[1])
                yield pa.RecordBatch.from_arrays([pa.array([row["slice"]], pa.int64()), pa.array([found.tobytes()], pa.binary()), pa.array([pack(np.ones(len(found), np.int64))], pa.binary())], ["slice", "anchors", "lines"])

    return with_answers(texts, answers, ["blob", "first", "n", "value", "inner"], "shared", "hot").where("size(hot) > 0").mapInArrow(run, "slice long, anchors binary, lines binary")


def routed(texts: DataFrame, answers: DataFrame, length: int, groups: int) -> DataFrame:
    """group, slice, line, places: the slice's distinct lines (or windows of hot anchors) and where their first windows are."""

    def batch_of(number: int, rows: list[tuple[int, bytes, list[int]]]) -> pa.RecordBatch:
        group, line, places = zip(*rows, strict=True) if rows else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(group, pa.int64()), pa.array([number] * len(group), pa.int64()), pa.array(line, pa.binary()), pa.array(places, pa.list_(pa.int64()))], ["group", "slice", "line", "places"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                held, size = [], 0
                for item in of_slice(row):
                    held.append(item)
                    size += len(item[1])
                    if size > 2 << 20:
                        yield batch_of(row["slice"], held)
                        held, size = [], 0
                yield batch_of(row["slice"], held)

    def of_slice(row: dict) -> Iterator[tuple[int, bytes, list[int]]]:
        lines = Lines(row)
        some = np.flatnonzero(lines.open & ~lines.hot)
        yield from distinct(lines.blob, lines.value[some], lines.first[some], lines.n[some] + length - 1)
        if lines.hot.any():
            places, found = lines.windows(length)
            _, back, counts = np.unique(found, return_inverse=True, return_counts=True)
            again = (counts[back] > 1) | among(found, row["windows"])
            yield from distinct(lines.blob, found[again], places[again], np.full(int(again.sum()), length))

    def distinct(blob: bytes, value: np.ndarray, first: np.ndarray, size: np.ndarray) -> Iterator[tuple[int, bytes, list[int]]]:
        """Different strings of one value after the other, with their places."""
        order = np.argsort(value, kind="stable")
        group = (mixed(value) % np.uint64(groups)).astype(np.int64)[order].tolist()
        before, seen = None, {}
        for g, v, a, n in zip(group, value[order].tolist(), first[order].tolist(), size[order].tolist(), strict=True):
            if v != before:
                yield from ((last, line, at) for line, at in seen.items())
                before, last, seen = v, g, {}
            seen.setdefault(blob[a : a + n], []).append(a)
        yield from ((last, line, at) for line, at in seen.items())

    asked = with_answers(texts, answers, ["blob", "first", "n", "value", "inner"], "shared", "hot", "windows")
    return asked.mapInArrow(run, "group long, slice long, line binary, places array<long>")


def suffix_order(words: np.ndarray) -> np.ndarray:
    """Starts of a text's suffixes in order, an end of the text before all bytes. ``words``: eight bytes from each place on."""
    n = len(words)
    key = (words & ~np.uint64(0xFF)) | np.minimum(7, np.arange(n, 0, -1)).astype(np.uint64)  # seven bytes, and how many there are
    order = np.argsort(key, kind="stable")
    return doubled(order, np.r_[True, key[order][1:] != key[order][:-1]], 7)


def doubled(order: np.ndarray, head: np.ndarray, depth: int) -> np.ndarray:
    """Order by ever longer beginnings, from groups (``head``: their first) that agree to ``depth``; only what is still tied is sorted again."""
    n = len(order)
    slots = np.arange(n)
    start = np.maximum.accumulate(np.where(head, slots, 0))
    rank = np.empty(n, dtype=np.int64)
    rank[order] = start
    sa, tied = order.copy(), order
    while True:
        single = head & np.r_[head[1:], True]
        tied, slots = tied[~single], slots[~single]
        if not len(tied):
            return sa
        after = tied + depth
        second = np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        key = rank[tied] * (n + 1) + second
        by = np.argsort(key, kind="stable")
        tied, key = tied[by], key[by]
        sa[slots] = tied
        head = np.r_[True, key[1:] != key[:-1]]
        rank[tied] = slots[np.maximum.accumulate(np.where(head, np.arange(len(tied)), 0))]
        depth *= 2


class RunLengthIndex:
    """The Burrows-Wheeler transform of different lines as runs, sampled at both ends of each.

    symbols, sizes: the runs. before, behind: (place, agreement) ascending by place: how far the suffix agrees with its neighbour before the
    first, or behind the last, place of a run; beginnings of lines are sampled as well. An agreement ends with the line.
    """

    def __init__(self, lines: list[bytes]) -> None:
        self.bounds = np.cumsum([0, *(len(line) + 1 for line in lines)])  # a byte between lines
        text = np.frombuffer(b"\xff".join(lines) + b"\xff", np.uint8)
        self.n = n = len(text)
        words = np.zeros(n, dtype=np.uint64)
        for k in range(8):
            words[: n - k] |= text[k:].astype(np.uint64) << np.uint64(56 - 8 * k)
        sa = suffix_order(words)
        symbol = np.where(sa > 0, text[sa - 1].astype(np.int64), 256)
        head = np.flatnonzero(np.r_[True, symbol[1:] != symbol[:-1]])
        self.symbols, self.sizes = symbol[head], np.diff(np.r_[head, n])
        left = self.bounds[np.searchsorted(self.bounds, np.arange(n), side="right")] - 1 - np.arange(n)  # bytes to the end of the line
        rank = np.empty(n, dtype=np.int64)
        rank[sa] = np.arange(n)
        starts = rank[self.bounds[:-1]]
        self.before = self._sampled(np.union1d(head, starts), -1, sa, words, left)
        self.behind = self._sampled(np.union1d(np.r_[head[1:] - 1, n - 1], starts), 1, sa, words, left)

    @staticmethod
    def _sampled(at: np.ndarray, side: int, sa: np.ndarray, words: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        other = at + side
        inside = (other >= 0) & (other < len(sa))
        place = sa[at]
        a, b = place[inside], sa[other[inside]]
        agreed = np.zeros(len(at), dtype=np.int64)
        agreed[inside] = agreement(a, b, words, np.minimum(left[a], left[b]))
        order = np.argsort(place)
        return place[order], agreed[order]

    def statistics(self) -> np.ndarray:
        """For every place, the length of the longest string from there that also starts at another place, within lines."""
        best = np.zeros(self.n, dtype=np.int64)
        for place, agreed in (self.before, self.behind):
            reach = np.zeros(self.n, dtype=np.int64)
            since = np.zeros(self.n, dtype=np.int64)
            since[place] = place
            reach[place] = place + agreed
            last = np.maximum.accumulate(since)
            np.maximum(best, reach[last] - np.arange(self.n), out=best)
        return best


def agreement(a: np.ndarray, b: np.ndarray, words: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """Common bytes from places ``a`` and ``b`` on, up to ``limit``."""
    found, n = np.zeros(len(a), dtype=np.int64), len(words)
    active = np.arange(len(a))
    while len(active):
        x, y = np.minimum(a[active] + found[active], n - 1), np.minimum(b[active] + found[active], n - 1)
        differ = words[x] ^ words[y]
        zeros = np.zeros(len(active), dtype=np.int64)
        for shift in (32, 16, 8):  # leading bytes that are equal
            free = (differ >> np.uint64(64 - shift)) == 0
            zeros += np.where(free, shift // 8, 0)
            differ = np.where(free, differ << np.uint64(shift), differ)
        zeros += (differ >> np.uint64(56)) == 0
        found[active] += zeros
        active = active[(zeros == 8) & (found[active] < limit[active])]
    return np.minimum(found, limit)


def marked(lines: DataFrame, length: int) -> DataFrame:
    """slice, first, n: runs of windows that occur elsewhere, packed."""

    def of_group(table: pa.Table) -> pa.Table:
        raw = table.column("line").to_pylist()
        places = table.column("places").to_pylist()
        slices = table.column("slice").to_pylist()
        number: dict[bytes, int] = {}
        of = [number.setdefault(line, len(number)) for line in raw]
        copies = np.zeros(len(number), dtype=np.int64)
        np.add.at(copies, of, [len(p) for p in places])
        index = RunLengthIndex(list(number))
        long = index.statistics() >= length
        edge = np.flatnonzero(np.diff(np.r_[False, long, False].astype(np.int8)))
        firsts, ends = edge[::2], edge[1::2]
        lo, hi = np.searchsorted(firsts, index.bounds[:-1]), np.searchsorted(firsts, index.bounds[1:])
        found: dict[int, tuple[list[int], list[int]]] = {}
        for line, at, number_of, slice_ in zip(raw, places, of, slices, strict=True):
            if copies[number_of] > 1:
                runs = [(0, len(line) - length + 1)]
            else:
                base = int(index.bounds[number_of])
                runs = [(int(firsts[k]) - base, int(ends[k] - firsts[k])) for k in range(lo[number_of], hi[number_of])]
            if runs:
                first, n = found.setdefault(slice_, ([], []))
                for p in at:
                    for a, k in runs:
                        first.append(p + a)
                        n.append(k)
        out = [(s, pack(np.array(first)), pack(np.array(n))) for s, (first, n) in found.items()]
        return pa.table({"slice": pa.array([x[0] for x in out], pa.int64()), "marked": pa.array([x[1] for x in out], pa.binary()), "n_marked": pa.array([x[2] for x in out], pa.binary())})

    return lines.groupBy("group").applyInArrow(of_group, "slice long, marked binary, n_marked binary")


def cut_out(texts: DataFrame, found: DataFrame, length: int) -> DataFrame:
    """key, n_bytes, n_removed, kept (bytes) and spans (of the removed bytes) per text."""
    key = texts.schema["keys"].dataType.elementType.simpleString()
    span = pa.list_(pa.struct([("start", pa.int64()), ("n", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        for batch in batches:
            for at in range(batch.num_rows):
                part = batch.slice(at, 1)
                row = part.drop_columns("keys").to_pylist()[0]
                blob, sizes = zstandard.decompress(row["blob"]), unpack(row["sizes"])
                edge = np.zeros(len(blob) + 1, dtype=np.int64)
                for first, n in zip(row["marked"] or (), row["n_marked"] or (), strict=True):
                    a, k = unpack(first), unpack(n)
                    np.add.at(edge, a, 1)
                    np.add.at(edge, a + k - 1 + length, -1)
                gone = np.cumsum(edge[:-1]) > 0
                spans, kept, removed = [], [], []
                for end, size in zip(np.cumsum(sizes).tolist(), sizes.tolist(), strict=True):
                    turns = np.flatnonzero(np.diff(np.r_[False, gone[end - size : end], False].astype(np.int8))).tolist()
                    pairs = list(zip(turns[::2], turns[1::2], strict=True))
                    spans.append([{"start": a, "n": b - a} for a, b in pairs])
                    removed.append(sum(b - a for a, b in pairs))
                    text = blob[end - size : end]
                    borders = [0, *turns, size]
                    kept.append(b"".join([text[a:b] for a, b in zip(borders[::2], borders[1::2], strict=True)]) if pairs else text)
                values = [pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()), pa.array(spans, span)]
                yield pa.RecordBatch.from_arrays([part.column("keys").flatten(), *values], ["key", "n_bytes", "n_removed", "kept", "spans"])

    asked = with_answers(texts, found, ["keys", "sizes", "blob"], "marked", "n_marked")
    return asked.mapInArrow(run, f"key {key}, n_bytes long, n_removed long, kept binary, spans array<struct<start:long,n:long>>")


def trimmed(
    docs: DataFrame, length: int = 400, gram: int = 100, slice_bytes: int = 4 << 20, group_bytes: int = 2 << 20, hot_lines: int = 2000, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Return ``id_col``, n_bytes, n_removed, kept (the bytes left) and spans (of removed bytes) per row of ``docs``.

    Every byte goes that a string of ``length`` bytes covers which also starts anywhere else. The result does not depend on ``gram``
    (below ``length``) and the sizes: of slices, of the lines of a group, and the number of lines from which an anchor is split.
    """
    spark = docs.sparkSession
    base = shared_dir(spark)
    rows = docs.select(F.col(id_col).alias("key"), text_or_empty(text_col).alias("text"))
    texts = bucketed(sliced(rows, length, gram, slice_bytes), "slice", f"{base}/slices")
    n_bytes, n_anchors = texts.agg(F.sum("bytes"), F.sum("n_anchors")).first()
    bits = max(0, ((n_anchors or 0) // BIN_PRINTS).bit_length())
    answers = written(exchanged(texts, bits, hot_lines), f"{base}/answers").withColumn("windows", F.lit(None).cast("binary"))
    if not answers.where("hot is not null").isEmpty():
        asked = written(hot_prints(texts, answers, length), f"{base}/prints")
        n_prints = asked.agg(F.sum(F.octet_length("anchors"))).first()[0] // 8
        windows = exchanged(asked, max(0, (n_prints // BIN_PRINTS).bit_length()), 1 << 60)
        none = F.lit(None).cast("binary")
        answers = written(answers.union(windows.select("slice", none, none, F.col("shared"))), f"{base}/windows")
    # A line has length - 1 bytes more than windows, and an anchor rules (length - gram + 2) / 2 windows on average.
    growth = 1 + 2 * length / (length - gram + 2)
    groups = max(1, int((n_bytes or 0) * growth) // group_bytes)
    return cut_out(texts, marked(routed(texts, answers, length, groups), length), length).withColumnRenamed("key", id_col)
