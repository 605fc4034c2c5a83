"""Best-fit packing of tokenised documents by bin completion.

Tokens of a document: its ids, then id 0; documents over ``capacity`` are cut into full pieces and a rest. Packing
needs the number of pieces of each length only, at most ``capacity`` counts for any corpus, so the search works on
that histogram: a best-fit-decreasing solution is the incumbent; of it the bins that waste little stay, and of the rest the
largest open length is completed by undominated fillings, where a branch ends if its waste leaves no room for fewer bins
than the incumbent's. A solution that meets the lower bound ends the search; else ``effort`` does.
A solution is a list of patterns (lengths in a bin, number of such bins), so a step fills any number of bins.

Pieces find their place by rank among those of their length: ranks are counted in ``buckets`` per length and
offset by the counts before, so a length that a third of all pieces share is no group of its own.

Null text counts as empty: one piece holding id 0. Repeated rows and ids are packed once each. An empty table gives an
empty one; other columns are not looked at, whatever their names.
"""

from __future__ import annotations

import os
import re
import string
import zlib
from bisect import bisect_left, insort
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spindrift.llm.bpe import vocabulary_path
from spindrift.llm.common import byte_parts, shared_dir, text_or_empty, written
from spindrift.llm.run_length_index import prints

#: Bytes of words and their ids that a worker remembers at least; twice as many make it forget those that are not in use. Only speed depends on it.
REMEMBERED = 24 << 20

#: A word of Latin-1 letters and ASCII punctuation behind them, or none.
SIMPLE = f"^(?P<core>[A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)(?P<tail>[{re.escape(string.punctuation)}]*)$"
Pattern = tuple[tuple[tuple[int, int], ...], int]  # ((length, times), ...), bins


class Memory:
    """Words and their ids as Arrow columns, ascending by fingerprint; what is found was compared by bytes."""

    def __init__(self) -> None:
        self.prints, self.words, self.ids = np.zeros(0, np.uint64), pa.array([], pa.binary()), pa.array([], pa.large_binary())

    def find(self, prints: np.ndarray, words: pa.Array) -> pa.Array:
        """Ids of each word, null for those that are not here."""
        if not len(self.prints):
            return pa.nulls(len(words), pa.large_binary())
        at = np.minimum(np.searchsorted(self.prints, prints), len(self.prints) - 1)
        there = pc.equal(self.words.take(pa.array(at)), words).to_numpy(zero_copy_only=False)
        return self.ids.take(pa.array(at, mask=~there))

    def add(self, prints: np.ndarray, words: pa.Array, ids: pa.Array) -> None:
        """A fingerprint belongs to the first word that came with it."""
        new, first = np.unique(prints, return_index=True)
        at = np.searchsorted(self.prints, new)
        free = np.r_[self.prints, np.uint64(0)][at] != new if len(self.prints) else np.ones(len(new), dtype=bool)
        free |= at == len(self.prints)
        new, first, at = new[free], first[free], at[free]
        order = pa.array(np.insert(np.arange(len(self.prints)), at, len(self.prints) + first))
        self.prints = np.insert(self.prints, at, new)
        # One after the other, so that no more than one of the two is there twice.
        self.words = pa.concat_arrays((self.words, words)).take(order)
        self.ids = pa.concat_arrays((self.ids, ids)).take(order)

    def size(self) -> int:
        return self.prints.nbytes + self.words.nbytes + self.ids.nbytes


def fingerprints(words: pa.Array) -> np.ndarray:
    if not len(words):
        return np.zeros(0, np.uint64)
    ends = words.cast(pa.large_binary())
    _, offsets, values = ends.buffers()
    at = np.frombuffer(offsets, np.int64)[ends.offset : ends.offset + len(ends) + 1]
    raw = np.frombuffer(values, np.uint8)[: at[-1]] if values else np.zeros(0, np.uint8)
    return prints(raw[at[0] :], at[:-1] - at[0], np.diff(at))


def packed(ids: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Ids up to each end as bytes."""
    offsets = 4 * np.r_[0, ends].astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(ids, "<u4"))])


class WordIds:
    """Ids of a vocabulary that drops white space, so that the words between ASCII spaces are encoded alone.

    Each part of texts is cut into its different words by Arrow; new ones go through the tokenizer many at a time. A word of Latin-1 letters,
    with ASCII punctuation behind it or not, is its lower-case letters, one pre-token whose last id ends a word, and its punctuation, another
    pre-token. Other words stand with an added token between them, which splits them before any normalisation; words that hold
    an added token are encoded one by one.
    """

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks share out the cores
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        added = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.added = list(added)
        self.mark, self.mark_id = next(iter(added.items()))
        vocab = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(1 + max(vocab.values()), dtype=bool)
        self.ends_word[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.known, self.before = Memory(), Memory()

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def recall(self, prints: np.ndarray, words: pa.Array) -> pa.Array:
        """Ids of each word, null for those that are not remembered; words in use come back from before."""
        ids = self.known.find(prints, words)
        lacking = np.flatnonzero(ids.is_null().to_numpy(zero_copy_only=False))
        if len(lacking) and len(self.before.prints):
            some = words.take(pa.array(lacking))
            again = self.before.find(prints[lacking], some)
            back = again.is_valid()
            self.known.add(prints[lacking][back.to_numpy(zero_copy_only=False)], some.filter(back), again.filter(back))
            ids = pc.replace_with_mask(ids, ids.is_null(), again)
        return ids

    def ids_of(self, words: pa.Array, learn: Callable[[pa.Array], pa.Array]) -> pa.Array:
        """Ids of different words; what is not remembered is learnt."""
        keys = fingerprints(words)
        ids = self.recall(keys, words)
        lacking = ids.is_null()
        new = words.filter(lacking)
        if len(new):
            learnt = learn(new)
            self.known.add(keys[lacking.to_numpy(zero_copy_only=False)], new, learnt)
            ids = pc.replace_with_mask(ids, lacking, learnt)
        return ids

    def letters(self, words: pa.Array) -> pa.Array:
        """Ids of words of lower-case Latin-1 letters alone."""
        listed = words.to_pylist()
        ids = np.concatenate([self._ids(b" ".join(listed[a : a + 512]).decode()) for a in range(0, len(listed), 512)])
        return packed(ids, np.flatnonzero(self.ends_word[ids]) + 1)

    def others(self, words: pa.Array) -> pa.Array:
        """Ids of any words."""
        listed = [w.decode() for w in words.to_pylist()]
        whole = [k for k, w in enumerate(listed) if "|" in w and any(t in w for t in self.added)]
        apart = dict.fromkeys(whole, "")
        found = []
        for a in range(0, len(listed), 512):
            ids = self._ids("".join(apart.get(a + k, w) + self.mark for k, w in enumerate(listed[a : a + 512])))
            ends = np.flatnonzero(ids == self.mark_id)
            found += [ids[i:j].tobytes() for i, j in zip(np.r_[0, ends[:-1] + 1].tolist(), ends.tolist(), strict=True)]
        for k in whole:
            found[k] = self._ids(listed[k]).tobytes()
        return pa.array(found, pa.large_binary())

    def learn(self, words: pa.Array) -> pa.Array:
        """Ids of different words."""
        parts = pc.extract_regex(words.view(pa.string()), SIMPLE)
        plain = parts.is_valid()
        ids = pa.nulls(len(words), pa.large_binary())
        if pc.any(plain).as_py():
            core, tail = (parts.filter(plain).field(k).dictionary_encode() for k in ("core", "tail"))
            # Words that differ in their upper-case letters alone have one core.
            lower = pc.utf8_lower(core.dictionary).dictionary_encode()
            cores = self.ids_of(lower.dictionary.view(pa.binary()), self.letters).take(lower.indices).take(core.indices)
            tails = self.ids_of(tail.dictionary.view(pa.binary()), self.others).take(tail.indices)
            ids = pc.replace_with_mask(ids, plain, pc.binary_join_element_wise(cores, tails, pa.scalar(b"", pa.large_binary())))
        rest = ids.is_null()
        some = words.filter(rest)
        return pc.replace_with_mask(ids, rest, self.others(some)) if len(some) else ids

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        if self.known.size() > REMEMBERED:
            self.before, self.known = self.known, Memory()
        cut = pc.ascii_split_whitespace(pa.array(texts, pa.binary()).view(pa.string()))
        coded = cut.flatten().dictionary_encode()
        found = self.ids_of(coded.dictionary.view(pa.binary()), self.learn).take(coded.indices)
        if not len(found):
            return [b""] * len(texts)
        _, offsets, values = found.buffers()
        ends = np.frombuffer(offsets, np.int64)[cut.offsets.to_numpy()].tolist()
        raw = values.to_pybytes() if values else b""
        return [raw[a:b] for a, b in zip(ends, ends[1:], strict=False)]


@cache
def word_ids(path: str) -> WordIds:
    return WordIds(path)


def pieces(docs: DataFrame, capacity: int = 2048, vocabulary: str = "word_bpe_49k.json", id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """Return key, piece, start, length, ids_crc32 (and ids, where asked for) per piece."""
    keys = docs.select(F.col(id_col).alias("key"), text_or_empty(text_col).alias("text"))
    names = ["key", "piece", "start", "length", "ids_crc32", *["ids"] * keep_ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_ids(vocabulary_path(vocabulary))
        for batch, texts in byte_parts(batches, "text"):
            rows, piece, start, length, crc, kept = [], [], [], [], [], []
            for i, ids in enumerate(words.encode(texts)):
                ids += bytes(4)
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    rows.append(i)
                    piece.append(k)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    if keep_ids:
                        kept.append(np.frombuffer(part, "<u4").astype(np.int32))
            columns = [batch.column("key").take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            yield pa.RecordBatch.from_arrays([*columns, *[pa.array(kept, pa.list_(pa.int32()))] * keep_ids], names)

    kind = keys.schema["key"].dataType.simpleString()
    return keys.mapInArrow(run, f"key {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * keep_ids)


def best_fit(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Best-fit decreasing over a histogram: bins of one filling move together."""
    by_room: dict[int, dict[tuple, int]] = defaultdict(dict)
    rooms: list[int] = []

    def put(room: int, filling: tuple, bins: int) -> None:
        if room not in by_room:
            insort(rooms, room)
        by_room[room][filling] = by_room[room].get(filling, 0) + bins

    for size in sorted(counts, reverse=True):
        left = counts[size]
        while left:
            at = bisect_left(rooms, size)
            room = rooms[at] if at < len(rooms) else capacity
            if at < len(rooms):
                filling, bins = by_room[room].popitem()
                if not by_room[room]:
                    del by_room[room]
                    rooms.pop(at)
            else:
                filling, bins = (), max(1, left // (capacity // size))
            each = min(room // size, left)  # a bin stays the best fit until no more goes in
            filled = min(bins, left // each)
            put(room - each * size, (*filling, (size, each)), filled)
            if bins > filled and (filling or at < len(rooms)):
                put(room, filling, bins - filled)
            left -= each * filled
    return [(filling, bins) for group in by_room.values() for filling, bins in group.items()]


def fillings(room: int, sizes: list[int], counts: dict[int, int], steps: int) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Undominated fillings of a room, least waste first: none leaves room for a further piece, and none has a piece that a larger unused one could replace.

    The largest pieces are tried first; after ``steps`` trials the fillings found so far are those there are.
    """
    found: list[tuple[tuple[tuple[int, int], ...], int]] = []
    done = 0

    def extend(room: int, first: int, taken: list[tuple[int, int]], spare: int) -> None:
        """spare: the largest size passed over that is still unused."""
        nonlocal done
        done += 1
        start = first
        while start < len(sizes) and sizes[start] > room:
            start += 1
        if start == len(sizes):
            if not any(size < spare <= size + room for size, _ in taken):
                found.append((tuple(taken), room))
            return
        for k in range(start, len(sizes)):
            size = sizes[k]
            for times in range(min(counts[size], room // size), 0, -1):
                if done > steps:
                    return
                extend(room - times * size, k + 1, [*taken, (size, times)], sizes[k - 1] if k > start else spare)

    extend(room, 0, [], 0)
    return sorted(found, key=lambda f: (f[1], sum(n for _, n in f[0])))


def least_bins(counts: dict[int, int], capacity: int) -> int:
    """A lower bound: sizes by themselves and with small ones left out, and sizes rounded to k-ths of a bin by a dual feasible function."""
    sizes = sorted(counts)
    best = -(-sum(s * n for s, n in counts.items()) // capacity)
    for small in [s for s in sizes if 2 * s <= capacity]:
        alone = sum(n for s, n in counts.items() if s > capacity - small)
        large = [(s, n) for s, n in counts.items() if capacity < 2 * s <= 2 * (capacity - small)]
        rest = sum(s * n for s, n in counts.items() if s >= small and 2 * s <= capacity) - sum((capacity - s) * n for s, n in large)
        best = max(best, alone + sum(n for _, n in large) + max(0, -(-rest // capacity)))
    for k in range(1, 33):
        # In units of a bin's k * capacity-th part.
        worth = sum(n * (k * s if (k + 1) * s % capacity == 0 else (k + 1) * s // capacity * capacity) for s, n in counts.items())
        best = max(best, -(-worth // (k * capacity)))
    return best


def complete(counts: dict[int, int], capacity: int, incumbent: list[Pattern], least: int, effort: int, steps: int = 400) -> tuple[list[Pattern], int]:
    """Bin completion: depth first, the largest length first, pruned by waste. Returns the best solution and the nodes looked at, ``effort`` at most.

    A node's branches are all its fillings, each as often as there are pieces for it, then each once.
    """
    total = sum(size * n for size, n in counts.items())
    best, bins = incumbent, sum(n for _, n in incumbent)
    nodes = 0
    stack: list[tuple[dict[int, int], tuple[tuple[int, int], ...], int, int, int, tuple | None]] = [(counts, (), 0, 0, 0, None)]
    while stack and bins > least and nodes < effort:
        before, inside, times, used, waste, path = stack.pop()
        if waste > (bins - 1) * capacity - total:
            continue
        nodes += 1
        open_counts = dict(before)
        for size, n in inside:
            open_counts[size] -= n * times
            if not open_counts[size]:
                del open_counts[size]
        if not open_counts:
            bins, best = used, []
            while path is not None:
                best.append(path[0])
                path = path[1]
            continue
        largest = max(open_counts)
        rest = dict(open_counts)
        rest[largest] -= 1
        sizes = sorted((s for s, n in rest.items() if n and s <= capacity - largest), reverse=True)
        options = fillings(capacity - largest, sizes, rest, steps) if sizes else [((), capacity - largest)]
        often, once = [], []
        for filling, over in options:
            inside = Counter(dict(filling))
            inside[largest] += 1
            times = min(open_counts[s] // n for s, n in inside.items())
            for many, into in ((times, often), (1, once)) if times > 1 else ((times, often),):
                into.append((open_counts, tuple(inside.items()), many, used + many, waste + many * over, ((tuple(inside.items()), many), path)))
        stack += reversed(often + once)
    return best, nodes


def solve(counts: dict[int, int], capacity: int, effort: int = 3_000) -> list[Pattern]:
    """Best fit, and then bin completion of what it fills badly.

    Of the incumbent, bins that waste no more than a limit stay, and the rest is searched, for each of several limits; the best
    of these is the next incumbent. After a round without a gain each search takes longer, until the lower bound is met.
    ``effort`` bounds the nodes of all searches.
    """
    counts = {s: n for s, n in counts.items() if n}
    if not counts:
        return []
    best, least, left = best_fit(counts, capacity), least_bins(counts, capacity), effort
    limits = [*(1 << k for k in range(capacity.bit_length())), 0, -1]
    width = 2
    while left > 0 and sum(n for _, n in best) > least:
        tried = []
        for limit in limits:
            wasted = [capacity - sum(s * n for s, n in filling) for filling, _ in best]
            kept = [pattern for pattern, waste in zip(best, wasted, strict=True) if waste <= limit]
            rest = [pattern for pattern, waste in zip(best, wasted, strict=True) if waste > limit]
            open_counts: Counter[int] = Counter()
            for filling, bins in rest:
                for size, n in filling:
                    open_counts[size] += n * bins
            found, nodes = complete(dict(open_counts), capacity, rest, least - sum(n for _, n in kept), max(0, min(left, width * len(rest) + 50)))
            left -= nodes
            tried.append(kept + found)
        after = min(tried, key=lambda patterns: sum(n for _, n in patterns))
        if sum(n for _, n in after) == sum(n for _, n in best):  # a round without a gain: search each rest for longer
            width, left = 4 * width, left - 1
        best = after
    return best


def places(patterns: list[Pattern]) -> pd.DataFrame:
    """For each length, intervals of ranks and the bins and offsets they go to."""
    rows, taken, sequence = [], Counter(), 0
    for filling, bins in patterns:
        offset = 0
        merged: dict[int, int] = {}
        for size, times in filling:
            merged[size] = merged.get(size, 0) + times
        for size, times in merged.items():
            rows.append((size, taken[size], times, sequence, offset))
            taken[size] += times * bins
            offset += size * times
        sequence += bins
    return pd.DataFrame(rows, columns=["length", "first", "times", "sequence", "offset"]).sort_values(["length", "first"])


def pack(docs: DataFrame, capacity: int = 2048, vocabulary: str = "word_bpe_49k.json", id_col: str = "doc_id", text_col: str = "text", effort: int = 3_000) -> DataFrame:
    """Return ``id_col``, piece, start, length, ids_crc32, sequence_id, offset per piece."""
    spark = docs.sparkSession
    base = shared_dir(spark)
    buckets = max(64, int(spark.conf.get("spark.sql.shuffle.partitions")))
    cut = pieces(docs, capacity, vocabulary, id_col, text_col).withColumn("bucket", F.pmod(F.xxhash64("key", "piece", "ids_crc32"), F.lit(buckets)).cast("int"))
    cut = written(cut, f"{base}/pieces")
    counted = written(cut.groupBy("length", "bucket").agg(F.count("*").alias("n")), f"{base}/counts")

    def plan(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = pd.concat([pd.DataFrame({"length": [], "n": []}), *parts])  # a row for each length at most
        counts = {int(s): int(n) for s, n in zip(table["length"], table["n"], strict=True)}
        yield places(solve(counts, capacity, effort))

    lengths = counted.groupBy("length").agg(F.sum("n").alias("n")).coalesce(1)
    # Bounded by the capacity alone: a few intervals for each of the lengths there can be.
    table = lengths.mapInPandas(plan, "length long, first long, times long, sequence long, offset long").toPandas()
    shared = spark.sparkContext.broadcast({c: table[c].to_numpy(np.int64) for c in table})

    before = counted.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)))
    before = before.select("length", "bucket", F.coalesce("before", F.lit(0)).alias("before"))
    order = Window.partitionBy("length", "bucket").orderBy("key", "piece", "ids_crc32")
    ranked = cut.withColumn("rank", F.row_number().over(order)).join(before, ["length", "bucket"])
    ranked = ranked.select("key", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("rank") - 1).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = shared.value
        known = t["length"] << 44 | t["first"]
        for batch in batches:
            size, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            at = np.searchsorted(known, size << 44 | rank, side="right") - 1
            there = rank - t["first"][at]
            sequence, slot = t["sequence"][at] + there // t["times"][at], there % t["times"][at]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("key", "piece", "start", "length", "ids_crc32")), pa.array(sequence, pa.int64()), pa.array(t["offset"][at] + slot * size, pa.int64())], ["key", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    kind = cut.schema["key"].dataType.simpleString()
    return ranked.mapInArrow(place, f"key {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long").withColumnRenamed("key", id_col)
