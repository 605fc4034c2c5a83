"""Byte-level BPE encoding and decoding with a pair occurrence index.

Each slice of a partition is cut into pre-tokens where the kinds of its characters change, and a worker remembers the ids
of different pre-tokens; those not met before are laid out in one symbol array.
An index maps every mergeable pair (by its rank) to all its positions in that array. Active ranks are taken in
ascending order, each is applied at all its positions, and the positions of the pairs to the left and right of
every merge are added to the lists of their ranks. The result equals merging each pre-token on its own, since
merges never cross a pre-token and a pair only ever gives rise to pairs of higher rank. A long list of places is merged as arrays.

Rows are independent: the plan has no shuffle. Null and empty text give no ids and the digest of nothing.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.llm.common import text_or_empty, text_parts

#: Fixed value: the pre-token pattern of the vocabulary.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pre-tokens that a worker remembers at least; twice as many make it forget those that are not in use. Only speed depends on it.
REMEMBERED = 400_000
#: So many places of a rank are merged as arrays; fewer, one by one. Only speed depends on it.
MANY = 32


def vocabulary_path(name: str) -> str:
    """Place of a public vocabulary file; a path is taken as it is."""
    if "/" in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte: itself where Latin-1 prints it, else the next free one from U+0100."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {b: chr(b) for b in shown}
    for b in range(256):
        if b not in letters:
            letters[b] = chr(0x100 + len(letters) - len(shown))
    return [letters[b] for b in range(256)]


def between(values: pa.Array, upto: np.ndarray | None = None) -> list[bytes]:
    """What stands in a large_binary array from its start, or the end before, up to each end; without ends, its values."""
    _, offsets, raw = values.buffers()
    at = np.frombuffer(offsets, np.int64)[values.offset : values.offset + len(values) + 1] if len(values) else np.zeros(1, np.int64)
    stops, raw = (at if upto is None else np.r_[at[:1], at[upto]]).tolist(), raw.to_pybytes() if raw else b""
    return [raw[a:b] for a, b in zip(stops, stops[1:], strict=False)]


#: Kinds of characters that the pattern tells apart, but for the first by their groups in ``character_kinds``.
OTHER, LETTER, NUMBER, SPACE = range(4)
#: Letters behind an apostrophe that are a pre-token with it.
ALONE, PAIRS = "stmd", ("re", "ve", "ll")


def character_kinds() -> np.ndarray:
    """The kind of every code point, as the pattern's classes have it."""
    every = np.arange(0x110000, dtype="<u4").tobytes().decode("utf-32-le", "surrogatepass")
    kinds = np.full(0x110000, OTHER, dtype=np.uint8)
    for m in regex.finditer(r"(\p{L}+)|(\p{N}+)|(\s+)", every):
        kinds[m.start() : m.end()] = m.lastindex
    return kinds


def token_starts(codes: np.ndarray, kinds: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where ``PRE_TOKEN`` begins a match in texts that stand one behind the other and begin at ``first``.

    Matches are runs of one kind, but for these: of white space that something follows in its text the last character
    stands apart, and if it is U+0020 it begins what follows; an apostrophe that begins a match of its own takes the letters
    of a contraction with it.
    """
    n = len(codes)
    begins = np.zeros(n + 1, dtype=bool)
    begins[first] = True
    of = kinds[codes]
    runs = begins[:-1].copy()
    runs[1:] |= of[1:] != of[:-1]
    starts = runs.copy()
    space = of == SPACE
    b = 1 + np.flatnonzero(space[:-1] & ~space[1:] & ~begins[1:-1])
    starts[b - 1] = True
    starts[b[codes[b - 1] == 0x20]] = False
    q = np.flatnonzero((codes == 0x27) & starts)
    q = q[q + 1 < n]
    q = q[runs[q + 1] & (of[q + 1] == LETTER) & ~begins[q + 1]]
    if len(q):
        one, two = codes[q + 1], codes[np.minimum(q + 2, n - 1)]
        alone = np.isin(one, [ord(c) for c in ALONE])
        pair = ~begins[q + 2] & (q + 2 < n) & np.logical_or.reduce([(one == ord(a)) & (two == ord(b)) for a, b in PAIRS])
        starts[q[alone | pair] + 1] = False
        behind = np.concatenate((q[alone] + 2, q[pair] + 3))
        starts[behind[behind < n]] = True
    return starts


class Ends:
    """Merges that begin, or end, with a token: the token at their other end and their ranks."""

    def __init__(self, tokens: np.ndarray, others: np.ndarray, size: int) -> None:
        self.ranks = np.argsort(tokens, kind="stable")
        self.others = others[self.ranks]
        self.at = np.searchsorted(tokens[self.ranks], np.arange(size + 1)).tolist()
        self.table = np.full(size + 1, -1, dtype=np.int64)

    def find(self, token: int, others: np.ndarray) -> np.ndarray:
        """Ranks of ``token`` with each other one, -1 where they do not merge or -1 stands there."""
        a, b = self.at[token], self.at[token + 1]
        if a == b:
            return np.full(len(others), -1, dtype=np.int64)
        self.table[self.others[a:b]] = self.ranks[a:b]
        found = self.table[others]
        self.table[self.others[a:b]] = -1
        return found


class PairIndexBpe:
    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab: dict[str, int] = spec["model"]["vocab"]
        letters = byte_letters()
        byte_of = {c: b for b, c in enumerate(letters)}
        self.byte_ids = np.array([vocab[c] for c in letters], dtype=np.int64)
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", ())}
        bytes_of = [b""] * (1 + max([*vocab.values(), *self.special.values()]))
        for token, i in vocab.items():
            bytes_of[i] = bytes(byte_of[c] for c in token)
        for token, i in self.special.items():
            bytes_of[i] = token.encode()
        self.bytes_of = pa.array(bytes_of, pa.large_binary())
        self.rank: dict[int, int] = {}
        self.rules: list[tuple[int, int, int]] = []
        first = np.full((256, 256), -1, dtype=np.int64)
        single = {vocab[c]: b for b, c in enumerate(letters)}
        for r, merge in enumerate(spec["model"]["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            x, y = vocab[a], vocab[b]
            self.rank[x << 20 | y] = r
            self.rules.append((x, y, vocab[a + b]))
            if x in single and y in single:
                first[single[x], single[y]] = r
        self.first = first
        lefts, rights, _ = np.array(self.rules, dtype=np.int64).reshape(-1, 3).T
        self.begin, self.end = Ends(lefts, rights, len(bytes_of)), Ends(rights, lefts, len(bytes_of))
        self.kinds = character_kinds()
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.known: dict[bytes, bytes] = {}
        self.before: dict[bytes, bytes] = {}

    def cut(self, texts: list[str]) -> tuple[pa.Array, np.ndarray]:
        """Pre-tokens of all texts in order, and their number up to the end of each text; an added token that stands in a text is one of them."""
        parts, whole, upto = [], [], []
        for text in texts:
            if self.split is not None and any(s in text for s in self.special):
                cut = self.split.split(text)
                whole += range(len(parts) + 1, len(parts) + len(cut), 2)
                parts += cut
            else:
                parts.append(text)
            upto.append(len(parts))
        text = "".join(parts)
        codes, raw = np.frombuffer(text.encode("utf-32-le"), np.uint32), text.encode()
        edges = np.cumsum([0, *map(len, parts)])
        starts = np.r_[token_starts(codes, self.kinds, edges[:-1]), True]
        for k in whole:
            starts[edges[k] + 1 : edges[k + 1]] = False
        at = np.flatnonzero(starts)
        ends = np.searchsorted(at, edges[upto])
        if len(raw) > len(codes):
            wide = (codes >= 0x80).astype(np.int8) + (codes >= 0x800) + (codes >= 0x10000)
            at = at + np.r_[0, np.cumsum(wide, dtype=np.int64)][at]
        return pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(raw)]), ends

    def learn(self, words: list[bytes]) -> None:
        """Merge all given pre-tokens together and remember their ids."""
        special = {w.encode(): np.array([i], "<u4").tobytes() for w, i in self.special.items()}
        self.known |= special
        words = [w for w in words if w not in special]
        if not words:
            return
        flat = np.frombuffer(b"\0" + b"\0".join(words) + b"\0", dtype=np.uint8)
        ends = np.cumsum([len(w) + 1 for w in words])
        symbols = self.byte_ids[flat]
        symbols[0] = -1
        symbols[ends] = -1
        ranks = self.first[flat[:-1], flat[1:]]
        ranks[(symbols[:-1] < 0) | (symbols[1:] < 0)] = -1
        at = np.flatnonzero(ranks >= 0)
        index: dict[int, tuple[list[np.ndarray], list[int]]] = {}
        self._enter(index, [], ranks[at], at)
        self._apply(symbols, index)
        live = symbols >= 0
        upto = np.concatenate(([0], np.cumsum(live)))[np.concatenate(([1], ends))] * 4
        ids = symbols[live].astype("<u4").tobytes()
        stops = upto.tolist()
        self.known.update((w, ids[stops[k] : stops[k + 1]]) for k, w in enumerate(words))

    @staticmethod
    def _enter(index: dict[int, tuple[list[np.ndarray], list[int]]], active: list[int], ranks: np.ndarray, places: np.ndarray) -> None:
        """Add places to the lists of their ranks."""
        if not len(ranks):
            return
        order = np.argsort(ranks, kind="stable")
        ranks, places = ranks[order], places[order]
        edges = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
        edges = [0, *edges.tolist(), len(ranks)]
        for r, a, b in zip(ranks[edges[:-1]].tolist(), edges, edges[1:], strict=False):
            if r in index:
                index[r][0].append(places[a:b])
            else:
                index[r] = [places[a:b]], []
                heapq.heappush(active, r)

    def _apply(self, symbols: np.ndarray, index: dict[int, tuple[list[np.ndarray], list[int]]]) -> None:
        """-1 stands between pre-tokens, -2 for what a merge took in. An entry has places in arrays and single ones."""
        after, before = np.arange(1, len(symbols) + 1), np.arange(-1, len(symbols) - 1)
        symbol, behind, ahead = memoryview(symbols), memoryview(after), memoryview(before)
        rank, active = self.rank.get, sorted(index)
        while active:
            r = heapq.heappop(active)
            left, right, new = self.rules[r]
            many, places = index.pop(r)
            if len(places) + sum(map(len, many)) >= MANY:
                i = np.concatenate((*many, np.array(places, dtype=np.int64)))
                i = i[symbols[i] == left]
                i = np.sort(i[symbols[after[i]] == right])
                once = np.ones(len(i), dtype=bool)
                once[1:] = i[1:] != i[:-1]  # a place may have come from both of its sides
                i = i[once]
                if left == right:  # of overlapping places every other one, from the left
                    heads = np.ones(len(i), dtype=bool)
                    heads[1:] = after[i[:-1]] != i[1:]
                    heads = np.flatnonzero(heads)
                    i = i[(np.arange(len(i)) - np.repeat(heads, np.diff(np.append(heads, len(i))))) % 2 == 0]
                j = after[i]
                symbols[i], symbols[j] = new, -2
                k = after[i] = after[j]
                before[k] = i
                h = before[i]
                ranks, at = np.concatenate((self.end.find(new, symbols[h]), self.begin.find(new, symbols[k]))), np.concatenate((h, i))
                merges = ranks >= 0
                self._enter(index, active, ranks[merges], at[merges])
                continue
            for some in many:
                places += some.tolist()
            if left == right:
                places.sort()  # overlapping places of one pair merge from the left
            for i in places:
                j = behind[i]
                if symbol[i] != left or symbol[j] != right:
                    continue
                symbol[i], symbol[j] = new, -2
                k = behind[i] = behind[j]
                ahead[k] = i
                h = ahead[i]
                for at, s, pair in ((h, symbol[h], symbol[h] << 20 | new), (i, symbol[k], new << 20 | symbol[k])):
                    if s >= 0 and (x := rank(pair)) is not None:
                        if x in index:
                            index[x][1].append(at)
                        else:
                            index[x] = [], [at]
                            heapq.heappush(active, x)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        words, ends = self.cut(texts)
        coded = words.dictionary_encode()
        different = between(coded.dictionary)
        if len(self.known) > REMEMBERED:
            self.known, self.before = {}, self.known
        lacking = [w for w in different if w not in self.known]
        if lacking:
            self.known |= {w: self.before[w] for w in lacking if w in self.before}
            self.learn([w for w in lacking if w not in self.before])
        return between(pa.array(list(map(self.known.__getitem__, different)), pa.large_binary()).take(coded.indices), ends)

    def decode_all(self, ids: np.ndarray, ends: np.ndarray) -> list[bytes]:
        """Texts in UTF-8 of the ids up to each end; bytes that are no UTF-8 become U+FFFD."""
        texts = between(self.bytes_of.take(pa.array(ids)), ends)
        for k, text in enumerate(texts):
            try:
                text.decode()
            except UnicodeDecodeError:
                texts[k] = text.decode("utf-8", "replace").encode()
        return texts

    def decode(self, ids: np.ndarray) -> bytes:
        """Text of ids in UTF-8; bytes that are no UTF-8 become U+FFFD."""
        return self.decode_all(ids, np.array([len(ids)]))[0]


@cache
def encoder(path: str) -> PairIndexBpe:
    return PairIndexBpe(path)


def encode(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Return ``id_col``, ids array<int> per document (null text: no ids); other columns are left out."""
    keys = docs.select(F.col(id_col).alias("key"), text_or_empty(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(vocabulary_path(vocabulary))
        for part, texts in text_parts(batches, "text"):
            ids = [np.frombuffer(x, "<u4").astype(np.int32) for x in bpe.encode(texts)]
            yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(ids, pa.list_(pa.int32()))], ["key", "ids"])

    return keys.mapInArrow(run, f"key {keys.schema['key'].dataType.simpleString()}, ids array<int>").withColumnRenamed("key", id_col)


def decode(encoded: DataFrame, vocabulary: str = "byte_bpe_50k.json", id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Return ``id_col``, text per row of ids (null ids: empty text)."""
    keys = encoded.select(F.col(id_col).alias("key"), F.coalesce(F.col(ids_col), F.array().cast("array<int>")).alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(vocabulary_path(vocabulary))
        for batch in batches:
            ids = batch.column("ids")
            texts = bpe.decode_all(ids.flatten().to_numpy(zero_copy_only=False), ids.offsets.to_numpy()[1:] - ids.offsets[0].as_py())
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(texts, pa.binary()).cast(pa.string())], ["key", "text"])

    return keys.mapInArrow(run, f"key {keys.schema['key'].dataType.simpleString()}, text string").withColumnRenamed("key", id_col)


def round_trip(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode, decode what was encoded, and digest both in one pass over the texts.

    Return ``id_col``, n_tokens, ids_sha256, decoded_sha256; one row per row of ``docs``, repeated rows and null ids too.
    """
    keys = docs.select(F.col(id_col).alias("key"), text_or_empty(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(vocabulary_path(vocabulary))
        for part, texts in text_parts(batches, "text"):
            ids = bpe.encode(texts)
            n = np.array([len(x) // 4 for x in ids], dtype=np.int64)
            ids_digest = [hashlib.sha256(x).hexdigest() for x in ids]
            text_digest = [hashlib.sha256(x).hexdigest() for x in bpe.decode_all(np.frombuffer(b"".join(ids), "<u4"), np.cumsum(n))]
            yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(n, pa.int64()), pa.array(ids_digest, pa.string()), pa.array(text_digest, pa.string())], ["key", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = keys.schema["key"].dataType.simpleString()
    return keys.mapInArrow(run, f"key {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("key", id_col)
