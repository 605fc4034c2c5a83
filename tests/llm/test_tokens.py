import hashlib
import random
import subprocess
import sys
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from spindrift.llm import bin_packing, bpe

from .helpers import documents, odd_texts

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def bytes_reference():
    return tokenizers.Tokenizer.from_file(bpe.vocabulary_path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def words_reference():
    return tokenizers.Tokenizer.from_file(bpe.vocabulary_path("word_bpe_49k.json"))


def test_every_character(bytes_reference, words_reference):
    texts = ["".join(chr(c) + " " * (c % 3 == 0) for c in range(s, min(s + 997, 0x110000)) if not 0xD800 <= c < 0xE000) for s in range(0, 0x110000, 997)]
    own = bpe.PairIndexBpe(bpe.vocabulary_path("byte_bpe_50k.json"))
    words = bin_packing.WordIds(bpe.vocabulary_path("word_bpe_49k.json"))
    for text, a, b in zip(texts, own.encode(texts), words.encode([t.encode() for t in texts]), strict=True):
        assert np.frombuffer(a, "<u4").tolist() == bytes_reference.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(b, "<u4").tolist() == words_reference.encode(text, add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab 'stS\n<|endoftext|>é1.,日")))
def test_any_text(text):
    own = bpe.encoder(bpe.vocabulary_path("byte_bpe_50k.json"))
    reference = tokenizers.Tokenizer.from_file(bpe.vocabulary_path("byte_bpe_50k.json")) if not hasattr(test_any_text, "t") else test_any_text.t
    test_any_text.t = reference
    ids = np.frombuffer(own.encode([text])[0], "<u4")
    assert ids.tolist() == reference.encode(text, add_special_tokens=False).ids
    assert own.decode(ids).decode() == text == reference.decode(ids.tolist(), skip_special_tokens=False)


def test_decoding_ids_that_are_no_text(bytes_reference):
    own = bpe.encoder(bpe.vocabulary_path("byte_bpe_50k.json"))
    rng = random.Random(2)
    for _ in range(300):
        ids = [rng.randrange(50257) for _ in range(8)]
        assert own.decode(np.array(ids)).decode() == bytes_reference.decode(ids, skip_special_tokens=False)


def test_forgetting_changes_nothing(monkeypatch):
    texts = [t or "" for t in odd_texts()]
    path = bpe.vocabulary_path("byte_bpe_50k.json")
    whole = bpe.PairIndexBpe(path).encode(texts)
    monkeypatch.setattr(bpe, "REMEMBERED", 5)
    small = bpe.PairIndexBpe(path)
    assert [small.encode([t])[0] for t in texts] == whole


def test_words_in_use_are_learnt_once(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 50)
    own = bpe.PairIndexBpe(bpe.vocabulary_path("byte_bpe_50k.json"))
    learnt, learn = Counter(), own.learn
    monkeypatch.setattr(own, "learn", lambda words: (learnt.update(w if isinstance(w, bytes) else w.encode() for w in words), learn(words))[1])
    for k in range(40):
        own.encode([f"common words, {' '.join('q' + 'abcdefghij'[n // 10] + 'abcdefghij'[n % 10] + 'z' * k for n in range(20))}"])
    assert learnt[b"common"] == learnt[b" words"] == learnt[b","] == 1
    assert len(own.known) + len(own.before) < 200


@pytest.mark.parametrize("many", [1, 4, 10**9])
def test_places_as_arrays_or_one_by_one(monkeypatch, bytes_reference, many):
    monkeypatch.setattr(bpe, "MANY", many)
    own = bpe.PairIndexBpe(bpe.vocabulary_path("byte_bpe_50k.json"))
    rng = random.Random(4)
    texts = [*(t or "" for t in odd_texts()), *("".join(rng.choice(("ab", "th", "he", "aa", " ", "in", "er", "é", "-", "!!")) for _ in range(rng.randrange(400))) for _ in range(60))]
    assert [np.frombuffer(x, "<u4").tolist() for x in own.encode(texts)] == [bytes_reference.encode(t, add_special_tokens=False).ids for t in texts]


def test_cutting_is_the_pattern():
    own = bpe.encoder(bpe.vocabulary_path("byte_bpe_50k.json"))
    rng = random.Random(5)
    letters = ["'", "'s", "'re", "'l", "'ve", "'d", "s", "e", "l", "a", "É", "日", "1", "²", " ", "  ", "\n", "\t ", "\u00a0", "\u3000", "\x1c", "\x85", "!", "\u0301", "\U0001f600", "\x00"]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(12))) for _ in range(30_000)]
    words, ends = own.cut(texts)
    words, a, pattern = words.to_pylist(), 0, bpe.regex.compile(bpe.PRE_TOKEN)
    for text, b in zip(texts, ends.tolist(), strict=True):
        assert [w.decode() for w in words[a:b]] == pattern.findall(text)
        a = b
    mark = "<|endoftext|>"
    words, ends = own.cut([f"a {mark} b", mark, "", f"{mark}{mark}'s ", " x"])
    assert [w.decode() for w in words.to_pylist()] == ["a", " ", mark, " b", mark, mark, mark, "'s", " ", " x"] and ends.tolist() == [4, 5, 5, 9, 10]


def test_round_trip_query(spark, bytes_reference):
    texts = odd_texts()
    docs = documents(spark, texts)
    got = {r.doc_id: r for r in bpe.round_trip(docs).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        ids = bytes_reference.encode(t or "", add_special_tokens=False).ids
        assert (got[i].n_tokens, got[i].ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert got[i].decoded_sha256 == hashlib.sha256(bytes_reference.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    encoded = bpe.encode(docs)
    assert {r.doc_id: r.text for r in bpe.decode(encoded).collect()} == {i: t or "" for i, t in enumerate(texts)}
    assert bpe.round_trip(docs.limit(0)).count() == 0
    assert bpe.round_trip(documents(spark, ["a", None], ids=[None, None])).count() == 2


def test_packing_remembers_words(monkeypatch):
    path = bpe.vocabulary_path("word_bpe_49k.json")
    letters = "abcdefghijklmnopqrstuvwxyz"
    words = ["".join(letters[n // 26**k % 26] for k in range(4)) for n in range(450_000)]
    parts = [" ".join(words[a : a + 75_000]).encode() for a in range(0, len(words), 75_000)]
    own = bin_packing.WordIds(path)
    before = [own.encode([part])[0] for part in parts]
    monkeypatch.setattr(own, "_ids", None)  # nothing is left to be encoded
    assert [own.encode([part])[0] for part in parts] == before


@pytest.mark.parametrize("forgetful, colliding", [(True, False), (False, True), (True, True)])
def test_packing_memory_changes_nothing(monkeypatch, forgetful, colliding):
    texts = [(t or "").encode() for t in odd_texts()] + [b"", b"\x1c a\x0bB \x85 a\x00 a\x00\x00 K\xe2\x84\xaa <|endoftext|>x| |".replace(b"\x85", b"\xc2\x85")]
    path = bpe.vocabulary_path("word_bpe_49k.json")
    reference = tokenizers.Tokenizer.from_file(path)
    whole = [np.array(reference.encode(t.decode(), add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    if forgetful:
        monkeypatch.setattr(bin_packing, "REMEMBERED", 1)
    if colliding:
        monkeypatch.setattr(bin_packing, "fingerprints", lambda words: np.zeros(len(words), np.uint64))
    own = bin_packing.WordIds(path)
    for _ in range(2):
        assert [own.encode([t])[0] for t in texts] == whole
        assert own.encode(texts) == whole
    assert own.encode([]) == []


HELD = """
import re
from pathlib import Path
import pyarrow as pa
import pyarrow.compute as pc
from spindrift.llm.common import byte_parts

def held():
    return sum(map(int, re.findall(r"Pss_Anon:\\s+(\\d+)", Path("/proc/self/smaps_rollup").read_text()))) >> 10

def stream():
    for n in range(8):
        yield pa.RecordBatch.from_pydict({"text": [" ".join(f"{n}w{k * 1000 + i}" for i in range(1000)) for k in range(600)]})

before = held()
for _, texts in byte_parts(stream(), "text"):
    words = pc.ascii_split_whitespace(pa.array(texts).view(pa.string())).flatten().dictionary_encode()
    words = words.dictionary.take(pc.sort_indices(words.dictionary))
    words = texts = None
print(held() - before, pa.total_allocated_bytes() >> 20)
"""


@pytest.mark.skipif(not Path("/proc/self/smaps_rollup").exists(), reason="tells a process's memory by Linux's /proc")
def test_parts_give_memory_back():
    held, used = map(int, subprocess.run([sys.executable, "-c", HELD], capture_output=True, text=True, check=True).stdout.split())
    assert held < used + 48


def check_packing(rows, texts, reference, capacity):
    by_doc, bins = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        bins[r.sequence_id].append((r.offset, r.length))
    for i, t in enumerate(texts):
        ids = [*reference.encode(t or "", add_special_tokens=False).ids, 0]
        parts = sorted(by_doc[i], key=lambda r: r.piece)
        assert [r.piece for r in parts] == list(range(-(-len(ids) // capacity)))
        for r in parts:
            piece = ids[r.start : r.start + r.length]
            assert r.start == r.piece * capacity and len(piece) == r.length <= capacity
            assert r.ids_crc32 == zlib.crc32(np.array(piece, "<u4").tobytes())
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


def test_packing_query(spark, words_reference):
    texts = odd_texts() * 3
    docs = documents(spark, texts)
    for capacity in (64, 2048):
        rows = bin_packing.pack(docs, capacity).collect()
        n = check_packing(rows, texts, words_reference, capacity)
        assert n <= -(-sum(r.length for r in rows) // capacity) + 2
    assert bin_packing.pack(docs.limit(0)).count() == 0
    one = bin_packing.pack(documents(spark, [None, None, ""], ids=[4, 4, None])).collect()
    assert sorted((r.length, r.offset) for r in one) == [(1, 0), (1, 1), (1, 2)]


def test_solutions_are_whole_and_better_than_best_fit():
    rng = random.Random(4)
    better = 0
    for _ in range(40):
        capacity = rng.choice([50, 100, 2048])
        counts = Counter(rng.choices(range(1, capacity + 1), k=rng.choice([1, 8, 100, 2000])))
        fit, best = bin_packing.best_fit(counts, capacity), bin_packing.solve(counts, capacity, 2000)
        for solution in (fit, best):
            used = Counter()
            for filling, bins in solution:
                assert bins > 0 and sum(s * n for s, n in filling) <= capacity
                for s, n in filling:
                    used[s] += n * bins
            assert used == counts
        a, b = (sum(n for _, n in x) for x in (fit, best))
        assert -(-sum(s * n for s, n in counts.items()) // capacity) <= b <= a
        better += b < a
    assert better


@pytest.mark.parametrize(("low", "high", "pieces", "gain"), [(300, 1500, 5000, 8), (5, 2048, 20_000, 0), (650, 1100, 3000, 8)])
def test_search_gains_on_best_fit(low, high, pieces, gain):
    rng = random.Random(1)
    counts = Counter(rng.randint(low, high) for _ in range(pieces))
    fit, best = (sum(n for _, n in x) for x in (bin_packing.best_fit(counts, 2048), bin_packing.solve(counts, 2048)))
    assert bin_packing.least_bins(counts, 2048) <= best <= fit - gain


def test_lower_bound_against_the_optimum():
    """Small cases, every packing tried."""

    def optimum(sizes, rooms):
        if not sizes:
            return len(rooms)
        best = len(rooms) + len(sizes)
        for k in {r: k for k, r in enumerate(rooms) if r >= sizes[0]}.values():
            best = min(best, optimum(sizes[1:], [r - sizes[0] if i == k else r for i, r in enumerate(rooms)]))
        return min(best, optimum(sizes[1:], [*rooms, 20 - sizes[0]]))

    rng = random.Random(9)
    for _ in range(60):
        sizes = sorted((rng.randrange(1, 21) for _ in range(rng.randrange(1, 8))), reverse=True)
        least = optimum(sizes, [])
        assert bin_packing.least_bins(Counter(sizes), 20) <= least
        assert sum(n for _, n in bin_packing.solve(Counter(sizes), 20)) == least


def test_best_fit_equals_piece_by_piece():
    rng = random.Random(6)
    for _ in range(50):
        sizes = sorted((rng.randrange(1, 101) for _ in range(rng.randrange(1, 200))), reverse=True)
        rooms: list[int] = []
        for s in sizes:
            fits = [r for r in rooms if r >= s]
            if fits:
                rooms.remove(min(fits))
                rooms.append(min(fits) - s)
            else:
                rooms.append(100 - s)
        assert sum(n for _, n in bin_packing.best_fit(Counter(sizes), 100)) == len(rooms)
