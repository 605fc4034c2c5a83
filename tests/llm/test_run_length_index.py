import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from spindrift.llm import run_length_index as rli

from .helpers import documents, odd_texts


def plain_trim(texts: dict[int, str | None], length: int) -> dict[int, tuple]:
    """Every byte of a window that starts at another place as well goes."""
    raw = {k: (t or "").encode() for k, t in texts.items()}
    starts = Counter(b[i : i + length] for b in raw.values() for i in range(len(b) - length + 1))
    out = {}
    for k, b in raw.items():
        gone = np.zeros(len(b) + 1, dtype=bool)
        for i in range(len(b) - length + 1):
            if starts[b[i : i + length]] > 1:
                gone[i : i + length] = True
        spans = int((np.diff(np.r_[False, gone].astype(np.int8)) == 1).sum())
        out[k] = (len(b), int(gone.sum()), spans, bytes(x for x, g in zip(b, gone, strict=False) if not g))
    return out


def lines_of(seed: int) -> list[bytes]:
    rng = random.Random(seed)
    base = bytes(rng.choice(b"ab") for _ in range(60))
    found = {base, b"a" * 50, b"ab" * 30, b"\x00\x00\x00", b"\x00" * 20, b"x"}
    for _ in range(12):
        cut = rng.randrange(60)
        found.add(base[:cut] + bytes(rng.choice(b"abc") for _ in range(rng.randrange(1, 9))) + base[cut:])
    return sorted(found, key=lambda _: rng.random())


@pytest.mark.parametrize("seed", range(6))
def test_index_is_the_run_compressed_transform(seed):
    lines = lines_of(seed)
    text = b"\xff".join(lines) + b"\xff"
    index = rli.RunLengthIndex(lines)
    order = sorted(range(len(text)), key=lambda i: text[i:])
    transform = [text[i - 1] if i else 256 for i in order]
    assert np.repeat(index.symbols, index.sizes).tolist() == transform
    assert (index.symbols[1:] != index.symbols[:-1]).all()
    bounds = index.bounds.tolist()
    expected = np.zeros(len(text), dtype=int)
    line_end = {i: b - 1 for a, b in zip(bounds[:-1], bounds[1:], strict=True) for i in range(a, b)}
    for i in range(len(text)):
        for j in range(len(text)):
            if i != j:
                k = 0
                while i + k < line_end[i] and j + k < line_end[j] and text[i + k] == text[j + k]:
                    k += 1
                expected[i] = max(expected[i], k)
    inside = [i for i in range(len(text)) if i < line_end[i]]
    assert index.statistics()[inside].tolist() == expected[inside].tolist()


def test_repetitive_lines_have_few_runs():
    rng = random.Random(1)
    base = bytes(rng.randrange(97, 123) for _ in range(2000))
    lines = [base[:k] + b"!" + base[k:] for k in range(0, 2000, 50)]
    index = rli.RunLengthIndex(lines)
    assert len(index.sizes) < index.n / 10


def test_lines_hold_each_window_once_and_anchors_follow_contents():
    rng = random.Random(2)
    shared = bytes(rng.randrange(97, 100) for _ in range(300))
    texts = [bytes(rng.randrange(97, 123) for _ in range(n)) + shared + bytes(rng.randrange(97, 123) for _ in range(n)) for n in (0, 17, 150)] + [b"xy" * 6000, b"", b"q" * 39, b"q" * 40]
    ends = np.cumsum([len(t) for t in texts])
    blob = b"".join(texts)
    first, n, value, inner = rli.anchored(np.frombuffer(blob, np.uint8), ends, 40, 10)
    windows = [a + k for a, m in zip(first.tolist(), n.tolist(), strict=True) for k in range(m)]
    assert sorted(windows) == [e - len(t) + i for e, t in zip(ends.tolist(), texts, strict=True) for i in range(len(t) - 39)]
    anchors = defaultdict(set)
    for a, m, v in zip(first.tolist(), n.tolist(), value.tolist(), strict=True):
        for k in range(m):
            anchors[blob[a + k : a + k + 40]].add(v)
    assert all(len(v) == 1 for v in anchors.values())
    assert n.max() <= rli.LINE_WINDOWS and inner.any()


def test_windows_over_chunks(monkeypatch):
    rng = random.Random(4)
    raw = np.frombuffer(bytes(rng.randrange(97, 99) for _ in range(3000)), np.uint8)
    whole = rli.anchored(raw, np.array([1000, 3000]), 40, 10)
    monkeypatch.setattr(rli, "PLACE_BITS", 8)
    parts = rli.anchored(raw, np.array([1000, 3000]), 40, 10)
    spread = [np.repeat(x[2], x[1]).tolist() for x in (whole, parts)]
    assert len(spread[0]) == len(spread[1]) == int(whole[1].sum()) and spread[0] == spread[1]


def texts_for_trim() -> list[str | None]:
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdeéß日") for _ in range(rng.randrange(1, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passage, base = prose(30), prose(200)
    edited = [base[:k] + "#" + base[k:] for k in (5, 300, 301, 500)]
    return [None, "", "a", "x" * 500, "ab" * 400, passage, prose(40) + passage + prose(40), passage + prose(3), passage[3:-3], base, base, *edited, prose(50) + base[100:150] + prose(20), *(prose(60) for _ in range(20)), *(prose(rng.randrange(30)) + passage[k:] for k in range(8))]


@pytest.mark.parametrize(("hot", "slice_bytes", "group_bytes"), [(2000, 1 << 20, 1 << 20), (2, 1500, 4000), (0, 700, 1000)])
def test_trim_equals_plain_version(spark, hot, slice_bytes, group_bytes):
    texts = dict(enumerate(texts_for_trim()))
    docs = documents(spark, list(texts.values()))
    got = {r.doc_id: (r.n_bytes, r.n_removed, len(r.spans), bytes(r.kept)) for r in rli.trimmed(docs, 40, 12, slice_bytes, group_bytes, hot).collect()}
    assert got == plain_trim(texts, 40)


def test_trim_with_production_parameters(spark):
    texts = dict(enumerate(t for t in odd_texts() if t is None or len(t) < 60_000))
    rng = random.Random(3)
    long = "".join(rng.choice("abcdefgh ") for _ in range(900))
    texts |= {100: long, 101: long[:399] + "!" + long[399:], 102: "!" + long[100:500], 103: "!" + long[600:999] + "?", 104: "y" * 401, 105: "z" * 400}
    docs = documents(spark, list(texts.values()), list(texts))
    result = rli.trimmed(docs)
    got = {r.doc_id: (r.n_bytes, r.n_removed, len(r.spans), bytes(r.kept)) for r in result.collect()}
    assert got == plain_trim(texts, 400)
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("bucketed_")]
    plan = result._jdf.queryExecution().executedPlan().toString()
    assert "blob" not in "".join(line for line in plan.splitlines() if "Exchange" in line)  # texts stay where they are


def test_trim_of_nothing_and_of_equal_or_missing_ids(spark):
    assert rli.trimmed(documents(spark, ["a"]).limit(0)).count() == 0
    same = "".join(random.Random(5).choice("abcdefg") for _ in range(450))
    rows = rli.trimmed(documents(spark, [same, same, "short", None], ids=[None, 4, 4, None])).collect()
    assert sorted((r.doc_id is None, r.n_bytes, r.n_removed) for r in rows) == [(False, 5, 0), (False, 450, 450), (True, 0, 0), (True, 450, 450)]
