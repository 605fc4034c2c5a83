import random
import re
from collections import Counter
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from spindrift.llm import filter_audit, vector_codes

from .helpers import WORDS, documents, odd_texts

pytest.importorskip("xxhash")


def plain_audit(rows, labels):
    """rows: (doc_id, part, text); labels: (doc_id, quality, toxic)."""
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    least = {}
    for i, _, text in rows:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    fails = []
    for i, part, text in rows:
        text = text or ""
        words = WORDS.findall(text)
        found = {
            "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text),
            "D": re.search(r"[#$%&*|]", text) is not None, "E": text in least and (i is None or i > least[text]),
        }
        fails.append((part or "", {k for k, v in found.items() if v}, i in good, i in toxic))
    out = set()
    for part in {f[0] for f in fails}:
        mine = [f[1:] for f in fails if f[0] == part]
        shares, steps = Counter(), []
        for order in permutations("ABCDE"):
            for k, letter in enumerate(order):
                left = [f for f in mine if not f[0] & set(order[:k])]
                gone = [f for f in left if letter in f[0]]
                shares[letter] += len(gone)
                failing = sum(letter in f[0] for f in mine)
                steps.append((letter, ("".join(order), k + 1, len(left) - len(gone), len(gone), failing - len(gone), sum(f[0] == {letter} for f in mine), sum(f[1] for f in gone), sum(f[2] for f in gone))))
        out |= {(part, *values, shares[letter]) for letter, values in steps}
    return out


LABELS = "doc_id long, quality int, toxic int, text string, part string"


@pytest.mark.parametrize("chain_bytes", [1 << 24, 2000])
def test_audit_equals_plain_version(spark, chain_bytes, monkeypatch):
    monkeypatch.setattr(filter_audit.masks, "__defaults__", (*filter_audit.masks.__defaults__[:-1], chain_bytes))
    texts = odd_texts() + [t and t.replace("e", "E") for t in odd_texts(2)[:30]] + ["cost: 5 $ # | "] * 40
    ids = [i % 70 if i % 11 else None for i in range(len(texts))]
    docs = documents(spark, texts, ids)
    labels = [(i, i % 2, i % 3 == 0 and 1 or 0, "x", "y") for i in range(0, 80, 2)] + [(4, 1, None, "x", "y"), (None, 1, 1, None, None), (6, None, 1, None, None), (200, 1, 1, None, None)]
    got = [tuple(r) for r in filter_audit.audit(docs, spark.createDataFrame(labels, LABELS)).collect()]
    rows = [(r.doc_id, r.lang, r.text) for r in docs.collect()]
    assert len(got) == len(set(got)) and set(got) == plain_audit(rows, [x[:3] for x in labels])


def test_audit_of_nothing_and_other_rules(spark):
    none = spark.createDataFrame([], LABELS)
    docs = documents(spark, ["a b", "a b", "c", None])
    assert filter_audit.audit(docs.limit(0), none).count() == 0
    found = filter_audit.audit(docs, none, {"S": lambda raw, words: len(words) < 2}, "X").where("part = 'en'").collect()
    assert {(r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails) for r in found} == {("SX", 1): (1, 2, 0, 2), ("SX", 2): (0, 1, 0, 1), ("XS", 1): (2, 1, 0, 1), ("XS", 2): (0, 2, 0, 2)}


def test_copies_carry_ids_that_are_not_the_smallest(spark):
    docs = documents(spark, ["a", "b", "a", "a", None, ""], ids=[7, 1, 3, 9, 5, 2])
    assert sorted(r.doc_id for r in filter_audit.copies(docs).collect()) == [5, 7, 9]
    named = spark.createDataFrame([("k2", "x"), ("k10", "x"), (None, "x")], "doc_id string, text string")
    assert sorted(str(r.doc_id) for r in filter_audit.copies(named).collect()) == ["None", "k2"]


def test_one_hash_may_hold_unequal_texts():
    sent = [(1, (b"x", 5, [("p", 0)])), (1, (b"y", 4, [("p", 0)])), (1, (b"x", 3, [("q", 2)])), (1, (b"y", 4, [("r", 0)])), (2, (None, 8, [("p", 1)])), (3, (b"x", None, [("p", 0)]))]
    assert sorted(filter_audit.judged(16)(iter(sent)), key=str) == [(3, "q", 2), (4, "p", 0), (4, "r", 0), (5, "p", 16), (8, "p", 17), (None, "p", 0)]


def test_copies_of_a_task_travel_without_text():
    rows = [(i, "p", "same text") for i in range(100)] + [(0, "p", "same text")]
    sent = list(filter_audit.routed({}, 1 << 20)(iter(rows)))
    assert sum(record[0] is not None for _, record in sent) == 1
    assert len({route for route, record in sent if record[0] is None}) == 99  # dealt out


def plain_codes(rows, parts=4, entries=256, rounds=4):
    """rows: (vec_id, whole numbers), in order of id -> codes, errors, books."""
    width = len(rows[0][1]) // parts
    cut = [[v[p * width : (p + 1) * width] for p in range(parts)] for _, v in rows]
    books = [[cut[k][p] for k in range(min(entries, len(rows)))] for p in range(parts)]

    def nearest(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), e) for e, c in enumerate(books[p]))

    for _ in range(rounds):
        for p in range(parts):
            own = [[] for _ in books[p]]
            for x in cut:
                own[nearest(p, x[p])[1]].append(x[p])
            books[p] = [[sum(col) // len(o) for col in zip(*o, strict=True)] if o else c for o, c in zip(own, books[p], strict=True)]
    found = [[nearest(p, x[p]) for p in range(parts)] for x in cut]
    return [[e for _, e in f] for f in found], [sum(d for d, _ in f) for f in found], books


SCHEMA = "vec_id long, embedding array<float>, label int, codes string, error int, key string, vector int"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, label, "x", 1, "y", 2) for i, v, label in rows], SCHEMA).repartition(3)


@pytest.mark.parametrize(("entries", "scale", "block_rows"), [(8, 1.0, 7), (256, 1.0, 1000), (16, 0.003, 50), (5, 3e5, 40)])
def test_codes_equal_plain_lloyd(spark, entries, scale, block_rows):
    rng = random.Random(entries)
    centres = [[rng.gauss(0, 1) * scale for _ in range(12)] for _ in range(6)]
    rows = [(3 * i % 331, [float(np.float32(x + rng.gauss(0, 0.2) * scale)) for x in rng.choice(centres)], None if i % 5 == 0 else i % 3) for i in range(331)]
    rows += [(400 + i, rows[0][1], 7) for i in range(20)]  # ties
    bad = [(-1, None, 1), (-2, [float("nan")] * 12, 1), (-3, [float("inf"), *[0.0] * 11], 1), (-4, [None, *[0.0] * 11], 1), (-5, [], 1), (500, [1.0] * 11, 1)]
    found, books = vector_codes.compressed(vectors(spark, rows + bad), entries=entries, block_rows=block_rows)
    whole = sorted((i, np.floor(np.array(v, dtype=np.float32).astype(float) * 1024).astype(int).tolist(), label) for i, v, label in rows)
    codes, errors, expected = plain_codes([x[:2] for x in whole], entries=entries)
    got = {r.vec_id: (r.codes, r.error) for r in found.collect()}
    assert got == {x[0]: (c, e) for x, c, e in zip(whole, codes, errors, strict=True)}
    assert books.entries.tolist() == expected
    sums = Counter()
    for (_, _, label), e in zip(whole, errors, strict=True):
        sums[label] += e
    assert {(r.label, r.label_error) for r in vector_codes.with_label_error(found).collect()} == {(k, min(v, 2**63 - 1)) for k, v in sums.items()}


def test_codes_edges(spark, monkeypatch):
    none, books = vector_codes.compressed(vectors(spark, [(1, None, 1)]))
    assert none.count() == 0 and none.columns == ["vec_id", "label", "codes", "error"]
    assert vector_codes.with_label_error(none).count() == 0 and len(vector_codes.digest(books)) == 64
    one = [(None, [0.5, 0.25, 0.125], None), (None, [0.5, 0.25, 0.125], None), (2, [1.0, 0.0, 1e30], 3)]
    found, books = vector_codes.compressed(vectors(spark, one))  # three components, four parts; components beyond the limit
    assert books.entries.shape == (4, 3, 1) and books.entries[2, 0, 0] == vector_codes.LARGEST
    assert sorted((str(r.vec_id), r.codes, r.error) for r in found.collect()) == [("2", [0, 0, 0, 0], 0), ("None", [1, 1, 1, 0], 0), ("None", [1, 1, 1, 0], 0)]
    monkeypatch.setattr(vector_codes, "BROADCAST_BYTES", 0)
    assert vector_codes.with_label_error(found).agg(F.sum("label_error")).first()[0] == 0


def test_later_rounds_pop_few_parts_and_miss_none():
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(16, 4)) * 5
    x = vector_codes.whole(np.concatenate([c + rng.normal(size=(200, 4)) * 0.3 for c in centres])[rng.permutation(3200)])
    books = vector_codes.Books(x[:16][None].copy(), np.zeros((1, 16)))
    codes, heaps, looked = None, None, []
    for _ in range(12):
        codes, heaps, popped = vector_codes.advanced(x, books.entries[0], books.drift[0], codes, heaps)
        squares = ((x[:, None] - books.entries[0][None]) ** 2).sum(axis=2)
        assert (codes == squares.argmin(axis=1)).all()
        looked.append(len(popped))
        total = vector_codes.changes(x[None], np.full((1, len(x)), -1), codes[None], 16).astype(object)
        books = vector_codes.moved(books, total)
    assert looked[0] == 3200 and looked[-1] < 320
    for e in range(16):
        heap = heaps.heap(e)
        assert all(heap[(k - 1) // 2] <= heap[k] for k in range(1, len(heap)))
