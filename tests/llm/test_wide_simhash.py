import random

import corpus_pipeline
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spindrift.llm import connected, wide_simhash
from spindrift.llm.common import shared_dir

from .helpers import WORDS, ascii_lower, documents, odd_texts
from .test_dedup import plain_components

xxhash = pytest.importorskip("xxhash")
FULL = (1 << 64) - 1


def finalised(x):
    x = ((x ^ x >> 30) * 0xBF58476D1CE4E5B9) & FULL
    x = ((x ^ x >> 27) * 0x94D049BB133111EB) & FULL
    return x ^ x >> 31


def plain_wide_fingerprint(text, n_words=4):
    words = WORDS.findall(ascii_lower(text or ""))
    shingles = [" ".join(words[k : k + 5]) for k in range(len(words) - 4)] or ([" ".join(words)] if words else [])
    hashes = []
    for s in dict.fromkeys(shingles):  # each counts once
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        hashes.append(sum((h if k == 0 else finalised((h + k * 0x9E3779B97F4A7C15) & FULL)) << 64 * k for k in range(n_words)))
    return sum(1 << b for b in range(64 * n_words) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def edited(rng, words, share):
    return [rng.choice(words) + "x" if rng.random() < share else w for w in words]


def test_nulls_and_empty(spark):
    assert wide_simhash.near_duplicates(documents(spark, ["a"]).limit(0)).count() == 0
    nulls = wide_simhash.near_duplicates(documents(spark, ["a b c d", "a b c d", None], ids=[None, 3, None])).collect()
    assert sorted((r.key is None, r.component_id) for r in nulls if r.component_id is not None) == [(False, 3), (True, 3)] and len(nulls) == 3
    # The empty text is alone with its null id, so the rows that share that id stay.
    assert wide_simhash.one_per_group(documents(spark, ["a b c d", "a b c d", None], ids=[None, 3, None])).count() == 3


@pytest.mark.parametrize("cell_rows", [8192, 40])
def test_dense_groups_and_overfull_cells(spark, cell_rows):
    """Groups about common centres among strangers: components are whole, also where cells go by blocks."""
    rng = np.random.default_rng(4)
    rows = [rng.integers(0, 1 << 63, 4, dtype=np.uint64) for _ in range(200)]
    for centre in rows[:3]:
        for _ in range(150):
            bits = np.zeros(256, dtype=np.uint8)
            bits[rng.choice(256, 12, replace=False)] = 1
            rows.append(centre ^ np.packbits(bits, bitorder="little").view("<u8"))
    x = np.array(rows, dtype=np.uint64)
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(x.view(np.int64).tolist())], "vertex long, w0 long, w1 long, w2 long, w3 long")
    links = [(r.u, r.v) for r in wide_simhash.near_links(df, shared_dir(spark), 4, 46, 32, cell_rows).collect()]
    distance = lambda a, b: int(np.bitwise_count(x[a] ^ x[b]).sum())
    expected = plain_components(list(range(len(x))), lambda a, b: distance(a, b) <= 46)
    joined = connected.components(spark.createDataFrame(links, "u long, v long"), shared_dir(spark)).collect()
    assert {v: v for v in range(len(x))} | {r.vertex: r.root for r in joined} == expected
    assert len(links) < 40 * len(x) * (1 if cell_rows == 8192 else 16)


def test_recall_grows_not_with_strangers(spark):
    """Pairs at the distance that similarity 0.85 gives, among strangers: nine of ten are linked."""
    rng = np.random.default_rng(8)
    x = rng.integers(0, 1 << 63, (6000, 4), dtype=np.uint64)
    for i in range(0, 400, 2):
        bits = np.zeros(256, dtype=np.uint8)
        bits[rng.choice(256, 33, replace=False)] = 1
        x[i + 1] = x[i] ^ np.packbits(bits, bitorder="little").view("<u8")
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(x.view(np.int64).tolist())], "vertex long, w0 long, w1 long, w2 long, w3 long")
    found = {tuple(sorted((r.u, r.v))) for r in wide_simhash.near_links(df, shared_dir(spark), 4, 46, 32).collect()}
    assert found <= {(i, i + 1) for i in range(0, 400, 2)} and len(found) >= 190


def test_label_is_the_first_of_each_component():
    u, v = np.array([1, 2, 5, 7]), np.array([2, 3, 6, 5])
    assert wide_simhash.first_of(8, u, v).tolist() == [0, 1, 1, 1, 4, 5, 5, 5]
    batch = pa.RecordBatch.from_arrays([pa.array([1, 1]), pa.array([4, 9]), *[pa.array([0, 1])] * 4], ["code", "vertex", "w0", "w1", "w2", "w3"])
    assert [r for b in wide_simhash.links_of(iter([batch]), 4, 46) for r in b.to_pylist()] == [{"code": None, "u": 9, "v": 4}]


@pytest.mark.parametrize("n", [75_000, 20_000_000])
def test_stated_recall_at_any_size(n):
    """Pairs whose bits differ as at similarity 0.8, in cells as fine as for n fingerprints."""
    rng = np.random.default_rng(n)
    distance, pairs = 56, 2000
    x = rng.integers(0, 256, (pairs, 32), dtype=np.uint8)
    flips = np.packbits(rng.random((pairs, 256)) < np.arccos(1.6 / 1.8) / np.pi, axis=1)
    both = np.stack([x, x ^ flips], axis=1).reshape(-1, 32)
    words = np.ascontiguousarray(both).view(np.int64)
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(2 * pairs)), *(pa.array(np.ascontiguousarray(words[:, k])) for k in range(4))], ["vertex", "w0", "w1", "w2", "w3"])
    tables = wide_simhash.tables_for(n, distance, 4)
    met = np.zeros(pairs, dtype=bool)
    for cell in wide_simhash.coded([batch], 4, wide_simhash.chosen_bits(4, tables, wide_simhash.bits_for(n))):
        code = cell.column("code").to_numpy()
        met |= code[::2] == code[1::2]
    found = met & (np.unpackbits(flips, axis=1).sum(axis=1) <= distance)
    assert found.mean() >= 0.93
    assert tables >= 32 and abs(found.mean() - wide_simhash.recall_of(wide_simhash.bits_for(n), tables, distance, 4)) < 0.03


def shingle_set(text):
    words = WORDS.findall(ascii_lower(text or ""))
    return {" ".join(words[k : k + 5]) for k in range(len(words) - 4)} or ({" ".join(words)} if words else set())


def similar(a, b):
    return not a | b or 10 * len(a & b) >= 8 * len(a | b)


def test_only_similar_texts_are_dropped(spark):
    """Edits of all grades, chains, and texts that share a fingerprint but not their shingles, against every pair's Jaccard similarity."""
    rng = random.Random(11)
    texts = ["a a a a a", "a a a a a a b", None, "", "x y"]
    for _ in range(25):
        words = [f"w{rng.randrange(3000)}" for _ in range(200)]
        texts += [" ".join(edited(rng, words, share)) for share in (0.0, 0.005, 0.015, 0.03, 0.04, 0.05)]
    sets = [shingle_set(t) for t in texts]
    expected = plain_components(list(range(len(texts))), lambda a, b: similar(sets[a], sets[b]))
    stay = {r.doc_id for r in corpus_pipeline.near(spark, documents(spark, texts), "").collect()}
    assert stay == {i for i, c in expected.items() if i == c}


@pytest.mark.parametrize("block_rows", [2048, 7])
def test_links_are_similar_also_across_blocks(spark, block_rows):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, (3, 60), dtype=np.uint64)
    sets = [np.unique(np.r_[base[i % 3][rng.random(60) < 0.93], rng.integers(0, 1 << 63, 2, dtype=np.uint64)]) for i in range(60)]
    groups = spark.createDataFrame([(i, 0, len(x), x.tobytes()) for i, x in enumerate(sets)], "vertex long, root long, size long, shingles binary")
    links = [(r.u, r.v) for r in wide_simhash.verified_links(wide_simhash.placed_blocks(groups, 60, block_rows), 0.8).collect()]
    ok = lambda a, b: similar(set(sets[a].tolist()), set(sets[b].tolist()))
    assert links and all(ok(u, v) for u, v in links)
    linked = {frozenset(p) for p in links}
    plain = plain_components(list(range(60)), ok)
    assert plain_components(list(range(60)), lambda a, b: frozenset((a, b)) in linked) == plain


def test_odd_texts_against_all_pairs(spark):
    texts = [t for t in odd_texts(2) if t is None or len(t) < 5_000]
    sets = [shingle_set(t) for t in texts]
    docs = documents(spark, texts).withColumn("place", F.lit(1)).withColumn("out0_0", F.lit(2)).withColumn("vertex", F.lit(3))
    got = {r.key: r.component_id for r in wide_simhash.near_duplicates(docs).collect()}
    assert got == plain_components(list(range(len(texts))), lambda a, b: similar(sets[a], sets[b]))
    stay = wide_simhash.one_per_group(docs)
    assert stay.columns == docs.columns and sorted(r.doc_id for r in stay.collect()) == sorted(i for i, c in got.items() if i == c)


@pytest.mark.parametrize("groups", [60, 240])
def test_recall_on_texts_against_all_pairs(spark, groups):
    """Pairs of 0.8 to 0.9 among strangers, half of them of texts that repeat a few lines many times: the bits alone propose 95 of 100, at two sizes."""
    rng = random.Random(groups)
    texts, near = [], []
    for k in range(groups):
        words = [f"w{rng.randrange(5000)}" for _ in range(240)]
        other = list(words)
        for at in rng.sample(range(240), rng.randrange(3, 6)):
            other[at] += "x"
        if k % 2:  # one copy of every line but the first, which comes fifty times in one text and once in the other
            words = words[:12] * 50 + words
        near.append((len(texts), len(texts) + 1))
        texts += [" ".join(words), " ".join(other)]
    sets = [shingle_set(t) for t in texts]
    wanted = [p for p in near if similar(sets[p[0]], sets[p[1]])]
    assert len(wanted) > groups // 2
    names = [f"w{k}" for k in range(4)]
    prints = wide_simhash.prints_of(documents(spark, texts), "doc_id", "text", 5, 42, 4).select(F.col("key").alias("vertex"), *names)
    links = [(r.u, r.v) for r in wide_simhash.near_links(prints, shared_dir(spark), 4, 56).collect()]
    linked = {frozenset(x) for x in links}
    roots = plain_components(sorted({v for x in links for v in x} | {v for x in wanted for v in x}), lambda a, b: frozenset((a, b)) in linked)
    assert sum(roots[a] == roots[b] for a, b in wanted) >= 0.95 * len(wanted)


def test_sketches_never_overstate():
    rng = np.random.default_rng(6)
    sets = [np.unique(rng.integers(0, 1 << 63, rng.integers(1, 400), dtype=np.uint64)) for _ in range(40)]
    sets += [np.union1d(sets[k][rng.random(len(sets[k])) < 0.9], sets[k + 1][:5]) for k in range(39)]
    bits = wide_simhash.sketches(sets)
    for a in range(len(sets)):
        for b in range(a):
            assert int(np.bitwise_count(bits[a] ^ bits[b]).sum()) <= len(np.setxor1d(sets[a], sets[b]))
