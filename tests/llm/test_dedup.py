import hashlib
import random
from bisect import bisect_right
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from spindrift.llm import connected, exact_dedup, simhash, substring_dedup
from spindrift.llm.common import shared_dir

from .helpers import WORDS, ascii_lower, documents, odd_texts

xxhash = pytest.importorskip("xxhash")


def plain_fingerprint(text):
    words = WORDS.findall(ascii_lower(text or ""))
    shingles = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(items, linked):
    parent = {i: i for i in items}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, a in enumerate(items):
        for b in items[:k]:
            if linked(a, b):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in items}


def test_simhash_query(spark):
    texts = [t for t in odd_texts() if t is None or len(t) < 60_000]
    got = {r.key: (r.fp & (1 << 64) - 1, r.component_id) for r in simhash.near_duplicates(documents(spark, texts)).collect()}
    prints = {i: plain_fingerprint(t) for i, t in enumerate(texts)}
    assert {i: fp for i, (fp, _) in got.items()} == prints
    assert {i: c for i, (_, c) in got.items()} == plain_components(list(prints), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 3)
    assert simhash.near_duplicates(documents(spark, ["a"]).limit(0)).count() == 0
    nulls = simhash.near_duplicates(documents(spark, ["a b c d", "a b c d", None], ids=[None, 3, None])).collect()
    assert sorted((r.key is None, r.component_id) for r in nulls if r.fp) == [(False, 3), (True, 3)]
    assert [r.component_id for r in nulls if not r.fp] == [None]


@pytest.mark.parametrize("cell_rows", [8192, 16])
def test_links_lose_nothing(spark, cell_rows):
    """Dense clusters, chains and strangers; with small cells the dense ones go by blocks."""
    rng = random.Random(9)
    fps = {rng.getrandbits(64) for _ in range(300)}
    for centre in list(fps)[:4]:
        for _ in range(60):
            x = centre
            for b in rng.sample(range(64), rng.randrange(1, 5)):
                x ^= 1 << b
            fps.add(x)
    x = rng.getrandbits(64)
    for _ in range(40):  # a chain of steps of three bits
        for b in rng.sample(range(64), 3):
            x ^= 1 << b
        fps.add(x)
    rows = sorted(f - (1 << 64) if f >> 63 else f for f in fps)
    df = spark.createDataFrame([(f,) for f in rows], "fp long")
    links = simhash.near_links(df, shared_dir(spark), cell_rows).collect()
    unsigned = lambda v: v & (1 << 64) - 1
    assert all((unsigned(r.u) ^ unsigned(r.v)).bit_count() <= 3 for r in links)
    expected = plain_components(rows, lambda a, b: (unsigned(a) ^ unsigned(b)).bit_count() <= 3)
    joined = connected.components(spark.createDataFrame([(r.u, r.v) for r in links], "u long, v long"), shared_dir(spark)).collect()
    got = {v: v for v in rows} | {r.vertex: r.root for r in joined}
    assert got == expected


def test_overfull_cells_pass_and_blocks_find():
    import pyarrow as pa

    rng = np.random.default_rng(3)
    fp = (np.int64(1) << rng.integers(0, 60, 300)).astype(np.int64)
    fp = np.unique(fp)
    batch = lambda f, c: pa.RecordBatch.from_arrays([pa.array(np.full(len(f), c)), pa.array(np.zeros(len(f), np.int64)), pa.array(f)], ["cell", "code", "fp"])
    out = list(simhash.links_of(iter([batch(fp[:15], 1), batch(fp[15:30], 1), batch(fp[30:], 1), batch(fp[:5], 2)]), cell_rows=20))
    rows = [r for b in out for r in b.to_pylist()]
    assert sorted(r["u"] for r in rows if r["cell"] == 1) == sorted(fp.tolist())
    assert len({r["v"] for r in rows if r["cell"] is None} | {r["u"] for r in rows if r["cell"] is None}) == 5
    linked = [r for b in simhash.block_links(iter([batch(fp[:40], 7), batch(fp[40:], 7)])) for r in b.to_pylist()]
    assert len({r["u"] for r in linked} | {r["v"] for r in linked}) == len(fp)


def test_embedding_is_a_lower_bound(spark):
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 1 << 63, 5000, dtype=np.uint64), rng.integers(0, 1 << 63, 5000, dtype=np.uint64)
    counts = lambda x: np.array([[int(v >> np.uint64(2 * k)) & 3 for k in range(32)] for v in x])
    segments = lambda x: (counts(x) & 1) + (counts(x) >> 1)
    manhattan = np.abs(segments(a[:200]) - segments(b[:200])).sum(axis=1)
    assert (np.bitwise_count(simhash.embedded_array(a) ^ simhash.embedded_array(b))[:200] == manhattan).all()
    assert (np.bitwise_count(simhash.embedded_array(a) ^ simhash.embedded_array(b)) <= np.bitwise_count(a ^ b)).all()
    df = spark.createDataFrame([(int(x),) for x in a[:50].view(np.int64)], "fp long").select(simhash.embedded(F.col("fp")).alias("e"))
    assert [r.e for r in df.collect()] == simhash.embedded_array(a[:50]).view(np.int64).tolist()


def test_components_of_random_graphs(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 6000 + i) for i in range(50)]
    found = {r.vertex: r.root for r in connected.components(spark.createDataFrame(edges, "u long, v long"), shared_dir(spark)).collect()}
    both = {tuple(sorted(e)) for e in edges}
    vertices = sorted({v for e in edges if e[0] != e[1] for v in e})
    assert found == plain_components(vertices, lambda a, b: tuple(sorted((a, b))) in both)


def plain_exact(texts, ids):
    groups = defaultdict(list)
    for i, t in zip(ids, texts, strict=True):
        groups[ascii_lower(t or "")].append(i)
    return {(i, max(g), len(g), i == max(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for i in g}


@pytest.mark.parametrize("digest", [exact_dedup.digest_of, lambda norm: F.substring(exact_dedup.digest_of(norm), 1, 1), lambda norm: F.lit(b"x")])
@pytest.mark.parametrize("words", [4 << 20, 1])
def test_exact_groups(spark, monkeypatch, digest, words):
    """Even with digests that unequal texts share, and with a filter that lets nearly all through."""
    monkeypatch.setattr(exact_dedup, "FILTER_WORDS", words)
    texts = [t for t in odd_texts() if t is None or len(t) < 60_000]
    found = exact_dedup.groups(documents(spark, texts), "largest", memtable_rows=7, digest=digest).collect()
    got = {(r.key, r.keep_key, r.group_size, r.kept_rows == 1) for r in found}
    assert got == {x[:4] for x in plain_exact(texts, range(len(texts)))} and len(found) == len(texts)


def test_exact_query_and_rows(spark):
    texts = odd_texts()
    docs = documents(spark, texts)
    assert {tuple(r) for r in exact_dedup.mark(docs, "largest").collect()} == plain_exact(texts, range(len(texts)))
    kept = exact_dedup.deduplicated(docs, "largest")
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {x[0] for x in plain_exact(texts, range(len(texts))) if x[3]}
    assert exact_dedup.mark(docs.limit(0)).count() == 0 and exact_dedup.deduplicated(docs.limit(0)).count() == 0


def test_exact_ties(spark):
    docs = documents(spark, ["A", "a", "a", "b", None, ""], ids=[1, 1, 1, None, None, None])
    rows = exact_dedup.mark(docs, "largest").collect()
    assert sorted((r.doc_id or -1, r.group_size, r.kept) for r in rows) == [(-1, 1, True), (-1, 2, False), (-1, 2, True), (1, 3, False), (1, 3, False), (1, 3, True)]
    assert exact_dedup.deduplicated(docs, "largest").count() == 3


def test_exact_rows_of_any_kind(spark):
    """No other columns; a map column; columns named as the operator's own; equal rows, of which one stays."""
    two = spark.createDataFrame([(1, "a"), (1, "A"), (2, "a"), (None, None), (None, "")], "doc_id long, text string")
    assert sorted((r.doc_id or 0, (r.text or "").lower()) for r in exact_dedup.deduplicated(two).collect()) == [(0, ""), (1, "a")]
    maps = spark.createDataFrame([(1, "a", {"x": 1}), (1, "a", {"x": 1}), (3, "a", None), (3, "b", {}), (3, "b", {"y": 2})], "doc_id long, text string, more map<string,int>")
    assert sorted((r.doc_id, r.text) for r in exact_dedup.deduplicated(maps).collect()) == [(1, "a"), (3, "b")]
    names = ["__d", "__t", "__key", "__row", "digest", "tag", "key_0", "out0_0", "word", "bits", "place"]
    clash = two.select("*", *(F.lit(k).alias(n) for k, n in enumerate(names)))
    kept = exact_dedup.deduplicated(clash, "largest")
    assert kept.columns == clash.columns and sorted((r.doc_id or 0, r.out0_0) for r in kept.collect()) == [(0, 7), (2, 7)]


def test_index_of_batches(spark, tmp_path):
    """Batches meet in runs; a look-up opens only runs whose filters let it, and full levels merge."""
    digest = lambda i: hashlib.sha256(str(i).encode()).digest()
    part = lambda keys, shift=0: spark.createDataFrame([(i, digest(i % 50 + shift)) for i in keys], "key int, digest binary")
    index = exact_dedup.MergeIndex(part([0]), str(tmp_path / "index"), memtable_rows=10)
    index.flush(part(range(60)))
    index.flush(part(range(40, 100)))
    index.compact()
    assert list(index.levels) == [1]
    index.flush(part(range(50), 1000))
    index.compact()
    index.flush(part(range(100, 120), 2000))
    index.compact()
    assert list(index.levels) == [2, 1]
    asked = lambda *of: spark.createDataFrame([(digest(i),) for i in of], "digest binary")
    first, second = index.levels[2], index.levels[1]
    opened = [run for run, _ in index.opened(asked(7))]
    assert first in opened and (second in opened) == (second.filter.passing(asked(7)).count() > 0)
    assert index.opened(asked(*range(-300, -290))) == [] or len(index.opened(asked(-5000))) < 2
    assert sorted((r.key, r.copies) for r in index.known(asked(7)).collect()) == [(7, 1), (57, 2)]
    assert {r.key for r in index.known(asked(1003)).collect()} == {3}
    assert sum(not index.opened(asked(-k)) for k in range(1, 30)) >= 15
    index.flush(part([1, 7, 7]))
    index.compact()
    assert list(index.levels) == [3]
    assert sorted((r.key, r.copies) for r in index.known(asked(7)).collect()) == [(7, 3), (57, 2)]
    smallest = {bytes(r.digest): (r.keep_key, r.group_size) for r in exact_dedup.by_digest(index.rows()).collect()}
    assert smallest[digest(7)] == (7, 5) and len(smallest) == 120


def test_runs_merge_without_a_shuffle(spark, tmp_path):
    rows = spark.createDataFrame([(i or None, bytes([i])) for i in range(50)], "key int, digest binary")
    indexes = [exact_dedup.MergeIndex(rows, str(tmp_path / str(k))) for k in range(2)]
    for index in indexes:
        index.flush(rows)
        index.compact()
    a, b = (index.levels[1].rows for index in indexes)
    assert "Exchange" not in a.join(b, [*exact_dedup.SORTED], "full_outer")._jdf.queryExecution().executedPlan().toString()
    indexes[0].flush(rows)
    indexes[0].compact()
    assert {(r.key, r.copies) for r in indexes[0].rows().collect()} == {(i or None, 2) for i in range(50)} and indexes[0].rows().count() == 50


@pytest.mark.parametrize("keep", ["smallest", "largest"])
def test_compaction_drops_identifiers_and_flushes_ask_filters(spark, tmp_path, monkeypatch, keep):
    digest = lambda i: hashlib.sha256(str(i).encode()).digest()
    part = lambda pairs: spark.createDataFrame([(k, digest(d)) for k, d in pairs], "key long, digest binary")
    index = exact_dedup.MergeIndex(part([(0, 0)]), str(tmp_path / "index"), memtable_rows=5, keep=keep)
    first, second = [(9, 1), (4, 1), (7, 2), (None, 3), (None, 3)], [(6, 1), (2, 1), (None, 2), (8, 5)]
    index.flush(part(first))
    index.compact()
    best = {"smallest": min, "largest": max}[keep]
    assert {(bytes(r.digest), r.key, r.copies, r.keys) for r in index.rows().collect()} == {(digest(1), best(9, 4), 2, 2), (digest(2), 7, 1, 1), (digest(3), None, 2, 2)}
    assert index.levels[1].rows.count() == 3
    index.flush(part(second))
    index.compact()
    assert list(index.levels) == [2]
    assert {(bytes(r.digest), r.key, r.copies) for r in index.rows().collect()} == {(digest(1), best(9, 4, 6, 2), 4), (digest(2), 7, 2), (digest(3), None, 2), (digest(5), 8, 1)}
    asked = []
    passing = exact_dedup.Filter.passing
    monkeypatch.setattr(exact_dedup.Filter, "passing", lambda self, rows: asked.append(rows.columns) or passing(self, rows))
    texts = odd_texts()[:30]
    found = exact_dedup.groups(documents(spark, texts), keep, flush_rows=4)
    assert len([c for c in asked if c == ["digest"]]) >= 7  # every flush but the first
    assert {r.keep_key for r in found.collect() if r.group_size > 1} == {x[1] for x in plain_exact(texts, range(len(texts))) if x[2] > 1} or keep == "smallest"


def test_calls_leave_no_tables_and_folders_of_others(spark):
    """Two calls at once: one that ends, or fails, deletes its own folders only."""
    import threading
    from pathlib import Path

    from spindrift.llm.common import scratch, shared_dir, written

    base, ended = spark.sparkContext.getConf().get("spark.checkpoint.dir"), threading.Event()
    kept: dict[str, object] = {}

    def longer():
        with scratch(spark):
            kept["table"] = written(spark.range(5), shared_dir(spark))
            ended.wait(60)
            kept["n"] = kept["table"].count()

    worker = threading.Thread(target=longer)
    worker.start()
    while "table" not in kept:
        worker.join(0.05)
    before = {p.name for p in Path(base).glob("spindrift-*")}
    with pytest.raises(ZeroDivisionError), scratch(spark):
        written(spark.range(3), shared_dir(spark))
        raise ZeroDivisionError
    assert {p.name for p in Path(base).glob("spindrift-*")} == before
    ended.set()
    worker.join()
    assert kept["n"] == 5 and len({p.name for p in Path(base).glob("spindrift-*")}) == len(before) - 1
    exact_dedup.deduplicated(documents(spark, ["a", "a"])).collect()
    assert not spark.catalog.listTables()


def plain_trim(texts, ids, window):
    owner, cut = {}, [WORDS.findall(t or "") for t in texts]
    order = lambda i: (i is None, i or 0)
    for i, w in zip(ids, cut, strict=True):
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            owner[key] = min(owner.get(key, i), i, key=order)
    out = []
    for i, w in zip(ids, cut, strict=True):
        gone = set()
        for k in range(len(w) - window + 1):
            if order(owner[tuple(w[k : k + window])]) < order(i):
                gone.update(range(k, k + window))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out, key=str)


def trims(rows):
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.text) for r in rows), key=str)


@pytest.mark.parametrize(("group_suffixes", "slice_bytes", "print_bits"), [(4_000_000, 8 << 20, None), (2_000, 20_000, None), (500, 100_000, 3), (1, 1, 1)])
def test_substring_query(spark, group_suffixes, slice_bytes, print_bits):
    """Small groups have long prefixes; with few bits all fingerprints collide and words alone decide."""
    texts = [t for t in odd_texts() if print_bits is None or t is None or len(t) < 50_000]
    rows = substring_dedup.trimmed(documents(spark, texts), group_suffixes=group_suffixes, slice_bytes=slice_bytes, print_bits=print_bits).collect()
    assert trims(rows) == plain_trim(texts, range(len(texts)), 13)
    for r in rows:
        words = WORDS.findall(texts[r.doc_id] or "")
        gone = {k for s in r.spans for k in range(s.first, s.first + s.n)}
        assert len(gone) == r.n_removed and " ".join(w for k, w in enumerate(words) if k not in gone) == r.text


def test_substring_ties_and_nulls(spark):
    passage = " ".join(f"w{i}" for i in range(30))
    texts, ids = [passage, passage, f"x {passage}", f"{passage} y", None, passage], [5, 5, 9, None, None, 7]
    rows = substring_dedup.trimmed(documents(spark, texts, ids)).collect()
    assert trims(rows) == plain_trim(texts, ids, 13)
    assert substring_dedup.trimmed(documents(spark, ["a"]).limit(0)).count() == 0


def test_prefixes_part_a_hot_word(spark):
    """Suffixes that begin with one word are parted by prefixes of more words."""
    texts = [" ".join(["the", "same", *(f"v{i}x{k}" for k in range(40))]) for i in range(200)]
    rows = documents(spark, texts).selectExpr("doc_id as key", "text")
    sliced = substring_dedup.sliced(rows, 13, 10_000, 1)
    found = substring_dedup.splitters(sliced, sliced.agg(F.sum("suffixes")).first()[0], 20)
    assert found == sorted(set(found)) and len(found) > 100
    assert any(p.startswith(b"the same ") for p in found) and any(b" " not in p for p in found)
    lines = sorted(b" ".join(t.encode().split()[k : k + 13]) for t in texts for k in range(30))
    sizes = np.bincount([bisect_right(found, line) for line in lines])
    assert sizes.max() <= 60
