import re
from collections import defaultdict

import corpus_pipeline
import pytest

from spindrift.llm import bin_packing, bpe, secret_scan

from .helpers import ascii_lower, documents, odd_texts
from .test_dedup import plain_components, plain_fingerprint
from .test_scans import SECRETS, plain_counts
from .test_tokens import check_packing
from .test_wide_simhash import plain_wide_fingerprint

tokenizers = pytest.importorskip("tokenizers")


def plain_stages(texts):
    """Ids and texts after each stage; hosts are all good here."""
    rows = dict(enumerate(texts))

    def good(t):
        n, _, _, _, repeats = plain_counts(t)
        return n >= 50 and 100 * repeats <= 50 * n

    rows = {i: t for i, t in rows.items() if good(t)}
    yield dict(rows)
    groups = defaultdict(list)
    for i, t in rows.items():
        groups[ascii_lower(t)].append(i)
    rows = {i: rows[i] for i in map(max, groups.values())}
    yield dict(rows)
    prints = {i: plain_fingerprint(t) for i, t in rows.items()}
    wide = {i: plain_wide_fingerprint(t) for i, t in rows.items()}
    parts = plain_components(sorted(prints), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 3 or (wide[a] ^ wide[b]).bit_count() <= 46)
    rows = {i: t for i, t in rows.items() if parts[i] == i}
    yield dict(rows)


def test_stages_against_plain_versions(spark):
    base = [t for t in odd_texts(3) if t is None or len(t) < 60_000]
    long = next(t for t in base if t and len(t.split()) == 300)
    texts = [*base, *(f"{long} {s}" for s in SECRETS if s and len(s) < 1000), None]
    docs = documents(spark, texts)
    plain = plain_stages(texts)
    for (name, stage), expected in zip(corpus_pipeline.STAGES[:3], plain, strict=False):
        docs_out = stage(spark, docs, "")
        assert docs_out.columns == docs.columns, name
        assert {r.doc_id: r.text for r in docs_out.collect()} == expected, name
        docs = docs_out
    clean = corpus_pipeline.secrets(spark, docs, "")
    assert clean.columns == docs.columns
    texts_now = {r.doc_id: r.text for r in clean.collect()}
    assert set(texts_now) == set(expected) and all(r.n_chars == len(r.text) for r in clean.collect())
    assert not any(secret_scan.pattern_spans(t) for t in texts_now.values())
    assert all(re.sub(r"\[secret\]", "", t) == t or t != expected[i] for i, t in texts_now.items())
    order = sorted(texts_now)
    packed = corpus_pipeline.packing(spark, clean, "").collect()
    check = [r for r in packed]
    renamed = [type("R", (), {**r.asDict(), "doc_id": order.index(r.doc_id)}) for r in check]
    check_packing(renamed, [texts_now[i] for i in order], tokenizers.Tokenizer.from_file(bpe.vocabulary_path("word_bpe_49k.json")), 2048)


def test_run(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and out.count() > 0
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "exact", "near", "secrets", "packing"] and bin_packing.pack


def test_empty(spark):
    docs = documents(spark, ["a"]).limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
        assert docs.count() == 0, name
