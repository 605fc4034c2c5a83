"""Ordered folds against plain loops over random rows."""

import random

import numpy as np
import pytest

from spindrift.functions import urls
from spindrift.operators import segmentation, store, timeline

KINDS = ("matched_track", "music_unresolved", "speech_only", "silence_or_fx")


def plain_gap(length, steps):
    return steps[0] if length < 10_000 else steps[1] if length < 60_000 else steps[2] if length < 600_000 else steps[3]


def plain_join(a, b):
    once = lambda c: a[c] + [x for x in b[c] if x not in a[c]]
    return {**a, "end": max(a["end"], b["end"]), "providers": sorted(set(a["providers"] + b["providers"])), "n": a["n"] + b["n"], "alternates": once("alternates"), "explanation": once("explanation"), "uncertainty": min(a["uncertainty"] or 1.0, b["uncertainty"] or 1.0)}


def plain_stitch(rows):
    rows = sorted(rows, key=lambda r: (r["start"], r["end"], r["kind"], r["seq"]))
    merge, bridge = (2_000, 5_000, 12_000, 30_000), (2_000, 5_000, 8_000, 19_000)
    same = lambda a, b: a["kind"] == b["kind"] == "matched_track" and a["key"] == b["key"]
    size = lambda r: r["end"] - r["start"]
    out, k = [], 0
    while k < len(rows):
        if k + 2 < len(rows):
            a, mid, b = rows[k : k + 3]
            limit = plain_gap(max(size(a), size(b)), bridge)
            before, after = max(0, mid["start"] - a["end"]), max(0, b["start"] - mid["end"])
            if same(a, b) and mid["kind"] != "matched_track" and before <= limit and after <= limit and size(mid) <= limit:
                both = plain_join(a, b)
                note = f"Bridged across a {mid['kind'].replace('_', ' ')} gap of {before + after} ms."
                out.append({**both, "explanation": both["explanation"] + [note] * (note not in both["explanation"])})
                k += 3
                continue
        out.append(rows[k])
        k += 1
    merged = []
    for r in out:
        if merged:
            last, gap = merged[-1], max(0, r["start"] - merged[-1]["end"])
            longer = max(size(last), size(r))
            if (same(last, r) and gap <= plain_gap(longer, merge)) or (not same(last, r) and r["kind"] == last["kind"] != "matched_track" and gap <= plain_gap(longer, bridge)):
                merged[-1] = plain_join(last, r)
                continue
        merged.append(r)
    cut = [{**r, "end": max(r["start"], n["start"]) if n and r["end"] > n["start"] else r["end"]} for r, n in zip(merged, [*merged[1:], None], strict=True)]
    return [r for r in cut if r["end"] > r["start"]]


def test_stitching_against_a_loop(spark):
    rng = random.Random(31)
    items = {}
    for item in range(60):
        at, rows = 0, []
        for seq in range(rng.randrange(1, 25)):
            at += rng.choice([0, 1_000, 4_000, 9_000, 25_000])
            length = rng.choice([1_000, 3_000, 12_000, 70_000, 700_000])
            kind = rng.choice(KINDS[:3])
            rows.append({"seq": seq, "start": at, "end": at + length, "kind": kind, "key": rng.choice("AB") if kind == "matched_track" else None, "providers": rng.sample(["x", "y", "z"], rng.randrange(3)), "n": seq, "alternates": rng.sample("CDEF", 2), "explanation": [rng.choice("pq")], "uncertainty": rng.choice([None, 0.0, 0.25, 0.5])})
            at += length - rng.choice([0, 0, 2_000]) if length > 2_000 else length
        items[item] = rows
    flat = [(i, r["seq"], r["start"], r["end"], r["kind"], r["key"], 0.5, r["providers"], r["n"], r["alternates"], r["explanation"], r["uncertainty"]) for i, rows in items.items() for r in rows]
    rng.shuffle(flat)
    df = spark.createDataFrame(flat, "item long, seq long, start_ms long, end_ms long, kind string, key string, confidence double, providers array<string>, evidence_count long, alternates array<string>, explanation array<string>, uncertainty double")
    got = [(r.item, r.start_ms, r.end_ms, r.kind, r.key, sorted(r.providers), r.evidence_count, r.alternates, r.explanation, r.uncertainty or 0.0) for r in timeline.stitched(df).collect()]
    expected = [(i, r["start"], r["end"], r["kind"], r["key"], sorted(r["providers"]), r["n"], r["alternates"], r["explanation"], r["uncertainty"] or 0.0) for i, rows in items.items() for r in plain_stitch(rows)]
    assert sorted(got, key=str) == sorted(expected, key=str) and len(got) < len(flat)


def drafts(rng, items=20):
    out = []
    for item in range(items):
        at = 0
        for segment in range(rng.randrange(1, 30)):
            length = rng.choice([2_000, 6_000, 15_000, 60_000])
            base = rng.choice([(1, 1, 1, 1), (1, 1, 0.7, 0.3), (-1, 1, 0, 2)])
            out.append((item, segment, at, at + length, rng.choice(KINDS[1:] + KINDS[:2]), rng.random(), rng.random(), [x + rng.random() / 20 for x in base], [abs(x) + rng.random() / 20 for x in base[:2]]))
            at += length + rng.choice([0, 200_000])
    return out


DRAFT = "item long, segment long, start_ms long, end_ms long, kind string, music_ratio double, speech_ratio double, vector array<double>, chroma array<double>"


def test_short_segments_against_a_loop(spark):
    rows = drafts(random.Random(5))
    expected = []
    for item in range(20):
        own = []
        for r in sorted((r for r in rows if r[0] == item), key=lambda r: (r[2], r[1])):
            r = list(r)
            if own and own[-1][4] not in KINDS[2:] and r[4] not in KINDS[2:] and min(own[-1][3] - own[-1][2], r[3] - r[2]) < 8_000:
                last = own[-1]
                a, b = last[3] - last[2], r[3] - r[2]
                mean = lambda x, y: (x * a + y * b) / (a + b)  # noqa: B023, E731
                own[-1] = [item, last[1], last[2], r[3], last[4] if last[4] == r[4] else "music_unresolved", mean(last[5], r[5]), mean(last[6], r[6]), [mean(x, y) for x, y in zip(last[7], r[7], strict=True)], [mean(x, y) for x, y in zip(last[8], r[8], strict=True)]]
            else:
                own.append(r)
        expected += own
    got = sorted(tuple(r) for r in segmentation.merge_short(spark.createDataFrame(rows, DRAFT), 8_000).collect())
    assert len(got) == len(expected) < len(rows)
    for g, e in zip(got, sorted(expected, key=lambda r: (r[0], r[1])), strict=True):
        assert g[:5] == tuple(e[:5]) and np.allclose([*g[5:7], *g[7], *g[8]], [*e[5:7], *e[7], *e[8]])


@pytest.mark.parametrize("limits", [(0.88, 0.82, 0.35, 0.96), (0.999, 0.999, 0.35, 0.9999)])
def test_repeat_groups_against_a_loop(spark, limits):
    rows = drafts(random.Random(6))
    feature, chroma, ratio, certain = limits
    cosine = lambda a, b: float(np.dot(a, b) / (np.linalg.norm(a) * np.linalg.norm(b)))
    expected = {}
    for item in range(20):
        own = sorted((r for r in rows if r[0] == item), key=lambda r: (r[2], r[1]))
        lengths = sorted(r[3] - r[2] for r in own if r[4] in KINDS[:2])
        groups = []
        for r in own:
            if r[4] not in KINDS[:2]:
                expected[item, r[1]] = None
                continue
            n, middle = max(1, r[3] - r[2]), r[2] + max(1, r[3] - r[2]) // 2
            for g in groups:
                alike = cosine(r[7], g["first"][7])
                m = g["first"][3] - g["first"][2]
                near = min(abs(middle - x) for x in g["middles"]) <= max(120_000, 4 * lengths[len(lengths) // 2])
                if alike >= feature and cosine(r[8], g["first"][8]) >= chroma and min(n, m) / max(n, m) >= ratio and (near or alike >= certain):
                    g["middles"].append(middle)
                    expected[item, r[1]] = g["first"][1]
                    break
            else:
                groups.append({"first": r, "middles": [middle]})
                expected[item, r[1]] = r[1]
    got = {(r.item, r.segment): r.repeat_group for r in segmentation.repeat_groups(spark.createDataFrame(rows, DRAFT), *limits).collect()}
    assert got == expected and len({v for v in got.values() if v is not None}) > 3


def test_store_errors(spark):
    jobs = spark.createDataFrame([(1, [" a "], True), (2, [" "], None), (3, [], False)], "id long, inputs array<string>, cancel_requested boolean")
    assert store.known(jobs, 1).count() == 1 and store.cancel_requested(jobs, 1) and not store.cancel_requested(jobs, 2) and not store.cancel_requested(jobs, 9)
    with pytest.raises(ValueError):
        store.known(jobs, 9)
    clean = jobs.select("id", store.cleaned_inputs(jobs["inputs"]).alias("inputs"))
    assert clean.where("id = 1").first().inputs == ["a"]
    for job in (2, 3):
        with pytest.raises(Exception, match="blank"):
            clean.where(f"id = {job}").collect()
    with pytest.raises(Exception, match="there is a job 1"):
        store.inserted(jobs, jobs.where("id = 1")).collect()


@pytest.mark.parametrize(("host", "unsafe"), [
    ("192.0.2.1", True), ("198.18.5.5", True), ("198.20.0.1", False), ("203.0.113.9", True), ("192.0.0.8", True), ("100.64.0.1", False), ("[::1]", True), ("::ffff:10.0.0.1", True), ("::ffff:8.8.8.8", False),
    ("2001:db8::1", True), ("2606:4700::1", False), ("1.2.3.999", False), ("240.0.0.1", True), ("a.b", False), (None, False),
])
def test_unsafe_addresses(spark, host, unsafe):
    row = spark.createDataFrame([(host,)], "h string")
    assert row.select(urls.unsafe_address(row["h"])).first()[0] is unsafe
