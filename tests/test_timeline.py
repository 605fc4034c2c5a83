import random

from pyspark.sql import functions as F

from spindrift.operators import scoring, timeline

SEGMENT = "item long, seq long, start_ms long, end_ms long, kind string, key string, confidence double, providers array<string>, evidence_count long"


def segments(spark, rows):
    full = [(1, i, a * 1000, b * 1000, "matched_track" if k else kind, k, 0.9, ["audd"], 1) for i, (a, b, k, kind) in enumerate(rows)]
    return spark.createDataFrame(full, SEGMENT)


def spans(df):
    return [(r.start_ms // 1000, r.end_ms // 1000, r.key) for r in df.orderBy("start_ms").collect()]


def test_overlapping_hits_fuse(spark):
    hits = spark.createDataFrame([(1, "k", 0, 0, 12_000, 0.7, "vibra", 1), (1, "k", 1, 8_000, 20_000, 0.9, "audd", 1)], "item long, key string, seq long, start_ms long, end_ms long, confidence double, provider string, n_evidence int")
    (r,) = timeline.fused(hits).collect()
    assert (r.start_ms, r.end_ms, r.providers, r.primary_seq) == (0, 20_000, ["audd", "vibra"], 1)
    assert abs(r.confidence - 0.85) < 1e-9


def test_island_ends_by_the_hit_before_not_the_furthest(spark):
    hits = spark.createDataFrame([(1, "k", 0, 0, 50_000, 0.7, "a", 1), (1, "k", 1, 1_000, 2_000, 0.7, "a", 1), (1, "k", 2, 10_000, 11_000, 0.7, "a", 1)], "item long, key string, seq long, start_ms long, end_ms long, confidence double, provider string, n_evidence int")
    assert timeline.fused(hits).count() == 2


def test_stitch_merges_and_clamps(spark):
    assert spans(timeline.stitched(segments(spark, [(5, 53, "A", ""), (46, 74, "A", ""), (67, 98, "B", "")]))) == [(5, 67, "A"), (67, 98, "B")]


def test_short_speech_is_bridged(spark):
    assert spans(timeline.stitched(segments(spark, [(0, 30, "A", ""), (30, 33, None, "speech_only"), (33, 60, "A", "")]))) == [(0, 60, "A")]


def test_long_speech_is_not(spark):
    assert len(spans(timeline.stitched(segments(spark, [(0, 30, "A", ""), (30, 50, None, "speech_only"), (50, 80, "A", "")])))) == 3


def test_other_tracks_stay_apart(spark):
    assert len(spans(timeline.stitched(segments(spark, [(0, 30, "A", ""), (30, 60, "B", "")])))) == 2


def test_bridge_is_not_bridged_again(spark):
    rows = [(0, 30, "A", ""), (30, 32, None, "speech_only"), (32, 60, "A", ""), (60, 62, None, "speech_only"), (62, 90, "A", "")]
    assert spans(timeline.stitched(segments(spark, rows))) == [(0, 60, "A"), (60, 62, None), (62, 90, "A")]


def test_items_do_not_touch(spark):
    rows = [(i, s, s * 20_000, s * 20_000 + 20_000, "matched_track", "A", 0.5, ["x"], 1) for i in range(30) for s in range(5)]
    random.Random(1).shuffle(rows)
    out = timeline.stitched(spark.createDataFrame(rows, SEGMENT)).collect()
    assert sorted((r.item, r.start_ms, r.end_ms, r.parts) for r in out) == [(i, 0, 100_000, 5) for i in range(30)]


def test_correction(spark):
    rows = spark.createDataFrame([(1, 0, 12_000, "music_unresolved", "old", 0.2, 0.8, ["b"])], "item long, start_ms long, end_ms long, kind string, key string, confidence double, uncertainty double, alternates array<string>")
    (r,) = timeline.corrected(rows, spark.createDataFrame([(1, 0, 12_000, "Manual Song")], "item long, start_ms long, end_ms long, new_key string")).collect()
    assert (r.kind, r.key, r.confidence, r.uncertainty, r.alternates) == ("matched_track", "Manual Song", 0.99, 0.0, ["old", "b"])


def test_gates(spark):
    cases = [((1, 1, 0.85, 0.30, False), "G3"), ((1, 1, 0.60, 0.20, True), "G5"), ((2, 2, 0.1, 0, False), "G1"), ((1, 2, 0.1, 0, False), "G2"), ((1, 1, 0.61, 0.35, False), "G4"), ((1, 1, 0.61, 0.2, False), None)]
    rows = spark.createDataFrame([(*map(float, c[:4]), c[4], i) for i, (c, _) in enumerate(cases)], "p double, h double, b double, m double, i boolean, n int")
    found = rows.select("n", scoring.gate(*map(F.col, "phbmi")).alias("g")).orderBy("n").collect()
    assert [r.g for r in found] == [g for _, g in cases]
