import numpy as np
from pyspark.sql import functions as F

from spindrift.operators import segmentation

FRAME = "item long, segment long, start_ms long, end_ms long, kind string, vector array<double>, chroma array<double>"


def groups(spark, rows, **kw):
    df = spark.createDataFrame([(1, i, s, s + 30_000, "music_unresolved", list(map(float, v)), list(map(float, v))) for i, (s, v) in enumerate(rows)], FRAME)
    return [r.repeat_group for r in segmentation.repeat_groups(df, **kw).orderBy("segment").collect()]


def test_alike_but_far_apart(spark):
    assert groups(spark, [(0, [1.0, 1, 1, 1]), (1_800_000, [1.0, 1, 0.7, 0.3])]) == [0, 1]


def test_equal_and_far_apart(spark):
    assert groups(spark, [(0, [1.0, 1, 1, 1]), (1_800_000, [1.0, 1, 1, 1])]) == [0, 0]


def test_against_a_plain_loop(spark):
    rng = np.random.default_rng(5)
    rows = [(int(k * 40_000), list(map(float, rng.normal(size=4)))) for k in range(60)]
    cos = lambda a, b: float(np.dot(a, b) / (np.linalg.norm(a) * np.linalg.norm(b)))
    known, expected = [], []
    for i, (s, v) in enumerate(rows):
        for g in known:
            if cos(v, g[1]) >= 0.5 and min(abs(s - m) for m in g[2]) <= 120_000 or cos(v, g[1]) >= 0.9:
                g[2].append(s)
                expected.append(g[0])
                break
        else:
            known.append((i, v, [s]))
            expected.append(i)
    assert groups(spark, rows, feature=0.5, chroma=0.5, certain=0.9) == expected


def test_labels(spark):
    cases = [((0.50, 0.40, 0.20, 0.35, 0.25), "matched_track"), ((0.20, 0.80, 0.20, 0.30, 0.10), "speech_only"), ((0.9, 0, 0, 0.05, 0.9), "silence_or_fx"), ((0.4, 0.1, 0.1, 0.5, 0.1), "music_unresolved")]
    rows = spark.createDataFrame([(i, *map(float, c)) for i, (c, _) in enumerate(cases)], "i int, m double, s double, n double, r double, c double")
    assert [r.label for r in rows.select("i", segmentation.frame_label(*map(F.col, "msnrc")).alias("label")).orderBy("i").collect()] == [x for _, x in cases]


def test_short_segments_merge(spark):
    rows = [(1, 0, 0, 5_000, "music_unresolved", 0.4, 0.0), (1, 1, 5_000, 30_000, "music_unresolved", 0.8, 0.2), (1, 2, 30_000, 31_000, "speech_only", 0.0, 1.0), (1, 3, 31_000, 32_000, "music_unresolved", 1.0, 0.0)]
    found = segmentation.merge_short(spark.createDataFrame(rows, "item long, segment long, start_ms long, end_ms long, kind string, music_ratio double, speech_ratio double"), 8_000).orderBy("start_ms").collect()
    assert [(r.start_ms, r.end_ms) for r in found] == [(0, 30_000), (30_000, 31_000), (31_000, 32_000)]
    assert abs(found[0].music_ratio - (0.4 * 5 + 0.8 * 25) / 30) < 1e-9


def test_smoothing_equals_padded_convolution(spark):
    x = np.random.default_rng(2).normal(size=23)
    for context in (1, 2, 3, 6, 8):
        rows = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate(x)], "item int, idx int, x double")
        got = [r.smooth for r in segmentation.smoothed(rows, "x", context).orderBy("idx").collect()]
        padded = np.pad(x, (context // 2, context // 2), mode="edge") if context > 1 else x
        expected = np.convolve(padded, np.ones(context) / context, mode="valid")[: len(x)]
        assert np.allclose(got, expected)
