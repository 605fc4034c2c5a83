import json
import random

import pytest
from pyspark.sql import functions as F

from spindrift.operators import ordering, similarity
from spindrift.sources import readers

PRINT = "{0} long, fingerprint array<int>, duration_ms long"


def plain_score(a, b):
    n = min(len(a[0] or []), len(b[0] or []), 120)
    if not n:
        return 0.0
    near = sum(x is not None and y is not None and abs(x - y) < 10 for x, y in zip(a[0][:n], b[0][:n], strict=True)) / n
    return near * (0.7 + 0.3 * min(a[1], b[1]) / max(a[1], b[1]) if a[1] and b[1] else 1.0)


@pytest.mark.parametrize("least", [0.2, 0.5, 0.03])
def test_search_equals_a_full_scan(spark, least):
    """Prints of all lengths, with a value that a third of the catalog has at every position, and lengths that are not known."""
    rng = random.Random(int(100 * least))
    tracks = {}
    for k in range(150):
        values = [rng.randrange(-400, 400) for _ in range(rng.choice([0, 1, 3, 7, 30, 90, 125]))]
        if k % 3 == 0:
            values = [0 if rng.random() < 0.6 else x for x in values]
        tracks[k] = (values, rng.choice([0, None, 1000, 2500]))
    asked = {}
    for k in range(40):
        base = tracks[rng.randrange(150)][0]
        asked[k] = ([x + rng.randrange(-9, 10) if rng.random() < 0.5 else rng.randrange(-400, 400) for x in base], rng.choice([0, None, 1500]))
    asked[40], asked[41] = ([10**6] * 50, 1000), ([], 1000)
    frame = lambda d, name: spark.createDataFrame([(k, *v) for k, v in d.items()], PRINT.format(name))
    found = similarity.catalog_search(frame(asked, "query_id"), frame(tracks, "track_id"), least)
    expected = {}
    for q, a in asked.items():
        score, t = max((plain_score(a, b), -t) for t, b in tracks.items())
        if score >= least and score > 0:
            expected[q] = (-t, pytest.approx(score))
    assert {r.query_id: (r.track_id, r.score) for r in found.collect()} == expected
    assert "Cartesian" not in found._jdf.queryExecution().executedPlan().toString() and "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString()


def test_equal_prints_of_unknown_length_are_wholly_alike(spark):
    queries = spark.createDataFrame([(1, [5] * 20, 0), (2, [5] * 20, 2000)], PRINT.format("query_id"))
    tracks = spark.createDataFrame([(7, [5] * 20, 1000)], PRINT.format("track_id"))
    listed = similarity.shortlist(queries, similarity.fingerprint_index(tracks))
    assert {r.query_id: r.score for r in similarity.catalog_matches(queries, tracks, listed).collect()} == {1: 1.0, 2: pytest.approx(0.85)}


def test_places_need_no_single_task(spark):
    rng = random.Random(3)
    rows = [(k, rng.choice(["a", "b", None]), rng.randrange(1000)) for k in range(500)]
    frame = spark.createDataFrame(rows, "id int, g string, v int").repartition(5)
    found = ordering.placed(frame, [F.desc_nulls_last("g"), "v", "id"])
    order = sorted(rows, key=lambda r: (r[1] is None, -ord(r[1] or "a"), r[2], r[0]))
    assert {r.id: r.place for r in found.collect()} == {r[0]: k for k, r in enumerate(order, 1)}
    assert ordering.placed(frame.limit(0), ["id"]).count() == 0


def test_playlists_are_opened_in_one_scan(spark):
    deep = '{"title":"leaf"}'
    for k in range(300):
        deep = '{"entries":[null,' + deep + f',{{"title":"s{k}"}}]}}'
    rows = spark.createDataFrame([(1, deep), (2, None), (3, "no json"), (4, '{"entries":[]}'), (5, '{"entries":["x",{"a":1.50}]}')], "id int, body string")
    found = readers.flattened(rows)
    got = [(r.id, r.entry, len(r.path)) for r in found.collect()]
    assert [x for x in got if x[0] > 1] == [(3, "no json", 0), (4, '{"entries":[]}', 0), (5, "x", 1), (5, '{"a":1.5}', 1)]
    assert [(json.loads(e)["title"], n) for i, e, n in got if i == 1] == [("leaf", 300), *((f"s{k}", 300 - k) for k in range(300))]
    assert found._jdf.queryExecution().executedPlan().toString().count("Scan") == 1


def test_all_with_all_goes_by_blocks(spark, monkeypatch):
    """Small blocks, null values, numbers far apart, ids that repeat and more tracks as near than are kept; pairs are not dealt out."""
    monkeypatch.setattr(similarity, "QUERY_BLOCK", 7)
    monkeypatch.setattr(similarity, "TRACK_BLOCK", 9)
    rng = random.Random(4)
    values = lambda wide: [None if rng.random() < 0.1 else rng.randrange(-wide, wide) for _ in range(rng.choice([0, 2, 10, 130]))]
    tracks = [(k % 45, values(rng.choice([40, 40, 10**9])), rng.choice([0, 10, 30])) for k in range(50)] + [(45, None, 1)]
    asked = [(100 + k, values(rng.choice([40, 10**9])), 10) for k in range(19)] + [(119, tracks[1][1], 10), (120, None, 5)]
    q, t = spark.createDataFrame(asked, PRINT.format("query_id")), spark.createDataFrame(tracks, PRINT.format("track_id"))
    shared = {}
    for a, x, _ in asked:
        for b, y, _ in tracks:
            n = sum(v is not None and w is not None and abs(v - w) <= 10 for v, w in zip((x or [])[:120], (y or [])[:120], strict=False))
            shared[a, b] = shared.get((a, b), 0) + n
    best = {a: sorted((-n, b) for (c, b), n in shared.items() if c == a and n)[:5] for a, _, _ in asked}
    expected = {(a, b): -n for a, found in best.items() for n, b in found}
    for index in (t, t.where("track_id = 45 or track_id between 5 and 44")):
        if index is not t:
            expected = {}
            for a in best:
                for n, b in sorted((-n, b) for (c, b), n in shared.items() if c == a and n and 5 <= b < 45)[:5]:
                    expected[a, b] = -n
            index = similarity.fingerprint_index(index)
        found = similarity.shortlist(q, index, limit=5)
        assert {(r.query_id, r.track_id): r.shared for r in found.collect()} == expected
        assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in similarity.catalog_search(q, t)._jdf.queryExecution().executedPlan().toString()


def test_equal_scores_of_unequal_sums(spark):
    """0.5 * (0.7 + 0.3 * 10 / 30) and 0.4 as doubles differ in the last place; of equal scores the smallest id counts."""
    queries = spark.createDataFrame([(1, [0] * 10, 10)], PRINT.format("query_id"))
    rows = [(5, [0] * 4 + [99] * 6, 0), (6, [0] * 5 + [99] * 5, 30)]
    for order in (rows, [(6, *rows[0][1:]), (5, *rows[1][1:])]):
        tracks = spark.createDataFrame(order, PRINT.format("track_id"))
        assert [r.track_id for r in similarity.catalog_search(queries, tracks).collect()] == [5]
        assert [r.track_id for r in similarity.catalog_matches(queries, tracks, similarity.shortlist(queries, tracks)).collect()] == [5]


def test_nearest_frame_takes_each_frame_in_once(spark):
    """A window that shrinks from row to row was gone through again for each; of frames that start together the earlier counts."""
    frames = spark.createDataFrame([(1, 0, 0), (1, 1, 10), (1, 2, 10), (1, 3, 30), (2, 0, 5)], "item int, idx int, start_ms long")
    marks = spark.createDataFrame([(1, 0), (1, 4), (1, 5), (1, 6), (1, 10), (1, 20), (1, 21), (1, 99), (2, 0), (2, 9), (3, 1)], "item int, mark_ms long")
    found = similarity.nearest_frame(marks, frames)
    assert {(r.item, r.mark_ms): (r.idx, r.distance_ms) for r in found.collect()} == {(1, 0): (0, 0), (1, 4): (0, 4), (1, 5): (0, 5), (1, 6): (1, 4), (1, 10): (1, 0), (1, 20): (1, 10), (1, 21): (3, 9), (1, 99): (3, 69), (2, 0): (0, 5), (2, 9): (0, 4), (3, 1): (None, None)}
    assert "unboundedfollowing" not in found._jdf.queryExecution().executedPlan().toString()
