import json

import pytest
from pyspark.sql import functions as F

from spindrift.functions import text as T
from spindrift.functions import urls as U
from spindrift.operators import export, library
from spindrift.plans.text_queries import SITES
from spindrift.sources import readers
from spindrift.streaming import events as S


def one(spark, value, kind, f):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first().y


def test_stamps(spark):
    assert one(spark, "Intro 00:00\nBattle Theme 03:41\nnothing\nEnding 1:02:03 2:00", "string", T.line_stamps) == [0, 221_000, 3_723_000]
    assert one(spark, 3_723_999, "long", T.stamp) == "01:02:03" and one(spark, 61_000, "long", T.stamp) == "01:01"
    assert one(spark, None, "string", T.line_stamps) == []


def test_site_rules(spark):
    rows = spark.createDataFrame([(a, b) for a, b in SITES], "a string, b string").withColumn("c", U.canonical(F.col("a")))
    assert [(r.a, r.c) for r in rows.where("b != c").collect()] == []


def test_shim_and_download(spark):
    assert one(spark, "https://l.instagram.com/?u=https%3A%2F%2Fa.example%2Fb&e=1", "string", U.unwrapped) == "https://a.example/b"


def test_answers(spark):
    audd = {"status": "success", "result": {"artist": "A", "title": "T", "song_link": "l", "spotify": {"external_ids": {"isrc": "I"}}}}
    acr = {"metadata": {"score": 97, "music": [{"title": "T", "acrid": "x", "artists": [{"name": "A"}, {"name": ""}, {"name": "B"}]}]}}
    vibra = {"track": {"title": "T", "subtitle": "S", "key": "9", "sections": [{"metadata": [{"text": ""}, {"text": "Album"}]}]}}
    df = lambda *b: spark.createDataFrame([(i, json.dumps(x)) for i, x in enumerate(b)], "id int, body string")
    a = readers.audd(df(audd, {"result": {"artist": "A"}}, {"result": None}, {})).collect()
    assert [(r.title, r.isrc, r.confidence, r.provider_ids) for r in a] == [("T", "I", 0.83, {"audd": "l"})]
    c = readers.acrcloud(df(acr, {"metadata": {"music": [{"acrid": "x"}]}}, {"metadata": {"music": []}})).collect()
    assert [(r.artist, r.confidence) for r in c] == [("A, B", 0.95)]
    v = readers.vibra(df(vibra, {"track": None})).collect()
    assert [(r.album, r.confidence, r.provider_ids) for r in v] == [("Album", 0.72, {"shazam": "9"})]


def test_nested_playlists(spark):
    body = {"entries": [{"entries": [{"title": "a"}, {"title": "b"}]}, {"title": "c"}, None]}
    found = readers.flattened(spark.createDataFrame([(1, json.dumps(body))], "id int, body string")).orderBy("path").collect()
    assert [json.loads(r.entry)["title"] for r in found] == ["a", "b", "c"]


def test_files(spark, tmp_path):
    (tmp_path / "x").mkdir()
    for name in ("A - B - C.mp3", "x/plain.flac", "skip.txt"):
        (tmp_path / name).write_bytes(b"12")
    found = {(r.artist, r.title, r.size_bytes) for r in readers.catalog_files(spark, str(tmp_path)).collect()}
    assert found == {("A", "B - C", 2), (None, "plain", 2)}
    (tmp_path / "m.json").write_text(json.dumps({"cases": [{"id": "1", "input_value": "v", "expected_tracks": ["t"]}]}))
    assert readers.manifest(spark, str(tmp_path / "m.json")).first().expected_tracks == ["t"]
    (tmp_path / "f.jsonl").write_text('{"timestamp": 1.5, "duration": 2, "fingerprint": [1, 2]}\nbroken\n{"timestamp": 3, "duration": 2, "fingerprint": []}\n')
    assert [(r.timestamp_ms, r.fingerprint) for r in readers.fingerprint_lines(spark, str(tmp_path / "f.jsonl")).collect()] == [(1500, [1, 2])]


def test_exports(spark):
    rows = spark.createDataFrame([("i", 1, 0, 12_000, "matched_track", 0.5, None, "Song", "Artist", None, ["a", "b"], None, ["h"], [])], "item string, seq long, start_ms long, end_ms long, kind string, confidence double, uncertainty double, title string, artist string, album string, providers array<string>, repeat_group_id string, metadata_hints array<string>, explanation array<string>")
    csv = export.export(rows.withColumn("source_item_id", F.col("item")), "CSV")
    assert csv.columns[:3] == ["source_item_id", "start_ms", "end_ms"] and csv.first().providers == "a, b" and csv.first().confidence == "0.5000" and csv.first().uncertainty == ""
    assert export.export(rows, "chapters").first().chapters == "00:00 Artist - Song"
    with pytest.raises(ValueError):
        export.export(rows, "xml")


def test_recovery(spark):
    rows = spark.sql("select * from values ('a', 'running', timestamp'2024-01-01 00:00:00'), ('b', 'queued', timestamp'2024-01-01 00:01:00'), ('c', 'running', timestamp'2024-01-01 00:01:30'), ('d', 'succeeded', timestamp'2023-01-01') as t(id, status, updated_at)")
    now = F.lit("2024-01-01 00:02:00").cast("timestamp")
    out = {r.id: r.status for r in library.recovered(rows, now, "lost", 60).collect()}
    assert out == {"a": "failed", "b": "failed", "c": "running", "d": "succeeded"}
    assert {r.id for r in library.recovered(rows, now, "lost", 60, dry_run=True).where("recovered and status != 'failed'").collect()} == {"a", "b"}
    with pytest.raises(ValueError):
        library.stale(rows, now, -1)


def test_streams(spark, tmp_path):
    schema = "id long, key string, ts timestamp, event_type string, value double"
    rows = lambda a, b: spark.createDataFrame([(i, f"k{i % 3}", None, "t", 1.0) for i in range(a, b)], schema)
    log = str(tmp_path / "log")
    rows(0, 5).coalesce(1).write.parquet(log)
    read = lambda: S.read_log(spark, log, schema)
    S.latest_into(read(), str(tmp_path / "out"), ["key"], ["id"], str(tmp_path / "cp"))
    S.appended(read(), str(tmp_path / "copy"), str(tmp_path / "cp2"))
    rows(5, 9).coalesce(1).write.mode("append").parquet(log)
    S.latest_into(read(), str(tmp_path / "out"), ["key"], ["id"], str(tmp_path / "cp"))
    S.appended(read(), str(tmp_path / "copy"), str(tmp_path / "cp2"))
    assert {r.key: r.id for r in spark.read.parquet(str(tmp_path / "out/v1")).collect()} == {"k0": 6, "k1": 7, "k2": 8}
    assert spark.read.parquet(str(tmp_path / "copy")).count() == 9
