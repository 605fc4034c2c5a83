from pyspark.sql import functions as F

from spindrift.functions import urls as U
from spindrift.operators import assembly, providers
from spindrift.sources import inputs


def test_inputs_become_items(spark):
    values = ["/m/a.wav", " /m/a.wav\n", "/m", "/none", None, "", "http://127.0.0.1/x.mp3", "https://h.example.com/b.mp3?utm_source=x", "https://list.example.com/1", "https://nobody.example.com/1", "https://one.example.com/1"]
    given = spark.createDataFrame([("j", k, v) for k, v in enumerate(values)], "job_id string, place int, value string")
    files = spark.createDataFrame([("/m/a.wav",), ("/m/sub/b.wav",)], "path string")
    answers = spark.createDataFrame([("https://list.example.com/1", '{"entries":[{"title":"x","duration":2},null,{"title":"y"}]}'), ("https://one.example.com/1", '{"title":"z","url":"https://a.example/z"}')], "url string, body string")
    rows = inputs.resolved(given, files, answers).collect()
    found = {(r.place, r.entry_index): (r.kind, r.status, r.title, r.error) for r in rows}
    assert len(rows) == len(found) == len({r.id for r in rows}) == 12
    assert found[0, None] == found[1, None] == ("local_file", "queued", "a.wav", None)
    assert found[2, None][3] == "Input path is not a file: /m" and found[3, None][3] == "Input file does not exist: /none"
    assert found[4, None][1] == found[5, None][1] == "failed"
    assert found[6, None][:2] == ("direct_http", "failed") and found[7, None] == ("direct_http", "queued", "b.mp3", None)
    assert found[8, 1] == ("yt_dlp", "queued", "x", None) and found[8, 3][2] == "y" and found[9, None][1] == "failed"
    assert [f for k, f in found.items() if k[0] == 10] == [("yt_dlp", "queued", "z", None)]
    again = {r.id for r in inputs.resolved(given, files, answers).collect()}
    assert again == {r.id for r in rows}
    assert inputs.resolved(given.limit(0), files, answers).count() == 0


def test_addresses_are_taken_apart_once(spark):
    rows = spark.createDataFrame([("https://youtu.be/a?t=1", "10.0.0.1"), ("https://vimeo.com/1/?s=2", "9.255.255.255")], "url string, host string")
    found = rows.select(U.canonical(F.col("url")).alias("url"), U.unsafe_address(F.col("host")).alias("unsafe"))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract(") < 20 and plan.count("aggregate(") == 1
    assert [tuple(r) for r in found.collect()] == [("https://youtu.be/a", True), ("https://vimeo.com/1", False)]


def test_settings_and_segments_by_item(spark):
    rows = spark.createDataFrame([("a", 1, '{"k":"v"}'), ("b", 0, "{broken"), ("c", None, None)], "name string, enabled int, config_json string")
    assert {r.name: (r.enabled, r.config) for r in providers.saved_settings(rows).collect()} == {"a": (True, {"k": "v"}), "b": (False, {}), "c": (False, {})}
    segments = spark.createDataFrame([("i", 5, 9), ("i", 1, 2), ("j", 0, 1)], "item string, start_ms int, end_ms int")
    assert [(r.item, r.place, r.start_ms) for r in assembly.by_item(segments).orderBy("item", F.col("place")).collect()] == [("i", 1, 1), ("i", 2, 5), ("j", 1, 0)]
