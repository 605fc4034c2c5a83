"""Corrections, delete plans, roll-ups and streamed payloads."""

import json

import pytest
from pyspark.sql import functions as F

from spindrift.operators import export, library, store, timeline
from spindrift.sources import pieces

SEGMENT = "item string, start_ms long, end_ms long, kind string, key string, confidence double, uncertainty double, alternates array<string>, metadata_hints array<string>, explanation array<string>"


def segments(spark):
    rows = [
        ("a", 0, 10, "music_unresolved", None, 0.4, 0.6, [], None, ["heard", timeline.CORRECTED]), ("a", 10, 20, "matched_track", "old", 0.995, 0.1, ["x", "new", "y", "z", "u", "v"], ["h", "manual:new"], None),
        ("b", 0, 10, "speech_only", None, 0.0, 1.0, [], ["h"], ["said"]),
    ]
    return spark.createDataFrame(rows, SEGMENT)


def test_corrections_leave_hints_and_an_explanation(spark):
    fixes = spark.createDataFrame([("a", 0, 10, " new "), ("a", 10, 20, "new")], "item string, start_ms long, end_ms long, new_key string")
    found = {(r.item, r.start_ms): r for r in timeline.corrected(segments(spark), fixes, strict=True).collect()}
    first, second, other = found["a", 0], found["a", 10], found["b", 0]
    assert (first.kind, first.key, first.confidence, first.uncertainty, first.alternates) == ("matched_track", "new", 0.99, 0.0, [])
    assert first.metadata_hints == ["manual:new"] and first.explanation == [timeline.CORRECTED, "heard"]
    assert second.alternates == ["old", "x", "y", "z", "u"] and second.confidence == 0.995
    assert second.metadata_hints == ["h", "manual:new"] and second.explanation == [timeline.CORRECTED]
    assert (other.kind, other.metadata_hints, other.explanation) == ("speech_only", ["h"], ["said"])
    assert timeline.corrected(segments(spark), fixes).columns == segments(spark).columns


def test_a_correction_of_no_segment_is_an_error(spark):
    fixes = spark.createDataFrame([("a", 0, 11, "new")], "item string, start_ms long, end_ms long, new_key string")
    with pytest.raises(Exception, match="Segment not found: a 0 11"):
        timeline.corrected(segments(spark), fixes, strict=True).collect()
    assert timeline.corrected(segments(spark), fixes).count() == 3


def test_delete_plans(spark):
    jobs = spark.createDataFrame([("a", True, "running"), ("b", False, "queued"), ("c", False, "failed")], "id string, pinned boolean, status string")
    asked = lambda *ids: spark.createDataFrame([(i,) for i in ids], "id string")
    plan = lambda df: {r.id: r.action for r in df.collect()}
    assert plan(library.delete_plan(jobs, asked("a", "c", "c"))) == {"a": "canceled", "c": "deleted"}
    assert plan(library.delete_plan(jobs, asked("a", "b", "zzz"), include_pinned=False, strict=False)) == {"a": "skipped", "b": "canceled"}
    with pytest.raises(Exception, match="Unknown job: zzz"):
        library.delete_plan(jobs, asked("a", "zzz")).collect()


def test_roll_ups_keep_few_errors(spark):
    rows = [("a", k, f"i{k}", "failed" if k % 2 else "succeeded", f"e{k}" if k % 2 else None) for k in range(2000)] + [("b", 0, "x", "succeeded", None), ("c", 0, "y", "failed", "no")]
    items = spark.createDataFrame(rows, "job_id string, seq int, id string, status string, error string")
    found = {r.job_id: (r.status, r.n_failed, r.first_error, r.summary) for r in library.status_rollup(items).collect()}
    assert found == {"a": ("partial_failed", 1000, "e1", "e1\ne3\ne5"), "b": ("succeeded", 0, None, ""), "c": ("failed", 1, "no", "no")}
    assert "WindowGroupLimit" in library.status_rollup(items)._jdf.queryExecution().executedPlan().toString()


def test_jobs_as_files_equal_jobs_as_values(spark, tmp_path):
    jobs = spark.createDataFrame([("a", "x"), ("b", None), ("c", 'q"')], "id string, status string")
    items = spark.createDataFrame([("a", k % 3, f"t{k}") for k in range(7)] + [("c", 0, None), ("gone", 1, "t")], "job_id string, seq int, title string")
    parts = spark.createDataFrame([("a", 1, 5)], "job_id string, seq int, start_ms int")
    pieces.write_files(export.job_pieces(jobs, items, parts), str(tmp_path / "out"), "job_id", ["section", "seq"], "text", ".json")
    files = {p.stem: json.loads(p.read_text()) for p in (tmp_path / "out").rglob("*.json")}
    values = {r.id: json.loads(r.body) for r in export.job_json(jobs, items, parts).collect()}
    assert files.keys() == values.keys() == {"a", "b", "c"}
    for k, v in values.items():
        assert files[k]["job"] == v["job"] and files[k]["segments"] == v.get("segments", [])
        order = lambda rows: sorted(rows, key=lambda r: (r["seq"], r.get("title") or ""))
        assert order(files[k]["items"]) == order(v.get("items", [])) and [r["seq"] for r in files[k]["items"]] == sorted(r["seq"] for r in files[k]["items"])


def test_metrics_in_pieces_equal_the_payload(spark):
    from spindrift.operators import ledger
    from spindrift.plans import views

    sf = "/root/testdata/sf0.001"
    rows = ledger.lifted(views.ledger(spark, sf)).where("job_id = 3")
    jobs = views.jobs(spark, sf).withColumn("options", F.struct(F.lit(5).alias("max_provider_calls"), F.lit(True).alias("budget_autoscale"), F.array(F.lit("vibra")).alias("provider_order")))
    job = store.known(jobs, 3)
    whole = json.loads(store.metrics_payload(rows, job, providers=["vibra"]).select(F.to_json(F.struct("*")).alias("t")).first().t)
    text = "".join(r.text for r in store.metrics_pieces(rows, job, providers=["vibra"]).orderBy("section", "id").collect())
    assert json.loads(text) == whole and whole["metrics"]


def test_many_jobs_share_files_as_lines(spark, tmp_path):
    """A file for each of many jobs took a block of the disk each."""
    jobs = spark.range(300).select(F.concat(F.lit("j"), "id").alias("id"), F.lit("a\nb").alias("status"))
    items = spark.range(900).select(F.concat(F.lit("j"), F.col("id") % 310).alias("job_id"), (F.col("id") % 2).alias("seq"), F.col("id").alias("title"))
    pieces.write_lines(export.job_pieces(jobs, items, items.select("job_id", "seq").limit(0)), str(tmp_path / "out"), "job_id", "text", ".jsonl", file_bytes=500)
    files = [p for p in (tmp_path / "out").rglob("*") if p.is_file()]
    assert len(files) < 30 and all(p.name.endswith(".jsonl.gz") for p in files)
    got = {b["job"]["id"]: b for b in (json.loads(r.value) for r in spark.read.option("recursiveFileLookup", "true").text(str(tmp_path / "out")).collect())}
    assert got.keys() == {f"j{k}" for k in range(300)} and all(b["job"]["status"] == "a\nb" for b in got.values())
    assert {k: [i["title"] for i in b["items"]] for k, b in got.items()} == {f"j{j}": sorted(range(j, 900, 310), key=lambda k: (k % 2, f"{k}}}")) for j in range(300)}
    with pytest.raises(Exception, match="no line breaks"):
        pieces.write_lines(spark.createDataFrame([("a", "x\ny")], "name string, t string"), str(tmp_path / "broken"), "name", "t")
    assert not [p for p in (tmp_path / "broken").rglob("*") if p.is_file()]


def test_sizes_of_folders_are_not_broadcast(spark):
    """Few bytes by Spark's reckoning, and many rows once exploded, which the driver had to hold."""
    from spindrift.operators import storage

    paths = spark.createDataFrame([(1, "a", "excerpt", "x", "/c/d"), (1, "b", "excerpt", "x", "/c/none")], "job_id int, source_item_id string, category string, label string, path string")
    files = spark.createDataFrame([("/c/d/e", 3), ("/c/d/f/g", 4), ("/c/h", 9)], "path string, size_bytes long")
    found = storage.entries(paths, files)
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    assert [(r.source_item_id, r.size_bytes) for r in found.collect()] == [("a", 7)]
    assert {(r.source_item_id, r.size_bytes, r.exists_flag) for r in storage.entries(paths, files, temporary=False).collect()} == {("a", 7, True), ("b", 0, False)}
