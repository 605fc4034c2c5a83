"""Watches and running counts over a growing log."""

import threading
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from spindrift.streaming import events as S

LOG = "id long, job_id string, message string"
ITEMS = "input string, status string"


def grow(spark, folder, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))


def log_of(spark, folder):
    return S.read_log(spark, str(folder), LOG)


def ids(spark, out):
    return sorted(r.id for r in S.read_batches(spark, str(out), LOG).collect())


def test_a_resumed_delivery_repeats_nothing(spark, tmp_path):
    log, out, cp = tmp_path / "log", tmp_path / "out", str(tmp_path / "cp")
    for k in range(3):
        grow(spark, log, [(3 * k + 1, "a", "x"), (3 * k + 2, "b", "y"), (3 * k + 3, "a", None)], LOG)
    assert S.delivered(log_of(spark, log), "a", str(out), cp)
    assert ids(spark, out) == [1, 3, 4, 6, 7, 9]
    # Killed after the last batch was written and before it was committed: the batch runs again.
    for name in ("commits", "offsets"):
        assert Path(cp, name, "2").exists()
    Path(cp, "commits", "2").unlink()
    Path(cp, "commits", ".2.crc").unlink(missing_ok=True)
    grow(spark, log, [(10, "a", "z"), (11, "b", "z")], LOG)
    S.delivered(log_of(spark, log), "a", str(out), cp)
    assert ids(spark, out) == [1, 3, 4, 6, 7, 9, 10]
    # Even a watch that has lost its checkpoint goes on after the cursor.
    grow(spark, log, [(12, "a", "z")], LOG)
    S.delivered(log_of(spark, log), "a", str(out), str(tmp_path / "other"))
    assert ids(spark, out) == [1, 3, 4, 6, 7, 9, 10, 12]
    later = tmp_path / "later"
    S.delivered(log_of(spark, log), "a", str(later), str(tmp_path / "cp3"), cursor=6)
    assert ids(spark, later) == [7, 9, 10, 12]


def test_a_watch_ends_with_the_job(spark, tmp_path):
    log, out = tmp_path / "log", tmp_path / "out"
    grow(spark, log, [(1, "a", "begun")], LOG)
    state = {"status": "running"}
    statuses = lambda: spark.createDataFrame([("a", state["status"])], "id string, status string")

    def finish():
        time.sleep(3)
        grow(spark, log, [(2, "a", "done")], LOG)
        state["status"] = "partial_failed"

    worker = threading.Thread(target=finish)
    worker.start()
    ended = S.watched(log_of(spark, log), statuses, "a", str(out), str(tmp_path / "cp"), interval_s=0.2)
    worker.join()
    assert ended == ("partial_failed", False) and ended.code == 0 and ids(spark, out) == [1, 2]
    state["status"] = "canceled"
    assert S.watched(log_of(spark, log), statuses, "a", str(out), str(tmp_path / "cp")).code == 1
    assert ids(spark, out) == [1, 2]


def test_a_watch_times_out_and_refuses_unknown_jobs(spark, tmp_path):
    log = tmp_path / "log"
    grow(spark, log, [(1, "a", "begun")], LOG)
    statuses = lambda: spark.createDataFrame([("a", "running")], "id string, status string")
    began = time.monotonic()
    ended = S.watched(log_of(spark, log), statuses, "a", str(tmp_path / "out"), str(tmp_path / "cp"), interval_s=0.1, timeout_s=4)
    assert ended.timed_out and ended.code == 2 and ended.status == "running" and time.monotonic() - began < 30
    with pytest.raises(ValueError, match="Unknown job"):
        S.watched(log_of(spark, log), statuses, "zzz", str(tmp_path / "o"), str(tmp_path / "c"))
    with pytest.raises(ValueError, match="below zero"):
        S.watched(log_of(spark, log), statuses, "a", str(tmp_path / "o"), str(tmp_path / "c"), timeout_s=-1)


def test_running_counts_equal_the_batch_counts_after_every_batch(spark, tmp_path):
    source, out, cp = tmp_path / "items", str(tmp_path / "out"), str(tmp_path / "cp")
    batches = [[("a", "succeeded"), ("b", "failed")], [("a", "failed")], [("c", None), ("c", "succeeded"), (None, "failed")], [("b", "succeeded")] * 3, [("a", "succeeded")]]
    seen = []
    for k, rows in enumerate(batches):
        grow(spark, source, rows, ITEMS)
        seen += rows
        S.discovered(S.read_log(spark, str(source), ITEMS), out, cp, compact_every=2)
        expected = {i: (sum(x == i for x, _ in seen), sum(x == i and s == "succeeded" for x, s in seen), sum(x == i and s == "failed" for x, s in seen)) for i in {x for x, _ in seen}}
        assert {r.input: (r.found, r.done, r.failed) for r in S.discovery(spark, out).collect()} == expected
        changed = S.read_batches(spark, f"{out}/changes", S.PROGRESS).where(F.col("batch") == k)
        assert {r.input for r in changed.collect()} == {i for i, _ in rows}  # update mode: only what a batch changed
    assert S.numbers(spark, f"{out}/base") == [1, 3]
    assert {r.input: r.found for r in S.discovery(spark, out, upto=1).collect()} == {"a": 2, "b": 1}
