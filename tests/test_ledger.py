import json

from spindrift.operators import ledger

SCHEMA = "id string, source_item_id string, provider_name string, cache_hit boolean, matched boolean, call_count int, matched_segments int, unresolved_segments int, elapsed_ms int, payload string"
PROBE = {"ledger_version": 1, "start_ms": 0, "end_ms": 1, "probe_start_ms": 0, "probe_end_ms": 1, "cache_hit": False, "provider_call_attempted": False, "budget_consumed": 0, "budget_exhausted": False}


def frame(spark, rows):
    return spark.createDataFrame([(str(i), r.get("item"), r.get("provider"), r.get("hit", False), r.get("matched", False), r.get("calls", 0), r.get("m", 0), r.get("u", 0), 5, json.dumps(r.get("payload", {}))) for i, r in enumerate(rows)], SCHEMA)


ROWS = [
    {"item": "item-1", "provider": "vibra", "matched": True, "calls": 1, "payload": {"metric_type": "provider_attempt", "outcome": "provider_call_matched", "provider_call_attempted": True, "budget_consumed": 1}},
    {"item": "item-1", "provider": "audd", "hit": True, "payload": {"metric_type": "provider_attempt", "outcome": "cache_hit_empty"}},
    {"item": "item-1", "provider": "acrcloud", "payload": {"metric_type": "provider_decision", "outcome": "budget_exhausted"}},
    {"item": "item-1", "payload": {"metric_type": "item_summary", "outcome": "item_summary", "segment_count": 2}},
    {"item": "item-2", "m": 3},
    {"item": "item-2"},
    {"payload": {"outcome": "odd"}},
]


def test_totals_types_and_facets(spark):
    rows = ledger.lifted(frame(spark, ROWS))
    t = ledger.totals(rows).first()
    assert (t.metrics, t.provider_calls, t.provider_call_attempts, t.cache_hits, t.matched_metrics, t.budget_consumed, t.budget_exhausted) == (7, 1, 1, 1, 1, 1, 1)
    kinds = {r.metric_type: r.n for r in ledger.histogram(rows, "metric_type").collect()}
    assert kinds == {"provider_attempt": 2, "provider_decision": 1, "item_summary": 2, "unknown": 2}
    assert {r.provider: r.metrics for r in ledger.by_provider(rows).collect()}["job"] == 4
    ids = lambda **f: sorted(r.id for r in ledger.faceted(rows, **f).collect())
    assert ids(providers=["VIBRA"], outcomes=["provider_call_matched"], metric_types=["provider_attempt"]) == ["0"]
    assert ids(providers=["vibra", "audd"], metric_types=["provider_attempt"]) == ["0", "1"]
    assert ids(source_item_id="item-2") == ["4", "5"]
    assert ids(matched=True) == ["0"] and ids(cache_hit=True) == ["1"]
    assert ledger.totals(ledger.faceted(rows, providers=["none"])).first().metrics == 0


def errors(spark, row):
    found = ledger.validated(frame(spark, [row])).first()
    return found.effective_type, found.errors


def test_validation(spark):
    hit = PROBE | {"metric_type": "provider_attempt", "outcome": "cache_hit_matched", "cache_key": "k", "cache_hit": True}
    assert errors(spark, {"hit": True, "matched": True, "payload": hit}) == ("provider_attempt", [])
    assert errors(spark, {"hit": True, "matched": False, "payload": hit})[1] == ["matched_flag"]
    assert errors(spark, {"hit": True, "matched": True, "calls": 1, "payload": hit})[1] == ["cached_calls"]
    call = PROBE | {"outcome": "provider_error", "cache_key": "k", "provider_call_attempted": True}
    assert errors(spark, {"calls": 1, "payload": call}) == ("provider_attempt", ["error_details"])
    assert errors(spark, {"calls": 1, "payload": call | {"error_type": "a", "error_message": "b", "budget_remaining_before": 3}})[1] == ["call_budget"]
    skip = PROBE | {"outcome": "budget_exhausted", "skip_reason": "s", "budget_exhausted": True}
    assert errors(spark, {"payload": skip}) == ("provider_decision", [])
    assert errors(spark, {"payload": skip | {"outcome": "prefer_free_skip"}})[1] == ["decision_exhausted"]
    assert errors(spark, {"item": "i", "payload": {"metric_type": "item_summary", "outcome": "item_summary", "segment_count": -1}})[1] == ["summary_count"]
    assert errors(spark, {"payload": {"metric_type": "strange"}})[1] == ["unknown_type"]
    assert errors(spark, {"payload": {}}) == (None, [])


def test_pack_and_lift(spark):
    rows = ledger.lifted(frame(spark, [{"payload": {"gate_g1_hits": 2, "outcome": "x"}}])).withColumn("segments_merged", ledger.F.lit(4))
    packed = json.loads(ledger.packed(rows).first().payload)
    assert packed["segments_merged"] == 4 and packed["gate_g1_hits"] == 2 and packed["outcome"] == "x"
