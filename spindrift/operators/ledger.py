"""Recognition ledger: payload lift, typing, facets, totals and validation."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Outcome vocabularies and lifted counters.
ATTEMPT_OUTCOMES = ("cache_hit_matched", "cache_hit_empty", "provider_call_matched", "provider_call_empty", "provider_error", "provider_exception", "budget_exhausted")
DECISION_OUTCOMES = ("provider_unavailable", "prefer_free_skip", "budget_exhausted")
GATES = ("gate_g1_hits", "gate_g2_hits", "gate_g3_hits", "gate_g4_hits", "gate_g5_hits")
COUNTERS = ("segments_merged", "segments_bridged_across_speech", "repeat_group_reconfirmed", "repeat_group_rejected", *GATES)


def loose_int(value: Column) -> Column:
    """Integers of loose JSON, zero for anything else."""
    return F.coalesce(F.when(F.lower(value.cast("string")).isin("true"), 1).otherwise(value.cast("string").try_cast("long")), F.lit(0).cast("long"))


def loose_bool(value: Column) -> Column:
    """true or a number other than zero; false for null."""
    return F.coalesce(F.lower(value.cast("string")) == "true", F.lit(False)) | (loose_int(value) != 0)


def lifted(ledger: DataFrame) -> DataFrame:
    """Rows with the payload's counters and flags as columns, and metric_type and outcome with their fallbacks.

    The payload is parsed once for all of them.
    """
    keys = (*COUNTERS, "budget_exhausted", "provider_call_attempted", "budget_consumed", "metric_type", "outcome", "segment_count")
    rows = ledger.select("*", F.json_tuple("payload", *keys).alias(*(f"_{k}" for k in keys)))
    counters = {c: loose_int(F.col(f"_{c}")) for c in (*COUNTERS, "budget_consumed")}
    flags = {"budget_exhausted_flag": loose_bool(F.col("_budget_exhausted")), "provider_call_attempted": loose_bool(F.col("_provider_call_attempted"))}
    rows = rows.withColumns(counters | flags | {"_kind": F.coalesce("_metric_type", F.lit("")), "_outcome": F.coalesce("_outcome", F.lit(""))})
    counted = (F.col("matched_segments") != 0) | (F.col("unresolved_segments") != 0)
    for c in COUNTERS:
        counted = counted | (F.col(c) != 0)
    summary = F.col("provider_name").isNull() & (F.col("call_count") == 0) & F.col("source_item_id").isNotNull() & (F.col("_segment_count").isNotNull() | counted)
    untyped = (F.col("_kind") == "") & (F.col("_outcome") == "")
    named = lambda c: F.when(untyped, F.when(summary, "item_summary").otherwise("unknown")).when(c == "", "unknown").otherwise(c)
    rows = rows.withColumns({"metric_type": named(F.col("_kind")), "outcome": named(F.col("_outcome"))}).drop("_kind", *(f"_{k}" for k in keys))
    return rows.withColumns({"provider": F.coalesce(F.nullif(F.col("provider_name"), F.lit("")), F.lit("job")), "exhausted": F.col("budget_exhausted_flag") | (F.col("outcome") == "budget_exhausted")})


def facet_values(values: Iterable[str] | None) -> list[str]:
    """Facet values stripped, lower-cased, distinct and sorted, without blanks."""
    return sorted({v.strip().lower() for v in values or () if v.strip()})


def faceted(rows: DataFrame, providers: Iterable[str] | None = None, outcomes: Iterable[str] | None = None, metric_types: Iterable[str] | None = None, source_item_id: str | None = None, matched: bool | None = None, cache_hit: bool | None = None) -> DataFrame:
    """Lifted rows that meet every facet; a facet is met by any of its values, and one not given is left out."""
    for column, values in (("provider", providers), ("outcome", outcomes), ("metric_type", metric_types)):
        if wanted := facet_values(values):
            rows = rows.where(F.lower(column).isin(wanted))
    if source_item_id:
        rows = rows.where(F.col("source_item_id") == source_item_id)
    for column, flag in (("matched", matched), ("cache_hit", cache_hit)):
        if flag is not None:
            rows = rows.where(F.col(column) == flag)
    return rows


def _measures() -> list[Column]:
    count_if = lambda c: F.count_if(c)
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return [
        F.count("*").alias("metrics"), total("call_count").alias("provider_calls"), count_if(F.col("provider_call_attempted")).alias("provider_call_attempts"), count_if(F.col("cache_hit")).alias("cache_hits"),
        count_if(F.col("matched")).alias("matched_metrics"), total("budget_consumed").alias("budget_consumed"), count_if(F.col("exhausted")).alias("budget_exhausted"), total("elapsed_ms").alias("elapsed_ms"),
    ]


def totals(rows: DataFrame) -> DataFrame:
    """One row of ten counters, zeros for no rows."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c)
    return rows.agg(*_measures(), total("matched_segments"), total("unresolved_segments"))


def by_provider(rows: DataFrame) -> DataFrame:
    return rows.groupBy("provider").agg(*_measures())


def histogram(rows: DataFrame, column: str) -> DataFrame:
    return rows.groupBy(column).agg(F.count("*").alias("n"))


def provider_outcomes(rows: DataFrame) -> DataFrame:
    """Counts by provider and outcome, as one map for each provider."""
    counts = rows.groupBy("provider", "outcome").agg(F.count("*").alias("n"))
    return counts.groupBy("provider").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("outcome", "n")))).alias("outcomes"))


def gate_hits(rows: DataFrame) -> DataFrame:
    return rows.agg(*(F.coalesce(F.sum(g), F.lit(0)).cast("long").alias(g) for g in GATES))


#: Keys that a payload of each kind must hold.
_PROBE_KEYS = ("ledger_version", "outcome", "start_ms", "end_ms", "probe_start_ms", "probe_end_ms", "cache_hit", "provider_call_attempted", "budget_consumed", "budget_exhausted")
REQUIRED = {"provider_attempt": (*_PROBE_KEYS, "cache_key"), "provider_decision": (*_PROBE_KEYS, "skip_reason"), "item_summary": ("metric_type", "outcome", "segment_count")}


def validated(ledger: DataFrame) -> DataFrame:
    """Add effective_type (inferred where the payload has none) and errors, the names of the rules that a row breaks."""
    keys = F.coalesce(F.json_object_keys("payload"), F.array().cast("array<string>"))
    has = lambda k: F.array_contains(keys, k)
    parsed = ("metric_type", "outcome", "cache_hit", "provider_call_attempted", "budget_exhausted", "budget_consumed", "segment_count")
    ledger = ledger.select("*", F.json_tuple("payload", *parsed).alias(*(f"_{k}" for k in parsed)))
    _text = lambda k: F.col(f"_{k}")
    kind, outcome = _text("metric_type"), _text("outcome")
    as_bool = lambda k: F.coalesce(_text(k) == "true", F.lit(False))
    is_bool = lambda k: F.coalesce(_text(k).isin("true", "false"), F.lit(False))
    is_int = lambda k: F.coalesce(_text(k).rlike(r"^-?\d+$"), F.lit(False))
    inferred = (
        F.when(kind.isNotNull(), kind).when(outcome.isNull(), F.lit(None))
        .when(outcome.isin(*DECISION_OUTCOMES) & ((outcome != "budget_exhausted") | ~has("cache_key")), "provider_decision")
        .when(outcome.isin(*ATTEMPT_OUTCOMES), "provider_attempt").otherwise("unknown_outcome")
    )
    rows = ledger.withColumn("effective_type", inferred)
    of = lambda t: F.col("effective_type") == t
    attempt, decision, summary = of("provider_attempt"), of("provider_decision"), of("item_summary")
    probe = attempt | decision
    missing = F.lit(False)
    for name, required in REQUIRED.items():
        missing = missing | (of(name) & (F.size(F.array_except(F.array(*map(F.lit, required)), keys)) > 0))
    consumed = loose_int(_text("budget_consumed"))
    cached = attempt & outcome.startswith("cache_hit")
    called = attempt & outcome.isin("provider_call_matched", "provider_call_empty", "provider_error", "provider_exception")
    spent = attempt & (outcome == "budget_exhausted")
    calls, hit, match = F.coalesce("call_count", F.lit(0)), F.coalesce("cache_hit", F.lit(False)), F.coalesce("matched", F.lit(False))
    rules = {
        "unknown_type": ~F.col("effective_type").isin(*REQUIRED),
        "missing_keys": missing,
        "unknown_outcome": (attempt & ~outcome.isin(*ATTEMPT_OUTCOMES)) | (decision & ~outcome.isin(*DECISION_OUTCOMES)) | (summary & (outcome != "item_summary")),
        "not_bool": probe & ~(is_bool("cache_hit") & is_bool("provider_call_attempted") & is_bool("budget_exhausted")),
        "not_int": (probe & ~is_int("budget_consumed")) | (summary & ~is_int("segment_count")),
        "cached_calls": cached & (~hit | (calls != 0) | as_bool("provider_call_attempted")),
        "cached_budget": cached & (as_bool("budget_exhausted") | (consumed != 0)),
        "matched_flag": attempt & ((outcome.endswith("_matched") & ~match) | (outcome.isin("cache_hit_empty", "provider_call_empty", "provider_error", "provider_exception") & match)),
        "call_flags": called & (hit | as_bool("cache_hit") | as_bool("budget_exhausted") | ~as_bool("provider_call_attempted") | (calls < 1)),
        "call_budget": called & has("budget_remaining_before") & (consumed < 1),
        "exhausted_flags": spent & (hit | as_bool("cache_hit") | as_bool("provider_call_attempted") | (consumed != 0) | (calls != 0) | ~as_bool("budget_exhausted")),
        "skip_reason": spent & ~has("skip_reason"),
        "error_details": attempt & outcome.isin("provider_error", "provider_exception") & ~(has("error_type") & has("error_message")),
        "decision_calls": decision & (hit | as_bool("cache_hit") | (calls != 0) | as_bool("provider_call_attempted") | (consumed != 0)),
        "decision_exhausted": decision & (as_bool("budget_exhausted") != (outcome == "budget_exhausted")),
        "summary_count": summary & (loose_int(_text("segment_count")) < 0),
        "summary_item": summary & F.col("source_item_id").isNull(),
        "summary_provider": summary & (F.col("provider_name").isNotNull() | hit | match | (calls != 0)),
    }
    broken = F.filter(F.array(*(F.when(F.coalesce(rule, F.lit(False)), name) for name, rule in rules.items())), lambda x: x.isNotNull())
    return rows.withColumn("errors", broken).drop(*(f"_{k}" for k in parsed))


def packed(rows: DataFrame) -> DataFrame:
    """Add payload: its counters that are not zero, as JSON numbers, behind the members of the payload there is (the reverse of ``lifted``)."""
    own = F.coalesce(F.json_object_keys("payload"), F.array().cast("array<string>"))
    extra = F.to_json(F.struct(*(F.when((F.col(c) != 0) & ~F.array_contains(own, c), F.col(c)).alias(c) for c in COUNTERS)))
    members = lambda text: F.regexp_replace(F.trim(text), r"^\{\s*|\s*\}$", "")
    both = F.filter(F.array(members(F.coalesce("payload", F.lit(""))), members(extra)), lambda m: m != "")
    return rows.withColumn("payload", F.concat(F.lit("{"), F.array_join(both, ","), F.lit("}")))
