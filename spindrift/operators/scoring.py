"""Candidate scores, acceptance gates and early stops."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Weights of providers; others weigh 0.80.
WEIGHTS = {"local_catalog": 0.93, "acrcloud": 0.90, "audd": 0.87, "vibra": 0.82}
PAID = ("audd", "acrcloud")


def weight(provider: Column) -> Column:
    found = F.lit(0.80)
    for name, value in WEIGHTS.items():
        found = F.when(provider == name, value).otherwise(found)
    return found


def score(confidence: Column, provider: Column, hinted: Column, repeated: Column, n_evidence: Column) -> Column:
    """Weighted confidence, raised by hints, repeats and evidence, at most 1."""
    raised = confidence * weight(provider) + F.when(hinted, 0.05).otherwise(0.0) + F.when(repeated, 0.04).otherwise(0.0) + F.least(F.lit(0.08), 0.02 * n_evidence)
    return F.least(F.lit(1.0), raised)


def gate(n_providers: Column, n_hits: Column, best: Column, music_ratio: Column, has_isrc: Column) -> Column:
    """Name of the first gate that accepts a candidate, null for none."""
    return (
        F.when(n_providers >= 2, "G1").when(n_hits >= 2, "G2").when(best >= 0.72, "G3")
        .when((best >= 0.60) & (music_ratio >= 0.35), "G4").when(has_isrc & (best >= 0.55), "G5")
    )


def best_candidates(scored: DataFrame, group: list[str]) -> DataFrame:
    """Per group, the key with the largest sum of scores (to nine decimals, so that order of addition does not matter; the first seen of equals) and its best hit.

    scored: group columns, key, seq, score, confidence, provider.
    """
    keys = scored.groupBy(*group, "key").agg(
        F.round(F.sum("score"), 9).alias("total"), F.count("*").alias("n_hits"), F.count_distinct("provider").alias("n_providers"), F.min("seq").alias("first_seq"),
        F.max_by(F.struct("seq", "score", "confidence", "provider"), F.struct("score", "confidence", -F.col("seq"))).alias("best"),
    )
    top = keys.groupBy(*group).agg(F.max_by(F.struct("key", "total", "n_hits", "n_providers", "best"), F.struct("total", -F.col("first_seq"))).alias("_top"))
    return top.select(*group, "_top.*")


def consensus(candidates: DataFrame, group: list[str], least: int = 2, strong: float = 0.92) -> DataFrame:
    """Per group, its most frequent key (the first seen of equals), that key's hits and best confidence, and whether a walk stops there."""
    keys = candidates.groupBy(*group, "key").agg(F.count("*").alias("n"), F.max("confidence").alias("confidence"), F.min("seq").alias("first_seq"))
    top = keys.groupBy(*group).agg(F.max_by(F.struct("key", "n", "confidence"), F.struct("n", -F.col("first_seq"))).alias("_top")).select(*group, "_top.*")
    return top.withColumn("stop", (F.col("n") >= least) | (F.col("confidence") >= strong))


def item_summary(segments: DataFrame) -> DataFrame:
    """Per item: matched and other segments, and segments by gate."""
    gates = [F.count_if(F.col("acceptance_gate") == f"G{k}").alias(f"gate_g{k}_hits") for k in range(1, 6)]
    matched = F.col("acceptance_gate").isNotNull()
    return segments.groupBy("item").agg(F.count_if(matched).alias("matched_segments"), F.count_if(~matched).alias("unresolved_segments"), *gates)


def outcome(cached: Column, available: Column, called: Column, failed: Column, matched: Column, exhausted: Column, skipped: Column) -> Column:
    """Outcome of one provider's turn at a window."""
    return (
        F.when(cached, F.when(matched, "cache_hit_matched").otherwise("cache_hit_empty")).when(~available, "provider_unavailable").when(skipped, "prefer_free_skip")
        .when(exhausted, "budget_exhausted").when(failed, "provider_error").when(called & matched, "provider_call_matched").when(called, "provider_call_empty")
    )


def provider_walk(turns: DataFrame, budget: int, strong_free: float = 0.80) -> DataFrame:
    """Outcome of every (item, window, place) turn of providers in order.

    A strong hit of a free provider spares the paid ones after it; calls of an item are paid from one budget in order of
    window and place, a cached answer costs nothing. turns: item, window, place, provider, available, cached, matched, confidence, failed.
    """
    at = Window.partitionBy("item", "window").orderBy("place")
    free_hit = F.col("matched") & ~F.col("provider").isin(*PAID) & (F.col("confidence") >= strong_free) & F.col("available")
    before = F.max(free_hit.cast("int")).over(at.rowsBetween(Window.unboundedPreceding, -1))
    skipped = F.col("provider").isin(*PAID) & (F.coalesce(before, F.lit(0)) == 1) & ~F.col("cached")
    asks = (F.col("available") & ~F.col("cached") & ~F.col("skipped")).cast("int")
    spent = F.sum("asks").over(Window.partitionBy("item").orderBy("window", "place"))
    rows = turns.withColumn("skipped", skipped).withColumn("asks", asks).withColumn("spent", spent)
    exhausted = F.col("spent") > budget
    rows = rows.withColumn("outcome", outcome(F.col("cached"), F.col("available"), F.col("asks") == 1, F.col("failed"), F.col("matched"), exhausted, F.col("skipped")))
    return rows.drop("asks", "spent", "skipped")
