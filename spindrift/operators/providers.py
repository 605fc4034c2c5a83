"""Recognizers as rows: states, saved settings, cached answers, turns not taken, repeats confirmed again."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.operators.scoring import PAID

#: Fixed value: the default order of recognizers. Those not named come last.
ORDER = ("local_catalog", "vibra", "audd", "acrcloud")
LAST_RANK = 999


def is_paid(name: Column) -> Column:
    return name.isin(*PAID)


def _given(config: Column, key: str) -> Column:
    return F.coalesce(config[key], F.lit("")) != ""


def states(facts: DataFrame) -> DataFrame:
    """name, enabled, available, reason and config of each recognizer.

    facts: name, program (whether its program is there), n_tracks (of the catalog), config map<string,string>. Local ones
    need their program, and the catalog a track; the others need their keys.
    """
    name, config = F.col("name"), F.col("config")
    token, keys = _given(config, "api_token"), _given(config, "host") & _given(config, "access_key") & _given(config, "access_secret")
    local = name.isin("local_catalog", "vibra")
    configured = F.when(name == "audd", token).when(name == "acrcloud", keys).otherwise(F.lit(False))
    there = F.coalesce(F.col("program"), F.lit(False))
    reason = F.when(local, F.when(~there, F.concat(F.lit("Missing program: "), name))).when(configured, F.lit(None)).when(name == "audd", "Set provider config with api_token").when(name == "acrcloud", "Set host, access_key, access_secret")
    shown = (
        F.when(name == "local_catalog", F.create_map(F.lit("track_count"), F.coalesce("n_tracks", F.lit(0)).cast("string")))
        .when(name == "audd", F.create_map(F.lit("configured"), token.cast("string"))).when(name == "acrcloud", F.create_map(F.lit("configured"), keys.cast("string"), F.lit("host"), F.coalesce(config["host"], F.lit(""))))
        .otherwise(F.create_map().cast("map<string,string>"))
    )
    available = F.when(name == "local_catalog", there & (F.coalesce("n_tracks", F.lit(0)) > 0)).when(local, there).otherwise(configured)
    others = [c for c in facts.columns if c not in ("name", "program", "n_tracks", "config")]
    return facts.select(*others, "name", F.when(local, True).otherwise(configured).alias("enabled"), available.alias("available"), reason.alias("reason"), shown.alias("config"))


def overlaid(below: Column, above: Column) -> Column:
    """Both maps as one; ``above`` wins where both have a key."""
    return F.map_concat(F.map_filter(below, lambda k, v: ~F.map_contains_key(above, k)), above)


def with_settings(found: DataFrame, saved: DataFrame, order: Iterable[str] = ORDER) -> DataFrame:
    """States with what is saved (name, enabled, config) laid over them, and their rank."""
    own = saved.select(F.col("name").alias("_name"), F.col("enabled").alias("_enabled"), F.col("config").alias("_config"))
    rank = F.array_position(F.array(*map(F.lit, order)), F.col("name"))
    rows = found.join(own, F.col("name") == F.col("_name"), "left")
    others = [c for c in found.columns if c not in ("name", "enabled", "available", "reason", "config")]
    return rows.select(
        *others, "name", F.coalesce("_enabled", "enabled").alias("enabled"), "available", "reason",
        F.when(F.col("_config").isNull(), F.col("config")).otherwise(overlaid(F.col("config"), F.col("_config"))).alias("config"), F.when(rank > 0, rank - 1).otherwise(LAST_RANK).cast("int").alias("rank"),
    )


def saved_settings(rows: DataFrame) -> DataFrame:
    """name, enabled and config map of a table of settings (name, enabled as a number, config_json); a faulty text is an empty map."""
    config = F.coalesce(F.from_json("config_json", "map<string,string>"), F.create_map().cast("map<string,string>"))
    return rows.select("name", (F.coalesce(F.col("enabled"), F.lit(0)) != 0).alias("enabled"), config.alias("config"))


def active(names: DataFrame, saved: DataFrame) -> DataFrame:
    """Recognizers that are not switched off; those without settings are on."""
    return names.join(saved.where(~F.col("enabled")).select("name"), "name", "left_anti")


def fingerprint_key(duration: Column, fingerprint: Column, positions: int = 120) -> Column:
    """Key of cached answers: the digest of duration and first positions as compact JSON. ``duration`` is text as it was read."""
    numbers = F.array_join(F.transform(F.slice(fingerprint, 1, positions), lambda x: x.cast("string")), ",")
    return F.sha1(F.concat(F.lit('{"duration":'), duration, F.lit(',"fingerprint":['), numbers, F.lit("]}")))


def excerpt_name(source: Column, start_ms: Column, end_ms: Column, label: Column) -> Column:
    """File name of an excerpt."""
    return F.concat(F.sha1(F.concat_ws(":", source, start_ms, end_ms, label)), F.lit(".wav"))


def cached_answers(probes: DataFrame, cache: DataFrame) -> DataFrame:
    """Probes (cache_key, provider) with the answers kept for them: cache_hit and n_hits, null where none are kept.

    cache: cache_key, provider, candidates (JSON list), created_at; the last row of a key counts.
    """
    last = cache.groupBy("cache_key", "provider").agg(F.max_by("candidates", "created_at").alias("_kept"))
    rows = probes.join(last, ["cache_key", "provider"], "left")
    hit = F.col("_kept").isNotNull()
    return rows.withColumns({"cache_hit": hit, "n_hits": F.when(hit, F.coalesce(F.json_array_length("_kept"), F.lit(0)))}).drop("_kept")


def called_outcome(cache_hit: Column, n_hits: Column, refused: Column, failed: Column, raised: Column) -> Column:
    """Outcome of a recognizer that is asked: kept answer, refused for want of budget, error, or answer."""
    some = F.coalesce(n_hits, F.lit(0)) > 0
    return (
        F.when(cache_hit & some, "cache_hit_matched").when(cache_hit, "cache_hit_empty").when(refused, "budget_exhausted").when(failed, "provider_error")
        .when(raised, "provider_exception").when(some, "provider_call_matched").otherwise("provider_call_empty")
    )


def decision_rows(turns: DataFrame) -> DataFrame:
    """Ledger rows of turns not taken (id, job_id, source_item_id, provider_name, start_ms, end_ms, outcome, skip_reason, remaining, created_at).

    Nothing is called or consumed; ``remaining``, where known, is the budget before and after.
    """
    span = [F.col(c).alias(a) for a, c in (("start_ms", "start_ms"), ("end_ms", "end_ms"), ("probe_start_ms", "start_ms"), ("probe_end_ms", "end_ms"))]
    spent = F.col("outcome") == "budget_exhausted"
    payload = F.struct(
        F.lit("provider_decision").alias("metric_type"), F.lit(1).alias("ledger_version"), "outcome", *span, F.lit(False).alias("cache_hit"), F.lit(False).alias("provider_call_attempted"), F.lit(0).alias("budget_consumed"),
        spent.alias("budget_exhausted"), F.when(spent, "provider-call budget exhausted").otherwise(F.col("skip_reason")).alias("skip_reason"), F.col("remaining").alias("budget_remaining_before"), F.col("remaining").alias("budget_remaining_after"),
    )
    zero = lambda c: F.lit(0).alias(c)
    return turns.select(
        "id", "job_id", "source_item_id", "provider_name", F.lit(False).alias("cache_hit"), F.lit(False).alias("matched"), zero("call_count"), zero("matched_segments"), zero("unresolved_segments"), zero("elapsed_ms"),
        F.to_json(payload).alias("payload"), "created_at",
    )


def reconfirmed(hits: DataFrame, group: list[str]) -> DataFrame:
    """Per draft, whether the match of its repeat group holds: the first free recognizer with a hit decides, null for none.

    hits: group columns, place (of the recognizer), provider, available, key (null for no hit), reused_key.
    """
    free = hits.where(~is_paid(F.col("provider")) & F.col("available") & F.col("key").isNotNull())
    by_place = free.groupBy(*group, "place").agg(F.bool_or(F.col("key") == F.col("reused_key")).alias("same"))
    decided = by_place.groupBy(*group).agg(F.min_by("same", "place").alias("confirmed"))
    return hits.select(*group).distinct().join(decided, group, "left")


def net_cost(excerpt_there: Column, failed: Column, answered_from_cache: Column) -> Column:
    """Calls a probe costs: one is reserved with its excerpt and given back if that fails or a kept answer comes."""
    return F.when((failed & ~excerpt_there) | answered_from_cache, 0).otherwise(1)
