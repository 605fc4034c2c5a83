"""Queries over the recognition ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.operators import ledger as L
from spindrift.plans import views
from spindrift.plans.registry import query

_SUMS = """count(*) as metrics, coalesce(sum(call_count), 0)::bigint as provider_calls, coalesce(sum(call_count), 0)::bigint as provider_call_attempts,
  coalesce(sum(cache_hit::int), 0)::bigint as cache_hits, coalesce(sum(matched::int), 0)::bigint as matched_metrics, coalesce(sum(budget_consumed), 0)::bigint as budget_consumed,
  coalesce(sum((raw_outcome = 'budget_exhausted')::int), 0)::bigint as budget_exhausted, coalesce(sum(elapsed_ms), 0)::bigint as elapsed_ms"""
_SEGMENTS = ", coalesce(sum(matched_segments), 0)::bigint as matched_segments, coalesce(sum(unresolved_segments), 0)::bigint as unresolved_segments"


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.lifted(views.ledger(spark, sf_dir))


@query(f"with {views.LEDGER} select {_SUMS}{_SEGMENTS} from ledger")
def ledger_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.totals(_rows(spark, sf_dir))


@query(f"with {views.LEDGER} select coalesce(provider_name, 'job') as provider, {_SUMS} from ledger group by 1")
def ledger_by_provider(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.by_provider(_rows(spark, sf_dir))


@query(f"with {views.LEDGER} select 'outcome' as facet, outcome as value, count(*) as n from ledger group by 2 union all select 'metric_type', metric_type, count(*) from ledger group by 2")
def ledger_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows(spark, sf_dir)
    parts = [L.histogram(rows, c).select(F.lit(c).alias("facet"), F.col(c).alias("value"), "n") for c in ("outcome", "metric_type")]
    return parts[0].unionByName(parts[1])


@query(f"""with {views.LEDGER}, c as (select coalesce(provider_name, 'job') as provider, outcome, count(*) as n from ledger group by 1, 2)
select provider, string_agg(outcome || '=' || n, ',' order by outcome) as outcomes from c group by 1""")
def ledger_provider_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = F.transform(F.map_entries("outcomes"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return L.provider_outcomes(_rows(spark, sf_dir)).select("provider", F.array_join(entries, ",").alias("outcomes"))


@query(f"""with {views.LEDGER} select {_SUMS}{_SEGMENTS} from ledger
where coalesce(provider_name, 'job') in ('vibra', 'audd') and lower(metric_type) in ('provider_attempt', 'unknown') and outcome in ('provider_call_matched', 'cache_hit_empty', 'budget_exhausted')""")
def ledger_faceted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.totals(L.faceted(_rows(spark, sf_dir), providers=[" VIBRA", "audd", " "], metric_types=["provider_attempt", "Unknown"], outcomes=["provider_call_matched", "cache_hit_empty", "budget_exhausted"]))


@query(f"with {views.LEDGER} select id, coalesce(provider_name, 'job') as provider, outcome, elapsed_ms from ledger where matched and not cache_hit and source_item_id = 'item-7' order by created_at, id")
def ledger_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = L.faceted(_rows(spark, sf_dir), source_item_id="item-7", matched=True, cache_hit=False)
    return found.orderBy("created_at", "id").select("id", "provider", "outcome", "elapsed_ms")


@query(f"with {views.LEDGER} select coalesce(sum(gate_g1_hits), 0)::bigint as gate_g1_hits, 0::bigint as gate_g2_hits, coalesce(sum(gate_g3_hits), 0)::bigint as gate_g3_hits, 0::bigint as gate_g4_hits, 0::bigint as gate_g5_hits from ledger")
def ledger_gate_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.gate_hits(_rows(spark, sf_dir))


@query(f"with {views.LEDGER} select job_id, sum(call_count)::bigint as provider_calls, sum(cache_hit::int)::bigint as cache_hits from ledger group by 1")
def ledger_job_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(spark, sf_dir).groupBy("job_id").agg(F.sum("call_count").alias("provider_calls"), F.count_if("cache_hit").alias("cache_hits"))


@query("""with e as (select event_id, (props->>'$.k')::int as k, event_type from events),
c as (select event_id, case k % 6 when 0 then 'ok' when 1 then 'cached_calls' when 2 then 'missing_keys' when 3 then 'summary_item' when 4 then 'ok' else 'unknown_outcome' end as expected from e)
select expected as error, count(*) as n from c group by 1""")
def ledger_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows seeded with one fault each, counted by the rule that finds it."""
    rows = views.table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))
    base = '"ledger_version":1,"start_ms":0,"end_ms":9,"probe_start_ms":0,"probe_end_ms":9,"cache_key":"a","cache_hit":%s,"provider_call_attempted":%s,"budget_consumed":0,"budget_exhausted":false'
    cached, called = base % ("true", "false"), base % ("false", "true")
    bodies = [
        f'{{"metric_type":"provider_attempt","outcome":"cache_hit_matched",{cached}}}', f'{{"metric_type":"provider_attempt","outcome":"cache_hit_matched",{cached}}}',
        '{"metric_type":"item_summary","outcome":"item_summary"}', '{"metric_type":"item_summary","outcome":"item_summary","segment_count":3}',
        f'{{"outcome":"provider_call_matched",{called}}}', f'{{"metric_type":"provider_attempt","outcome":"surprise",{called}}}',
    ]
    kind = F.col("k") % 6
    seeded = rows.select(
        F.col("event_id").alias("id"), F.when(kind == 3, F.lit(None)).otherwise("item").alias("source_item_id"), F.when(~kind.isin(2, 3), "audd").alias("provider_name"), kind.isin(0, 1).alias("cache_hit"),
        kind.isin(0, 1, 4).alias("matched"), F.when(kind.isin(1, 4), 1).otherwise(0).alias("call_count"), F.element_at(F.array(*map(F.lit, bodies)), kind + 1).alias("payload"),
    )
    found = L.validated(seeded).select(F.coalesce(F.get(F.col("errors"), F.lit(0)), F.lit("ok")).alias("error"))
    return found.groupBy("error").agg(F.count("*").alias("n"))


@query(f"""with {views.LEDGER} select id, sum(case when call_count > 0 then 1 else 0 end) over (partition by job_id order by created_at, id)::bigint as spent,
  call_count > 0 and sum(case when call_count > 0 then 1 else 0 end) over (partition by job_id order by created_at, id) <= 96 as allowed from ledger""")
def budget_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls in order against a budget of 96 for each job: a call is allowed while the sum of calls is within it."""
    from pyspark.sql import Window

    cost = F.when(F.col("call_count") > 0, 1).otherwise(0)
    spent = F.sum(cost).over(Window.partitionBy("job_id").orderBy("created_at", "id"))
    return views.ledger(spark, sf_dir).withColumn("spent", spent).select("id", "spent", ((F.col("call_count") > 0) & (F.col("spent") <= 96)).alias("allowed"))
