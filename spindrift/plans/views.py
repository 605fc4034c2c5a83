"""Adapters from the shared test tables to the timeline model, and the same views as DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PROVIDERS = ("local_catalog", "vibra", "audd", "acrcloud")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _k() -> Column:
    return F.get_json_object("props", "$.k").cast("int")


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate hits from ``events``: item, key, seq, start_ms, end_ms, confidence, provider, n_evidence."""
    start = F.timestamp_diff("SECOND", F.lit("2024-01-01").cast("timestamp_ntz"), F.col("ts"))
    rows = table(spark, sf_dir, "events").withColumns({"k": _k(), "start_ms": start})
    return rows.select(
        F.col("user_id").alias("item"), F.col("event_type").alias("key"), F.col("event_id").alias("seq"), "start_ms",
        (F.col("start_ms") + 12_000 * (1 + F.col("k") % 3)).alias("end_ms"), (0.5 + (F.col("k") % 50).cast("double") / 100).alias("confidence"),
        F.element_at(F.array(*map(F.lit, PROVIDERS)), F.col("k") % 4 + 1).alias("provider"), (F.col("k") % 5).alias("n_evidence"),
    )


HITS = """hits as (
  select user_id as item, event_type as key, event_id as seq, epoch_us(ts) // 1000000 - 1704067200 as start_ms,
    epoch_us(ts) // 1000000 - 1704067200 + 12000 * (1 + k % 3) as end_ms, 0.5::double + (k % 50)::double / 100 as confidence,
    ['local_catalog', 'vibra', 'audd', 'acrcloud'][k % 4 + 1] as provider, k % 5 as n_evidence
  from (select *, (props->>'$.k')::int as k from events))"""


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recognition ledger from ``events``; the payload is JSON, as it is stored."""
    rows = table(spark, sf_dir, "events").withColumn("k", _k())
    provider = F.when(F.col("event_type") == "click", "local_catalog").when(F.col("event_type") == "view", "vibra").when(F.col("event_type") == "purchase", "audd").when(F.col("event_type") == "signup", "acrcloud")
    cache_hit, matched = F.col("k") % 3 == 0, F.col("k") % 2 == 0
    outcome = (
        F.when(F.col("provider_name").isNull(), F.when(F.col("k") % 4 == 1, "item_summary"))
        .when(F.col("k") % 17 == 0, "budget_exhausted").when(cache_hit & matched, "cache_hit_matched").when(cache_hit, "cache_hit_empty")
        .when(matched, "provider_call_matched").when(F.col("k") % 5 == 0, "provider_error").otherwise("provider_call_empty")
    )
    kind = F.when(F.col("outcome") == "item_summary", "item_summary").when((F.col("outcome") == "budget_exhausted") & (F.col("k") % 4 == 0), "provider_decision").when(F.col("outcome") == "budget_exhausted", F.lit(None)).when(F.col("outcome").isNotNull(), "provider_attempt")
    rows = rows.withColumn("provider_name", provider).withColumn("outcome", outcome).withColumn("metric_type", kind)
    called = F.col("outcome").startswith("provider_")
    payload = F.to_json(F.struct("metric_type", "outcome", F.when(called, F.col("k") % 2).alias("budget_consumed"), (F.col("outcome") == "budget_exhausted").alias("budget_exhausted"), called.alias("provider_call_attempted"), F.when(F.col("k") % 6 == 0, F.col("k") % 4).alias("gate_g1_hits"), F.when(F.col("k") % 7 == 0, F.col("k") % 3).alias("gate_g3_hits"), F.when((F.col("k") % 8 == 0) & F.col("provider_name").isNull() & F.col("outcome").isNull(), F.col("k")).alias("segment_count")))
    return rows.select(
        F.col("event_id").alias("id"), (F.col("user_id") % 10).alias("job_id"), F.when(F.col("k") % 11 != 0, F.concat(F.lit("item-"), F.col("user_id"))).alias("source_item_id"), "provider_name",
        F.coalesce(F.col("outcome").startswith("cache_hit"), F.lit(False)).alias("cache_hit"), F.coalesce(F.col("outcome").endswith("_matched"), F.lit(False)).alias("matched"),
        F.coalesce(called.cast("int"), F.lit(0)).alias("call_count"), (F.col("k") % 5).alias("matched_segments"), (F.col("k") % 3).alias("unresolved_segments"), F.col("k").alias("elapsed_ms"), payload.alias("payload"), F.col("ts").alias("created_at"),
    )


LEDGER = """ledger0 as (
  select *, (props->>'$.k')::int as k,
    case event_type when 'click' then 'local_catalog' when 'view' then 'vibra' when 'purchase' then 'audd' when 'signup' then 'acrcloud' end as provider_name
  from events),
ledger1 as (
  select *, case when provider_name is null then case when k % 4 = 1 then 'item_summary' end when k % 17 = 0 then 'budget_exhausted'
    when k % 3 = 0 and k % 2 = 0 then 'cache_hit_matched' when k % 3 = 0 then 'cache_hit_empty' when k % 2 = 0 then 'provider_call_matched'
    when k % 5 = 0 then 'provider_error' else 'provider_call_empty' end as raw_outcome
  from ledger0),
ledger as (
  select event_id as id, user_id % 10 as job_id, case when k % 11 != 0 then 'item-' || user_id end as source_item_id, provider_name, k, raw_outcome,
    coalesce(raw_outcome like 'cache_hit%', false) as cache_hit, coalesce(raw_outcome like '%!_matched' escape '!', false) as matched,
    case when raw_outcome like 'provider!_%' escape '!' then 1 else 0 end as call_count, k % 5 as matched_segments, k % 3 as unresolved_segments, k as elapsed_ms,
    case when raw_outcome like 'provider!_%' escape '!' then k % 2 else 0 end as budget_consumed, case when k % 6 = 0 then k % 4 else 0 end as gate_g1_hits,
    case when k % 7 = 0 then k % 3 else 0 end as gate_g3_hits,
    case when raw_outcome is null and source_item_id is not null and (k % 8 = 0 or k % 5 != 0 or k % 3 != 0 or (k % 6 = 0 and k % 4 != 0) or (k % 7 = 0 and k % 3 != 0)) then 'item_summary'
      when raw_outcome is null then 'unknown' else raw_outcome end as outcome,
    case when raw_outcome is null and source_item_id is not null and (k % 8 = 0 or k % 5 != 0 or k % 3 != 0 or (k % 6 = 0 and k % 4 != 0) or (k % 7 = 0 and k % 3 != 0)) then 'item_summary'
      when raw_outcome is null then 'unknown' when raw_outcome = 'item_summary' then 'item_summary'
      when raw_outcome = 'budget_exhausted' then case when k % 4 = 0 then 'provider_decision' else 'unknown' end else 'provider_attempt' end as metric_type,
    ts as created_at
  from ledger1)"""


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs from ``orders``: id, status, title, playlist, input, created_at, updated_at, pinned."""
    rows = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    status = F.when(F.col("o_orderstatus") == "P", "partial_failed").when(F.col("o_orderstatus") == "F", F.when(key % 7 == 0, "failed").otherwise("succeeded")).otherwise(F.when(key % 2 == 0, "queued").otherwise("running"))
    return rows.select(
        key.alias("id"), status.alias("status"), F.when(key % 3 == 0, F.concat(F.lit("Mix "), key)).alias("title"), F.when(key % 5 == 0, F.concat(F.lit("List "), key)).alias("playlist"),
        F.concat(F.lit("/media/set/"), key, F.lit(".wav")).alias("input"), F.col("o_orderdate").alias("created_at"), F.timestamp_add("HOUR", (key % 72).cast("int"), F.col("o_orderdate")).alias("updated_at"), (key % 13 == 0).alias("pinned"),
    )


JOBS = """jobs as (
  select o_orderkey as id, case o_orderstatus when 'P' then 'partial_failed' when 'F' then case when o_orderkey % 7 = 0 then 'failed' else 'succeeded' end
      else case when o_orderkey % 2 = 0 then 'queued' else 'running' end end as status,
    case when o_orderkey % 3 = 0 then 'Mix ' || o_orderkey end as title, case when o_orderkey % 5 = 0 then 'List ' || o_orderkey end as playlist,
    '/media/set/' || o_orderkey || '.wav' as input, o_orderdate as created_at, o_orderdate + (o_orderkey % 72) * interval 1 hour as updated_at, o_orderkey % 13 = 0 as pinned
  from orders)"""


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source items from ``lineitem``: id, job_id, seq, status, error, duration_ms, n_segments, n_matched."""
    rows = table(spark, sf_dir, "lineitem")
    failed = F.col("l_returnflag") == "R"
    quantity = F.col("l_quantity").cast("long")
    return rows.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("id"), F.col("l_orderkey").alias("job_id"), F.col("l_linenumber").alias("seq"), F.when(failed, "failed").otherwise("succeeded").alias("status"),
        F.when(failed, F.concat(F.lit("no audio in part "), F.col("l_partkey"))).alias("error"), (quantity * 37_000 + F.col("l_partkey") % 1000).alias("duration_ms"),
        F.when(failed, 0).otherwise(quantity % 4).cast("long").alias("n_segments"), F.when(failed, 0).otherwise(quantity % 4 - F.least(F.lit(1), quantity % 2)).cast("long").alias("n_matched"),
    )


ITEMS = """items as (
  select concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) as id, l_orderkey as job_id, l_linenumber as seq,
    case when l_returnflag = 'R' then 'failed' else 'succeeded' end as status, case when l_returnflag = 'R' then 'no audio in part ' || l_partkey end as error,
    l_quantity::bigint * 37000 + l_partkey % 1000 as duration_ms, case when l_returnflag = 'R' then 0 else l_quantity::bigint % 4 end as n_segments,
    case when l_returnflag = 'R' then 0 else l_quantity::bigint % 4 - least(1, l_quantity::bigint % 2) end as n_matched
  from lineitem)"""


def artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored files from ``documents``: id, job_id, category, label, path, size_bytes, temporary."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"), (F.col("doc_id") % 50).alias("job_id"), F.col("lang").alias("category"), F.col("source").alias("label"), F.sha1(F.coalesce("text", F.lit(""))).alias("path"), F.col("n_chars").alias("size_bytes"), (F.col("doc_id") % 3 == 0).alias("temporary"),
    )


ARTIFACTS = """artifacts as (
  select doc_id as id, doc_id % 50 as job_id, lang as category, source as label, sha1(coalesce(text, '')) as path, n_chars as size_bytes, doc_id % 3 = 0 as temporary
  from documents)"""


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracks from ``part``: id, artist, title, isrc, provider_ids."""
    key = F.col("p_partkey")
    suffixes = F.array(*map(F.lit, ("", " (Remastered 2015)", " - Remastered 2011", " (feat. X)", " [Live]")))
    return table(spark, sf_dir, "part").select(
        key.alias("id"), F.concat("p_brand", F.when(key % 3 == 0, F.concat(F.lit(" & "), F.col("p_type"))).otherwise("")).alias("artist"),
        F.concat(F.when(key % 4 == 0, "The ").otherwise(""), F.col("p_name"), F.element_at(suffixes, (key % 5 + 1).cast("int"))).alias("title"),
        F.when(key % 7 == 0, F.concat(F.lit(" us"), F.lpad((key % 90).cast("string"), 10, "0"), F.lit(" "))).alias("isrc"),
        F.when(key % 11 == 0, F.create_map(F.lit("acrcloud"), F.concat(F.lit("A"), key % 40))).when(key % 6 == 0, F.create_map(F.lit("shazam"), F.concat(F.lit("S"), key % 25))).otherwise(F.create_map().cast("map<string,string>")).alias("provider_ids"),
    )


TRACKS = """tracks as (
  select p_partkey as id, p_brand || case when p_partkey % 3 = 0 then ' & ' || p_type else '' end as artist,
    case when p_partkey % 4 = 0 then 'The ' else '' end || p_name || ['', ' (Remastered 2015)', ' - Remastered 2011', ' (feat. X)', ' [Live]'][(p_partkey % 5 + 1)::int] as title,
    case when p_partkey % 7 = 0 then ' us' || lpad((p_partkey % 90)::varchar, 10, '0') || ' ' end as isrc,
    case when p_partkey % 11 = 0 then 'A' || p_partkey % 40 end as acr, case when p_partkey % 11 != 0 and p_partkey % 6 = 0 then 'S' || p_partkey % 25 end as shz
  from part)"""


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feature frames from ``embeddings``: item, idx, start_ms, end_ms, vector (doubles)."""
    from pyspark.sql import Window

    rows = table(spark, sf_dir, "embeddings").select(F.col("label").alias("item"), "vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("vector"))
    idx = F.row_number().over(Window.partitionBy("item").orderBy("vec_id")) - 1
    return rows.withColumn("idx", idx).select("item", "vec_id", "idx", (F.col("idx") * 1000).cast("long").alias("start_ms"), ((F.col("idx") + 1) * 1000).cast("long").alias("end_ms"), "vector")


FRAMES = """frames as (
  select label as item, vec_id, (row_number() over (partition by label order by vec_id) - 1)::int as idx,
    (row_number() over (partition by label order by vec_id) - 1) * 1000 as start_ms, (row_number() over (partition by label order by vec_id)) * 1000 as end_ms, embedding::double[] as vector
  from embeddings)"""


def durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Media durations from ``orders``: id, duration_ms, n_chapters, playlist, recording."""
    q = F.col("o_orderkey") * 37_111 + F.col("o_custkey") * 997
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), q.alias("q"))
    q = F.col("q")
    return rows.select("id", (q % 400_000 * (1 + q % 9) + 3_000).alias("duration_ms"), (q % 5).cast("int").alias("n_chapters"), (q % 6 == 0).alias("playlist"), (q % 4 == 0).alias("recording"))


DURATIONS = """durations as (
  select id, q % 400000 * (1 + q % 9) + 3000 as duration_ms, (q % 5)::int as n_chapters, q % 6 = 0 as playlist, q % 4 = 0 as recording
  from (select o_orderkey as id, o_orderkey * 37111 + o_custkey * 997 as q from orders))"""
