"""Queries over durations: profiles, budgets and windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.operators import planning
from spindrift.plans import views
from spindrift.plans.registry import query

_D = views.DURATIONS
_PROFILE = f"""{_D},
profile as (select *, case when duration_ms >= 1500000 then 'long_mix' when n_chapters >= 2 or duration_ms >= 15000 then 'multi_track' else 'single_track' end as strategy,
  case when duration_ms >= 1500000 then greatest(24, least(360, ceil(duration_ms / 90000)))::int when n_chapters >= 2 or duration_ms >= 15000 then greatest(6, least(36, ceil(duration_ms / 12000)))::int else 6 end as max_windows from durations),
budgeted as (select *, case strategy when 'long_mix' then least(420, max_windows + 48) when 'multi_track' then least(96, max_windows * 3) else 6 end as request_budget,
  case strategy when 'single_track' then 2 else 0 end as stop_after, duration_ms < 1500000 or duration_ms <= 5400000 as separate from profile)"""


def _profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planning.with_profile(views.durations(spark, sf_dir).withColumn("has_structure", F.col("n_chapters") >= 2))


@query(f"with {_PROFILE} select id, strategy, max_windows, request_budget, stop_after, separate from budgeted")
def source_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _profiles(spark, sf_dir).select("id", "strategy", "max_windows", "request_budget", "stop_after", "separate")


@query(f"""with {_PROFILE}, m as (select *, ['auto', 'long_mix', 'single_track', 'playlist_entry'][n_chapters % 4 + 1] as mode from budgeted),
a as (select *, case when mode = 'auto' and recording and duration_ms <= 90000 then 'single_track' else strategy end as s from m)
select case when mode in ('long_mix', 'single_track') then mode when mode = 'playlist_entry' and s != 'long_mix' then 'multi_track' else s end as strategy, mode, count(*) as n from a group by 1, 2""")
def strategy_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    modes = F.array(*map(F.lit, ("auto", "long_mix", "single_track", "playlist_entry")))
    rows = _profiles(spark, sf_dir).withColumn("mode", F.element_at(modes, F.col("n_chapters") % 4 + 1))
    strategy = planning.overridden_strategy(F.col("strategy"), F.col("mode"), F.col("recording"), F.col("duration_ms"))
    return rows.groupBy(strategy.alias("strategy"), "mode").agg(F.count("*").alias("n"))


@query(f"""with {_D} select id, case when n_chapters = 0 then case when duration_ms >= 1500000 then 420 else 96 end when playlist then greatest(420, 6 * greatest(1, n_chapters * 40)) else 420 end as budget from durations""")
def effective_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    budget = planning.effective_budget(F.lit(420), F.col("n_chapters") != 0, F.col("playlist"), F.col("duration_ms"), 3, F.col("n_chapters") * 40)
    return views.durations(spark, sf_dir).select("id", budget.alias("budget"))


@query("""with g as (select distinct p_partkey % 16 + 1 as cpus, (p_size * 7 + p_partkey) % 33 as ram, p_size % 9 as asked from part)
select cpus, ram, asked, case when ram <= 0 then least(4, greatest(2, cpus)) else greatest(1, least(8, case when cpus > 2 then cpus - 1 else cpus end, greatest(1, floor((ram - 2) / 1.5)::bigint))) end::int as workers,
  greatest(1, least(6, greatest(2, 2 * cpus), greatest(1, ram)))::int as segment_workers from g""")
def worker_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Machines with the cores and memory that parts' sizes and keys give."""
    key, size = F.col("p_partkey"), F.col("p_size")
    grid = views.table(spark, sf_dir, "part").select((key % 16 + 1).alias("cpus"), ((size * 7 + key) % 33).alias("ram"), (size % 9).alias("asked")).distinct()
    return grid.select("cpus", "ram", "asked", planning.job_workers(F.col("cpus"), F.col("ram")).alias("workers"), planning.segment_workers(F.lit(0), F.col("cpus"), F.col("ram")).cast("int").alias("segment_workers"))


_STARTS = "list_distinct(range(0, greatest(0, {last}) + 1, {step}) || [greatest(0, {last})])"


@query(f"""with {_PROFILE}, l as (select id, duration_ms, max_windows, greatest(60000, ceil(duration_ms / max_windows)::bigint) as step from budgeted where strategy = 'long_mix'),
w as (select id, duration_ms, unnest(list_sort({_STARTS.format(last='duration_ms - 12000', step='step')})[1:max_windows]) as start_ms from l) select id, start_ms, least(duration_ms, start_ms + 12000) as end_ms from w""")
def uniform_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage of long media."""
    rows = _profiles(spark, sf_dir).where("strategy = 'long_mix'")
    return planning.uniform_windows(rows, planning.long_step(F.col("duration_ms"), F.col("max_windows")), F.col("max_windows")).select("id", "start_ms", "end_ms")


@query(f"""with {_D}, w as (select id, duration_ms, unnest({_STARTS.format(last='duration_ms - 14000', step='10000')}) as start_ms from durations where duration_ms < 1500000) select id, start_ms, least(duration_ms, start_ms + 14000) as end_ms from w""")
def sliding_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows over all media but long mixes."""
    return planning.sliding_windows(views.durations(spark, sf_dir).where(F.col("duration_ms") < planning.LONG_MS), 14_000, 10_000).select("id", "start_ms", "end_ms")


@query(f"""with {_D}, m as (select distinct id, duration_ms, unnest([0, duration_ms // 5, duration_ms // 5 + 9000, duration_ms // 2, duration_ms + 5]) as mark_ms from durations where n_chapters >= 2),
i as (select *, coalesce(lead(mark_ms) over (partition by id order by mark_ms), duration_ms) as nxt from m where mark_ms >= 0 and mark_ms < duration_ms),
s as (select *, least(greatest(mark_ms, mark_ms + least(30000, greatest(8000, (nxt - mark_ms) // 4))), greatest(0, duration_ms - 12000)) as start_ms from i) select id, mark_ms, start_ms, least(duration_ms, start_ms + 12000) as end_ms from s""")
def metadata_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("duration_ms")
    marks = F.array(F.lit(0).cast("long"), F.expr("duration_ms div 5"), F.expr("duration_ms div 5") + 9_000, F.expr("duration_ms div 2"), d + 5)
    rows = views.durations(spark, sf_dir).where("n_chapters >= 2").withColumn("mark_ms", F.explode(marks))
    return planning.metadata_windows(rows).select("id", "mark_ms", "start_ms", "end_ms")


_SEGMENTS = f"""{_D}, segments as (select id, start_ms, start_ms + length_ms as end_ms, kind from (
  select id, duration_ms % 7919 as start_ms, duration_ms % 61000 + 500 as length_ms, case n_chapters when 0 then 'speech_only' when 1 then 'silence_or_fx' else 'music_unresolved' end as kind from durations))"""


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("duration_ms")
    kind = F.when(F.col("n_chapters") == 0, "speech_only").when(F.col("n_chapters") == 1, "silence_or_fx").otherwise("music_unresolved")
    return views.durations(spark, sf_dir).select("id", (d % 7_919).alias("start_ms"), (d % 7_919 + d % 61_000 + 500).alias("end_ms"), kind.alias("kind"))


@query(f"""with {_SEGMENTS}, m as (select *, end_ms - start_ms as len from segments where kind = 'music_unresolved'), z as (select *, least(12000, greatest(7000, floor(len * 0.45::double)::bigint)) as size from m),
a as (select *, unnest([0.18::double, 0.5::double, 0.82::double]) as anchor from z where len > 12000),
p as (select id, least(greatest(start_ms, start_ms + floor(len * anchor)::bigint - size // 2), greatest(start_ms, end_ms - size)) as probe_start, end_ms, size from a)
select distinct id, probe_start, least(end_ms, probe_start + size) as probe_end from p union all select id, start_ms, end_ms from m where len <= 12000""")
def probe_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planning.probe_windows(_segments(spark, sf_dir)).select("id", "probe_start", "probe_end")


@query(f"""with {_SEGMENTS}, z as (select *, greatest(1000, end_ms - start_ms) as len from segments), y as (select *, least(18000, len) as size, start_ms + len // 2 as mid from z),
p as (select id, unnest([{{'a': start_ms, 'b': least(end_ms, start_ms + size)}}, {{'a': greatest(start_ms, mid - size // 2), 'b': least(end_ms, mid + size // 2)}}, {{'a': greatest(start_ms, end_ms - size), 'b': end_ms}}]) as w from y)
select distinct id, w.a as probe_start, w.b as probe_end from p where w.b > w.a""")
def retry_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planning.retry_windows(_segments(spark, sf_dir)).select("id", "probe_start", "probe_end")


@query(f"""with {_SEGMENTS}, z as (select *, end_ms - start_ms as len, case when end_ms - start_ms <= 20000 then 1 else greatest(2, ceil((end_ms - start_ms) / 20000)::int) end as parts from segments),
p as (select *, len // parts as size, unnest(range(parts)) as part from z)
select id, part::int as part, start_ms + part * size as start_ms, case when part = parts - 1 then end_ms else least(end_ms, start_ms + part * size + size) end as end_ms from p""")
def split_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planning.split_long(_segments(spark, sf_dir), 20_000).select("id", "part", "start_ms", "end_ms")


def _dealt(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """Dealt out, since two numbers a row become hundreds of windows."""
    return rows.select("id", "duration_ms").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "id")


@query(f"""with {_D}, w as (select id, duration_ms, label, hop, unnest({_STARTS.format(last='duration_ms - 12000', step='hop')}) as start_ms from durations, (values ('mix', 8000), ('instrumental', 16000), ('mix', 24000)) v(label, hop) where duration_ms < 1500000),
s as (select id, label, start_ms, least(duration_ms, start_ms + 12000) as end_ms, (start_ms // 1000 * 7919 % 1000)::bigint as score from w),
o as (select distinct * from s) select id, label, start_ms, end_ms, row_number() over (partition by id order by score desc, start_ms, label, end_ms)::int as place from o qualify place <= 10""")
def window_dedup_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of three planners over all media but long mixes, distinct, the ten best of each."""
    rows = _dealt(spark, views.durations(spark, sf_dir).where(F.col("duration_ms") < planning.LONG_MS))
    return planning.planned_windows(rows, 12_000, [(8_000, "mix"), (16_000, "instrumental"), (24_000, "mix")], 10, lambda start: start // 1000 * 7919 % 1000)


@query(f"""with {_D}, w as (select id, duration_ms, label, unnest({_STARTS.format(last='duration_ms - 12000', step='hop')}) as start_ms from durations, (values ('mix', 60000), ('instrumental', 90000)) v(label, hop)),
o as (select distinct id, label, start_ms, least(duration_ms, start_ms + 12000) as end_ms from w) select id, label, start_ms, end_ms, row_number() over (partition by id order by start_ms, label, end_ms)::int as place from o qualify place <= 5""")
def window_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of two planners, in order of time, the first five of each medium."""
    return planning.planned_windows(_dealt(spark, views.durations(spark, sf_dir)), 12_000, [(60_000, "mix"), (90_000, "instrumental")], 5)


@query(f"""with {views.HITS}, t as (select item, seq, start_ms, case when key = 'error' then 'speech_only' else 'music_unresolved' end as kind from hits)
select item, seq from t qualify row_number() over (partition by item order by kind != 'music_unresolved', start_ms, seq) <= 60""")
def segment_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.hits(spark, sf_dir).withColumn("kind", F.when(F.col("key") == "error", "speech_only").otherwise("music_unresolved"))
    return planning.prioritized(rows, 60).select("item", "seq")


@query(f"""with {_D}, p as (select id, duration_ms / 1000.0 as s, ['max_recall', 'balanced', 'fast_first'][n_chapters % 3 + 1] as recall from durations),
t as (select *, case when s <= 45 then 1 when s <= 180 then 2 when s <= 1200 then 3 else 4 end as k from p)
select id, case when k = 4 then case recall when 'max_recall' then 1.0 when 'balanced' then 2.0 else 3.0 end when recall = 'max_recall' then [0.5, 0.75, 1.0][k] else [0.75, 1.0, 1.5][k] end::double as hop_seconds,
  case when k = 4 then case recall when 'max_recall' then 600 else 900 end else [90, 180, 300][k] end as chunk_seconds, [4.0, 5.0, 6.0, 8.0][k]::double as context_seconds, [4000, 6000, 8000, 20000][k] as min_segment_ms,
  [45000, 60000, 180000, 360000][k] as max_segment_ms, [68.0, 74.0, 78.0, 82.0][k]::double as novelty_percentile from t""")
def analysis_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    recalls = F.array(*map(F.lit, ("max_recall", "balanced", "fast_first")))
    rows = views.durations(spark, sf_dir).withColumn("recall", F.element_at(recalls, F.col("n_chapters") % 3 + 1))
    return planning.analysis_parameters(rows).drop("duration_ms", "n_chapters", "playlist", "recording", "recall")
