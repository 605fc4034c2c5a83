"""Queries over tracks, hits and timelines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.functions import identity as I
from spindrift.operators import evaluation, export, scoring, timeline
from spindrift.plans import views
from spindrift.plans.registry import query

_TITLE = r"""regexp_replace(lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace(title, '\s*[\(\[]?\s*\b(feat(\.|uring)?|ft\.?)\b.*?([\)\]]|$)', '', 'gi'),
  '\s*[\(\[][^)\]]*\b(remaster(ed)?|remix|edit|radio\s+edit|extended|bonus\s+track|live|explicit|clean|version|acoustic|mono|stereo|deluxe|re[\- ]?record(ed)?)\b[^)\]]*[\)\]]', '', 'gi'),
  '\s-\s.*\b(remaster(ed)?|edit|version|mix|acoustic|re[\- ]?record(ed)?)\b.*$', '', 'i'), '^the\s+', '', 'i')), '[^a-z0-9]+', '', 'g')"""
_ARTISTS = r"""array_to_string(list_sort(list_distinct(list_filter(list_transform(regexp_split_to_array(lower(artist), '\s*(,|&|\band\b|/|\+|;|\bx\b)\s*'),
  lambda x: regexp_replace(regexp_replace(trim(x), '^the\s+', ''), '[^a-z0-9]+', '', 'g')), lambda x: x != ''))), ';')"""
_KEYS = f"""{views.TRACKS},
keys as (select id, coalesce('isrc::' || upper(nullif(trim(isrc), '')), 'acr::' || lower(acr), 'shz::' || lower(shz), 'fuzzy::' || {_ARTISTS} || '::' || {_TITLE}) as identity_key from tracks)"""


def _keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = I.identity_key(F.col("artist"), F.col("title"), F.col("isrc"), F.col("provider_ids"))
    return views.tracks(spark, sf_dir).select("id", key.alias("identity_key"))


@query(f"with {_KEYS} select * from keys")
def identity_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _keys(spark, sf_dir)


@query(f"""with {views.TRACKS} select case when trim(coalesce(isrc, '')) != '' then 'isrc' when trim(coalesce(acr, shz, '')) != '' then 'provider_id' else 'fuzzy' end as tier, count(*) as n from tracks group by 1""")
def identity_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _keys(spark, sf_dir).groupBy(I.tier(F.col("identity_key")).alias("tier")).agg(F.count("*").alias("n"))


@query(f"with {_KEYS} select identity_key, count(*) as n, min(id) as first_id from keys group by 1 having count(*) > 1")
def identity_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracks that are one: equal keys."""
    return _keys(spark, sf_dir).groupBy("identity_key").agg(F.count("*").alias("n"), F.min("id").alias("first_id")).where("n > 1")


_ISLANDS = f"""{views.HITS},
islands as (select *, sum(opens) over (partition by item, key order by start_ms, seq)::bigint as island from (
  select *, case when lag(end_ms) over w is null or start_ms > lag(end_ms) over w + 2000 then 1 else 0 end as opens from hits window w as (partition by item, key order by start_ms, seq)))"""
_FUSED = f"""{_ISLANDS},
fused as (select item, key, island, min(start_ms) as start_ms, max(end_ms) as end_ms, least(1.0::double, avg(confidence) + 0.05::double * (count(distinct provider) - 1)) as confidence,
    array_to_string(list_sort(list(distinct provider)), ',') as providers, sum(greatest(1, n_evidence))::bigint as evidence_count, count(*) as probe_count, max_by(seq, confidence * 1e9 - seq) as primary_seq
  from islands group by 1, 2, 3)"""


@query(f"with {_ISLANDS} select item, key, seq, island from islands")
def fused_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.islands(views.hits(spark, sf_dir)).select("item", "key", "seq", "island")


@query(f"with {_FUSED} select * exclude (confidence), round(confidence, 6) as confidence from fused")
def fused_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = timeline.fused(views.hits(spark, sf_dir)).withColumn("providers", F.array_join("providers", ",")).withColumn("confidence", F.round("confidence", 6))
    return found.drop("uncertainty", "acceptance_gate")


@query(f"""with {views.HITS}, best as (select item, key, max(confidence * 1e9 - seq) as b from hits group by 1, 2), placed as (select *, row_number() over (partition by item order by b desc) as place from best)
select item, string_agg(key, ',' order by place) as alternates from placed where place between 2 and 6 group by 1""")
def fused_alternates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.alternates(views.hits(spark, sf_dir), ["item"]).select("item", F.array_join("alternates", ",").alias("alternates"))


_SCORED = f"""{views.HITS},
scored as (select *, least(1.0::double, confidence * case provider when 'local_catalog' then 0.93::double when 'acrcloud' then 0.90::double when 'audd' then 0.87::double when 'vibra' then 0.82::double else 0.80::double end
    + case when seq % 3 = 0 then 0.05::double else 0 end + case when seq % 5 = 0 then 0.04::double else 0 end + least(0.08::double, 0.02::double * n_evidence)) as score, start_ms // 600000 as draft from hits)"""


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = views.hits(spark, sf_dir)
    score = scoring.score(F.col("confidence"), F.col("provider"), F.col("seq") % 3 == 0, F.col("seq") % 5 == 0, F.col("n_evidence"))
    return hits.withColumns({"score": score, "draft": F.expr("start_ms div 600000")})


@query(f"with {_SCORED} select seq, round(score, 6) as score from scored")
def candidate_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).select("seq", F.round("score", 6).alias("score"))


_BEST = f"""{_SCORED},
by_key as (select item, draft, key, sum(score) as total, count(*) as n_hits, count(distinct provider) as n_providers, min(seq) as first_seq, max(score) as best from scored group by 1, 2, 3),
top as (select * from by_key qualify row_number() over (partition by item, draft order by round(total, 9) desc, first_seq) = 1)"""


@query(f"with {_BEST} select item, draft, key, round(total, 6) as total, n_hits, n_providers, round(best, 6) as best from top")
def best_candidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = _scored(spark, sf_dir).withColumn("score", F.round("score", 9))
    best = scoring.best_candidates(scored, ["item", "draft"])
    return best.select("item", "draft", "key", F.round("total", 6).alias("total"), "n_hits", "n_providers", F.round("best.score", 6).alias("best"))


_GATE = """case when n_providers >= 2 then 'G1' when n_hits >= 2 then 'G2' when best >= 0.72 then 'G3' when best >= 0.60 and draft % 2 = 0 then 'G4' when key = 'signup' and best >= 0.55 then 'G5' end"""


def _gated(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = scoring.best_candidates(_scored(spark, sf_dir).withColumn("score", F.round("score", 9)), ["item", "draft"])
    ratio = F.when(F.col("draft") % 2 == 0, 0.5).otherwise(0.2)
    return best.withColumn("acceptance_gate", scoring.gate(F.col("n_providers"), F.col("n_hits"), F.col("best.score"), ratio, F.col("key") == "signup"))


@query(f"with {_BEST} select coalesce({_GATE}, 'rejected') as gate, count(*) as n from top group by 1")
def acceptance_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _gated(spark, sf_dir).groupBy(F.coalesce("acceptance_gate", F.lit("rejected")).alias("gate")).agg(F.count("*").alias("n"))


@query(f"""with {_BEST}, g as (select *, {_GATE} as gate from top) select item, count(gate) as matched_segments, count(*) - count(gate) as unresolved_segments,
  {", ".join(f"count(*) filter (gate = 'G{k}') as gate_g{k}_hits" for k in range(1, 6))} from g group by 1""")
def ledger_gate_tallies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.item_summary(_gated(spark, sf_dir))


@query(f"""with {views.HITS}, c as (select item, start_ms // 3600000 as hour, key, count(*) as n, max(confidence) as confidence, min(seq) as first_seq from hits group by 1, 2, 3)
select item, hour, key, n, round(confidence, 6) as confidence, n >= 2 or confidence >= 0.92 as stop from c qualify row_number() over (partition by item, hour order by n desc, first_seq) = 1""")
def consensus_stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = views.hits(spark, sf_dir).withColumn("hour", F.expr("start_ms div 3600000"))
    return scoring.consensus(hits, ["item", "hour"]).withColumn("confidence", F.round("confidence", 6))


@query(f"""with {views.HITS}, t as (select *, row_number() over (partition by item, start_ms // 60000 order by seq) as place, start_ms // 60000 as w from hits),
f as (select *, provider in ('audd', 'acrcloud') as paid, seq % 4 != 0 as available, seq % 3 = 0 as cached, seq % 2 = 0 as matched, seq % 29 = 0 as failed from t),
s as (select *, paid and not cached and coalesce(max(case when matched and not paid and confidence >= 0.80 and available then 1 else 0 end) over (partition by item, w order by place rows between unbounded preceding and 1 preceding), 0) = 1 as skipped from f),
a as (select *, case when available and not cached and not skipped then 1 else 0 end as asks from s), b as (select *, sum(asks) over (partition by item order by w, place) as spent from a)
select seq, case when cached then case when matched then 'cache_hit_matched' else 'cache_hit_empty' end when not available then 'provider_unavailable' when skipped then 'prefer_free_skip'
  when spent > 20 then 'budget_exhausted' when failed then 'provider_error' when matched then 'provider_call_matched' else 'provider_call_empty' end as outcome from b""")
def provider_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of providers minute by minute, with a budget of twenty calls an item."""
    from pyspark.sql import Window

    hits = views.hits(spark, sf_dir).withColumn("window", F.expr("start_ms div 60000"))
    place = F.row_number().over(Window.partitionBy("item", "window").orderBy("seq"))
    turns = hits.select("item", "window", "seq", place.alias("place"), "provider", (F.col("seq") % 4 != 0).alias("available"), (F.col("seq") % 3 == 0).alias("cached"), (F.col("seq") % 2 == 0).alias("matched"), "confidence", (F.col("seq") % 29 == 0).alias("failed"))
    return scoring.provider_walk(turns, budget=20).select("seq", "outcome")


@query(f"""with {_FUSED}, a as (select item, start_ms, end_ms, 1 + seq % 3 as calls from hits where seq % 2 = 0)
select f.item, f.primary_seq as seq, coalesce((select sum(calls) from a where a.item = f.item and a.start_ms < f.end_ms and a.end_ms > f.start_ms), 0)::bigint as provider_attempts from fused f""")
def attempt_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls that overlap each fused segment."""
    hits = views.hits(spark, sf_dir)
    segments = timeline.fused(hits).select("item", F.col("primary_seq").alias("seq"), "start_ms", "end_ms")
    attempts = hits.where("seq % 2 = 0").select("item", "start_ms", "end_ms", (1 + F.col("seq") % 3).alias("calls"))
    return timeline.with_attempts(segments, attempts).select("item", "seq", "provider_attempts")


@query(f"""with {views.HITS}, h as (select seq, start_ms, end_ms, seq % 40 as c from hits), ch as (select c, c * 60000 * 1000 as s, case when c % 4 != 0 then (c + 1) * 60000 * 1000 end as e from (select unnest(range(40)) as c))
select h.seq, h.c from h join ch on ch.c = h.c where ch.s <= h.end_ms and (ch.e is null or ch.e >= h.start_ms)""")
def chapter_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits that touch the chapter they are listed under; a chapter without an end never closes."""
    chapters = spark.range(40).select(F.col("id").alias("c"), (F.col("id") * 60_000_000).alias("s"), F.when(F.col("id") % 4 != 0, (F.col("id") + 1) * 60_000_000).alias("e"))
    hits = views.hits(spark, sf_dir).withColumn("c", F.col("seq") % 40)
    return hits.join(chapters, "c").where((F.col("s") <= F.col("end_ms")) & (F.col("e").isNull() | (F.col("e") >= F.col("start_ms")))).select("seq", "c")


def _timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits as a timeline: some are matched, some speech, some unresolved."""
    kind = F.when(F.col("key").isin("view", "click"), "matched_track").when(F.col("key") == "error", "speech_only").otherwise("music_unresolved")
    return views.hits(spark, sf_dir).withColumn("kind", kind)


_TIMELINE = f"{views.HITS}, timeline as (select *, case when key in ('view', 'click') then 'matched_track' when key = 'error' then 'speech_only' else 'music_unresolved' end as kind from hits)"


@query(f"""with {_TIMELINE}, n as (select *, lead(start_ms) over (partition by item order by start_ms, end_ms, kind, seq) as nxt from timeline),
c as (select item, seq, start_ms, case when end_ms > nxt then greatest(start_ms, nxt) else end_ms end as end_ms from n) select * from c where end_ms > start_ms""")
def clamped_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.clamped(_timeline(spark, sf_dir)).select("item", "seq", "start_ms", "end_ms")


@query(f"with {_TIMELINE} select item, kind, count(*) as n from timeline where item % 7 = 0 and key != 'view' and key != 'click' group by 1, 2 union all select item, kind, count(*) from timeline where item % 7 != 0 and kind = 'matched_track' group by 1, 2")
def only_songs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _timeline(spark, sf_dir).where((F.col("item") % 7 != 0) | ~F.col("key").isin("view", "click"))
    return timeline.only_songs(rows).groupBy("item", "kind").agg(F.count("*").alias("n"))


@query(f"""with {_TIMELINE}, t as (select *, greatest(1, max(end_ms) over (partition by item)) as total from timeline),
r as (select *, floor(start_ms / total * 80)::int as a, greatest(floor(start_ms / total * 80)::int + 1, floor(end_ms / total * 80)::int) as b, case kind when 'matched_track' then 'M' when 'music_unresolved' then 'u' else 's' end as fill from t),
x as (select item, unnest(range(a, b)) as cell, fill, start_ms, end_ms, kind, seq from r), y as (select item, cell, fill from x where cell < 80 qualify row_number() over (partition by item, cell order by start_ms desc, end_ms desc, kind desc, seq desc) = 1)
select item, (select string_agg(coalesce(y.fill, '.'), '' order by g.c) from (select unnest(range(80)) as c) g left join y on y.item = i.item and y.cell = g.c) as bar from (select distinct item from timeline) i""")
def timeline_bar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.timeline_bar(_timeline(spark, sf_dir))


@query()
def stitched_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fused segments stitched; an ordered fold, tested against given timelines."""
    kind = F.when(F.col("key").isin("view", "click", "purchase"), "matched_track").when(F.col("key") == "error", "speech_only").otherwise("music_unresolved")
    fused = timeline.fused(views.hits(spark, sf_dir)).withColumn("kind", kind)
    rows = fused.select("item", F.col("primary_seq").alias("seq"), "start_ms", "end_ms", "kind", F.when(F.col("kind") == "matched_track", F.col("key")).alias("key"), "confidence", "providers", "evidence_count")
    return timeline.stitched(rows).withColumn("providers", F.array_join("providers", ",")).withColumn("confidence", F.round("confidence", 6))


@query(f"""with {_FUSED}, c as (select *, primary_seq % 10 = 0 as fixed from fused)
select item::varchar || '/' || key as item, start_ms, end_ms, case when fixed then 'matched_track' else 'music_unresolved' end as kind, case when fixed then 'manual ' || key else key end as key, round(case when fixed then greatest(0.99::double, confidence) else confidence end, 6) as confidence,
  case when fixed then key else '' end as alternates, 'hint' || case when fixed then ',manual:manual ' || key else '' end as hints, case when fixed then 'Manually corrected by the user.,' else '' end || 'fused' as explanation from c""")
def corrected_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments whose primary hit has an id divisible by ten, corrected by hand, with hints and explanations."""
    fused = timeline.fused(views.hits(spark, sf_dir))
    texts = lambda *x: F.array(*map(F.lit, x)).cast("array<string>")
    segments = fused.select(
        F.concat_ws("/", "item", "key").alias("item"), "start_ms", "end_ms", "key", "confidence", F.col("uncertainty").cast("double").alias("uncertainty"), F.lit("music_unresolved").alias("kind"), texts().alias("alternates"), texts("hint").alias("metadata_hints"), texts("fused").alias("explanation"), "primary_seq",
    )
    corrections = segments.where("primary_seq % 10 = 0").select("item", "start_ms", "end_ms", F.concat(F.lit(" manual "), F.col("key"), F.lit(" ")).alias("new_key"))
    rows = timeline.corrected(segments.drop("primary_seq"), corrections, strict=True)
    listed = [F.array_join(c, ",").alias(a) for c, a in (("alternates", "alternates"), ("metadata_hints", "hints"), ("explanation", "explanation"))]
    return rows.select("item", "start_ms", "end_ms", "kind", "key", F.round("confidence", 6).alias("confidence"), *listed)


_EXPORTED = f"""{_TIMELINE}, named as (select *, case when kind = 'matched_track' then key || ' song' end as title, case when kind = 'matched_track' and seq % 3 != 0 then 'Artist ' || seq % 9 end as artist from timeline)"""


def _named(spark: SparkSession, sf_dir: str) -> DataFrame:
    matched = F.col("kind") == "matched_track"
    return _timeline(spark, sf_dir).withColumns({"title": F.when(matched, F.concat("key", F.lit(" song"))), "artist": F.when(matched & (F.col("seq") % 3 != 0), F.concat(F.lit("Artist "), F.col("seq") % 9))})


@query(f"""with {_EXPORTED} select 'item-' || item as source_item_id, start_ms, end_ms, kind, coalesce(title, '') as title, coalesce(artist, '') as artist, provider || ', extra' as providers, 'a | b' as metadata_hints, case when seq % 2 = 0 then 'rg' || seq % 5 else '' end as repeat_group_id from named""")
def export_csv_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns of the CSV export but for the formatted confidences."""
    rows = _named(spark, sf_dir).select(
        F.concat(F.lit("item-"), "item").alias("source_item_id"), "start_ms", "end_ms", "kind", "confidence", F.lit(None).cast("double").alias("uncertainty"), "title", "artist", F.lit(None).cast("string").alias("album"),
        F.array("provider", F.lit("extra")).alias("providers"), F.when(F.col("seq") % 2 == 0, F.concat(F.lit("rg"), F.col("seq") % 5)).alias("repeat_group_id"), F.array(F.lit("a"), F.lit("b")).alias("metadata_hints"), F.array().cast("array<string>").alias("explanation"),
    )
    return export.csv_rows(rows).drop("confidence", "uncertainty", "album", "explanation")


@query(f"""with {_EXPORTED}, s as (select *, start_ms // 1000 as t from named),
l as (select item, start_ms, seq, case when t >= 3600 then lpad((t // 3600)::varchar, greatest(2, length((t // 3600)::varchar))::int, '0') || ':' else '' end || lpad((t % 3600 // 60)::varchar, 2, '0') || ':' || lpad((t % 60)::varchar, 2, '0') || ' ' ||
    case when title is not null then coalesce(artist || ' - ', '') || title when kind = 'music_unresolved' then '[Unresolved music]' else '[Speech only]' end as line from s)
select item, string_agg(line, chr(10) order by start_ms, seq) as chapters from l group by 1""")
def export_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export.chapters(_named(spark, sf_dir))


@query("""with c as (select source, d.doc_id, quality = 1 as e, n_chars > 1500 as a from documents d join labels l on l.doc_id = d.doc_id),
s as (select source, count(*) filter (e) as n_expected, count(*) filter (a) as n_actual, count(*) filter (e and a) as n_hit from c group by 1)
select source, n_expected, n_actual, n_hit, n_hit / greatest(1, n_actual) as precision, n_hit / greatest(1, n_expected) as recall from s where n_expected > 0 or n_actual > 0""")
def eval_precision_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents labelled good against those that are long, by source."""
    rows = views.table(spark, sf_dir, "documents").join(views.table(spark, sf_dir, "labels"), "doc_id").select("source", F.col("doc_id").cast("string").alias("track"), "quality", "n_chars")
    return evaluation.by_case(rows.where("quality = 1"), rows.where("n_chars > 1500"), "source")


@query("""with c as (select source, quality = 1 as e, n_chars > 1500 as a from documents d join labels l on l.doc_id = d.doc_id),
s as (select source, count(*) filter (e) as n_expected, count(*) filter (a) as n_actual, count(*) filter (e and a) as n_hit from c group by 1 having count(*) filter (e or a) > 0)
select count(*) as case_count, round(avg(n_hit / greatest(1, n_actual)), 9) as avg_precision, round(avg(n_hit / greatest(1, n_expected)), 9) as avg_recall from s""")
def eval_macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = evaluation.macro(eval_precision_recall(spark, sf_dir))
    return found.select("case_count", F.round("avg_precision", 9).alias("avg_precision"), F.round("avg_recall", 9).alias("avg_recall"))


@query(f"with {_TIMELINE} select count(*) filter (kind = 'music_unresolved') as retried, count(*) filter (kind = 'music_unresolved' and seq % 3 = 0) as matched, count(*) filter (kind = 'music_unresolved' and seq % 3 != 0) as remaining from timeline")
def retry_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = _timeline(spark, sf_dir).select("seq", "kind")
    after = before.withColumn("kind", F.when((F.col("kind") == "music_unresolved") & (F.col("seq") % 3 == 0), "matched_track").otherwise(F.col("kind")))
    return evaluation.retry_counters(before, after, ["seq"])
