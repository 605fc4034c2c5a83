"""Queries over recognizers, the assembly of segments, and stored files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spindrift.operators import assembly as A
from spindrift.operators import budget
from spindrift.operators import ledger as L
from spindrift.operators import providers as P
from spindrift.operators import storage as S
from spindrift.plans import views
from spindrift.plans.registry import query
from spindrift.plans.timeline_queries import _SCORED, _TIMELINE, _scored, _timeline

_H = views.HITS


def _every(n: int, column: str = "seq"):
    return F.col(column) % n == 0


@query("""with f as (select n_nationkey as id, ['local_catalog', 'vibra', 'audd', 'acrcloud', 'other'][n_nationkey % 5 + 1] as name, n_nationkey as k from nation),
b as (select *, k % 2 = 0 as token, k % 2 = 0 and k % 3 != 0 as keys, k % 3 != 0 as program from f)
select id, name, case name when 'local_catalog' then true when 'vibra' then false when 'audd' then true when 'acrcloud' then keys else false end as enabled,
  case name when 'local_catalog' then program and k % 7 > 0 when 'vibra' then program when 'audd' then token when 'acrcloud' then keys else false end as available,
  case when name in ('local_catalog', 'vibra') then case when program then null else 'Missing program: ' || name end when name = 'audd' and not token then 'Set provider config with api_token' when name = 'acrcloud' and not keys then 'Set host, access_key, access_secret' end as reason,
  case name when 'local_catalog' then 'track_count=' || k % 7 when 'vibra' then 'model=b' when 'audd' then 'configured=maybe,zone=eu' when 'acrcloud' then 'configured=' || keys || ',host=' || case when k % 2 = 0 then 'h' else '' end else '' end as config,
  case name when 'local_catalog' then 0 when 'vibra' then 1 when 'audd' then 2 when 'acrcloud' then 3 else 999 end::int as rank from b""")
def provider_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States of recognizers on 25 machines, with saved settings laid over them."""
    k, text = F.col("n_nationkey"), "map<string,string>"
    given = F.map_filter(F.create_map(F.lit("api_token"), F.when(k % 2 == 0, "t"), F.lit("host"), F.when(k % 2 == 0, "h"), F.lit("access_key"), F.lit("a"), F.lit("access_secret"), F.when(k % 3 != 0, "s")), lambda _, v: v.isNotNull())
    names = F.array(*map(F.lit, (*P.ORDER, "other")))
    facts = views.table(spark, sf_dir, "nation").select(k.alias("id"), F.element_at(names, k % 5 + 1).alias("name"), (k % 3 != 0).alias("program"), (k % 7).alias("n_tracks"), given.alias("config"))
    saved = spark.createDataFrame([("vibra", False, {"model": "b"}), ("audd", True, {"configured": "maybe", "zone": "eu"})], f"name string, enabled boolean, config {text}")
    shown = F.array_join(F.transform(F.array_sort(F.map_entries("config")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return P.with_settings(P.states(facts), saved).withColumn("config", shown)


@query(f"with {_H} select provider as name, count(*) as n, provider in ('audd', 'acrcloud') as paid from hits where provider != 'vibra' group by 1")
def active_providers(spark: SparkSession, sf_dir: str) -> DataFrame:
    saved = spark.createDataFrame([("vibra", False), ("audd", True)], "name string, enabled boolean")
    rows = P.active(views.hits(spark, sf_dir).withColumnRenamed("provider", "name"), saved)
    return rows.groupBy("name").agg(F.count("*").alias("n")).withColumn("paid", P.is_paid(F.col("name")))


@query(f"""with {_H}, p as (select *, item || '-' || start_ms // 600000 as cache_key from hits),
c as (select cache_key, provider, max_by(case seq % 3 when 0 then 0 else seq % 3 end, seq) as n from p where seq % 4 = 0 group by 1, 2)
select p.seq, case when c.n > 0 then 'cache_hit_matched' when c.n = 0 then 'cache_hit_empty' when seq % 17 = 0 then 'budget_exhausted' when seq % 5 = 0 then 'provider_error' when seq % 7 = 0 then 'provider_exception'
  when seq % 2 = 1 then 'provider_call_matched' else 'provider_call_empty' end as outcome from p left join c on c.cache_key = p.cache_key and c.provider = p.provider""")
def cached_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probes against kept answers, and what comes of asking where none is kept."""
    probes = views.hits(spark, sf_dir).withColumn("cache_key", F.concat_ws("-", "item", F.expr("start_ms div 600000")))
    answers = F.element_at(F.array(F.lit("[]"), F.lit('[{"a":1}]'), F.lit('[{"a":1},{"b":2}]')), (F.col("seq") % 3 + 1).cast("int"))
    cache = probes.where(_every(4)).select("cache_key", "provider", answers.alias("candidates"), F.col("seq").alias("created_at"))
    found = P.cached_answers(probes, cache)
    outcome = P.called_outcome(F.col("cache_hit"), F.coalesce("n_hits", (F.col("seq") % 2).cast("int")), _every(17), _every(5), _every(7))
    return found.select("seq", outcome.alias("outcome"))


@query("""with p as (select vec_id as id, list_transform(embedding, lambda x: floor(x::double * 1000)::int) as fp from embeddings)
select id, sha1('{"duration":' || id % 90 || '.5,"fingerprint":[' || array_to_string(fp[1:120], ',') || ']}') as cache_key, sha1('/media/' || id || ':0:' || id * 10 || ':probe') || '.wav' as excerpt from p""")
def fingerprint_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: F.floor(x.cast("double") * 1000).cast("int")).alias("fp"))
    key = P.fingerprint_key(F.concat((F.col("id") % 90).cast("string"), F.lit(".5")), F.col("fp"))
    return rows.select("id", key.alias("cache_key"), P.excerpt_name(F.concat(F.lit("/media/"), "id"), F.lit(0), F.col("id") * 10, F.lit("probe")).alias("excerpt"))


@query(f"with {_H} select ['prefer_free_skip', 'provider_unavailable', 'budget_exhausted'][(seq % 3 + 1)::int] as outcome, count(*) as n, count(*) as n_valid, count(*) filter (seq % 3 = 2) as n_exhausted from hits group by 1")
def decision_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ledger rows of turns not taken; every one is valid, and they read back as what they are."""
    outcomes = F.array(*map(F.lit, ("prefer_free_skip", "provider_unavailable", "budget_exhausted")))
    turns = views.hits(spark, sf_dir).select(
        F.col("seq").alias("id"), F.lit("j").alias("job_id"), F.col("item").cast("string").alias("source_item_id"), F.col("provider").alias("provider_name"), "start_ms", "end_ms",
        F.element_at(outcomes, (F.col("seq") % 3 + 1).cast("int")).alias("outcome"), F.lit("not asked").alias("skip_reason"), F.when(_every(2), 5).alias("remaining"), F.col("seq").alias("created_at"),
    )
    rows = L.lifted(L.validated(P.decision_rows(turns)))
    return rows.groupBy("outcome").agg(F.count("*").alias("n"), F.count_if((F.size("errors") == 0) & (F.col("metric_type") == "provider_decision")).alias("n_valid"), F.count_if("exhausted").alias("n_exhausted"))


@query(f"""with {_H}, t as (select *, start_ms // 600000 as draft, row_number() over (partition by item, start_ms // 600000 order by seq) as place, case when seq % 3 != 0 then key end as hit from hits),
d as (select * from t where provider not in ('audd', 'acrcloud') and seq % 4 != 0 and hit is not null qualify row_number() over (partition by item, draft order by place) = 1)
select g.item, g.draft, d.hit = 'view' as confirmed from (select distinct item, draft from t) g left join d on d.item = g.item and d.draft = g.draft""")
def repeat_reconfirmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.hits(spark, sf_dir).withColumn("draft", F.expr("start_ms div 600000"))
    place = F.row_number().over(Window.partitionBy("item", "draft").orderBy("seq"))
    hits = rows.select("item", "draft", place.alias("place"), "provider", (~_every(4)).alias("available"), F.when(~_every(3), F.col("key")).alias("key"), F.lit("view").alias("reused_key"))
    return P.reconfirmed(hits, ["item", "draft"])


@query(f"""with recursive {_H}, t as (select item, seq, case when seq % 9 = 0 then 0 else end_ms % 7 end as cost, case when seq % 9 = 0 then seq % 3 else 0 end as refund,
  row_number() over (partition by item order by seq) as n from hits),
walk(item, seq, n, before, remaining, consumed, allowed) as (
  select item, null::bigint, 0::bigint, 0::bigint, 20::bigint, 0::bigint, false from hits group by 1
  union all select w.item, t.seq, t.n, w.remaining, case when t.refund > 0 then least(20, w.remaining + t.refund) when t.cost > 0 and w.remaining >= t.cost then w.remaining - t.cost else w.remaining end,
    case when t.refund = 0 and t.cost > 0 and w.remaining >= t.cost then t.cost else 0 end, t.refund > 0 or (case when t.cost > 0 then w.remaining >= t.cost else w.remaining > 0 end) from walk w join t on t.item = w.item and t.n = w.n + 1)
select item, seq, before, remaining, consumed, allowed from walk where n > 0""")
def budget_spending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A budget of twenty an item: turns of several costs, questions, refusals and refunds."""
    back = _every(9)
    rows = views.hits(spark, sf_dir).select("item", "seq", F.when(back, 0).otherwise(F.col("end_ms") % 7).alias("cost"), F.when(back, F.col("seq") % 3).otherwise(0).alias("refund"))
    return budget.spending(rows, F.lit(20), ["item"], ["seq"], refund="refund").drop("cost", "refund")


@query(f"with {_H} select seq, case when (seq % 7 = 0 and seq % 5 != 0) or seq % 3 = 0 then 0 else 1 end as cost from hits")
def probe_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each probe costs in the end: kept answers and failed excerpts are given back."""
    return views.hits(spark, sf_dir).select("seq", P.net_cost(_every(5), _every(7), _every(3)).alias("cost"))


@query(f"""{"with " + _SCORED}, r as (select *, round(score, 9) as s, seq % 4 = 0 as gated, seq % 5 = 0 as reused, (seq % 10) / 10.0::double as speech, (seq % 4) / 10.0::double as music from scored),
t as (select *, gated or reused or s >= 0.60::double as taken from r)
select seq, case when taken then 'matched_track' when speech >= 0.70::double and music < 0.35::double then 'speech_only' else 'music_unresolved' end as kind, case when taken then key end as key, case when taken then provider end as provider,
  round(case when not taken then 0 when reused then least(0.95::double, confidence + 0.03::double) else confidence end, 6) as confidence, round(case when taken then greatest(0, 1 - s) else 1 end, 6) as uncertainty,
  case when taken then greatest(1, n_evidence) else 0 end::bigint as evidence_count, case when taken then case when gated then 'G3' when reused then 'REUSED' end end as acceptance_gate from t""")
def accepted_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every hit as a draft with its best candidate, tried again: accepted by a gate, for a repeat, or by its score."""
    ten = lambda n: (F.col("seq") % n) / F.lit(10.0)
    rows = _scored(spark, sf_dir).select("seq", "key", "provider", "confidence", F.round("score", 9).alias("score"), "n_evidence", F.when(_every(4), "G3").alias("gate"), _every(5).alias("reused"), ten(10).alias("speech_ratio"), ten(4).alias("music_ratio"))
    return A.accepted(rows, retried=True).withColumns({"confidence": F.round("confidence", 6), "uncertainty": F.round("uncertainty", 6)})


@query(f"""with {_H}, d as (select item, seq, case when seq % 4 != 0 then provider end as g, case when seq % 3 = 0 then key end as k from hits),
f as (select *, case when g is not null then first_value(k ignore nulls) over (partition by item, g order by seq rows between unbounded preceding and 1 preceding) end as known from d)
select seq, coalesce(known, k) as first_key, known is not null as reused from f""")
def group_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drafts that take over the first match of their repeat group."""
    drafts = views.hits(spark, sf_dir).select("item", "seq", F.when(~_every(4), F.col("provider")).alias("repeat_group"), F.when(_every(3), F.col("key")).alias("key"))
    return A.with_group_match(drafts).select("seq", "first_key", "reused")


@query(f"with {_H}, f as (select item, start_ms // 60000 as m, min(seq % 5) as chunk from hits group by 1, 2) select chunk, count(*) as n from f group by 1")
def unseen_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = views.hits(spark, sf_dir).select("item", (F.col("seq") % 5).alias("chunk"), F.expr("start_ms div 60000").alias("start_ms"))
    return A.without_seen_frames(frames).groupBy("chunk").agg(F.count("*").alias("n"))


@query(f"with {_TIMELINE} select kind, seq % 5 = 0 or seq % 3 = 0 or seq % 11 = 0 as did_work, count(*) as n from timeline group by 1, 2")
def retry_work(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = _timeline(spark, sf_dir).select("seq", "kind", "key", F.col("n_evidence").alias("probe_count"), F.lit(1).alias("provider_attempts"))
    after = before.withColumns({"probe_count": F.col("probe_count") + _every(5).cast("int"), "provider_attempts": F.col("provider_attempts") + _every(3).cast("int"), "key": F.when(~_every(11), F.col("key"))})
    return A.retry_did_work(before, after, ["seq"]).join(before.select("seq", "kind"), "seq").groupBy("kind", "did_work").agg(F.count("*").alias("n"))


@query(f"""with {views.TRACKS}, i as (select id, trim(title) as title, case when id % 3 != 0 then trim(artist) end as artist, case when id % 5 != 0 then id * 1000 else 0 end as duration_ms, id % 4 = 0 as listed, id % 8 = 0 as named from tracks where id % 2 = 0)
select id as source_item_id, case when duration_ms = 0 then 30000 else duration_ms end as end_ms, title, artist, 0.52::double as confidence, case when named then 'List' else '' end as hints from i where artist is not null or listed""")
def metadata_only_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = "id"
    items = views.tracks(spark, sf_dir).select(
        i, _every(2, i).alias("metadata_only"), "title", F.when(~_every(3, i), F.col("artist")).alias("artist"), F.lit(" ").alias("album"), F.when(_every(5, i), 0).otherwise(F.col(i) * 1000).alias("duration_ms"),
        F.when(_every(4, i), "pl").alias("playlist_id"), F.when(_every(8, i), "List").alias("playlist_title"),
    )
    return A.metadata_segments(items).select("source_item_id", "end_ms", "title", "artist", "confidence", F.array_join("metadata_hints", ",").alias("hints"))


@query("""select page_id as id, case when page_id % 2 = 0 then 'yt_dlp' else 'local_file' end as kind, 'failed' as status, case when page_id % 2 = 0 then url when page_id % 3 = 0 then '/' else 'clip' || page_id || '.wav' end as title, 'no such input' as error from pages""")
def failed_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("page_id")
    value = F.when(p % 2 == 0, F.col("url")).when(p % 3 == 0, "/").otherwise(F.concat(F.lit("/in/clip"), p, F.lit(".wav")))
    inputs = views.table(spark, sf_dir, "pages").select(p.alias("id"), F.lit("j").alias("job_id"), value.alias("input_value"), F.lit("no such input").alias("error"))
    return A.failed_items(inputs).select("id", "kind", "status", "title", "error")


@query(f"with {_H} select item, seq, row_number() over (partition by item order by seq)::int as done, count(*) over (partition by item) as total from hits qualify done % 12 = 0")
def progress_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.progress_marks(views.hits(spark, sf_dir).select("item", "seq"))


@query(f"""with {_TIMELINE}, l as (select case kind when 'matched_track' then 'Song' when 'speech_only' then 'Speech' else 'Music' end as label, case when confidence >= 0.85::double then 'High' when confidence >= 0.65::double then 'Good' else 'Low' end as quality,
  kind = 'speech_only' and seq % 5 = 0 as skipped, provider in ('local_catalog', 'vibra') and confidence >= 0.80::double as strong_free from timeline) select *, count(*) as n from l group by all""")
def segment_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    skipped = A.skips_probing(F.col("kind"), F.when(_every(5), 0.1).otherwise(0.2))
    strong = A.strong_free_hit(F.array(F.struct("provider", "confidence")))
    return _timeline(spark, sf_dir).groupBy(A.kind_label(F.col("kind")).alias("label"), A.quality_band(F.col("confidence")).alias("quality"), skipped.alias("skipped"), strong.alias("strong_free")).agg(F.count("*").alias("n"))


@query(f"with {views.JOBS} select count(*) as jobs, count(*) filter (status in ('queued', 'running')) as active, count(*) filter (status = 'running') as running from jobs")
def job_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.job_context(views.jobs(spark, sf_dir))


def _stored(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Items of every part, and the files that some of them have left."""
    k = F.col("p_partkey")
    at = lambda text: F.concat(F.lit(text), k)
    work = F.concat(F.lit("/cache/normalized/"), k % 50, F.lit("/i"), k)
    rows = views.table(spark, sf_dir, "part")
    items = rows.select(
        at("i").alias("id"), (k % 50).alias("job_id"), F.when(k % 4 == 0, at("/cache/uploads/u")).when(k % 4 == 1, at("/tmp/recording-mic-")).when(k % 4 == 2, at("https://a.example/")).alias("input_value"),
        F.when(k % 3 == 0, at("/cache/uploads/v")).when(k % 3 == 1, at("/home/me/")).alias("local_path"), F.when(k % 2 == 0, F.concat(work, F.lit("/full.wav"))).alias("normalized_path"), F.lit("x").alias("instrumental_path"),
    )
    file = lambda there, path, size: F.when(there, F.struct(path.alias("path"), size.alias("size_bytes")))
    files = F.array(
        file(k % 5 == 0, F.concat(at("/cache/sources/i"), F.lit("/a.webm")), k), file(k % 8 == 0, at("/cache/uploads/u"), 2 * k), file(k % 12 == 1, at("/tmp/recording-mic-"), 3 * k), file(k % 9 == 0, at("/cache/uploads/v"), 4 * k),
        file(k % 6 == 0, F.concat(work, F.lit("/full.wav")), 5 * k), file(k % 7 == 0, F.concat(work, F.lit("/clips/c.wav")), 6 * k), file(k % 7 == 0, F.concat(work, F.lit("/clips/d/e.wav")), k), file(k % 14 == 0, F.concat(work, F.lit("/segment-clips/c.wav")), 7 * k),
    )
    return items, rows.select(F.inline(F.filter(files, lambda f: f.isNotNull())))


@query("""with p as (select p_partkey as k from part), e as (
  select k, 'download' as category, 'Quellcache' as label, k as bytes from p where k % 5 = 0 union all select k, 'upload', 'Hochgeladene Datei', 2 * k from p where k % 8 = 0 union all select k, 'recording', 'Temporäre Aufnahme', 3 * k from p where k % 12 = 1
  union all select k, 'upload', 'Hochgeladene Datei', 4 * k from p where k % 9 = 0 union all select k, 'normalized', 'Normalisierte Audiodatei', 5 * k from p where k % 6 = 0 union all select k, 'excerpt', 'Probe-Clips', 7 * k from p where k % 7 = 0
  union all select k, 'excerpt', 'Segment-Probes', 7 * k from p where k % 14 = 0)
select category, label, count(*) as n, sum(bytes)::bigint as bytes, min(k % 50 || ':' || category || ':') as first_id from e group by 1, 2""")
def item_storage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of the typed paths that are there, with their sizes."""
    items, files = _stored(spark, sf_dir)
    found = S.entries(S.item_paths(items, "/cache/"), files)
    return found.groupBy("category", "label").agg(F.count("*").alias("n"), F.sum("size_bytes").alias("bytes"), F.min(F.regexp_extract("id", "^[^:]*:[^:]*:", 0)).alias("first_id"))


@query("select p_partkey % 3 = 1 as local_stays, p_partkey % 4 = 1 as recording, count(*) as n from part group by 1, 2")
def cleared_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    items, _ = _stored(spark, sf_dir)
    recording = S.is_recording_source(F.col("input_value"), F.col("local_path"))
    return S.without_references(items, "/cache").groupBy(F.col("local_path").isNotNull().alias("local_stays"), recording.alias("recording")).agg(F.count("*").alias("n"))


@query(f"""with {views.JOBS}, {views.ARTIFACTS}, k as (select id, pinned from jobs where id % 7 != 0)
select case when not temporary or coalesce(k.pinned, false) then 'kept' when k.id is null then 'orphan' else 'deleted' end as action, count(*) as n from artifacts a left join k on k.id = a.job_id group by 1""")
def cleanup_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = views.jobs(spark, sf_dir).where("id % 7 != 0")
    return S.cleaned(views.artifacts(spark, sf_dir), jobs).groupBy("action").agg(F.count("*").alias("n"))
