"""Queries over the job store: scans, appends, payloads, and names and playlists with accents and depth."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.functions import identity as I  # noqa: E741
from spindrift.functions import text as T
from spindrift.operators import assembly, ledger, ordering, providers, segmentation, store, timeline
from spindrift.plans import views
from spindrift.plans.ledger_queries import _SEGMENTS, _SUMS
from spindrift.plans.registry import query
from spindrift.plans.timeline_queries import _ARTISTS, _TITLE
from spindrift.sources import inputs, readers

_STAMP = "yyyy-MM-dd HH:mm:ss"


@query(f"with {views.ARTIFACTS} select id, category, label, size_bytes from artifacts where job_id = 7")
def artifact_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.scan(views.artifacts(spark, sf_dir), store.storage_order(), 7).select("id", "category", "label", "size_bytes")


@query(f"with {views.ARTIFACTS} select id, row_number() over (order by coalesce(job_id::varchar, ''), category nulls first, label nulls first, id) as place from artifacts")
def storage_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored files with their place in the order of a storage report."""
    return ordering.placed(views.artifacts(spark, sf_dir), [*store.storage_order(), "id"]).select("id", "place")


@query("select event_id, 'item-' || user_id as source_item_id, event_type as status from events where user_id % 10 = 3")
def discovery_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.table(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 10).alias("job_id"), F.concat(F.lit("item-"), F.col("user_id")).alias("source_item_id"), F.col("event_type").alias("status"))
    return store.discovery_states(rows, 3).drop("job_id")


_CATALOG = f"{views.TRACKS}, catalog as (select id as track_id, case when id % 9 != 0 then artist end as artist, title, '/music/' || id as path from tracks)"


def _catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("id")
    return views.tracks(spark, sf_dir).select(key.alias("track_id"), F.when(key % 9 != 0, F.col("artist")).alias("artist"), "title", F.concat(F.lit("/music/"), key).alias("path"))


@query(f"with {_CATALOG} select track_id, artist, title, row_number() over (order by artist nulls first, title nulls first, path nulls first) as place from catalog")
def catalog_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole catalog with each track's place in its order."""
    return ordering.placed(_catalog(spark, sf_dir), store.catalog_order()).select("track_id", "artist", "title", "place")


@query(f"with {_CATALOG} select * from catalog where track_id in (select l_partkey from lineitem where l_quantity > 45)")
def catalog_by_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = views.table(spark, sf_dir, "lineitem").where("l_quantity > 45").select("l_partkey")
    return store.by_ids(_catalog(spark, sf_dir), asked).select("track_id", "artist", "title", "path")


@query("select event_type, count(*) as n from events where event_id % 2 = 0 or user_id in (select c_custkey from customer where c_custkey % 3 = 0) group by 1")
def appended_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every second event, and of the others those whose job (a third of the customers) there is."""
    rows = views.table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("job_id"), "event_type")
    jobs = views.table(spark, sf_dir, "customer").where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("id"))
    return store.appended(rows.where("event_id % 2 = 0"), rows.where("event_id % 2 != 0"), jobs).groupBy("event_type").agg(F.count("*").alias("n"))


@query(f"with {views.JOBS} select status, count(*) * 2 as n, sum(id)::bigint * 2 + count(*) * 1000000000 as ids from jobs group by 1")
def inserted_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All jobs, and each once more with a new id."""
    jobs = views.jobs(spark, sf_dir)
    both = store.inserted(jobs, jobs.withColumn("id", F.col("id") + 1_000_000_000))
    return both.groupBy("status").agg(F.count("*").alias("n"), F.sum("id").alias("ids"))


@query(f"with {views.ARTIFACTS}, new_paths as (select distinct path from artifacts where job_id = 8), kept as (select job_id, size_bytes from artifacts where job_id is distinct from 7 and path not in (select path from new_paths)), new as (select 7 as job_id, 0 as size_bytes from artifacts where job_id = 8) select job_id, count(*) as n, sum(size_bytes)::bigint as bytes from (select * from kept union all select * from new) group by 1")
def replaced_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of one job give way to those of another."""
    rows = views.artifacts(spark, sf_dir)
    new = rows.where("job_id = 8").withColumn("job_id", F.lit(7).cast("long")).withColumn("size_bytes", F.lit(0).cast("long"))
    return store.replaced_files(rows, new, 7).groupBy("job_id").agg(F.count("*").alias("n"), F.sum("size_bytes").alias("bytes"))


@query(f"with {views.JOBS} select id, (id % 13 = 0 and id % 26 != 0) or id % 17 = 0 as pinned from jobs")
def pins_toggled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of pins after changes, and the jobs with it."""
    jobs = views.jobs(spark, sf_dir)
    pins = jobs.where("pinned").select(F.col("id").alias("job_id"))
    changes = jobs.where("id % 17 = 0").select(F.col("id").alias("job_id"), F.lit(True).alias("pin")).unionByName(jobs.where("id % 26 = 0 and id % 17 != 0").select(F.col("id").alias("job_id"), F.lit(False).alias("pin")))
    return store.pinned(jobs, store.toggled(pins, changes)).select("id", "pinned")


_CONTEXT = "context as (select id, status, created_at, updated_at, case when id % 4 != 0 then (id % 400)::int else 420 end as max_provider_calls, id % 2 = 0 as budget_autoscale, case when id % 5 = 0 then 'vibra,audd' else '' end as provider_order from jobs)"


def _with_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("id")
    options = F.struct(F.when(key % 4 != 0, (key % 400).cast("int")).otherwise(420).alias("max_provider_calls"), (key % 2 == 0).alias("budget_autoscale"), F.when(key % 5 == 0, F.array(F.lit("vibra"), F.lit("audd"))).alias("provider_order"))
    return views.jobs(spark, sf_dir).withColumn("options", options)


@query(f"with {views.JOBS}, {_CONTEXT} select * replace (strftime(created_at, '%Y-%m-%d %H:%M:%S') as created_at, strftime(updated_at, '%Y-%m-%d %H:%M:%S') as updated_at) from context")
def job_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = store.job_context(_with_options(spark, sf_dir))
    return rows.withColumns({**{c: F.date_format(c, _STAMP) for c in ("created_at", "updated_at")}, "provider_order": F.array_join("provider_order", ",")})


@query(f"with {views.JOBS} select id, input || ',b ' || id as inputs from jobs")
def cleaned_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.array(F.concat(F.lit(" \t"), F.col("input"), F.lit("\n")), F.concat(F.lit("b "), F.col("id"), F.lit("  ")))
    return views.jobs(spark, sf_dir).select("id", F.array_join(store.cleaned_inputs(raw), ",").alias("inputs"))


@query("""select r_name as region, unnest(['cache', 'data', 'config', 'database', 'temporary_recordings']) as name,
  unnest(['/var/cache/' || r_regionkey, '/srv/' || r_regionkey, '/etc/' || r_regionkey, '/srv/' || r_regionkey || '/db', '/tmp']) as location from region""")
def storage_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each region keeps what."""
    key = F.col("r_regionkey").cast("string")
    settings = views.table(spark, sf_dir, "region").select("r_name", F.concat(F.lit("/var/cache/"), key).alias("cache_dir"), F.concat(F.lit("/srv/"), key).alias("data_dir"), F.concat(F.lit("/etc/"), key).alias("config_dir"), F.concat(F.lit("/srv/"), key, F.lit("/db")).alias("db_path"), F.lit("/tmp").alias("temporary_dir"))
    return store.locations(settings, "r_name").withColumnRenamed("r_name", "region")


@query("""select event_id, '{"a":"' || user_id || '","k":"' || (props->>'$.k') || '","z":"' || event_type || '"}' as payload from events""")
def canonical_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = F.create_map(F.lit("z"), F.col("event_type"), F.lit("a"), F.col("user_id").cast("string"), F.lit("k"), F.get_json_object("props", "$.k"))
    return views.table(spark, sf_dir, "events").select("event_id", T.canonical_json(members).alias("payload"))


@query(f"""with {views.LEDGER}, {views.JOBS}, {_CONTEXT}, found as (select * from ledger where job_id = 3 and coalesce(provider_name, 'job') = 'vibra' and not matched), sums as (select {_SUMS}{_SEGMENTS} from found)
select c.id as job_id, c.max_provider_calls, '{{"matched":"False","providers":"vibra"}}' as filters, s.metrics as n_metrics, s.elapsed_ms, (select sum(id)::bigint from found) as ids from context c, sums s where c.id = 3""")
def metrics_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The payload of one job with a filters block."""
    rows = ledger.lifted(views.ledger(spark, sf_dir)).where("job_id = 3")
    body = store.metrics_payload(rows, store.known(_with_options(spark, sf_dir), 3), providers=["vibra"], matched=False)
    ids = F.aggregate("metrics", F.lit(0).cast("long"), lambda total, m: total + m["id"])
    return body.select(F.col("job.id").alias("job_id"), F.col("job.max_provider_calls"), T.canonical_json(F.col("filters")).alias("filters"), F.col("summary.metrics").alias("n_metrics"), F.col("summary.elapsed_ms").alias("elapsed_ms"), ids.alias("ids"))


@query(f"with {views.LEDGER} select sum(gate_g1_hits)::bigint as gate_g1_hits, sum(gate_g3_hits)::bigint as gate_g3_hits, count(*) filter (gate_g1_hits != 0) as with_g1 from ledger")
def packed_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters into payloads and out again; those that are zero leave no member."""
    rows = ledger.lifted(views.ledger(spark, sf_dir)).withColumn("payload", F.lit('{"note":"x"}'))
    back = ledger.packed(rows).select(F.from_json("payload", "note string, gate_g1_hits long, gate_g3_hits long").alias("p")).where("p.note = 'x'")
    return back.select(F.sum("p.gate_g1_hits").alias("gate_g1_hits"), F.sum("p.gate_g3_hits").alias("gate_g3_hits"), F.count("p.gate_g1_hits").alias("with_g1"))


@query(f"with {views.TRACKS} select id, {_ARTISTS} || '::' || {_TITLE} as name_key from tracks")
def accented_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names written with accents, ligatures and wide letters have the keys of the plain ones."""
    accented = lambda c: F.translate(F.replace(c, F.lit("fi"), F.lit("ﬁ")), "aeouncAEOB4", "áëôůñçÀÉỒＢ４")
    artist, title = F.col("artist"), F.col("title")
    # Words that the rules look for stay as they are.
    plain = title.rlike(r"(?i)\(|\[| - |feat|^the ")
    return views.tracks(spark, sf_dir).select("id", I.fuzzy_key(accented(artist), F.when(plain, title).otherwise(accented(title))).alias("name_key"))


@query("select o_orderkey as id, 't' || o_orderkey as title, 7 as depth from orders union all select o_orderkey, 'u' || o_orderkey, 8 from orders")
def deep_playlists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaves seven and eight levels below the top."""
    key = F.col("o_orderkey").cast("string")
    leaf = lambda prefix: F.concat(F.lit(f'{{"title":"{prefix}'), key, F.lit('"}'))
    body = F.concat(F.lit('{"entries":[' * 7), leaf("t"), F.lit(',null,{"entries":['), leaf("u"), F.lit("]}"), F.lit("]}" * 7))
    rows = views.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), body.alias("body"))
    return readers.flattened(rows).select("id", F.get_json_object("entry", "$.title").alias("title"), F.size("path").alias("depth"))


@query(f"with {views.HITS}, l as (select seq, end_ms - start_ms as n from (select seq, start_ms, start_ms + (end_ms - start_ms) * (1 + seq % 60) as end_ms from hits)) select seq, case when n < 10000 then 2000 when n < 60000 then 5000 when n < 600000 then 12000 else 30000 end as merge_gap, case when n < 10000 then 2000 when n < 60000 then 5000 when n < 600000 then 8000 else 19000 end as bridge_gap from l")
def gap_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    longer = (F.col("end_ms") - F.col("start_ms")) * (1 + F.col("seq") % 60)
    return views.hits(spark, sf_dir).select("seq", timeline.gap_for(longer, timeline.merge_steps()).alias("merge_gap"), timeline.gap_for(longer, timeline.bridge_steps()).alias("bridge_gap"))


@query(f"with {views.FRAMES}, parts as (select item, idx // 10 as segment, generate_subscripts(vector, 1) as pos, unnest(vector) as x from frames) select item, segment::bigint as segment, pos::int as pos, round(avg(x), 6) as x from parts group by 1, 2, 3")
def segment_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean vectors of every ten frames."""
    rows = views.frames(spark, sf_dir).withColumn("segment", F.expr("cast(idx div 10 as long)"))
    return segmentation.mean_vectors(rows).select("item", "segment", F.posexplode("vector").alias("pos", "x")).select("item", "segment", (F.col("pos") + 1).alias("pos"), F.round("x", 6).alias("x"))


@query()
def analyzed_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chain from frames to segments with repeat groups; an ordered fold, tested against plain loops."""
    label = F.element_at(F.array(*map(F.lit, ("matched_track", "music_unresolved", "speech_only"))), (F.col("vec_id") % 3 + 1).cast("int"))
    rows = views.frames(spark, sf_dir).withColumns({"label": label, "chroma": F.slice("vector", 1, 12)})
    found = segmentation.analyzed(rows, feature=0.2, chroma=0.1, certain=0.4)
    return found.select("item", "segment", "start_ms", "end_ms", "kind", F.round("music_ratio", 9).alias("music_ratio"), "repeat_group")


@query(f"with {views.JOBS} select id, status, title, input from jobs where id = 7")
def job_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One job by its id; the filter reaches the scan."""
    return store.by_id(views.jobs(spark, sf_dir), 7).select("id", "status", "title", "input")


@query("select s_name as name, s_suppkey % 3 != 0 as enabled, case when s_suppkey % 5 = 0 then '' else 'api_token=' || s_name || ',nation=' || s_nationkey end as config from supplier")
def saved_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settings kept as JSON, some of it faulty."""
    key = F.col("s_suppkey")
    body = F.when(key % 5 == 0, "{broken").otherwise(F.to_json(F.struct(F.col("s_name").alias("api_token"), F.col("s_nationkey").cast("string").alias("nation"))))
    rows = views.table(spark, sf_dir, "supplier").select(F.col("s_name").alias("name"), F.when(key % 3 == 0, 0).otherwise(1).alias("enabled"), body.alias("config_json"))
    shown = F.array_join(F.array_sort(F.transform(F.map_entries("config"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ",")
    return providers.saved_settings(rows).select("name", "enabled", shown.alias("config"))


@query(f"with {views.HITS} select item, seq, row_number() over (partition by item order by start_ms, seq)::int as place from hits")
def segments_by_item(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assembly.by_item(views.hits(spark, sf_dir), "start_ms", "seq").select("item", "seq", "place")


@query("""with i as (select o_orderkey as k, o_custkey as c from orders)
select k as job_id, 1 as place, null::int as entry_index, 'local_file' as kind, case when k % 6 = 0 then 'queued' else 'failed' end as status,
  case when k % 6 = 0 then null when k % 6 = 1 then 'Input file does not exist: /media/m' || k || '.wav' else 'Input path is not a file: /media/d' || k end as error, case k % 6 when 0 then 'f' || k || '.wav' when 1 then 'm' || k || '.wav' else 'd' || k end as title, null as download_url from i where k % 6 in (0, 1, 2)
union all select k, 1, null, 'direct_http', 'queued', null, 's' || k || '.mp3', 'https://x.example.com/a/s' || k || '.mp3' from i where k % 6 = 3
union all select k, 1, e.n, 'yt_dlp', 'queued', null, e.name || k, 'https://a.example/' || e.name || k from i, (values (1, 'a'), (1, 'b'), (2, 'c')) e(n, name) where k % 6 = 4
union all select k, 1, null, case when c % 2 = 0 then 'direct_http' else 'yt_dlp' end, 'failed', case when c % 2 = 0 then 'Address not allowed: 10.0.0.' || c % 256 else 'No answer for https://nobody.example.com/' || k end, null, null from i where k % 6 = 5""")
def resolved_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inputs of all kinds as source items: files there and not, folders, media, playlists, hosts that must not be asked, and addresses nobody answers for."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    form = k % 6
    text = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    blocked = text("http://10.0.0.", c % 256, "/x.mp3")
    value = (
        F.when(form == 0, text(" /media/f", k, ".wav ")).when(form == 1, text("/media/m", k, ".wav")).when(form == 2, text("/media/d", k)).when(form == 3, text("http://X.example.com/a/s", k, ".mp3?utm_source=a"))
        .when(form == 4, text("https://list.example.com/", k)).when(c % 2 == 0, blocked).otherwise(text("https://nobody.example.com/", k))
    )
    orders = views.table(spark, sf_dir, "orders").select(k, c)
    files = orders.where(form == 0).select(text("/media/f", k, ".wav").alias("path")).unionByName(orders.where(form == 2).select(text("/media/d", k, "/inner.wav").alias("path")))
    one = lambda name: text(f'{{"title":"{name}', k, f'","url":"https://a.example/{name}', k, '"}')
    body = text('{"title":"all","entries":[{"entries":[', one("a"), ",", one("b"), "]},", one("c"), ",null]}")
    answers = orders.where(form == 4).select(text("https://list.example.com/", k).alias("url"), body.alias("body"))
    found = inputs.resolved(orders.select(k.alias("job_id"), F.lit(1).alias("place"), value.alias("value")), files, answers)
    return found.select("job_id", "place", "entry_index", "kind", "status", "error", "title", "download_url")
