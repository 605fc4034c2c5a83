"""Files written and read by data sources, and waveforms made of columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.functions.text import stamp
from spindrift.operators import segmentation
from spindrift.plans import views
from spindrift.plans.registry import query
from spindrift.sources import pieces, waveforms
from spindrift.sources.folders import shared_folder


@query(f"""with {views.HITS}, l as (select item, start_ms, seq, case when start_ms >= 3600000 then lpad((start_ms // 3600000)::varchar, 2, '0') || ':' else '' end || lpad((start_ms // 1000 % 3600 // 60)::varchar, 2, '0') || ':' || lpad((start_ms // 1000 % 60)::varchar, 2, '0') || ' ' || key || chr(10) as line from hits)
select item::varchar as item, count(*) as lines, sha256(string_agg(line, '' order by start_ms, seq)) as digest from l group by 1""")
def exported_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One file of chapter lines for each item, written by tasks and read back whole."""
    lines = views.hits(spark, sf_dir).withColumn("line", F.concat(stamp(F.col("start_ms")), F.lit(" "), "key", F.lit("\n")))
    folder = f"{shared_folder(spark)}/chapters"
    pieces.write_files(lines, folder, "item", ["start_ms", "seq"], "line", ".txt")
    files = spark.read.option("recursiveFileLookup", "true").text(folder, wholetext=True).select(F.regexp_extract("_metadata.file_name", r"^(.*)\.txt$", 1).alias("item"), "value")
    return files.select("item", F.regexp_count("value", F.lit("\n")).cast("long").alias("lines"), F.sha2("value", 256).alias("digest"))


def _little(value: Column, width: int) -> Column:
    """A whole number as bytes, the least first."""
    return F.unhex(F.concat(*(F.lpad(F.hex(F.pmod(F.shiftright(value.cast("long"), 8 * k), F.lit(256))), 2, "0") for k in range(width))))


_RATE = 16


@query(f"""with s as (select user_id as item, row_number() over (partition by user_id order by event_id) - 1 as i, (props->>'$.k')::int * 37 % 4001 - 2000 as x from events),
n as (select item, count(*) as n from s group by 1), b as (select item, n, unnest(range(0, ceil(greatest(0, n - {_RATE}) / 12.0)::bigint + 1)) as block from n)
select b.item::varchar as item, b.block, b.block * 12 as first_frame, any_value(b.n) as frames, count(*) as n, sum(x)::bigint as total, max_by(x, i)::bigint as last from b join s on s.item = b.item and s.i >= b.block * 12 and s.i < b.block * 12 + 20 group by 1, 2, 3""")
def waveform_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A PCM file for each user from the values of the user's events, read in overlapping blocks of a second."""
    rows = views.table(spark, sf_dir, "events").select(F.col("user_id").alias("item"), "event_id", (F.get_json_object("props", "$.k").cast("int") * 37 % 4001 - 2000).alias("x"))
    samples = rows.select("item", F.col("event_id").alias("at"), _little(F.col("x"), 2).alias("piece"))
    size = 2 * F.col("n")
    text = lambda t: F.lit(t).cast("binary")
    number = lambda v, width: _little(F.lit(v), width)
    head = F.concat(text("RIFF"), _little(36 + size, 4), text("WAVEfmt "), number(16, 4), number(1, 2), number(1, 2), number(_RATE, 4), number(2 * _RATE, 4), number(2, 2), number(16, 2), text("data"), _little(size, 4))
    heads = rows.groupBy("item").agg(F.count("*").alias("n")).select("item", F.lit(-1).cast("long").alias("at"), head.alias("piece"))
    folder = f"{shared_folder(spark)}/waves"
    pieces.write_files(heads.unionByName(samples), folder, "item", ["at"], "piece", ".wav")
    spark.dataSource.register(waveforms.WaveSource)
    blocks = spark.read.format("waveforms").option("path", folder).option("chunkSeconds", "1").option("overlapSeconds", "0.25").option("splitBytes", "60").load()
    whole = F.transform("samples", lambda x: (x * 32768).cast("long"))
    return blocks.select(
        F.regexp_extract("path", r"([^/]*)\.wav$", 1).alias("item"), "block", "first_frame", "frames", F.size("samples").cast("long").alias("n"), F.aggregate(whole, F.lit(0).cast("long"), lambda a, x: a + x).alias("total"), F.element_at(whole, -1).alias("last"),
    )


def _series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as windows of sixteen-bit samples."""
    return views.table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").alias("item"), F.transform("embedding", lambda x: F.floor(x.cast("double") * 20_000)).alias("samples"))


@query("""with s as (select vec_id, unnest(range(0, 64)) as i, unnest(list_transform(embedding, lambda x: floor(x::double * 20000))) as x from embeddings),
f as (select vec_id, k, sqrt(pow(sum(x * cos(2 * pi() * i * k / 64)), 2) + pow(sum(x * sin(2 * pi() * i * k / 64)), 2)) as m from s, range(0, 33) r(k) group by 1, 2),
e as (select vec_id, sqrt(avg(x * x)) / 32768 as energy from s group by 1)
select vec_id, round(any_value(energy) * 0.6::double + sum(case when k / 32 > 0.02 and k / 32 < 0.45 then m else 0 end) * 1e-6 + sum(case when k / 32 >= 0.45 and k / 32 < 0.9 then m else 0 end) * 5e-7, 9) as score from f join e using (vec_id) group by 1""")
def window_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return waveforms.with_score(_series(spark, sf_dir)).select("vec_id", F.round("score", 9).alias("score"))


@query()
def waveform_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of vectors as waveforms, from the transform to labels; features are tested against plain loops."""
    rows = _series(spark, sf_dir).withColumns({"samples": F.transform("samples", lambda x: x / 32768), "rate": F.lit(64)})
    scored = segmentation.scores(waveforms.features(rows, hop_seconds=0.25, context_seconds=0.5))
    label = segmentation.frame_label(F.col("music_score"), F.col("speech_score"), F.col("no_music_score"), F.col("rms"), F.col("chroma"))
    return scored.groupBy("item", label.alias("label")).agg(F.count("*").alias("n"))
