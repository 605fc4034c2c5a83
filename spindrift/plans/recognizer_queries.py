"""Recognizers as table functions over the hits of ``events``."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.operators import recognizers
from spindrift.plans import views
from spindrift.plans.registry import query


class Catalog(recognizers.Recognizer):
    """Knows the clips of short windows."""

    name, fields = "local_catalog", ("start_ms", "end_ms")

    def recognize(self, clip: Any) -> Iterable[tuple[str, float]]:
        length = clip["end_ms"] - clip["start_ms"]
        if length < 20_000:
            yield f"c{clip['start_ms'] % 11}", 0.70 + (clip["start_ms"] % 5) / 16


class Vibra(recognizers.Recognizer):
    """Fails on some clips, and has two candidates for others."""

    name, fields = "vibra", ("start_ms",)

    def recognize(self, clip: Any) -> Iterable[tuple[str, float]]:
        if clip["start_ms"] % 13 == 0:
            raise RuntimeError("no answer")
        if clip["start_ms"] % 3:
            yield f"v{clip['start_ms'] % 7}", 0.5
            yield f"v{clip['start_ms'] % 5}", 0.5 + (clip["start_ms"] % 7) / 16


class Audd(recognizers.Recognizer):
    """Paid; always has an answer."""

    name, fields, needs = "audd", ("start_ms",), ("api_token",)

    def recognize(self, clip: Any) -> Iterable[tuple[str, float]]:
        yield f"{self.settings['api_token']}{clip['start_ms'] % 4}", 0.75


def registry() -> recognizers.Registry:
    return recognizers.Registry().add(Audd, api_token="a").add(Vibra).add(Catalog)


def _clip(column: Callable[[str], Column]) -> Column:
    return F.struct(column("start_ms").alias("start_ms"), column("end_ms").alias("end_ms"))


def _probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits dealt out, since a few small files hold many clips to ask for."""
    return views.hits(spark, sf_dir).select("seq", "start_ms", "end_ms").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "seq")


_WALK = f"""{views.HITS},
c as (select *, case when end_ms - start_ms < 20000 then 'c' || start_ms % 11 end as ck, case when end_ms - start_ms < 20000 then 0.70::double + (start_ms % 5) / 16::double end as cc from hits),
v as (select *, coalesce(cc, 0) < 0.92 as v_asked, coalesce(cc, 0) < 0.92 and start_ms % 13 != 0 and start_ms % 3 != 0 as v_found from c),
w as (select *, case when v_found then case when start_ms % 7 > 0 then 'v' || start_ms % 5 else least('v' || start_ms % 5, 'v' || start_ms % 7) end end as vk, case when v_found then 0.5::double + (start_ms % 7) / 16::double end as vc from v),
a as (select *, greatest(coalesce(cc, 0), coalesce(vc, 0)) < 0.80 as a_asked from w),
p as (select *, case when a_asked then 'a' || start_ms % 4 end as ak, case when a_asked then 0.75::double end as ac, greatest(coalesce(cc, 0), coalesce(vc, 0), case when a_asked then 0.75 else 0 end) as top from a)"""


@query(f"""with {_WALK} select seq, case when top = 0 then null when cc = top then 'local_catalog' when vc = top then 'vibra' else 'audd' end as provider,
  case when top = 0 then null when cc = top then ck when vc = top then vk else ak end as key, nullif(top, 0) as confidence,
  'local_catalog' || case when v_asked then ',vibra' else '' end || case when a_asked then ',audd' else '' end as asked, v_asked and start_ms % 13 = 0 as failed from p""")
def recognizer_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three recognizers in the registry's order, asked by lateral joins; sure answers and strong free ones spare those after them."""
    found = recognizers.walk(_probes(spark, sf_dir), registry(), _clip, arrow=False)
    asked = F.array_join(F.transform(F.filter("turns", lambda t: t["asked"]), lambda t: t["provider"]), ",")
    return found.select("seq", "provider", "key", "confidence", asked.alias("asked"), F.exists("turns", lambda t: t["error"].isNotNull()).alias("failed"))


@query(f"""with {views.HITS} select seq, 'v' || start_ms % 7 as key, 0.5::double as confidence from hits where start_ms % 13 != 0 and start_ms % 3 != 0
union all select seq, 'v' || start_ms % 5, 0.5::double + (start_ms % 7) / 16::double from hits where start_ms % 13 != 0 and start_ms % 3 != 0""")
def recognizer_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All candidates of one recognizer, as a lateral join."""
    return registry().candidates(_probes(spark, sf_dir), "vibra", _clip, arrow=False).select("seq", "key", "confidence")
