"""Recognizers as table functions, in a registry with an order, asked one after the other by lateral joins.

A recognizer is a class with ``name`` and ``recognize(clip)``, which gives candidates (key, confidence). ``table_function`` makes it a Python
table function: while Spark analyses a plan it checks that the clip is a struct with the fields that the recognizer
needs and that its settings are there, and while the plan runs it gets clips in Arrow batches, or in pickled ones (``arrow=False``): as Arrow, each clip's
few answers are a batch of their own, which takes several times as long. Two forms are there: all
candidates of a clip, one row each, and the best one only, with exactly one row for each clip, whether or not something was found.

``walk`` joins probes laterally with one recognizer after the other. A recognizer gets null instead of the clip, and so is not
asked, where one before it was sure enough, or where it is paid and a free one has a strong hit.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any, ClassVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, UserDefinedTableFunction

from spindrift.operators.providers import ORDER
from spindrift.operators.scoring import PAID

CANDIDATE = T.StructType([T.StructField("key", T.StringType()), T.StructField("confidence", T.DoubleType())])
ANSWER = T.StructType([*CANDIDATE.fields, T.StructField("n_candidates", T.IntegerType()), T.StructField("asked", T.BooleanType()), T.StructField("error", T.StringType())])


class Recognizer:
    """Base of recognizers; they are made in the task, with their settings."""

    name: ClassVar[str]
    #: Fields of a clip, and settings, that must be there.
    fields: ClassVar[tuple[str, ...]] = ()
    needs: ClassVar[tuple[str, ...]] = ()

    def __init__(self, settings: Mapping[str, str]) -> None:
        self.settings = settings

    def recognize(self, clip: Any) -> Iterable[tuple[str, float]]:
        """Candidates of a clip, any number in any order; an error counts as no answer."""
        raise NotImplementedError


def table_function(kind: type[Recognizer], best: bool = True, arrow: bool = True) -> UserDefinedTableFunction:
    """(clip struct, settings as JSON text) -> the best candidate with how many there were, or all candidates."""

    class Asked:
        @staticmethod
        def analyze(clip: AnalyzeArgument, settings: AnalyzeArgument) -> AnalyzeResult:
            if not isinstance(clip.dataType, T.StructType):
                raise ValueError(f"{kind.name} takes a clip as a struct")
            if missing := [f for f in kind.fields if f not in clip.dataType.names]:
                raise ValueError(f"A clip for {kind.name} lacks {', '.join(missing)}")
            if settings.value is None or (missing := [k for k in kind.needs if not json.loads(settings.value).get(k)]):
                raise ValueError(f"Settings of {kind.name} lack {', '.join(missing) if settings.value else 'a constant text'}")
            return AnalyzeResult(ANSWER if best else CANDIDATE)

        def __init__(self) -> None:
            self.asked: Recognizer | None = None

        def eval(self, clip: Any, settings: str) -> Iterator[tuple]:
            if clip is None:
                if best:
                    yield None, None, 0, False, None
                return
            self.asked = self.asked or kind(json.loads(settings))
            try:
                found = sorted(self.asked.recognize(clip), key=lambda c: (-c[1], c[0]))
            except Exception as error:  # an answer of a recognizer, which the ledger shows
                if best:
                    yield None, None, 0, True, f"{type(error).__name__}: {error}"
                return
            if best:
                key, confidence = found[0] if found else (None, None)
                yield key, confidence, len(found), True, None
            else:
                yield from found

    return F.udtf(Asked, useArrow=arrow)


@dataclass
class Registry:
    """Recognizers by name, with settings and switches; those in ``order`` come first, others by name after them."""

    order: Sequence[str] = ORDER
    kinds: dict[str, type[Recognizer]] = field(default_factory=dict)
    settings: dict[str, Mapping[str, str]] = field(default_factory=dict)
    off: set[str] = field(default_factory=set)

    def add(self, kind: type[Recognizer], **settings: str) -> Registry:
        """Register under its name, in place of one that has it already."""
        self.kinds[kind.name] = kind
        self.settings[kind.name] = settings
        return self

    def configure(self, name: str, enabled: bool = True, **settings: str) -> Registry:
        """Lay settings over those that are there, and switch on or off."""
        if name not in self.kinds:
            raise KeyError(f"Unknown recognizer: {name}")
        self.settings[name] = {**self.settings[name], **settings}
        (self.off.discard if enabled else self.off.add)(name)
        return self

    def active(self, order: Sequence[str] | None = None) -> list[type[Recognizer]]:
        """Those switched on whose settings are whole, in order; ``order`` names all that are wanted."""
        if order is not None:
            if unknown := [n for n in order if n not in self.kinds]:
                raise KeyError(f"Unknown recognizer: {', '.join(unknown)}")
            names = list(order)
        else:
            place = {n: k for k, n in enumerate(self.order)}
            names = sorted(self.kinds, key=lambda n: (place.get(n, len(place)), n))
        return [self.kinds[n] for n in names if n not in self.off and all(self.settings[n].get(k) for k in self.kinds[n].needs)]

    def register(self, spark: SparkSession) -> list[str]:
        """Table functions for SQL: recognize_<name>(clip, settings) gives all candidates."""
        names = []
        for kind in self.active():
            spark.udtf.register(f"recognize_{kind.name}", table_function(kind, best=False))
            names.append(f"recognize_{kind.name}")
        return names

    def candidates(self, probes: DataFrame, name: str, clip: Callable[[Callable[[str], Column]], Column], arrow: bool = True) -> DataFrame:
        """All candidates of one recognizer, a row each; a probe without one has none. ``clip`` builds the clip from a probe's columns."""
        asked = table_function(self.kinds[name], best=False, arrow=arrow)
        return probes.lateralJoin(asked(clip(outer), F.lit(json.dumps(dict(self.settings[name])))))


def outer(name: str) -> Column:
    return F.col(name).outer()


def walk(probes: DataFrame, registry: Registry, clip: Callable[[Callable[[str], Column]], Column], sure: float = 0.92, strong_free: float = 0.80, order: Sequence[str] | None = None, arrow: bool = True) -> DataFrame:
    """Probes with turns, an array in order of (provider, asked, key, confidence, n_candidates, error), and the best answer as provider, key, confidence.

    ``clip`` builds the clip from a function that gives a probe's column by name. From a confidence of ``sure`` on, nobody is asked any more; from
    ``strong_free`` of a free recognizer on, paid ones are not. Of equal confidences the first recognizer's counts. A plan has one
    lateral join for each recognizer; all keep the partitioning of ``probes``.
    """
    kinds, rows = registry.active(order), probes

    def highest(of: list[int]) -> Column:
        return F.greatest(F.lit(0.0), F.lit(0.0), *(F.coalesce(F.col(f"_a{j}.confidence"), F.lit(0.0)) for j in of))

    for k, kind in enumerate(kinds):
        free = [j for j in range(k) if kinds[j].name not in PAID]
        spared = (highest(list(range(k))) >= sure) | (F.lit(kind.name in PAID) & (highest(free) >= strong_free))
        rows = rows.withColumn(f"_spared{k}", spared)
        asked = table_function(kind, arrow=arrow)(F.when(~outer(f"_spared{k}"), clip(outer)), F.lit(json.dumps(dict(registry.settings[kind.name]))))
        rows = rows.lateralJoin(asked.select(F.struct(*ANSWER.names).alias(f"_a{k}")))
    turns = [F.struct(F.lit(n).alias("provider"), *(F.col(f"_a{k}.{c}").alias(c) for c in ("asked", "key", "confidence", "n_candidates", "error"))) for k, n in enumerate(kind.name for kind in kinds)]
    rows = rows.withColumn("turns", F.array(*turns) if turns else F.array().cast("array<struct<provider:string,asked:boolean,key:string,confidence:double,n_candidates:int,error:string>>"))
    found = F.filter("turns", lambda t: t["confidence"].isNotNull())
    ranked = F.array_sort(F.transform(found, lambda t, k: F.struct((-t["confidence"]).alias("less"), k.alias("k"), t["provider"].alias("provider"), t["key"].alias("key"), t["confidence"].alias("confidence"))))
    top = F.get(ranked, F.lit(0))
    rows = rows.withColumns({"provider": top["provider"], "key": top["key"], "confidence": top["confidence"]})
    return rows.drop(*(f"_a{k}" for k in range(len(kinds))), *(f"_spared{k}" for k in range(len(kinds))))
