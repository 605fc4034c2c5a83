import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from spindrift.operators import recognizers
from spindrift.plans.recognizer_queries import Audd, Catalog, Vibra, registry


def clip(column):
    return F.struct(column("start_ms").alias("start_ms"), column("end_ms").alias("end_ms"))


def probes(spark):
    return spark.createDataFrame([(1, 3, 12_003), (2, 1, 30_001), (3, 26, 30_026), (4, 7, 12_007), (5, None, None)], "id int, start_ms long, end_ms long")


def test_registry_order_switches_and_settings():
    r = registry()
    names = lambda kinds: [k.name for k in kinds]
    assert names(r.active()) == ["local_catalog", "vibra", "audd"]
    assert names(r.active(["audd", "vibra"])) == ["audd", "vibra"]
    assert names(r.configure("vibra", enabled=False).active()) == ["local_catalog", "audd"]
    assert names(r.configure("vibra").configure("audd", api_token="").active()) == ["local_catalog", "vibra"]
    with pytest.raises(KeyError):
        r.configure("other")
    with pytest.raises(KeyError):
        r.active(["other"])

    class Extra(recognizers.Recognizer):
        name = "aaa"

    assert names(r.add(Extra).active()) == ["local_catalog", "vibra", "aaa"]


def test_walk_spares_and_keeps_errors(spark):
    found = {r.id: r for r in recognizers.walk(probes(spark), registry(), clip).collect()}
    turns = {k: [(t.provider, t.asked) for t in r.turns] for k, r in found.items()}
    assert turns[4] == [("local_catalog", True), ("vibra", True), ("audd", False)]  # a strong free hit spares the paid one
    assert turns[2] == [("local_catalog", True), ("vibra", True), ("audd", True)]
    assert found[3].turns[1].error == "RuntimeError: no answer" and found[3].provider == "audd"
    assert [t.error is not None for t in found[5].turns] == [True, True, True] and found[5].provider is None
    sure = recognizers.walk(probes(spark).where("id = 1"), registry(), clip, sure=0.8).first()
    assert [t.asked for t in sure.turns] == [True, False, False] and sure.key == "c3"
    assert recognizers.walk(probes(spark).limit(0), registry(), clip).count() == 0
    alone = recognizers.walk(probes(spark), recognizers.Registry(), clip).first()
    assert alone.turns == [] and alone.key is None


def test_plan_has_no_shuffle_and_sql_can_ask(spark):
    plan = recognizers.walk(probes(spark), registry(), clip)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPythonUDTF") == 3 and "Exchange" not in plan and "Join" not in plan
    registry().register(spark)
    probes(spark).createOrReplaceTempView("some_probes")
    rows = spark.sql("select id, r.key from some_probes, lateral recognize_vibra(named_struct('start_ms', start_ms), '{}') r where id = 2 order by key").collect()
    assert [(r.id, r.key) for r in rows] == [(2, "v1"), (2, "v1")]


def test_faults_are_found_while_the_plan_is_analysed(spark):
    with pytest.raises(AnalysisException, match="lacks end_ms"):
        probes(spark).lateralJoin(recognizers.table_function(Catalog)(F.struct(F.col("start_ms").outer().alias("start_ms")), F.lit("{}"))).schema
    with pytest.raises(AnalysisException, match="lack api_token"):
        probes(spark).lateralJoin(recognizers.table_function(Audd)(F.struct(F.col("start_ms").outer().alias("start_ms")), F.lit("{}"))).schema
    with pytest.raises(AnalysisException, match="takes a clip"):
        probes(spark).lateralJoin(recognizers.table_function(Vibra)(F.col("start_ms").outer(), F.lit("{}"))).schema


def test_queries_pickle_their_clips(spark):
    """Arrow makes a batch of each clip's answers, which took several times as long; both forms answer alike."""
    from spindrift.plans import catalogue

    for name in ("recognizer_walk", "recognizer_candidates"):
        assert "ArrowEvalPythonUDTF" not in catalogue.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    key = lambda r: str(r)
    for ask in (lambda arrow: recognizers.walk(probes(spark), registry(), clip, arrow=arrow), lambda arrow: registry().candidates(probes(spark), "vibra", clip, arrow=arrow)):
        assert sorted(ask(True).collect(), key=key) == sorted(ask(False).collect(), key=key)
