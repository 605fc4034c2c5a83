"""Budgets against a plain loop."""

import random

import pytest
from pyspark.sql import functions as F

from spindrift.operators import budget


def plain(turns, first):
    """turns: (cost, refund) in order."""
    first = max(0, first)
    remaining, out = first, []
    for cost, refund in turns:
        cost, refund, before = cost or 0, refund or 0, remaining
        if refund > 0:
            remaining, ok, used = min(first, remaining + refund), True, 0
        elif cost <= 0:
            ok, used = remaining > 0, 0
        else:
            ok = remaining >= cost
            used = cost if ok else 0
            remaining -= used
        out.append((before, remaining, used, ok))
    return out


SCHEMA = "job string, at long, cost int, refund int, part int, place string"


@pytest.mark.parametrize("partitions", [1, 8])
def test_spending_against_a_loop(spark, partitions):
    """A group of over half of all rows, which spans partitions, with small and large costs; null costs and a null group."""
    rng = random.Random(partitions)
    jobs = {"hot": 3000, **{f"j{k}": rng.randrange(1, 60) for k in range(30)}, None: 20}
    rows, expected = [], {}
    for job, n in jobs.items():
        turns = [(rng.choice([0, 1, 1, 2, 5, 9, None, -1]), rng.choice([0, 0, 0, 1, 4, None])) for _ in range(n)]
        rows += [(job, at, c, r, 1, "x") for at, (c, r) in enumerate(turns)]
        expected |= {(job, at): x for at, x in enumerate(plain(turns, 37))}
    rng.shuffle(rows)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        frame = spark.createDataFrame(rows, SCHEMA).repartition(partitions)
        got = {(r.job, r.at): (r.before, r.remaining, r.consumed, r.allowed) for r in budget.spending(frame, F.lit(37), ["job"], ["at"], refund="refund").collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == expected


def test_refusal_and_questions(spark):
    rows = spark.createDataFrame([("a", 1, 3), ("a", 2, 1), ("a", 3, 2), ("a", 4, 1), ("a", 5, 0), ("b", 1, 0)], "g string, t int, cost int")
    found = budget.spending(rows, F.when(F.col("g") == "a", 2).otherwise(0), ["g"], ["t"])
    assert [(r.allowed, r.remaining) for r in found.orderBy("g", "t").collect()] == [(False, 2), (True, 1), (False, 1), (True, 0), (False, 0), (False, 0)]
    assert budget.spending(rows.limit(0), F.lit(3), ["g"], ["t"]).count() == 0
