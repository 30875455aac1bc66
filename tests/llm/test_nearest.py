from __future__ import annotations

import random

import pyspark.sql.functions as F
import pytest

from skylode.llm.nearest import match_nearest, mjd


def brute(starts, leaves, tolerance):
    out = set()
    for i, e, at in starts:
        near = [(abs(at - t), t, r) for x, t, r in leaves if x == e and e is not None and t is not None and at is not None and abs(at - t) <= tolerance]
        if near:
            out.add((i, min(near)[2]))
    return out


@pytest.mark.parametrize("tolerance", [0, 1, 7, 180.0])
def test_equals_brute_force(spark, tolerance):
    rng = random.Random(int(tolerance))
    leaves = [(rng.choice(["hot"] * 4 + ["b", "c", None]), rng.choice([None, rng.randrange(-3000, 60_000)]), k) for k in range(800)]
    leaves += [(e, t, r + 1000) for e, t, r in leaves[::9]]
    starts = [(k, rng.choice(["hot", "hot", "b", "c", "none", None]), rng.choice([None, rng.uniform(-3500, 61_000), float(rng.randrange(60_000))])) for k in range(1500)]
    starts += starts[:5]
    q = spark.createDataFrame(starts, "id long, entity string, at double").withColumn("level", F.lit(3))
    t = spark.createDataFrame(leaves, "entity string, time long, ref long").withColumn("prefix", F.lit(1))
    got = match_nearest(q, t, tolerance).collect()
    assert {(r["id"], r["ref"]) for r in got} == brute(starts, leaves, tolerance)
    assert len(got) == sum(1 for s in starts if brute([s], leaves, tolerance))


def test_empty_tables(spark):
    q = spark.createDataFrame([(1, "a", 5.0)], "id long, entity string, at double")
    t = spark.createDataFrame([("a", 5, 7)], "entity string, time long, ref long")
    assert match_nearest(q, t.limit(0), 180).count() == 0
    assert match_nearest(q.limit(0), t, 180).count() == 0


def test_mjd_of_any_tool(spark):
    texts = ["57001.5", "+57001,5", " \t57001.50 ", "5.70015E+04", "2457002.0", "NaN", "nan", "inf", "", "--", "n/a", None, "1e999", "57 001", "0x10", ".5", "5,"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(mjd(F.col("t"))).collect()]
    assert got == [57001.5] * 5 + [None] * 10 + [0.5, 5.0]
