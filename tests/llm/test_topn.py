from __future__ import annotations

import math
import random
from collections import defaultdict

import pytest

from skylode.llm.topn import top_n

SCHEMA = "g string, m string, item long, score double, rank int, emitted string"


def brute(rows, n):
    best = defaultdict(dict)
    for g, m, i, s, *_ in rows:
        if s is not None and not math.isnan(s):
            best[g, m][i] = max(s, best[g, m].get(i, -math.inf))
    out = set()
    for (g, m), items in best.items():
        out |= {(g, m, i, s) for i, s in sorted(items.items(), key=lambda x: (-x[1], x[0] is None, x[0]))[:n]}
    return out


@pytest.mark.parametrize("n", [1, 5])
@pytest.mark.parametrize("seed", range(3))
def test_equals_brute_force(spark, n, seed):
    rng = random.Random(seed)
    rows = []
    for g in ["hot"] * 3000 + [str(k % 200) for k in range(600)] + [None] * 30:
        s = rng.choice([None, math.nan, math.inf, -math.inf, float(rng.randrange(4)), rng.gauss(0, 3)])
        rows.append((g, rng.choice(["a", None]), rng.choice([None, rng.randrange(40), rng.randrange(4000)]), s, 1, "x"))
    rows += rows[::5]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = top_n(df, ["g", "m"], "item", "score", n).collect()
    assert len(got) == len({tuple(r) for r in got})
    assert {tuple(r) for r in got} == brute(rows, n)


def test_repeats_of_lower_score_dont_take_places(spark):
    rows = [("g", "m", 1, 9.0, 0, "")] + [("g", "m", 1, 8.0 - k / 100, 0, "") for k in range(50)] + [("g", "m", 2, 1.0, 0, "")]
    got = top_n(spark.createDataFrame(rows, SCHEMA).coalesce(1), ["g", "m"], "item", "score", 2).collect()
    assert [(r["item"], r["score"]) for r in got] == [(1, 9.0), (2, 1.0)]


def test_small_batches_carry_the_state(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        rows = [("g", "m", k % 7, float(k % 5), 0, "") for k in range(100)]
        got = top_n(spark.createDataFrame(rows, SCHEMA).coalesce(1), ["g", "m"], "item", "score", 5).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {tuple(r) for r in got} == brute(rows, 5)


def test_empty(spark):
    assert top_n(spark.createDataFrame([], SCHEMA), ["g", "m"], "item", "score", 5).count() == 0
