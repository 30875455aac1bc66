from __future__ import annotations

import math
import random
from collections import defaultdict
from datetime import datetime, timedelta

import pytest

from skylode.llm.cutoffs import keep_fraction

SCHEMA = "cadence string, method string, f_start long, score double, scored_at timestamp_ntz, salt int, bin string"
T0 = datetime(2020, 1, 1)


def brute(rows, drops):
    last = {}
    for c, m, f, s, t, *_ in rows:
        if c is None or m is None:
            continue
        good = s if s is not None and math.isfinite(s) else None
        key = (t or datetime.min, good is not None, good or 0.0)
        if (c, m, f) not in last or key > last[c, m, f][0]:
            last[c, m, f] = (key, good)
    groups = defaultdict(list)
    for (c, m, f), (_, s) in last.items():
        if s is not None and m in drops:
            groups[c, m].append((s, f))
    kept = set()
    for (c, m), xs in groups.items():
        k = -(-(1000 - drops[m]) * len(xs) // 1000)
        if k:
            cut = sorted((s for s, _ in xs), reverse=True)[k - 1]
            kept |= {(c, m, f) for s, f in xs if s >= cut}
    return kept


def run(spark, rows, drops):
    df = spark.createDataFrame(rows, SCHEMA)
    drop = spark.createDataFrame(list(drops.items()), "method string, drop long")
    return keep_fraction(df, ["cadence", "method"], "f_start", "score", "scored_at", drop)


def scores(kind, n, rng):
    if kind == "ties":
        return [float(rng.randrange(3)) for _ in range(n)]
    if kind == "wide":
        return [rng.choice([-1, 1]) * 10 ** rng.uniform(-300, 300) for _ in range(n)]
    if kind == "close":
        return [1.0 + rng.randrange(50) * 2**-52 for _ in range(n)]
    return [rng.gauss(0, 5) for _ in range(n)]


@pytest.mark.parametrize("kind", ["plain", "ties", "wide", "close"])
def test_kept_rows_equal_brute_force(spark, kind):
    rng = random.Random(kind)
    rows = []
    for c, n in (("hot", 3000), ("small", 40), ("one", 1), (None, 20)):
        for f, s in enumerate(scores(kind, n, rng)):
            rows.append((c, "ab"[f % 2], f, s, T0 + timedelta(seconds=f), 0, "x"))
    rows += [(c, m, f, None if f % 3 else math.inf, t + timedelta(days=1), 1, "y") for c, m, f, _, t, *_ in rows[::11]]
    rows += rows[::7]
    rows += [("odd", "a", None, 1.0, None, 0, None), ("odd", "a", None, 2.0, T0, 0, None), ("odd", None, 1, 1.0, T0, 0, None), ("odd", "without", 1, 1.0, T0, 0, None)]
    rows += [("bad", "a", f, s, T0, 0, "") for f, s in enumerate([None, math.nan, math.inf, -math.inf])]
    drops = {"a": 990, "b": 500}
    got = run(spark, rows, drops)
    assert {tuple(r) for r in got.kept.select("cadence", "method", "f_start").collect()} == brute(rows, drops)
    assert got.kept.count() == len(brute(rows, drops))


def test_groups_report_cutoff_and_sizes(spark):
    rows = [("c", "a", f, float(f), T0, 0, "") for f in range(100)]
    (r,) = run(spark, rows, {"a": 975}).groups.collect()
    assert (r["n_usable"], r["target"], r["cutoff"], r["kept"]) == (100, 3, 97.0, 3)


def test_extremes_of_the_share_and_empty_input(spark):
    rows = [("c", m, f, float(f), T0, 0, "") for f in range(5) for m in "ab"]
    kept = run(spark, rows, {"a": 0, "b": 1000}).kept.collect()
    assert {r["method"] for r in kept} == {"a"} and len(kept) == 5
    empty = run(spark, [], {"a": 10})
    assert empty.kept.count() == 0 and empty.groups.count() == 0


def test_equally_late_rows_take_the_highest_usable_score(spark):
    rows = [("c", "a", 1, 1.0, T0, 0, ""), ("c", "a", 1, math.nan, T0, 0, ""), ("c", "a", 1, 3.0, T0, 0, "")]
    assert run(spark, rows, {"a": 0}).kept.collect()[0]["score"] == 3.0
