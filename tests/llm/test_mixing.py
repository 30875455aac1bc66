from __future__ import annotations

import random
from collections import defaultdict

import pytest

from skylode.llm.mixing import mix, water_fill


def test_water_filling_clamps_and_redistributes():
    got = water_fill({"a": 1, "b": 1, "c": 2, "d": 0}, {"a": 10, "b": 100, "c": 100, "d": 100}, 100)
    assert got == pytest.approx({"a": 10, "b": 30, "c": 60, "d": 0})
    assert water_fill({"a": 1, "b": 3}, {"a": 5, "b": 5}, 100) == {"a": 5, "b": 5}
    assert water_fill({"a": 1}, {}, 10) == {"a": 0}
    assert water_fill({}, {}, 10) == {}


@pytest.mark.parametrize("total", [None, 20_000, 10_000_000])
def test_shares_caps_and_totals(spark, total):
    rng = random.Random(0)
    docs = [(k, rng.choice(["Big ", "big", "mid", " SMALL", "free", None]), rng.randrange(1, 40), 0) for k in range(6000)]
    docs += [(9000, "big", 0, 0), (9001, "mid", None, 0), (None, "mid", 5, 0), docs[0]]
    weights = [("big", 5.0, 2), ("Mid", 3.0, None), ("small", 2.0, 3), ("small ", None, 5), ("absent", 1.0, 1), ("free", 0.0, 2), (None, 1.0, 1)]
    got = mix(spark.createDataFrame(docs, "key long, source string, size long, copies int"), spark.createDataFrame(weights, "source string, weight double, max_repeats int"), total)
    copies, report = got.copies.collect(), {r["source"]: r for r in got.report.collect()}
    caps = {"big": 2, "mid": 1, "small": 3}
    used = defaultdict(int)
    for r in copies:
        assert 1 <= r["copies"] <= caps[r["source"]]
        used[r["source"]] += r["size"] * r["copies"]
    assert set(report) == {"big", "mid", "small", "absent", "free"}
    for s, r in report.items():
        assert r["used"] == used[s]
        assert abs(r["used"] - r["planned"]) <= 40
        assert r["used"] <= r["tokens"] * r["max_repeats"]
    assert sum(r["share"] for r in report.values()) == pytest.approx(1)


def test_same_seed_same_choice(spark):
    docs = spark.createDataFrame([(k, "a", 10) for k in range(500)], "key long, source string, size long")
    w = spark.createDataFrame([("a", 1.0, 2)], "source string, weight double, max_repeats int")
    first = {tuple(r) for r in mix(docs.repartition(7), w, 2500, 1).copies.collect()}
    assert first == {tuple(r) for r in mix(docs, w, 2500, 1).copies.collect()}
    assert first != {tuple(r) for r in mix(docs, w, 2500, 2).copies.collect()}


def test_empty(spark):
    docs = spark.createDataFrame([], "key long, source string, size long")
    w = spark.createDataFrame([("a", 1.0, 2)], "source string, weight double, max_repeats int")
    assert mix(docs, w).copies.count() == 0
    assert mix(docs, w.limit(0)).report.count() == 0
