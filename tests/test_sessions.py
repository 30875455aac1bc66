from __future__ import annotations

import random
from collections import defaultdict

import pytest

from skylode.operators.islands import island_starts, overlap_join, running_total
from skylode.operators.sessions import SessionTable, merge_intervals, sessions_by_batches
from skylode.session import scratch_path
from skylode.streaming.sessions import feed
import pyspark.sql.functions as F


def brute(events, gap):
    by = defaultdict(set)
    for k, t, i in events:
        if k is not None and t is not None:
            by[k].add((t, i))
    out = set()
    for k, xs in by.items():
        xs = sorted(xs, key=lambda x: (x[0], str(x[1])))
        start, last, n = xs[0][0], xs[0][0], 0
        for t, _ in xs:
            if t - last > gap:
                out.add((k, start, last, n))
                start, n = t, 0
            last, n = t, n + 1
        out.add((k, start, last, n))
    return out


def events_of(seed, n=1200):
    rng = random.Random(seed)
    rows = [(rng.choice(["hot"] * 5 + ["a", "b", None]), rng.choice([None] + [rng.randrange(-200_000, 900_000)] * 9), f"e{k}") for k in range(n)]
    rows += [("hot", 700 * k, f"g{k}") for k in range(30)] + [("edge", 0, "x"), ("edge", 700, "y"), ("edge", 1401, "z"), ("a", 5, None)]
    return rows + rows[::6]


@pytest.mark.parametrize("seed", range(2))
@pytest.mark.parametrize("batches", [1, 3])
def test_incremental_table_equals_brute_force(spark, seed, batches):
    events = events_of(seed)
    rng = random.Random(seed)
    rng.shuffle(events)
    table = SessionTable(spark, scratch_path(spark, "t"), 700, period=100_000)
    for b in range(batches):
        table.merge(spark.createDataFrame(events[b::batches], "key string, time long, id string"))
    assert {tuple(r) for r in table.read().select("key", "start", "end", "n").collect()} == brute(events, 700)
    assert table.read().count() == len(brute(events, 700))


def test_merging_again_changes_nothing(spark):
    events = spark.createDataFrame(events_of(1, 200), "key string, time long, id string")
    table = SessionTable(spark, scratch_path(spark, "t"), 700)
    table.merge(events)
    before = {tuple(r) for r in table.read().collect()}
    assert table.merge(events) == 2 and {tuple(r) for r in table.read().collect()} == before


def test_a_batch_bridges_stored_sessions_over_periods(spark):
    table = SessionTable(spark, scratch_path(spark, "t"), 10, period=100)
    schema = "key string, time long, id string"
    table.merge(spark.createDataFrame([("a", 95, "1"), ("a", 112, "2"), ("b", 500, "3")], schema))
    assert table.read().count() == 3
    table.merge(spark.createDataFrame([("a", 104, "4")], schema))
    assert {tuple(r) for r in table.read().collect()} == {("a", 95, 112, 3), ("b", 500, 500, 1)}


def test_readers_see_whole_versions_only(spark):
    table = SessionTable(spark, scratch_path(spark, "t"), 10)
    schema = "key string, time long, id string"
    table.merge(spark.createDataFrame([("a", 1, "1")], schema))
    old, frame = table.manifest(), table.read()
    table.merge(spark.createDataFrame([("a", 5, "2")], schema))
    assert [tuple(r) for r in table.read(old).collect()] == [("a", 1, 1, 1)] == [tuple(r) for r in frame.collect()]
    with pytest.raises(Exception):  # noqa: B017  another writer took this version
        table._publish(old | {"version": 2})
    with pytest.raises(ValueError, match="has gap 10"):
        SessionTable(spark, table.path, 11).manifest()


def test_empty_batches_and_tables(spark):
    schema = "key string, time long, id string, at timestamp"
    table = sessions_by_batches(spark.createDataFrame([], schema), "at", 700, 2)
    assert table.read().count() == 0 and table.read().columns == ["key", "start", "end", "n"]


def test_stream_feeds_the_table(spark):
    path, state = scratch_path(spark, "in"), scratch_path(spark, "state")
    table = SessionTable(spark, scratch_path(spark, "t"), 700)
    events = events_of(3, 150)
    schema = "key string, time long, id string"
    for part in (events[::2], events[1::2]):
        spark.createDataFrame(part, schema).write.mode("append").parquet(path)
        feed(spark.readStream.schema(schema).parquet(path), table, state).awaitTermination()
    assert {tuple(r) for r in table.read().collect()} == brute(events, 700)


def test_interval_merging_with_long_intervals(spark):
    rng = random.Random(5)
    rows = [("k", s := rng.randrange(0, 500_000), s + rng.choice([0, 5, 90_000]), 1) for _ in range(60)] + [("k", 3, None, 1), (None, 1, 2, 1), ("k", None, 5, 1)]
    got = {tuple(r) for r in merge_intervals(spark.createDataFrame(rows, "key string, start long, end long, n long"), 100, 1000).collect()}
    want, cur = set(), None
    for s, e in sorted((s, s if e is None else e) for k, s, e, _ in rows if k and s is not None):
        if cur and s <= cur[1] + 100:
            cur = (cur[0], max(cur[1], e), cur[2] + 1)
        else:
            if cur:
                want.add(("k", *cur))
            cur = (s, e, 1)
    assert got == want | {("k", *cur)}


@pytest.mark.parametrize("seed", range(2))
def test_islands_running_totals_and_overlaps(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.choice("aab"), rng.randrange(0, 40_000), rng.randrange(1, 900)) for _ in range(400)]
    df = spark.createDataFrame(rows, "k string, p long, w long")
    got = {(r["k"], r["p"]): r["island"] for r in island_starts(df, ["k"], "p", 64, 1000).collect()}
    for k in "ab":
        last = start = None
        for p in sorted({p for x, p, _ in rows if x == k}):
            start = p if last is None or p - last > 64 else start
            assert got[k, p] == start
            last = p
    totals = running_total(df, ["k"], [F.desc("p")], (-F.floor(F.col("p") / 500)), "w", "t").collect()
    assert all(r["t"] == sum(w for k, p, w in rows if k == r["k"] and p >= r["p"]) for r in totals)
    left = df.select("k", F.col("p").alias("lo"), (F.col("p") + F.col("w")).alias("hi")).distinct()
    right = df.select("k", F.col("p").alias("a"), (F.col("p") + 2 * F.col("w")).alias("z")).distinct()
    pairs = [tuple(r) for r in overlap_join(left, right, ["k"], "lo", "hi", "a", "z", 300).select("k", "lo", "hi", "a", "z").collect()]
    want = {(k, p, p + w, q, q + 2 * v) for k, p, w in rows for j, q, v in rows if j == k and q < p + w and q + 2 * v > p}
    assert len(pairs) == len(set(pairs)) and set(pairs) == want
