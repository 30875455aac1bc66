from __future__ import annotations

import random
from collections import Counter, defaultdict

import pyspark.sql.functions as F

from skylode.llm.splits import components, grouped, night_key, recorded_splits, sequence_edges, split_groups, split_key


def union_find(edges):
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for r, e in edges:
        up[find(("r", r))] = find(("e", e))
    groups = defaultdict(list)
    for r, _ in edges:
        groups[find(("r", r))].append(r)
    return {r: min(rs) for rs in groups.values() for r in rs}


def test_components_equal_union_find(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(400), f"e{rng.randrange(500)}") for _ in range(450)]
    edges += [(1000 + k // 2, f"chain {(k + 1) // 2}") for k in range(120)]  # a long chain
    edges += [(rng.randrange(2000, 4000), "hot") for _ in range(1500)] + edges[:20]
    dirty = [*edges, (None, "x"), (5000, None)]
    want = union_find(edges)
    got = dict(components(spark.createDataFrame(dirty, "record long, entity string")).collect())
    tied = {g for g, n in Counter(want.values()).items() if n > 1}
    assert got.items() >= {r: g for r, g in want.items() if g in tied}.items()
    assert all(want[r] == g for r, g in got.items())


def test_no_edges_gives_single_groups(spark):
    records = spark.createDataFrame([(2, 9), (1, 9)], "id long, group int")
    got = grouped(records, spark.createDataFrame([], "record long, entity string"), "id")
    assert dict(got.select("id", "group").collect()) == {1: 1, 2: 2}


def test_readings(spark):
    df = spark.createDataFrame([(" s-0012 ", "Dev_Cal "), ("S 12", ""), ("12", None), (None, "train"), ("", "--")], "n string, s string")
    assert [tuple(r) for r in df.select(night_key(F.col("n")), split_key(F.col("s"))).collect()] == [("12", "devcal"), ("12", None), (None, None), (None, "train"), (None, None)]


def test_ties_and_recorded_splits(spark):
    sequences = spark.createDataFrame(
        [(5, "S1", ["a/x.h5", None], "train"), (6, "s-01", [], ""), (7, None, ["/b/x.h5"], "final"), (8, "S2", None, "train"), (9, " ", ["y.h5"], None)],
        "sequence_id long, night string, files array<string>, split string",
    )
    nights = spark.createDataFrame([("S000002", "devcal"), ("S2", "devcal"), ("S1", " "), (None, "train")], "name string, split string")
    groups = grouped(sequences, sequence_edges(sequences), "sequence_id").select("sequence_id", "group", "night", "split")
    assert dict(groups.select("sequence_id", "group").collect()) == {5: 5, 6: 5, 7: 5, 8: 8, 9: 9}
    assert {tuple(r) for r in recorded_splits(groups, nights).collect()} == {(5, "train"), (5, "final"), (8, "train"), (8, "devcal")}


def test_split_groups_keeps_groups_and_shares(spark):
    rng = random.Random(3)
    sizes = [rng.choice([1, 2, 3, 8, 40]) for _ in range(1500)]
    rows = [(g, rng.choice("abc"), "old") for g, n in enumerate(sizes) for _ in range(n)] + [(None, None, "old")] * 3
    shares = {"train": 0.7, "devcal": 0.15, "final": 0.15}
    got = split_groups(spark.createDataFrame(rows, "g long, label string, assigned string"), "g", F.col("label"), shares).collect()
    assert len(got) == len(rows)
    by = defaultdict(set)
    for r in got:
        by[r["g"]].add(r["assigned"])
    assert all(len(v) == 1 for v in by.values())
    for label in "abc":
        n = Counter(r["assigned"] for r in got if r["label"] == label)
        assert all(abs(n[s] / sum(n.values()) - p) < 0.02 for s, p in shares.items())


def test_split_of_nothing(spark):
    assert split_groups(spark.createDataFrame([], "g long, label string"), "g", F.col("label"), {"a": 1.0}).count() == 0
