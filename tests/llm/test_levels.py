"""Water-filling by running totals against the loop over sources in memory, and splits of many labels."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import pytest
import pyspark.sql.functions as F

from skylode.llm.mixing import level, water_fill
from skylode.llm.splits import split_groups


@pytest.mark.parametrize("seed", range(3))
def test_level_equals_the_loop(spark, seed):
    rng = random.Random(seed)
    rows = [(f"s{k}", rng.choice([0.0, 1.0, rng.uniform(0.01, 5), 1000.0]), float(rng.choice([0, 10, rng.randrange(1, 10_000)]))) for k in range(400)]
    weights, caps = {s: w for s, w, _ in rows}, {s: c for s, _, c in rows}
    frame = spark.createDataFrame(rows, "source string, weight double, cap double")
    for total in (0.0, 1234.0, 200_000.0, 1e9):
        at = level(frame, total)
        want = water_fill(weights, caps, total)
        assert {s: min(caps[s], at * w) if w > 0 else 0.0 for s, w, _ in rows} == pytest.approx(want, rel=1e-9, abs=1e-9)


def test_no_label_is_merged(spark):
    rng = random.Random(9)
    sizes = [rng.choice([1, 1, 1, 2, 3]) for _ in range(9000)] + [700, 450, 300, 120]
    rows = []
    for g, n in enumerate(sizes):
        main = rng.randrange(150)
        rows += [(g, f"l{main if n < 100 and rng.random() < 0.9 else rng.randrange(150)}") for _ in range(n)]
    shares = {"train": 0.7, "devcal": 0.15, "final": 0.15, "none": 0.0}
    got = split_groups(spark.createDataFrame(rows, "g long, label string"), "g", F.col("label"), shares).collect()
    of = defaultdict(set)
    for r in got:
        of[r["g"]].add(r["assigned"])
    assert len(got) == len(rows) and all(len(s) == 1 for s in of.values())
    off = []
    for label in {x for _, x in rows}:
        n = Counter(r["assigned"] for r in got if r["label"] == label)
        off += [abs(n[s] - p * sum(n.values())) for s, p in shares.items()]
    # About 115 rows a label; a random assignment would be off by 3.8 on average.
    assert sum(off) / len(off) < 3.0 and max(off) < 20
    n = Counter(r["assigned"] for r in got)
    assert all(abs(n[s] / len(rows) - p) < 0.01 for s, p in shares.items())
