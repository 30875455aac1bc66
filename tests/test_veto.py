from __future__ import annotations

import random

import numpy as np
import pytest

from skylode.operators.candidates import veto_counts
from skylode.operators.islands import count_at_most

SCHEMA = "cadence string, method string, f_start_peak long, f_start_first long, f_start_last long"


def brute(rows, width, tolerance, by_target):
    out = {}
    part = lambda c: (c.split("_")[0], c.split("_")[1])
    target = lambda c: "_".join(c.split("_")[3:])
    for c, m, p, a, z in rows:
        seen = set()
        for c2, m2, _, a2, z2 in rows:
            if m2 == m and part(c2) == part(c) and part(c)[1].isdigit() and c2 != c and a2 < z + width + tolerance and z2 + width > a - tolerance:
                seen.add(target(c2) if by_target else c2)
        out[c, m, p] = len(seen - {target(c)} if by_target else seen)
    return out


@pytest.mark.parametrize("by_target", [False, True])
@pytest.mark.parametrize("tolerance", [0, 700])
def test_equals_all_pairs(spark, tolerance, by_target):
    rng = random.Random(tolerance)
    rows = {}
    for _ in range(500):
        cadence = f"blc0{rng.randrange(2)}_{rng.choice(['57000', '57001', 'x'])}_{rng.randrange(9)}_T{rng.randrange(5)}_A"
        a = rng.choice([4096, rng.randrange(0, 60_000)])
        rows[cadence, "m", a] = (cadence, "m", a, a - rng.randrange(0, 900), a + rng.choice([0, 512, 20_000 * (rng.random() < 0.1)]))
    rows = list(rows.values())
    got = veto_counts(spark.createDataFrame([tuple(map(lambda x: x if isinstance(x, str) else int(x), r)) for r in rows], SCHEMA), 1024, tolerance, 2048, by_target)
    assert {(r["cadence"], r["method"], r["f_start_peak"]): r["n_other"] for r in got.collect()} == brute(rows, 1024, tolerance, by_target)


def test_a_line_in_every_cadence_forms_no_pairs(spark):
    rows = [(f"blc00_57000_{k}_T{k}", "m", 5000, 5000 + k % 7, 5000 + k % 7) for k in range(500)]
    got = veto_counts(spark.createDataFrame(rows, SCHEMA), 1024).collect()
    assert [r["n_other"] for r in got] == [499] * 500
    assert veto_counts(spark.createDataFrame([], SCHEMA), 1024).count() == 0


def test_counts_by_blocks():
    rng = np.random.default_rng(0)
    for n in (1, 2, 7, 64, 333):
        v = rng.integers(0, 50, n)
        i, j, x = rng.integers(0, n + 1, 200), rng.integers(0, n + 1, 200), rng.integers(-2, 53, 200)
        assert count_at_most(v, i, j, x).tolist() == [int((v[a:b] <= c).sum()) for a, b, c in zip(i, j, x, strict=True)]
    assert count_at_most(np.zeros(0, int), np.zeros(3, int), np.zeros(3, int), np.ones(3, int)).tolist() == [0, 0, 0]
