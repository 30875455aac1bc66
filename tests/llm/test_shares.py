"""The shares that problem 4 reaches over the test tables, for all rows and for each product."""

from __future__ import annotations

import os
from collections import Counter, defaultdict

import pytest

from skylode.llm import queries

DATA = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.exists(DATA), reason="no test tables")


def test_shares_by_product(spark):
    rows = queries.p4_splits(spark, DATA).collect()
    splits, by = defaultdict(set), defaultdict(Counter)
    for r in rows:
        splits[r["group_id"]].add(r["split"])
        by[r["product"]][r["split"]] += 1
        by[None][r["split"]] += 1
    assert all(len(s) == 1 for s in splits.values())
    assert len(rows) == spark.read.parquet(f"{DATA}/sequences.parquet").count()
    for product, n in by.items():
        total = sum(n.values())
        for split, share in queries.SHARES.items():
            # Within four rows, or two per cent, of the share.
            assert abs(n[split] - share * total) <= max(4, 0.02 * total), (product, n)
