from __future__ import annotations

import os
from pathlib import Path

import pytest

from skylode.llm import queries

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.exists(DATA), reason="no test tables")


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, name):
    import duckdb

    got = queries.QUERIES[name](spark, DATA)
    rows = got.collect()
    con = duckdb.connect()
    for f in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    r = con.execute(queries.SQL[name])
    names = [d[0] for d in r.description]
    assert sorted(names) == sorted(got.columns)
    key = lambda row: tuple("nan" if isinstance(v, float) and v != v else v for v in row)
    want = sorted((key(x) for x in r.fetchall()), key=repr)
    assert sorted((key(tuple(x[n] for n in names)) for x in rows), key=repr) == want


def test_splits_keep_groups_and_shares(spark):
    rows = queries.p4_splits(spark, DATA).collect()
    groups: dict[int, set] = {}
    for r in rows:
        groups.setdefault(r["group_id"], set()).add(r["split"])
    assert all(len(s) == 1 for s in groups.values())
    assert len(rows) == spark.read.parquet(f"{DATA}/sequences.parquet").count()


def test_redaction_leaves_nothing_to_find(spark):
    found = queries.p8_found(spark, DATA)
    assert found.columns == ["doc_id", "kind", "start_pos"] and found.count() > 0
    texts = queries.p8_redacted(spark, DATA)
    assert queries.pii.find_items(texts, "doc_id", "text").where("kind <> 'name'").count() == 0


def test_every_document_is_encoded(spark):
    ids = queries.p6_ids(spark, DATA)
    assert dict(ids.dtypes) == {"doc_id": "bigint", "ids": "array<int>"}
    assert ids.count() == spark.read.parquet(f"{DATA}/documents.parquet").count()


def test_mix_holds_the_caps(spark):
    shares = queries.p7_shares(spark, DATA).collect()
    assert abs(sum(r["share"] for r in shares) - 1) < 1e-9
    assert all(r["used"] <= r["tokens"] * r["max_repeats"] and r["most_copies"] <= r["max_repeats"] for r in shares)
