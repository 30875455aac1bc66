from __future__ import annotations

import os
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
REPO = Path(__file__).resolve().parents[1]


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 90


@pytest.mark.skipif(not os.path.exists(DATA), reason="no test tables")
def test_flagship(spark):
    out = entry.entry(spark)
    assert out.columns[:3] == ["cadence", "map_id", "rank"] and out.count() > 0


@pytest.mark.skipif(not os.path.exists(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(n for plan in entry._PLANS for n in plan.QUERIES))
def test_query_equals_sql(spark, name):
    import duckdb

    got = entry.queries()[name](spark, DATA)
    rows = got.collect()
    if name not in entry.oracle_sql():
        return
    con = duckdb.connect()
    for f in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    r = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in r.description]
    assert sorted(names) == sorted(got.columns)
    key = lambda row: tuple("nan" if isinstance(v, float) and v != v else v for v in row)
    want = sorted((key(x) for x in r.fetchall()), key=repr)
    assert sorted((key(tuple(x[n] for n in names)) for x in rows), key=repr) == want


def test_the_rest_stands_without_the_subpackage():
    code = "import sys; sys.modules['skylode.llm'] = None; import __spark_entry__ as e; print(sorted(n for n in e.queries() if n.startswith('p') and n[1].isdigit()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=REPO, capture_output=True, text=True, check=True)
    assert out.stdout.strip() == "['p3_durations', 'p3_found']"
