"""A merge that dies at any step is run again; periods of any size; what dead merges left."""

from __future__ import annotations

import pytest

from skylode.operators.sessions import SessionTable
from skylode.session import scratch_path

SCHEMA = "key string, time long, id string"
FIRST, SECOND = [("a", 0, "1"), ("a", 500, "2"), ("b", 90, "3")], [("a", 1000, "4"), ("b", 5000, "5"), ("a", 0, "1")]
WANT = {("a", 0, 1000, 3), ("b", 90, 90, 1), ("b", 5000, 5000, 1)}


class Death(Exception):
    pass


@pytest.mark.parametrize("step, after", [("_write", False), ("_write", True), ("_publish", False), ("sessions", False), ("sessions", True)])
def test_a_merge_that_died_is_run_again(spark, monkeypatch, step, after):
    table = SessionTable(spark, scratch_path(spark, "t"), 700, period=1000)
    table.merge(spark.createDataFrame(FIRST, SCHEMA))
    before = table.read().collect()
    name = "_write" if step == "sessions" else step
    real, calls = getattr(SessionTable, name), []

    def dies(self, *args):
        calls.append(1)
        if step == "sessions" and len(calls) == 1:
            return real(self, *args)
        if after:
            real(self, *args)
        raise Death

    monkeypatch.setattr(SessionTable, name, dies)
    with pytest.raises(Death):
        table.merge(spark.createDataFrame(SECOND, SCHEMA))
    monkeypatch.undo()
    assert table.read().collect() == before
    assert table.merge(spark.createDataFrame(SECOND, SCHEMA)) == 2
    assert {tuple(r) for r in table.read().collect()} == WANT
    # The micro-batch is delivered once more.
    table.merge(spark.createDataFrame(SECOND, SCHEMA))
    assert {tuple(r) for r in table.read().collect()} == WANT
    assert table.vacuum() > 0
    assert {tuple(r) for r in table.read().collect()} == WANT
