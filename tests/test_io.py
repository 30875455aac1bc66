from __future__ import annotations

import pytest

from skylode.session import scratch_path
from skylode.sources import files, sinks


def test_manifest_listing_headers_and_channels(spark, tmp_path):
    (tmp_path / "m.txt").write_text("a b  c\n\n  d\te \n")
    assert [(r["manifest_row"], list(r["paths"])) for r in files.read_manifest(spark, str(tmp_path / "m.txt")).collect()] == [(0, ["a", "b", "c"]), (1, ["d", "e"])]
    (tmp_path / "deep/er").mkdir(parents=True)
    for n in ("x.0000.h5", "y.0001.h5", "z.txt"):
        (tmp_path / "deep/er" / n).write_bytes(b"12345")
    assert files.list_files(spark, str(tmp_path)).count() == 2
    assert [r["length"] for r in files.list_files(spark, str(tmp_path), product="0001").collect()] == [5]
    names = [c.split()[0] for c in files.HEADERS.split(", ")]
    row = dict.fromkeys(names, "")
    cases = ({"header_id": 1}, {"header_id": 2, "parse_error": "bad"}, {"header_id": 3, "nchans": "many"})
    lines = [",".join(names), *(",".join(str((row | {"file": "f"} | c)[n]) for n in names) for c in cases)]
    (tmp_path / "h.csv").write_text("\n".join(lines))
    good, bad = files.read_headers(spark, str(tmp_path / "h.csv"))
    assert [r["header_id"] for r in good.collect()] == [1] and {r["header_id"] for r in bad.collect()} == {2, 3}
    blocks = str(tmp_path / "blocks")
    spark.createDataFrame([("c", 0, k * 100) for k in range(10)], "cadence string, obs int, chan_start long").write.parquet(blocks)
    assert sorted(r["chan_start"] for r in files.read_channels(spark, blocks, 250, 401, 100).collect()) == [200, 300, 400]
    flags = spark.createDataFrame([("True",), (" false",), ("x",), (None,)], "b string").select(files.bool_of_text("b")).collect()
    assert [r[0] for r in flags] == [True, False, None, None]


def test_sinks(spark):
    df = spark.createDataFrame([(1, "a", 5), (2, "b", 6)], "id long, cadence string, f_start long")
    path = scratch_path(spark, "once")
    sinks.write_once(df, path)
    with pytest.raises(Exception, match="(?i)exist"):
        sinks.write_once(df, path)
    out = scratch_path(spark, "published")
    sinks.publish(df, out, ["cadence"])
    assert spark.read.parquet(out).count() == 2 and not sinks.exists(spark, f"{out}.partial")
    with pytest.raises(FileExistsError):
        sinks.publish(df, out)
    log = scratch_path(spark, "log")
    sinks.append_new(df.unionByName(df), log, "id")
    sinks.append_new(spark.createDataFrame([(2, "x", 0), (3, "c", 7)], df.schema), log, "id")
    assert sorted((r["id"], r["cadence"]) for r in spark.read.parquet(log).collect()) == [(1, "a"), (2, "b"), (3, "c")]
    assert [r["id"] for r in sinks.missing_keys(spark.createDataFrame([(3,), (4,)], "id long"), log, ["id"]).collect()] == [4]
    parts = scratch_path(spark, "parts")
    sinks.replace_partitions(df, parts, ["cadence"])
    sinks.replace_partitions(spark.createDataFrame([(9, "b", 1)], df.schema), parts, ["cadence"])
    assert sorted(r["id"] for r in spark.read.parquet(parts).collect()) == [1, 9]
    split = scratch_path(spark, "split")
    sinks.by_cadence(df, split)
    assert spark.read.parquet(split).where("cadence = 'a'").count() == 1
    folder = scratch_path(spark, "run")
    sinks.guard_identity(spark, folder, {"rule": 1})
    sinks.guard_identity(spark, folder, {"rule": 1})
    with pytest.raises(ValueError):
        sinks.guard_identity(spark, folder, {"rule": 2})
    assert '"spark"' in sinks.provenance(spark, {"t": "x"})
