"""Statistics of groups above the size that is sorted as one array: the same as of small ones."""

from __future__ import annotations

import numpy as np
import pyspark.sql.functions as F
import pytest

from skylode.operators import robust

KEYS = ["cadence", "method"]


def close(a, b):
    key = lambda r: tuple(str(r[k]) for k in KEYS if k in r)
    a, b = (sorted((r.asDict() for r in x.collect()), key=key) for x in (a, b))
    assert len(a) == len(b) > 0
    for x, y in zip(a, b, strict=True):
        assert [str(x[k]) for k in KEYS] == [str(y[k]) for k in KEYS]
        assert [v for k, v in x.items() if k not in KEYS] == pytest.approx([y[k] for k in x if k not in KEYS], rel=1e-12)


def scores(spark):
    rng = np.random.default_rng(7)
    rows = [("big", "m", 512 * k, float(x)) for k, x in enumerate(rng.standard_cauchy(3000))]
    rows += [("big", "n", 512 * k, float(x)) for k, x in enumerate(rng.integers(0, 5, 900))]
    rows += [(f"c{k % 7}", "m", 512 * k, float(x)) for k, x in enumerate(rng.normal(size=300))]
    return spark.createDataFrame(rows, "cadence string, method string, f_start long, score double")


def test_stats_and_thresholds(spark):
    df = scores(spark)
    rules = spark.createDataFrame([("m", 0.99), ("n", 0.9)], "method string, far_quantile double")
    close(robust.robust_stats(df, KEYS, most=200), robust.robust_stats(df, KEYS))
    close(robust.thresholds(df, rules, most=200).select(*KEYS, "n", "median", "far_thresh", "n_3", "n_5", "n_far"), robust.thresholds(df, rules).select(*KEYS, "n", "median", "far_thresh", "n_3", "n_5", "n_far"))


def test_ceilings(spark):
    df = scores(spark).withColumn("v", F.abs("score"))
    close(robust.clipped_ceiling(df, KEYS, "v", most=200), robust.clipped_ceiling(df, KEYS, "v"))
    same = df.withColumn("v", F.lit(2.0))
    close(robust.clipped_ceiling(same, KEYS, "v", most=200), robust.clipped_ceiling(same, KEYS, "v"))


@pytest.mark.parametrize("half", [3, 30])
def test_blocks_of_neighbours(spark, half):
    df = scores(spark).where("method = 'm'")
    close(robust.local_stats(df, KEYS, "f_start", "score", half, 1 << 16, 50).orderBy(*KEYS, "f_start"), robust.local_stats(df, KEYS, "f_start", "score", half).orderBy(*KEYS, "f_start"))


def test_nothing(spark):
    df = scores(spark).limit(0)
    rules = spark.createDataFrame([("m", 0.99)], "method string, far_quantile double")
    assert robust.thresholds(df, rules).count() == robust.robust_stats(df, KEYS).count() == robust.clipped_ceiling(df, KEYS, "score").count() == robust.local_stats(df, KEYS, "f_start", "score", 4).count() == 0
