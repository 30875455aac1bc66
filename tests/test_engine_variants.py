"""Patches, incomplete windows, frequencies, and the search of many patched variants against full searches."""

from __future__ import annotations

import numpy as np
import pytest
import pyspark.sql.functions as F

from skylode.engine import SearchEngine, peak_frequencies
from skylode.functions.preprocess import bandpass
from skylode.functions.scorers import PooledSquares
from skylode.rules import Rule
from skylode.session import materialize

CADENCE, NCHANS, BLOCK = "blc00_57000_00001_A", 10_240, 2048
PATCH = "cadence string, obs int, c0 long, patch array<array<double>>"


def blocks_of(spark, obs):
    rows = [(CADENCE, i, c, p[:, c : c + BLOCK].astype(np.float32).tolist()) for i, p in enumerate(obs) for c in range(0, NCHANS, BLOCK)]
    return materialize(spark.createDataFrame(rows, "cadence string, obs int, chan_start long, power array<array<float>>"), "toy")


def noise(seed=0):
    rng = np.random.default_rng(seed)
    return [rng.uniform(size=(16, NCHANS)) + 1.0 for _ in range(6)]


def flat(width, value):
    return np.full((16, width), float(value)).tolist()


def test_a_block_takes_several_patches(spark):
    obs = noise()
    blocks = blocks_of(spark, obs)
    patches = [(CADENCE, 0, 300, flat(40, 9)), (CADENCE, 0, 320, flat(40, 7)), (CADENCE, 0, 1990, flat(58, 5)), (CADENCE, 3, 4096, flat(1, 3))]
    got = SearchEngine(Rule(), PooledSquares()).overlay(blocks, spark.createDataFrame(patches, PATCH)).collect()
    want = [o.astype(np.float32).copy() for o in obs]
    for _, o, c, p in patches:
        want[o][:, c : c + len(p[0])] = p
    assert len(got) == 6 * NCHANS // BLOCK
    for r in got:
        assert np.array_equal(np.array(r["power"], np.float32), want[r["obs"]][:, r["chan_start"] : r["chan_start"] + BLOCK])
    engine = SearchEngine(Rule(), PooledSquares())
    scores = engine.scores(blocks)
    again = engine.rescore(scores, blocks, spark.createDataFrame(patches, PATCH))
    assert again.count() == scores.count() == (NCHANS - 1024) // 512 + 1


@pytest.mark.parametrize("rule", [Rule(far_quantile=0.8, off_ceiling_probe=4), Rule(far_quantile=0.9, cfar_half=2, cfar_k=4.0, off_ceiling_probe=4)])
def test_variants_equal_full_searches(spark, rule):
    obs = noise(1)
    for o in obs:
        o[:, 8000] += 50
    blocks = blocks_of(spark, obs)
    engine = SearchEngine(rule, PooledSquares())
    scores = engine.scores(blocks)
    _, saved = engine.select(scores, blocks)
    variants = {
        1: [(CADENCE, o, 3000, flat(30, 60)) for o in (0, 2, 4)],
        2: [(CADENCE, o, c, flat(20, 40)) for o in (0, 2) for c in (2040 - 20, 2048, 8190 - 20)],
    }
    rows = [(v, *p) for v, ps in variants.items() for p in ps]
    bands = spark.createDataFrame([(CADENCE, 8000.0, -2.5)], "cadence string, fch1_mhz double, foff_hz double")
    got = engine.search_patched(scores, saved, blocks, spark.createDataFrame(rows, f"variant long, {PATCH}"), bands=bands).collect()
    cols = ["f_start_peak", "f_start_first", "f_start_last", "n_snippets", "n_on_hits_full", "n_off_hits_full", "in_short_list"]
    for v, ps in variants.items():
        changed = materialize(engine.overlay(blocks, spark.createDataFrame(ps, PATCH)), "changed")
        full = engine.select(engine.scores(changed), changed)[0].collect()
        mine = [r for r in got if r["variant"] == v]
        assert sorted(tuple(r[c] for c in cols) for r in mine) == sorted(tuple(r[c] for c in cols) for r in full)
        for key in ("peak_score", "off_ceiling", "far_thresh"):
            assert sorted(r[key] for r in mine) == pytest.approx(sorted(r[key] for r in full), rel=1e-9)
        assert all(r["freq_mhz_peak"] == pytest.approx(8000.0 - 2.5e-6 * r["f_start_peak"]) for r in mine)
    assert any(r["in_short_list"] for r in got if r["variant"] == 1)


def test_incomplete_windows_are_skipped_or_abort(spark):
    blocks = blocks_of(spark, noise()).where("NOT (obs = 2 AND chan_start = 4096)")
    scores = SearchEngine(Rule(), PooledSquares()).scores(blocks)
    assert {r[0] for r in scores.select("f_start").collect()} == {f for f in range(0, NCHANS - 1023, 512) if f + 1024 <= 4096 or f >= 6144}
    with pytest.raises(ValueError, match="windows lack channels"):
        SearchEngine(Rule(), PooledSquares(), incomplete="abort").scores(blocks)
    with pytest.raises(ValueError, match="incomplete is"):
        SearchEngine(Rule(), PooledSquares(), incomplete="maybe")
    with pytest.raises(Exception):  # noqa: B017  nothing to score
        SearchEngine(Rule(), PooledSquares(), incomplete="abort").scores(blocks.where("obs < 5"))


def test_frequencies_of_peaks(spark):
    found = spark.createDataFrame([("a", 1000), ("b", 5)], "cadence string, f_start_peak long")
    bands = spark.createDataFrame([("a", 1500.0, -2.0)], "cadence string, fch1_mhz double, foff_hz double")
    assert {r["cadence"]: r["freq_mhz_peak"] for r in peak_frequencies(found, bands).collect()} == {"a": pytest.approx(1499.998), "b": None}


def test_bandpass_is_fitted_again_after_each_masking():
    rng = np.random.default_rng(4)
    x = np.linspace(-1, 1, 200)
    level = 10 + x**2
    level[60:66] += 40
    level[120:124] += 2
    power = level + rng.normal(0, 0.05, (16, 200))
    med = np.median(power, axis=0)
    used = np.ones(200, bool)
    fit = np.polynomial.Polynomial.fit(x, med, 3)(x)
    for _ in range(3):
        rest = med - fit
        used = np.abs(rest) <= 3 * rest[used].std()
        fit = np.polynomial.Polynomial.fit(x[used], med[used], 3)(x)
    assert np.allclose(bandpass(power, 3), power / fit)
    assert not np.allclose(bandpass(power, 3, rounds=2), power / fit)
