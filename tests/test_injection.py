from __future__ import annotations

import json

import numpy as np
import pytest

from skylode.engine import SearchEngine
from skylode.functions import morphologies as M
from skylode.functions.scorers import PooledSquares
from skylode.operators import injection
from skylode.rules import Rule
from skylode.session import materialize


@pytest.mark.parametrize("name", M.NAMES)
def test_signals_are_on_only_and_repeatable(name):
    rng = np.random.default_rng(0)
    window = rng.chisquare(2, (6, 16, 1024))
    site = M.sample_site(name, 7, 1024, 16)
    assert site == M.sample_site(name, 7, 1024, 16) != M.sample_site(name, 8, 1024, 16)
    for pattern, on in M.PATTERNS.items():
        out, info = M.inject(window, site, 30.0, pattern)
        assert [i for i in range(6) if (out[i] != window[i]).any()] == list(on)
        assert (out >= window).all() and info["pattern"] == pattern
    assert M.changed_span(window, M.inject(window, site, 0.0, "3on")[0]) is None
    assert json.loads(M.canonical_json(site)) == site


def test_seeds_profiles_and_bursts():
    assert M.hash_seed(1, "a") == int(__import__("hashlib").sha256(b"1|a").hexdigest()[:8], 16)
    x = np.array([0.0, 1.0])
    for kind in ("gaussian", "sinc2", "lorentzian", "box"):
        assert M.profile(kind, x * 0, 2.0)[0] == 1 and M.profile(kind, x, 2.0)[1] == pytest.approx(1.0 if kind == "box" else 0.5, abs=0.01)
    with pytest.raises(ValueError):
        M.sample_site("nothing", 1, 64, 16)
    freqs = np.array([1400.0, 1200.0])
    burst = M.dispersed_burst(freqs, 400, 1e-3, 50, 100.0, 3.0, 1e-4, 1400.0)
    delay = M.DISPERSION * 100 * (1200.0**-2 - 1400.0**-2) / 1e-3
    assert burst[:, 1].argmax() - burst[:, 0].argmax() == pytest.approx(delay, abs=1.5)


def test_catalogue_patches_and_recovery(spark):
    rng = np.random.default_rng(1)
    n, block = 8192, 2048
    rows = [("blc00_57000_1_A", o, c, (rng.uniform(size=(16, block)) + 1).astype(np.float32).tolist()) for o in range(6) for c in range(0, n, block)]
    blocks = materialize(spark.createDataFrame(rows, "cadence string, obs int, chan_start long, power array<array<float>>"), "blocks")
    engine = SearchEngine(Rule(far_quantile=0.8, off_ceiling_probe=5), PooledSquares())
    starts = spark.createDataFrame([("blc00_57000_1_A", 1536), ("blc00_57000_1_A", 5120)], "cadence string, f_start long")
    cat = injection.catalogue(injection.sites(starts, 1024, 16), ["3on", "1on_0"], [0, 300])
    assert cat.count() == 2 * 8 * 2 * 2 and cat.select("injection_id").distinct().count() == cat.count()
    with pytest.raises(ValueError):
        injection.catalogue(starts, ["4on"], [1])
    one = materialize(cat.where("morphology = 'narrowband_drift' AND pattern = '3on' AND snr = 300 AND c0 = 1536"), "one")
    got = injection.split_at_blocks(injection.patches(engine.windows(blocks), one, 1024, 16), block)
    pieces = got.collect()
    assert {r["obs"] for r in pieces} == {0, 2, 4} and all(r["c0"] // block == (r["c0"] + len(r["patch"][0]) - 1) // block for r in pieces)
    assert injection.patches(engine.windows(blocks), cat.where("snr = 0"), 1024, 16).count() == 0
    found = engine.search(engine.overlay(blocks, materialize(got, "patches")))
    site = json.loads(one.first()["site_meta"])
    at = 1536 + site["centre"]
    assert any(r["f_start_first"] <= at < r["f_start_last"] + 1024 and r["n_on_hits_full"] == 3 for r in found.collect())
    spoilt = one.withColumn("site_seed", one["site_seed"] + 1)
    with pytest.raises(Exception, match="differs from its catalogue"):
        injection.patches(engine.windows(blocks), spoilt, 1024, 16).collect()
