"""Signal forms against their definitions; recovery by morphology against full searches; patches, delays, folds."""

from __future__ import annotations

import numpy as np
import pytest
import pyspark.sql.functions as F

from skylode.functions import morphologies as M
from skylode.operators import injection, models
from skylode.plans import recovery
from skylode.plans.search import CHANNELS, _blocks, _engine
from skylode.session import materialize


def test_voigt_is_the_convolution():
    x = np.linspace(-400, 400, 16_001)
    for gauss, lorentz in ((2.0, 0.5), (1.0, 1.0), (0.5, 2.0)):
        want = np.convolve(M.profile("gaussian", x, gauss), M.profile("lorentzian", x, lorentz), mode="same")
        want /= want.max()
        assert np.abs(M.profile("voigt", x, gauss, lorentz) - want).max() < 0.02
    assert np.allclose(M.voigt(x, 2.0, 0.0), M.profile("gaussian", x, 2.0))
    assert M.profile("lorentzian", np.array([1.5]), 2.0, 1.0)[0] == pytest.approx(0.5)


def test_scintillation_has_mean_one_and_its_timescale():
    gains = M.scintillation(3, 200_000, 10.0, 0.5)
    logs = np.log(gains)
    assert (gains > 0).all() and gains.mean() == pytest.approx(1, abs=0.05) and logs.std() == pytest.approx(0.5, abs=0.02)
    assert np.corrcoef(logs[:-10], logs[10:])[0, 1] == pytest.approx(np.exp(-1), abs=0.05)
    assert np.array_equal(gains, M.scintillation(3, 200_000, 10.0, 0.5))
    sites = [M.sample_site("narrowband_drift", s, 1024, 16) for s in range(60)]
    assert 10 < sum("scint_seed" in s for s in sites) < 50 and {"voigt", "gaussian"} <= {s["profile"] for s in sites}
    assert all(("scatter" in s) == (s["profile"] in ("voigt", "lorentzian")) for s in sites)


def test_burst_has_its_strength_along_the_track_and_its_band():
    rng = np.random.default_rng(0)
    freqs, step = np.linspace(1500, 1200, 64), 1e-3
    frame = rng.normal(10, 1, (512, 64))
    for seed in range(5):
        site = M.sample_burst(seed, 64, 512, step, 50.0)
        out, info = M.inject_burst(frame, site, 20.0, freqs, step)
        added = out - frame
        lo, hi = site["band"]
        assert (added[:, lo:hi].max(0) > 0).all() and not added[:, :lo].any() and not added[:, hi:].any()
        delays = np.rint(M.delay_steps(freqs, step, 50.0, 1500.0)).astype(int)
        summed = np.mean([np.concatenate([added[d:, c], np.zeros(d)]) for c, d in enumerate(delays)], axis=0)
        assert summed.max() == pytest.approx(20.0 * frame.mean(1).std()) and info["amplitude"] > 0
    away, info = M.inject_burst(frame, site | {"start": 1e6}, 20.0, freqs, step)
    assert info["amplitude"] == 0 and np.array_equal(away, frame)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = np.random.default_rng(5)
    out = str(tmp_path_factory.mktemp("tables"))
    rows = [(i, rng.uniform(0.5, 1.5, 64).astype(np.float32).tolist(), i % 10) for i in range(2 * 96 + 3)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{out}/embeddings.parquet")
    return out


def test_recovery_equals_full_searches(spark, folder):
    got = materialize(recovery.injected(spark, folder), "injected")
    assert got.count() == 2 * len(M.NAMES) * len(recovery.PATTERNS) * len(recovery.SNRS) == got.select("injection_id").distinct().count()
    rates = {(r["morphology"], r["pattern"], r["snr"]): r for r in recovery.recovery_by_morphology(spark, folder).collect()}
    assert len(rates) == len(M.NAMES) * 9 and all(r["n"] == 2 and r["listed"] <= r["detected"] for r in rates.values())
    assert not any(r["listed"] for k, r in rates.items() if k[1] == "1on_2")
    strong = got.where("snr = 80 AND morphology = 'narrowband_drift' AND pattern <> '2on_04'").orderBy("injection_id").limit(2).collect()
    engine, blocks = _engine(), _blocks(spark, folder)
    starts = engine.scores(blocks).groupBy("cadence").agg(F.min_by("f_start", F.struct("score", "f_start")).alias("f_start"))
    signals = injection.catalogue(injection.sites(materialize(starts, "s"), 64, 1), recovery.PATTERNS, recovery.SNRS)
    for r in strong:
        one = materialize(signals.where(F.col("injection_id") == r["injection_id"]), "one")
        patch = injection.split_at_blocks(injection.patches(engine.windows(blocks), one, 64, 1), CHANNELS)
        full = engine.search(engine.overlay(blocks.where(F.col("cadence") == r["cadence"]), materialize(patch, "patch"))).withColumn("variant", F.lit(r["injection_id"]))
        assert injection.outcomes(one, full, 64).select("detected", "listed").first() == (r["detected"], r["listed"])
    assert any(r["detected"] for r in strong)


def test_outcomes_of_an_empty_search(spark):
    cat = spark.createDataFrame([("a", "c", 0, "narrowband_drift", 1, '{"centre": 5.0}')], "injection_id string, cadence string, c0 long, morphology string, site_seed long, site_meta string")
    none = spark.createDataFrame([], "variant string, cadence string, f_start_first long, f_start_last long, in_short_list boolean")
    assert injection.outcomes(cat, none, 64).select("detected", "listed").collect() == [(False, False)]
    undecided = spark.createDataFrame([("a", "c", 0, 0, None)], none.schema)
    assert injection.outcomes(cat, undecided, 64).select("detected", "listed").collect() == [(True, False)]


def test_folds_do_not_depend_on_partitions(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 3))
    rows = [(i, v.tolist(), int(v[0] + 0.5 * rng.normal() > 0)) for i, v in enumerate(x)] + [(400, None, 1), (401, [0.0, 0.0, 0.0], None)]
    df = spark.createDataFrame(rows, "id long, v array<double>, y int")
    a, b = (models.cross_validated_auc(df.repartition(n), "v", "y", folds=3, key="id") for n in (1, 5))
    assert a == pytest.approx(b, abs=1e-6) and a > 0.9


def test_ridge_passes_over_rows_without_numbers(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 2))
    rows = [(v.tolist(), float(v @ [2.0, -1.0] + 3)) for v in x]
    schema = "x array<double>, y double"
    plain = models.ridge(spark.createDataFrame(rows, schema), "x", "y", 0.1)
    gaps = models.ridge(spark.createDataFrame([*rows, (None, 1.0), ([9.0, 9.0], None)], schema), "x", "y", 0.1)
    assert np.allclose(plain.coefficients, gaps.coefficients) and plain.intercept == pytest.approx(gaps.intercept)
