from __future__ import annotations

import numpy as np
import pytest

from skylode.engine import SearchEngine
from skylode.functions.preprocess import bandpass, centred_log, normalise
from skylode.functions.scorers import PooledSquares, build, reduce_maps
from skylode.rules import RULES, Rule
from skylode.session import materialize

NCHANS, BLOCK = 20_480, 4096


def blocks_of(spark, cadences):
    rows = []
    for name, obs in cadences.items():
        for i, power in enumerate(obs):
            rows += [(name, i, c, power[:, c : c + BLOCK].astype(np.float32).tolist()) for c in range(0, NCHANS, BLOCK)]
    return materialize(spark.createDataFrame(rows, "cadence string, obs int, chan_start long, power array<array<float>>"), "toy")


def toy(seed=0):
    rng = np.random.default_rng(seed)
    obs = [rng.uniform(size=(16, NCHANS)) + 1.0 for _ in range(6)]
    for o in obs:
        o[:, 15_000] += 50
    for i in (0, 2, 4):
        obs[i][:, 5000] += 50
    return obs


@pytest.fixture(scope="module")
def engine():
    return SearchEngine(Rule(far_quantile=0.9, off_ceiling_probe=20), PooledSquares())


@pytest.fixture(scope="module")
def searched(spark, engine):
    blocks = blocks_of(spark, {"blc00_57000_00001_A": toy()})
    return blocks, engine.search(blocks).collect()


def test_on_only_signal_is_listed_and_persistent_line_leaks(searched):
    _, rows = searched
    listed = [r for r in rows if r["in_short_list"]]
    assert [r["f_start_first"] <= 5000 < r["f_start_last"] + 1024 and r["n_on_hits_full"] == 3 for r in listed] == [True]
    line = [r for r in rows if r["f_start_first"] <= 15_000 < r["f_start_last"] + 1024]
    assert line and all(r["off_leak"] for r in line)


def test_scores_equal_direct_computation(spark, engine, searched):
    obs = toy()
    got = {r["f_start"]: r["score"] for r in engine.scores(searched[0]).collect()}
    starts = range(0, NCHANS - 1024 + 1, 512)
    assert sorted(got) == list(starts)
    for f in list(starts)[::7]:
        frame = normalise(np.stack([o[:, f : f + 1024].astype(np.float32).astype(float) for o in obs]))
        assert got[f] == pytest.approx(reduce_maps(PooledSquares().anomaly_map(frame[None]), "topk")[0], rel=1e-6)


def test_incremental_equals_full(spark, engine, searched):
    blocks, _ = searched
    scores = engine.scores(blocks)
    patch = (np.full((16, 30), 9.0)).tolist()
    patches = spark.createDataFrame([("blc00_57000_00001_A", 0, 9000, patch)], "cadence string, obs int, c0 long, patch array<array<double>>")
    full = {(r["f_start"], round(r["score"], 9)) for r in engine.scores(engine.overlay(blocks, patches)).collect()}
    assert full == {(r["f_start"], round(r["score"], 9)) for r in engine.rescore(scores, blocks, patches).collect()}
    assert full != {(r["f_start"], round(r["score"], 9)) for r in scores.collect()}


def test_rules_round_trip_and_errors():
    for rule in RULES.values():
        assert Rule.from_json(rule.to_json()) == rule
    assert Rule.from_json("{}") == Rule()
    with pytest.raises(ValueError, match="unknown rule fields: nonsense"):
        Rule.from_json('{"nonsense": 1}')
    assert RULES["hybrid_v3"].shares_clusters(RULES["hybrid_v4"]) and not RULES["production"].shares_clusters(RULES["hybrid_v1"])


def test_normalisation_modes():
    rng = np.random.default_rng(0)
    shape = 1 + 0.5 * np.linspace(-1, 1, 256) ** 2
    window = np.stack([rng.normal(10, 1, (16, 256)) * shape * g for g in (1.0, 1.6) * 3])
    per, old = normalise(window), normalise(window, "legacy_concat", None)
    assert per.shape == old.shape == (96, 256)
    assert np.abs(np.median(per.reshape(6, -1), axis=1)).max() < 1e-9
    assert np.ptp(np.median(old.reshape(6, -1), axis=1)) > 1
    flat = bandpass(window[0])
    assert np.median(flat, axis=0).std() < np.median(window[0], axis=0).std() / 10
    with pytest.raises(ValueError):
        normalise(window, "other")
    with pytest.raises(ValueError):
        bandpass(window[0], method="other")
    assert np.isfinite(centred_log(np.zeros((2, 2)))).all()


def test_scorers():
    maps = np.arange(12, dtype=float).reshape(1, 3, 4)
    assert reduce_maps(maps, "max")[0] == 11 and reduce_maps(maps, "recon")[0] == 5.5 and reduce_maps(maps, "topk", 0.25)[0] == 10
    assert build("pooled_squares", rows=2, columns=2).anomaly_map(np.ones((1, 4, 4))).shape == (1, 2, 2)
    with pytest.raises(ValueError):
        build("nothing")
    with pytest.raises(ValueError):
        reduce_maps(maps, "nothing")
