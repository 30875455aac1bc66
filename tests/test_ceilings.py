from __future__ import annotations

import numpy as np
import pytest

from skylode.plans import maps


def survey_ceiling(cells, scores):
    """off_ceiling by the survey's A-05 and A-06."""
    med = np.median(scores)
    five = med + 5 * 1.4826 * np.median(np.abs(scores - med))
    if len(cells) < 200:
        return five
    kept = np.ones(len(cells), bool)
    for _ in range(5):
        med = np.median(cells[kept])
        sigma = 1.4826 * np.median(np.abs(cells[kept] - med))
        new = np.abs(cells - med) <= 3 * sigma
        if sigma == 0 or new.sum() == kept.sum():
            break
        kept = new
    return max(np.quantile(cells[kept], 0.999), five)


def test_verdicts_use_the_surveys_ceiling(spark, tmp_path):
    # A whole cadence of 16 maps, three with two bright ON rows, and one of a single map, too few cells for a ceiling.
    rng = np.random.default_rng(4)
    x = rng.normal(size=(17, 6, 64))
    for k in (2, 5, 16):
        x[k, [0, 2], 9] = 12.0
    x[7, [0, 2], 9] = 2.8
    rows = [(int(i), int(i) // 6 % 3, v.tolist()) for i, v in enumerate(x.reshape(-1, 64))]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    amap = x * x
    scores = np.array([np.sort(a.ravel())[-4:].mean() for a in amap])
    ceiling = [survey_ceiling(amap[:16, 1::2].ravel(), scores[:16]), survey_ceiling(amap[16, 1::2].ravel(), scores[16:])]
    want, listed = {}, []
    for k, a in enumerate(amap):
        peaks, t = a.max(1), ceiling[k // 16]
        on, off = int((peaks[0::2] > t).sum()), int(((peaks[1::2] > t) & (peaks[1::2] >= 0.3 * peaks[0::2].min())).sum())
        want[k] = (on, off, on >= 2 and off < 2)
        listed += [k] * want[k][2]
    for query in (maps.verdict_production, maps.verdict_hit_reference):
        got = {r["map_id"]: r for r in query(spark, str(tmp_path)).collect()}
        assert set(got) == set(want) and all(r["off_ceiling"] == pytest.approx(ceiling[k // 16], abs=1e-6) for k, r in got.items())
    got = {r["map_id"]: (r["n_on_hits_full"], r["n_off_hits_full"], r["in_short_list"]) for r in maps.verdict_production(spark, str(tmp_path)).collect()}
    assert got == want and {2, 5} <= set(listed)
    assert sorted(r["map_id"] for r in maps.review_list(spark, str(tmp_path)).collect()) == listed
    recovered = {(r["pattern"], r["snr"]): r["n"] for r in maps.injection_recovery(spark, str(tmp_path)).collect()}
    assert set(recovered.values()) == {17 - len(listed)}
