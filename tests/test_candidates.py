from __future__ import annotations

import math
from datetime import datetime

from skylode.plans import candidates

CLUSTERS = "cluster_id long, cadence string, method string, f_start_peak long, f_start_first long, f_start_last long, run_at timestamp, peak_score double, on_off_contrast double, in_short_list boolean"


def clusters(spark, folder, rows):
    """Clusters of one window each: cadence, method, place, contrast, whether listed."""
    full = [(k, cadence, method, at, at, at, None, 1.0, contrast, listed) for k, (cadence, method, at, contrast, listed) in enumerate(rows)]
    spark.createDataFrame(full, CLUSTERS).write.parquet(f"{folder}/method_clusters.parquet")


def test_detection_floor_has_no_cap(spark, tmp_path):
    rows = [("strong", 19.5, False), ("strong", 20.5, False), ("strong", 23.2, True), ("strong", 23.9, False), ("strong", 40.0, True), ("weak", 3.5, True), ("none", 50.0, False), ("none", math.nan, True), ("none", math.inf, True), ("none", None, True)]
    clusters(spark, tmp_path, [("c", m, 5000 * k, x, listed) for k, (m, x, listed) in enumerate(rows)])
    assert {r["method"]: r["level"] for r in candidates.detection_floor(spark, str(tmp_path)).collect()} == {"strong": 23, "weak": 3, "none": None}


def test_regions_are_answered_for_every_method(spark, tmp_path):
    methods = ["udma_topk", "ae_recon", "udma_recon", "vit_cadence"]
    spark.createDataFrame([(m,) for m in methods], "method string").write.parquet(f"{tmp_path}/selection_rules.parquet")
    # The region at 10,000; udma_recon's cluster there touches ae_recon's, vit_cadence's doesn't.
    places = [("c", "udma_topk", 10_000), ("c", "ae_recon", 10_800), ("c", "udma_recon", 10_200), ("c", "vit_cadence", 9_100), ("d", "ae_recon", 9_100)]
    clusters(spark, tmp_path, [(c, m, at, 2.0, True) for c, m, at in places])
    scores = [("c", m, at, datetime(2026, 1, 1), float(k + at)) for k, m in enumerate(methods) for at in (8_976, 9_488, 10_512, 11_024)] + [("d", "ae_recon", 10_000, datetime(2026, 1, 1), 1e6)]
    spark.createDataFrame(scores, "cadence string, method string, f_start long, scored_at timestamp, score double").write.parquet(f"{tmp_path}/window_scores.parquet")
    merges = {(r["region"], r["method"]): r["merged"] for r in candidates.region_merges(spark, str(tmp_path)).collect()}
    assert merges == {(0, "ae_recon"): True, (0, "udma_recon"): True, (0, "vit_cadence"): False}
    windows = {(r["region"], r["method"]): (r["n_windows"], r["max_window_score"]) for r in candidates.region_windows(spark, str(tmp_path)).collect()}
    assert windows == {(0, m): (2, 10_512.0 + k) for k, m in enumerate(methods)}
