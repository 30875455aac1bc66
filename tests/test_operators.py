from __future__ import annotations

import math
import random

import numpy as np
import pyspark.sql.functions as F
import pytest

from skylode.functions.observations import observations
from skylode.operators import candidates, catalogue, evaluation, islands, maps, models, robust


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


@pytest.mark.parametrize("kind", ["normal", "ties", "cauchy", "close"])
def test_exact_quantiles_equal_numpy(spark, kind, monkeypatch):
    monkeypatch.setattr(robust, "GATHERED", 50)  # so that bins are narrowed down several times
    rng = np.random.default_rng(0)
    draw = {"normal": rng.normal, "ties": lambda size: rng.integers(0, 4, size).astype(float), "cauchy": rng.standard_cauchy, "close": lambda size: 1 + rng.integers(0, 900, size) * 2.0**-52}[kind]
    groups = {"a": draw(size=3000), "b": draw(size=7), "c": draw(size=1)}
    rows = [(k, float(x)) for k, xs in groups.items() for x in xs] + [("a", None), ("a", math.nan), ("d", None)]
    qs = {"q0": 0.0, "q25": 0.25, "q50": 0.5, "q999": 0.999, "q1": 1.0}
    got = {r["k"]: r for r in robust.exact_quantiles(frame(spark, rows, "k string, v double"), ["k"], "v", qs).collect()}
    assert set(got) == set(groups)
    for k, xs in groups.items():
        assert got[k]["n"] == len(xs)
        for name, q in qs.items():
            assert got[k][name] == pytest.approx(np.quantile(xs, q), rel=1e-12)


def test_quantile_of_everything(spark):
    df = frame(spark, [(float(k),) for k in range(11)], "v double")
    assert tuple(robust.exact_quantiles(df, [], "v", {"m": 0.5, "p": 0.95}).first()) == (11, 5.0, 9.5)


def test_robust_stats_and_thresholds(spark):
    rng = np.random.default_rng(1)
    xs = rng.standard_cauchy(500)
    df = frame(spark, [("c", "m", k * 512, float(x)) for k, x in enumerate(xs)], "cadence string, method string, f_start long, score double")
    rules = frame(spark, [("m", 0.95)], "method string, far_quantile double")
    r = robust.thresholds(df, rules).first()
    med = np.median(xs)
    sigma = np.median(np.abs(xs - med)) * 1.4826
    assert (r["median"], r["mad_sigma"], r["far_thresh"]) == pytest.approx((med, sigma, np.quantile(xs, 0.95)))
    assert r["n_5"] == (xs > med + 5 * sigma).sum() and r["n_far"] == (xs > np.quantile(xs, 0.95)).sum()


def test_clipped_ceiling_lets_values_come_back(spark):
    rng = np.random.default_rng(2)
    xs = np.abs(np.concatenate([rng.normal(size=400), rng.normal(20, 30, size=200)]))
    kept = np.ones(len(xs), bool)
    for _ in range(5):
        med = np.median(xs[kept])
        sigma = 1.4826 * np.median(np.abs(xs[kept] - med))
        new = xs <= med + 3 * sigma
        same = new.sum() == kept.sum()
        if sigma == 0:
            break
        kept = new
        if same:
            break
    r = robust.clipped_ceiling(frame(spark, [("k", float(x)) for x in xs] + [("flat", 1.0)] * 5, "k string, v double"), ["k"], "v")
    got = {x["k"]: x for x in r.collect()}
    assert got["k"]["n_kept"] == kept.sum() and got["k"]["ceiling"] == pytest.approx(np.quantile(xs[kept], 0.999))
    assert got["flat"]["ceiling"] == 1.0


@pytest.mark.parametrize("half", [1, 5, 40])
def test_local_stats_replicate_edges(spark, half):
    xs = np.random.default_rng(3).standard_cauchy(60)
    df = frame(spark, [("k", p, float(x)) for p, x in enumerate(xs)], "k string, p int, v double")
    got = robust.local_stats(df, ["k"], "p", "v", half).orderBy("p").collect()
    roll = lambda a: np.array([np.median(np.pad(a, half, mode="edge")[i : i + 2 * half + 1]) for i in range(len(a))])
    b = roll(xs)
    assert [r["local_median"] for r in got] == pytest.approx(list(b))
    assert [r["local_sigma"] for r in got] == pytest.approx(list(roll(np.abs(xs - b)) * 1.4826 + 1e-9))


def test_clusters_partition_the_windows_above(spark):
    rng = random.Random(4)
    rows = [("c", "m", 512 * p, float(rng.randrange(5))) for p in sorted(rng.sample(range(3000), 500))]
    got = islands.summarize_clusters(frame(spark, rows, "cadence string, method string, f_start long, score double"), ["cadence", "method"], 512, 1024, 1 << 14).collect()
    assert sum(r["n_snippets"] for r in got) == len(rows)
    for r in got:
        inside = [(s, -f) for _, _, f, s in rows if r["f_start_first"] <= f <= r["f_start_last"]]
        assert (r["peak_score"], -r["f_start_peak"]) == max(inside) and len(inside) == r["n_snippets"]
        assert r["cluster_width_channels"] == r["f_start_last"] - r["f_start_first"] + 1024
    assert islands.summarize_clusters(frame(spark, [], "cadence string, method string, f_start long, score double"), ["cadence", "method"], 512, 1024).count() == 0


def decide(spark, rows, **kw):
    grid = [[0.1] * 64 for _ in range(6)]
    for r, v in rows.items():
        grid[r][10] = v
    df = frame(spark, [(grid,)], "amap array<array<double>>")
    single = F.lit(kw.pop("single")) if "single" in kw else None
    return maps.verdict(df, F.lit(1.0), F.lit(kw.pop("leak_frac", 0.3)), single_off_frac=single, **kw).first()


def test_verdict_truth_table(spark):
    two_on = {0: 5.0, 2: 5.0, 1: 1.4, 3: 1.4}
    assert decide(spark, two_on)["off_leak"]  # the reference is the empty third ON row
    assert decide(spark, two_on, leak_ref="weakest_hit_on")["in_short_list"]
    bright = {0: 5.0, 2: 5.0, 4: 5.0, 1: 5.0}
    assert decide(spark, bright, leak_ref="weakest_hit_on")["in_short_list"]
    assert decide(spark, bright, leak_ref="weakest_hit_on", single=1.0)["off_single_leak"]
    assert not decide(spark, {0: 5.0})["in_short_list"]
    with pytest.raises(ValueError):
        decide(spark, {0: 5.0}, leak_ref="other")


def test_contrast_near_the_peak_column(spark):
    amap = np.full((6, 64), 0.1)
    amap[[0, 2, 4], [1, 3, 0]] = [6.0, 3.0, 3.0]
    amap[1, 40] = 5.0
    r = maps.contrast(frame(spark, [(amap.tolist(),)], "amap array<array<double>>"), F.lit(1.0)).first()
    assert (r["on_mean"], r["off_mean"], r["n_on_hits"], r["n_off_hits"]) == (4.0, pytest.approx(0.1), 3, 0)


def test_veto_counts_other_cadences(spark):
    schema = "cadence string, method string, f_start_peak long, f_start_first long, f_start_last long"
    rows = [
        ("blc01_57000_1_A", "m", 0, 0, 0), ("blc01_57000_2_B", "m", 512, 512, 512), ("blc01_57000_3_A", "m", 1023, 1023, 5000), ("blc01_57000_3_A", "m", 9, 1000, 1000),
        ("blc01_57000_4_C", "m", 100_000, 100_000, 100_000), ("blc02_57000_2_B", "m", 512, 512, 512), ("blc01_57001_2_B", "m", 512, 512, 512), ("blc01_57000_2_B", "n", 0, 0, 0),
    ]
    df = frame(spark, rows, schema)
    got = {(r["cadence"], r["method"], r["f_start_peak"]): r["n_other"] for r in candidates.veto_counts(df, 1024).collect()}
    assert got[rows[0][:3]] == 2 and got[rows[1][:3]] == 2 and got[rows[2][:3]] == 2 and sum(got.values()) == 8
    by_target = {(r["cadence"], r["method"], r["f_start_peak"]): r["n_other"] for r in candidates.veto_counts(df, 1024, by_target=True).collect()}
    assert by_target[rows[0][:3]] == 1


def test_ranks_and_quality_equal_brute_force(spark):
    rng = random.Random(6)
    rows = [("g", k, rng.choice([None, math.nan, float(rng.randrange(6)), rng.gauss(0, 1)]), rng.random() < 0.4) for k in range(300)]
    df = frame(spark, rows, "g string, i long, v double, l boolean")
    good = [(v, i, l) for _, i, v, l in rows if v is not None and not math.isnan(v)]
    order = {i: k + 1 for k, (v, i, _) in enumerate(sorted(good, key=lambda x: (-x[0], x[1])))}
    ranks = {r["i"]: r["rank"] for r in candidates.ranked(df.where("v IS NOT NULL AND NOT isnan(v)"), ["g"], "v", "i").collect()}
    assert ranks == order
    greater = {r["i"]: r["n"] for r in candidates.count_greater(df.where("v IS NOT NULL AND NOT isnan(v)"), ["g"], "v", "n").collect()}
    assert greater == {i: sum(w > v for w, _, _ in good) for v, i, _ in good}
    pos, neg = [v for v, _, l in good if l], [v for v, _, l in good if not l]
    r = evaluation.roc_auc(df, ["g"], "v", "l").first()
    assert r["auc"] == pytest.approx(np.mean([(p > n) + (p == n) / 2 for p in pos for n in neg]))
    assert r["ks"] == pytest.approx(max(abs(np.mean([p >= v for p in pos]) - np.mean([n >= v for n in neg])) for v, _, _ in good))


def test_rates(spark):
    row = frame(spark, [(0, 0), (5, 10)], "k long, n long").select(*[c.alias(x) for c, x in zip(evaluation.wilson(F.col("k"), F.col("n")), "plh", strict=True)]).collect()
    assert tuple(row[0]) == (0, 0, 0) and tuple(row[1]) == pytest.approx((0.5, 0.2366, 0.7634), abs=1e-4)
    df = frame(spark, [("g", float(v), v > 2) for v in (0, 1, 1, 2, 3, 4)], "g string, v double, f boolean")
    edges = frame(spark, [("g", 0.0, 1.0, 1.0, 4.0)], "g string, a double, b double, c double, d double")
    got = {r["bin"]: (r["n"], r["rate"]) for r in evaluation.binned_rates(df, edges, ["g"], "v", "f", list("abcd")).collect()}
    assert got == {0: (3, 0.0), 1: (3, pytest.approx(2 / 3))}


def test_names_products_and_keys(spark):
    names = ["/x/blc01_guppi_57000_00001_MY_STAR_0007.rawspec.0000.h5", "blc01_guppi_5x_aa_T_0001.rawspec.0000.h5", "blc01_guppi_1.rawspec.0000.h5", "calib.tmp.h5", "blc01_guppi_57000_2_T_1.0002.h5", None]
    got = {r["base"]: r for r in catalogue.parsed_names(frame(spark, [(n,) for n in names], "file string")).collect()}
    first = got["blc01_guppi_57000_00001_MY_STAR_0007.rawspec.0000.h5"]
    assert (first["node"], first["abs_time_s"], first["target"], first["scan_num"], first["product"], first["parse_error"]) == ("blc01", 57000 * 86400 + 1, "MY_STAR", "0007", "0000", None)
    assert got["blc01_guppi_57000_2_T_1.0002.h5"]["product"] == "0002"
    assert [got[n]["parse_error"].split(":")[0].split(" (")[0] for n in names[1:4]] == ["non-numeric MJD", "too few fields", "unrecognised filename"]
    keys = frame(spark, [("blc0a_X_1.rawspec.fine.H5",), ("other.h5",)], "b string").select(catalogue.product_of(F.col("b")), catalogue.scan_key(F.col("b")), catalogue.node_scan_key(F.col("b"))).collect()
    assert [tuple(r) for r in keys] == [("0000", "x_1", "blc0a_x_1"), (None, None, None)]


def test_sequences_flags_and_on_off(spark):
    targets = ["ON", "A", "ON", "B", "ON", "C"]
    rows = [("0000", "blc01", 1000 + 325 * k, f"f{k}", t, 1.0, 2.0, 16) for k, t in enumerate(targets + ["X", "Y"])]
    rows += [("0000", "blc02", 700 * k, f"g{k}", t, 1.0 + (k == 1), 2.0, 16 + k) for k, t in enumerate("PQ")]
    seq = catalogue.sequences_of_six(frame(spark, rows, "product string, node string, time long, base string, target string, f_start_mhz double, f_stop_mhz double, ntime long"))
    keys = ["product", "node", "run", "seq"]
    flags = {(r["node"], r["seq"]): r["flags"] for r in catalogue.shape_flags(seq, keys).collect()}
    assert flags == {("blc01", 0): "", ("blc01", 1): "files_2", ("blc02", 0): "files_2,mixed_band,ragged_ntime"}
    on = {(r["node"], r["seq"]): (r["on_target"], r["n_on"], r["n_off"], r["off_targets"]) for r in catalogue.on_off(seq, keys).collect()}
    assert on == {("blc01", 0): ("ON", 3, 3, "A,B,C"), ("blc01", 1): (None, 0, 2, "X,Y"), ("blc02", 0): (None, 0, 2, "P,Q")}


def test_reading_observations(spark):
    name = "/a/blc07_guppi_57000_00100_MY-Star_0001.rawspec.0000.h5"
    rows = [
        (1, name, None, " ", None, None, None, None, None, None), (2, name, "0000", " BLC07", "my star", 57001, 5, None, None, None), (3, name, "0001", "blc08", "Q", 1, 1, 9, None, None),
        (4, name, None, None, None, None, None, None, "bad name", None), (5, None, "0000", "blc01", "T", None, None, 7, None, None), (6, "x.h5", None, None, "--", None, None, None, None, None),
    ]
    df = frame(spark, rows, "header_id long, file string, product string, node string, target string, mjd_day int, mjd_sec int, abs_time_s long, parse_error string, ingest_ts timestamp")
    got = {r["header_id"]: (r["product"], r["node"], r["target"], r["time"]) for r in observations(df).collect()}
    day = 86400
    assert got == {1: ("0000", "blc07", "MYSTAR", 57000 * day + 100), 2: ("0000", "blc07", "MYSTAR", 57001 * day + 5), 3: ("0001", "blc08", "Q", 9), 5: ("0000", "blc01", "T", 7), 6: (None, "x.h5", None, None)}


def test_models(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 4))
    y = x @ [1.0, -2.0, 0.5, 0.0] + 3
    df = frame(spark, [(k, v.tolist(), float(t), int(t > 3)) for k, (v, t) in enumerate(zip(x, y, strict=True))], "i long, v array<double>, y double, c int")
    n, mean, cov = models.moments(df, "v")
    assert n == 300 and mean == pytest.approx(x.mean(0)) and cov == pytest.approx(np.cov(x.T, bias=True))
    got = {r["i"]: r["distance"] for r in models.mahalanobis(df, "v", df, shrink=0.0).collect()}
    centred = x - x.mean(0)
    want = np.sqrt(np.einsum("ij,jk,ik->i", centred, np.linalg.inv(np.cov(x.T, bias=True)), centred))
    assert [got[k] for k in range(300)] == pytest.approx(list(want))
    assert list(models.ridge(df, "v", "y", 0.0).coefficients) == pytest.approx([1, -2, 0.5, 0], abs=1e-6)
    assert models.cross_validated_auc(df, "v", "c", folds=2) > 0.99
