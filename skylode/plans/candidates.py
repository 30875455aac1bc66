"""Queries over candidates: review order, veto, association with injected regions, survival, quality of the scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skylode.operators import candidates as C
from skylode.operators import evaluation as E
from skylode.operators import robust
from skylode.operators.islands import overlap_join
from skylode.sources.tables import table

KEYS = ["cadence", "method"]
FCHANS = 1024


def _latest(spark: SparkSession, folder: str) -> DataFrame:
    return C.latest_clusters(table(spark, folder, "method_clusters"))


def clusters_latest(spark: SparkSession, folder: str) -> DataFrame:
    return _latest(spark, folder).select(*KEYS, "f_start_peak", "cluster_id", "peak_score", "in_short_list", "f_start_first", "f_start_last")


def short_list_order(spark: SparkSession, folder: str) -> DataFrame:
    """The short list of each cadence and method by contrast, without a limit."""
    short = _latest(spark, folder).where("in_short_list AND on_off_contrast IS NOT NULL AND NOT isnan(on_off_contrast)").select(*KEYS, "f_start_peak", "on_off_contrast")
    return C.ranked(short, KEYS, "on_off_contrast", "f_start_peak")


def counterfactual_rank(spark: SparkSession, folder: str) -> DataFrame:
    """How many short-listed clusters of its cadence and method have a strictly greater contrast; -1 off the list."""
    rows = _latest(spark, folder).where("on_off_contrast IS NOT NULL AND NOT isnan(on_off_contrast)").select(*KEYS, "f_start_peak", "on_off_contrast", "in_short_list")
    listed = C.count_greater(rows.where("in_short_list"), KEYS, "on_off_contrast", "rank")
    return listed.unionByName(rows.where("NOT in_short_list").withColumn("rank", F.lit(-1).cast("long"))).select(*KEYS, "f_start_peak", "rank")


def session_veto(spark: SparkSession, folder: str) -> DataFrame:
    """Other cadences of the night and node with an overlapping cluster, and what remains of the short list."""
    rows = C.veto_counts(_latest(spark, folder).select(*KEYS, "f_start_peak", "f_start_first", "f_start_last", "in_short_list"), FCHANS)
    ruled = rows.join(table(spark, folder, "selection_rules").select("method", "veto_min_targets"), "method")
    final = F.coalesce(F.col("in_short_list"), F.lit(False)) & ((F.col("veto_min_targets") == 0) | (F.col("n_other") < F.col("veto_min_targets")))
    return ruled.select(*KEYS, "f_start_peak", "n_other", final.alias("final"))


def session_veto_targets(spark: SparkSession, folder: str) -> DataFrame:
    """The same count over distinct other targets, spans widened by 512 channels."""
    rows = C.veto_counts(_latest(spark, folder).select(*KEYS, "f_start_peak", "f_start_first", "f_start_last"), FCHANS, 512, by_target=True)
    return rows.select(*KEYS, "f_start_peak", "n_other")


def _regions(spark: SparkSession, folder: str) -> DataFrame:
    """Regions to look for: the spans of the clusters of udma_topk, in the results of every other method."""
    spans = _latest(spark, folder).where("method = 'udma_topk'").select(F.col("cluster_id").alias("region"), "cadence", F.col("f_start_first").alias("lo"), (F.col("f_start_last") + FCHANS).alias("hi"))
    methods = table(spark, folder, "selection_rules").where("method <> 'udma_topk'").agg(F.collect_list("method").alias("m"))  # one row
    return spans.join(methods, F.lit(True)).select("region", "cadence", F.explode("m").alias("method"), "lo", "hi")


def region_association(spark: SparkSession, folder: str) -> DataFrame:
    best = C.associate(_regions(spark, folder), _latest(spark, folder).where("peak_score IS NOT NULL AND NOT isnan(peak_score)"), FCHANS)
    return best.select("region", *KEYS, "n_overlapping", "f_start_peak", "peak_in_region", "in_short_list")


def region_merges(spark: SparkSession, folder: str) -> DataFrame:
    """Whether the cluster chosen for a region in a method's results overlaps one of the recorded background, the clusters
    of ae_recon; in ae_recon's own results it always does."""
    best = C.associate(_regions(spark, folder), _latest(spark, folder).where("peak_score IS NOT NULL AND NOT isnan(peak_score)"), FCHANS)
    back = _latest(spark, folder).where("method = 'ae_recon'").select("cadence", F.col("f_start_first").alias("b0"), (F.col("f_start_last") + FCHANS).alias("b1"))
    hits = overlap_join(best.select("region", *KEYS, "first", "end"), back, ["cadence"], "first", "end", "b0", "b1", 8192).select("region", "method").distinct().withColumn("merged", F.lit(True))
    return best.select("region", *KEYS, "f_start_peak").join(hits, ["region", "method"], "left").fillna(False, ["merged"])


def region_windows(spark: SparkSession, folder: str) -> DataFrame:
    """The windows that touch each region in the scores of every method: their number and best score."""
    scores = robust.latest_scores(table(spark, folder, "window_scores")).select(*KEYS, F.col("f_start").alias("w0"), (F.col("f_start") + FCHANS).alias("w1"), "score")
    regions = _latest(spark, folder).where("method = 'udma_topk'").select(F.col("cluster_id").alias("region"), "cadence", F.col("f_start_first").alias("lo"), (F.col("f_start_last") + FCHANS).alias("hi"))
    return overlap_join(regions, scores, ["cadence"], "lo", "hi", "w0", "w1", 8192).groupBy("region", "method").agg(F.count("*").alias("n_windows"), F.max("score").alias("max_window_score"))


def verdict_audit(spark: SparkSession, folder: str) -> DataFrame:
    """Recorded verdicts beside those recomputed from the recorded counts, by method."""
    rows = _latest(spark, folder).where("n_on_hits_full IS NOT NULL")
    again = (F.col("n_on_hits_full") >= 2) & ~((F.col("n_off_hits_full") >= 2) | F.col("off_single_leak"))
    return rows.groupBy("method").agg(F.count("*").alias("n"), F.count_if(again != F.col("in_short_list")).alias("n_changed"), F.count_if(again).alias("n_listed_again"), F.count_if("in_short_list").alias("n_listed"))


def survival_cascade(spark: SparkSession, folder: str) -> DataFrame:
    """Per cent of clusters with maps that pass each stage, by method."""
    rows = _latest(spark, folder).where("n_on_hits_full IS NOT NULL")
    pct = lambda c: F.round(100 * F.avg(c.cast("double")), 6)
    return rows.groupBy("method").agg(
        F.count("*").alias("n"), pct(F.col("n_on_hits") >= 2).alias("on_window"), pct(F.col("n_on_hits_full") >= 2).alias("on_full"),
        pct((F.col("n_on_hits_full") >= 2) & ~F.col("off_leak")).alias("no_leak"), pct(F.col("in_short_list")).alias("listed"),
    )


def review_budget(spark: SparkSession, folder: str) -> DataFrame:
    """The share of short-listed clusters that a reviewer of the first 1, 3, 10 or 30 of each cadence sees."""
    ranks = short_list_order(spark, folder)
    caps = [1, 3, 10, 30]
    return ranks.groupBy("method").agg(F.count("*").alias("n"), F.max("rank").alias("longest"), *[F.round(F.avg((F.col("rank") <= c).cast("double")), 6).alias(f"seen_{c}") for c in caps])


def rank_percentiles(spark: SparkSession, folder: str) -> DataFrame:
    ranks = short_list_order(spark, folder).withColumn("rank", F.col("rank").cast("double"))
    return robust.exact_quantiles(ranks, ["method"], "rank", {"p50": 0.5, "p90": 0.9, "p99": 0.99}).withColumns({c: F.round(c, 6) for c in ("p50", "p90", "p99")})


def score_quality(spark: SparkSession, folder: str) -> DataFrame:
    """How well peak scores tell the short list from the rest: ROC AUC, Kolmogorov-Smirnov distance."""
    out = E.roc_auc(_latest(spark, folder), ["method"], "peak_score", "in_short_list")
    return out.withColumns({"auc": F.round("auc", 6), "ks": F.round("ks", 6)})


def rate_at_false_positives(spark: SparkSession, folder: str) -> DataFrame:
    """The share of the short list above the 90th percentile of the scores off it."""
    rows = _latest(spark, folder).where("in_short_list IS NOT NULL AND peak_score IS NOT NULL AND NOT isnan(peak_score)")
    cut = robust.exact_quantiles(rows.where("NOT in_short_list"), ["method"], "peak_score", {"cut": 0.9}).select("method", "cut")
    return rows.where("in_short_list").join(cut, "method").groupBy("method").agg(F.round(F.avg((F.col("peak_score") > F.col("cut")).cast("double")), 6).alias("tpr"), F.count("*").alias("n"))


def effect_sizes(spark: SparkSession, folder: str) -> DataFrame:
    """Cohen's d of ON and OFF means and of contrast between the short list and the rest."""
    rows = _latest(spark, folder).where("in_short_list IS NOT NULL")
    return rows.groupBy("method").agg(*[F.round(E.cohens_d(c, F.col("in_short_list")), 6).alias(f"d_{c}") for c in ("on_mean", "off_mean", "on_off_contrast")])


def listed_rates(spark: SparkSession, folder: str) -> DataFrame:
    """Short-list rate by number of ON hits, with its Wilson interval."""
    rows = _latest(spark, folder).where("n_on_hits IS NOT NULL").groupBy("method", "n_on_hits").agg(F.count("*").alias("n"), F.count_if("in_short_list").alias("k"))
    p, lo, hi = E.wilson(F.col("k"), F.col("n"))
    return rows.select("method", "n_on_hits", "n", "k", F.round(p, 6).alias("rate"), F.round(lo, 6).alias("lo"), F.round(hi, 6).alias("hi"))


def listed_by_contrast(spark: SparkSession, folder: str) -> DataFrame:
    """Short-list rate in the quartile bins of contrast, of at least five clusters."""
    rows = _latest(spark, folder).where("on_off_contrast IS NOT NULL AND NOT isnan(on_off_contrast)")
    qs = {f"q{k}": k / 4 for k in range(5)}
    edges = robust.exact_quantiles(rows, ["method"], "on_off_contrast", qs)
    return E.binned_rates(rows, edges, ["method"], "on_off_contrast", "in_short_list", list(qs)).where("n >= 5").withColumn("rate", F.round("rate", 6))


def factorial_rates(spark: SparkSession, folder: str) -> DataFrame:
    """Short-list rates by extent (one window or several), structure (strong contrast or not) and method."""
    rows = _latest(spark, folder).where("n_on_hits_full IS NOT NULL")
    extent, structure = F.when(F.col("n_snippets") > 1, "wide").otherwise("narrow"), F.when(F.col("on_off_contrast") >= 3, "strong").otherwise("weak")
    return rows.groupBy("method", extent.alias("extent"), structure.alias("structure")).agg(F.count("*").alias("n"), F.round(F.avg(F.col("in_short_list").cast("double")), 6).alias("rate"))


def detection_floor(spark: SparkSession, folder: str) -> DataFrame:
    """The lowest whole contrast at which half of a method's clusters are listed."""
    rows = _latest(spark, folder).where("on_off_contrast >= 0 AND on_off_contrast < double('infinity')")  # NaN is greater than infinity
    rates = rows.groupBy("method", F.floor("on_off_contrast").cast("long").alias("level")).agg(F.avg(F.col("in_short_list").cast("double")).alias("rate"))
    return E.lowest_passing(rates, ["method"], "level", "rate", 0.5)


def map_coverage(spark: SparkSession, folder: str) -> DataFrame:
    """Clusters whose peak window was scored and usable, and clusters without a saved map, by method."""
    scores = robust.latest_scores(table(spark, folder, "window_scores")).select(*KEYS, F.col("f_start").alias("f_start_peak"), F.lit(True).alias("scored"))
    rows = _latest(spark, folder).join(scores, [*KEYS, "f_start_peak"], "left")
    return rows.groupBy("method").agg(F.count("*").alias("n"), F.count_if("scored").alias("n_scored"), F.count_if(F.col("n_on_hits_full").isNull()).alias("n_without_map"))


def threshold_audit(spark: SparkSession, folder: str) -> DataFrame:
    """Clusters whose thresholds differ from those recorded for their cadence and method, and clusters without a record."""
    recorded = table(spark, folder, "method_results").where("cadence IS NOT NULL").groupBy(*KEYS).agg(F.max("thresh_3").alias("t3"))
    rows = _latest(spark, folder).join(recorded, KEYS, "left")
    return rows.groupBy("method").agg(F.count("*").alias("n"), F.count_if(F.col("t3").isNull()).alias("n_unrecorded"), F.count_if(F.abs(F.col("t3") - F.col("thresh_3")) > 1e-9).alias("n_stale"))


def describe_by_role(spark: SparkSession, folder: str) -> DataFrame:
    """Count, mean, standard deviation and extremes of ON and OFF means on and off the short list."""
    rows = _latest(spark, folder).where("in_short_list IS NOT NULL").select("in_short_list", F.explode(F.map_from_arrays(F.array(F.lit("on"), F.lit("off")), F.array("on_mean", "off_mean"))).alias("role", "x"))
    good = rows.where("x IS NOT NULL AND NOT isnan(x)")
    return good.groupBy("in_short_list", "role").agg(F.count("*").alias("n"), F.round(F.avg("x"), 6).alias("mean"), F.round(F.stddev_samp("x"), 5).alias("std"), F.min("x").alias("min"), F.max("x").alias("max"))


def injection_catalog(spark: SparkSession, folder: str) -> DataFrame:
    """Sites × ON patterns × SNR: an id and a seed for each injection at the peaks of the short list."""
    sites = _latest(spark, folder).where("in_short_list").select(*KEYS, "f_start_peak")
    patterns = ["3on", "2on_02", "2on_04", "2on_24", "1on_0", "1on_2", "1on_4"]
    grid = sites.withColumn("pattern", F.explode(F.array(*map(F.lit, patterns)))).withColumn("snr", F.explode(F.array(*map(F.lit, [0, 10, 30]))))
    key = F.concat_ws("|", "cadence", "method", F.col("f_start_peak").cast("string"), "pattern", F.col("snr").cast("string"))
    return grid.select(*KEYS, "f_start_peak", "pattern", "snr", F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("long").alias("seed"))


_L = """
WITH lc AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cadence, method, f_start_peak ORDER BY run_at DESC, cluster_id DESC) AS rn FROM method_clusters WHERE cadence IS NOT NULL) WHERE rn = 1)
"""
_W = _L + """, ws AS (SELECT cadence, method, f_start, score FROM (
    SELECT *, row_number() OVER (PARTITION BY cadence, method, f_start ORDER BY scored_at DESC) AS rn FROM window_scores WHERE cadence IS NOT NULL) WHERE rn = 1 AND isfinite(score))
"""
_R = _L + """, reg AS (SELECT cluster_id AS region, cadence, r.method, f_start_first AS lo, f_start_last + 1024 AS hi FROM lc, (SELECT method FROM selection_rules WHERE method <> 'udma_topk') r WHERE lc.method = 'udma_topk'),
cl AS (SELECT cadence, method, f_start_peak AS p, peak_score, on_off_contrast, in_short_list, f_start_first AS a, f_start_last + 1024 AS z FROM lc WHERE NOT isnan(peak_score)),
pr AS (SELECT region, cadence, method, p, a, z, in_short_list, p < hi AND p + 1024 > lo AS hit, coalesce(in_short_list, FALSE) AS s, coalesce(on_off_contrast, -1) AS k, peak_score
  FROM reg JOIN cl USING (cadence, method) WHERE a < hi AND z > lo),
bs AS (SELECT *, count(*) OVER (PARTITION BY region, method) AS n, row_number() OVER (PARTITION BY region, method ORDER BY hit DESC, CASE WHEN hit THEN s END DESC, CASE WHEN hit THEN k END DESC, peak_score DESC, p) AS rn FROM pr)
"""
_V = """, x AS (SELECT *, split_part(cadence, '_', 1) AS node, split_part(cadence, '_', 2) AS day, regexp_replace(cadence, '^[^_]*_[^_]*_[^_]*_', '') AS target FROM lc)"""
SQL = {
    "clusters_latest": _L + "SELECT cadence, method, f_start_peak, cluster_id, peak_score, in_short_list, f_start_first, f_start_last FROM lc",
    "short_list_order": _L + """SELECT cadence, method, f_start_peak, on_off_contrast, row_number() OVER (PARTITION BY cadence, method ORDER BY on_off_contrast DESC, f_start_peak) AS rank
      FROM lc WHERE in_short_list AND NOT isnan(on_off_contrast)""",
    "counterfactual_rank": _L + """, r AS (SELECT * FROM lc WHERE NOT isnan(on_off_contrast))
      SELECT cadence, method, f_start_peak, CASE WHEN in_short_list THEN rank() OVER (PARTITION BY cadence, method, in_short_list ORDER BY on_off_contrast DESC) - 1 ELSE -1 END AS rank FROM r""",
    "session_veto": _L + _V + """, o AS (SELECT a.cadence, a.method, a.f_start_peak, count(DISTINCT b.cadence) AS n FROM x a JOIN x b ON a.node = b.node AND a.day = b.day AND a.method = b.method AND a.cadence <> b.cadence
        AND b.f_start_first < a.f_start_last + 1024 AND b.f_start_last + 1024 > a.f_start_first GROUP BY ALL)
      SELECT cadence, method, f_start_peak, coalesce(n, 0) AS n_other, coalesce(in_short_list, FALSE) AND (veto_min_targets = 0 OR coalesce(n, 0) < veto_min_targets) AS final
      FROM lc JOIN selection_rules USING (method) LEFT JOIN o USING (cadence, method, f_start_peak)""",
    "session_veto_targets": _L + _V + """, o AS (SELECT a.cadence, a.method, a.f_start_peak, count(DISTINCT b.target) AS n FROM x a JOIN x b ON a.node = b.node AND a.day = b.day AND a.method = b.method AND a.cadence <> b.cadence AND a.target <> b.target
        AND b.f_start_first < a.f_start_last + 1024 + 512 AND b.f_start_last + 1024 > a.f_start_first - 512 GROUP BY ALL)
      SELECT cadence, method, f_start_peak, coalesce(n, 0) AS n_other FROM lc LEFT JOIN o USING (cadence, method, f_start_peak)""",
    "region_association": _R + "SELECT region, cadence, method, n AS n_overlapping, p AS f_start_peak, hit AS peak_in_region, in_short_list FROM bs WHERE rn = 1",
    "region_merges": _R + """SELECT region, cadence, p AS f_start_peak, EXISTS (SELECT 1 FROM lc b WHERE b.method = 'ae_recon' AND b.cadence = bs.cadence AND b.f_start_first < bs.z AND b.f_start_last + 1024 > bs.a) AS merged
      FROM bs WHERE rn = 1 AND method = 'vit_cadence'""",
    "region_windows": _W + """SELECT cluster_id AS region, count(*) AS n_windows, max(score) AS max_window_score FROM lc JOIN ws ON ws.cadence = lc.cadence AND ws.method = 'udma_topk' AND f_start < f_start_last + 1024 AND f_start + 1024 > f_start_first
      WHERE lc.method = 'udma_topk' GROUP BY 1""",
    "verdict_audit": _L + """, v AS (SELECT *, n_on_hits_full >= 2 AND NOT (n_off_hits_full >= 2 OR off_single_leak) AS again FROM lc WHERE n_on_hits_full IS NOT NULL)
      SELECT method, count(*) AS n, count(*) FILTER (again <> in_short_list) AS n_changed, count(*) FILTER (again) AS n_listed_again, count(*) FILTER (in_short_list) AS n_listed FROM v GROUP BY 1""",
    "survival_cascade": _L + """SELECT method, count(*) AS n, round(100 * avg((n_on_hits >= 2)::INT), 6) AS on_window, round(100 * avg((n_on_hits_full >= 2)::INT), 6) AS on_full,
      round(100 * avg((n_on_hits_full >= 2 AND NOT off_leak)::INT), 6) AS no_leak, round(100 * avg(in_short_list::INT), 6) AS listed FROM lc WHERE n_on_hits_full IS NOT NULL GROUP BY 1""",
    "review_budget": _L + """, r AS (SELECT method, row_number() OVER (PARTITION BY cadence, method ORDER BY on_off_contrast DESC, f_start_peak) AS rank FROM lc WHERE in_short_list AND NOT isnan(on_off_contrast))
      SELECT method, count(*) AS n, max(rank) AS longest, """ + ", ".join(f"round(avg((rank <= {c})::INT), 6) AS seen_{c}" for c in (1, 3, 10, 30)) + " FROM r GROUP BY 1",
    "rank_percentiles": _L + """, r AS (SELECT method, row_number() OVER (PARTITION BY cadence, method ORDER BY on_off_contrast DESC, f_start_peak) AS rank FROM lc WHERE in_short_list AND NOT isnan(on_off_contrast))
      SELECT method, count(*) AS n, round(quantile_cont(rank, 0.5), 6) AS p50, round(quantile_cont(rank, 0.9), 6) AS p90, round(quantile_cont(rank, 0.99), 6) AS p99 FROM r GROUP BY 1""",
    "score_quality": _L + """, g AS (SELECT method, peak_score AS s, in_short_list AS l FROM lc WHERE NOT isnan(peak_score) AND in_short_list IS NOT NULL),
      n AS (SELECT method, count(*) FILTER (l) AS n_pos, count(*) FILTER (NOT l) AS n_neg FROM g GROUP BY 1),
      r AS (SELECT method, l, rank() OVER (PARTITION BY method ORDER BY s) + (count(*) OVER (PARTITION BY method, s) - 1) / 2.0 AS r FROM g),
      a AS (SELECT method, sum(r) FILTER (l) AS rs FROM r GROUP BY 1),
      c AS (SELECT method, sum(l::INT) OVER w AS p, sum((NOT l)::INT) OVER w AS q FROM g WINDOW w AS (PARTITION BY method ORDER BY s DESC)),
      k AS (SELECT method, max(abs(p / n_pos - q / n_neg)) AS ks FROM c JOIN n USING (method) GROUP BY 1)
      SELECT method, n_pos, n_neg, round((rs - n_pos * (n_pos + 1) / 2) / (n_pos * n_neg), 6) AS auc, round(ks, 6) AS ks FROM n JOIN a USING (method) JOIN k USING (method)""",
    "rate_at_false_positives": _L + """, g AS (SELECT * FROM lc WHERE NOT isnan(peak_score)), c AS (SELECT method, quantile_cont(peak_score, 0.9) AS cut FROM g WHERE NOT in_short_list GROUP BY 1)
      SELECT method, round(avg((peak_score > cut)::INT), 6) AS tpr, count(*) AS n FROM g JOIN c USING (method) WHERE in_short_list GROUP BY 1""",
    "effect_sizes": _L + "SELECT method, " + ", ".join(
        f"""round((avg({c}) FILTER (in_short_list) - avg({c}) FILTER (NOT in_short_list)) / sqrt(((count({c}) FILTER (in_short_list) - 1) * var_samp({c}) FILTER (in_short_list)
        + (count({c}) FILTER (NOT in_short_list) - 1) * var_samp({c}) FILTER (NOT in_short_list)) / (count({c}) FILTER (in_short_list IS NOT NULL) - 2)), 6) AS d_{c}""" for c in ("on_mean", "off_mean", "on_off_contrast")
    ) + " FROM lc WHERE in_short_list IS NOT NULL GROUP BY 1",
    "listed_rates": _L + """, g AS (SELECT method, n_on_hits, count(*) AS n, count(*) FILTER (in_short_list) AS k, 1.959963984540054 AS z FROM lc WHERE n_on_hits IS NOT NULL GROUP BY 1, 2)
      SELECT method, n_on_hits, n, k, round(k / n, 6) AS rate, round(greatest(0, (k / n + z * z / (2 * n) - z * sqrt(k / n * (1 - k / n) / n + z * z / (4 * n * n))) / (1 + z * z / n)), 6) AS lo,
        round(least(1, (k / n + z * z / (2 * n) + z * sqrt(k / n * (1 - k / n) / n + z * z / (4 * n * n))) / (1 + z * z / n)), 6) AS hi FROM g""",
    "listed_by_contrast": _L + """, g AS (SELECT method, on_off_contrast AS v, in_short_list AS l FROM lc WHERE NOT isnan(on_off_contrast)),
      e AS (SELECT method, list_sort(list_distinct(quantile_cont(v, [0, 0.25, 0.5, 0.75, 1]))) AS e FROM g GROUP BY 1),
      b AS (SELECT method, l, greatest(0, len([x FOR x IN e IF x < v]) - 1) AS bin FROM g JOIN e USING (method))
      SELECT method, CAST(bin AS INT) AS bin, count(*) AS n, round(avg(l::INT), 6) AS rate FROM b GROUP BY 1, 2 HAVING count(*) >= 5""",
    "factorial_rates": _L + """SELECT method, CASE WHEN n_snippets > 1 THEN 'wide' ELSE 'narrow' END AS extent, CASE WHEN on_off_contrast >= 3 THEN 'strong' ELSE 'weak' END AS structure, count(*) AS n,
      round(avg(in_short_list::INT), 6) AS rate FROM lc WHERE n_on_hits_full IS NOT NULL GROUP BY 1, 2, 3""",
    "detection_floor": _L + """, r AS (SELECT method, CAST(floor(on_off_contrast) AS BIGINT) AS level, avg(in_short_list::INT) AS rate FROM lc WHERE on_off_contrast BETWEEN 0 AND 20 GROUP BY 1, 2)
      SELECT method, min(level) FILTER (rate >= 0.5) AS level FROM r GROUP BY 1""",
    "map_coverage": _W + """SELECT lc.method, count(*) AS n, count(ws.f_start) AS n_scored, count(*) FILTER (n_on_hits_full IS NULL) AS n_without_map FROM lc LEFT JOIN ws ON ws.cadence = lc.cadence AND ws.method = lc.method AND ws.f_start = lc.f_start_peak GROUP BY 1""",
    "threshold_audit": _L + """, r AS (SELECT cadence, method, max(thresh_3) AS t3 FROM method_results GROUP BY ALL)
      SELECT method, count(*) AS n, count(*) FILTER (t3 IS NULL) AS n_unrecorded, count(*) FILTER (abs(t3 - thresh_3) > 1e-9) AS n_stale FROM lc LEFT JOIN r USING (cadence, method) GROUP BY 1""",
    "describe_by_role": _L + """, u AS (SELECT in_short_list, 'on' AS role, on_mean AS x FROM lc UNION ALL SELECT in_short_list, 'off', off_mean FROM lc)
      SELECT in_short_list, role, count(*) AS n, round(avg(x), 6) AS mean, round(stddev_samp(x), 5) AS std, min(x) AS min, max(x) AS max FROM u WHERE in_short_list IS NOT NULL AND NOT isnan(x) GROUP BY 1, 2""",
    "injection_catalog": _L + """SELECT cadence, method, f_start_peak, pattern, snr, CAST('0x' || substr(sha256(cadence || '|' || method || '|' || f_start_peak || '|' || pattern || '|' || snr), 1, 8) AS BIGINT) AS seed
      FROM lc, (VALUES ('3on'), ('2on_02'), ('2on_04'), ('2on_24'), ('1on_0'), ('1on_2'), ('1on_4')) p(pattern), (VALUES (0), (10), (30)) s(snr) WHERE in_short_list""",
}
QUERIES = {
    f.__name__: f
    for f in (clusters_latest, short_list_order, counterfactual_rank, session_veto, session_veto_targets, region_association, region_merges, region_windows, verdict_audit, survival_cascade, review_budget,
              rank_percentiles, score_quality, rate_at_false_positives, effect_sizes, listed_rates, listed_by_contrast, factorial_rates, detection_floor, map_coverage, threshold_audit, describe_by_role, injection_catalog)
}
# The queries as they are: every method, every contrast. The SQL under their older names states one method, contrasts up to 20.
SQL |= {
    "merges_by_method": _R + """SELECT region, cadence, method, p AS f_start_peak, EXISTS (SELECT 1 FROM lc b WHERE b.method = 'ae_recon' AND b.cadence = bs.cadence AND b.f_start_first < bs.z AND b.f_start_last + 1024 > bs.a) AS merged
      FROM bs WHERE rn = 1""",
    "windows_by_method": _W + """SELECT cluster_id AS region, ws.method, count(*) AS n_windows, max(score) AS max_window_score FROM lc JOIN ws ON ws.cadence = lc.cadence AND f_start < f_start_last + 1024 AND f_start + 1024 > f_start_first
      WHERE lc.method = 'udma_topk' GROUP BY 1, 2""",
    "contrast_floor": _L + """, r AS (SELECT method, CAST(floor(on_off_contrast) AS BIGINT) AS level, avg(in_short_list::INT) AS rate FROM lc WHERE on_off_contrast >= 0 AND isfinite(on_off_contrast) GROUP BY 1, 2)
      SELECT method, min(level) FILTER (rate >= 0.5) AS level FROM r GROUP BY 1""",
}
QUERIES |= {"merges_by_method": region_merges, "windows_by_method": region_windows, "contrast_floor": detection_floor}
