"""Queries over the window scores: statistics, thresholds, clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skylode.operators import islands, robust
from skylode.operators.candidates import descending_bin
from skylode.session import materialize
from skylode.sources.tables import table

#: Fixed values of the search: distance and width of windows, in channels.
STRIDE, FCHANS = 512, 1024
KEYS = ["cadence", "method"]


def _latest(spark: SparkSession, folder: str) -> DataFrame:
    """Written once: the largest table is read and shuffled once, whatever a query then does with it."""
    return materialize(robust.latest_scores(table(spark, folder, "window_scores")), "latest-scores")


def _rules(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "selection_rules")


def r6(*names: str) -> dict:
    return {n: F.round(n, 6) for n in names}


def scores_latest(spark: SparkSession, folder: str) -> DataFrame:
    return robust.latest_scores(table(spark, folder, "window_scores"))


def robust_stats(spark: SparkSession, folder: str) -> DataFrame:
    return robust.robust_stats(_latest(spark, folder), KEYS).withColumns(r6("median", "mad_sigma"))


def thresholds(spark: SparkSession, folder: str) -> DataFrame:
    return robust.thresholds(_latest(spark, folder), _rules(spark, folder)).withColumns(r6("median", "mad_sigma", "thresh_3", "thresh_5", "far_thresh"))


def sigma_sweep(spark: SparkSession, folder: str) -> DataFrame:
    """Scores beyond median + k sigma, for each k of a list."""
    scores = _latest(spark, folder)
    stats = robust.robust_stats(scores, KEYS)
    ks = [3.0, 4.0, 5.0, 7.0, 10.0]
    counts = scores.join(stats, KEYS).groupBy(*KEYS).agg(*[F.count_if(F.col("score") > F.col("median") + k * F.col("mad_sigma")).alias(str(i)) for i, k in enumerate(ks)])
    return counts.select(*KEYS, F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(str(i)).alias("n_beyond")) for i, k in enumerate(ks)])).alias("s")).select(*KEYS, "s.k", "s.n_beyond")


def _pooled(scores: DataFrame, qs: dict[str, float]) -> DataFrame:
    """method, n, median, mad_sigma and quantiles over all cadences: groups that have no bound."""
    med = robust.exact_quantiles(scores, ["method"], "score", {"median": 0.5} | qs)
    dev = scores.join(med, "method").select("method", F.abs(F.col("score") - F.col("median")).alias("d"))
    return med.join(robust.exact_quantiles(dev, ["method"], "d", {"mad": 0.5}).select("method", (F.col("mad") * robust.MAD_SIGMA).alias("mad_sigma")), "method")


def score_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Each method over all cadences."""
    scores = _latest(spark, folder).select("method", "score")
    beyond = [F.round(100 * F.avg((F.col("score") > F.col("median") + k * F.col("mad_sigma")).cast("double")), 6).alias(f"pct_{k}sigma") for k in (3, 5)]
    return (
        scores.join(_pooled(scores, {"p99": 0.99}), "method").groupBy("method", "n", "median", "p99", "mad_sigma")
        .agg(F.round(F.avg("score"), 6).alias("mean"), F.round(F.stddev_pop("score"), 4).alias("std"), F.min("score").alias("lowest"), F.max("score").alias("highest"), *beyond)
        .withColumns(r6("median", "p99", "mad_sigma"))
    )


def _above(scores: DataFrame, rules: DataFrame) -> DataFrame:
    far = robust.thresholds(scores, rules).select(*KEYS, "far_thresh")
    return scores.join(far, KEYS).where("score > far_thresh").select(*KEYS, "f_start", "score")


def above_far(spark: SparkSession, folder: str) -> DataFrame:
    """The windows above their cadence's FAR threshold, strictly."""
    return _above(_latest(spark, folder), _rules(spark, folder))


def clusters(spark: SparkSession, folder: str) -> DataFrame:
    return islands.summarize_clusters(materialize(above_far(spark, folder), "above-far"), KEYS, STRIDE, FCHANS).withColumns(r6("mean_score"))


def cluster_counts(spark: SparkSession, folder: str) -> DataFrame:
    """The number of clusters only: runs of windows above the threshold."""
    runs = islands.island_starts(materialize(above_far(spark, folder), "above-far"), KEYS, "f_start", STRIDE, 1 << 20)
    return runs.groupBy(*KEYS).agg(F.count_distinct("island").alias("n_clusters"), F.count("*").alias("n_windows"))


def candidate_volume(spark: SparkSession, folder: str) -> DataFrame:
    """Clusters now, and with the recorded OFF ceiling as first cut where that is lower."""
    scores = _latest(spark, folder)
    recorded = table(spark, folder, "method_results").groupBy(*KEYS).agg(F.max("off_ceiling").alias("off_ceiling"))
    cut = robust.thresholds(scores, _rules(spark, folder)).select(*KEYS, "far_thresh").join(recorded, KEYS, "left")
    cut = cut.withColumn("low", F.least("far_thresh", F.when(F.isnan("off_ceiling"), None).otherwise(F.col("off_ceiling"))))
    cut = materialize(cut, "cuts")
    over = materialize(scores.join(cut, KEYS).where("score > low"), "above-low")
    count = lambda rows, name: islands.island_starts(rows.select(*KEYS, "f_start"), KEYS, "f_start", STRIDE, 1 << 20).groupBy(*KEYS).agg(F.count_distinct("island").alias(name))
    return cut.select(*KEYS).join(count(over.where("score > far_thresh"), "n_far"), KEYS, "left").join(count(over, "n_min"), KEYS, "left").fillna(0, ["n_far", "n_min"])


def cfar_windows(spark: SparkSession, folder: str) -> DataFrame:
    """Windows that stand out by (score - local median) / local sigma > cfar_k, for methods with such a rule; none without one."""
    rules = _rules(spark, folder).where("cfar_half > 0").select("method", "cfar_half", "cfar_k")
    scores = _latest(spark, folder)
    out = scores.limit(0).withColumns({"local_median": F.lit(0.0), "local_sigma": F.lit(0.0)})
    # One pass for each width of neighbourhood, of which there are no more than rules.
    for (half,) in rules.select("cfar_half").distinct().orderBy("cfar_half").collect():
        some = rules.where(F.col("cfar_half") == half).select("method", "cfar_k")
        local = robust.local_stats(scores.join(some.select("method"), "method", "left_semi"), KEYS, "f_start", "score", half).join(some, "method")
        out = out.unionByName(local.where((F.col("score") - F.col("local_median")) / F.col("local_sigma") > F.col("cfar_k")).drop("cfar_k"))
    return out.select(*KEYS, "f_start", "score", F.round("local_median", 6).alias("local_median"), F.round("local_sigma", 6).alias("local_sigma"))


def quiet_windows(spark: SparkSession, folder: str) -> DataFrame:
    """How many windows are at most the median of their cadence and method, and their sum."""
    scores = _latest(spark, folder)
    med = robust.robust_stats(scores, KEYS).select(*KEYS, "median")
    return scores.join(med, KEYS).where("score <= median").groupBy(*KEYS).agg(F.count("*").alias("n_quiet"), F.round(F.sum("score"), 4).alias("sum_quiet"))


def peak_background_rank(spark: SparkSession, folder: str) -> DataFrame:
    """For each latest cluster, the share of its cadence's windows with a score below its peak.

    Peaks and scores of a cadence and method are merged in one order, so that no pair is formed, and counted by bins of it.
    """
    scores = _latest(spark, folder)
    peaks = (
        table(spark, folder, "method_clusters").where("peak_score IS NOT NULL AND NOT isnan(peak_score) AND cadence IS NOT NULL")
        .groupBy(*KEYS, "f_start_peak").agg(F.max("peak_score").alias("score")).withColumn("w", F.lit(0).cast("long"))
    )
    both = scores.select(*KEYS, F.lit(None).cast("long").alias("f_start_peak"), "score", F.lit(1).cast("long").alias("w")).unionByName(peaks)
    ranked = islands.running_total(both, KEYS, [F.desc("score")], descending_bin(F.col("score")), "w", "upto").where("w = 0")
    n = scores.groupBy(*KEYS).agg(F.count("*").alias("n"))
    return ranked.join(n, KEYS).select(*KEYS, "f_start_peak", F.round((F.col("n") - F.col("upto")) / F.col("n"), 6).alias("pct_below"))


def threshold_regime(spark: SparkSession, folder: str) -> DataFrame:
    """Which recorded cut binds, by method: the OFF ceiling or five sigma, how often each, and their median ratio."""
    results = table(spark, folder, "method_results").where("off_ceiling IS NOT NULL AND thresh_5 IS NOT NULL AND NOT isnan(off_ceiling) AND NOT isnan(thresh_5) AND thresh_5 <> 0")
    binding = F.when(F.col("off_ceiling") > F.col("thresh_5"), "off_ceiling").otherwise("thresh_5")
    ratios = results.select("method", binding.alias("binding"), (F.col("off_ceiling") / F.col("thresh_5")).alias("ratio"))
    mid = robust.exact_quantiles(ratios, ["method", "binding"], "ratio", {"ratio_p10": 0.1, "ratio_median": 0.5, "ratio_p90": 0.9})
    return mid.withColumns(r6("ratio_p10", "ratio_median", "ratio_p90"))


def false_positives(spark: SparkSession, folder: str) -> DataFrame:
    """Windows beyond their own cadence's five sigma and beyond five sigma of all cadences of the method."""
    scores = _latest(spark, folder)
    five = F.col("median") + 5 * F.col("mad_sigma")
    local = robust.robust_stats(scores, KEYS).select(*KEYS, five.alias("own"))
    rows = scores.join(local, KEYS).join(_pooled(scores, {}).select("method", five.alias("pooled")), "method")
    return rows.groupBy(*KEYS).agg(F.count_if(F.col("score") > F.col("own")).alias("n_own"), F.count_if(F.col("score") > F.col("pooled")).alias("n_pooled"), F.count("*").alias("n"))


def variance_between_cadences(spark: SparkSession, folder: str) -> DataFrame:
    """Eta squared of each method: the share of the variance of scores that lies between cadences. Scores are first
    brought to their logarithm, so that a few extreme ones don't decide."""
    scores = _latest(spark, folder).withColumn("y", F.signum("score") * F.log1p(F.abs("score")))
    per = scores.groupBy(*KEYS).agg(F.count("*").alias("n"), F.sum("y").alias("s"), F.sum(F.col("y") * F.col("y")).alias("q"))
    total = per.groupBy("method").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("b"))
    grand = F.col("s") * F.col("s") / F.col("n")
    return total.select("method", "n", F.round((F.col("b") - grand) / (F.col("q") - grand), 6).alias("eta2"))


def spliced_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Incremental re-search: first versions, with the windows that were scored again replaced by their later scores."""
    keys = [*KEYS, "f_start"]
    scored = table(spark, folder, "window_scores").where("cadence IS NOT NULL")
    base = scored.groupBy(*keys).agg(F.min_by("score", "scored_at").alias("score"), F.min("scored_at").alias("at"))
    later = scored.join(base.select(*keys, "at"), keys).where("scored_at > at").groupBy(*keys).agg(F.max_by("score", "scored_at").alias("score"))
    return base.select(*keys, "score").join(later.select(*keys), keys, "left_anti").unionByName(later).groupBy(*KEYS).agg(
        F.count("*").alias("n_windows"), F.count_if(robust.finite(F.col("score")).isNotNull()).alias("n_usable"), F.round(F.sum(robust.finite(F.col("score"))), 4).alias("sum_score")
    )


_L = """
WITH latest AS (
  SELECT cadence, method, f_start, score FROM (
    SELECT *, row_number() OVER (PARTITION BY cadence, method, f_start ORDER BY scored_at DESC) AS rn FROM window_scores
    WHERE cadence IS NOT NULL AND method IS NOT NULL AND f_start IS NOT NULL)
  WHERE rn = 1 AND isfinite(score))
"""
_T = _L + """, med AS (SELECT *, median(score) OVER (PARTITION BY cadence, method) AS m FROM latest),
st AS (SELECT cadence, method, count(*) AS n, any_value(m) AS median, median(abs(score - m)) * 1.4826 AS mad_sigma FROM med GROUP BY ALL),
far AS (SELECT cadence, method, arr[lo + 1] + (arr[hi + 1] - arr[lo + 1]) * (h - lo) AS far_thresh FROM (
  SELECT cadence, method, arr, (len(arr) - 1) * far_quantile AS h, CAST(floor((len(arr) - 1) * far_quantile) AS BIGINT) AS lo,
         CAST(ceil((len(arr) - 1) * far_quantile) AS BIGINT) AS hi
  FROM (SELECT cadence, method, list_sort(list(score)) AS arr FROM latest GROUP BY ALL) JOIN selection_rules USING (method))),
th AS (SELECT st.*, median + 3 * mad_sigma AS thresh_3, median + 5 * mad_sigma AS thresh_5, far_thresh FROM st JOIN far USING (cadence, method)),
above AS (SELECT cadence, method, f_start, score FROM latest JOIN far USING (cadence, method) WHERE score > far_thresh),
isl AS (SELECT *, sum(o) OVER (PARTITION BY cadence, method ORDER BY f_start) AS k FROM (
  SELECT *, CASE WHEN f_start - lag(f_start) OVER (PARTITION BY cadence, method ORDER BY f_start) <= 512 THEN 0 ELSE 1 END AS o FROM above))
"""
SQL = {
    "scores_latest": _L + "SELECT * FROM latest",
    "robust_stats": _T + "SELECT cadence, method, n, round(median, 6) AS median, round(mad_sigma, 6) AS mad_sigma FROM st",
    "thresholds": _T + """SELECT cadence, method, n, round(median, 6) AS median, round(mad_sigma, 6) AS mad_sigma, round(thresh_3, 6) AS thresh_3,
        round(thresh_5, 6) AS thresh_5, round(far_thresh, 6) AS far_thresh, count(*) FILTER (score > thresh_3) AS n_3,
        count(*) FILTER (score > thresh_5) AS n_5, count(*) FILTER (score > far_thresh) AS n_far
      FROM latest JOIN th USING (cadence, method) GROUP BY cadence, method, n, median, mad_sigma, thresh_3, thresh_5, far_thresh""",
    "sigma_sweep": _T + """SELECT cadence, method, k, count(*) FILTER (score > median + k * mad_sigma) AS n_beyond
      FROM latest JOIN st USING (cadence, method), (VALUES (3.0::DOUBLE), (4.0), (5.0), (7.0), (10.0)) ks(k) GROUP BY cadence, method, k""",
    "score_summary": _L + """, m AS (SELECT method, count(*) AS n, median(score) AS median, quantile_cont(score, 0.99) AS p99 FROM latest GROUP BY 1),
      s AS (SELECT method, median(abs(score - median)) * 1.4826 AS mad_sigma FROM latest JOIN m USING (method) GROUP BY 1)
      SELECT method, n, round(median, 6) AS median, round(p99, 6) AS p99, round(mad_sigma, 6) AS mad_sigma, round(avg(score), 6) AS mean,
        round(stddev_pop(score), 4) AS std, min(score) AS lowest, max(score) AS highest,
        round(100 * avg((score > median + 3 * mad_sigma)::INT), 6) AS pct_3sigma, round(100 * avg((score > median + 5 * mad_sigma)::INT), 6) AS pct_5sigma
      FROM latest JOIN m USING (method) JOIN s USING (method) GROUP BY method, n, median, p99, mad_sigma""",
    "above_far": _T + "SELECT * FROM above",
    "clusters": _T + """SELECT cadence, method, arg_max(f_start, (score, -f_start)) AS f_start_peak, max(score) AS peak_score, round(avg(score), 6) AS mean_score,
        count(*) AS n_snippets, min(f_start) AS f_start_first, max(f_start) AS f_start_last, max(f_start) - min(f_start) + 1024 AS cluster_width_channels
      FROM isl GROUP BY cadence, method, k""",
    "cluster_counts": _T + "SELECT cadence, method, count(DISTINCT k) AS n_clusters, count(*) AS n_windows FROM isl GROUP BY cadence, method",
    "candidate_volume": _T + """, rec AS (SELECT cadence, method, max(off_ceiling) AS c FROM method_results GROUP BY ALL),
      cut AS (SELECT cadence, method, far_thresh, least(far_thresh, CASE WHEN isnan(c) THEN NULL ELSE c END) AS low FROM far LEFT JOIN rec USING (cadence, method)),
      ov AS (SELECT cadence, method, f_start, score > far_thresh AS f FROM latest JOIN cut USING (cadence, method) WHERE score > low),
      a AS (SELECT cadence, method, sum(o) AS n FROM (SELECT cadence, method, CASE WHEN f_start - lag(f_start) OVER (PARTITION BY cadence, method ORDER BY f_start) <= 512 THEN 0 ELSE 1 END AS o FROM ov WHERE f) GROUP BY ALL),
      b AS (SELECT cadence, method, sum(o) AS n FROM (SELECT cadence, method, CASE WHEN f_start - lag(f_start) OVER (PARTITION BY cadence, method ORDER BY f_start) <= 512 THEN 0 ELSE 1 END AS o FROM ov) GROUP BY ALL)
      SELECT cut.cadence, cut.method, CAST(coalesce(a.n, 0) AS BIGINT) AS n_far, CAST(coalesce(b.n, 0) AS BIGINT) AS n_min
      FROM cut LEFT JOIN a USING (cadence, method) LEFT JOIN b USING (cadence, method)""",
    "quiet_windows": _L + """SELECT cadence, method, count(*) AS n_quiet, round(sum(score), 4) AS sum_quiet FROM
      (SELECT *, median(score) OVER (PARTITION BY cadence, method) AS m FROM latest) WHERE score <= m GROUP BY ALL""",
    "peak_background_rank": _L + """, pk AS (SELECT cadence, method, f_start_peak, max(peak_score) AS p FROM method_clusters WHERE NOT isnan(peak_score) GROUP BY ALL)
      SELECT pk.cadence, pk.method, f_start_peak, round(avg((score < p)::INT), 6) AS pct_below FROM pk JOIN latest USING (cadence, method) GROUP BY ALL""",
    "threshold_regime": """SELECT method, CASE WHEN off_ceiling > thresh_5 THEN 'off_ceiling' ELSE 'thresh_5' END AS binding, count(*) AS n,
        round(quantile_cont(off_ceiling / thresh_5, 0.1), 6) AS ratio_p10, round(quantile_cont(off_ceiling / thresh_5, 0.5), 6) AS ratio_median,
        round(quantile_cont(off_ceiling / thresh_5, 0.9), 6) AS ratio_p90
      FROM method_results WHERE NOT isnan(off_ceiling) AND NOT isnan(thresh_5) AND thresh_5 <> 0 GROUP BY 1, 2""",
    "false_positives": _T + """, g AS (SELECT method, median(score) AS m FROM latest GROUP BY 1),
      p AS (SELECT method, any_value(m) + 5 * 1.4826 * median(abs(score - m)) AS pooled FROM latest JOIN g USING (method) GROUP BY 1)
      SELECT cadence, method, count(*) FILTER (score > median + 5 * mad_sigma) AS n_own, count(*) FILTER (score > pooled) AS n_pooled, count(*) AS n
      FROM latest JOIN st USING (cadence, method) JOIN p USING (method) GROUP BY cadence, method""",
    "variance_between_cadences": _L + """, y AS (SELECT cadence, method, sign(score) * ln(1 + abs(score)) AS y FROM latest),
      g AS (SELECT method, avg(y) AS g, count(*) AS n, var_pop(y) * count(*) AS total FROM y GROUP BY 1),
      b AS (SELECT cadence, method, avg(y) AS a, count(*) AS k FROM y GROUP BY 1, 2)
      SELECT method, any_value(n) AS n, round(sum(k * (a - g) * (a - g)) / any_value(total), 6) AS eta2 FROM b JOIN g USING (method) GROUP BY method""",
    "spliced_scores": """WITH l AS (SELECT cadence, method, f_start, score FROM (
        SELECT *, row_number() OVER (PARTITION BY cadence, method, f_start ORDER BY scored_at DESC) AS rn FROM window_scores WHERE cadence IS NOT NULL) WHERE rn = 1)
      SELECT cadence, method, count(*) AS n_windows, count(*) FILTER (isfinite(score)) AS n_usable, round(sum(score) FILTER (isfinite(score)), 4) AS sum_score FROM l GROUP BY ALL""",
    "cfar_windows": _L + """, r AS (SELECT l.*, cfar_half AS h, cfar_k, row_number() OVER w AS i, count(*) OVER (PARTITION BY cadence, method) AS n FROM latest l
        JOIN selection_rules USING (method) WHERE cfar_half > 0 WINDOW w AS (PARTITION BY cadence, method ORDER BY f_start)),
      nb AS (SELECT a.cadence, a.method, a.i, unnest(range(a.i - a.h, a.i + a.h + 1)) AS j, n FROM r a),
      b AS (SELECT nb.cadence, nb.method, nb.i, median(x.score) AS b FROM nb JOIN r x ON x.cadence = nb.cadence AND x.method = nb.method AND x.i = greatest(1, least(nb.n, nb.j)) GROUP BY ALL),
      d AS (SELECT r.*, b.b, abs(score - b.b) AS d FROM r JOIN b USING (cadence, method, i)),
      s AS (SELECT nb.cadence, nb.method, nb.i, median(x.d) * 1.4826 + 1e-9 AS s FROM nb JOIN d x ON x.cadence = nb.cadence AND x.method = nb.method AND x.i = greatest(1, least(nb.n, nb.j)) GROUP BY ALL)
      SELECT cadence, method, f_start, score, round(b, 6) AS local_median, round(s, 6) AS local_sigma FROM d JOIN s USING (cadence, method, i) WHERE (score - b) / s > cfar_k""",
}
QUERIES = {
    f.__name__: f
    for f in (scores_latest, robust_stats, thresholds, sigma_sweep, score_summary, above_far, clusters, cluster_counts, candidate_volume, cfar_windows, quiet_windows,
              peak_background_rank, threshold_regime, false_positives, variance_between_cadences, spliced_scores)
}
