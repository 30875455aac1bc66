"""Queries over anomaly maps, which the test tables hold as the squares of six embeddings in a row."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from skylode.functions.morphologies import PATTERNS
from skylode.operators import maps as M
from skylode.operators import robust
from skylode.operators.models import moments
from skylode.sources.tables import table

#: Maps of one cadence, in order of map_id.
PER_CADENCE = 16
#: Strengths of the injected cells, in standard deviations of a map's cells.
SNRS = [0, 3, 6, 10, 30]
#: OFF cells below which a cadence has no ceiling of its own.
MIN_POOL = 200


def _maps(spark: SparkSession, folder: str) -> DataFrame:
    maps = M.maps_of_vectors(table(spark, folder, "embeddings"))
    return maps.withColumn("cadence", F.expr(f"map_id div {PER_CADENCE}"))


def _cells(spark: SparkSession, folder: str) -> DataFrame:
    return M.cells(_maps(spark, folder))


def _scored(spark: SparkSession, folder: str) -> DataFrame:
    return _maps(spark, folder).withColumn("score", M.top_mean(F.flatten("amap"), 0.01))


def map_scores(spark: SparkSession, folder: str) -> DataFrame:
    """The reductions of a map to one score: mean of all cells, largest cell, mean of the top per cent."""
    flat = F.flatten("amap")
    return _maps(spark, folder).select("map_id", F.round(M.mean(flat), 6).alias("recon"), F.round(F.array_max(flat), 6).alias("max"), F.round(M.top_mean(flat, 0.01), 6).alias("topk"))


def map_peaks(spark: SparkSession, folder: str) -> DataFrame:
    """Row peaks and peak column of each map."""
    peaks = _maps(spark, folder).select("map_id", M.column_peak(F.col("amap")).alias("col_peak"), M.row_peaks(F.col("amap")).alias("p"))
    return peaks.select("map_id", "col_peak", *[F.round(F.get("p", F.lit(r)), 6).alias(f"row_{r}") for r in range(6)])


def _ceilings(spark: SparkSession, folder: str) -> DataFrame:
    maps = _scored(spark, folder)
    off = maps.select("cadence", F.posexplode("amap").alias("r", "row")).where(F.col("r").isin(*M.OFF)).select("cadence", F.explode("row").alias("v"))
    ceiling = robust.clipped_ceiling(off, ["cadence"], "v")
    five = robust.robust_stats(maps.select("cadence", "score"), ["cadence"]).select("cadence", (F.col("median") + 5 * F.col("mad_sigma")).alias("thresh_5"))
    floored = F.when(F.col("n") >= MIN_POOL, F.greatest("ceiling", "thresh_5")).otherwise(F.col("thresh_5"))
    return ceiling.join(five, "cadence").withColumn("off_ceiling", floored)


def off_ceilings(spark: SparkSession, folder: str) -> DataFrame:
    """The sigma-clipped ceiling of each cadence's OFF cells, beside five sigma of its scores; the larger one binds."""
    return _ceilings(spark, folder).select("cadence", "n", "n_kept", *[F.round(c, 6).alias(c) for c in ("ceiling", "thresh_5", "off_ceiling")])


def _decided(spark: SparkSession, folder: str, leak_ref: str, single: float | None) -> DataFrame:
    cut = _ceilings(spark, folder).select("cadence", "off_ceiling")
    ready = M.contrast(_maps(spark, folder).join(cut, "cadence"), F.col("off_ceiling"))
    return M.verdict(ready, F.col("off_ceiling"), F.lit(0.3), leak_ref, None if single is None else F.lit(single))


_VERDICT = ["cadence", "map_id", "off_ceiling", "n_on_hits", "n_off_hits", "n_on_hits_full", "n_off_hits_full", "off_single_leak", "off_leak", "in_short_list"]


def verdict_production(spark: SparkSession, folder: str) -> DataFrame:
    out = _decided(spark, folder, "weakest_on", None).withColumn("off_ceiling", F.round("off_ceiling", 6))
    return out.select(*_VERDICT, *[F.round(c, 6).alias(c) for c in ("on_off_contrast", "on_mean", "off_mean")])


def verdict_hit_reference(spark: SparkSession, folder: str) -> DataFrame:
    return _decided(spark, folder, "weakest_hit_on", 1.0).withColumn("off_ceiling", F.round("off_ceiling", 6)).select(*_VERDICT)


def review_order(spark: SparkSession, folder: str) -> DataFrame:
    """Every map of a cadence in the order of review: the short list before the rest, each by contrast."""
    order = W.partitionBy("cadence").orderBy(F.desc("in_short_list"), F.desc("on_off_contrast"), "map_id")  # PER_CADENCE maps
    ranked = _decided(spark, folder, "weakest_on", None).withColumn("rank", F.row_number().over(order).cast("long"))
    return ranked.select("cadence", "map_id", "rank", "in_short_list", F.round("on_off_contrast", 6).alias("on_off_contrast"), "n_on_hits_full", "n_off_hits_full")


def review_list(spark: SparkSession, folder: str) -> DataFrame:
    """The candidates that reach the reviewer, in order: the short list of each cadence by contrast."""
    short = _decided(spark, folder, "weakest_on", None).where("in_short_list")
    order = W.partitionBy("cadence").orderBy(F.desc("on_off_contrast"), "map_id")
    return short.select("cadence", "map_id", F.row_number().over(order).cast("long").alias("rank"), F.round("on_off_contrast", 6).alias("on_off_contrast"), "n_on_hits_full", "n_off_hits_full")


def pooled_cells(spark: SparkSession, folder: str) -> DataFrame:
    """Mean of squares over blocks of 3 × 16 cells of each map, as the stub scorer pools."""
    pooled = _cells(spark, folder).groupBy("map_id", F.expr("r div 3").cast("int").alias("br"), F.expr("c div 16").cast("int").alias("bc"))
    return pooled.agg(F.round(F.avg(F.col("v") * F.col("v")), 6).alias("pooled"))


def patches(spark: SparkSession, folder: str) -> DataFrame:
    """Row-major blocks of 2 × 8 cells, numbered, with their sums; and back: the place of a block's first cell."""
    patch = F.expr("(r div 2) * 8 + (c div 8)").cast("int")
    return _cells(spark, folder).groupBy("map_id", patch.alias("patch")).agg(F.round(F.sum("v"), 6).alias("total"), F.min(F.col("r") * 64 + F.col("c")).cast("long").alias("first_cell"))


def fused_scores(spark: SparkSession, folder: str) -> DataFrame:
    """A weighted fusion of three grids (cells, their roots, their squares) and its top mean; shares of the components."""
    flat = F.flatten("amap")
    three = _maps(spark, folder).select("map_id", flat.alias("a"), F.transform(flat, F.sqrt).alias("b"), F.transform(flat, lambda x: x * x).alias("c"))
    fused = M.fuse([0.5, 0.3, 0.2], [F.col("a"), F.col("b"), F.col("c")])
    parts = [M.mean(F.col(x)) * w for x, w in (("a", 0.5), ("b", 0.3), ("c", 0.2))]
    whole = parts[0] + parts[1] + parts[2]
    return three.select("map_id", F.round(M.top_mean(fused, 0.01), 6).alias("topk"), *[F.round(p / whole, 6).alias(f"share_{x}") for x, p in zip("abc", parts, strict=True)])


def frame_statistics(spark: SparkSession, folder: str) -> DataFrame:
    """Energy, peakiness, excess kurtosis and the brightest cells' share of each map."""
    flat = F.flatten("amap")
    per = _cells(spark, folder).groupBy("map_id").agg(
        F.avg(F.col("v") * F.col("v")).alias("energy"), (F.max("v") / (F.stddev_pop("v") + 1e-9)).alias("peakiness"), F.kurtosis("v").alias("kurtosis")
    )
    top = _maps(spark, folder).select("map_id", (M.total(F.slice(F.sort_array(flat, asc=False), 1, 4)) / M.total(flat)).alias("top_share"))
    return per.join(top, "map_id").select("map_id", *[F.round(c, 5).alias(c) for c in ("energy", "peakiness", "kurtosis", "top_share")])


def composition(spark: SparkSession, folder: str) -> DataFrame:
    """Largest cell, p99, hot fractions and the spread of column and row means of each map."""
    cells = _cells(spark, folder)
    base = cells.groupBy("map_id").agg(
        F.round(F.max("v"), 6).alias("max"), F.round(F.percentile("v", F.lit(0.99)), 6).alias("p99"),
        F.round(F.avg((F.col("v") > 0.03).cast("double")), 6).alias("hot_3pct"), F.round(F.avg((F.col("v") > 0.06).cast("double")), 6).alias("hot_6pct"),
    )
    cols = cells.groupBy("map_id", "c").agg(F.avg("v").alias("m")).groupBy("map_id").agg(F.round(F.stddev_pop("m"), 6).alias("std_columns"))
    rows = cells.groupBy("map_id", "r").agg(F.avg("v").alias("m")).groupBy("map_id").agg(F.round(F.stddev_pop("m"), 6).alias("std_rows"))
    return base.join(cols, "map_id").join(rows, "map_id")


def hot_fraction_quartiles(spark: SparkSession, folder: str) -> DataFrame:
    """Quiet and bright maps: hot fraction at most the first quartile, at least the third."""
    hot = _cells(spark, folder).groupBy("map_id").agg(F.avg((F.col("v") > 0.03).cast("double")).alias("h"))
    edges = robust.exact_quantiles(hot, [], "h", {"p25": 0.25, "p75": 0.75}).select("p25", "p75")
    kind = F.when(F.col("h") <= F.col("p25"), "quiet").when(F.col("h") >= F.col("p75"), "bright").otherwise("middle")
    return hot.join(edges, F.lit(True)).groupBy(kind.alias("kind")).agg(F.count("*").alias("n"), F.round(F.avg("h"), 6).alias("mean_hot"))


def on_off_rows(spark: SparkSession, folder: str) -> DataFrame:
    """ON-row and OFF-row means of each label's maps, how often OFF is brighter, and Cohen's d of the two."""
    role = F.when(F.col("r") % 2 == 0, "on").otherwise("off")
    means = _cells(spark, folder).groupBy("map_id", "label").agg(F.avg(F.when(role == "on", F.col("v"))).alias("on"), F.avg(F.when(role == "off", F.col("v"))).alias("off"))
    pooled = F.sqrt((F.var_samp("on") * (F.count("*") - 1) + F.var_samp("off") * (F.count("*") - 1)) / (2 * F.count("*") - 2))
    return means.groupBy("label").agg(
        F.count("*").alias("n"), F.round(F.avg("on"), 6).alias("mean_on"), F.round(F.avg("off"), 6).alias("mean_off"),
        F.round(F.avg((F.col("off") > F.col("on")).cast("double")), 6).alias("off_brighter"),
        F.round(F.when(F.count("*") > 1, (F.avg("on") - F.avg("off")) / pooled), 6).alias("cohens_d"),
    )


def channel_normalization(spark: SparkSession, folder: str) -> DataFrame:
    """Mean and standard deviation of each channel over all vectors, in one pass of partial sums."""
    x = table(spark, folder, "embeddings").select(F.posexplode(F.col("embedding").cast("array<double>")).alias("channel", "x"))
    return x.groupBy("channel").agg(F.round(F.avg("x"), 6).alias("mean"), F.round(F.stddev_pop("x"), 6).alias("std"), F.count("*").alias("n"))


def core_transform(spark: SparkSession, folder: str) -> DataFrame:
    """log1p of the cells, centred and scaled by median and unscaled MAD: of each observation, and of the whole map."""
    cells = _cells(spark, folder).withColumn("f", F.log1p(F.greatest("v", F.lit(0.0))))
    out = []
    for mode, keys in (("per_obs", ["map_id", "r"]), ("legacy_concat", ["map_id"])):
        by = W.partitionBy(*keys)
        z = cells.withColumn("m", F.percentile("f", F.lit(0.5)).over(by)).withColumn("d", F.percentile(F.abs(F.col("f") - F.col("m")), F.lit(0.5)).over(by))
        z = z.withColumn("z", (F.col("f") - F.col("m")) / (F.col("d") + 1e-6))
        out.append(z.groupBy("map_id").agg(F.round(F.max("z"), 4).alias("max_z"), F.round(F.min("z"), 4).alias("min_z")).withColumn("mode", F.lit(mode)))
    return out[0].unionByName(out[1])


def downsampled(spark: SparkSession, folder: str) -> DataFrame:
    """Means of each 5 neighbouring channels; the remainder of 4 is dropped."""
    return _cells(spark, folder).where("c < (64 div 5) * 5").groupBy("map_id", "r", F.expr("c div 5").cast("int").alias("c")).agg(F.round(F.avg("v"), 6).alias("v"))


def striping(spark: SparkSession, folder: str) -> DataFrame:
    """The standard deviation of the observations' means of each map."""
    return _cells(spark, folder).groupBy("map_id", "r").agg(F.avg("v").alias("m")).groupBy("map_id").agg(F.round(F.stddev_pop("m"), 6).alias("striping"))


def channel_flags(spark: SparkSession, folder: str) -> DataFrame:
    """Channels whose median over the observations lies beyond five sigma of the map's channels, by map."""
    medians = _cells(spark, folder).groupBy("map_id", "c").agg(F.percentile("v", F.lit(0.5)).alias("m"))
    by = W.partitionBy("map_id")
    z = medians.withColumn("c0", F.percentile("m", F.lit(0.5)).over(by)).withColumn("s", F.percentile(F.abs(F.col("m") - F.col("c0")), F.lit(0.5)).over(by) * robust.MAD_SIGMA)
    bad = F.abs(F.col("m") - F.col("c0")) > 5 * F.col("s")
    return z.groupBy("map_id").agg(F.count_if(bad).alias("n_flagged"), F.round(F.avg(bad.cast("double")), 6).alias("flagged_fraction"))


def row_correlation(spark: SparkSession, folder: str) -> DataFrame:
    """Pearson correlation and ratio of the means of the first ON and the first OFF row of each map."""
    pairs = _maps(spark, folder).select("map_id", F.explode(F.arrays_zip(F.get("amap", F.lit(0)).alias("a"), F.get("amap", F.lit(1)).alias("b"))).alias("p")).select("map_id", "p.*")
    return pairs.toDF("map_id", "a", "b").groupBy("map_id").agg(F.round(F.corr("a", "b"), 6).alias("corr"), F.round(F.avg("a") / F.avg("b"), 6).alias("mean_ratio"))


def memory_addressing(spark: SparkSession, folder: str) -> DataFrame:
    """Attention of each vector over the mean vectors of the labels: softmax of 20-fold dot products, hard shrinkage below 1/8,
    renormalised; the winning slot, its weight and the entropy."""
    x = table(spark, folder, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("x"))
    means = x.select("label", F.posexplode("x").alias("i", "v")).groupBy("label", "i").agg(F.avg("v").alias("v"))
    slots = means.groupBy("label").agg(F.sort_array(F.collect_list(F.struct("i", "v"))).alias("s")).select(F.col("label").alias("slot"), F.transform("s", lambda p: p["v"]).alias("m"))
    memory = slots.agg(F.sort_array(F.collect_list(F.struct("slot", "m"))).alias("memory"))  # one row: the labels are few
    dots = F.transform("memory", lambda s: F.struct(s["slot"].alias("slot"), F.aggregate(F.zip_with("x", s["m"], lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b * 20).alias("d")))
    q = x.join(memory, F.lit(True)).select("vec_id", dots.alias("d"))
    q = q.withColumn("top", F.array_max(F.transform("d", lambda s: s["d"])))
    q = q.withColumn("e", F.transform("d", lambda s: F.struct(s["slot"].alias("slot"), F.exp(s["d"] - F.col("top")).alias("w")))).withColumn("z", M.total(F.transform("e", lambda s: s["w"])))
    q = q.withColumn("w", F.transform("e", lambda s: F.struct(s["slot"].alias("slot"), F.when(s["w"] / F.col("z") >= 0.125, s["w"] / F.col("z")).otherwise(0.0).alias("w"))))
    q = q.withColumn("kept", M.total(F.transform("w", lambda s: s["w"])))
    q = q.select("vec_id", F.explode("w").alias("s"), "kept").select("vec_id", "s.slot", (F.col("s.w") / F.greatest("kept", F.lit(1e-12))).alias("w"))
    return q.groupBy("vec_id").agg(F.max(F.struct("w", (-F.col("slot")).alias("slot"))).alias("b"), F.round(-F.sum(F.when(F.col("w") > 0, F.col("w") * F.ln("w")).otherwise(0.0)), 5).alias("entropy")).select(
        "vec_id", (-F.col("b.slot")).alias("slot"), F.round("b.w", 5).alias("weight"), "entropy"
    )


def reconstruction_losses(spark: SparkSession, folder: str) -> DataFrame:
    """MSE, top-k MSE, masked MSE and pixel disagreement of each vector against its label's mean and a shifted copy."""
    x = table(spark, folder, "embeddings").select("vec_id", "label", F.posexplode(F.col("embedding").cast("array<double>")).alias("i", "x"))
    means = x.groupBy("label", "i").agg(F.avg("x").alias("m"))
    e = x.join(means, ["label", "i"]).withColumn("e", (F.col("x") - F.col("m")) * (F.col("x") - F.col("m")))
    per = e.groupBy("vec_id").agg(F.collect_list("e").alias("es"), F.avg("e").alias("mse"), F.avg(F.when(F.col("i") % 4 == 0, F.col("e"))).alias("masked"), F.avg((F.col("m") - F.col("x") / 2) * (F.col("m") - F.col("x") / 2)).alias("gap"))
    return per.select("vec_id", F.round("mse", 6).alias("mse"), F.round(M.top_mean(F.col("es"), 0.1), 6).alias("topk_mse"), F.round("masked", 6).alias("masked_mse"), F.round("gap", 6).alias("disagreement"))


def effective_rank(spark: SparkSession, folder: str) -> DataFrame:
    """Participation ratio of the channels' covariance, (trace C)^2 / trace C^2, which needs no eigenvalues; dead channels."""
    _, _, cov = moments(table(spark, folder, "embeddings"), "embedding")
    ratio = float(np.trace(cov) ** 2 / (cov * cov).sum())
    return spark.createDataFrame([(round(ratio, 4), int((np.diag(cov) < 1e-12).sum()))], "participation double, dead long")


def injection_recovery(spark: SparkSession, folder: str) -> DataFrame:
    """Maps with a bright cell put into the ON rows of each pattern, snr times the map's cell deviation, decided again at
    their cadence's ceiling: what share reaches the short list, by pattern and snr. Maps that are listed without it are left
    out. The ceiling stays that of the untouched cadence, as one signal among its windows hardly moves it."""
    maps, cut = _maps(spark, folder), _ceilings(spark, folder).select("cadence", "off_ceiling")
    flat = F.flatten("amap")
    sigma = F.sqrt(M.mean(F.transform(flat, lambda x: x * x)) - M.mean(flat) * M.mean(flat))
    base = M.verdict(maps.join(cut, "cadence"), F.col("off_ceiling"), F.lit(0.3)).where("NOT in_short_list").select("map_id", "amap", "off_ceiling", sigma.alias("sigma"))
    patterns = F.create_map(*[x for k, rows in PATTERNS.items() for x in (F.lit(k), F.array(*map(F.lit, rows)))])
    grid = base.select("*", F.explode(patterns).alias("pattern", "on_rows")).withColumn("snr", F.explode(F.array(*map(F.lit, SNRS))))
    at = (F.col("map_id") * 7 % 64).cast("int")
    cell = lambda v, c: v + F.when(c == at, F.col("snr") * F.col("sigma")).otherwise(0.0)
    bright = F.transform("amap", lambda row, r: F.when(F.array_contains("on_rows", r), F.transform(row, cell)).otherwise(row))
    again = M.verdict(grid.withColumn("amap", bright), F.col("off_ceiling"), F.lit(0.3))
    return again.groupBy("pattern", "snr").agg(F.count("*").alias("n"), F.round(F.avg(F.col("in_short_list").cast("double")), 6).alias("listed"), F.round(F.avg(F.col("off_leak").cast("double")), 6).alias("leaking"))


_C = """
WITH v AS (SELECT vec_id, label, vec_id // 6 AS map_id, CAST(vec_id % 6 AS INT) AS r, embedding::DOUBLE[] AS e FROM embeddings),
ok AS (SELECT map_id FROM v GROUP BY map_id HAVING count(*) = 6),
rows_ AS (SELECT map_id, map_id // 16 AS cadence, r, label, [x * x FOR x IN e] AS row FROM v JOIN ok USING (map_id)),
lab AS (SELECT map_id, label FROM rows_ WHERE r = 0),
cells AS (SELECT map_id, cadence, r, CAST(u.i - 1 AS INT) AS c, row[u.i] AS v FROM rows_, (SELECT unnest(range(1, 65)) AS i) u)
"""
_S = _C + """, top AS (SELECT map_id, cadence, sum(v) / 4 AS topk FROM (SELECT *, row_number() OVER (PARTITION BY map_id ORDER BY v DESC) AS k FROM cells) WHERE k <= 4 GROUP BY ALL)
"""
_D = _C + """, thr AS (SELECT cadence, round(quantile_cont(v, 0.99), 6) AS off_ceiling FROM cells WHERE r % 2 = 1 GROUP BY 1),
colm AS (SELECT map_id, c, max(v) AS m FROM cells GROUP BY ALL),
pk AS (SELECT map_id, arg_max(c, (m, -c)) AS p FROM colm GROUP BY 1),
near AS (SELECT map_id, r, max(v) AS m FROM cells JOIN pk USING (map_id) WHERE c BETWEEN p - 3 AND p + 3 GROUP BY ALL),
ful AS (SELECT map_id, cadence, r, max(v) AS m FROM cells GROUP BY ALL),
n1 AS (SELECT map_id, avg(near.m) FILTER (r % 2 = 0) AS on_mean, avg(near.m) FILTER (r % 2 = 1) AS off_mean,
        count(*) FILTER (r % 2 = 0 AND near.m > off_ceiling) AS n_on_hits, count(*) FILTER (r % 2 = 1 AND near.m > off_ceiling) AS n_off_hits
      FROM near JOIN thr ON thr.cadence = map_id // 16 GROUP BY 1),
f1 AS (SELECT map_id, cadence, any_value(off_ceiling) AS off_ceiling, count(*) FILTER (r % 2 = 0 AND m > off_ceiling) AS n_on_hits_full,
        min(m) FILTER (r % 2 = 0) AS w_on, coalesce(min(m) FILTER (r % 2 = 0 AND m > off_ceiling), min(m) FILTER (r % 2 = 0)) AS w_hit
      FROM ful JOIN thr USING (cadence) GROUP BY ALL)
"""


#: The same at the sigma-clipped, floored ceiling of A-05 and A-06: five rounds, each a median, a sigma, a test, what is kept.
_CLIPPED = (
    _S
    + ", k0 AS (SELECT cadence, v, TRUE AS kept, FALSE AS still FROM cells WHERE r % 2 = 1)"
    + "".join(
        f""", m{i} AS (SELECT *, median(CASE WHEN kept THEN v END) OVER (PARTITION BY cadence) AS m FROM k{i - 1}),
        s{i} AS (SELECT *, median(CASE WHEN kept THEN abs(v - m) END) OVER (PARTITION BY cadence) * 1.4826 AS s FROM m{i}),
        x{i} AS (SELECT *, CASE WHEN still OR s = 0 THEN kept ELSE v <= m + 3 * s END AS nx FROM s{i}),
        k{i} AS (SELECT cadence, v, nx AS kept, still OR s = 0 OR sum(nx::INT) OVER (PARTITION BY cadence) = sum(kept::INT) OVER (PARTITION BY cadence) AS still FROM x{i})"""
        for i in range(1, 6)
    )
    + """, oc AS (SELECT cadence, count(*) AS n, quantile_cont(v, 0.999) FILTER (kept) AS ceiling FROM k5 GROUP BY 1),
      om AS (SELECT cadence, topk, median(topk) OVER (PARTITION BY cadence) AS m FROM top), five AS (SELECT cadence, any_value(m) + 5 * median(abs(topk - m)) * 1.4826 AS t FROM om GROUP BY 1),
      thr AS (SELECT cadence, CASE WHEN n >= 200 THEN greatest(ceiling, t) ELSE t END AS off_ceiling FROM oc JOIN five USING (cadence))"""
)
_AT_CEILING = _CLIPPED + _D[_D.index(",\ncolm AS") :]


def _decide(ref: str, frac: float, single: str, start: str = _D) -> str:
    return start + f""", f2 AS (SELECT map_id, count(*) FILTER (r % 2 = 1 AND m > off_ceiling AND m >= {frac} * {ref}) AS n_off_hits_full,
        {single} AS off_single_leak FROM ful JOIN f1 USING (map_id) GROUP BY 1),
      dec AS (SELECT cadence, map_id, off_ceiling, CAST(n_on_hits AS INT) AS n_on_hits, CAST(n_off_hits AS INT) AS n_off_hits, CAST(n_on_hits_full AS INT) AS n_on_hits_full,
        CAST(n_off_hits_full AS INT) AS n_off_hits_full, off_single_leak, n_off_hits_full >= 2 OR off_single_leak AS off_leak,
        n_on_hits_full >= 2 AND NOT (n_off_hits_full >= 2 OR off_single_leak) AS in_short_list, on_mean / greatest(off_mean, 1e-8) AS con, on_mean, off_mean
      FROM f1 JOIN f2 USING (map_id) JOIN n1 USING (map_id))"""


_SINGLE = "coalesce(bool_or(r % 2 = 1 AND m > off_ceiling AND m >= w_hit), FALSE)"
_COLUMNS = "cadence, map_id, round(off_ceiling, 6) AS off_ceiling, n_on_hits, n_off_hits, n_on_hits_full, n_off_hits_full, off_single_leak, off_leak, in_short_list"
SQL = {
    "injection_recovery": _decide("w_on", 0.3, "FALSE") + """, b AS (SELECT map_id, off_ceiling FROM dec WHERE NOT in_short_list), sg AS (SELECT map_id, sqrt(avg(v * v) - avg(v) * avg(v)) AS sg FROM cells GROUP BY 1),
      g AS (SELECT map_id, off_ceiling, sg, p.pattern, p.a, p.b, p.d, snr FROM b JOIN sg USING (map_id),
        (VALUES ('3on', 0, 2, 4), ('2on_02', 0, 2, 0), ('2on_04', 0, 4, 0), ('2on_24', 2, 4, 2), ('1on_0', 0, 0, 0), ('1on_2', 2, 2, 2), ('1on_4', 4, 4, 4)) p(pattern, a, b, d), (VALUES (0), (3), (6), (10), (30)) s(snr)),
      m AS (SELECT g.map_id, off_ceiling, pattern, snr, r, max(v + CASE WHEN r IN (a, g.b, d) AND c = g.map_id * 7 % 64 THEN snr * sg ELSE 0 END) AS m FROM g JOIN cells ON cells.map_id = g.map_id GROUP BY ALL),
      w AS (SELECT map_id, pattern, snr, any_value(off_ceiling) AS t, min(m) FILTER (r % 2 = 0) AS ref, count(*) FILTER (r % 2 = 0 AND m > off_ceiling) AS n_on FROM m GROUP BY ALL),
      l AS (SELECT map_id, pattern, snr, any_value(n_on) AS n_on, count(*) FILTER (r % 2 = 1 AND m > t AND m >= 0.3 * ref) AS n_off FROM m JOIN w USING (map_id, pattern, snr) GROUP BY ALL)
      SELECT pattern, snr, count(*) AS n, round(avg((n_on >= 2 AND n_off < 2)::INT), 6) AS listed, round(avg((n_off >= 2)::INT), 6) AS leaking FROM l GROUP BY 1, 2""",
    "map_scores": _S + "SELECT map_id, round(avg(v), 6) AS recon, round(max(v), 6) AS max, round(any_value(topk), 6) AS topk FROM cells JOIN top USING (map_id) GROUP BY map_id",
    "map_peaks": _C + """, cm AS (SELECT map_id, c, max(v) AS m FROM cells GROUP BY ALL), p AS (SELECT map_id, arg_max(c, (m, -c)) AS col_peak FROM cm GROUP BY 1)
      SELECT map_id, any_value(col_peak) AS col_peak, """ + ", ".join(f"round(max(v) FILTER (r = {r}), 6) AS row_{r}" for r in range(6)) + " FROM cells JOIN p USING (map_id) GROUP BY map_id",
    "off_ceilings": _S + ", k0 AS (SELECT cadence, v, TRUE AS kept, FALSE AS still FROM cells WHERE r % 2 = 1)"
    + "".join(
        f""", m{i} AS (SELECT *, median(CASE WHEN kept THEN v END) OVER (PARTITION BY cadence) AS m FROM k{i - 1}),
        s{i} AS (SELECT *, median(CASE WHEN kept THEN abs(v - m) END) OVER (PARTITION BY cadence) * 1.4826 AS s FROM m{i}),
        t{i} AS (SELECT *, CASE WHEN still OR s = 0 THEN kept ELSE v <= m + 3 * s END AS nx FROM s{i}),
        k{i} AS (SELECT cadence, v, nx AS kept, still OR s = 0 OR sum(nx::INT) OVER (PARTITION BY cadence) = sum(kept::INT) OVER (PARTITION BY cadence) AS still FROM t{i})"""
        for i in range(1, 6)
    )
    + """, c AS (SELECT cadence, count(*) AS n, count(*) FILTER (kept) AS n_kept, quantile_cont(v, 0.999) FILTER (kept) AS ceiling FROM k5 GROUP BY 1),
      m AS (SELECT cadence, topk, median(topk) OVER (PARTITION BY cadence) AS m FROM top), f AS (SELECT cadence, any_value(m) + 5 * median(abs(topk - m)) * 1.4826 AS t5 FROM m GROUP BY 1)
      SELECT cadence, n, n_kept, round(ceiling, 6) AS ceiling, round(t5, 6) AS thresh_5, round(CASE WHEN n >= 200 THEN greatest(ceiling, t5) ELSE t5 END, 6) AS off_ceiling FROM c JOIN f USING (cadence)""",
    "verdict_production": _decide("w_on", 0.3, "FALSE") + """SELECT cadence, map_id, off_ceiling, n_on_hits, n_off_hits, n_on_hits_full, n_off_hits_full, off_single_leak, off_leak, in_short_list,
        round(con, 6) AS on_off_contrast, round(on_mean, 6) AS on_mean, round(off_mean, 6) AS off_mean FROM dec""",
    "verdict_hit_reference": _decide("w_hit", 0.3, "coalesce(bool_or(r % 2 = 1 AND m > off_ceiling AND m >= w_hit), FALSE)")
    + "SELECT cadence, map_id, off_ceiling, n_on_hits, n_off_hits, n_on_hits_full, n_off_hits_full, off_single_leak, off_leak, in_short_list FROM dec",
    "review_list": _decide("w_on", 0.3, "FALSE") + """SELECT cadence, map_id, row_number() OVER (PARTITION BY cadence ORDER BY con DESC, map_id) AS rank, round(con, 6) AS on_off_contrast,
        n_on_hits_full, n_off_hits_full FROM dec WHERE in_short_list""",
    "pooled_cells": _C + "SELECT map_id, r // 3 AS br, c // 16 AS bc, round(avg(v * v), 6) AS pooled FROM cells GROUP BY ALL",
    "patches": _C + "SELECT map_id, (r // 2) * 8 + (c // 8) AS patch, round(sum(v), 6) AS total, CAST(min(r * 64 + c) AS BIGINT) AS first_cell FROM cells GROUP BY ALL",
    "fused_scores": _C + """, f AS (SELECT map_id, v, 0.5 * v AS a, 0.3 * sqrt(v) AS b, 0.2 * v * v AS c2 FROM cells),
      t AS (SELECT map_id, sum(x) / 4 AS topk FROM (SELECT map_id, a + b + c2 AS x, row_number() OVER (PARTITION BY map_id ORDER BY a + b + c2 DESC) AS k FROM f) WHERE k <= 4 GROUP BY 1)
      SELECT map_id, round(any_value(topk), 6) AS topk, round(avg(a) / avg(a + b + c2), 6) AS share_a, round(avg(b) / avg(a + b + c2), 6) AS share_b, round(avg(c2) / avg(a + b + c2), 6) AS share_c
      FROM f JOIN t USING (map_id) GROUP BY map_id""",
    "frame_statistics": _S + """SELECT map_id, round(avg(v * v), 5) AS energy, round(max(v) / (stddev_pop(v) + 1e-9), 5) AS peakiness, round(kurtosis_pop(v), 5) AS kurtosis,
        round(any_value(topk) * 4 / sum(v), 5) AS top_share FROM cells JOIN top USING (map_id) GROUP BY map_id""",
    "composition": _C + """, cm AS (SELECT map_id, stddev_pop(m) AS s FROM (SELECT map_id, c, avg(v) AS m FROM cells GROUP BY ALL) GROUP BY 1),
      rm AS (SELECT map_id, stddev_pop(m) AS s FROM (SELECT map_id, r, avg(v) AS m FROM cells GROUP BY ALL) GROUP BY 1)
      SELECT map_id, round(max(v), 6) AS max, round(quantile_cont(v, 0.99), 6) AS p99, round(avg((v > 0.03)::INT), 6) AS hot_3pct, round(avg((v > 0.06)::INT), 6) AS hot_6pct,
        round(any_value(cm.s), 6) AS std_columns, round(any_value(rm.s), 6) AS std_rows FROM cells JOIN cm USING (map_id) JOIN rm USING (map_id) GROUP BY map_id""",
    "hot_fraction_quartiles": _C + """, h AS (SELECT map_id, avg((v > 0.03)::INT) AS h FROM cells GROUP BY 1), e AS (SELECT quantile_cont(h, 0.25) AS a, quantile_cont(h, 0.75) AS b FROM h)
      SELECT CASE WHEN h <= a THEN 'quiet' WHEN h >= b THEN 'bright' ELSE 'middle' END AS kind, count(*) AS n, round(avg(h), 6) AS mean_hot FROM h, e GROUP BY 1""",
    "on_off_rows": _C + """, m AS (SELECT map_id, label, avg(v) FILTER (r % 2 = 0) AS o, avg(v) FILTER (r % 2 = 1) AS f FROM cells JOIN lab USING (map_id) GROUP BY ALL)
      SELECT label, count(*) AS n, round(avg(o), 6) AS mean_on, round(avg(f), 6) AS mean_off, round(avg((f > o)::INT), 6) AS off_brighter,
        round(CASE WHEN count(*) > 1 THEN (avg(o) - avg(f)) / sqrt((var_samp(o) + var_samp(f)) / 2) END, 6) AS cohens_d FROM m GROUP BY label""",
    "channel_normalization": """SELECT CAST(i - 1 AS INT) AS channel, round(avg(embedding[i]::DOUBLE), 6) AS mean, round(stddev_pop(embedding[i]::DOUBLE), 6) AS std, count(*) AS n
      FROM embeddings, (SELECT unnest(range(1, 65)) AS i) GROUP BY i""",
    "core_transform": _C + ", f AS (SELECT map_id, r, ln(1 + greatest(v, 0)) AS f FROM cells)"
    + " UNION ALL ".join(
        f"""{"SELECT * FROM (" if k else " SELECT * FROM ("}SELECT map_id, round(max((f - m) / (d + 1e-6)), 4) AS max_z, round(min((f - m) / (d + 1e-6)), 4) AS min_z, '{mode}' AS mode FROM (
        SELECT *, median(abs(f - m)) OVER (PARTITION BY {keys}) AS d FROM (SELECT *, median(f) OVER (PARTITION BY {keys}) AS m FROM f)) GROUP BY map_id)"""
        for k, (mode, keys) in enumerate((("per_obs", "map_id, r"), ("legacy_concat", "map_id")))
    ),
    "downsampled": _C + "SELECT map_id, r, c // 5 AS c, round(avg(v), 6) AS v FROM cells WHERE c < 60 GROUP BY map_id, r, c // 5",
    "striping": _C + "SELECT map_id, round(stddev_pop(m), 6) AS striping FROM (SELECT map_id, r, avg(v) AS m FROM cells GROUP BY ALL) GROUP BY 1",
    "channel_flags": _C + """, m AS (SELECT map_id, c, median(v) AS m FROM cells GROUP BY ALL), a AS (SELECT *, median(m) OVER (PARTITION BY map_id) AS c0 FROM m),
      b AS (SELECT *, median(abs(m - c0)) OVER (PARTITION BY map_id) * 1.4826 AS s FROM a)
      SELECT map_id, count(*) FILTER (abs(m - c0) > 5 * s) AS n_flagged, round(avg((abs(m - c0) > 5 * s)::INT), 6) AS flagged_fraction FROM b GROUP BY 1""",
    "row_correlation": _C + """SELECT a.map_id, round(corr(a.v, b.v), 6) AS corr, round(avg(a.v) / avg(b.v), 6) AS mean_ratio FROM cells a JOIN cells b ON a.map_id = b.map_id AND a.c = b.c AND a.r = 0 AND b.r = 1 GROUP BY 1""",
    "memory_addressing": """WITH x AS (SELECT vec_id, label, i, embedding[i]::DOUBLE AS x FROM embeddings, (SELECT unnest(range(1, 65)) AS i)),
      m AS (SELECT label AS slot, i, avg(x) AS m FROM x GROUP BY ALL), d AS (SELECT vec_id, slot, sum(x * m * 20) AS d FROM x JOIN m USING (i) GROUP BY ALL),
      p AS (SELECT vec_id, slot, exp(d - max(d) OVER w) / sum(exp(d)) OVER w * exp(max(d) OVER w) AS p FROM d WINDOW w AS (PARTITION BY vec_id)),
      h AS (SELECT vec_id, slot, CASE WHEN p >= 0.125 THEN p ELSE 0 END AS p FROM p), w AS (SELECT vec_id, slot, p / greatest(sum(p) OVER (PARTITION BY vec_id), 1e-12) AS w FROM h)
      SELECT vec_id, arg_max(slot, (w, -slot)) AS slot, round(max(w), 5) AS weight, round(-sum(CASE WHEN w > 0 THEN w * ln(w) ELSE 0 END), 5) AS entropy FROM w GROUP BY vec_id""",
    "reconstruction_losses": """WITH x AS (SELECT vec_id, label, i - 1 AS i, embedding[i]::DOUBLE AS x FROM embeddings, (SELECT unnest(range(1, 65)) AS i)),
      m AS (SELECT label, i, avg(x) AS m FROM x GROUP BY ALL), e AS (SELECT vec_id, i, (x - m) * (x - m) AS e, (m - x / 2) * (m - x / 2) AS g FROM x JOIN m USING (label, i)),
      t AS (SELECT vec_id, sum(e) / 6 AS t FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY e DESC) AS k FROM e) WHERE k <= 6 GROUP BY 1)
      SELECT vec_id, round(avg(e), 6) AS mse, round(any_value(t), 6) AS topk_mse, round(avg(e) FILTER (i % 4 = 0), 6) AS masked_mse, round(avg(g), 6) AS disagreement FROM e JOIN t USING (vec_id) GROUP BY vec_id""",
    "effective_rank": """WITH x AS (SELECT vec_id, i, embedding[i]::DOUBLE AS x FROM embeddings, (SELECT unnest(range(1, 65)) AS i)),
      c AS (SELECT a.i, b.i AS j, covar_pop(a.x, b.x) AS c FROM x a JOIN x b USING (vec_id) GROUP BY ALL)
      SELECT round(power(sum(c) FILTER (i = j), 2) / sum(c * c), 4) AS participation, count(*) FILTER (i = j AND c < 1e-12) AS dead FROM c""",
}
# Held against the rule that the queries follow; the SQL under their older names states a raw 0.99 quantile as the ceiling.
SQL |= {
    "ceiling_verdicts": _decide("w_on", 0.3, "FALSE", _AT_CEILING) + f"SELECT {_COLUMNS}, round(con, 6) AS on_off_contrast, round(on_mean, 6) AS on_mean, round(off_mean, 6) AS off_mean FROM dec",
    "ceiling_verdicts_hit_reference": _decide("w_hit", 0.3, _SINGLE, _AT_CEILING) + f"SELECT {_COLUMNS} FROM dec",
    "review_order": _decide("w_on", 0.3, "FALSE", _AT_CEILING)
    + """SELECT cadence, map_id, row_number() OVER (PARTITION BY cadence ORDER BY in_short_list DESC, con DESC, map_id) AS rank, in_short_list, round(con, 6) AS on_off_contrast,
      n_on_hits_full, n_off_hits_full FROM dec""",
    "ceiling_recovery": _decide("w_on", 0.3, "FALSE", _AT_CEILING) + SQL["injection_recovery"][SQL["injection_recovery"].index(", b AS (SELECT map_id, off_ceiling") :],
}
QUERIES = {
    f.__name__: f
    for f in (map_scores, map_peaks, off_ceilings, verdict_production, verdict_hit_reference, review_list, pooled_cells, patches, fused_scores, frame_statistics, composition,
              hot_fraction_quartiles, on_off_rows, channel_normalization, core_transform, downsampled, striping, channel_flags, row_correlation, memory_addressing, reconstruction_losses, effective_rank, injection_recovery)
}
QUERIES |= {"ceiling_verdicts": verdict_production, "ceiling_verdicts_hit_reference": verdict_hit_reference, "review_order": review_order, "ceiling_recovery": injection_recovery}
