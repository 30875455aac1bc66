"""Robust statistics of scores: versions, medians, thresholds, exact quantiles of groups of any size.

Groups of up to GROUP values are gathered and sorted, each in one shuffle; larger ones, which one cadence that holds much
of the data would be, go through `exact_quantiles`, which narrows histograms down instead of gathering a group. Both are
exact, so that results don't depend on the way taken.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.types import DoubleType, StructField, StructType

from skylode.operators.islands import running_total
from skylode.session import Scratch, materialize

#: Values of a group that are sorted as one array; larger groups are narrowed down.
GROUP = 200_000
#: Normal consistency factor of the median absolute deviation.
MAD_SIGMA = 1.4826
#: Values that a task may gather for one group and bin.
GATHERED = 10_000


def finite(score: Column) -> Column:
    """score, or null where it is NaN or infinite."""
    return F.when(~F.isnan(score) & (F.abs(score) < float("inf")), score)


def latest_scores(scores: DataFrame) -> DataFrame:
    """cadence, method, f_start, score: of each window the latest usable version; windows without one are left out."""
    keys = ["cadence", "method", "f_start"]
    return (
        scores.where("cadence IS NOT NULL AND method IS NOT NULL AND f_start IS NOT NULL")
        .groupBy(*keys).agg(F.max_by(finite(F.col("score")), F.col("scored_at")).alias("score"))
        .where("score IS NOT NULL")
    )


def parted(rows: DataFrame, keys: list[str], most: int = GROUP) -> tuple[DataFrame | None, DataFrame | None]:
    """The rows of groups of at most `most` rows, and those of larger ones; None where there are none. rows is read twice."""
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("n"))
    large = sizes.where(F.col("n") > most).drop("n")
    if large.isEmpty():
        return rows, None
    large = materialize(large, "large-groups")
    return rows.join(large, keys, "left_anti"), rows.join(large, keys, "left_semi")


def _either(small: DataFrame | None, large: DataFrame | None) -> DataFrame:
    return small.unionByName(large) if large is not None else small


def _sorted_stats(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, s (the sorted values), n, median, mad_sigma."""
    held = rows.groupBy(*keys).agg(F.sort_array(F.collect_list(value)).alias("s"))
    held = held.withColumn("median", median_of_sorted(F.col("s")))
    away = F.array_sort(F.transform("s", lambda x: F.abs(x - F.col("median"))))
    return held.select(*keys, "s", F.size("s").cast("long").alias("n"), "median", (median_of_sorted(away) * MAD_SIGMA).alias("mad_sigma"))


def _narrowed_stats(rows: DataFrame, keys: list[str], value: str, qs: dict[str, float] | None = None) -> DataFrame:
    """keys, n, median, mad_sigma and the quantiles qs, of groups of any size."""
    med = materialize(exact_quantiles(rows, keys, value, {"median": 0.5} | (qs or {})), "medians")
    away = rows.join(med.select(*keys, "median"), keys).select(*keys, F.abs(F.col(value) - F.col("median")).alias("d"))
    mad = exact_quantiles(away, keys, "d", {"m": 0.5}).select(*keys, (F.col("m") * MAD_SIGMA).alias("mad_sigma"))
    return med.join(mad, keys)


def robust_stats(scores: DataFrame, keys: list[str], value: str = "score", most: int = GROUP) -> DataFrame:
    """keys, n, median, mad_sigma; nulls don't count."""
    small, large = parted(scores.where(F.col(value).isNotNull()).select(*keys, value), keys, most)
    cols = [*keys, "n", "median", "mad_sigma"]
    return _either(_sorted_stats(small, keys, value).select(*cols), _narrowed_stats(large, keys, value).select(*cols) if large is not None else None)


def thresholds(scores: DataFrame, rules: DataFrame, most: int = GROUP) -> DataFrame:
    """Thresholds of each cadence and method, with the numbers of scores beyond them: 3 and 5 sigma, and the FAR quantile.

    One shuffle of the scores: what lies beyond is counted in the sorted values too. Methods without a rule aren't listed.
    """
    keys = ["cadence", "method"]
    rules = rules.select("method", "far_quantile")
    small, large = parted(scores.select(*keys, "score"), keys, most)
    limits = {"thresh_3": F.col("median") + 3 * F.col("mad_sigma"), "thresh_5": F.col("median") + 5 * F.col("mad_sigma")}
    names = {"thresh_3": "n_3", "thresh_5": "n_5", "far_thresh": "n_far"}
    cols = [*keys, "n", "median", "mad_sigma", "thresh_3", "thresh_5", "far_thresh", *names.values()]
    held = _sorted_stats(small, keys, "score").join(rules, "method").withColumns(limits | {"far_thresh": quantile_of_sorted(F.col("s"), F.col("far_quantile"))})
    out = held.withColumns({n: _beyond(F.col("s"), F.col(t)) for t, n in names.items()}).select(*cols)
    if large is None:
        return out
    qs = {f"q{i}": r[0] for i, r in enumerate(rules.select("far_quantile").distinct().collect())}  # as many as there are rules
    far = F.coalesce(*[F.when(F.col("far_quantile") == q, F.col(name)) for name, q in qs.items()])
    cut = _narrowed_stats(large, keys, "score", qs).join(rules, "method").withColumns(limits | {"far_thresh": far})
    counts = [F.count_if(F.col("score") > F.col(t)).alias(n) for t, n in names.items()]
    by = cut.select(*cols[:8])
    return out.unionByName(large.join(by, keys).groupBy(*cols[:8]).agg(*counts).select(*cols))


def _beyond(values: Column, limit: Column) -> Column:
    """How many of the values exceed the limit."""
    return F.size(F.filter(values, lambda x: x > limit)).cast("long")


def quantile_of_sorted(values: Column, q: Column) -> Column:
    """The linearly interpolated quantile of a sorted array; null of an empty one."""
    h = (F.size(values) - 1) * q
    lo = F.element_at(values, F.floor(h).cast("int") + 1)
    hi = F.element_at(values, F.ceil(h).cast("int") + 1)
    return F.when(F.size(values) > 0, lo + (hi - lo) * (h - F.floor(h)))


def median_of_sorted(values: Column) -> Column:
    """The middle of a sorted array, or half of the sum of both; null of an empty one."""
    n = F.size(values)
    lo, hi = F.element_at(values, F.floor((n + 1) / 2).cast("int")), F.element_at(values, F.floor(n / 2).cast("int") + 1)
    return F.when(n > 0, lo * 0.5 + hi * 0.5)


def exact_quantiles(rows: DataFrame, keys: list[str], value: str, qs: dict[str, float]) -> DataFrame:
    """keys, n and a column for each quantile, linearly interpolated, of groups of any size; nulls and NaN don't count.

    Counts by bin find the bins that hold the ranks wanted; bins of more than GATHERED values are binned again over their
    own range, the others are gathered. What a task holds doesn't grow with the groups. rows is read once.
    """
    scratch = Scratch(rows.sparkSession)
    v = F.col(value).cast("double")
    rows = rows.select(*keys, (v + F.lit(0.0)).alias("v")).where("v IS NOT NULL AND NOT isnan(v)")
    rows = rows.select(*keys, "v", F.lit(0).cast("long").alias("base"), (F.signum("v") * F.floor(F.log1p(F.abs("v")) * 64)).cast("long").alias("bin"))
    rows = scratch.write(rows, "quantile-rows")
    #: What a row is narrowed to, and what is known of its group.
    part, group = [*keys, "base"], F.col("n")
    ranks = F.array_distinct(F.flatten(F.array(*[F.array(F.floor(q * (group - 1)), F.ceil(q * (group - 1))) for q in qs.values()])))
    found: list[DataFrame] = []
    sizes: DataFrame | None = None
    while True:
        # base: how many values of the group lie below the range that a row was narrowed to; it names the range.
        bins = rows.groupBy(*part, "bin").agg(F.count("*").alias("c"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        bins = bins.withColumn("from", F.col("base") + F.sum("c").over(W.partitionBy(*part).orderBy("bin")) - F.col("c"))
        if sizes is None:
            bins = scratch.write(bins.withColumn("n", F.sum("c").over(W.partitionBy(*keys))), "quantile-bins")
            sizes = scratch.write(bins.groupBy(*keys).agg(F.max("n").alias("n")).where("n > 0"), "quantile-sizes")
        else:
            bins = bins.join(sizes, keys) if keys else bins.crossJoin(sizes)  # without keys, one row
        wanted = F.filter(ranks, lambda r: (r >= F.col("from")) & (r < F.col("from") + F.col("c")))
        bins = bins.withColumn("ranks", wanted).where("size(ranks) > 0").select(*part, "bin", "from", "c", "lo", "hi", "ranks")
        bins = scratch.write(bins, "quantile-bins")
        found.append(bins.where("lo = hi").select(*keys, F.explode("ranks").alias("rank"), F.col("lo").alias("x")))
        held = rows.join(bins.where("lo < hi"), [*part, "bin"])
        small = held.where(F.col("c") <= GATHERED).groupBy(*keys, "from").agg(F.sort_array(F.collect_list("v")).alias("vs"), F.first("ranks").alias("ranks"))
        found.append(small.withColumn("rank", F.explode("ranks")).select(*keys, "rank", F.expr("element_at(vs, cast(rank - `from` + 1 as int))").alias("x")))
        if bins.where((F.col("lo") < F.col("hi")) & (F.col("c") > GATHERED)).isEmpty():
            break
        narrower = F.floor((F.col("v") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2) * 4095).cast("long")
        rows = scratch.write(held.where(F.col("c") > GATHERED).select(*keys, "v", F.col("from").alias("base"), narrower.alias("bin")), "quantile-rows")
    values = found[0]
    for more in found[1:]:
        values = values.unionByName(more)
    # Two ranks a quantile at most, so that a group's values are few.
    values = values.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("rank", "x"))).alias("at"))
    out = sizes.join(values, keys) if keys else sizes.crossJoin(values)  # one row each

    def between(q: float) -> Column:
        h = q * (F.col("n") - 1)
        lo, hi = F.element_at("at", F.floor(h)), F.element_at("at", F.ceil(h))
        return F.when(h > F.floor(h), lo * 0.5 + hi * 0.5).otherwise(lo) if q == 0.5 else lo + (hi - lo) * (h - F.floor(h))

    out = scratch.write(out.select(*keys, "n", *[between(q).alias(name) for name, q in qs.items()]), "quantiles")
    scratch.keep(out)
    return out


def clipped_ceiling(cells: DataFrame, keys: list[str], value: str, q: float = 0.999, rounds: int = 5, k: float = 3.0, most: int = GROUP) -> DataFrame:
    """keys, n, n_kept, ceiling: the quantile q of what iterative clipping keeps.

    Each round takes median and sigma of the values kept, then tests all values again with value <= median + k * sigma,
    so that values can come back; a group stays as it is once sigma is 0 or the number kept doesn't change. What is kept
    is always a first part of the sorted values, so that a round is a count, or for large groups a limit.
    """
    rows = cells.select(*keys, F.col(value).cast("double").alias("v")).where("v IS NOT NULL")
    small, large = parted(rows, keys, most)
    s = F.col("s")
    df = small.groupBy(*keys).agg(F.sort_array(F.collect_list("v")).alias("s")).withColumns({"m": F.size("s"), "still": F.lit(False)})
    for _ in range(rounds):
        kept = F.slice("s", F.lit(1), F.col("m"))
        df = df.withColumn("_c", median_of_sorted(kept))
        df = df.withColumn("_w", median_of_sorted(F.array_sort(F.transform(kept, lambda x: F.abs(x - F.col("_c"))))) * MAD_SIGMA)
        again = F.size(F.filter(s, lambda x: x <= F.col("_c") + k * F.col("_w")))
        df = df.withColumn("_n", F.when(F.col("still") | (F.col("_w") == 0), F.col("m")).otherwise(again))
        df = df.select(*keys, "s", F.col("_n").alias("m"), (F.col("still") | (F.col("_n") == F.col("m"))).alias("still"))
    out = df.select(*keys, F.size("s").cast("long").alias("n"), F.col("m").cast("long").alias("n_kept"), quantile_of_sorted(F.slice("s", F.lit(1), F.col("m")), F.lit(q)).alias("ceiling"))
    return _either(out, _narrowed_ceiling(large, keys, q, rounds, k) if large is not None else None)


def _narrowed_ceiling(rows: DataFrame, keys: list[str], q: float, rounds: int, k: float) -> DataFrame:
    """The same of groups of any size: limit is what a value must not exceed to be kept."""
    rows = materialize(rows, "ceiling-rows")
    state = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.max("v").alias("limit")).withColumns({"n_kept": F.col("n"), "still": F.lit(False)})
    state = materialize(state, "ceiling-state")
    for _ in range(rounds):
        kept = rows.join(state.where("NOT still").select(*keys, "limit"), keys).where("v <= limit").drop("limit")
        stats = _narrowed_stats(kept, keys, "v").select(*keys, "mad_sigma", (F.col("median") + k * F.col("mad_sigma")).alias("cut"))
        moved = state.where("NOT still").join(stats, keys).where("mad_sigma > 0").select(*keys, "cut", F.col("n_kept").alias("_before"))
        counts = rows.join(moved, keys).groupBy(*keys, "cut", "_before").agg(F.count_if(F.col("v") <= F.col("cut")).alias("_now"))
        after = state.join(counts, keys, "left").select(
            *keys, "n", F.coalesce("cut", "limit").alias("limit"), F.coalesce("_now", "n_kept").alias("n_kept"),
            (F.col("cut").isNull() | (F.col("_now") == F.col("_before"))).alias("still"),
        )
        state = materialize(after, "ceiling-state")
        if state.where("NOT still").isEmpty():
            break
    kept = rows.join(state.select(*keys, "limit"), keys).where("v <= limit")
    return exact_quantiles(kept, keys, "v", {"ceiling": q}).select(*keys, F.col("n").alias("n_kept"), "ceiling").join(state.select(*keys, "n"), keys)


#: Rows of a block of neighbourhoods, and those of the blocks that one call computes.
BLOCK, BATCH = 4096, 50_000


def local_stats(scores: DataFrame, keys: list[str], order: str, value: str, half: int, bucket: int = 1 << 20, block: int = BLOCK) -> DataFrame:
    """rows with local_median and local_sigma of the 2 * half + 1 values around each, edges replicated.

    The median of the absolute deviations is taken over the deviations of neighbours from their own local median. Rows are
    numbered by buckets of `order`, then cut into blocks, each with the 2 * half neighbours on either side that it needs,
    so that a group may be of any size. Empty input gives no row.
    """
    near = 2 * half
    numbered = running_total(scores.withColumn("_one", F.lit(1).cast("long")), keys, [F.col(order)], F.floor(F.col(order) / bucket), "_one", "_i").drop("_one")
    numbered = numbered.withColumn("_i", F.col("_i") - 1)
    ends = scores.groupBy(*keys).agg(F.count("*").alias("_n"))
    cut = numbered.join(ends, keys)
    first, last = F.greatest(F.lit(0), F.floor((F.col("_i") - near) / block)), F.least(F.floor((F.col("_n") - 1) / block), F.floor((F.col("_i") + near) / block))
    cut = cut.withColumn("_block", F.explode(F.sequence(first, last)))
    # A task call takes several blocks, about BATCH rows.
    batches = max(1, scores.count() // BATCH)
    cut = cut.withColumn("_batch", F.pmod(F.xxhash64(*keys, "_block"), F.lit(batches)))
    schema = StructType([*scores.schema.fields, StructField("local_median", DoubleType()), StructField("local_sigma", DoubleType())])
    columns = scores.columns

    def medians(values: np.ndarray, at: np.ndarray, n: int, start: int) -> np.ndarray:
        """The local medians at places of the group, from values of places start, start + 1, ..."""
        reach = np.clip(np.arange(at[0] - half, at[-1] + half + 1), 0, n - 1) - start
        return np.median(np.lib.stride_tricks.sliding_window_view(values[reach], 2 * half + 1), axis=1)

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("_i")
        b, n, start = int(rows["_block"].iloc[0]), int(rows["_n"].iloc[0]), int(rows["_i"].iloc[0])
        v = rows[value].to_numpy(float)
        own = np.arange(b * block, min((b + 1) * block, n))
        around = np.arange(max(0, own[0] - half), min(n, own[-1] + half + 1))
        level = medians(v, around, n, start)
        away = np.abs(v[around - start] - level)
        out = rows.iloc[own - start][columns].copy()
        out["local_median"] = level[own - around[0]]
        out["local_sigma"] = medians(away, own, n, int(around[0])) * MAD_SIGMA + 1e-9
        return out

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.concat([one(part) for _, part in rows.groupby([*keys, "_block"], dropna=False, sort=False)])

    return cut.groupBy("_batch").applyInPandas(run, schema)
