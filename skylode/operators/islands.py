"""Gaps and islands, running totals and interval overlap on keys of any size.

Positions are cut into buckets: windows see one bucket of a key, and what passes from bucket to bucket goes through
windows over one row per bucket.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def island_starts(rows: DataFrame, keys: list[str], pos: str, gap: int, bucket: int) -> DataFrame:
    """rows with `island`, the first position of the run of the key that a row lies in; a step above gap ends a run.

    Equal positions lie in one run. bucket must exceed gap and keep the rows of a key and bucket few.
    """
    cut = rows.withColumn("_b", F.floor(F.col(pos) / bucket))
    inside, earlier = W.partitionBy(*keys, "_b").orderBy(pos), W.partitionBy(*keys).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    ends = cut.groupBy(*keys, "_b").agg(F.max(pos).alias("_m")).select(*keys, "_b", F.max("_m").over(earlier).alias("_carried"))
    before = F.coalesce(F.lag(pos).over(inside), F.col("_carried"))
    marked = cut.join(ends, [*keys, "_b"]).withColumn("_opens", F.when(before.isNull() | (F.col(pos) - before > gap), F.col(pos)))
    opened = marked.groupBy(*keys, "_b").agg(F.max("_opens").alias("_m")).select(*keys, "_b", F.max("_m").over(earlier).alias("_open"))
    local = F.max("_opens").over(inside)
    return marked.join(opened, [*keys, "_b"]).withColumn("island", F.coalesce(local, F.col("_open"))).drop("_b", "_carried", "_opens", "_open")


def summarize_clusters(rows: DataFrame, keys: list[str], stride: int, width: int, bucket: int = 1 << 20) -> DataFrame:
    """One row for each run of windows (keys, f_start, score): its peak (first on ties), mean, size and span."""
    runs = island_starts(rows, keys, "f_start", stride, bucket)
    return (
        runs.groupBy(*keys, "island")
        .agg(
            F.max(F.struct("score", (-F.col("f_start")).alias("m"))).alias("p"),
            F.avg("score").alias("mean_score"), F.count("*").alias("n_snippets"), F.max("f_start").alias("f_start_last"),
        )
        .select(
            *keys, (-F.col("p.m")).alias("f_start_peak"), F.col("p.score").alias("peak_score"), "mean_score", "n_snippets",
            F.col("island").alias("f_start_first"), "f_start_last", (F.col("f_start_last") - F.col("island") + width).alias("cluster_width_channels"),
        )
    )


def running_total(rows: DataFrame, keys: list[str], order: list[Column], bin_: Column, value: str, name: str) -> DataFrame:
    """rows with the running sum of value, rows of equal order together; bin_ must grow with the first of order.

    Sums of the bins are few and are summed in one window; inside a bin a second window goes on.
    """
    cut = rows.withColumn("_bin", bin_)
    sums = cut.groupBy(*keys, "_bin").agg(F.sum(value).alias("_s"))
    before = W.partitionBy(*keys).orderBy("_bin").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select(*keys, "_bin", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_before"))
    inside = W.partitionBy(*keys, "_bin").orderBy(*order)
    return cut.join(sums, [*keys, "_bin"]).withColumn(name, F.sum(value).over(inside) + F.col("_before")).drop("_bin", "_before")


def overlap_join(left: DataFrame, right: DataFrame, keys: list[str], lo: str, hi: str, start: str, end: str, width: int) -> DataFrame:
    """Pairs of equal keys with start < hi and end > lo, without comparing all pairs of a key.

    Both sides are cut into bins of `width` and joined on key and bin; a pair that shares several bins is taken in the
    first of them. Columns other than the keys must differ in name.
    """

    def binned(df: DataFrame, a: str, b: str) -> DataFrame:
        # Half-open spans: the last bin is that of the last position inside.
        first, last = F.floor(F.col(a) / width), F.floor((F.col(b) - 1) / width)
        return df.withColumn(f"_first_{a}", first).withColumn("_bin", F.explode(F.sequence(first, F.greatest(first, last))))

    pairs = binned(left, lo, hi).join(binned(right, start, end), [*keys, "_bin"])
    once = F.col("_bin") == F.greatest(f"_first_{lo}", f"_first_{start}")
    return pairs.where(once & (F.col(start) < F.col(hi)) & (F.col(end) > F.col(lo))).drop("_bin", f"_first_{lo}", f"_first_{start}")


def count_at_most(values: np.ndarray, first: np.ndarray, last: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """For each query, how many of values[first:last] are at most its limit, by blocks of doubling size, each sorted."""
    n = len(values)
    rank = np.empty(n, np.int64)
    rank[np.argsort(values, kind="stable")] = np.arange(n)
    below = np.searchsorted(np.sort(values), limit, "right")  # values of a lesser rank than this are at most the limit
    left, right, out = first.copy(), np.maximum(first, last), np.zeros(len(first), np.int64)
    for level in range(int(n).bit_length() + 1):
        blocks = np.sort((np.arange(n) >> level) * (n + 1) + rank)

        def add(which: np.ndarray, block: np.ndarray, blocks: np.ndarray = blocks) -> None:
            at = block[which] * (n + 1)
            out[which] += np.searchsorted(blocks, at + below[which]) - np.searchsorted(blocks, at)

        odd = np.flatnonzero((left < right) & (left & 1 == 1))
        add(odd, left)
        left[odd] += 1
        odd = np.flatnonzero((left < right) & (right & 1 == 1))
        right[odd] -= 1
        add(odd, right)
        left, right = left >> 1, right >> 1
    return out


def distinct_overlaps(queries: DataFrame, spans: DataFrame, keys: list[str], of: list[str], bin_width: int, batch: int = 50_000) -> DataFrame:
    """keys, of, n_owners: for each query (keys, of, lo, hi) the number of owners with a span of equal keys that overlaps it.

    spans: keys, owner, start, end, of one owner more than a touch apart. No pair of query and span is formed: an owner
    overlaps a query if one of its spans covers lo, which running totals of starts and ends count, or else if one starts
    inside the query whose predecessor ends at or before lo; these are counted by bins of the starts, in sorted order.
    """
    # Spans that cover lo.
    moves = spans.select(*keys, F.explode(F.array(F.struct(F.col("start").alias("p"), F.lit(1).alias("d")), F.struct(F.col("end").alias("p"), F.lit(-1).alias("d")))).alias("m"))
    moves = moves.select(*keys, "m.p", "m.d", *[F.lit(None).cast(queries.schema[c].dataType).alias(c) for c in of], F.lit(False).alias("asks"))
    asked = queries.select(*keys, F.col("lo").alias("p"), F.lit(0).alias("d"), *of, F.lit(True).alias("asks"))
    covering = running_total(moves.unionByName(asked), keys, [F.col("p")], F.floor(F.col("p") / bin_width), "d", "n").where("asks").select(*keys, *of, "n")
    # Spans that start inside, by bin of the start.
    before = F.lag("end").over(W.partitionBy(*keys, "owner").orderBy("start"))
    starts = spans.select(*keys, F.col("start").alias("a"), F.coalesce(before, F.lit(-(1 << 62))).alias("z"), F.floor(F.col("start") / bin_width).alias("_bin"))
    bins = F.sequence(F.floor((F.col("lo") + 1) / bin_width), F.floor((F.col("hi") - 1) / bin_width))
    pieces = queries.where("hi > lo + 1").select(*keys, *of, "lo", "hi", F.explode(bins).alias("_bin"))
    pieces = pieces.select(*keys, *of, "_bin", F.greatest(F.col("lo") + 1, F.col("_bin") * bin_width).alias("a"), F.least("hi", (F.col("_bin") + 1) * bin_width).alias("b"), F.col("lo").alias("z"), F.lit(True).alias("asks"))
    both = starts.withColumn("asks", F.lit(False)).unionByName(pieces, allowMissingColumns=True)
    batches = max(1, queries.count() // batch)
    names = [*keys, *of]
    types = [queries.schema[c].dataType.simpleString() for c in names]

    def count(rows: pd.DataFrame) -> pd.DataFrame:
        group = rows.groupby([*keys, "_bin"], dropna=False, sort=False).ngroup().to_numpy(np.int64)
        at = group * (bin_width + 1) - rows["_bin"].to_numpy(np.int64) * bin_width
        asks = rows["asks"].to_numpy(bool)
        place, ends = (at + rows["a"].to_numpy(np.int64))[~asks], rows["z"].to_numpy(np.int64)[~asks]
        order = np.argsort(place, kind="stable")
        wanted = rows[asks]
        lo, hi = at[asks] + wanted["a"].to_numpy(np.int64), at[asks] + wanted["b"].to_numpy(np.int64)
        first, last = np.searchsorted(place[order], lo), np.searchsorted(place[order], hi)
        out = wanted[names].copy()
        out["n"] = count_at_most(ends[order], first, last, wanted["z"].to_numpy(np.int64))
        return out

    schema = ", ".join([*(f"`{c}` {t}" for c, t in zip(names, types, strict=True)), "n long"])
    starting = both.withColumn("_batch", F.pmod(F.xxhash64(*keys, "_bin"), F.lit(batches))).groupBy("_batch").applyInPandas(count, schema)
    return covering.unionByName(starting).groupBy(*names).agg(F.sum("n").alias("n_owners"))
