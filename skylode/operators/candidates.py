"""Candidates: latest clusters, ranking, session veto, association with regions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skylode.operators.islands import distinct_overlaps, overlap_join, running_total
from skylode.operators.sessions import merge_intervals
from skylode.session import materialize

KEYS = ["cadence", "method"]


def latest_clusters(clusters: DataFrame) -> DataFrame:
    """One row per cadence, method and peak: of clusters written again the latest run, of equally late ones the largest
    id. Rows without a cadence, method or peak are left out."""
    good = clusters.where("cadence IS NOT NULL AND method IS NOT NULL AND f_start_peak IS NOT NULL")
    rest = [c for c in clusters.columns if c not in (*KEYS, "f_start_peak", "run_at", "cluster_id")]
    last = good.groupBy(*KEYS, "f_start_peak").agg(F.max(F.struct("run_at", "cluster_id", *rest)).alias("c"))
    return last.select(*KEYS, "f_start_peak", "c.*")


def descending_bin(value: Column) -> Column:
    """A coarse whole number that falls as value grows; nulls and NaN come last."""
    good = F.when(~F.isnan(value), value)
    return F.coalesce(-F.floor(F.signum(good) * F.log1p(F.abs(good)) * 32), F.lit(1 << 40)).cast("long")


def ranked(rows: DataFrame, keys: list[str], value: str, tie: str, name: str = "rank") -> DataFrame:
    """rows with the rank of their value in its group, highest first, then by tie; groups may be of any size."""
    return running_total(rows.withColumn("_one", F.lit(1)), keys, [F.desc_nulls_last(value), F.col(tie)], descending_bin(F.col(value)), "_one", name).drop("_one")


def count_greater(rows: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """rows with the number of rows of their group whose value is strictly greater."""
    upto = running_total(rows.withColumn("_one", F.lit(1)), keys, [F.desc_nulls_last(value)], descending_bin(F.col(value)), "_one", "_upto")
    equal = rows.groupBy(*keys, value).agg(F.count("*").alias("_equal"))
    return upto.join(equal, [*keys, value]).withColumn(name, F.col("_upto") - F.col("_equal")).drop("_one", "_upto", "_equal")


def session_of(cadence: Column) -> tuple[Column, Column]:
    """Node and day in the name of a cadence."""
    parts = F.split(cadence, "_")
    return F.get(parts, F.lit(0)), F.get(parts, F.lit(1)).try_cast("long")


def veto_counts(clusters: DataFrame, width: int, tolerance: int = 0, bin_width: int = 8192, by_target: bool = False) -> DataFrame:
    """clusters with n_other: how many other cadences of the same method, night and node have an overlapping cluster.

    A cluster covers [f_start_first, f_start_last + width), the candidate's widened by the tolerance on both sides. Every
    cadence counts, also another one of the same target; with by_target, distinct other targets are counted instead.
    """
    node, day = session_of(F.col("cadence"))
    target = F.array_join(F.slice(F.split("cadence", "_"), 4, 100), "_")
    keys, of = ["node", "day", "method"], ["cadence", "f_start_peak"]
    base = clusters.select(*of, "method", "f_start_first", (F.col("f_start_last") + width).alias("end"), node.alias("node"), day.alias("day"), (target if by_target else F.col("cadence")).alias("owner"))
    base = materialize(base.where("node IS NOT NULL AND day IS NOT NULL AND f_start_first IS NOT NULL AND end IS NOT NULL"), "veto-clusters")
    # What an owner covers, as spans that don't touch.
    key = F.struct(*keys, "owner")
    spans = merge_intervals(base.select(key.alias("key"), F.col("f_start_first").alias("start"), "end", F.lit(1).cast("long").alias("n")), 0, 1 << 20)
    spans = materialize(spans.select("key.*", "start", "end"), "veto-spans")
    queries = base.select(*keys, "cadence", "f_start_peak", (F.col("f_start_first") - tolerance).alias("lo"), (F.col("end") + tolerance).alias("hi"))
    counted = distinct_overlaps(queries, spans, keys, of, bin_width)
    # The cluster's own cadence, or target, is always among them.
    return clusters.join(counted.select(*of, "method", (F.col("n_owners") - 1).alias("n_other")), [*of, "method"], "left").fillna(0, ["n_other"])


def associate(regions: DataFrame, clusters: DataFrame, width: int, bin_width: int = 8192) -> DataFrame:
    """For each region (region, cadence, method, lo, hi) the best cluster that overlaps it; regions without one aren't listed.

    A cluster whose peak window touches the region goes before others; among those the short list, then the contrast
    decide, among the others the peak score; the smaller peak position settles ties.
    """
    spans = clusters.select("cadence", "method", F.col("f_start_peak").alias("peak"), "peak_score", "on_off_contrast", "in_short_list", F.col("f_start_first").alias("first"), (F.col("f_start_last") + width).alias("end"))
    pairs = overlap_join(regions, spans, KEYS, "lo", "hi", "first", "end", bin_width)
    hit = (F.col("peak") < F.col("hi")) & (F.col("peak") + width > F.col("lo"))
    best = F.struct(
        hit.alias("peak_in_region"), F.when(hit, F.coalesce(F.col("in_short_list"), F.lit(False))).alias("s"), F.when(hit, F.coalesce(F.col("on_off_contrast"), F.lit(-1.0))).alias("k"),
        F.coalesce("peak_score", F.lit(-1e300)).alias("score"), (-F.col("peak")).alias("m"), "first", "end", "in_short_list",
    )
    return pairs.groupBy("region", *KEYS).agg(F.count("*").alias("n_overlapping"), F.max(best).alias("b")).select(
        "region", *KEYS, "n_overlapping", (-F.col("b.m")).alias("f_start_peak"), "b.peak_in_region", "b.in_short_list", F.col("b.first").alias("first"), F.col("b.end").alias("end")
    )
