"""Measures of a detector: rank sums, rates, intervals. Groups may be of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from skylode.operators.candidates import descending_bin
from skylode.operators.islands import running_total


def score_counts(rows: DataFrame, keys: list[str], score: str, label: str) -> DataFrame:
    """keys, score, pos, neg, and the positives and negatives of at least that score; one row per distinct score."""
    counts = rows.where(F.col(score).isNotNull() & ~F.isnan(score) & F.col(label).isNotNull()).groupBy(*keys, score).agg(F.count_if(label).alias("pos"), F.count_if(~F.col(label)).alias("neg"))
    order = [F.desc(score)]
    out = running_total(counts, keys, order, descending_bin(F.col(score)), "pos", "pos_upto")
    return running_total(out, keys, order, descending_bin(F.col(score)), "neg", "neg_upto")


def roc_auc(rows: DataFrame, keys: list[str], score: str, label: str) -> DataFrame:
    """keys, n_pos, n_neg, auc, ks: the area under the ROC curve (ties count half) and the largest distance of the two
    distributions; null where a class is absent."""
    c = score_counts(rows, keys, score, label)
    wins = F.sum(F.col("neg") * (F.col("pos_upto") - F.col("pos") / 2))
    n = c.groupBy(*keys).agg(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"), wins.alias("wins"))
    ks = c.join(n, keys).groupBy(*keys).agg(F.max(F.abs(F.try_divide("pos_upto", "n_pos") - F.try_divide("neg_upto", "n_neg"))).alias("ks"))
    return n.join(ks, keys).select(*keys, "n_pos", "n_neg", F.try_divide("wins", F.col("n_pos") * F.col("n_neg")).alias("auc"), "ks")


def wilson(k: Column, n: Column, z: float = 1.959963984540054) -> tuple[Column, Column, Column]:
    """Rate and 95 % Wilson interval of k of n; zeros of nothing."""
    p = k / n
    mid = (p + z * z / (2 * n)) / (1 + z * z / n)
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    return tuple(F.when(n > 0, x).otherwise(0.0) for x in (p, F.greatest(F.lit(0.0), mid - half), F.least(F.lit(1.0), mid + half)))


def cohens_d(x: str, group: Column) -> Column:
    """Cohen's d of x where group holds against where it doesn't, pooled with n - 1; null for fewer than two of either."""
    a, b = F.when(group, F.col(x)), F.when(~group, F.col(x))
    na, nb = F.count(a), F.count(b)
    pooled = F.sqrt(((na - 1) * F.var_samp(a) + (nb - 1) * F.var_samp(b)) / (na + nb - 2))
    return F.when((na > 1) & (nb > 1) & (pooled > 0), (F.avg(a) - F.avg(b)) / pooled)


def binned_rates(rows: DataFrame, edges: DataFrame, keys: list[str], value: str, flag: str, names: list[str]) -> DataFrame:
    """keys, bin, n, rate: rates in the bins (edge, next edge] of each group's edges, equal edges taken once, the lowest
    value included in the first bin. edges: one row per group, its edges in the columns names."""
    cut = edges.withColumn("e", F.array_sort(F.array_distinct(F.array(*names)))).select(*keys, "e")
    v = F.col(value)
    bin_ = F.greatest(F.lit(0), F.size(F.filter("e", lambda x: x < v)) - 1)
    inside = (v >= F.element_at("e", 1)) & (v <= F.element_at("e", -1))
    return rows.join(cut, keys).where(inside).groupBy(*keys, bin_.cast("int").alias("bin")).agg(F.count("*").alias("n"), F.avg(F.col(flag).cast("double")).alias("rate"))


def lowest_passing(rates: DataFrame, keys: list[str], level: str, rate: str, least: float) -> DataFrame:
    """keys and the lowest level whose rate reaches `least`, null where none does."""
    return rates.groupBy(*keys).agg(F.min(F.when(F.col(rate) >= least, F.col(level))).alias(level))


def share(of: str, *keys: str) -> Column:
    return F.col(of) / F.sum(of).over(W.partitionBy(*keys))
