"""Score cutoffs that keep a target fraction of each group, by iterative histogram refinement.

Every round counts the undecided scores of each group into bins, finds the bin that holds the target rank, keeps the
rows above it, drops those below and goes on with the rows inside, until the bin holds a single value. The first round's
bins are those of sign(x)·log1p|x|, which need no range and which any float order respects (log1p is semi-monotonic);
later ones divide the range of the bin found. Rows are shuffled once, by group and salt; histograms are combined before
they are shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from skylode.operators.skew import hot_keys, over_salts, salted
from skylode.session import materialize

#: Bins per unit of log1p in the first round, and bins of a range in the later ones.
FIRST, LATER = 32, 4096


@dataclass(frozen=True)
class Cutoffs:
    """kept: keys, item, score of the rows at or above their group's cutoff. groups: keys, n_usable, target, cutoff, kept."""

    kept: DataFrame
    groups: DataFrame


def usable(score: Column) -> Column:
    """score, or null where it is NaN or infinite."""
    return F.when(F.isnan(score) | (F.abs(score) == float("inf")), None).otherwise(score)


def _first_bin(score: Column) -> Column:
    return (F.signum(score) * F.floor(F.log1p(F.abs(score)) * FIRST)).cast("int")


def _later_bin(score: Column, lo: Column, hi: Column) -> Column:
    """Halves keep the differences finite; lo and hi fall into the first and the last bin."""
    return F.floor((score / 2 - lo / 2) / (hi / 2 - lo / 2) * (LATER - 1)).cast("int")


def _zoom(rows: DataFrame, keys: list[str], hot: DataFrame, share: DataFrame | None) -> DataFrame:
    """rows (keys, salt, item, score, bin) of the target bin and above, with `done` and the group's need, lo, hi.

    share: in the first round, the thousandths to drop; later rounds carry what is still needed.
    """
    carried = [] if share is not None else ["n_usable", "target", "need"]
    local = rows.groupBy(*keys, "salt", "bin").agg(F.count("*").alias("n"), F.min("score").alias("lo"), F.max("score").alias("hi"), *[F.max(c).alias(c) for c in carried])
    bins = local.repartition(*keys).groupBy(*keys, "bin").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), *[F.max(c).alias(c) for c in carried])
    down = W.partitionBy(*keys).orderBy(F.desc("bin"))
    at = bins.withColumn("to", F.sum("n").over(down))
    if share is not None:
        at = at.withColumn("n_usable", F.sum("n").over(W.partitionBy(*keys))).join(share, [c for c in share.columns if c != "drop"])
        at = at.withColumn("target", F.expr("((1000 - drop) * n_usable + 999) div 1000")).withColumn("need", F.col("target"))
    state = (
        at.where((F.col("to") >= F.col("need")) & (F.col("to") - F.col("n") < F.col("need")))
        .select(*[F.col(k) for k in keys], F.col("bin").alias("at"), "n_usable", "target", (F.col("need") - F.col("to") + F.col("n")).alias("need"), "lo", "hi")
    )
    state = over_salts(state, hot, keys).hint("shuffle_hash")
    joined = rows.drop("n_usable", "target", "need", "lo", "hi").join(state, [*keys, "salt"]).where("bin >= at")
    return joined.withColumn("done", (F.col("bin") > F.col("at")) | (F.col("lo") == F.col("hi"))).drop("bin", "at")


def keep_fraction(scores: DataFrame, keys: list[str], item: str, score: str, version: str, drop: DataFrame) -> Cutoffs:
    """Keep, of the n usable items of each group, at least ceil((1000 - drop) * n / 1000), by score, ties included.

    scores: one row per item and version; further columns are ignored, whatever their names. Of an item's rows the
    latest version holds (a null version is the earliest; of equally late rows the highest usable score). A null, NaN or
    infinite score isn't usable. drop: some of the keys and `drop`, whole thousandths (below 0 counts as 0, above 1000
    as 1000); a group without it, or with a null key, has no cutoff and isn't listed, nor is one without a usable item
    or with nothing to keep. Null items of a group are one item. Empty input gives empty results.
    """
    rows = scores.select(*keys, F.col(item).alias("_item"), usable(F.col(score).cast("double")).alias("_score"), F.col(version).alias("_version"))
    for k in keys:
        rows = rows.where(F.col(k).isNotNull())
    on = [c for c in drop.columns if c != "drop"]
    hot = hot_keys(rows, keys)
    ordered = F.coalesce("_version", F.lit("0001-01-01").cast(rows.schema["_version"].dataType)) if rows.schema["_version"].dataType.typeName().startswith("timestamp") else F.col("_version")
    rows = salted(rows, hot, keys, F.col("_item")).withColumn("_version", ordered).repartition(*keys, "salt")
    rows = (
        rows.groupBy(*keys, "salt", "_item", "_version").agg(F.max("_score").alias("_score"))
        .groupBy(*keys, "salt", "_item").agg(F.max_by("_score", "_version").alias("score"))
        .where(F.col("score").isNotNull())
        .withColumn("bin", _first_bin(F.col("score")))
    )
    share = drop.where(F.col("drop").isNotNull()).groupBy(*on).agg(F.greatest(F.lit(0), F.least(F.lit(1000), F.min(F.col("drop").cast("long")))).alias("drop"))
    found: list[DataFrame] = []
    while True:
        rows = materialize(_zoom(rows, keys, hot, None if found else share), "cutoff-round")
        found.append(rows.where("done"))
        rows = rows.where("not done")
        if rows.isEmpty():
            break
        rows = rows.withColumn("bin", _later_bin(F.col("score"), F.col("lo"), F.col("hi")))
    kept = found[0]
    for more in found[1:]:
        kept = kept.unionByName(more)
    groups = kept.groupBy(*keys).agg(F.max("n_usable").alias("n_usable"), F.max("target").alias("target"), F.min("score").alias("cutoff"), F.count("*").alias("kept"))
    return Cutoffs(kept.select(*keys, F.col("_item").alias(item), "score"), groups)
