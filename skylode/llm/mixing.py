"""Mixing sources to target weights by capped water-filling, and seeded sampling of whole and fractional repetitions."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from skylode.operators.islands import running_total
from skylode.session import Scratch

#: Bins of the hash that orders a source's documents; a task ranks the documents of one bin.
BINS = 65_536


class Mix(NamedTuple):
    """copies: key, source, size, copies of each document used. report: a row for each source of the weights."""

    copies: DataFrame
    report: DataFrame


def water_fill(weights: dict[str, float], caps: dict[str, float], total: float) -> dict[str, float]:
    """The amount of each source: in proportion to the weights, none above its cap, together the total or all caps.

    Sources whose proportional amount would exceed their cap are clamped to it, and what they leave is shared out among
    the others by weight, until none exceeds. This is `levels` for a few sources in memory.
    """
    amounts = dict.fromkeys(weights, 0.0)
    open_ = {s for s, w in weights.items() if w > 0}
    left = min(float(total), float(sum(caps.get(s, 0.0) for s in open_)))
    while open_ and left > 0:
        weight = sum(weights[s] for s in open_)
        over = {s for s in open_ if left * weights[s] / weight >= caps.get(s, 0.0)}
        if not over:
            return amounts | {s: left * weights[s] / weight for s in open_}
        for s in over:
            amounts[s] = float(caps.get(s, 0.0))
            left -= amounts[s]
        open_ -= over
    return amounts


def level(sources: DataFrame, total: float) -> float:
    """The amount per weight that all sources get which their caps leave open; infinite where the caps hold for all.

    sources: weight, cap. Sources are clamped in the order of cap / weight, so that running totals in this order, of the
    caps before a source and of the weights from it on, give the level at which it would be the first one open; clamped
    ones lie below the level sought, open ones at or above it, and it is the largest of all. Any number of sources.
    """
    open_ = sources.where("weight > 0").withColumn("ratio", F.col("cap") / F.col("weight"))
    sums = open_.agg(F.sum("weight").alias("w"), F.sum("cap").alias("c")).first()
    if sums["w"] is None or total >= sums["c"]:
        return float("inf")
    bin_ = F.floor(F.log1p("ratio") * 32)
    ordered = running_total(open_, [], [F.col("ratio"), F.col("source")], bin_, "weight", "w_to")
    ordered = running_total(ordered, [], [F.col("ratio"), F.col("source")], bin_, "cap", "c_to")
    left = F.lit(float(total)) - (F.col("c_to") - F.col("cap"))
    return float(ordered.agg(F.max(left / (F.lit(sums["w"]) - F.col("w_to") + F.col("weight")))).first()[0])


def mix(documents: DataFrame, weights: DataFrame, total: int | None = None, seed: int = 0) -> Mix:
    """Choose copies of documents so that the sources' shares of the size come as near to the weights as the caps allow.

    documents: key, source, size (long); weights: source, weight, max_repeats. Sources are equal without regard to case
    and outer blanks. A null or non-positive weight, or a source without a row in weights, has no share; several rows of
    one source add up their weights and take the least max_repeats; null max_repeats means 1. total is the size aimed
    at, by default that of all documents with a share. Of the n-fold use that a source's amount asks for, every document
    is used floor(n) times, and those first in the order of a seeded hash once more, to within half a document of the
    rest. Documents of null or no size are never used. Empty tables give empty results.
    """
    name: Column = F.lower(F.btrim(F.col("source")))
    plan = (
        weights.withColumn("source", name).where("source is not null").groupBy("source")
        .agg(F.sum(F.when(F.col("weight") > 0, F.col("weight")).otherwise(0.0)).alias("weight"), F.min(F.coalesce("max_repeats", F.lit(1))).alias("max_repeats"))
    )
    sized = documents.select("key", name.alias("source"), F.col("size").cast("long").alias("size")).where("size > 0 and source is not null")
    sized = sized.withColumn("h", F.xxhash64("key", F.lit(seed)))
    scratch = Scratch(documents.sparkSession)
    per = sized.groupBy("source").agg(F.sum("size").alias("tokens"), F.count("*").alias("n_documents"))
    held = plan.join(per, "source", "left").fillna(0, ["tokens", "n_documents"])
    held = scratch.write(held.withColumn("cap", (F.col("tokens") * F.greatest(F.lit(0), F.col("max_repeats"))).cast("double")), "mix-plan")
    aim = total if total is not None else held.where("weight > 0").agg(F.sum("tokens")).first()[0] or 0
    planned = F.when(F.col("weight") > 0, F.least("cap", F.lit(level(held, max(0.0, aim))) * F.col("weight"))).otherwise(0.0)
    whole = F.when(F.col("tokens") > 0, F.least(F.floor(F.col("planned") / F.col("tokens")), F.greatest(F.lit(0), F.col("max_repeats")))).otherwise(0)
    chosen = held.withColumn("planned", planned).withColumn("whole", whole.cast("long"))
    chosen = chosen.withColumn("rest", F.col("planned") - F.col("whole") * F.col("tokens")).withColumn("clamped", (F.col("planned") >= F.col("cap")) & (F.col("weight") > 0))
    chosen = scratch.write(chosen, "mix-planned")
    used = sized.join(chosen.where("planned > 0").select("source", "whole", "rest"), "source").withColumn("bin", F.pmod("h", F.lit(BINS)).cast("int"))
    upto = W.partitionBy("source").orderBy("bin")
    bins = used.where("rest > 0").groupBy("source", "bin").agg(F.sum("size").alias("s"), F.max("rest").alias("rest")).withColumn("to", F.sum("s").over(upto))
    last = bins.where("to >= rest and to - s < rest").select("source", F.col("bin").alias("last"), (F.col("rest") - F.col("to") + F.col("s")).alias("open"))
    last = scratch.write(last, "mix-last-bins")
    used = used.join(last, "source", "left")
    more = F.when((F.col("rest") > 0) & (F.col("last").isNull() | (F.col("bin") < F.col("last"))), 1).otherwise(0)
    sure = used.where("last is null or bin <> last").withColumn("copies", F.col("whole") + more)
    inside = W.partitionBy("source").orderBy("h", "key", "size").rowsBetween(W.unboundedPreceding, 0)
    edge = used.where("bin = last").withColumn("running", F.sum("size").over(inside))
    edge = edge.withColumn("copies", F.col("whole") + F.when(F.col("running") - F.col("size") / 2 <= F.col("open"), 1).otherwise(0))
    cols = ["key", "source", "size", "copies"]
    copies = scratch.write(sure.select(cols).unionByName(edge.select(cols)).where("copies > 0"), "mix-copies")
    reached = copies.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("used"), F.max("copies").alias("most_copies"))
    w, u = held.agg(F.sum("weight")).first()[0], reached.agg(F.sum("used")).first()[0]
    report = (
        chosen.join(reached, "source", "left").fillna(0, ["used", "most_copies"])
        .select(
            "source", "weight", "max_repeats", "n_documents", "tokens",
            (F.col("weight") / F.lit(w or 1.0)).alias("target_share"), "planned", "clamped",
            F.col("used").cast("long").alias("used"), (F.col("used") / F.lit(u or 1)).alias("share"),
            F.when(F.col("tokens") > 0, F.col("used") / F.col("tokens")).alias("epochs"), "most_copies",
        )
    )
    report = scratch.write(report, "mix-report")
    scratch.keep(copies, report)
    return Mix(copies, report)
