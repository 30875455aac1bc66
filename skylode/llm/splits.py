"""Splits that keep related records together.

Records tied by a shared entity (a night, a file) and everything chained to them form a group: minimum-label propagation
over the bipartite graph of records and entities. In every round a label takes the least label that shares an entity
with it, labels of labels are followed to their end, and the graph is written anew between the labels that are left:
what has converged takes no part in later rounds. Whole groups are then assigned to splits so that the distribution of
a label over the splits deviates least from the target shares.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skylode.functions.observations import base_name
from skylode.operators.islands import running_total
from skylode.operators.skew import HOT, LEAST, hot_keys, over_salts, salted
from skylode.session import Scratch, materialize

#: Bins of the hash that orders the small groups of a label; a task ranks the groups of one bin.
BINS = 4096


def _live(rows: DataFrame, hot: DataFrame | None) -> DataFrame:
    """node, entity, salt, low of the entities that more than one node has; low is the least of them."""
    rows = salted(rows, hot, ["entity"], F.col("node"))
    ends = rows.groupBy("entity", "salt").agg(F.min("node").alias("a"), F.max("node").alias("b")).groupBy("entity").agg(F.min("a").alias("low"), F.max("b").alias("b"))
    return rows.join(over_salts(ends.where("low < b").drop("b"), hot, ["entity"]), ["entity", "salt"])


def _followed(steps: DataFrame, scratch: Scratch) -> DataFrame:
    """node and its label, followed until labels are their own: steps maps each node to a smaller or the same one."""
    while True:
        onward = steps.where("label < node").select(F.col("node").alias("label"), F.col("label").alias("next"))
        moving = steps.select("label").distinct().join(onward, "label")
        if moving.isEmpty():
            return steps
        hot = hot_keys(steps, ["label"])
        jumped = salted(steps, hot, ["label"], F.col("node")).join(over_salts(onward, hot, ["label"]), ["label", "salt"], "left")
        steps = scratch.write(jumped.select("node", F.coalesce("next", "label").alias("label")), "labels")


def components(edges: DataFrame) -> DataFrame:
    """record and group (its smallest record) of every record that shares an entity with another one.

    edges: record (long), entity (any type). Rows with a null in either are left out; repeated rows don't matter.
    """
    scratch = Scratch(edges.sparkSession)
    edges = edges.where(F.col("record").isNotNull() & F.col("entity").isNotNull()).select(F.col("record").alias("node"), "entity")
    hot = hot_keys(edges, ["entity"])
    live = scratch.write(_live(edges, hot), "edges")
    rounds: list[DataFrame] = []
    while not live.isEmpty():
        steps = scratch.write(live.groupBy("node").agg(F.least(F.min("low"), F.col("node")).alias("label")), "labels")
        rounds.append(steps := _followed(steps, scratch))
        loud = hot_keys(live, ["node"])
        moved = salted(live.drop("salt", "low"), loud, ["node"], F.col("entity")).join(over_salts(steps, loud, ["node"]), ["node", "salt"])
        live = scratch.write(_live(moved.select(F.col("label").alias("node"), "entity").distinct(), hot), "edges")
        scratch.keep(live, *rounds)
    if not rounds:
        return edges.select(F.col("node").alias("record"), F.col("node").alias("group")).limit(0)
    # From the last round back: what a round's labels became later.
    labels = rounds[-1]
    for steps in reversed(rounds[:-1]):
        later = labels.select(F.col("node").alias("label"), F.col("label").alias("last"))
        hot = hot_keys(steps, ["label"])
        labels = salted(steps, hot, ["label"], F.col("node")).join(over_salts(later, hot, ["label"]), ["label", "salt"], "left").select("node", F.coalesce("last", "label").alias("label"))
    labels = scratch.write(labels, "labels")
    scratch.keep(labels)
    return labels.select(F.col("node").alias("record"), F.col("label").alias("group"))


def grouped(records: DataFrame, edges: DataFrame, record: str) -> DataFrame:
    """records with `group`: the smallest record of its component, or the record itself where it is tied to none.

    A column `group` that records have already is replaced; a null record has a null group.
    """
    records = records.drop("group")
    found = components(edges).select(F.col("record").alias("_record"), F.col("group").alias("_group"))
    return records.join(found, records[record] == found["_record"], "left").withColumn("group", F.coalesce("_group", record)).drop("_record", "_group")


def _products(cells: DataFrame) -> tuple[list, np.ndarray]:
    """The units of cells (unit, l, n, whole) and their products: sums over the labels of n * n / whole.

    Fewer than 1 / HOT units, so that a label has as few cells; each task adds up one grid of units × units, and the
    driver gets one grid, however many labels there are.
    """
    units = sorted(r[0] for r in cells.select("unit").distinct().collect())
    place = {u: i for i, u in enumerate(units)}
    side = len(units)

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        grid = np.zeros((side, side))
        for batch in batches:
            counts = np.zeros((len(batch), side))
            for row, (held, whole) in enumerate(zip(batch["held"], batch["whole"], strict=True)):
                for x in held:
                    counts[row, place[x["unit"]]] = x["n"] / whole**0.5
            grid += counts.T @ counts
        a, b = np.nonzero(grid)
        yield pd.DataFrame({"a": a, "b": b, "v": grid[a, b]})

    by_label = cells.groupBy("l").agg(F.collect_list(F.struct("unit", "n")).alias("held"), F.first("whole").alias("whole"))
    out = np.zeros((side, side))
    for r in by_label.mapInPandas(sums, "a long, b long, v double").groupBy("a", "b").agg(F.sum("v").alias("v")).collect():
        out[r["a"], r["b"]] = r["v"]
    return units, out


def _assign(sizes: np.ndarray, products: np.ndarray, total: float, shares: np.ndarray) -> np.ndarray:
    """The split of each unit: largest first to where the deviation grows least, then single moves.

    The deviation is the sum over splits and labels, and over splits for all labels, of (held - share * whole)² / whole,
    divided by the share, so that every split is filled in proportion.
    """
    grid = products + np.outer(sizes, sizes) / max(total, 1.0)
    own, to = np.diag(grid), np.full(len(sizes), -1)
    # Of each unit with what each split holds.
    held = np.zeros((len(shares), len(sizes)))
    for _ in range(20):
        moved = False
        for u in np.argsort(-sizes, kind="stable"):
            if to[u] >= 0:
                held[to[u]] -= grid[u]
            best = int(np.argmin((2 * (held[:, u] - shares * 2 * sizes[u]) + own[u]) / shares))
            held[best] += grid[u]
            moved |= best != to[u]
            to[u] = best
        if not moved:
            break
    return to


def split_groups(rows: DataFrame, group: str, label: Column, shares: dict[str, float], seed: int = 0) -> DataFrame:
    """rows with `assigned`, a name of shares: all rows of a group get the same one.

    The sizes of splits, and of each label in them, come as near to the shares as whole groups allow, for any number of
    labels and groups. Groups above HOT of all rows, fewer than 1 / HOT, are placed one by one, on the driver, by their
    products over all labels. The others are placed by Spark: those of one main label in the order of size and a seeded
    hash, along a low-discrepancy sequence over what the large ones leave open of the label's shares. A null label is a
    label; rows with a null group are one group. Splits without a positive share get nothing. Empty input gives no row. A
    column `assigned` that rows have already is replaced.
    """
    spark = rows.sparkSession
    names = [k for k, v in shares.items() if v > 0]
    parts = np.array([shares[k] for k in names]) / sum(shares[k] for k in names)
    # A null label and a null group become texts of their own, which joins can use.
    g, l = F.struct(F.col(group)), F.coalesce(F.concat(F.lit("l"), label.cast("string")), F.lit("-"))
    scratch = Scratch(spark)
    cells = scratch.write(rows.groupBy(F.to_json(g).alias("unit"), l.alias("l")).agg(F.count("*").alias("n")), "group-sizes")
    total = cells.agg(F.sum("n")).first()[0] or 0
    per = cells.groupBy("unit").agg(F.sum("n").alias("size"), F.max_by("l", F.struct("n", "l")).alias("main"))
    per = scratch.write(per.withColumn("large", F.col("size") > max(1.0, total * HOT)), "group-main")
    whole = cells.groupBy("l").agg(F.sum("n").alias("whole"))
    large = scratch.write(cells.join(per.where("large").select("unit", "size"), "unit").join(whole, "l"), "large-groups")
    units, products = _products(large)
    size = {r["unit"]: r["size"] for r in large.select("unit", "size").distinct().collect()}
    to = _assign(np.array([size[u] for u in units], float), products, total, parts) if units else []
    placed = spark.createDataFrame([(u, int(k)) for u, k in zip(units, to, strict=True)], "unit string, k int")
    # What each label still lacks in each split, as the upper ends of intervals of [0, 1).
    held = large.join(F.broadcast(placed), "unit").groupBy("l").agg(*[F.sum(F.when(F.col("k") == k, F.col("n")).otherwise(0)).alias(f"h{k}") for k in range(len(names))])
    lacks = [F.greatest(F.lit(0.0), float(p) * F.col("whole") - F.coalesce(f"h{k}", F.lit(0))) for k, p in enumerate(parts)]
    open_ = whole.join(held, "l", "left").select(F.col("l").alias("main"), F.array(*lacks).alias("lack"))
    small = per.where("not large").select("unit", "main", "size").withColumn("h", F.xxhash64("unit", F.lit(seed))).withColumn("one", F.lit(1))
    order = F.floor(F.log2("size") * 4) * BINS + F.pmod("h", F.lit(BINS))
    ranked = running_total(small.withColumn("o", order), ["main"], [F.col("o"), F.col("h"), F.col("unit")], F.col("o"), "one", "rank")
    phase = F.pmod(F.xxhash64("main", F.lit(seed)), F.lit(1 << 20)) / (1 << 20)
    u = F.pmod(phase + F.col("rank") * 0.6180339887498949, F.lit(1.0))
    ranked = ranked.join(open_, "main")
    upto = F.transform(F.sequence(F.lit(1), F.lit(len(names))), lambda i: F.aggregate(F.slice("lack", F.lit(1), i), F.lit(0.0), lambda a, x: a + x))
    k = F.least(F.lit(len(names) - 1), F.size(F.filter(upto, lambda x: x <= F.col("u") * F.element_at(upto, -1))))
    of = ranked.withColumn("u", u).select("unit", k.alias("k")).unionByName(placed)
    of = materialize(of.select(F.col("unit").alias("_unit"), F.get(F.array(*map(F.lit, names)), F.col("k")).alias("assigned")), "assigned")
    scratch.keep()
    share = max(1, int(total * HOT))
    hot = [(u, -(-n // share)) for u, n in size.items() if n > max(share, LEAST)]
    hot = spark.createDataFrame(hot, "_unit string, salts int") if hot else None
    rows = rows.drop("assigned").withColumn("_unit", F.to_json(g))
    spread = salted(rows.withColumnsRenamed({"salt": "_own_salt"}), hot, ["_unit"], F.monotonically_increasing_id())
    return spread.join(over_salts(of, hot, ["_unit"]), ["_unit", "salt"]).drop("_unit", "salt").withColumnsRenamed({"_own_salt": "salt"})


def night_key(night: Column) -> Column:
    """The number of a night as text: S and a number; null where it isn't one."""
    digits = F.regexp_extract(F.upper(F.regexp_replace(night, r"[\s 　-]", "")), r"^S0*(\d+)$", 1)
    return F.nullif(digits, F.lit(""))


def split_key(split: Column) -> Column:
    """A recorded split by its letters alone; null where it has none."""
    return F.nullif(F.lower(F.regexp_replace(split, r"[^\p{L}]", "")), F.lit(""))


def sequence_edges(sequences: DataFrame) -> DataFrame:
    """record and entity: each sequence with its night and with the base names of its files."""
    night = F.concat(F.lit("night "), night_key(F.col("night")))
    files = F.transform(F.coalesce("files", F.array().cast("array<string>")), lambda f: F.concat(F.lit("file "), base_name(f)))
    return sequences.select(F.col("sequence_id").alias("record"), F.explode(F.array_append(files, night)).alias("entity")).where("entity is not null")


def recorded_splits(groups: DataFrame, nights: DataFrame) -> DataFrame:
    """group and split: the splits recorded for a group's sequences (group, night, split) and for the nights they name."""
    nights = nights.select(night_key(F.col("name")).alias("n"), split_key(F.col("split")).alias("s")).where("n is not null and s is not null").distinct()
    named = groups.select("group", night_key(F.col("night")).alias("n")).where("n is not null").distinct()
    own = groups.select("group", split_key(F.col("split")).alias("s"))
    return own.unionByName(named.join(nights, "n").select("group", "s")).where("s is not null").select("group", F.col("s").alias("split")).distinct()
