"""Anomaly maps: 6 × 64 grids of cells, one row per observation, ON in rows 0, 2, 4 and OFF in rows 1, 3, 5.

A map is a column array<array<double>>; everything here is array expressions that stay inside generated code.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ON, OFF = (0, 2, 4), (1, 3, 5)


def maps_of_vectors(vectors: DataFrame, rows: int = 6) -> DataFrame:
    """map_id, label, amap: each `rows` vectors in a row make a map of squares; an incomplete last one is dropped."""
    cells = F.transform(F.col("embedding").cast("array<double>"), lambda x: x * x)
    numbered = vectors.select((F.expr(f"vec_id div {rows}")).alias("map_id"), F.struct((F.col("vec_id") % rows).cast("int").alias("r"), cells.alias("cells"), "label").alias("row"))
    grouped = numbered.groupBy("map_id").agg(F.sort_array(F.collect_list("row")).alias("rows"))  # at most `rows` each
    return grouped.where(F.size("rows") == rows).select("map_id", F.element_at("rows", 1)["label"].alias("label"), F.transform("rows", lambda r: r["cells"]).alias("amap"))


def row_peaks(amap: Column) -> Column:
    return F.transform(amap, F.array_max)


def pick(values: Column, rows: tuple[int, ...]) -> Column:
    """The elements of an array at some places, counted from 0."""
    return F.array(*[F.get(values, F.lit(r)) for r in rows])


def column_peak(amap: Column, width: int = 64) -> Column:
    """The first column that holds the maximum of the map, counted from 0."""
    maxima = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda c: F.array_max(F.transform(amap, lambda r: F.get(r, c))))
    return (F.array_position(maxima, F.array_max(maxima)) - 1).cast("int")


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def mean(values: Column) -> Column:
    return total(values) / F.size(values)


def contrast(df: DataFrame, threshold: Column, half: int = 3, width: int = 64, floor: float = 1e-8) -> DataFrame:
    """df with on_off_contrast, on_mean, off_mean, n_on_hits, n_off_hits: row maxima near the peak column."""
    lo = F.greatest(F.lit(0), F.col("_peak") - half)
    near = F.transform("amap", lambda r: F.array_max(F.slice(r, lo + 1, F.least(F.lit(width), F.col("_peak") + half + 1) - lo)))
    out = df.withColumn("_peak", column_peak(F.col("amap"), width)).withColumn("_near", near)
    on, off = pick(F.col("_near"), ON), pick(F.col("_near"), OFF)
    out = out.withColumns({"on_mean": mean(on), "off_mean": mean(off), "n_on_hits": F.size(F.filter(on, lambda x: x > threshold)), "n_off_hits": F.size(F.filter(off, lambda x: x > threshold))})
    return out.withColumn("on_off_contrast", F.col("on_mean") / F.greatest("off_mean", F.lit(floor))).drop("_peak", "_near")


def verdict(df: DataFrame, threshold: Column, leak_frac: Column, leak_ref: str = "weakest_on", single_off_frac: Column | None = None) -> DataFrame:
    """df with n_on_hits_full, n_off_hits_full, off_single_leak, off_leak, in_short_list.

    At least two ON rows must exceed the threshold. An OFF row leaks if it does so too and reaches leak_frac of the
    reference, the weakest ON peak or the weakest that exceeds the threshold; two leaks, or a single one that reaches
    single_off_frac of the reference, rule a map out.
    """
    if leak_ref not in ("weakest_on", "weakest_hit_on"):
        raise ValueError(f"unknown leak_ref {leak_ref!r}")
    out = df.withColumn("_peaks", row_peaks(F.col("amap")))
    on, off = pick(F.col("_peaks"), ON), pick(F.col("_peaks"), OFF)
    lit = F.filter(on, lambda x: x > threshold)
    ref = F.when(F.size(lit) > 0, F.array_min(lit)).otherwise(F.array_min(on)) if leak_ref == "weakest_hit_on" else F.array_min(on)
    out = out.withColumns({"n_on_hits_full": F.size(lit), "_ref": ref})
    leaks = F.size(F.filter(off, lambda x: (x > threshold) & (x >= leak_frac * F.col("_ref"))))
    single = F.lit(False) if single_off_frac is None else F.coalesce(F.exists(off, lambda x: (x > threshold) & (x >= single_off_frac * F.col("_ref"))), F.lit(False))
    out = out.withColumns({"n_off_hits_full": leaks, "off_single_leak": single})
    out = out.withColumn("off_leak", (F.col("n_off_hits_full") >= 2) | F.col("off_single_leak"))
    return out.withColumn("in_short_list", (F.col("n_on_hits_full") >= 2) & ~F.col("off_leak")).drop("_peaks", "_ref")


def top_mean(values: Column, frac: float) -> Column:
    """The mean of the k largest values, k the half-even rounding of frac * size, 1 at least."""
    k = F.greatest(F.lit(1), F.bround(F.size(values) * F.lit(frac)).cast("int"))
    return total(F.slice(F.sort_array(values, asc=False), F.lit(1), k)) / k


def fuse(weights: list[float], grids: list[Column]) -> Column:
    """The weighted sum of equal flat grids, cell by cell."""

    def add(weight: float) -> Callable[[Column, Column], Column]:
        return lambda a, x: a + x * weight

    out = F.transform(grids[0], lambda x: x * weights[0])
    for w, g in zip(weights[1:], grids[1:], strict=True):
        out = F.zip_with(out, g, add(w))
    return out


def cells(maps: DataFrame) -> DataFrame:
    """map_id, label, r, c, v: one row per cell."""
    rows = maps.select("map_id", "label", F.posexplode("amap").alias("r", "row"))
    return rows.select("map_id", "label", "r", F.posexplode("row").alias("c", "v"))
