"""Windows over frequency: cutting a block store into overlapping windows and scoring them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skylode.functions.preprocess import normalise
from skylode.functions.scorers import Scorer, reduce_maps

#: Blocks: one row per cadence, observation and stretch of channels, power time × channels.
BLOCK_SCHEMA = "cadence string, obs int, chan_start long, power array<array<float>>"


def window_grid(cadences: DataFrame, width: int, stride: int) -> DataFrame:
    """cadence and f_start of each whole window; cadences: cadence, nchans."""
    starts = F.sequence(F.lit(0).cast("long"), (F.expr(f"(nchans - {width}) div {stride}") * stride).cast("long"), F.lit(stride).cast("long"))
    return cadences.where(F.col("nchans") >= width).select("cadence", F.explode(starts).alias("f_start"))


#: Channels whose windows one task call assembles.
TILE = 65_536


def tiles(blocks: DataFrame, width: int, tile: int = TILE) -> DataFrame:
    """cadence, tile, obs, at, n, cells: the blocks cut into tiles of channels, each with the width - 1 channels after it
    that its last windows reach into. Cells are one flat array, time by time; only these channels are shuffled twice."""
    span = F.size(F.get("power", F.lit(0)))
    cut = blocks.where(span > 0).withColumn("_end", F.col("chan_start") + span)
    first, last = F.greatest(F.lit(0), F.floor((F.col("chan_start") - width + 1) / tile)), F.floor((F.col("_end") - 1) / tile)
    cut = cut.withColumn("tile", F.explode(F.sequence(first, last)))
    lo = F.greatest(F.col("tile") * tile, F.col("chan_start"))
    hi = F.least((F.col("tile") + 1) * tile + width - 1, F.col("_end"))
    cells = F.flatten(F.transform("power", lambda r: F.slice(r, (lo - F.col("chan_start") + 1).cast("int"), (hi - lo).cast("int"))))
    return cut.select("cadence", "tile", "obs", lo.alias("at"), (hi - lo).alias("n"), cells.alias("cells")).where("n > 0")


def score_blocks(blocks: DataFrame, scorer: Scorer, methods: list[str], width: int, stride: int, mode: str = "per_obs", degree: int | None = 3, n_obs: int = 6, tile: int = TILE) -> DataFrame:
    """cadence, f_start, method, score of each whole window of all n_obs observations; incomplete windows are left out.

    Blocks must not overlap. Channels are shuffled once, by cadence and tile, and windows are cut as views of the
    assembled tile, so that an overlap of windows costs no copy in the shuffle.
    """
    schema = "cadence string, f_start long, method string, score double"

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        cadence, number = key
        base, out = int(number) * tile, []
        times = max(len(c) // n for c, n in zip(rows["cells"], rows["n"], strict=True))
        power = np.zeros((n_obs, times, tile + width - 1), np.float32)
        held = np.zeros((n_obs, tile + width - 1), bool)
        for obs, at, n, cells in zip(rows["obs"], rows["at"], rows["n"], rows["cells"], strict=True):
            if 0 <= obs < n_obs and len(cells) == times * n:
                power[obs, :, at - base : at - base + n] = np.asarray(cells, np.float32).reshape(times, n)
                held[obs, at - base : at - base + n] = True
        whole = held.all(0)
        starts = [f for f in range(-(-base // stride) * stride, base + tile, stride) if whole[f - base : f - base + width].all()]
        for k in range(0, len(starts), 64):
            some = starts[k : k + 64]
            frames = np.stack([normalise(power[:, :, f - base : f - base + width].astype(float), mode, degree) for f in some])
            maps = scorer.anomaly_map(frames) if hasattr(scorer, "anomaly_map") else None
            for m in methods:
                out.append(pd.DataFrame({"cadence": cadence, "f_start": some, "method": m, "score": reduce_maps(maps, m) if maps is not None else scorer.scores(frames, m)}))
        return pd.concat(out) if out else pd.DataFrame({"cadence": [], "f_start": [], "method": [], "score": []})

    return tiles(blocks, width, tile).groupBy("cadence", "tile").applyInPandas(run, schema)


def missing_windows(blocks: DataFrame, scores: DataFrame, width: int, stride: int) -> DataFrame:
    """cadence and f_start of the windows inside a cadence's band, from channel 0 to its last, that have no score."""
    ends = blocks.groupBy("cadence").agg(F.max(F.col("chan_start") + F.size(F.get("power", F.lit(0)))).alias("nchans"))
    return window_grid(ends, width, stride).join(scores.select("cadence", "f_start").distinct(), ["cadence", "f_start"], "left_anti")


def windows_of_blocks(blocks: DataFrame, width: int, stride: int, n_obs: int = 6) -> DataFrame:
    """cadence, f_start, pieces: the parts of the blocks inside each whole window; incomplete windows are left out.

    Blocks must not overlap. Only the channels that a window needs are shuffled, each width / stride times.
    """
    span = F.size(F.get("power", F.lit(0)))
    cut = blocks.withColumn("chan_end", F.col("chan_start") + span)
    first = F.greatest(F.lit(0), F.floor((F.col("chan_start") - width) / stride) + 1)
    last = F.floor((F.col("chan_end") - 1) / stride)
    cut = cut.withColumn("f_start", F.explode(F.sequence(first, last))).withColumn("f_start", F.col("f_start") * stride)
    lo = F.greatest(F.col("f_start"), F.col("chan_start"))
    hi = F.least(F.col("f_start") + width, F.col("chan_end"))
    # The slice bounds are the same for each row of a block's power.
    piece = F.struct("obs", lo.alias("at"), F.transform("power", lambda r: F.slice(r, (lo - F.col("chan_start") + 1).cast("int"), (hi - lo).cast("int"))).alias("power"))
    grouped = cut.select("cadence", "f_start", piece.alias("piece"), (hi - lo).alias("size")).groupBy("cadence", "f_start").agg(F.collect_list("piece").alias("pieces"), F.sum("size").alias("size"))
    return grouped.where(F.col("size") == width * n_obs).drop("size")


def score_windows(windows: DataFrame, scorer: Scorer, methods: list[str], width: int, mode: str = "per_obs", degree: int | None = 3, n_obs: int = 6, keep_maps: bool = False) -> DataFrame:
    """cadence, f_start, method, score of each window; with keep_maps also amap, once per method.

    Windows are assembled, normalised and scored in Arrow batches by one scorer per task.
    """
    schema = "cadence string, f_start long, method string, score double" + (", amap array<array<double>>" if keep_maps else "")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            frames = []
            for pieces in batch["pieces"]:
                parts: list[list] = [[] for _ in range(n_obs)]
                for p in sorted(pieces, key=lambda p: (p["obs"], p["at"])):
                    parts[p["obs"]].append(np.stack([np.asarray(r, float) for r in p["power"]]))
                frames.append(normalise(np.stack([np.concatenate(o, axis=1) for o in parts]), mode, degree))
            if not frames:
                continue
            stacked = np.stack(frames)
            maps = scorer.anomaly_map(stacked) if hasattr(scorer, "anomaly_map") else None
            for m in methods:
                score = reduce_maps(maps, m) if maps is not None else scorer.scores(stacked, m)
                out = pd.DataFrame({"cadence": batch["cadence"], "f_start": batch["f_start"], "method": m, "score": score})
                if keep_maps:
                    out["amap"] = [a.tolist() for a in maps]
                yield out

    return windows.mapInPandas(run, schema)
