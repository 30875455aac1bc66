"""Injection and recovery: a catalogue of signals, patches of the cells they change, and their outcomes."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skylode.functions.morphologies import NAMES, PATTERNS, canonical_json, changed_span, hash_seed, inject, sample_site

SITES = "cadence string, site int, c0 long, morphology string, site_seed long, site_meta string"
PATCHES = "injection_id string, cadence string, obs int, c0 long, patch array<array<double>>, injection_info string"


def sites(starts: DataFrame, width: int, bins: int, seed: int = 0, names: tuple[str, ...] = NAMES) -> DataFrame:
    """A site of every morphology in each window (cadence, f_start); the seed of a site is a hash of what it is."""

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for cadence, c0 in zip(batch["cadence"], batch["f_start"], strict=True):
                for k, name in enumerate(names):
                    s = hash_seed(seed, cadence, c0, name)
                    rows.append((cadence, k, c0, name, s, canonical_json(sample_site(name, s, width, bins))))
            yield pd.DataFrame(rows, columns=["cadence", "site", "c0", "morphology", "site_seed", "site_meta"])

    return starts.select("cadence", "f_start").mapInPandas(draw, SITES)


def catalogue(sites: DataFrame, patterns: list[str], snrs: list[float]) -> DataFrame:
    """Sites × patterns × SNR, each with an id; the two lists are short, so this is an explode, not a join."""
    if unknown := set(patterns) - set(PATTERNS):
        raise ValueError(f"unknown patterns: {', '.join(sorted(unknown))}")
    grid = sites.withColumn("pattern", F.explode(F.array(*map(F.lit, patterns)))).withColumn("snr", F.explode(F.array(*[F.lit(float(s)) for s in snrs])))
    return grid.withColumn("injection_id", F.concat_ws("|", "cadence", "c0", "morphology", "site_seed", "pattern", "snr"))


def patches(windows: DataFrame, injections: DataFrame, width: int, bins: int, n_obs: int = 6) -> DataFrame:
    """The changed cells of each injection, by observation of its pattern.

    windows: cadence, f_start, pieces, as cut from a block store. A site whose parameters can't be drawn again from its
    seed is an error, since its catalogue doesn't belong to this code. An injection that changes nothing (SNR 0) has none.
    """

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for r in batch.itertuples():
                site = sample_site(r.morphology, int(r.site_seed), width, bins, n_obs)
                if canonical_json(site) != canonical_json(json.loads(r.site_meta)):
                    raise ValueError(f"site of {r.injection_id} differs from its catalogue")
                parts: list[list] = [[] for _ in range(n_obs)]
                for p in sorted(r.pieces, key=lambda p: (p["obs"], p["at"])):
                    parts[p["obs"]].append(np.stack([np.asarray(x, float) for x in p["power"]]))
                window = np.stack([np.concatenate(o, axis=1) for o in parts])
                out, info = inject(window, site, float(r.snr), r.pattern)
                for obs in PATTERNS[r.pattern]:
                    if span := changed_span(window[obs], out[obs]):
                        rows.append((r.injection_id, r.cadence, obs, r.c0 + span[0], out[obs][:, slice(*span)].tolist(), canonical_json(info)))
            yield pd.DataFrame(rows, columns=["injection_id", "cadence", "obs", "c0", "patch", "injection_info"])

    wanted = injections.join(windows.withColumnRenamed("f_start", "c0"), ["cadence", "c0"])
    return wanted.mapInPandas(build, PATCHES)


def split_at_blocks(patches: DataFrame, block: int) -> DataFrame:
    """Patches cut at the borders of blocks of a fixed size, as an overlay wants them."""
    width = F.size(F.get("patch", F.lit(0)))
    first, last = F.floor(F.col("c0") / block), F.floor((F.col("c0") + width - 1) / block)
    cut = patches.withColumn("_b", F.explode(F.sequence(first, last)))
    lo = F.greatest(F.col("c0"), F.col("_b") * block)
    hi = F.least(F.col("c0") + width, (F.col("_b") + 1) * block)
    piece = F.transform("patch", lambda r: F.slice(r, (lo - F.col("c0") + 1).cast("int"), (hi - lo).cast("int")))
    return cut.select(*[c for c in patches.columns if c not in ("c0", "patch")], piece.alias("patch"), lo.alias("c0"))


def outcomes(injections: DataFrame, decided: DataFrame, width: int) -> DataFrame:
    """injections with `detected` and `listed`: whether a cluster, and one of the short list, of the search with that
    injection covers the centre of the signal. decided: variant (the injection_id), as the search of variants gives it."""
    centre = F.col("c0") + F.get_json_object("site_meta", "$.centre").cast("double")
    seen = decided.select(F.col("variant").alias("injection_id"), "cadence", "f_start_first", "f_start_last", "in_short_list")
    met = injections.withColumn("_at", centre).join(seen, ["injection_id", "cadence"], "left")
    over = F.coalesce((F.col("f_start_first") <= F.col("_at")) & (F.col("_at") < F.col("f_start_last") + width), F.lit(False))
    keys = [c for c in injections.columns if c not in ("site", "site_meta")]
    return met.groupBy(*keys).agg(F.bool_or(over).alias("detected"), F.bool_or(over & F.coalesce("in_short_list", F.lit(False))).alias("listed"))
