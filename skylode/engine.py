"""The search as one object: scores, thresholds, clusters, verdicts, veto and rank, each a lazy DataFrame.

Every stage works by cadence and method, and by `variant` too where its input has one: a variant is a cadence with
patches put into it, and many of them are searched in one job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from skylode.functions.scorers import Scorer
from skylode.operators import candidates, islands, maps, robust, windows
from skylode.rules import Rule
from skylode.session import materialize

KEYS = ["cadence", "method"]


def keys_of(df: DataFrame) -> list[str]:
    return [k for k in ("variant", *KEYS) if k in df.columns]


class SearchEngine:
    """Search block stores with a rule and a scorer.

    bands: optional cadence, fch1_mhz, foff_hz, for the peaks' frequencies and the excluded bands. Window statistics use
    usable windows only; local statistics use all. incomplete says what happens to windows that lack channels or
    observations: "skip" leaves them out, "abort" raises.
    """

    def __init__(self, rule: Rule, scorer: Scorer, methods: list[str] | None = None, width: int = 1024, stride: int = 512, mode: str = "per_obs", degree: int | None = 3, incomplete: str = "skip"):
        if incomplete not in ("skip", "abort"):
            raise ValueError(f"incomplete is 'skip' or 'abort', not {incomplete!r}")
        self.rule, self.scorer, self.methods, self.incomplete = rule, scorer, methods or ["topk"], incomplete
        self.width, self.stride, self.mode, self.degree = width, stride, mode, degree

    def windows(self, blocks: DataFrame) -> DataFrame:
        return windows.windows_of_blocks(blocks, self.width, self.stride)

    def scores(self, blocks: DataFrame, bands: DataFrame | None = None) -> DataFrame:
        """cadence, method, f_start, score, usable; written once, since scoring is dear."""
        scored = windows.score_blocks(blocks, self.scorer, self.methods, self.width, self.stride, self.mode, self.degree)
        scored = materialize(self.mark_usable(scored, bands), "scores")
        if self.incomplete == "abort" and (missing := windows.missing_windows(blocks, scored, self.width, self.stride).count()):
            raise ValueError(f"{missing} windows lack channels or observations")
        return scored

    def mark_usable(self, scores: DataFrame, bands: DataFrame | None = None) -> DataFrame:
        if not self.rule.exclude_mhz or bands is None:
            return scores.withColumn("usable", F.lit(True))
        a, b = (F.col("fch1_mhz") + F.col("foff_hz") / 1e6 * (F.col("f_start") + x) for x in (0, self.width))
        out = F.array(*[F.struct(F.lit(lo).alias("lo"), F.lit(hi).alias("hi")) for lo, hi in self.rule.exclude_mhz])
        hit = F.exists(out, lambda e: (F.greatest(a, b) > e["lo"]) & (F.least(a, b) < e["hi"]))
        return scores.join(bands, "cadence", "left").withColumn("usable", ~F.coalesce(hit, F.lit(False))).drop("fch1_mhz", "foff_hz")

    def thresholds(self, scores: DataFrame) -> DataFrame:
        """keys, n, median, mad_sigma and the thresholds of the usable windows."""
        keys = keys_of(scores)
        small, large = robust.parted(scores.where("usable").select(*keys, "score"), keys)
        cols = [*keys, "n", "median", "mad_sigma", "far_thresh"]
        held = robust._sorted_stats(small, keys, "score")
        stats = held.withColumn("far_thresh", robust.quantile_of_sorted(F.col("s"), F.lit(self.rule.far_quantile))).select(*cols)
        if large is not None:
            stats = stats.unionByName(robust._narrowed_stats(large, keys, "score", {"far_thresh": self.rule.far_quantile}).select(*cols))
        return stats.withColumns({"thresh_3": F.col("median") + 3 * F.col("mad_sigma"), "thresh_5": F.col("median") + 5 * F.col("mad_sigma")})

    def local(self, scores: DataFrame) -> DataFrame:
        """The scores with local_median and local_sigma."""
        return robust.local_stats(scores, keys_of(scores), "f_start", "score", self.rule.cfar_half)

    def above(self, scores: DataFrame, limits: DataFrame) -> DataFrame:
        """The windows that stand out, by the FAR cut or by their neighbourhood; scores may come with local statistics."""
        keys = keys_of(scores)
        far = F.col("score") > F.col("far_thresh")
        if self.rule.cfar_half:
            local = scores if "local_median" in scores.columns else self.local(scores)
            far = far | ((F.col("score") - F.col("local_median")) / F.col("local_sigma") > self.rule.cfar_k)
            scores = local
        return scores.join(limits.select(*keys, "far_thresh"), keys).where(far & F.col("usable")).select(*keys, "f_start", "score")

    def clusters(self, scores: DataFrame, limits: DataFrame, bands: DataFrame | None = None) -> DataFrame:
        """Runs of windows that stand out; with bands also the frequency of each peak, null without a band."""
        found = islands.summarize_clusters(self.above(scores, limits), keys_of(scores), self.stride, self.width)
        return found if bands is None else peak_frequencies(found, bands)

    def probe(self, scores: DataFrame, seed: int = 0) -> DataFrame:
        """Usable windows drawn for the OFF pool: the first of each cadence and method in the order of a seeded hash.

        A cadence's windows are ranked by bins of the hash, so that no task orders all of them.
        """
        keys = keys_of(scores)
        h = F.sha2(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in (*KEYS, "f_start")]), 256)
        rows = scores.where("usable").select(*keys, "f_start", h.alias("h")).withColumn("one", F.lit(1).cast("long"))
        bin_ = F.conv(F.substring("h", 1, 3), 16, 10).cast("int")
        ranked = islands.running_total(rows, keys, [F.col("h"), F.col("f_start")], bin_, "one", "k")
        return ranked.where(F.col("k") <= self.rule.off_ceiling_probe).select(*keys, "f_start")

    def maps(self, blocks: DataFrame, wanted: DataFrame) -> DataFrame:
        """cadence, method, f_start, amap of the windows wanted: only these are assembled and scored again."""
        some = self.windows(blocks).join(wanted.select("cadence", "f_start").distinct(), ["cadence", "f_start"], "left_semi")
        scored = windows.score_windows(some, self.scorer, self.methods, self.width, self.mode, self.degree, keep_maps=True)
        return scored.join(wanted.select(*KEYS, "f_start").distinct(), [*KEYS, "f_start"], "left_semi").drop("score")

    def decide(self, clusters: DataFrame, cluster_maps: DataFrame, probe_maps: DataFrame, limits: DataFrame) -> DataFrame:
        """clusters with contrast, verdict and the ceiling they were decided at; both terms of it are kept."""
        keys = keys_of(clusters)
        pool = cluster_maps.select(*keys, "amap").unionByName(probe_maps.select(*keys, "amap"))
        off = pool.select(*keys, F.posexplode("amap").alias("r", "row")).where(F.col("r").isin(*maps.OFF)).select(*keys, F.explode("row").alias("v"))
        raw = robust.clipped_ceiling(materialize(off, "off-cells"), keys, "v").withColumnRenamed("n", "n_off")
        cut = limits.select(*keys, "thresh_3", "thresh_5", "far_thresh").join(raw, keys, "left")
        cut = cut.withColumn("off_ceiling", F.when(F.col("n_off") >= self.rule.min_off_pool, F.greatest("ceiling", "thresh_5")).otherwise(F.col("thresh_5")))
        ready = clusters.join(cluster_maps.withColumnRenamed("f_start", "f_start_peak"), [*keys, "f_start_peak"], "left").join(cut, keys)
        ready = maps.contrast(ready, F.col("off_ceiling"))
        single = None if self.rule.single_off_frac is None else F.lit(self.rule.single_off_frac)
        return maps.verdict(ready, F.col("off_ceiling"), F.lit(self.rule.leak_frac), self.rule.leak_ref, single)

    def veto(self, decided: DataFrame) -> DataFrame:
        """decided with n_other and final, once the night is complete."""
        counted = candidates.veto_counts(decided, self.width)
        passed = F.lit(True) if self.rule.veto_min_targets == 0 else F.col("n_other") < self.rule.veto_min_targets
        return counted.withColumn("final", F.col("in_short_list") & passed)

    def rank(self, decided: DataFrame, top_k: int | None = None) -> DataFrame:
        """The final list of each cadence and method by contrast; all of it unless top_k is given."""
        out = candidates.ranked(decided.where("final"), KEYS, "on_off_contrast", "f_start_peak")
        return out if top_k is None else out.where(F.col("rank") <= top_k)

    def search(self, blocks: DataFrame, bands: DataFrame | None = None) -> DataFrame:
        """All stages: every cluster with its verdict and veto."""
        return self.veto(self.select(self.scores(blocks, bands), blocks, bands)[0])

    def select(self, scores: DataFrame, blocks: DataFrame, bands: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
        """The stages after scoring: decided clusters, and the maps they were decided from."""
        limits = materialize(self.thresholds(scores), "limits")
        found = materialize(self.clusters(scores, limits, bands), "clusters")
        peaks = found.select(*KEYS, F.col("f_start_peak").alias("f_start"))
        probe = self.probe(scores)
        all_maps = materialize(self.maps(blocks, peaks.unionByName(probe).distinct()), "maps")
        on = [*KEYS, "f_start"]
        return self.decide(found, all_maps.join(peaks, on, "left_semi"), all_maps.join(probe, on, "left_semi"), limits), all_maps

    def overlay(self, blocks: DataFrame, patches: DataFrame) -> DataFrame:
        """blocks with patches put in: cells of a patch (cadence, obs, c0, patch time × channels) replace those of the block
        that holds them. A block takes any number of patches; where they overlap the one of greater c0 holds. A patch that
        spans blocks must come cut at their borders. With a column `variant`, patches give one copy of the blocks they
        touch for each variant."""
        keys = [*(["variant"] if "variant" in patches.columns else []), "cadence", "obs", "chan_start"]
        p = patches.select(*keys[:-1], F.col("c0").alias("lo"), (F.col("c0") + 1).alias("lo_end"), "patch")
        spans = blocks.select("cadence", "obs", "chan_start", (F.col("chan_start") + F.size(F.get("power", F.lit(0)))).alias("chan_end"))
        held = islands.overlap_join(p, spans, ["cadence", "obs"], "lo", "lo_end", "chan_start", "chan_end", 8 * self.width)
        held = held.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("lo", "patch"))).alias("patches"))

        def put(power: Column, p: Column) -> Column:
            at, w = (p["lo"] - F.col("chan_start")).cast("int"), F.size(F.get(p["patch"], F.lit(0)))
            row = lambda r, q: F.concat(F.slice(r, F.lit(1), at), q.cast("array<float>"), F.slice(r, at + w + 1, F.greatest(F.lit(0), F.size(r) - at - w)))
            return F.zip_with(power, p["patch"], row)

        mixed = F.aggregate(F.coalesce("patches", F.array().cast(held.schema["patches"].dataType)), F.col("power"), put)
        if "variant" in patches.columns:
            return blocks.join(held, ["cadence", "obs", "chan_start"]).select("variant", "cadence", "obs", "chan_start", mixed.alias("power"))
        return blocks.join(held, ["cadence", "obs", "chan_start"], "left").select("cadence", "obs", "chan_start", mixed.alias("power"))

    def _stale(self, scores: DataFrame, patches: DataFrame) -> DataFrame:
        """cadence and f_start, of each variant, of the windows that a patch touches."""
        keys = [*(["variant"] if "variant" in patches.columns else []), "cadence"]
        spans = patches.select(*keys, F.col("c0").alias("lo"), (F.col("c0") + F.size(F.get("patch", F.lit(0)))).alias("hi")).distinct()
        grid = scores.select("cadence", "f_start").distinct().withColumn("end", F.col("f_start") + self.width)
        return islands.overlap_join(spans, grid, ["cadence"], "lo", "hi", "f_start", "end", 8 * self.width).select(*keys, "f_start").distinct()

    def rescore(self, scores: DataFrame, blocks: DataFrame, patches: DataFrame) -> DataFrame:
        """Scores of the patched blocks: only windows that a patch touches are scored again, the rest is taken over."""
        stale = self._stale(scores, patches)
        again = self.windows(self.overlay(blocks, patches)).join(stale, ["cadence", "f_start"], "left_semi")
        new = windows.score_windows(again, self.scorer, self.methods, self.width, self.mode, self.degree)
        new = new.join(scores.select(*KEYS, "f_start", "usable"), [*KEYS, "f_start"])
        return scores.join(stale, ["cadence", "f_start"], "left_anti").unionByName(new)

    def _patched(self, blocks: DataFrame, patches: DataFrame, wanted: DataFrame) -> DataFrame:
        """The windows wanted (variant, cadence, f_start) of the patched variants, `cadence` holding variant and cadence.

        Of the blocks only those that such a window reaches into are copied for a variant."""
        spans = blocks.select("cadence", "obs", "chan_start", (F.col("chan_start") + F.size(F.get("power", F.lit(0)))).alias("chan_end"))
        need = wanted.select("variant", "cadence", "f_start", (F.col("f_start") + self.width).alias("f_end"))
        touched = islands.overlap_join(need, spans, ["cadence"], "f_start", "f_end", "chan_start", "chan_end", 8 * self.width).select("variant", "cadence", "obs", "chan_start").distinct()
        plain = touched.join(blocks, ["cadence", "obs", "chan_start"])
        changed = self.overlay(blocks, patches)
        at = ["variant", "cadence", "obs", "chan_start"]
        mixed = plain.join(changed.withColumnRenamed("power", "new"), at, "left").select(*at, F.coalesce("new", "power").alias("power"))
        both = F.to_json(F.struct("variant", "cadence"))
        return self.windows(mixed.withColumn("cadence", both).drop("variant")).join(wanted.select(both.alias("cadence"), "f_start").distinct(), ["cadence", "f_start"], "left_semi")

    def _score(self, some: DataFrame, variant: str, keep_maps: bool) -> DataFrame:
        out = windows.score_windows(some, self.scorer, self.methods, self.width, self.mode, self.degree, keep_maps=keep_maps)
        parts = F.from_json("cadence", f"variant {variant}, cadence string")
        return out.withColumn("_p", parts).withColumn("variant", F.col("_p.variant")).withColumn("cadence", F.col("_p.cadence")).drop("_p")

    def search_patched(self, scores: DataFrame, saved_maps: DataFrame, blocks: DataFrame, patches: DataFrame, local: DataFrame | None = None, bands: DataFrame | None = None) -> DataFrame:
        """The decided clusters of every variant: those of a full search of the cadence with the variant's patches.

        patches: variant, cadence, obs, c0, patch, cut at the borders of blocks. Windows that a patch touches are scored
        again, the other scores, the local statistics (of `scores`, computed unless given) beyond twice the neighbourhood
        and the saved maps are taken over; thresholds, clusters, probe, ceiling and verdicts are made anew. All variants
        are searched in one job. The veto, which needs the whole night, isn't part of it.
        """
        of = ["variant", *KEYS, "f_start"]
        variant = patches.schema["variant"].dataType.simpleString()
        stale = materialize(self._stale(scores, patches), "stale-windows")
        base = patches.select("variant", "cadence").distinct().join(scores, "cadence")
        new = self._score(self._patched(blocks, patches, stale), variant, keep_maps=False).join(scores.select(*KEYS, "f_start", "usable"), [*KEYS, "f_start"])
        spliced = base.join(stale, ["variant", "cadence", "f_start"], "left_anti").select(*of, "score", "usable").unionByName(new.select(*of, "score", "usable"))
        spliced = materialize(spliced, "spliced-scores")
        if self.rule.cfar_half:
            spliced = materialize(self._spliced_local(spliced, self.local(scores) if local is None else local, stale), "spliced-local")
        limits = materialize(self.thresholds(spliced), "limits")
        found = materialize(self.clusters(spliced, limits, bands), "clusters")
        peaks = found.select("variant", *KEYS, F.col("f_start_peak").alias("f_start"))
        probe = materialize(self.probe(spliced), "probe")
        wanted = peaks.unionByName(probe).distinct()
        cached = wanted.join(stale, ["variant", "cadence", "f_start"], "left_anti").join(saved_maps.select(*KEYS, "f_start", "amap"), [*KEYS, "f_start"])
        rest = materialize(wanted.join(cached.select(*of), of, "left_anti"), "maps-wanted")
        made = self._score(self._patched(blocks, patches, rest.select("variant", "cadence", "f_start").distinct()), variant, keep_maps=True)
        all_maps = materialize(cached.select(*of, "amap").unionByName(made.join(rest, of, "left_semi").select(*of, "amap")), "maps")
        return self.decide(found, all_maps.join(peaks, of, "left_semi"), all_maps.join(probe, of, "left_semi"), limits)

    def _spliced_local(self, spliced: DataFrame, local: DataFrame, stale: DataFrame) -> DataFrame:
        """spliced with local statistics: those of `local` where no changed score is within twice the neighbourhood, else
        computed from the rows within four times of it."""
        near = 2 * self.rule.cfar_half * self.stride
        keys = ["variant", *KEYS]
        ends = stale.groupBy("variant", "cadence").agg(F.min("f_start").alias("_a"), F.max("f_start").alias("_z"))
        marked = spliced.join(ends, ["variant", "cadence"], "left").withColumn("_far", F.greatest(F.col("_a") - F.col("f_start"), F.col("f_start") - F.col("_z"), F.lit(0)))
        cols = [*keys, "f_start", "score", "usable", "local_median", "local_sigma"]
        again = self.local(marked.where(F.col("_far") <= 2 * near)).where(F.col("_far") <= near).select(*cols)
        kept = marked.where(F.col("_far").isNull() | (F.col("_far") > near)).join(local.select(*KEYS, "f_start", "local_median", "local_sigma"), [*KEYS, "f_start"]).select(*cols)
        return kept.unionByName(again)


def peak_frequencies(clusters: DataFrame, bands: DataFrame) -> DataFrame:
    """clusters with freq_mhz_peak: the first channel's frequency plus the signed step times the peak's start."""
    at = F.col("fch1_mhz") + F.col("f_start_peak") * F.coalesce("foff_hz", F.lit(0.0)) / 1e6
    return clusters.join(bands.select("cadence", "fch1_mhz", "foff_hz"), "cadence", "left").withColumn("freq_mhz_peak", at).drop("fch1_mhz", "foff_hz")
