"""Recovery of injected signals by the search, dispersion over the bands of the headers, and models held out or in the plane."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skylode.functions.morphologies import DISPERSION
from skylode.operators import injection, models
from skylode.plans import maps
from skylode.plans.search import CHANNELS, _blocks, _engine
from skylode.session import materialize
from skylode.sources.tables import table

#: Patterns and strengths of the recovery, dispersion measures of the delays, rows and channels of a patch.
PATTERNS, SNRS, MEASURES, PATCH = ["3on", "2on_04", "1on_2"], [5.0, 20.0, 80.0], [10.0, 100.0, 1000.0], (2, 8)
#: Penalty of the ridge in the plane.
PENALTY = 0.1


def injected(spark: SparkSession, folder: str) -> DataFrame:
    """Every injection of the recovery with its outcome: a signal of each morphology in the quietest window of each cadence,
    in each pattern and strength, searched as variants of the cadence in one job."""
    engine, blocks = _engine(), _blocks(spark, folder)
    scores = engine.scores(blocks)
    _, saved = engine.select(scores, blocks)
    starts = scores.groupBy("cadence").agg(F.min_by("f_start", F.struct("score", "f_start")).alias("f_start"))
    starts = materialize(starts, "starts")
    signals = materialize(injection.catalogue(injection.sites(starts, engine.width, 1), PATTERNS, SNRS), "injections")
    # Only the blocks that a chosen window reaches into are cut into windows.
    near = (F.col("chan_start") < F.col("f_start") + engine.width) & (F.col("chan_start") + CHANNELS > F.col("f_start"))
    held = blocks.join(starts, "cadence").where(near).drop("f_start")
    patches = injection.split_at_blocks(injection.patches(engine.windows(held), signals, engine.width, 1), CHANNELS)
    patches = materialize(patches.select(F.col("injection_id").alias("variant"), "cadence", "obs", "c0", "patch"), "patches")
    return injection.outcomes(signals, engine.search_patched(scores, saved, blocks, patches), engine.width)


def recovery_by_morphology(spark: SparkSession, folder: str) -> DataFrame:
    """What share of the injections is detected and listed, by morphology, pattern and strength."""
    share = lambda c: F.round(F.avg(F.col(c).cast("double")), 6).alias(c)
    return injected(spark, folder).groupBy("morphology", "pattern", "snr").agg(F.count("*").alias("n"), share("detected"), share("listed"))


def dispersion_delays(spark: SparkSession, folder: str) -> DataFrame:
    """How much later a burst ends at the low edge of each observation's band than at the high one, in seconds and in time
    steps, and whether it passes within the observation; bands that can't be read have no row."""
    low, high = F.least("f_start_mhz", "f_stop_mhz"), F.greatest("f_start_mhz", "f_stop_mhz")
    rows = table(spark, folder, "scan_headers").where("parse_error IS NULL").select("header_id", low.alias("low"), high.alias("high"), "tsamp_s", "duration_s")
    rows = rows.where("low > 0 AND NOT isnan(high)").withColumn("dm", F.explode(F.array(*map(F.lit, MEASURES))))
    delay = DISPERSION * F.col("dm") * (1 / (F.col("low") * F.col("low")) - 1 / (F.col("high") * F.col("high")))
    steps = F.when(F.col("tsamp_s") > 0, delay / F.col("tsamp_s"))
    return rows.select("header_id", "dm", F.round(delay, 6).alias("delay_s"), F.round(steps, 4).alias("steps"), (delay <= F.col("duration_s")).alias("within"))


def unpatched(spark: SparkSession, folder: str) -> DataFrame:
    """Maps cut into patches of two rows and eight channels and put together again from them: every cell at its place."""
    ph, pw = PATCH
    across = CHANNELS // pw
    cells = maps._cells(spark, folder)
    patch, place = F.expr(f"(r div {ph}) * {across} + c div {pw}"), F.expr(f"(r % {ph}) * {pw} + c % {pw}")
    cut = cells.groupBy("map_id", patch.alias("patch")).agg(F.sort_array(F.collect_list(F.struct(place.alias("at"), "v"))).alias("cells"))  # sixteen a patch
    back = cut.select("map_id", "patch", F.posexplode(F.transform("cells", lambda x: x["v"])).alias("at", "v"))
    row, channel = F.expr(f"(patch div {across}) * {ph} + at div {pw}"), F.expr(f"(patch % {across}) * {pw} + at % {pw}")
    return back.select("map_id", row.cast("int").alias("r"), channel.cast("int").alias("c"), F.round("v", 6).alias("v"))


def label_auc(spark: SparkSession, folder: str) -> DataFrame:
    """Cross-validated area under the ROC curve of telling the upper half of the labels from the vectors."""
    v = table(spark, folder, "embeddings").select("vec_id", "embedding", (F.col("label") >= 5).alias("upper"))
    n = v.agg(F.count("*").alias("n"), F.avg(F.col("upper").cast("double")).alias("share"))
    return n.select("n", F.round("share", 6).alias("share"), F.lit(round(models.cross_validated_auc(v, "embedding", "upper", key="vec_id"), 6)).alias("auc"))


def ridge_plane(spark: SparkSession, folder: str) -> DataFrame:
    """Ridge regression of the label on the first two dimensions: each vector's residual."""
    v = table(spark, folder, "embeddings").where("label IS NOT NULL").select("vec_id", F.slice("embedding", 1, 2).alias("x"), "label")
    model = models.ridge(v, "x", "label", PENALTY)
    fit = float(model.intercept) + sum(F.get("x", F.lit(i)).cast("double") * float(w) for i, w in enumerate(model.coefficients))
    return v.select("vec_id", F.round(F.col("label") - fit, 5).alias("residual"))


SQL = {
    "dispersion_delays": """WITH b AS (SELECT header_id, least(f_start_mhz, f_stop_mhz) AS lo, greatest(f_start_mhz, f_stop_mhz) AS hi, tsamp_s, duration_s FROM scan_headers WHERE parse_error IS NULL),
      d AS (SELECT *, 4148.808 * dm * (1 / (lo * lo) - 1 / (hi * hi)) AS delay FROM b, (VALUES (10.0::DOUBLE), (100.0), (1000.0)) m(dm) WHERE lo > 0 AND NOT isnan(hi))
      SELECT header_id, dm, round(delay, 6) AS delay_s, round(CASE WHEN tsamp_s > 0 THEN delay / tsamp_s END, 4) AS steps, delay <= duration_s AS within FROM d""",
    "unpatched": maps._C + "SELECT map_id, r, c, round(v, 6) AS v FROM cells",
    "ridge_plane": """WITH x AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS a, CAST(embedding[2] AS DOUBLE) AS b, CAST(label AS DOUBLE) AS y FROM embeddings WHERE label IS NOT NULL),
      s AS (SELECT avg(a) AS ma, avg(b) AS mb, avg(y) AS my, stddev_pop(a) AS sa, stddev_pop(b) AS sb, stddev_pop(y) AS sy, corr(a, b) AS k, corr(a, y) AS ka, corr(b, y) AS kb FROM x),
      w AS (SELECT *, 1 + 0.1 / sy AS d FROM s), c AS (SELECT *, (d * ka - k * kb) / (d * d - k * k) * sy / sa AS wa, (d * kb - k * ka) / (d * d - k * k) * sy / sb AS wb FROM w)
      SELECT vec_id, round(y - (my + wa * (a - ma) + wb * (b - mb)), 5) AS residual FROM x, c""",
}
QUERIES = {f.__name__: f for f in (recovery_by_morphology, dispersion_delays, unpatched, label_auc, ridge_plane)}
