"""The search from blocks to verdicts, in full and after patches, over a block store made from the embeddings.

Six vectors in a row are the observations of 64 channels, sixteen such groups are one cadence; power is the absolute
value times a hundred.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skylode.engine import SearchEngine
from skylode.functions.scorers import PooledSquares
from skylode.operators.maps import ON
from skylode.operators.windows import window_grid
from skylode.rules import Rule
from skylode.session import materialize
from skylode.sources.tables import table

#: Channels of a vector, groups of a cadence, and the groups that variants put a signal into.
CHANNELS, PER_CADENCE, VARIANTS = 64, 16, (3, 9)
RULE = Rule(far_quantile=0.9, off_ceiling_probe=4)


def _engine() -> SearchEngine:
    return SearchEngine(RULE, PooledSquares(1, 4), ["topk"], width=64, stride=32, degree=None)


def _blocks(spark: SparkSession, folder: str) -> DataFrame:
    place = F.expr("vec_id div 6")
    cadence = F.format_string("emb_57000_%05d_T", F.expr(f"(vec_id div 6) div {PER_CADENCE}"))
    power = F.array(F.transform("embedding", lambda x: (F.abs(x.cast("double")) * 100.0).cast("float")))
    vectors = table(spark, folder, "embeddings").withColumn("place", place)
    # A last group of fewer than six vectors is no group.
    vectors = vectors.join(vectors.groupBy("place").agg(F.count("*").alias("n")).where("n = 6").select("place"), "place", "left_semi")
    out = vectors.select(cadence.alias("cadence"), (F.col("vec_id") % 6).cast("int").alias("obs"), (place % PER_CADENCE * CHANNELS).alias("chan_start"), power.alias("power"))
    return materialize(out, "blocks")


def _rounded(decided: DataFrame, *more: str) -> DataFrame:
    exact = ["f_start_peak", "f_start_first", "f_start_last", "n_snippets", "n_on_hits", "n_off_hits", "n_on_hits_full", "n_off_hits_full", "off_leak", "in_short_list"]
    return decided.select(*more, "cadence", *exact, *[F.round(c, 5).alias(c) for c in ("peak_score", "mean_score", "far_thresh", "off_ceiling", "on_off_contrast")])


def engine_grid(spark: SparkSession, folder: str) -> DataFrame:
    """The whole windows of each cadence's band."""
    bands = _blocks(spark, folder).groupBy("cadence").agg(F.max(F.col("chan_start") + CHANNELS).alias("nchans"))
    return window_grid(bands, 64, 32)


def engine_scores(spark: SparkSession, folder: str) -> DataFrame:
    """The score of every window."""
    return _engine().scores(_blocks(spark, folder)).select("cadence", "f_start", F.round("score", 5).alias("score"))


def engine_search(spark: SparkSession, folder: str) -> DataFrame:
    """Every cluster of every cadence with its verdict: scores, thresholds, clusters, probe, ceiling, maps, decision."""
    return _rounded(_engine().search(_blocks(spark, folder)))


def engine_incremental(spark: SparkSession, folder: str) -> DataFrame:
    """The clusters of each cadence after a signal was put into one group of its ON observations, for each of the VARIANTS:
    only what the signal touches is scored again, and all variants are searched together."""
    engine, blocks = _engine(), _blocks(spark, folder)
    scores = engine.scores(blocks)
    _, saved = engine.select(scores, blocks)
    bright = F.transform("power", lambda r: F.transform(F.slice(r, 1, 32), lambda x: x.cast("double") * 5.0))
    patches = blocks.where(F.col("obs").isin(*ON)).withColumn("variant", F.expr(f"chan_start div {CHANNELS}")).where(F.col("variant").isin(*VARIANTS))
    patches = materialize(patches.select("variant", "cadence", "obs", F.col("chan_start").alias("c0"), bright.alias("patch")), "patches")
    return _rounded(engine.search_patched(scores, saved, blocks, patches), "variant")


_P = """WITH v AS (SELECT vec_id // 6 AS m, vec_id % 6 AS o, embedding AS e FROM embeddings), ok AS (SELECT m FROM v GROUP BY m HAVING count(*) = 6),
  p0 AS (SELECT printf('emb_57000_%05d_T', m // 16) AS cadence, o, (m % 16) * 64 + u.i - 1 AS ch, CAST(CAST(abs(CAST(e[u.i] AS DOUBLE)) * 100 AS FLOAT) AS DOUBLE) AS x
    FROM v JOIN ok USING (m), (SELECT unnest(range(1, 65)) AS i) u)"""
_ONE = _P + ", p AS (SELECT 0 AS variant, cadence, o, ch, ln(1 + x) AS y FROM p0)"
_TWO = _P + """, p AS (SELECT variant, cadence, o, ch, ln(1 + CASE WHEN o % 2 = 0 AND ch >= variant * 64 AND ch < variant * 64 + 32 THEN CAST(CAST(x * 5 AS FLOAT) AS DOUBLE) ELSE x END) AS y
    FROM p0 JOIN (SELECT DISTINCT ch // 64 AS variant, cadence FROM p0 WHERE ch // 64 IN (3, 9)) USING (cadence))"""
_SCORES = """, nch AS (SELECT cadence, max(ch) + 1 AS n FROM p GROUP BY 1),
  w AS (SELECT variant, cadence, o, ch, y, f FROM (SELECT *, unnest([(ch // 32) * 32, (ch // 32) * 32 - 32]) AS f FROM p) JOIN nch USING (cadence) WHERE f >= 0 AND f + 64 <= n),
  w1 AS (SELECT *, median(y) OVER (PARTITION BY variant, cadence, o, f) AS med FROM w), w2 AS (SELECT *, median(abs(y - med)) OVER (PARTITION BY variant, cadence, o, f) AS mad FROM w1),
  cell AS (SELECT variant, cadence, f, o, (ch - f) // 4 AS k, avg(power((y - med) / (mad + 1e-6), 2)) AS v FROM w2 GROUP BY ALL),
  sc AS (SELECT variant, cadence, f, max(v) AS score FROM cell GROUP BY ALL)"""
_CHAIN = _SCORES + """, md AS (SELECT *, median(score) OVER (PARTITION BY variant, cadence) AS med FROM sc),
  th AS (SELECT variant, cadence, any_value(med) + 5 * median(abs(score - med)) * 1.4826 AS t5, quantile_cont(score, 0.9) AS far FROM md GROUP BY ALL),
  ab AS (SELECT variant, cadence, f, score, CASE WHEN f - lag(f) OVER (PARTITION BY variant, cadence ORDER BY f) <= 32 THEN 0 ELSE 1 END AS o FROM sc JOIN th USING (variant, cadence) WHERE score > far),
  isl AS (SELECT *, sum(o) OVER (PARTITION BY variant, cadence ORDER BY f) AS k FROM ab),
  cl AS (SELECT variant, cadence, arg_max(f, (score, -f)) AS peak, max(score) AS peak_score, avg(score) AS mean_score, count(*) AS n, min(f) AS f0, max(f) AS f1 FROM isl GROUP BY variant, cadence, k),
  pb AS (SELECT variant, cadence, f FROM (SELECT *, row_number() OVER (PARTITION BY variant, cadence ORDER BY sha256('0|' || cadence || '|topk|' || f), f) AS rn FROM sc) WHERE rn <= 4),
  k0 AS (SELECT variant, cadence, v, TRUE AS kept, FALSE AS still FROM (SELECT variant, cadence, peak AS f FROM cl UNION ALL SELECT * FROM pb) JOIN cell USING (variant, cadence, f) WHERE o % 2 = 1)""" + "".join(
    f""", m{i} AS (SELECT *, median(CASE WHEN kept THEN v END) OVER (PARTITION BY variant, cadence) AS m FROM k{i - 1}),
  s{i} AS (SELECT *, median(CASE WHEN kept THEN abs(v - m) END) OVER (PARTITION BY variant, cadence) * 1.4826 AS s FROM m{i}),
  x{i} AS (SELECT *, CASE WHEN still OR s = 0 THEN kept ELSE v <= m + 3 * s END AS nx FROM s{i}),
  k{i} AS (SELECT variant, cadence, v, nx AS kept, still OR s = 0 OR sum(nx::INT) OVER (PARTITION BY variant, cadence) = sum(kept::INT) OVER (PARTITION BY variant, cadence) AS still FROM x{i})"""
    for i in range(1, 6)
) + """, oc AS (SELECT variant, cadence, count(*) AS n_off, quantile_cont(v, 0.999) FILTER (kept) AS c FROM k5 GROUP BY ALL),
  cut AS (SELECT variant, cadence, far, CASE WHEN n_off >= 30 THEN greatest(c, t5) ELSE t5 END AS t FROM th LEFT JOIN oc USING (variant, cadence)),
  am AS (SELECT variant, cadence, f, o, k, v FROM (SELECT variant, cadence, peak AS f FROM cl) JOIN cell USING (variant, cadence, f)),
  pk AS (SELECT variant, cadence, f, arg_max(k, (m, -k)) AS pk FROM (SELECT variant, cadence, f, k, max(v) AS m FROM am GROUP BY ALL) GROUP BY ALL),
  nr AS (SELECT variant, cadence, f, o, max(v) FILTER (k BETWEEN pk - 3 AND pk + 3) AS near, max(v) AS whole FROM am JOIN pk USING (variant, cadence, f) GROUP BY ALL),
  h AS (SELECT variant, cadence, f, any_value(t) AS t, any_value(far) AS far, avg(near) FILTER (o % 2 = 0) / greatest(avg(near) FILTER (o % 2 = 1), 1e-8) AS con, count(*) FILTER (o % 2 = 0 AND near > t) AS on_hits, count(*) FILTER (o % 2 = 1 AND near > t) AS off_hits,
    count(*) FILTER (o % 2 = 0 AND whole > t) AS on_full, min(whole) FILTER (o % 2 = 0) AS ref FROM nr JOIN cut USING (variant, cadence) GROUP BY ALL),
  l AS (SELECT variant, cadence, f, count(*) FILTER (o % 2 = 1 AND whole > t AND whole >= 0.3 * ref) AS off_full FROM nr JOIN h USING (variant, cadence, f) GROUP BY ALL)
  SELECT {variant} cadence, peak AS f_start_peak, f0 AS f_start_first, f1 AS f_start_last, n AS n_snippets, CAST(on_hits AS INT) AS n_on_hits, CAST(off_hits AS INT) AS n_off_hits, CAST(on_full AS INT) AS n_on_hits_full,
    CAST(off_full AS INT) AS n_off_hits_full, off_full >= 2 AS off_leak, on_full >= 2 AND off_full < 2 AS in_short_list, round(peak_score, 5) AS peak_score, round(mean_score, 5) AS mean_score, round(far, 5) AS far_thresh,
    round(t, 5) AS off_ceiling, round(con, 5) AS on_off_contrast
  FROM cl JOIN h ON cl.variant = h.variant AND cl.cadence = h.cadence AND cl.peak = h.f JOIN l ON cl.variant = l.variant AND cl.cadence = l.cadence AND cl.peak = l.f"""
SQL = {
    "engine_grid": _ONE + ", nch AS (SELECT cadence, max(ch) + 1 AS n FROM p GROUP BY 1) SELECT cadence, unnest(range(0, CAST(n - 64 AS BIGINT) + 1, 32)) AS f_start FROM nch",
    "engine_scores": _ONE + _SCORES + " SELECT cadence, f AS f_start, round(score, 5) AS score FROM sc",
    "engine_search": _ONE + _CHAIN.replace("{variant}", ""),
    "engine_incremental": _TWO + _CHAIN.replace("{variant}", "cl.variant,").replace("SELECT cl.variant, cadence", "SELECT cl.variant, cl.cadence"),
}
SQL = {k: q.replace("SELECT  cadence, peak", "SELECT cl.cadence, peak").replace("{variant}", "") for k, q in SQL.items()}
QUERIES = {f.__name__: f for f in (engine_grid, engine_scores, engine_search, engine_incremental)}
