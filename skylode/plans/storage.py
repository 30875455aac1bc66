"""Sources and sinks as round trips over the tables, streams that are driven to their end, and audits of what was stored."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skylode.functions.observations import mjd, observations
from skylode.operators import audits, maps as M, models, robust
from skylode.operators import catalogue as C
from skylode.operators.candidates import latest_clusters
from skylode.plans import maps, scores
from skylode.plans.events import stream_sessions, stream_windows
from skylode.plans.search import _blocks
from skylode.session import materialize, scratch_path
from skylode.sources import files, sinks
from skylode.sources.tables import table

KEYS = ["cadence", "method"]


def scores_by_csv(spark: SparkSession, folder: str) -> DataFrame:
    """The latest scores, written once as CSV and read again."""
    path = f"{scratch_path(spark, 'scores')}.csv"
    sinks.write_once(robust.latest_scores(table(spark, folder, "window_scores")).select("cadence", "f_start", "method", "score"), path, "csv")
    rows = spark.read.schema("cadence string, f_start long, method string, score double").csv(path)
    return rows.select(*KEYS, "f_start", "score")


def score_columns(spark: SparkSession, folder: str) -> DataFrame:
    """Two columns of a published score table, the others unread."""
    path = scratch_path(spark, "scores")
    sinks.publish(robust.latest_scores(table(spark, folder, "window_scores")), path, by=["method"])
    return files.read_scores(spark, path, ["cadence", "score"])


def scores_by_cadence(spark: SparkSession, folder: str) -> DataFrame:
    """A score table parted by cadence: what each part holds."""
    path = scratch_path(spark, "scores")
    sinks.by_cadence(robust.latest_scores(table(spark, folder, "window_scores")), path)
    return spark.read.option("basePath", path).parquet(path).groupBy(F.col("cadence").cast("string").alias("cadence")).agg(F.count("*").alias("n"), F.min("f_start").alias("first"), F.max("f_start").alias("last"))


def headers_by_csv(spark: SparkSession, folder: str) -> DataFrame:
    """The header table, written as CSV and read again, good rows apart from bad ones."""
    path = scratch_path(spark, "headers")
    names = [c.strip().split(" ")[0] for c in files.HEADERS.split(",")]
    table(spark, folder, "scan_headers").select(*names).write.option("header", "true").csv(path)
    good, bad = files.read_headers(spark, path)
    return good.select("header_id", "nchans", F.lit(True).alias("good")).unionByName(bad.select("header_id", "nchans", F.lit(False).alias("good")))


def listed_parts(spark: SparkSession, folder: str) -> DataFrame:
    """The files of a published table, found by listing: which products have any."""
    path = scratch_path(spark, "sequences")
    sinks.publish(table(spark, folder, "sequences").where("product IS NOT NULL"), path, by=["product"])
    found = files.list_files(spark, path, "*.parquet").where("length > 0")
    return found.select(F.regexp_extract("path", "product=([^/]*)", 1).alias("product")).distinct()


def appended_once(spark: SparkSession, folder: str) -> DataFrame:
    """Sequences appended in two batches that overlap, then both again: each once."""
    path = scratch_path(spark, "sequences")
    rows = table(spark, folder, "sequences").select("sequence_id", "product")
    half = rows.agg(F.percentile("sequence_id", F.lit(0.5))).first()[0] or 0
    for batch in (rows.where(F.col("sequence_id") <= half + 50), rows.where(F.col("sequence_id") > half - 50), rows):
        sinks.append_new(batch, path, "sequence_id")
    return spark.read.parquet(path)


def resumed_keys(spark: SparkSession, folder: str) -> DataFrame:
    """What is left to do of a run of which the first product is done."""
    path = scratch_path(spark, "run")
    rows = table(spark, folder, "sequences").select("sequence_id", "product")
    sinks.guard_identity(spark, path, {"run": 1})
    sinks.write_once(rows.where("product = '0000'"), f"{path}/done")
    sinks.guard_identity(spark, path, {"run": 1})
    return sinks.missing_keys(rows, f"{path}/done", ["sequence_id"])


def replaced_parts(spark: SparkSession, folder: str) -> DataFrame:
    """Method results with the parts of one method replaced and the others left."""
    path = scratch_path(spark, "results")
    rows = table(spark, folder, "method_results").where("method IS NOT NULL").select(*KEYS, "n_stage1")
    rows.write.partitionBy("method").parquet(path)
    sinks.replace_partitions(rows.where("method = 'udma_topk'").withColumn("n_stage1", F.col("n_stage1") + 1), path, ["method"])
    return spark.read.parquet(path).groupBy(F.col("method").cast("string").alias("method")).agg(F.count("*").alias("n"), F.sum("n_stage1").alias("sum_stage1"))


def channels_read(spark: SparkSession, folder: str) -> DataFrame:
    """The blocks of a store that hold channels 100 to 299."""
    path = scratch_path(spark, "blocks")
    sinks.write_once(_blocks(spark, folder), path, by=["cadence"])
    return files.read_channels(spark, path, 100, 300, 64).select(F.col("cadence").cast("string").alias("cadence"), "obs", "chan_start")


def checked_publication(spark: SparkSession, folder: str) -> DataFrame:
    """Latest clusters published with a catalogue and checksums, read again after both were verified."""
    path = scratch_path(spark, "clusters")
    rows = latest_clusters(table(spark, folder, "method_clusters")).select(*KEYS, "f_start_peak", "cluster_id")
    return audits.read_checked(spark, path, audits.publish_checked(rows, path))


def structure_audit(spark: SparkSession, folder: str) -> DataFrame:
    """What is wrong with the header table as a table of one row a file, without one of its columns, 3,000 rows long."""
    expected = {"file": "string", "product": "string", "node": "string", "nchans": "bigint", "beam": "int"}
    return audits.structure(table(spark, folder, "scan_headers").select("file", "product", "node", "nchans", "ntime"), expected, ["file"], 3000)


def content_audit(spark: SparkSession, folder: str) -> DataFrame:
    """A stored copy of the method clusters, in which contrasts above 5 were capped and one method was lost, compared with
    its source on a seeded quarter of the clusters."""
    source = table(spark, folder, "method_clusters").select("cluster_id", "method", "on_off_contrast", "in_short_list")
    good = ~F.isnan("on_off_contrast") & (F.col("on_off_contrast") > 5)
    copy = source.where("method IS NULL OR method <> 'vit_cadence'").withColumn("on_off_contrast", F.when(good, 5.0).otherwise(F.col("on_off_contrast")))
    return audits.mismatches(materialize(copy, "copy"), source, ["cluster_id"], share=0.25)


def superseded_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of window_scores that a later version of the same window has replaced, by method."""
    rows = table(spark, folder, "window_scores").where("cadence IS NOT NULL AND method IS NOT NULL AND f_start IS NOT NULL")
    per = rows.groupBy(*KEYS, "f_start", "scored_at").agg(F.count("*").alias("c")).groupBy(*KEYS, "f_start").agg(F.sum("c").alias("c"), F.max_by("c", "scored_at").alias("last"))
    return per.groupBy("method").agg(F.sum("c").alias("n_rows"), F.sum(F.col("c") - F.col("last")).alias("n_superseded"))


def stale_probe(spark: SparkSession, folder: str) -> DataFrame:
    """Windows that belong to a seeded probe and were scored again: the probe must be drawn anew for them."""
    rows = table(spark, folder, "window_scores").where("cadence IS NOT NULL")
    keys = [*KEYS, "f_start"]
    again = rows.groupBy(*keys).agg(F.count_distinct("scored_at").alias("n")).where("n > 1").select(*keys)
    probe = rows.select(*keys).where(audits.drawn("probe", F.concat_ws("|", *[F.col(k).cast("string") for k in keys]), 0.25))
    return again.intersect(probe)


def band_samples(spark: SparkSession, folder: str) -> DataFrame:
    """For each readable header with room for it, the first channels of windows of 1,024 at tenths of the band."""
    good = table(spark, folder, "scan_headers").where("nchans >= 1024 AND parse_error IS NULL")
    at = F.explode(F.sequence(F.lit(1), F.lit(9)))
    return good.select("header_id", "nchans", at.alias("tenth")).select("header_id", "tenth", F.expr("(nchans - 1024) * tenth div 10").alias("chan_start"))


def nights_of_both(spark: SparkSession, folder: str) -> DataFrame:
    """Nights over the first product's observations and the second product's starts together."""
    first = observations(table(spark, folder, "scan_headers")).where("product = '0000'").select("time", F.lit(0).alias("second"))
    starts = table(spark, folder, "association_rows").select(F.floor(mjd(F.col("tstart_mjd")) * 86400).cast("long").alias("time"), F.lit(1).alias("second"))
    both = materialize(first.unionByName(starts).where("time IS NOT NULL"), "starts")
    found = both.join(C.nights_of(both), "time").groupBy("night")
    return found.agg(F.max("time").alias("end_s"), F.count("*").alias("n_starts"), F.sum("second").alias("n_second"))


def counterparts(spark: SparkSession, folder: str) -> DataFrame:
    """For each sequence of another product, how many of its scans the first product has on the same node and on any."""
    from skylode.plans.catalogue import _sequence_files

    rows = materialize(_sequence_files(spark, folder).where("scan_key IS NOT NULL"), "sequence-files")
    first, other = rows.where("product = '0000'"), rows.where("product <> '0000'").select("sequence_id", "node_key", "scan_key").distinct()
    same = first.select("node_key", F.lit(1).alias("same")).distinct()
    some = first.select("scan_key", F.lit(1).alias("some")).distinct()
    return other.join(same, "node_key", "left").join(some, "scan_key", "left").groupBy("sequence_id").agg(F.count("*").alias("n_scans"), F.count("same").alias("n_same_node"), F.count("some").alias("n_any_node"))


def residual_ratios(spark: SparkSession, folder: str) -> DataFrame:
    """ON over OFF mean square of each map in its eight columns of most energy, and whether it survives cuts at 1, 2 and 5."""
    cells = M.cells(maps._maps(spark, folder))
    columns = cells.groupBy("map_id", "c").agg(F.sum(F.when(F.col("r") % 2 == 0, F.col("v") * F.col("v"))).alias("on"), F.sum(F.when(F.col("r") % 2 == 1, F.col("v") * F.col("v"))).alias("off"))
    top = columns.groupBy("map_id").agg(F.slice(F.sort_array(F.collect_list(F.struct((F.col("on") + F.col("off")).alias("e"), (-F.col("c")).alias("c"), "on", "off")), asc=False), 1, 8).alias("t"))
    total = lambda f: F.aggregate("t", F.lit(0.0), lambda a, x: a + x[f])
    out = top.select("map_id", (total("on") / (total("off") + 24e-10)).alias("ratio"))
    return out.select("map_id", F.round("ratio", 6).alias("ratio"), *[(F.col("ratio") >= k).alias(f"survives_{k}") for k in (1, 2, 5)])


def detection_table(spark: SparkSession, folder: str) -> DataFrame:
    """Maps with a bright ON cell of snr deviations: how many exceed their cadence's three and five sigma, mean and deviation
    of the score, its distance in sigma, and the share of the cadence's maps below it."""
    rows = materialize(maps._scored(spark, folder).select("cadence", "map_id", "amap", "score"), "maps")
    stats = robust.robust_stats(rows.select("cadence", "score"), ["cadence"]).select("cadence", "median", "mad_sigma")
    background = rows.groupBy("cadence").agg(F.collect_list("score").alias("all"))  # PER_CADENCE maps
    flat = F.flatten("amap")
    sigma = F.sqrt(M.mean(F.transform(flat, lambda x: x * x)) - M.mean(flat) * M.mean(flat))
    grid = rows.withColumn("s", sigma).withColumn("snr", F.explode(F.array(*map(F.lit, maps.SNRS))))
    at = (F.col("map_id") * 7 % 64).cast("int")
    cells = F.flatten(F.transform("amap", lambda row, r: F.transform(row, lambda v, c: v + F.when((c == at) & (r % 2 == 0), F.col("snr") * F.col("s")).otherwise(0.0))))
    scored = grid.withColumn("score", M.top_mean(cells, 0.01)).join(stats, "cadence").join(background, "cadence")
    below = F.size(F.filter("all", lambda x: x < F.col("score"))) / F.size("all")
    scored = scored.withColumns({"z": (F.col("score") - F.col("median")) / F.col("mad_sigma"), "below": below})
    return scored.groupBy("snr").agg(
        F.count("*").alias("n"), *[F.count_if(F.col("z") > k).alias(f"det_{k}") for k in (3, 5)],
        *[F.round(f, 5).alias(c) for c, f in (("mean_score", F.avg("score")), ("std_score", F.stddev_pop("score")), ("mean_sigma", F.avg("z")), ("mean_below", F.avg("below")))],
    )


def slot_usage(spark: SparkSession, folder: str) -> DataFrame:
    """How often each memory slot wins, and its mean weight where it does."""
    won = maps.memory_addressing(spark, folder)
    return won.groupBy("slot").agg(F.count("*").alias("n"), F.round(F.avg("weight"), 4).alias("mean_weight"))


def channel_intensity(spark: SparkSession, folder: str) -> DataFrame:
    """Mean power of each map's flagged channels over that of the others, where there are both."""
    cells = M.cells(maps._maps(spark, folder))
    level = cells.groupBy("map_id", "c").agg(F.percentile("v", F.lit(0.5)).alias("m"), F.sum("v").alias("s"), F.count("*").alias("k"))
    rows = level.groupBy("map_id").agg(F.collect_list(F.struct("m", "s", "k")).alias("cs"), F.percentile("m", F.lit(0.5)).alias("c0"))  # one a channel
    away = F.array_sort(F.transform("cs", lambda x: F.abs(x["m"] - F.col("c0"))))
    rows = rows.withColumn("sd", robust.median_of_sorted(away) * robust.MAD_SIGMA).select("map_id", "c0", "sd", F.explode("cs").alias("x"))
    hit = F.abs(F.col("x.m") - F.col("c0")) > 5 * F.col("sd")
    share = lambda c: F.sum(F.when(c, F.col("x.s"))) / F.sum(F.when(c, F.col("x.k")))
    return rows.groupBy("map_id").agg(F.count_if(hit).alias("n_flagged"), F.round(share(hit) / share(~hit), 5).alias("intensity_ratio"))


def plane_distances(spark: SparkSession, folder: str) -> DataFrame:
    """Mahalanobis distances in the first two dimensions, without shrinkage."""
    v = table(spark, folder, "embeddings").select("vec_id", F.slice("embedding", 1, 2).alias("x"))
    return models.mahalanobis(v, "x", v, shrink=0.0).select("vec_id", F.round("distance", 5).alias("distance"))


def closed_sessions(spark: SparkSession, folder: str) -> DataFrame:
    """The sessions that a stream over the events has closed at its end, in microseconds."""
    s = stream_sessions(spark, folder)
    return s.select("user_id", F.unix_micros("start_ts").alias("start_us"), F.unix_micros("end_ts").alias("end_us"), "n")


def closed_windows(spark: SparkSession, folder: str) -> DataFrame:
    """The sliding windows that a stream over the events has closed at its end."""
    w = stream_windows(spark, folder)
    return w.select("event_type", F.unix_micros("start_ts").alias("start_us"), "n", F.round("mean", 6).alias("mean"))


_DRAW = "CAST('0x' || substr(sha256({key}), 1, 8) AS BIGINT) < {share} * 4294967296"
_SEQ = """WITH f AS (SELECT sequence_id, product, regexp_replace(unnest(files), '.*/', '') AS base FROM sequences),
  k AS (SELECT sequence_id, product, nullif(lower(regexp_replace(base, '([.]rawspec)?[.](0000|0001|0002|fine|time|mid)[.](h5|hdf5|fil)$', '', 'i')), '') AS nk FROM f WHERE regexp_matches(base, '[.](0000|0001|0002|fine|time|mid)[.](h5|hdf5|fil)$', 'i')),
  s AS (SELECT *, nullif(regexp_replace(nk, '^blc[0-9a-z]+_', ''), '') AS sk FROM k WHERE nk IS NOT NULL)"""
SQL = {
    "scores_by_csv": scores._L + "SELECT cadence, method, f_start, score FROM latest",
    "score_columns": scores._L + "SELECT cadence, score FROM latest",
    "scores_by_cadence": scores._L + "SELECT cadence, count(*) AS n, min(f_start) AS first, max(f_start) AS last FROM latest GROUP BY 1",
    "headers_by_csv": "SELECT header_id, nchans, parse_error IS NULL AND header_error IS NULL AS good FROM scan_headers",
    "listed_parts": "SELECT DISTINCT product FROM sequences WHERE product IS NOT NULL",
    "appended_once": "SELECT sequence_id, product FROM sequences",
    "resumed_keys": "SELECT sequence_id, product FROM sequences WHERE product IS DISTINCT FROM '0000'",
    "replaced_parts": "SELECT method, count(*) AS n, sum(n_stage1 + CASE WHEN method = 'udma_topk' THEN 1 ELSE 0 END) AS sum_stage1 FROM method_results WHERE method IS NOT NULL GROUP BY 1",
    "channels_read": "SELECT printf('emb_57000_%05d_T', vec_id // 96) AS cadence, CAST(vec_id % 6 AS INT) AS obs, vec_id // 6 % 16 * 64 AS chan_start FROM embeddings WHERE vec_id // 6 IN (SELECT vec_id // 6 FROM embeddings GROUP BY 1 HAVING count(*) = 6) AND vec_id // 6 % 16 BETWEEN 1 AND 4",
    "checked_publication": """SELECT cadence, method, f_start_peak, cluster_id FROM (SELECT *, row_number() OVER (PARTITION BY cadence, method, f_start_peak ORDER BY run_at DESC, cluster_id DESC) AS rn
      FROM method_clusters WHERE cadence IS NOT NULL) WHERE rn = 1""",
    "structure_audit": """SELECT * FROM (SELECT 'columns' AS "check", CAST(1 AS BIGINT) AS n UNION ALL SELECT 'extra columns', 1 UNION ALL SELECT 'null keys', count(*) FILTER (file IS NULL) FROM scan_headers
      UNION ALL SELECT 'rows', abs(count(*) - 3000) FROM scan_headers UNION ALL SELECT 'repeated keys', count(*) - (SELECT count(*) FROM (SELECT DISTINCT file FROM scan_headers)) FROM scan_headers)""",
    "content_audit": f"""SELECT cluster_id, CASE WHEN method = 'vit_cadence' THEN 'missing' ELSE 'changed' END AS reason FROM method_clusters
      WHERE {_DRAW.format(key="'audit|' || cluster_id", share=0.25)} AND (method = 'vit_cadence' OR (on_off_contrast > 5 AND NOT isnan(on_off_contrast)))""",
    "superseded_scores": """SELECT method, count(*) AS n_rows, count(*) FILTER (scored_at < m) AS n_superseded FROM (SELECT *, max(scored_at) OVER (PARTITION BY cadence, method, f_start) AS m FROM window_scores
      WHERE cadence IS NOT NULL AND method IS NOT NULL AND f_start IS NOT NULL) GROUP BY 1""",
    "stale_probe": f"""SELECT cadence, method, f_start FROM window_scores WHERE cadence IS NOT NULL GROUP BY ALL HAVING count(DISTINCT scored_at) > 1
      INTERSECT SELECT cadence, method, f_start FROM window_scores WHERE {_DRAW.format(key="'probe|' || cadence || '|' || method || '|' || f_start", share=0.25)}""",
    "band_samples": "SELECT header_id, CAST(t AS INT) AS tenth, (nchans - 1024) * t // 10 AS chan_start FROM scan_headers, range(1, 10) r(t) WHERE nchans >= 1024 AND parse_error IS NULL",
    "nights_of_both": """WITH o AS (SELECT *, regexp_replace(file, '.*/', '') AS base FROM scan_headers WHERE parse_error IS NULL AND product = '0000'),
      s AS (SELECT coalesce(abs_time_s, mjd_day::BIGINT * 86400 + mjd_sec, split_part(base, '_', 3)::BIGINT * 86400 + split_part(base, '_', 4)::BIGINT) AS t, 0 AS second FROM o
        UNION ALL SELECT CAST(floor((CASE WHEN v > 2000000 THEN v - 2400000.5 ELSE v END) * 86400) AS BIGINT), 1 FROM (SELECT try_cast(replace(regexp_extract(trim(tstart_mjd, ' 	'),
          '^[+-]?([0-9]+[.,]?[0-9]*([eE][+-]?[0-9]+)?)$', 1), ',', '.') AS DOUBLE) AS v FROM association_rows) WHERE isfinite(v)),
      d AS (SELECT t, CASE WHEN t - lag(t) OVER (ORDER BY t) <= 43200 THEN 0 ELSE 1 END AS o FROM (SELECT DISTINCT t FROM s)), g AS (SELECT t, sum(o) OVER (ORDER BY t) AS k FROM d),
      n AS (SELECT k, min(t) AS night FROM g GROUP BY 1)
      SELECT night, max(s.t) AS end_s, count(*) AS n_starts, CAST(sum(second) AS BIGINT) AS n_second FROM s JOIN g USING (t) JOIN n USING (k) GROUP BY night""",
    "counterparts": _SEQ + """ SELECT sequence_id, count(*) AS n_scans, count(*) FILTER (nk IN (SELECT nk FROM s WHERE product = '0000')) AS n_same_node, count(*) FILTER (sk IN (SELECT sk FROM s WHERE product = '0000')) AS n_any_node
      FROM (SELECT DISTINCT sequence_id, nk, sk FROM s WHERE product <> '0000' AND sk IS NOT NULL) GROUP BY 1""",
    "residual_ratios": maps._C + """, e AS (SELECT map_id, c, sum(v * v) FILTER (r % 2 = 0) AS a, sum(v * v) FILTER (r % 2 = 1) AS b FROM cells GROUP BY ALL),
      t AS (SELECT map_id, sum(a) / (sum(b) + 24e-10) AS q FROM (SELECT *, row_number() OVER (PARTITION BY map_id ORDER BY a + b DESC, c) AS k FROM e) WHERE k <= 8 GROUP BY 1)
      SELECT map_id, round(q, 6) AS ratio, q >= 1 AS survives_1, q >= 2 AS survives_2, q >= 5 AS survives_5 FROM t""",
    "detection_table": maps._S + """, md AS (SELECT *, median(topk) OVER (PARTITION BY cadence) AS m FROM top), st AS (SELECT cadence, any_value(m) AS m, median(abs(topk - m)) * 1.4826 AS s FROM md GROUP BY 1),
      sg AS (SELECT map_id, sqrt(avg(v * v) - avg(v) * avg(v)) AS sg FROM cells GROUP BY 1),
      x AS (SELECT cells.map_id, cadence, snr, v + CASE WHEN r % 2 = 0 AND c = cells.map_id * 7 % 64 THEN snr * sg ELSE 0 END AS v FROM cells JOIN sg USING (map_id), (VALUES (0), (3), (6), (10), (30)) n(snr)),
      y AS (SELECT map_id, cadence, snr, sum(v) / 4 AS score FROM (SELECT *, row_number() OVER (PARTITION BY map_id, snr ORDER BY v DESC) AS k FROM x) WHERE k <= 4 GROUP BY ALL),
      z AS (SELECT y.*, (score - m) / s AS z, (SELECT avg((t.topk < y.score)::INT) FROM top t WHERE t.cadence = y.cadence) AS below FROM y JOIN st USING (cadence))
      SELECT snr, count(*) AS n, count(*) FILTER (z > 3) AS det_3, count(*) FILTER (z > 5) AS det_5, round(avg(score), 5) AS mean_score, round(stddev_pop(score), 5) AS std_score, round(avg(z), 5) AS mean_sigma,
        round(avg(below), 5) AS mean_below FROM z GROUP BY 1""",
    "slot_usage": "SELECT slot, count(*) AS n, round(avg(weight), 4) AS mean_weight FROM (" + maps.SQL["memory_addressing"] + ") GROUP BY 1",
    "channel_intensity": maps._C + """, m AS (SELECT map_id, c, median(v) AS m, sum(v) AS s, count(*) AS k FROM cells GROUP BY ALL), a AS (SELECT *, median(m) OVER (PARTITION BY map_id) AS c0 FROM m),
      b AS (SELECT *, abs(m - c0) > 5 * (median(abs(m - c0)) OVER (PARTITION BY map_id) * 1.4826) AS hit FROM a)
      SELECT map_id, count(*) FILTER (hit) AS n_flagged, round((sum(s) FILTER (hit) / sum(k) FILTER (hit)) / (sum(s) FILTER (NOT hit) / sum(k) FILTER (NOT hit)), 5) AS intensity_ratio FROM b GROUP BY 1""",
    "plane_distances": """WITH x AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS a, CAST(embedding[2] AS DOUBLE) AS b FROM embeddings),
      c AS (SELECT avg(a) AS ma, avg(b) AS mb, var_pop(a) AS va, var_pop(b) AS vb, covar_pop(a, b) AS k FROM x)
      SELECT vec_id, round(sqrt((vb * (a - ma) * (a - ma) - 2 * k * (a - ma) * (b - mb) + va * (b - mb) * (b - mb)) / (va * vb - k * k)), 5) AS distance FROM x, c""",
    "closed_sessions": """WITH o AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 10 MINUTE THEN 0 ELSE 1 END AS o FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
      k AS (SELECT *, sum(o) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM o)
      SELECT user_id, epoch_us(min(ts)) AS start_us, epoch_us(max(ts)) AS end_us, count(*) AS n FROM k GROUP BY user_id, k HAVING epoch_ms(max(ts)) + 600000 <= (SELECT epoch_ms(max(ts)) - 3600000 FROM events)""",
    "closed_windows": """WITH w AS (SELECT event_type, value, unnest([epoch_us(ts) // 1800000000 * 1800000000, epoch_us(ts) // 1800000000 * 1800000000 - 1800000000]) AS a FROM events)
      SELECT event_type, a AS start_us, count(*) AS n, round(avg(value), 6) AS mean FROM w GROUP BY 1, 2 HAVING a // 1000 + 3600000 <= (SELECT epoch_ms(max(ts)) - 3600000 FROM events)""",
}
QUERIES = {
    f.__name__: f
    for f in (scores_by_csv, score_columns, scores_by_cadence, headers_by_csv, listed_parts, appended_once, resumed_keys, replaced_parts, channels_read, checked_publication, structure_audit, content_audit, superseded_scores,
              stale_probe, band_samples, nights_of_both, counterparts, residual_ratios, detection_table, slot_usage, channel_intensity, plane_distances, closed_sessions, closed_windows)
}
