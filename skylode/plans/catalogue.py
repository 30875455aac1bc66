"""Queries over the file catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from skylode.functions.observations import base_name, finite, mjd, node_key, observations, trimmed
from skylode.operators import catalogue as C
from skylode.operators.islands import running_total
from skylode.operators.sessions import sessions_by_batches
from skylode.sources.tables import table

#: Seconds without a record that part two sessions.
SESSION_GAP = 700


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Sessions of each target, from a session table fed by the headers in the order of their ingestion."""
    seen = observations(table(spark, folder, "scan_headers")).select(F.col("target").alias("key"), "time", F.col("base").alias("id"), "ingest_ts")
    return sessions_by_batches(seen, "ingest_ts", SESSION_GAP).read().select(F.col("key").alias("target"), F.col("start").alias("start_s"), F.col("end").alias("end_s"), F.col("n").alias("n_files"))


def p3_durations(spark: SparkSession, folder: str) -> DataFrame:
    """The sessions with their duration."""
    return p3_found(spark, folder).withColumn("duration_s", F.col("end_s") - F.col("start_s"))


_P3 = """
WITH obs AS (
  SELECT *, regexp_replace(file, '.*/', '') AS base, regexp_extract(file, '_guppi_[0-9]+_[0-9]+_(.+)_[^_]+[.]rawspec', 1) AS tn
  FROM scan_headers WHERE parse_error IS NULL),
files AS (
  SELECT DISTINCT base, upper(regexp_replace(coalesce(nullif(trim(target), ''), tn), '[^A-Za-z0-9]', '', 'g')) AS target,
         coalesce(abs_time_s, mjd_day::BIGINT * 86400 + mjd_sec, split_part(base, '_', 3)::BIGINT * 86400 + split_part(base, '_', 4)::BIGINT) AS t
  FROM obs),
cut AS (SELECT *, CASE WHEN t - lag(t) OVER w <= 700 THEN 0 ELSE 1 END AS opens FROM files WINDOW w AS (PARTITION BY target ORDER BY t, base)),
numbered AS (SELECT *, sum(opens) OVER (PARTITION BY target ORDER BY t, base) AS k FROM cut),
sessions AS (SELECT target, min(t) AS start_s, max(t) AS end_s, count(*) AS n_files FROM numbered GROUP BY target, k)
"""


def parsed_names(spark: SparkSession, folder: str) -> DataFrame:
    return C.parsed_names(table(spark, folder, "scan_headers")).distinct()


def product_keys(spark: SparkSession, folder: str) -> DataFrame:
    base = base_name(F.col("file"))
    return table(spark, folder, "scan_headers").select(base.alias("base"), C.product_of(base).alias("product"), C.scan_key(base).alias("scan_key"), C.node_scan_key(base).alias("node_scan_key")).distinct()


def header_census(spark: SparkSession, folder: str) -> DataFrame:
    """Good and bad rows by product and kind of error."""
    kind = F.when(F.col("parse_error").isNotNull(), F.substring_index("parse_error", ":", 1)).when(F.col("header_error").isNotNull(), F.col("header_error")).otherwise("good")
    return table(spark, folder, "scan_headers").groupBy(F.coalesce("product", F.lit("none")).alias("product"), kind.alias("kind")).agg(F.count("*").alias("n"), F.sum("file_size_bytes").alias("bytes"))


def band_edges(spark: SparkSession, folder: str) -> DataFrame:
    """Band edges from first channel, signed step and channels, beside the recorded start; unreadable headers have none."""
    h = table(spark, folder, "scan_headers").where("header_error IS NULL AND parse_error IS NULL AND foff_hz IS NOT NULL AND fch1_mhz IS NOT NULL AND NOT isnan(foff_hz) AND NOT isnan(fch1_mhz)")
    end = F.col("fch1_mhz") + F.col("foff_hz") / 1e6 * F.col("nchans")
    return h.select("header_id", F.round(F.least("fch1_mhz", end), 4).alias("f_lo"), F.round(F.greatest("fch1_mhz", end), 4).alias("f_hi"), F.round(F.abs(F.col("fch1_mhz") - end), 4).alias("bw"))


def _files(spark: SparkSession, folder: str) -> DataFrame:
    """One row per file: product, node, target, time, and the header's band and length."""
    headers = table(spark, folder, "scan_headers")
    seen = observations(headers).select("header_id", "base", "product", "node", "target", "time")
    one = seen.groupBy("base").agg(*[F.min_by(c, "header_id").alias(c) for c in ("product", "node", "target", "time")], F.min("header_id").alias("header_id"))
    return one.where("time IS NOT NULL AND node IS NOT NULL AND product IS NOT NULL").join(headers.select("header_id", "f_start_mhz", "f_stop_mhz", "ntime"), "header_id")


def _sequences(spark: SparkSession, folder: str) -> DataFrame:
    return C.sequences_of_six(_files(spark, folder))


_SEQ = ["product", "node", "run", "seq"]


def observing_sequences(spark: SparkSession, folder: str) -> DataFrame:
    return _sequences(spark, folder).groupBy(*_SEQ).agg(F.min("time").alias("start_s"), F.max("time").alias("end_s"), F.count("*").alias("n_files"))


def on_off_targets(spark: SparkSession, folder: str) -> DataFrame:
    return C.on_off(_sequences(spark, folder), _SEQ)


def sequence_flags(spark: SparkSession, folder: str) -> DataFrame:
    return C.shape_flags(_sequences(spark, folder), _SEQ)


def nights(spark: SparkSession, folder: str) -> DataFrame:
    """Nights of the first product's observations over all nodes, numbered in order of time, with the gap to the next."""
    files = _files(spark, folder).where("product = '0000'")
    found = files.join(C.nights_of(files), "time").groupBy("night").agg(F.min("time").alias("start_s"), F.max("time").alias("end_s"), F.count("*").alias("n_files"))
    order = W.orderBy("night")  # one row per night
    return found.select(F.format_string("S%06d", F.row_number().over(order)).alias("name"), "start_s", "end_s", "n_files", (F.lead("start_s").over(order) - F.col("end_s")).alias("gap_after_s"))


def night_gaps(spark: SparkSession, folder: str) -> DataFrame:
    """The longest gap inside a night and the shortest between two."""
    times = C.nights_of(_files(spark, folder).where("product = '0000'"))
    inside = times.withColumn("gap", F.col("time") - F.lag("time").over(W.partitionBy("night").orderBy("time"))).agg(F.max("gap").alias("max_inside_s"))
    ends = times.groupBy("night").agg(F.max("time").alias("e")).withColumn("next", F.lead("night").over(W.orderBy("night")))
    return inside.join(ends.agg(F.min(F.col("next") - F.col("e")).alias("min_between_s")), F.lit(True))


def header_mismatches(spark: SparkSession, folder: str) -> DataFrame:
    """Second-product starts beside the first product's header of the same node and scan: band within 0.01 MHz, start
    within one second; a Julian date is converted. A row whose numbers can't be read is compared as far as they can."""
    rows = table(spark, folder, "association_rows").withColumn("k", C.node_scan_key(base_name(F.col("file"))))
    refs = table(spark, folder, "scan_headers").where("product = '0000' AND parse_error IS NULL").withColumn("k", C.node_scan_key(base_name(F.col("file"))))
    refs = refs.groupBy("k").agg(F.min_by(F.struct("f_start_mhz", "f_stop_mhz", "tstart_mjd"), "header_id").alias("r"))
    number = lambda c: finite(F.regexp_replace(trimmed(F.col(c)), ",", ".").try_cast("double"))
    both = rows.join(refs, "k").select("row_id", number("f_start_mhz").alias("a"), number("f_stop_mhz").alias("b"), mjd(F.col("tstart_mjd")).alias("t"), "r")
    # Null OR true is true: one edge that can be read and differs is enough.
    band = (F.abs(F.col("a") - finite(F.col("r.f_start_mhz"))) > 0.01) | (F.abs(F.col("b") - finite(F.col("r.f_stop_mhz"))) > 0.01)
    start = F.abs(F.col("t") - finite(F.col("r.tstart_mjd"))) * 86400 > 1.0
    return both.select("row_id", F.coalesce(band, F.lit(False)).alias("band_vs_0000"), F.coalesce(start, F.lit(False)).alias("tstart_vs_0000"))


def _sequence_files(spark: SparkSession, folder: str) -> DataFrame:
    s = table(spark, folder, "sequences").select("sequence_id", "product", F.regexp_replace(F.lower("split"), "[^a-z]", "").alias("split"), F.explode("files").alias("f"))
    return s.withColumn("base", base_name(F.col("f"))).select("sequence_id", "product", F.nullif("split", F.lit("")).alias("split"), C.node_scan_key(F.col("base")).alias("node_key"), C.scan_key(F.col("base")).alias("scan_key"))


def exact_matches(spark: SparkSession, folder: str) -> DataFrame:
    """Sequences of other products whose node and scan keys are exactly those of one first-product sequence."""
    keys = _sequence_files(spark, folder).where("node_key IS NOT NULL").groupBy("sequence_id", "product").agg(F.array_join(F.array_sort(F.collect_set("node_key")), " ").alias("keys"))
    refs = keys.where("product = '0000'").groupBy("keys").agg(F.min("sequence_id").alias("ref_id"), F.count("*").alias("n_refs"))
    return keys.where("product <> '0000'").join(refs, "keys").select("sequence_id", "ref_id", "n_refs")


def scan_splits(spark: SparkSession, folder: str) -> DataFrame:
    """The splits recorded for each scan, over all nodes and products."""
    files = _sequence_files(spark, folder).where("scan_key IS NOT NULL AND split IS NOT NULL")
    return files.groupBy("scan_key").agg(F.array_join(F.array_sort(F.collect_set("split")), ",").alias("splits"), F.count_distinct("sequence_id").alias("n_sequences"))


def missing_counterparts(spark: SparkSession, folder: str) -> DataFrame:
    """First-product sequences none of whose files has one in another product, by product."""
    files = _sequence_files(spark, folder).where("node_key IS NOT NULL")
    first = files.where("product = '0000'").select("sequence_id", "node_key").distinct()
    out = []
    for product in ("0001", "0002"):
        other = files.where(F.col("product") == product).select("node_key").distinct()
        out.append(first.select("sequence_id").distinct().join(first.join(other, "node_key", "left_semi").select("sequence_id").distinct(), "sequence_id", "left_anti").withColumn("product", F.lit(product)))
    return out[0].unionByName(out[1])


def flag_counts(spark: SparkSession, folder: str) -> DataFrame:
    flags = table(spark, folder, "sequences").select("product", "match_kind", F.explode_outer("flags").alias("flag"))
    return flags.groupBy("product", "match_kind", F.coalesce("flag", F.lit("none")).alias("flag")).agg(F.count("*").alias("n"))


def coverage(spark: SparkSession, folder: str) -> DataFrame:
    """Range, bandwidth and duration of each product; the upper median is taken over counts of distinct values."""
    good = table(spark, folder, "scan_headers").where("parse_error IS NULL AND header_error IS NULL AND duration_s IS NOT NULL AND NOT isnan(duration_s)")
    counts = good.groupBy("product", "duration_s").agg(F.count("*").alias("c"))
    order = W.partitionBy("product").orderBy("duration_s")
    ranked = counts.withColumns({"to": F.sum("c").over(order), "n": F.sum("c").over(W.partitionBy("product"))})
    mid = ranked.where("to > n div 2 AND to - c <= n div 2").select("product", F.col("duration_s").alias("upper_median_duration"))
    return good.groupBy("product").agg(
        F.count("*").alias("n"), F.min("f_start_mhz").alias("f_min"), F.max("f_stop_mhz").alias("f_max"), F.min("bw_mhz").alias("bw_min"), F.max("bw_mhz").alias("bw_max"),
        F.min("duration_s").alias("d_min"), F.max("duration_s").alias("d_max"),
    ).join(mid, "product")


def node_completeness(spark: SparkSession, folder: str) -> DataFrame:
    """Files of each node and product beside the most of any node."""
    per = _files(spark, folder).groupBy("product", "node").agg(F.count("*").alias("n"))
    return per.withColumn("most", F.max("n").over(W.partitionBy("product"))).withColumn("short", F.col("n") < F.col("most"))


def nodes_without_sequences(spark: SparkSession, folder: str) -> DataFrame:
    """Nodes and products seen in the catalogue that have no sequence."""
    seen = _files(spark, folder).select("product", "node").distinct()
    return seen.subtract(table(spark, folder, "sequences").select("product", node_key(F.col("node")).alias("node")))


def sequence_bands(spark: SparkSession, folder: str) -> DataFrame:
    """The rounded band of each sequence's first file; null where another file differs by more than 1 MHz."""
    rows = _sequences(spark, folder).where("NOT isnan(f_start_mhz) AND NOT isnan(f_stop_mhz)")
    first = rows.groupBy(*_SEQ).agg(F.min_by(F.struct("f_start_mhz", "f_stop_mhz"), "place").alias("b"), F.max("f_start_mhz").alias("a1"), F.min("f_start_mhz").alias("a0"), F.max("f_stop_mhz").alias("z1"), F.min("f_stop_mhz").alias("z0"))
    alike = F.greatest(F.col("a1") - F.col("b.f_start_mhz"), F.col("b.f_start_mhz") - F.col("a0"), F.col("z1") - F.col("b.f_stop_mhz"), F.col("b.f_stop_mhz") - F.col("z0")) <= 1.0
    return first.select(*_SEQ, F.when(alike, F.round("b.f_start_mhz", 0)).alias("band_lo"), F.when(alike, F.round("b.f_stop_mhz", 0)).alias("band_hi"))


def bands_first_complete(spark: SparkSession, folder: str) -> DataFrame:
    """For each band of the first product its first complete sequence; the eight lowest bands."""
    rows = _sequences(spark, folder).where("product = '0000'")
    whole = rows.groupBy("node", "run", "seq").agg(F.count("*").alias("n"), F.min("time").alias("start_s"), F.min("f_start_mhz").alias("band")).where("n = 6 AND NOT isnan(band)")
    return whole.groupBy("band").agg(F.min(F.struct("start_s", "node")).alias("s")).select("band", "s.start_s", "s.node").orderBy("band").limit(8)


def split_leaks(spark: SparkSession, folder: str) -> DataFrame:
    """Nights whose sequences carry two or more different splits."""
    s = table(spark, folder, "sequences").select(F.regexp_extract(F.upper(F.regexp_replace("night", "[\\s-]", "")), "^S0*(\\d+)$", 1).alias("night"), F.regexp_replace(F.lower("split"), "[^a-z]", "").alias("split"))
    return s.where("night <> '' AND split <> ''").groupBy("night").agg(F.count_distinct("split").alias("n_splits"), F.count("*").alias("n_sequences")).where("n_splits > 1")


def _hash(*parts: str) -> F.Column:
    """The first four bytes, big-endian, of the SHA-256 of the parts joined by bars."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", *[F.col(p).cast("string") for p in parts]), 256), 1, 8), 16, 10).cast("long")


def night_selection(spark: SparkSession, folder: str) -> DataFrame:
    """Six sequences of each night, round-robin over its nodes in seeded order."""
    s = table(spark, folder, "sequences").select("sequence_id", node_key(F.col("node")).alias("node"), F.regexp_extract(F.upper(F.regexp_replace("night", "[\\s-]", "")), "^S0*(\\d+)$", 1).alias("night"), F.lit("rows").alias("seed"))
    s = s.where("night <> '' AND node IS NOT NULL").withColumns({"h": _hash("seed", "sequence_id"), "nh": _hash("seed", "night", "node")})
    turn = F.row_number().over(W.partitionBy("night", "node").orderBy("h", "sequence_id"))
    place = F.row_number().over(W.partitionBy("night").orderBy("turn", "nh", "node"))
    return s.withColumn("turn", turn).where("turn <= 6").withColumn("place", place).where("place <= 6").select("night", "node", "sequence_id", F.col("place").cast("long").alias("place"))


def cadence_offsets(spark: SparkSession, folder: str) -> DataFrame:
    """Cumulative offsets of the cadences' window counts, in the order of the name."""
    counts = table(spark, folder, "window_scores").where("cadence IS NOT NULL").groupBy("cadence").agg(F.count("*").alias("n"))
    total = running_total(counts.withColumn("one", F.lit(0)), ["one"], [F.col("cadence")], F.substring("cadence", 1, 11), "n", "upto")
    return total.select("cadence", "n", (F.col("upto") - F.col("n")).alias("offset"))


def quota_fill(spark: SparkSession, folder: str) -> DataFrame:
    """Windows taken of each cadence, 50 at most, in the order of the name until 2,000 are reached."""
    counts = table(spark, folder, "window_scores").where("cadence IS NOT NULL").groupBy("cadence").agg(F.least(F.count("*"), F.lit(50)).alias("n"))
    total = running_total(counts.withColumn("one", F.lit(0)), ["one"], [F.col("cadence")], F.substring("cadence", 1, 11), "n", "upto")
    left = F.lit(2000) - (F.col("upto") - F.col("n"))
    return total.select("cadence", F.least(F.col("n"), F.greatest(left, F.lit(0))).cast("long").alias("n_take")).where("n_take > 0")


def validation_split(spark: SparkSession, folder: str) -> DataFrame:
    """A fifth of the cadences, rounded down, for validation, by seeded hash order: exact in number, unlike random splits."""
    c = table(spark, folder, "window_scores").where("cadence IS NOT NULL").select("cadence", F.lit("split").alias("seed")).distinct()
    c = c.withColumns({"h": _hash("seed", "cadence"), "one": F.lit(0), "unit": F.lit(1)})
    ranked = running_total(c, ["one"], [F.col("h"), F.col("cadence")], F.shiftright("h", 20), "unit", "rank")
    n = c.groupBy("one").agg(F.expr("count(*) div 5").alias("n_val"))  # one row
    return ranked.join(n, "one").select("cadence", F.when(F.col("rank") <= F.col("n_val"), "validation").otherwise("train").alias("split"))


def cadence_metadata(spark: SparkSession, folder: str) -> DataFrame:
    """Each scored cadence's header: product, first channel, signed step, date; by node, day and second of its name."""
    c = table(spark, folder, "window_scores").select("cadence").where("cadence IS NOT NULL").distinct().withColumn("p", F.split("cadence", "_"))
    c = c.select("cadence", F.get("p", F.lit(0)).alias("node"), (F.get("p", F.lit(1)).try_cast("long") * 86400 + F.get("p", F.lit(2)).try_cast("long")).alias("time"), F.get("p", F.lit(1)).try_cast("long").alias("day"))
    files = _files(spark, folder).where("product = '0000'").groupBy("node", "time").agg(F.min("header_id").alias("header_id"))
    date = F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), (F.col("day") - 40587).cast("int")), "yyyyMMdd")
    headers = table(spark, folder, "scan_headers").select("header_id", "fch1_mhz", "foff_hz", "nchans")
    return c.join(files, ["node", "time"]).join(headers, "header_id").select("cadence", "header_id", "fch1_mhz", "foff_hz", "nchans", date.alias("date"))


def excluded_windows(spark: SparkSession, folder: str) -> DataFrame:
    """Windows of each cadence inside the excluded bands: those whose span, by the signed step, overlaps one strictly."""
    w = table(spark, folder, "window_scores").where("cadence IS NOT NULL").select("cadence", "f_start").distinct()
    m = cadence_metadata(spark, folder).where("fch1_mhz IS NOT NULL AND foff_hz IS NOT NULL AND NOT isnan(fch1_mhz) AND NOT isnan(foff_hz)")
    a, b = (F.col("fch1_mhz") + F.col("foff_hz") / 1e6 * x for x in (F.col("f_start"), F.col("f_start") + 1024))
    bands = F.array(*[F.struct(F.lit(lo).alias("lo"), F.lit(hi).alias("hi")) for lo, hi in ((1200.0, 1341.2), (2300.0, 2360.0), (4060.0, 4064.0), (5524.5, 5525.5))])
    hit = F.exists(bands, lambda e: (F.greatest(a, b) > e["lo"]) & (F.least(a, b) < e["hi"]))
    return w.join(m, "cadence").groupBy("cadence").agg(F.count("*").alias("n"), F.count_if(hit).alias("n_excluded"))


_O = """
WITH obs AS (
  SELECT header_id, regexp_replace(file, '.*/', '') AS base, product, node, target, f_start_mhz, f_stop_mhz, ntime, abs_time_s, mjd_day, mjd_sec,
    regexp_extract(file, '_guppi_[0-9]+_[0-9]+_(.+)_[^_]+[.]rawspec', 1) AS tn FROM scan_headers WHERE parse_error IS NULL),
files AS (
  SELECT min(header_id) AS header_id, arg_min(product, header_id) AS product,
    arg_min(lower(trim(coalesce(nullif(trim(node), ''), split_part(base, '_', 1)))), header_id) AS node, base,
    arg_min(upper(regexp_replace(coalesce(nullif(trim(target), ''), tn), '[^A-Za-z0-9]', '', 'g')), header_id) AS target,
    arg_min(coalesce(abs_time_s, mjd_day::BIGINT * 86400 + mjd_sec, split_part(base, '_', 3)::BIGINT * 86400 + split_part(base, '_', 4)::BIGINT), header_id) AS time,
    min_by(struct_pack(a := f_start_mhz, z := f_stop_mhz, n := ntime), header_id) AS h
  FROM obs GROUP BY base),
opens AS (SELECT *, CASE WHEN time - lag(time) OVER w <= 700 THEN NULL ELSE time END AS o FROM files WINDOW w AS (PARTITION BY product, node ORDER BY time)),
runs AS (SELECT *, max(o) OVER (PARTITION BY product, node ORDER BY time) AS run FROM opens),
sq AS (SELECT *, (k - 1) // 6 AS seq, (k - 1) % 6 AS place FROM (SELECT *, row_number() OVER (PARTITION BY product, node, run ORDER BY time, base) AS k FROM runs)),
n0 AS (SELECT time, CASE WHEN time - lag(time) OVER (ORDER BY time) <= 43200 THEN NULL ELSE time END AS o FROM (SELECT DISTINCT time FROM files WHERE product = '0000')),
nt AS (SELECT time, max(o) OVER (ORDER BY time) AS night FROM n0)
"""
_K = """
WITH f AS (SELECT sequence_id, product, nullif(regexp_replace(lower(split), '[^a-z]', '', 'g'), '') AS split, regexp_replace(unnest(files), '.*/', '') AS base FROM sequences),
k AS (SELECT sequence_id, product, split, lower(regexp_replace(base, '([.]rawspec)?[.](000[012]|fine|time|mid)[.](h5|hdf5|fil)$', '')) AS nk FROM f)
"""
_NIGHT = "regexp_extract(upper(regexp_replace(night, '[\\s-]', '', 'g')), '^S0*([0-9]+)$', 1)"


def _sha(parts: str) -> str:
    return f"CAST('0x' || substr(sha256({parts}), 1, 8) AS BIGINT)"


QUERIES = {
    f.__name__: f
    for f in (p3_found, p3_durations, parsed_names, product_keys, header_census, band_edges, observing_sequences, on_off_targets, sequence_flags, nights, night_gaps, header_mismatches,
              exact_matches, scan_splits, missing_counterparts, flag_counts, coverage, node_completeness, nodes_without_sequences, sequence_bands, bands_first_complete, split_leaks,
              night_selection, cadence_offsets, quota_fill, validation_split, cadence_metadata, excluded_windows)
}
SQL = {
    "p3_found": _P3 + "SELECT * FROM sessions",
    "p3_durations": _P3 + "SELECT *, end_s - start_s AS duration_s FROM sessions",
    "parsed_names": """WITH b AS (SELECT DISTINCT regexp_replace(file, '.*/', '') AS base FROM scan_headers),
      c AS (SELECT base, CASE WHEN contains(base, '.rawspec.') AND suffix(base, '.h5') THEN split_part(base, '.rawspec.', 1) WHEN regexp_matches(base, '^.*[.][0-9]+[.]h5$') THEN regexp_replace(base, '[.][0-9]+[.]h5$', '') END AS core,
        CASE WHEN contains(base, '.rawspec.') AND suffix(base, '.h5') THEN regexp_replace(split_part(base, '.rawspec.', 2), '[.]h5$', '') ELSE regexp_extract(base, '[.]([0-9]+)[.]h5$', 1) END AS product FROM b),
      d AS (SELECT *, string_split(core, '_') AS f FROM c),
      e AS (SELECT *, CASE WHEN core IS NULL THEN 'unrecognised filename: ' || base WHEN len(f) < 6 THEN 'too few fields (' || len(f) || '): ' || core
        WHEN try_cast(f[3] AS BIGINT) IS NULL OR try_cast(f[4] AS BIGINT) IS NULL THEN 'non-numeric MJD: ' || base END AS parse_error FROM d)
      SELECT base, CASE WHEN parse_error IS NULL THEN f[1] END AS node, CASE WHEN parse_error IS NULL THEN try_cast(f[3] AS BIGINT) END AS mjd_day, CASE WHEN parse_error IS NULL THEN try_cast(f[4] AS BIGINT) END AS mjd_sec,
        CASE WHEN parse_error IS NULL THEN try_cast(f[3] AS BIGINT) * 86400 + try_cast(f[4] AS BIGINT) END AS abs_time_s, CASE WHEN parse_error IS NULL THEN array_to_string(f[5:len(f) - 1], '_') END AS target,
        CASE WHEN parse_error IS NULL THEN f[len(f)] END AS scan_num, CASE WHEN parse_error IS NULL THEN product END AS product, parse_error FROM e""",
    "product_keys": """WITH b AS (SELECT DISTINCT regexp_replace(file, '.*/', '') AS base FROM scan_headers),
      p AS (SELECT base, nullif(lower(regexp_extract(base, '[.](000[012]|fine|time|mid)[.](h5|hdf5|fil)$', 1, 'i')), '') AS p FROM b),
      k AS (SELECT base, CASE p WHEN 'fine' THEN '0000' WHEN 'time' THEN '0001' WHEN 'mid' THEN '0002' ELSE p END AS product,
        CASE WHEN p IS NOT NULL THEN nullif(lower(regexp_replace(base, '([.]rawspec)?[.](000[012]|fine|time|mid)[.](h5|hdf5|fil)$', '', 'i')), '') END AS nk FROM p)
      SELECT base, product, nullif(regexp_replace(nk, '^blc[0-9a-z]+_', ''), '') AS scan_key, nk AS node_scan_key FROM k""",
    "header_census": """SELECT coalesce(product, 'none') AS product, CASE WHEN parse_error IS NOT NULL THEN split_part(parse_error, ':', 1) WHEN header_error IS NOT NULL THEN header_error ELSE 'good' END AS kind,
      count(*) AS n, CAST(sum(file_size_bytes) AS BIGINT) AS bytes FROM scan_headers GROUP BY 1, 2""",
    "band_edges": """SELECT header_id, round(least(fch1_mhz, fch1_mhz + foff_hz / 1e6 * nchans), 4) AS f_lo, round(greatest(fch1_mhz, fch1_mhz + foff_hz / 1e6 * nchans), 4) AS f_hi,
      round(abs(fch1_mhz - (fch1_mhz + foff_hz / 1e6 * nchans)), 4) AS bw FROM scan_headers WHERE header_error IS NULL AND parse_error IS NULL AND NOT isnan(foff_hz) AND NOT isnan(fch1_mhz)""",
    "observing_sequences": _O + "SELECT product, node, run, seq, min(time) AS start_s, max(time) AS end_s, count(*) AS n_files FROM sq GROUP BY ALL",
    "on_off_targets": _O + """, c AS (SELECT product, node, run, seq, target, count(*) AS n, min(place) AS p FROM sq GROUP BY ALL),
      t AS (SELECT product, node, run, seq, max(n) AS m, arg_max(target, (n, -p)) AS t FROM c GROUP BY ALL)
      SELECT product, node, run, seq, CASE WHEN m > 1 THEN any_value(t) END AS on_target, CASE WHEN m > 1 THEN m ELSE 0 END AS n_on, CAST(sum(n) - CASE WHEN m > 1 THEN m ELSE 0 END AS BIGINT) AS n_off,
        coalesce(string_agg(target, ',' ORDER BY p) FILTER (m = 1 OR target <> t), '') AS off_targets FROM c JOIN t USING (product, node, run, seq) GROUP BY product, node, run, seq, m""",
    "sequence_flags": _O + """, g AS (SELECT product, node, run, seq, list(target ORDER BY place) AS t, count(*) AS n, count(DISTINCT (h.a, h.z)) FILTER (h.a IS NOT NULL AND h.z IS NOT NULL) AS b, count(DISTINCT h.n) AS m FROM sq GROUP BY ALL)
      SELECT product, node, run, seq, concat_ws(',', CASE WHEN n <> 6 THEN 'files_' || n END,
        CASE WHEN n = 6 AND NOT coalesce(t[1] = t[3] AND t[3] = t[5] AND len(list_distinct([t[1], t[2], t[4], t[6]])) = 4, FALSE) THEN 'pattern' END,
        CASE WHEN b > 1 THEN 'mixed_band' END, CASE WHEN m > 1 THEN 'ragged_ntime' END) AS flags FROM g""",
    "nights": _O + """, g AS (SELECT night, min(time) AS start_s, max(time) AS end_s, count(*) AS n_files FROM files JOIN nt USING (time) WHERE product = '0000' GROUP BY 1)
      SELECT printf('S%06d', row_number() OVER (ORDER BY night)) AS name, start_s, end_s, n_files, lead(start_s) OVER (ORDER BY night) - end_s AS gap_after_s FROM g""",
    "night_gaps": _O + """, a AS (SELECT max(d) AS x FROM (SELECT time - lag(time) OVER (PARTITION BY night ORDER BY time) AS d FROM nt)),
      b AS (SELECT min(d) AS y FROM (SELECT lead(min(time)) OVER (ORDER BY night) - max(time) AS d FROM nt GROUP BY night)) SELECT x AS max_inside_s, y AS min_between_s FROM a, b""",
    "header_mismatches": """WITH r AS (SELECT lower(regexp_replace(regexp_replace(file, '.*/', ''), '([.]rawspec)?[.](000[012])[.]h5$', '')) AS k, arg_min(struct_pack(a := f_start_mhz, z := f_stop_mhz, t := tstart_mjd), header_id) AS r
        FROM scan_headers WHERE product = '0000' AND parse_error IS NULL GROUP BY 1),
      q AS (SELECT row_id, lower(regexp_replace(file, '([.]rawspec)?[.](000[012])[.]h5$', '')) AS k, try_cast(replace(trim(f_start_mhz, ' \t'), ',', '.') AS DOUBLE) AS a, try_cast(replace(trim(f_stop_mhz, ' \t'), ',', '.') AS DOUBLE) AS z,
        try_cast(replace(trim(tstart_mjd, ' \t'), ',', '.') AS DOUBLE) AS t FROM association_rows)
      SELECT row_id, coalesce(abs(q.a - r.r.a) > 0.01 OR abs(q.z - r.r.z) > 0.01, FALSE) AS band_vs_0000, coalesce(abs(q.t - r.r.t) * 86400 > 1.0, FALSE) AS tstart_vs_0000
      FROM q JOIN r USING (k) WHERE NOT isnan(r.r.a) AND NOT isnan(r.r.t) AND q.t < 2000000""",
    "exact_matches": _K + """, s AS (SELECT sequence_id, product, string_agg(DISTINCT nk, ' ' ORDER BY nk) AS keys FROM k GROUP BY ALL),
      r AS (SELECT keys, min(sequence_id) AS ref_id, count(*) AS n_refs FROM s WHERE product = '0000' GROUP BY 1)
      SELECT sequence_id, ref_id, n_refs FROM s JOIN r USING (keys) WHERE product <> '0000'""",
    "scan_splits": _K + "SELECT regexp_replace(nk, '^blc[0-9a-z]+_', '') AS scan_key, string_agg(DISTINCT split, ',' ORDER BY split) AS splits, count(DISTINCT sequence_id) AS n_sequences FROM k WHERE split IS NOT NULL GROUP BY 1",
    "missing_counterparts": _K + """SELECT DISTINCT a.sequence_id, p.product FROM k a, (VALUES ('0001'), ('0002')) p(product) WHERE a.product = '0000' AND NOT EXISTS (
        SELECT 1 FROM k b JOIN k c ON b.nk = c.nk WHERE b.sequence_id = a.sequence_id AND c.product = p.product)""",
    "flag_counts": """SELECT product, match_kind, coalesce(flag, 'none') AS flag, count(*) AS n FROM (
        SELECT product, match_kind, unnest(CASE WHEN flags IS NULL OR len(flags) = 0 THEN [NULL::VARCHAR] ELSE flags END) AS flag FROM sequences) GROUP BY 1, 2, 3""",
    "coverage": """SELECT product, count(*) AS n, min(f_start_mhz) AS f_min, max(f_stop_mhz) AS f_max, min(bw_mhz) AS bw_min, max(bw_mhz) AS bw_max, min(duration_s) AS d_min, max(duration_s) AS d_max,
      list_sort(list(duration_s))[count(*) // 2 + 1] AS upper_median_duration FROM scan_headers WHERE parse_error IS NULL AND header_error IS NULL AND NOT isnan(duration_s) GROUP BY product""",
    "node_completeness": _O + "SELECT product, node, n, max(n) OVER (PARTITION BY product) AS most, n < max(n) OVER (PARTITION BY product) AS short FROM (SELECT product, node, count(*) AS n FROM files GROUP BY ALL)",
    "nodes_without_sequences": _O + "SELECT product, node FROM files EXCEPT SELECT product, lower(trim(node)) FROM sequences",
    "sequence_bands": _O + """, g AS (SELECT product, node, run, seq, arg_min(h, place) AS b, max(h.a) AS a1, min(h.a) AS a0, max(h.z) AS z1, min(h.z) AS z0 FROM sq WHERE NOT isnan(h.a) AND NOT isnan(h.z) GROUP BY ALL)
      SELECT product, node, run, seq, CASE WHEN greatest(a1 - b.a, b.a - a0, z1 - b.z, b.z - z0) <= 1 THEN round(b.a) END AS band_lo, CASE WHEN greatest(a1 - b.a, b.a - a0, z1 - b.z, b.z - z0) <= 1 THEN round(b.z) END AS band_hi FROM g""",
    "bands_first_complete": _O + """, w AS (SELECT node, min(time) AS start_s, min(h.a) AS band FROM sq WHERE product = '0000' GROUP BY node, run, seq HAVING count(*) = 6)
      SELECT band, min(start_s) AS start_s, arg_min(node, (start_s, node)) AS node FROM w WHERE NOT isnan(band) GROUP BY band ORDER BY band LIMIT 8""",
    "split_leaks": f"""SELECT night, count(DISTINCT s) AS n_splits, count(*) AS n_sequences FROM (SELECT {_NIGHT} AS night, regexp_replace(lower(split), '[^a-z]', '', 'g') AS s FROM sequences) WHERE night <> '' AND s <> '' GROUP BY 1 HAVING count(DISTINCT s) > 1""",
    "night_selection": f"""WITH s AS (SELECT sequence_id, lower(trim(node)) AS node, {_NIGHT} AS night FROM sequences),
      t AS (SELECT *, row_number() OVER (PARTITION BY night, node ORDER BY {_sha("'rows|' || sequence_id")}, sequence_id) AS turn FROM s WHERE night <> ''),
      p AS (SELECT *, row_number() OVER (PARTITION BY night ORDER BY turn, {_sha("'rows|' || night || '|' || node")}, node) AS place FROM t)
      SELECT night, node, sequence_id, place FROM p WHERE place <= 6""",
    "cadence_offsets": "SELECT cadence, n, CAST(sum(n) OVER (ORDER BY cadence) - n AS BIGINT) AS \"offset\" FROM (SELECT cadence, count(*) AS n FROM window_scores WHERE cadence IS NOT NULL GROUP BY 1)",
    "quota_fill": """WITH c AS (SELECT cadence, least(count(*), 50) AS n FROM window_scores WHERE cadence IS NOT NULL GROUP BY 1), r AS (SELECT *, sum(n) OVER (ORDER BY cadence) - n AS before FROM c)
      SELECT cadence, CAST(least(n, greatest(2000 - before, 0)) AS BIGINT) AS n_take FROM r WHERE before < 2000""",
    "validation_split": f"""WITH c AS (SELECT DISTINCT cadence FROM window_scores WHERE cadence IS NOT NULL), r AS (SELECT cadence, row_number() OVER (ORDER BY {_sha("'split|' || cadence")}, cadence) AS k, count(*) OVER () AS n FROM c)
      SELECT cadence, CASE WHEN k <= n // 5 THEN 'validation' ELSE 'train' END AS split FROM r""",
    "cadence_metadata": _O + """, c AS (SELECT DISTINCT cadence, string_split(cadence, '_') AS p FROM window_scores WHERE cadence IS NOT NULL), f AS (SELECT node, time, min(header_id) AS header_id FROM files WHERE product = '0000' GROUP BY ALL)
      SELECT cadence, s.header_id, fch1_mhz, foff_hz, nchans, strftime(DATE '1970-01-01' + (p[2]::INT - 40587), '%Y%m%d') AS date
      FROM c JOIN f ON f.node = p[1] AND f.time = p[2]::BIGINT * 86400 + p[3]::BIGINT JOIN scan_headers s ON s.header_id = f.header_id""",
    "excluded_windows": _O + """, c AS (SELECT DISTINCT cadence, string_split(cadence, '_') AS p FROM window_scores WHERE cadence IS NOT NULL), f AS (SELECT node, time, min(header_id) AS header_id FROM files WHERE product = '0000' GROUP BY ALL),
      m AS (SELECT cadence, fch1_mhz, foff_hz FROM c JOIN f ON f.node = p[1] AND f.time = p[2]::BIGINT * 86400 + p[3]::BIGINT JOIN scan_headers s ON s.header_id = f.header_id WHERE NOT isnan(fch1_mhz) AND NOT isnan(foff_hz)),
      w AS (SELECT cadence, fch1_mhz + foff_hz / 1e6 * f_start AS a, fch1_mhz + foff_hz / 1e6 * (f_start + 1024) AS b FROM (SELECT DISTINCT cadence, f_start FROM window_scores) JOIN m USING (cadence))
      SELECT cadence, count(*) AS n, count(*) FILTER (EXISTS (SELECT 1 FROM (VALUES (1200.0, 1341.2), (2300.0, 2360.0), (4060.0, 4064.0), (5524.5, 5525.5)) e(lo, hi) WHERE greatest(a, b) > lo AND least(a, b) < hi)) AS n_excluded FROM w GROUP BY cadence""",
}
# header_mismatches as the query states it: every joined row, compared as far as it can be read. Its older SQL leaves rows out.
SQL["header_checks"] = r"""WITH r AS (SELECT lower(regexp_replace(regexp_replace(file, '.*/', ''), '([.]rawspec)?[.](000[012])[.]h5$', '')) AS k, arg_min(struct_pack(a := f_start_mhz, z := f_stop_mhz, t := tstart_mjd), header_id) AS r
    FROM scan_headers WHERE product = '0000' AND parse_error IS NULL GROUP BY 1),
  h AS (SELECT k, CASE WHEN isfinite(r.a) THEN r.a END AS a, CASE WHEN isfinite(r.z) THEN r.z END AS z, CASE WHEN isfinite(r.t) THEN r.t END AS t FROM r),
  q AS (SELECT row_id, lower(regexp_replace(file, '([.]rawspec)?[.](000[012])[.]h5$', '')) AS k, try_cast(replace(trim(f_start_mhz, ' 	'), ',', '.') AS DOUBLE) AS a, try_cast(replace(trim(f_stop_mhz, ' 	'), ',', '.') AS DOUBLE) AS z,
    try_cast(replace(regexp_extract(trim(tstart_mjd, ' 	'), '^[+-]?([0-9]+[.,]?[0-9]*([eE][+-]?[0-9]+)?)$', 1), ',', '.') AS DOUBLE) AS v FROM association_rows),
  n AS (SELECT row_id, k, CASE WHEN isfinite(a) THEN a END AS a, CASE WHEN isfinite(z) THEN z END AS z, CASE WHEN v > 2000000 THEN v - 2400000.5 WHEN isfinite(v) THEN v END AS t FROM q)
  SELECT row_id, coalesce(abs(n.a - h.a) > 0.01 OR abs(n.z - h.z) > 0.01, FALSE) AS band_vs_0000, coalesce(abs(n.t - h.t) * 86400 > 1.0, FALSE) AS tstart_vs_0000 FROM n JOIN h USING (k)"""
QUERIES["header_checks"] = header_mismatches
