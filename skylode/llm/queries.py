"""The queries of this subpackage over the test tables, and the SQL they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from skylode.functions.observations import base_name, node_key, observations, trimmed
from skylode.llm import cutoffs, mixing, nearest, pii, splits, tokens, topn
from skylode.session import materialize
from skylode.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]


def _cutoffs(spark: SparkSession, folder: str) -> cutoffs.Cutoffs:
    drop = table(spark, folder, "selection_rules").select("method", F.round(F.col("far_quantile") * 1000).cast("long").alias("drop"))
    return cutoffs.keep_fraction(table(spark, folder, "window_scores"), ["cadence", "method"], "f_start", "score", "scored_at", drop)


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return _cutoffs(spark, folder).kept.select("cadence", "method", "f_start")


def p1_cutoffs(spark: SparkSession, folder: str) -> DataFrame:
    """Cutoffs and kept sizes beside the recorded thresholds; a recorded cadence and method of several rows counts once for each."""
    recorded = table(spark, folder, "method_results").select("cadence", "method", "far_thresh", "n_stage1")
    return _cutoffs(spark, folder).groups.join(recorded, ["cadence", "method"], "left")


_P1 = """
WITH last AS (
  SELECT cadence, method, f_start, arg_max(CASE WHEN isfinite(score) THEN score END, scored_at) AS s0,
         max(scored_at) AS at FROM window_scores WHERE cadence IS NOT NULL AND method IS NOT NULL GROUP BY ALL),
held AS (
  SELECT l.cadence, l.method, l.f_start, max(w.score) AS score FROM last l JOIN window_scores w
    ON l.cadence = w.cadence AND l.method = w.method AND l.f_start = w.f_start AND l.at = w.scored_at
  WHERE isfinite(w.score) GROUP BY ALL),
ranked AS (
  SELECT h.*, r.q, count(*) OVER (PARTITION BY h.cadence, h.method) AS n,
         row_number() OVER (PARTITION BY h.cadence, h.method ORDER BY h.score DESC) AS rn
  FROM held h JOIN (SELECT method, CAST(round(far_quantile * 1000) AS BIGINT) AS q FROM selection_rules) r USING (method)),
cut AS (
  SELECT cadence, method, max(n) AS n_usable, max(((1000 - q) * n + 999) // 1000) AS target,
         max(CASE WHEN rn = ((1000 - q) * n + 999) // 1000 THEN score END) AS cutoff FROM ranked GROUP BY ALL)
"""


def _top_clusters(spark: SparkSession, folder: str) -> DataFrame:
    return topn.top_n(table(spark, folder, "method_clusters"), ["cadence", "method"], "f_start_peak", "peak_score", 5)


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return _top_clusters(spark, folder).select("cadence", "method", "f_start_peak")


def p2_ranked(spark: SparkSession, folder: str) -> DataFrame:
    """The listed clusters with score and rank; a window sees the at most five rows of a group."""
    order = W.partitionBy("cadence", "method").orderBy(F.desc("peak_score"), "f_start_peak")
    return _top_clusters(spark, folder).withColumn("rank", F.row_number().over(order).cast("long"))


_P2 = """
WITH best AS (SELECT cadence, method, f_start_peak, max(peak_score) AS peak_score FROM method_clusters
              WHERE NOT isnan(peak_score) GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY cadence, method ORDER BY peak_score DESC, f_start_peak) AS rank FROM best)
"""


def _groups(spark: SparkSession, folder: str) -> DataFrame:
    sequences = table(spark, folder, "sequences")
    return splits.grouped(sequences.select("sequence_id", "product", "night", "split"), splits.sequence_edges(sequences), "sequence_id")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    groups = materialize(_groups(spark, folder), "groups")
    recorded = splits.recorded_splits(groups, table(spark, folder, "nights"))
    torn = recorded.groupBy("group").agg(F.count("*").alias("n")).where("n > 1").select("group")
    return groups.join(torn, "group").select(F.col("group").alias("group_id"), "sequence_id")


#: Target shares of the splits.
SHARES = {"train": 0.70, "devcal": 0.15, "final": 0.15}


def p4_splits(spark: SparkSession, folder: str) -> DataFrame:
    """A split for every sequence, whole groups together, products spread alike."""
    groups = materialize(_groups(spark, folder), "groups")
    return splits.split_groups(groups, "group", F.lower(trimmed(F.col("product"))), SHARES).select(F.col("group").alias("group_id"), "sequence_id", "product", F.col("assigned").alias("split"))


def p4_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Rows and shares of each split, over all products and in each."""
    rows = p4_splits(spark, folder).groupBy("split", "product").agg(F.count("*").alias("n"))
    return rows.select("split", "product", "n", (F.col("n") / F.sum("n").over(W.partitionBy("product"))).alias("share"))


_P4 = """
WITH RECURSIVE seq AS (
  SELECT sequence_id AS id, split, files,
         nullif(regexp_extract(upper(regexp_replace(night, '[\\s-]', '', 'g')), '^S0*([0-9]+)$', 1), '') AS night FROM sequences),
edges AS (
  SELECT id, 'n' || night AS e FROM seq WHERE night IS NOT NULL
  UNION SELECT id, 'f' || regexp_replace(f, '.*/', '') FROM (SELECT id, unnest(files) AS f FROM seq)),
ties AS (SELECT DISTINCT a.id AS a, b.id AS b FROM edges a JOIN edges b USING (e) WHERE a.id <> b.id),
reach AS (SELECT id AS a, id AS b FROM seq UNION SELECT r.a, t.b FROM reach r JOIN ties t ON r.b = t.a),
grp AS (SELECT a AS id, min(b) AS g FROM reach GROUP BY a),
said AS (
  SELECT g, s FROM (
    SELECT g, nullif(lower(regexp_replace(split, '[^A-Za-z]', '', 'g')), '') AS s FROM seq JOIN grp USING (id)
    UNION SELECT g, nullif(lower(regexp_replace(n.split, '[^A-Za-z]', '', 'g')), '') FROM seq JOIN grp USING (id) JOIN nights n
      ON seq.night = nullif(regexp_extract(upper(regexp_replace(n.name, '[\\s-]', '', 'g')), '^S0*([0-9]+)$', 1), ''))
  WHERE s IS NOT NULL)
SELECT g AS group_id, id AS sequence_id FROM grp WHERE g IN (SELECT g FROM said GROUP BY g HAVING count(DISTINCT s) > 1)
"""

#: Seconds within which a start and an observation can be the same.
TOLERANCE = 180.0


def p5_matches(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "association_rows").select("row_id", "file", "node", "tstart_mjd")
    node = node_key(F.coalesce(trimmed(F.col("node")), F.substring_index(base_name(F.col("file")), "_", 1)))
    starts = rows.select(F.col("row_id").alias("id"), node.alias("entity"), (nearest.mjd(F.col("tstart_mjd")) * 86400).alias("at"))
    seen = observations(table(spark, folder, "scan_headers")).where("product = '0000'")
    files = seen.groupBy("base").agg(F.min("header_id").alias("ref"), F.min_by("node", "header_id").alias("entity"), F.min_by("time", "header_id").alias("time"))
    return nearest.match_nearest(starts, files.select("entity", "time", "ref"), TOLERANCE)


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return p5_matches(spark, folder).select(F.col("id").alias("row_id"), F.col("ref").alias("header_id"))


_P5 = """
WITH obs AS (
  SELECT *, regexp_replace(file, '.*/', '') AS base FROM scan_headers WHERE parse_error IS NULL),
files AS (
  SELECT base, min(header_id) AS header_id, arg_min(lower(trim(coalesce(nullif(trim(node), ''), split_part(base, '_', 1)))), header_id) AS node,
         arg_min(coalesce(abs_time_s, mjd_day::BIGINT * 86400 + mjd_sec,
           split_part(base, '_', 3)::BIGINT * 86400 + split_part(base, '_', 4)::BIGINT), header_id) AS t
  FROM obs WHERE product = '0000' GROUP BY base),
num AS (
  SELECT row_id, lower(trim(coalesce(nullif(trim(node), ''), split_part(file, '_', 1)))) AS node,
         try_cast(replace(regexp_extract(trim(tstart_mjd, ' 	'), '^[+-]?([0-9]+[.,]?[0-9]*([eE][+-]?[0-9]+)?)$', 1), ',', '.') AS DOUBLE) AS v
  FROM association_rows),
starts AS (SELECT row_id, node, (CASE WHEN v > 2000000 THEN v - 2400000.5 ELSE v END) * 86400 AS s FROM num WHERE isfinite(v)),
near AS (
  SELECT row_id, header_id, row_number() OVER (PARTITION BY row_id ORDER BY abs(s - t), t) AS rn
  FROM starts JOIN files USING (node) WHERE abs(s - t) <= 180)
SELECT row_id, header_id FROM near WHERE rn = 1
"""


def p6_ids(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.encode(table(spark, folder, "documents"), "doc_id", "text")


def _mix(spark: SparkSession, folder: str) -> mixing.Mix:
    documents = table(spark, folder, "documents").select("doc_id", "source", "text")
    # The encoder is given key and source together, so that nothing is joined afterwards.
    keyed = documents.select(F.struct("doc_id", "source").alias("key"), "text")
    sized = tokens.encode(keyed, "key", "text").select(F.col("key.doc_id").alias("key"), F.col("key.source").alias("source"), F.size("ids").alias("size"))
    return mixing.mix(materialize(sized, "sized"), table(spark, folder, "source_weights"))


def p7_mix(spark: SparkSession, folder: str) -> DataFrame:
    """The documents used, with their tokens and how often each is used."""
    return _mix(spark, folder).copies.select(F.col("key").alias("doc_id"), "source", F.col("size").alias("n_tokens"), "copies")


def p7_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Target and reached shares, caps and totals of the sources."""
    return _mix(spark, folder).report


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return pii.find_items(table(spark, folder, "documents"), "doc_id", "text").select("doc_id", "kind", "start_pos")


def p8_redacted(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's text with placeholders."""
    return pii.redacted(table(spark, folder, "documents"), "doc_id", "text")


SQL: dict[str, str] = {
    "p1_found": _P1 + "SELECT cadence, method, f_start FROM ranked JOIN cut USING (cadence, method) WHERE score >= cutoff",
    "p1_cutoffs": _P1
    + """, groups AS (SELECT cadence, method, n_usable, target, cutoff, count(*) AS kept FROM ranked JOIN cut USING (cadence, method)
           WHERE score >= cutoff GROUP BY ALL)
         SELECT g.*, m.far_thresh, m.n_stage1 FROM groups g LEFT JOIN method_results m USING (cadence, method)""",
    "p2_found": _P2 + "SELECT cadence, method, f_start_peak FROM ranked WHERE rank <= 5",
    "p2_ranked": _P2 + "SELECT cadence, method, f_start_peak, peak_score, rank FROM ranked WHERE rank <= 5",
    "p4_found": _P4,
    "p5_found": _P5,
}

QUERIES: dict[str, Query] = {
    "p1_found": p1_found,
    "p1_cutoffs": p1_cutoffs,
    "p2_found": p2_found,
    "p2_ranked": p2_ranked,
    "p4_found": p4_found,
    "p4_splits": p4_splits,
    "p4_shares": p4_shares,
    "p5_found": p5_found,
    "p6_ids": p6_ids,
    "p7_mix": p7_mix,
    "p7_shares": p7_shares,
    "p8_found": p8_found,
    "p8_redacted": p8_redacted,
}
