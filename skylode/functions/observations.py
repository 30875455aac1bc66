"""Reading a row of the file catalogue: names, nodes, targets and times."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: {node}_guppi_{mjd_day}_{mjd_sec}_{TARGET...}_{scan}.rawspec.{product}.h5
NAME = r"^([^_]+)_guppi_(\d{1,9})_(\d{1,9})_(.+)_([^_]+)\.rawspec\.([^.]+)\.h5$"
BLANKS = " \t\r\n\u00a0\u3000"
#: A sign, digits with a decimal point or comma, an exponent.
NUMBER = r"^[+-]?((?:\d+(?:[.,]\d*)?|[.,]\d+)(?:[eE][+-]?\d+)?)$"
#: A value above JULIAN is a Julian date, MJD + JD_OFFSET.
JULIAN, JD_OFFSET = 2_000_000.0, 2_400_000.5


def base_name(path: Column) -> Column:
    """The part after the last slash; null where that is empty."""
    return F.nullif(F.substring_index(path, "/", -1), F.lit(""))


def trimmed(text: Column) -> Column:
    """Without outer blanks; null where nothing is left."""
    return F.nullif(F.btrim(text, F.lit(BLANKS)), F.lit(""))


def finite(value: Column) -> Column:
    """value, or null where it is NaN or infinite."""
    return F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value)


def mjd(text: Column) -> Column:
    """The Modified Julian Date of a text written by any tool; null where it isn't a finite number."""
    value = finite(F.replace(F.regexp_extract(F.btrim(text, F.lit(BLANKS)), NUMBER, 1), F.lit(","), F.lit(".")).try_cast("double"))
    return F.when(value > JULIAN, value - JD_OFFSET).otherwise(value)


def name_part(base: Column, part: int) -> Column:
    """A part of a file name: 1 node, 2 day, 3 second, 4 target, 5 scan, 6 product; null where the name isn't one."""
    return F.nullif(F.regexp_extract(base, NAME, part), F.lit(""))


def node_key(node: Column) -> Column:
    return F.lower(trimmed(node))


def target_key(target: Column) -> Column:
    """Upper-case letters and digits only; null where there are none."""
    return F.nullif(F.upper(F.regexp_replace(target, r"[^\p{L}\p{Nd}]", "")), F.lit(""))


def observations(headers: DataFrame) -> DataFrame:
    """header_id, base, product, node, target, time (long seconds), ingest_ts of the rows that are observations.

    Rows with a parse_error are none. What is missing in a column is read from the file name. A row without a file name
    is a file of its own, named by its header_id.
    """
    base = base_name(F.col("file"))
    return (
        headers.where(F.col("parse_error").isNull())
        .select("header_id", base.alias("base"), "product", "node", "target", "mjd_day", "mjd_sec", "abs_time_s", "ingest_ts")
        .select(
            "header_id",
            F.coalesce("base", F.concat(F.lit("#"), F.col("header_id").cast("string"))).alias("base"),
            F.coalesce(trimmed(F.col("product")), name_part(F.col("base"), 6)).alias("product"),
            node_key(F.coalesce(trimmed(F.col("node")), F.substring_index("base", "_", 1))).alias("node"),
            F.coalesce(target_key(F.col("target")), target_key(name_part(F.col("base"), 4))).alias("target"),
            F.coalesce(
                F.col("abs_time_s").cast("long"),
                F.col("mjd_day").cast("long") * 86400 + F.col("mjd_sec"),
                name_part(F.col("base"), 2).cast("long") * 86400 + name_part(F.col("base"), 3).cast("long"),
            ).alias("time"),
            "ingest_ts",
        )
    )
