"""Sources: file listings, manifests, header tables, score files, block stores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The header table, in the order of its columns.
HEADERS = (
    "header_id long, file string, product string, node string, target string, scan_num string, mjd_day int, mjd_sec int, abs_time_s long, f_start_mhz double, f_stop_mhz double, bw_mhz double, "
    "fch1_mhz double, foff_hz double, nchans long, ntime long, nifs int, tsamp_s double, duration_s double, tstart_mjd double, source_name string, dtype string, chunks string, filter_ids string, "
    "file_size_bytes long, has_mask boolean, parse_error string, header_error string"
)


def list_files(spark: SparkSession, root: str, pattern: str = "*.h5", product: str | None = None) -> DataFrame:
    """path and length of the files below root; contents aren't read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern)
    files = reader.load(root).select("path", "length")
    return files if product is None else files.where(F.col("path").endswith(f".{product}.h5"))


def read_headers(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The good and the bad rows of a header CSV; errors are data there, so rows that don't fit are kept as bad ones."""
    rows = spark.read.schema(f"{HEADERS}, _corrupt string").option("header", "true").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").csv(path)
    bad = F.col("_corrupt").isNotNull() | F.col("parse_error").isNotNull() | F.col("header_error").isNotNull()
    return rows.where(~bad), rows.where(bad)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """manifest_row and paths: one cadence per line, paths parted by blanks, blank lines left out, rows numbered from 0.

    A manifest is one small file, so that its lines come in one partition and in their order.
    """
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.filter(F.split("value", r"\r?\n"), lambda s: F.trim(s) != "")).alias("manifest_row", "line"))
    return lines.select("manifest_row", F.split(F.trim("line"), r"\s+").alias("paths"))


def read_scores(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Some columns of a score file, Parquet or CSV; the others aren't read from Parquet."""
    rows = spark.read.option("header", "true").schema("cadence string, f_start long, method string, score double").csv(path) if path.endswith(".csv") else spark.read.parquet(path)
    return rows.select(*columns)


def read_channels(spark: SparkSession, path: str, start: int, stop: int, block: int) -> DataFrame:
    """The blocks of a store that hold channels of [start, stop): pruned by the partitions and the statistics of the files."""
    return spark.read.parquet(path).where((F.col("chan_start") > start - block) & (F.col("chan_start") < stop))


def bool_of_text(column: str) -> F.Column:
    """True and False as text, without regard to case; null for anything else."""
    low = F.lower(F.trim(F.col(column)))
    return F.when(low == "true", True).when(low == "false", False)
