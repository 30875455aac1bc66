"""Audits of stored tables: structure, content against the source, recorded hashes."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skylode.session import write_file
from skylode.sources.sinks import exists, read_text


def drawn(seed: str, key: Column, share: float) -> Column:
    """Whether a key belongs to a seeded sample of about the share given; the same keys on every run and partitioning."""
    head = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}|"), key.cast("string")), 256), 1, 8), 16, 10).cast("long")
    return head < F.lit(int(share * (1 << 32)))


def structure(df: DataFrame, expected: dict[str, str], keys: list[str], rows: int | None = None) -> DataFrame:
    """check and n: what is wrong with a table, one row a check, 0 where it is as expected.

    Columns missing or of another type, columns not expected, null and repeated keys, rows more or less than recorded.
    """
    types = dict(df.dtypes)
    spark = df.sparkSession
    columns = [("columns", sum(types.get(c) != t for c, t in expected.items())), ("extra columns", len(set(types) - set(expected)))]
    fixed = spark.createDataFrame(columns, "check string, n long")
    known = [k for k in keys if k in types]
    null = F.count_if(F.array_contains(F.array(*[F.col(k).isNull() for k in known]), True))
    counts = df.agg(null.alias("null keys"), F.abs(F.count("*") - F.lit(rows) if rows is not None else F.lit(0)).alias("rows"))
    repeats = df.groupBy(*known).agg(F.count("*").alias("c")).agg(F.coalesce(F.sum(F.col("c") - 1), F.lit(0)).alias("repeated keys"))
    out = fixed
    for frame in (counts, repeats):
        out = out.unionByName(frame.select(F.explode(F.create_map(*[x for c in frame.columns for x in (F.lit(c), F.col(c).cast("long"))])).alias("check", "n")))
    return out


def mismatches(copy: DataFrame, source: DataFrame, keys: list[str], seed: str = "audit", share: float = 1.0) -> DataFrame:
    """keys, reason of the sampled keys whose rows differ: "missing" in the copy, "unknown" to the source, or "changed".

    Values are compared exactly, null equal to null and NaN to NaN, over the columns that both have; keys are unique.
    """
    rest = [c for c in source.columns if c in copy.columns and c not in keys]
    pick = drawn(seed, F.concat_ws("|", *[F.col(k).cast("string") for k in keys]), share)
    a = source.where(pick).select(*keys, F.struct(*rest).alias("_a"))
    b = copy.where(pick).select(*keys, F.struct(*rest).alias("_b"))
    both = a.join(b, keys, "full")
    reason = F.when(F.col("_b").isNull(), "missing").when(F.col("_a").isNull(), "unknown").when(~F.col("_a").eqNullSafe(F.col("_b")), "changed")
    return both.select(*keys, reason.alias("reason")).where("reason IS NOT NULL")


def publish_checked(df: DataFrame, path: str) -> str:
    """Write df, a summary and the checksum of each file beside it; the path must not exist. Returns the catalogue's hash.

    Checksums are taken by tasks, of one file each; the catalogue holds one line a file.
    """
    spark = df.sparkSession
    if exists(spark, path):
        raise FileExistsError(path)
    df.write.mode("errorifexists").parquet(f"{path}/data")
    sums = {r["name"]: r["sum"] for r in checksums(spark, path).collect()}
    rows = spark.read.parquet(f"{path}/data").count()
    text = json.dumps({"rows": rows, "schema": df.schema.jsonValue(), "sha256": sums}, sort_keys=True)
    digest = hashlib.sha256(text.encode()).hexdigest()
    write_file(spark, f"{path}/catalogue.json", text.encode())
    write_file(spark, f"{path}/SHA256SUMS", "".join(f"{s}  data/{n}\n" for n, s in sorted(sums.items())).encode())
    write_file(spark, f"{path}/DONE", digest.encode())
    return digest


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """name and sum of each data file."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(f"{path}/data")
    return files.select(F.substring_index("path", "/", -1).alias("name"), F.sha2("content", 256).alias("sum"))


def read_checked(spark: SparkSession, path: str, digest: str | None = None) -> DataFrame:
    """The table at path, if it is complete and its files and catalogue are those that were written; else an error."""
    if not exists(spark, f"{path}/DONE"):
        raise ValueError(f"{path} isn't complete")
    text = read_text(spark, f"{path}/catalogue.json")
    found = hashlib.sha256(text.encode()).hexdigest()
    if found != read_text(spark, f"{path}/DONE") or digest not in (None, found):
        raise ValueError(f"the catalogue at {path} isn't the one recorded")
    recorded = json.loads(text)["sha256"]
    if recorded != {r["name"]: r["sum"] for r in checksums(spark, path).collect()}:
        raise ValueError(f"files at {path} differ from their checksums")
    return spark.read.parquet(f"{path}/data")
