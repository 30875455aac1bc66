"""Sinks: write-once tables, resumable and append-only outputs, provenance."""

from __future__ import annotations

import hashlib
import json
import platform
import subprocess
import sys

from pyspark.sql import DataFrame, SparkSession

from skylode.session import drop_path


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p, jvm


def exists(spark: SparkSession, path: str) -> bool:
    fs, p, _ = _fs(spark, path)
    return fs.exists(p)


def write_once(df: DataFrame, path: str, fmt: str = "parquet", by: list[str] | None = None) -> None:
    """Write to a path that must not exist yet."""
    writer = df.write.mode("errorifexists").format(fmt)
    (writer.partitionBy(*by) if by else writer).save(path)


def publish(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    """Write beside the path and rename when complete; readers never see a part. The path must not exist."""
    spark = df.sparkSession
    if exists(spark, path):
        raise FileExistsError(path)
    partial = f"{path.rstrip('/')}.partial"
    drop_path(spark, partial)
    writer = df.write.mode("errorifexists")
    (writer.partitionBy(*by) if by else writer).parquet(partial)
    fs, p, jvm = _fs(spark, path)
    if not fs.rename(jvm.org.apache.hadoop.fs.Path(partial), p):
        raise OSError(f"could not rename {partial} to {path}")


def write_text(spark: SparkSession, path: str, text: str, overwrite: bool = False) -> None:
    fs, p, _ = _fs(spark, path)
    stream = fs.create(p, overwrite)
    stream.write(text.encode())
    stream.close()


def read_text(spark: SparkSession, path: str) -> str:
    fs, p, _ = _fs(spark, path)
    stream = fs.open(p)
    out = bytes(stream.readAllBytes()).decode()
    stream.close()
    return out


def guard_identity(spark: SparkSession, folder: str, identity: dict) -> None:
    """Bind a run's folder to its inputs: the first call records the identity, later ones must bring the same."""
    path, text = f"{folder.rstrip('/')}/identity.json", json.dumps(identity, sort_keys=True)
    if not exists(spark, path):
        write_text(spark, path, text)
    elif read_text(spark, path) != text:
        raise ValueError(f"{folder} belongs to another run")


def missing_keys(todo: DataFrame, path: str, keys: list[str]) -> DataFrame:
    """The rows of todo whose keys the table at path doesn't hold yet; all of them if it doesn't exist."""
    spark = todo.sparkSession
    if not exists(spark, path):
        return todo
    return todo.join(spark.read.parquet(path).select(*keys).distinct(), keys, "left_anti")


def append_new(df: DataFrame, path: str, key: str) -> None:
    """Append rows whose key isn't there yet; a repeated key within df is written once."""
    missing_keys(df.dropDuplicates([key]), path, [key]).write.mode("append").parquet(path)


def replace_partitions(df: DataFrame, path: str, by: list[str]) -> None:
    """Replace the partitions that df holds and leave the others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def by_cadence(df: DataFrame, path: str, order: str = "f_start") -> None:
    """Part a score table by cadence, each in order; a cadence of many rows is spread over several files."""
    df.repartitionByRange("cadence", order).sortWithinPartitions("cadence", order).write.mode("errorifexists").partitionBy("cadence").parquet(path)


def provenance(spark: SparkSession, inputs: dict[str, str]) -> str:
    """JSON of code version, environment, command line and the inputs' identities."""
    try:
        commit = subprocess.run(["git", "rev-parse", "HEAD"], capture_output=True, text=True, timeout=10).stdout.strip() or None
    except OSError:
        commit = None
    return json.dumps({"commit": commit, "python": platform.python_version(), "spark": spark.version, "argv": sys.argv, "inputs": {k: hashlib.sha256(v.encode()).hexdigest() for k, v in inputs.items()}}, sort_keys=True)
