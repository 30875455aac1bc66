"""Hot keys: find them by a bound that holds for any data, and spread them over salts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

#: A key is hot above this fraction of all rows, so there are fewer than 1 / HOT of them whatever the data.
HOT = 1 / 1000
#: Groups of no more rows than this are never worth a salt.
LEAST = 1000


def hot_keys(rows: DataFrame, keys: list[str], total: int | None = None) -> DataFrame | None:
    """keys and `salts` of the keys that hold more than HOT of all rows; a salt of one holds about HOT of all rows.

    Fewer than 1 / HOT rows by construction, and fewer than 2 / HOT salts in all: safe to gather and to broadcast at any
    scale. The counts themselves stay distributed. None where no key is hot.
    """
    total = rows.count() if total is None else total
    if total <= LEAST:
        return None
    share = max(1, int(total * HOT))
    counts = rows.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > max(share, LEAST))
    hot = counts.select(*keys, F.ceil(F.col("n") / share).cast("int").alias("salts")).collect()
    schema = StructType([*(rows.schema[k] for k in keys), StructField("salts", IntegerType())])
    return rows.sparkSession.createDataFrame(hot, schema) if hot else None


def _with_salts(rows: DataFrame, hot: DataFrame, keys: list[str]) -> DataFrame:
    salts = F.broadcast(hot.select(*[F.col(k).alias(f"_hot_{k}") for k in keys], F.col("salts").alias("_salts")))
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_hot_{k}"))
    return rows.join(salts, cond, "left").drop(*[f"_hot_{k}" for k in keys])


def salted(rows: DataFrame, hot: DataFrame | None, keys: list[str], *by: Column) -> DataFrame:
    """rows with `salt`: 0 for a key that isn't hot, else one of its salts, chosen by the hash of `by`."""
    if hot is None:
        return rows.withColumn("salt", F.lit(0))
    # Never null by its type: a join on it adds no filter below the exchange, and plans that read the rows twice share it.
    salt = F.coalesce(F.pmod(F.xxhash64(*by), F.col("_salts")), F.lit(0)).cast("int")
    return _with_salts(rows, hot, keys).withColumn("salt", salt).drop("_salts")


def over_salts(state: DataFrame, hot: DataFrame | None, keys: list[str]) -> DataFrame:
    """One row of state for each salt of its key: at most 2 / HOT rows more than state has."""
    if hot is None:
        return state.withColumn("salt", F.lit(0))
    every = F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1)
    return _with_salts(state, hot, keys).withColumn("salt", F.explode(every)).drop("_salts")
