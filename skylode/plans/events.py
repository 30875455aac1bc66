"""Queries that run as streams or train models: a weaker check holds for them where SQL can't say the same."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skylode.operators import models
from skylode.session import scratch_path
from skylode.sources.tables import table
from skylode.streaming import sessions


def _stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    schema = table(spark, folder, name).schema
    return spark.readStream.schema(schema).parquet(f"{folder}/{name}[.]parquet")  # a pattern that only this table's name matches


def _run(stream: DataFrame) -> DataFrame:
    """Drive a bounded stream to its end and read what it appended."""
    spark = stream.sparkSession
    out = scratch_path(spark, f"stream-{uuid.uuid4().hex}")
    query = stream.writeStream.format("parquet").option("path", f"{out}/data").option("checkpointLocation", f"{out}/state").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{out}/data")


def stream_sessions(spark: SparkSession, folder: str) -> DataFrame:
    """Sessions of each user's events with gaps of ten minutes, those that the watermark has closed."""
    events = _stream(spark, folder, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return _run(sessions.session_stream(events, "user_id", "ts", "10 minutes", "1 hour"))


def stream_windows(spark: SparkSession, folder: str) -> DataFrame:
    """Sliding hours of each event type, every half hour, those that the watermark has closed."""
    events = _stream(spark, folder, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return _run(sessions.sliding_stream(events, "event_type", "ts", "1 hour", "30 minutes", "1 hour", F.col("value")))


def batch_sessions(spark: SparkSession, folder: str) -> DataFrame:
    """The same sessions over the finished table, all of them closed."""
    events = table(spark, folder, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    s = events.groupBy("user_id", F.session_window("ts", "10 minutes").alias("s")).agg(F.count("*").alias("n"), F.min("ts").alias("a"), F.max("ts").alias("z"))
    return s.select("user_id", F.unix_micros("a").alias("start_us"), F.unix_micros("z").alias("end_us"), "n")


def event_meta(spark: SparkSession, folder: str) -> DataFrame:
    """Free-form JSON read on demand: the number in each event's props, by type; unreadable ones count apart."""
    k = F.get_json_object("props", "$.k").try_cast("long")
    return table(spark, folder, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count(k).alias("n_k"), F.sum(k).alias("sum_k"), F.max(k).alias("max_k"))


def mahalanobis_distances(spark: SparkSession, folder: str) -> DataFrame:
    v = table(spark, folder, "embeddings").select("vec_id", "embedding")
    return models.mahalanobis(v, "embedding", v).select("vec_id", F.round("distance", 4).alias("distance"))


def ridge_labels(spark: SparkSession, folder: str) -> DataFrame:
    """Ridge regression of the label on the vector: each vector's residual."""
    v = table(spark, folder, "embeddings").where("label IS NOT NULL")
    model = models.ridge(v, "embedding", "label", 0.1)
    w = F.array(*map(F.lit, map(float, model.coefficients)))
    fit = F.aggregate(F.zip_with(F.col("embedding").cast("array<double>"), w, lambda a, b: a * b), F.lit(float(model.intercept)), lambda a, b: a + b)
    return v.select("vec_id", F.round(F.col("label") - fit, 4).alias("residual"))


SQL = {
    "batch_sessions": """WITH o AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 10 MINUTE THEN 0 ELSE 1 END AS o FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
      k AS (SELECT *, sum(o) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM o)
      SELECT user_id, epoch_us(min(ts)) AS start_us, epoch_us(max(ts)) AS end_us, count(*) AS n FROM k GROUP BY user_id, k""",
    "event_meta": """SELECT event_type, count(*) AS n, count(try_cast(json_extract_string(props, '$.k') AS BIGINT)) AS n_k, CAST(sum(try_cast(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS sum_k,
      max(try_cast(json_extract_string(props, '$.k') AS BIGINT)) AS max_k FROM events GROUP BY 1""",
}
QUERIES = {f.__name__: f for f in (stream_sessions, stream_windows, batch_sessions, event_meta, mahalanobis_distances, ridge_labels)}
