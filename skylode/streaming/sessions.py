"""Structured Streaming counterparts: sessions by gap, windows, and the session table fed by micro-batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from skylode.operators.sessions import SessionTable


def session_stream(events: DataFrame, key: str, time: str, gap: str, late: str) -> DataFrame:
    """key, start_ts, end_ts, n of each session, emitted once the watermark has passed its end.

    Events exactly a gap apart lie in two sessions here, since a session window is half-open; the session table joins them.
    """
    windows = events.withWatermark(time, late).groupBy(F.col(key), F.session_window(time, gap).alias("s"))
    return windows.agg(F.count("*").alias("n"), F.min(time).alias("start_ts"), F.max(time).alias("end_ts")).select(key, "start_ts", "end_ts", "n")


def sliding_stream(events: DataFrame, key: str, time: str, length: str, slide: str, late: str, value: Column) -> DataFrame:
    """Count and mean over sliding windows of event time."""
    by = events.withWatermark(time, late).groupBy(F.col(key), F.window(time, length, slide).alias("w"))
    return by.agg(F.count("*").alias("n"), F.avg(value).alias("mean")).select(key, F.col("w.start").alias("start_ts"), "n", "mean")


def feed(events: DataFrame, table: SessionTable, checkpoint: str) -> StreamingQuery:
    """Merge each micro-batch of key, time, id into a session table. A batch that is run again changes nothing, since its
    events are known by key, time and id."""
    return events.writeStream.foreachBatch(lambda batch, _: table.merge(batch)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
