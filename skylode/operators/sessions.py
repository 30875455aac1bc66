"""Sessions: activity of a key cut wherever nothing happens for longer than a gap; an incremental session table.

Merging works on intervals, so that events (intervals of no length), local sessions of a batch and stored sessions go
through the same plan. A key's intervals are cut into time buckets: windows see one bucket of a key, which holds at most
one row per second, and the buckets of a key are linked by windows over one row per bucket. A key that holds a third of
all rows is spread over its buckets.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from skylode.session import Scratch, drop_path, scratch_path

BUCKET = 21_600
PERIOD = 30 * 86_400


def merge_intervals(intervals: DataFrame, gap: int, bucket: int = BUCKET) -> DataFrame:
    """key, start, end, n: the intervals of each key merged wherever at most `gap` lies between them, n summed.

    intervals: key, start, end, n (long, end >= start). Rows with a null key or start are left out; a null end is the
    start. Equal intervals add up. Empty input gives no row.
    """
    inside = W.partitionBy("key", "b").orderBy("start")
    reach = F.max("end").over(inside.rowsBetween(W.unboundedPreceding, -1))
    opens = F.when(reach.isNull() | (F.col("start") > reach + gap), F.col("start"))
    local = (
        intervals.where(F.col("key").isNotNull() & F.col("start").isNotNull())
        .select("key", "start", F.coalesce("end", "start").alias("end"), "n", F.floor(F.col("start") / bucket).alias("b"))
        .repartition("key", "b")
        .withColumn("opens", opens)
        .withColumn("first", F.max("opens").over(inside.rowsBetween(W.unboundedPreceding, 0)))
        .groupBy("key", "b", "first").agg(F.max("end").alias("end"), F.sum("n").alias("n"))
    )
    # One row a bucket: how far earlier buckets reach, and the last interval of the bucket unless they reach it.
    earlier = W.partitionBy("key").orderBy("b").rowsBetween(W.unboundedPreceding, -1)
    links = local.groupBy("key", "b").agg(F.max("end").alias("m"), F.max("first").alias("last")).withColumn("carried", F.max("m").over(earlier))
    links = links.withColumn("opened", F.when(F.col("carried").isNull() | (F.col("last") > F.col("carried") + gap), F.col("last")))
    links = links.select("key", "b", "carried", F.max("opened").over(earlier).alias("open"))
    start = F.when(F.col("first") <= F.col("carried") + gap, F.col("open")).otherwise(F.col("first"))
    return local.join(links, ["key", "b"]).groupBy("key", start.alias("start")).agg(F.max("end").alias("end"), F.sum("n").alias("n"))


class SessionTable:
    """A table of sessions in a folder, kept up to date batch by batch.

    Sessions lie in folders by the period of their start. A merge compares the batch's sessions with the stored ones of
    the periods within the gap, writes these periods anew, and publishes a new manifest under the next number, which the
    file system lets only one writer create: readers see the table before or after, never between. Every folder written
    has a name of its own and counts only once a manifest names it, so that a merge that died, at whatever step, is
    simply run again; `vacuum` deletes what it left. Events are known by key, time and id; one that was merged before
    counts once, in whichever batch it comes again.
    """

    def __init__(self, spark: SparkSession, path: str, gap: int, period: int = PERIOD):
        self.spark, self.path, self.gap, self.period = spark, path.rstrip("/"), gap, period

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(self.path)
        return jvm, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def manifest(self) -> dict:
        """The newest one: its version, and by period the folder of its sessions, their last end, and folders of events."""
        jvm, fs = self._fs()
        found = fs.globStatus(jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifest-*.json")) or []
        names = sorted(x.getPath().toString() for x in found)
        if not names:
            return {"version": 0, "gap": self.gap, "sessions": {}, "ends": {}, "events": {}}
        stream = fs.open(jvm.org.apache.hadoop.fs.Path(names[-1]))
        state = json.loads(bytes(stream.readAllBytes()))
        stream.close()
        if state["gap"] != self.gap:
            raise ValueError(f"the table at {self.path} has gap {state['gap']}, not {self.gap}")
        return state

    def _publish(self, state: dict) -> None:
        jvm, fs = self._fs()
        stream = fs.create(jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifest-{state['version']:08d}.json"), False)
        stream.write(json.dumps(state).encode())
        stream.close()

    def _period(self, time: Column) -> Column:
        return F.floor(time / self.period)

    def read(self, state: dict | None = None, periods: list[str] | None = None) -> DataFrame:
        """key, start, end, n of the sessions; of some periods only, if given."""
        state = state or self.manifest()
        paths = [f"{self.path}/{v}" for k, v in sorted(state["sessions"].items()) if periods is None or k in periods]
        return self._load(paths, "key string, start long, end long, n long")

    def _load(self, paths: list[str], schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _write(self, df: DataFrame, time: str, name: str) -> dict[str, str]:
        """Write df by period into a new folder; the folder of each period. Rows are shuffled by period, and adaptive
        execution splits large periods and joins small ones by their size."""
        folder = f"{name}-{uuid.uuid4().hex}"
        df.withColumn("period", self._period(F.col(time))).hint("rebalance", "period").write.partitionBy("period").parquet(f"{self.path}/{folder}")
        jvm, fs = self._fs()
        found = fs.globStatus(jvm.org.apache.hadoop.fs.Path(f"{self.path}/{folder}/period=*")) or []
        return {(x := s.getPath().getName()).split("=")[1]: f"{folder}/{x}" for s in found}

    def merge(self, events: DataFrame) -> int:
        """Merge a batch of key (string), time (long), id (string) and return the table's new version.

        Rows with a null key or time are left out; a null id is an event of its own kind at its time.
        """
        state = self.manifest()
        version = state["version"] + 1
        schema = "key string, time long, id string"
        batch = events.select(F.col("key").cast("string").alias("key"), F.col("time").cast("long").alias("time"), F.col("id").cast("string").alias("id"))
        new_events = self._write(batch.where("key is not null and time is not null").distinct(), "time", f"events-{version:08d}")
        batch = self._load([f"{self.path}/{p}" for p in new_events.values()], schema)
        seen = [f"{self.path}/{p}" for k in sorted(new_events) for p in state["events"].get(k, [])]
        if seen:
            same = F.expr("b.key = k.key and b.time = k.time and b.id <=> k.id")
            batch = batch.alias("b").join(self._load(seen, schema).alias("k"), same, "left_anti")
        scratch = Scratch(self.spark)
        local = merge_intervals(batch.select("key", F.col("time").alias("start"), F.col("time").alias("end"), F.lit(1).cast("long").alias("n")), self.gap)
        local = scratch.write(local, "local-sessions")
        near = [p for p in state["sessions"] if any(self._within(int(p), state["ends"][p], int(q)) for q in new_events)]
        # Sessions of a batch lie more than a gap apart: without stored ones in reach they stand as they are.
        merged = merge_intervals(local.unionByName(self.read(state, near)), self.gap) if near else local
        new = self._write(merged, "start", f"sessions-{version:08d}")
        scratch.keep()
        written = self._load([f"{self.path}/{p}" for p in new.values()], "key string, start long, end long, n long")
        ends = {str(r[0]): r[1] for r in written.groupBy(self._period(F.col("start"))).agg(F.max("end")).collect()} if new else {}
        kept = [p for p in state["sessions"] if p not in near]
        self._publish({
            "version": version,
            "gap": self.gap,
            "sessions": {p: state["sessions"][p] for p in kept} | new,
            "ends": {p: state["ends"][p] for p in kept} | ends,
            "events": state["events"] | {p: [*state["events"].get(p, []), f] for p, f in new_events.items()},
        })
        return version

    def vacuum(self) -> int:
        """Delete the folders that the newest manifest doesn't name, and return how many: those of merges that died and
        those of older versions. Call it while nobody merges or reads an older version."""
        state = self.manifest()
        named = {f.split("/")[0] for f in [*state["sessions"].values(), *(f for fs in state["events"].values() for f in fs)]}
        jvm, fs = self._fs()
        found = fs.globStatus(jvm.org.apache.hadoop.fs.Path(f"{self.path}/*-*-*")) or []
        dead = [s.getPath() for s in found if s.isDirectory() and s.getPath().getName() not in named]
        for p in dead:
            fs.delete(p, True)
        return len(dead)

    def _within(self, stored: int, end: int, batch: int) -> bool:
        """Whether sessions of a stored period, the last of which ends at `end`, can touch events of a batch's period."""
        return stored * self.period <= (batch + 1) * self.period + self.gap and end >= batch * self.period - self.gap


def sessions_by_batches(events: DataFrame, arrival: str, gap: int, batches: int = 4, path: str | None = None) -> SessionTable:
    """Build a session table from events (key, time, id) in the order of their arrival, in equal spans of it.

    Events without an arrival come with the first batch.
    """
    spark = events.sparkSession
    out = SessionTable(spark, path or scratch_path(spark, "sessions"), gap)
    at = F.unix_micros(F.col(arrival).cast("timestamp"))
    lo, hi = events.agg(F.min(at), F.max(at)).first()
    step = ((hi or 0) - (lo or 0)) // batches + 1
    part = F.coalesce(F.floor((at - (lo or 0)) / step), F.lit(0)).cast("int")
    # Cut once, when they are written: each batch reads its own folder.
    folder = scratch_path(spark, "session-events")
    events.select("key", "time", "id", part.alias("batch")).write.partitionBy("batch").parquet(folder)
    cut = spark.read.schema(events.select("key", "time", "id", part.alias("batch")).schema).parquet(folder)
    for k in range(batches):
        out.merge(cut.where(F.col("batch") == k).drop("batch"))
    drop_path(spark, folder)
    return out
