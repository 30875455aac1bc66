"""Matching by nearest time: x-fast tries of the timestamps of each entity, built and searched where the rows lie.

Timestamps are cut into blocks of 2^H seconds, H the least with 2^H > tolerance, so that a match lies in the block of
the start or in one beside it. A block of an entity is one trie: hash tables that hold, for each level 0..H, every bit
prefix of its timestamps with the first and the last leaf below it. Starts and leaves are shuffled once, by entity and
block, and sorted; tasks stream through them in Arrow batches. For all starts of a batch together, binary search over
the levels finds the longest prefix that is present; the entry there gives predecessor or successor, and the leaf beside
it in the order of time the other. A block that many starts fall into is spread over salts, with its at most 3 · 2^H
leaves in each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, StructField, StructType

from skylode.functions.observations import mjd as mjd  # the rule by which queries read a start
from skylode.operators.skew import hot_keys, over_salts, salted

#: What makes rows those of one trie.
BLOCK = ["entity", "block", "salt"]


class Tries:
    """Tries over leaves in order of group and time, one for each group, of its leaves that are `own`.

    An entry is known by its group and its node, numbered as in a heap: 1 is the root at level `top`, below n lie 2n and
    2n + 1. One hash table holds the entries of all groups and levels.
    """

    def __init__(self, group: np.ndarray, time: np.ndarray, own: np.ndarray, top: int):
        self.top = top
        at = np.flatnonzero(own)
        keys, first, last = [], [], []
        for level in range(top + 1):
            key = self.key(group[at], time[at], np.full(len(at), level))
            opens = np.flatnonzero(np.diff(key, prepend=-1))
            keys.append(key[opens])
            first.append(at[opens])
            last.append(at[np.append(opens[1:], len(key))[: len(opens)] - 1])
        self.table = pd.Index(np.concatenate(keys))
        self.first, self.last = np.concatenate(first), np.concatenate(last)

    def key(self, group: np.ndarray, time: np.ndarray, level: np.ndarray) -> np.ndarray:
        prefix = (time & ((1 << self.top) - 1)) >> level
        return (group << (self.top + 1)) | (np.int64(1) << (self.top - level)) | prefix

    def longest(self, group: np.ndarray, time: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each start the least level at which its prefix is present, top + 1 for none, and the number of the entry."""
        lo, hi = np.zeros(len(time), np.int64), np.full(len(time), self.top + 1)
        entry = np.full(len(time), -1)
        while len(open_ := np.flatnonzero(lo < hi)):
            mid = (lo[open_] + hi[open_]) // 2
            found = self.table.get_indexer(self.key(group[open_], time[open_], mid))
            there = found >= 0
            hi[open_[there]], entry[open_[there]] = mid[there], found[there]
            lo[open_[~there]] = mid[~there] + 1
        return hi, entry


def nearest_leaves(leaves: tuple[np.ndarray, np.ndarray, np.ndarray], starts: tuple[np.ndarray, np.ndarray], top: int) -> tuple[np.ndarray, np.ndarray]:
    """For each start the place of the nearest leaf of its group, the earlier of two equally near, and the distance,
    infinite where there is none; at least one leaf is given.

    leaves: group, time and block of the group, in order of group and time, of each group those in its block and in the
    blocks beside it; starts: group and time.
    """
    group, time, block = leaves
    q_group, at = starts
    q = np.floor(at).astype(np.int64)
    where = time >> top
    tries = Tries(group, time, where == block, top)
    level, entry = tries.longest(q_group, q)
    n = len(time)
    # The first leaf after the start, as a place among all leaves. Without any entry: behind those of the block before.
    after = np.searchsorted(group, q_group, "left") + _earlier(group, where < block, q_group)
    some = entry >= 0
    first, last = tries.first[entry[some]], tries.last[entry[some]]
    # At the entry found, only the child that the start isn't in exists: the start is above all leaves there, or below all.
    above = (level[some] == 0) | ((q[some] >> np.maximum(level[some] - 1, 0)) & 1 == 1)
    after[some] = np.where(above, last + 1, first)

    def distance(place: np.ndarray, sign: int) -> np.ndarray:
        safe = np.clip(place, 0, n - 1)
        return np.where((safe == place) & (group[safe] == q_group), sign * (at - time[safe]), np.inf)

    before, behind = distance(after - 1, 1), distance(after, -1)
    return np.where(before <= behind, after - 1, after), np.minimum(before, behind)


def _earlier(group: np.ndarray, earlier: np.ndarray, q_group: np.ndarray) -> np.ndarray:
    """How many leaves of each start's group lie in the block before."""
    counts = np.bincount(group[earlier], minlength=int(q_group.max(initial=-1)) + 1)
    return counts[q_group]


def match_nearest(starts: DataFrame, leaves: DataFrame, tolerance: float) -> DataFrame:
    """id, ref, distance: for each start the nearest leaf of its entity, if within the tolerance (inclusive).

    starts: id, entity, at (double seconds); leaves: entity, time (long seconds), ref. Every start row counts. Of leaves
    of one entity and time the smallest ref stands for all; of two equally near the earlier is taken. Null entities and
    times match nothing; empty tables give no row.
    """
    top = max(1, int(tolerance).bit_length())
    at = F.col("at")
    q = starts.where(F.col("entity").isNotNull() & at.isNotNull() & ~F.isnan(at) & (F.abs(at) < 9e18)).select("id", "entity", "at")
    q = q.withColumn("block", F.shiftright(F.floor("at"), top))
    hot = hot_keys(q, ["entity", "block"], starts.count())
    q = salted(q, hot, ["entity", "block"], F.col("id"), F.col("at"))
    held = leaves.where("entity is not null and time is not null").select("entity", "time", "ref")
    # A leaf serves the starts of its own block and of the blocks beside it.
    here = F.shiftright("time", top)
    held = over_salts(held.withColumn("block", F.explode(F.array(here - 1, here, here + 1))), hot, ["entity", "block"])
    both = q.select(*BLOCK, "id", "at", F.lit(None).cast(held.schema["time"].dataType).alias("time"), F.lit(None).cast(held.schema["ref"].dataType).alias("ref"))
    both = both.unionByName(held, allowMissingColumns=True).repartition(*BLOCK).sortWithinPartitions(*BLOCK, F.col("at").isNotNull(), "time", F.asc_nulls_last("ref"))
    schema = StructType([StructField("id", q.schema["id"].dataType), StructField("ref", held.schema["ref"].dataType), StructField("distance", DoubleType())])
    arrow = to_arrow_schema(schema)

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried: pa.Table | None = None  # leaves of the block that the last batch ended in
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            if not len(rows):
                continue
            if carried is not None:
                rows = pa.concat_tables([carried, rows])
            opens = np.zeros(len(rows), bool)
            for k in BLOCK:
                opens[1:] |= pc.not_equal(rows[k][1:], rows[k][:-1]).to_numpy()
            group = np.cumsum(opens)
            is_leaf = pc.is_null(rows["at"]).to_numpy()
            leaf = np.flatnonzero(is_leaf)
            time = rows["time"].take(leaf).to_numpy()
            # Repeated times of a group: the first row holds the smallest ref.
            new = (np.diff(group[leaf], prepend=-1) != 0) | (np.diff(time, prepend=0) != 0)
            new[:1] = True
            leaf, time = leaf[new], time[new]
            carried = rows.take(leaf[group[leaf] == group[-1]])
            start = np.flatnonzero(~is_leaf)
            if not len(start) or not len(leaf):
                continue
            block = rows["block"].take(leaf).to_numpy()
            place, distance = nearest_leaves((group[leaf], time, block), (group[start], rows["at"].take(start).to_numpy()), top)
            good = np.flatnonzero(distance <= tolerance)
            found = [rows["id"].take(start[good]), rows["ref"].take(leaf[place[good]]), pa.chunked_array([distance[good]])]
            yield from pa.table(found, names=arrow.names).cast(arrow).to_batches()

    return both.mapInArrow(match, schema)
