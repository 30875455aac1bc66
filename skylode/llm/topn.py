"""The N best items of every group, by secondary sort.

Each input partition is sorted by group, score and item and streamed once, emitting at most N items per group: what a
group of millions of items sends on is N items per input partition. These are hash-partitioned by group, sorted and
streamed again. No group is ever held: the state is the at most N items emitted of the current group.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _codes(column: pa.ChunkedArray) -> np.ndarray:
    """Equal values get equal codes; null gets -1."""
    encoded = pa.chunked_array(column).combine_chunks() if not isinstance(column, pa.ChunkedArray) else column.combine_chunks()
    return pc.dictionary_encode(encoded).indices.fill_null(-1).to_numpy(zero_copy_only=False)


def _emitter(keys: list[str], item: str, n: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For rows sorted by keys, then best first: the rows of the first n distinct items of each group."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        emitted: pa.Table | None = None  # of the group that the last batch ended in
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch])
            old = emitted.num_rows if emitted is not None else 0
            if old:
                rows = pa.concat_tables([emitted, rows])
            size = rows.num_rows
            start = np.zeros(size, bool)
            start[0] = True
            for k in keys:
                code = _codes(rows[k])
                start[1:] |= code[1:] != code[:-1]
            group, items = np.cumsum(start) - 1, _codes(rows[item])
            fresh = np.ones(size, bool)
            fresh[1:] = start[1:] | (items[1:] != items[:-1])
            while True:  # an item met again further down gives its place to the next one
                upto = np.cumsum(fresh)
                before = (upto - fresh)[start]
                best = np.flatnonzero(fresh & (upto - before[group] <= n))
                order = np.lexsort((best, items[best], group[best]))
                ranked = best[order]
                again = ranked[1:][(group[ranked[1:]] == group[ranked[:-1]]) & (items[ranked[1:]] == items[ranked[:-1]])]
                if not len(again):
                    break
                fresh[again] = False
            if len(new := best[best >= old]):
                yield from rows.take(pa.array(new)).to_batches()
            emitted = rows.take(pa.array(best[group[best] == group[-1]]))

    return emit


def top_n(rows: DataFrame, keys: list[str], item: str, score: str, n: int) -> DataFrame:
    """keys, item and score of the n best items of each group: highest score first, then smallest item.

    Rows of one group and item are one item; its best score counts. A null or NaN score is never listed, an infinite one
    is. A null key makes a group of its own; a null item is one item and comes after the others of its score. Further
    columns are ignored. A group of fewer than n items gives all of them, empty input gives no row.
    """
    clean = rows.select(*keys, F.col(item), (F.col(score).cast("double") + F.lit(0.0)).alias(score)).where(F.col(score).isNotNull() & ~F.isnan(score))
    order, emit = [*keys, F.desc(score), F.asc_nulls_last(item)], _emitter(keys, item, n)
    local = clean.sortWithinPartitions(*order).mapInArrow(emit, clean.schema)
    return local.repartition(*keys).sortWithinPartitions(*order).mapInArrow(emit, clean.schema)
