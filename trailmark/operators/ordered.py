"""Ordered work on keys of any size: rows are range-sorted by key and order, and a key may span ranges.

A task walks its range once and keeps what it knows of one key; what crosses a border is a row a
range, put together afterwards. So no key has to fit a task, as with a window over the key.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import shared

#: Rows of a range, about.
RANGE_ROWS = 2_000_000
#: Names of the columns that are added: the range, and the key as text.
RANGE, KEY, KEY_LENGTH = "_range", "_key", "_key_length"


def key_text(by: list[str]) -> Column:
    """A key as text, equal for equal keys and for no others; nulls count as values."""
    return F.to_json(F.struct(*(F.col(c).cast("string").alias(f"k{n}") for n, c in enumerate(by))))


def by_ranges(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """df with its key as text, in ranges sorted by key and order."""
    n = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(df.count() / RANGE_ROWS))
    keyed = df.withColumn(KEY, key_text(by)).withColumn(KEY_LENGTH, F.length(KEY))
    return keyed.repartitionByRange(n, KEY, *order).sortWithinPartitions(KEY, *order)


def key_starts(keys: pa.Array, last: str | None) -> np.ndarray:
    """Whether each row's key differs from the row's before; last: the key before the first row."""
    n = len(keys)
    out = np.ones(n, bool)
    if n:
        out[0] = keys[0].as_py() != last
        out[1:] = pc.not_equal(keys[1:], keys[:-1]).to_numpy(zero_copy_only=False)
    return out


def count_begins(ranged: DataFrame, begins: Callable[[dict[str, np.ndarray], dict[str, np.ndarray]], np.ndarray], reads: list[str], name: str) -> DataFrame:
    """ranged with its range and, for every row, how many rows of its key in its range begin something.

    begins gets the columns that it reads, of the rows and of the rows before them; a key's first row
    in a range is not asked, as the row before it may stand in another range.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, before, count = TaskContext.get().partitionId(), None, None, 0
        for b in batches:
            if not b.num_rows:
                continue
            first = key_starts(b[KEY], last)
            now = {c: b[c].to_numpy(zero_copy_only=False) for c in reads}
            held = before or {c: v[:1] for c, v in now.items()}
            prior = {c: np.append(held[c], v[:-1]) for c, v in now.items()}
            total = np.cumsum(begins(now, prior) & ~first)
            start = np.maximum.accumulate(np.where(first, np.arange(len(first)), -1))
            local = np.where(start < 0, total + count, total - total[np.maximum(start, 0)])
            last, before, count = b[KEY][-1].as_py(), {c: v[-1:] for c, v in now.items()}, int(local[-1])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(b.num_rows, part, np.int32)), pa.array(local.astype(np.int64))], [*b.schema.names, RANGE, name])

    return ranged.mapInArrow(each, T.StructType([*ranged.schema.fields, T.StructField(RANGE, T.IntegerType()), T.StructField(name, T.LongType())]))


def border_runs(placed: DataFrame, order: list[str], *measures: Column) -> DataFrame:
    """(range, key, measures) of the first and the last key of every range: two rows a range at most."""
    at = F.struct(KEY, *order)
    ends = placed.groupBy(RANGE).agg(F.min(at)[KEY].alias("a"), F.max(at)[KEY].alias("b"))
    edge = ends.select(RANGE, F.explode(F.array_distinct(F.array("a", "b"))).alias(KEY))
    return placed.join(F.broadcast(edge), [RANGE, KEY]).groupBy(RANGE, KEY).agg(*measures)


def number(df: DataFrame, by: list[str], order: list[str], name: str) -> DataFrame:
    """df with each row's place among its key's, from 0."""
    placed = shared.written(count_begins(by_ranges(df, by, order), lambda now, before: np.ones(len(now[KEY_LENGTH]), bool), [KEY_LENGTH], "_local"), "numbered")
    edges = border_runs(placed, order, F.max("_local").alias("n"))
    along = Window.partitionBy(KEY).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    offsets = F.broadcast(edges.select(RANGE, KEY, F.sum(F.col("n") + 1).over(along).alias("_offset")))
    out = placed.join(offsets, [RANGE, KEY], "left").withColumn(name, F.coalesce("_offset", F.lit(0)) + F.col("_local"))
    return out.select(*(c for c in df.columns if c != name), name)


def composed(ranged: DataFrame, column: str, table: np.ndarray, kinds: list[str]) -> DataFrame:
    """(range, key, map array<int>): the maps of a key's rows in a range, one after another.

    table has a row for each of the column's kinds and last the identity: where each state leads.
    """
    width = table.shape[1]

    def reduced(maps: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """The composition of each run of maps; neighbours are composed until a run has one."""
        run = np.cumsum(starts) - 1
        while len(maps) > run[-1] + 1:
            first = np.flatnonzero(np.append(True, run[1:] != run[:-1]))
            place = np.arange(len(run)) - first[run]
            left = np.flatnonzero(place % 2 == 0)
            right = left + 1
            paired = (right < len(run)) & (run[np.minimum(right, len(run) - 1)] == run[left])
            out = maps[left]
            out[paired] = np.take_along_axis(maps[right[paired]], maps[left[paired]], axis=1)
            maps, run = out, run[left]
        return maps

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, key, carried = TaskContext.get().partitionId(), None, None

        def rows(keys: list, maps: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([part] * len(keys), pa.int32()), pa.array(keys, pa.string()), pa.array(maps, pa.list_(pa.int32()))], [RANGE, KEY, "map"])

        for b in batches:
            if not b.num_rows:
                continue
            starts = key_starts(b[KEY], key)
            kind = pc.index_in(b[column], value_set=pa.array(kinds, pa.string())).fill_null(len(kinds)).to_numpy(zero_copy_only=False)
            continued = not starts[0]
            starts[0] = True
            maps = reduced(table[kind], starts)
            if continued:
                maps[0] = maps[0][carried]
            keys = b[KEY].take(pa.array(np.flatnonzero(starts))).to_pylist()
            if key is not None and not continued:
                yield rows([key], [carried.tolist()])
            yield rows(keys[:-1], maps[:-1].tolist())
            key, carried = keys[-1], maps[-1]
        if key is not None:
            yield rows([key], [carried.tolist()])

    assert table.shape == (len(kinds) + 1, width)
    return ranged.select(KEY, column).mapInArrow(each, f"{RANGE} int, {KEY} string, map array<int>")
