"""Arrow functions that add columns to rows they otherwise pass on."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import trim


def append(df: DataFrame, fn: Callable[[pa.RecordBatch], list], fields: list[tuple[str, T.DataType]], rows: int = 1_000) -> DataFrame:
    """df with further columns: fn gets batches of at most so many rows, returns a list a column.

    Columns of df that have one of the new names are replaced.
    """
    kept = df.select(*(F.col(f"`{c}`") for c in df.columns if c not in {f for f, _ in fields}))
    kinds = [to_arrow_type(t) for _, t in fields]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, rows):
                b = whole.slice(at, rows)
                new = [pa.array(v, k) for v, k in zip(fn(b), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*b.columns, *new], [*b.schema.names, *(f for f, _ in fields)])
        trim()

    return kept.mapInArrow(each, T.StructType([*kept.schema.fields, *(T.StructField(f, t) for f, t in fields)]))


def free(df: DataFrame, *names: str) -> list[str]:
    """The names with underscores behind them until no column of df is called so."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def fold(column: str, folds: int) -> Column:
    """crc32 of a column as text, modulo; null counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(folds))
