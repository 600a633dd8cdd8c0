"""Vectors at rest and their arithmetic, in double precision."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import let


@F.pandas_udf(T.BinaryType())
def to_float32_le(vector: pd.Series) -> pd.Series:
    """Little-endian 32-bit floats; null for null."""
    return vector.map(lambda v: None if v is None else np.asarray(v, "<f4").tobytes())


@F.pandas_udf(T.ArrayType(T.FloatType()))
def from_float32_le(raw: pd.Series) -> pd.Series:
    """The floats of such bytes; null for null, empty or misaligned bytes."""
    return raw.map(lambda b: None if not b or len(b) % 4 else np.frombuffer(b, "<f4"))


def as_double(vector: Column) -> Column:
    return vector.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(as_double(a), as_double(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(as_double(v), F.lit(0.0), lambda s, x: s + x * x))


def masked_mean(rows: Column, mask: Column) -> Column:
    """Mean of the vectors of rows whose mask is not 0; the divisor is at least 1e-9."""

    def mean(kept: Column) -> Column:
        total = F.aggregate(kept, zero, lambda s, x: F.zip_with(s, as_double(x["v"]), lambda p, q: p + q))
        return let(F.greatest(F.size(kept).cast("double"), F.lit(1e-9)), lambda n: F.transform(total, lambda x: x / n))

    zero = F.array_repeat(F.lit(0.0), F.size(F.element_at(rows, 1)))
    return let(F.filter(F.arrays_zip(rows.alias("v"), mask.alias("m")), lambda x: x["m"] != 0), mean)


def normalize(v: Column) -> Column:
    return let(as_double(v), lambda d: let(norm(d), lambda length: F.transform(d, lambda x: x / length)))


def rounded(v: Column, digits: int) -> Column:
    return F.transform(as_double(v), lambda x: F.round(x, digits))


def is_jpeg(raw: Column) -> Column:
    return F.coalesce(F.startswith(raw, F.lit(bytearray(b"\xff\xd8\xff"))), F.lit(False))


def is_pdf(raw: Column) -> Column:
    return F.coalesce(F.startswith(raw, F.lit(bytearray(b"%PDF"))), F.lit(False))
