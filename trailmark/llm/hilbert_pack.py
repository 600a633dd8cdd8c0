"""Packing along a space-filling curve.

A document's token ids are hashed into a vector, the vector is projected to three dimensions,
and each dimension is cut at quantiles into cells; the Hilbert index of the cells is the sort
key. Documents are range-sorted by it, so that like documents are neighbours, and every range
is filled into sequences in that order: a document is cut where its sequence is full. What is
left at the end of a range becomes sequences of powers of two, so nothing is padded.

The quantiles are those of all documents, from a sketch that Spark merges (``percentile_approx``, ranks
right to 1 / ``ACCURACY``). Equal texts share a key; a hash of doc_id behind it lets a range end among them.

Defined results: null and empty texts are the end id alone; rows that share a doc_id each get
their pieces; a null doc_id is kept; an empty table has no pieces; extra columns are not carried.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, trim
from .wordbpe import encoder, vocabulary_path

LENGTH, END_ID = 4096, 2
BUCKETS, DIMENSIONS, BITS, ACCURACY = 256, 3, 8, 10_000
#: Columns of a document's projection.
_AXES = [f"x{k}" for k in range(DIMENSIONS)]
#: Tokens of a range, on average.
RANGE_TOKENS = 4_000_000
_PROJECT = np.random.default_rng(11).standard_normal((BUCKETS, DIMENSIONS))


def project(ids: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """(documents, dimensions) of ids[bounds[k]:bounds[k + 1]]: hashed counts, damped, of length one, projected."""
    n = len(bounds) - 1
    bucket = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - 8)
    owner = np.repeat(np.arange(n), np.diff(bounds))
    vectors = np.sqrt(np.bincount(owner * BUCKETS + bucket.astype(np.int64), minlength=n * BUCKETS).reshape(n, BUCKETS))
    return (vectors / np.maximum(np.linalg.norm(vectors, axis=1), 1e-9)[:, None]) @ _PROJECT


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve of integer points (n, dimensions) with so many bits each."""
    x = cells.astype(np.int64).T.copy()
    dims = len(x)
    q = 1 << (bits - 1)
    while q > 1:  # undo the excess rotations from the highest bit down
        p = q - 1
        for i in range(dims):
            high = (x[i] & q) > 0
            swap = (x[0] ^ x[i]) & p
            x[0] = np.where(high, x[0] ^ p, x[0] ^ swap)
            if i:
                x[i] = np.where(high, x[i], x[i] ^ swap)
        q >>= 1
    for i in range(1, dims):  # Gray code
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[-1] & q) > 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            out = (out << 1) | ((x[i] >> b) & 1)
    return out


def fit_cells(table: DataFrame) -> np.ndarray:
    """Quantiles (dimensions, cells - 1) of the projections of all rows of table(x0, x1, ...)."""
    at = [k / (1 << BITS) for k in range(1, 1 << BITS)]
    found = table.agg(*(F.percentile_approx(c, at, ACCURACY).alias(c) for c in _AXES)).first()
    if found[0] is None:
        return np.zeros((DIMENSIONS, len(at)))
    return np.array([found[c] for c in _AXES])


class _Filler:
    """Fills sequences one after another; a piece is (document, start, stop, sequence, offset)."""

    def __init__(self, length: int):
        self.length, self.sequence, self.filled, self.open = length, 0, 0, []

    def add(self, document, tokens: int) -> Iterator[tuple]:
        at = 0
        while at < tokens:
            n = min(tokens - at, self.length - self.filled)
            self.open.append((document, at, at + n))
            self.filled += n
            at += n
            if self.filled == self.length:
                yield from self._close()

    def _close(self) -> Iterator[tuple]:
        offset = 0
        for document, a, b in self.open:
            yield document, a, b, self.sequence, offset
            offset += b - a
        self.sequence, self.filled, self.open = self.sequence + 1, 0, []

    def finish(self) -> Iterator[tuple]:
        """The rest as sequences of powers of two, the largest first."""
        rest, left = self.open, self.filled
        while left:
            self.length = 1 << (left.bit_length() - 1)
            left -= self.length
            self.open, self.filled, more = [], 0, []
            for document, a, b in rest:
                n = min(b - a, self.length - self.filled)
                if n:
                    self.open.append((document, a, a + n))
                    self.filled += n
                if a + n < b:
                    more.append((document, a + n, b))
            yield from self._close()
            rest = more


def pack(docs: DataFrame, path: str | None = None, length: int = LENGTH) -> DataFrame:
    """docs(doc_id, text) -> pieces (doc_id, start, length, doc_tokens, sequence_id, offset, ids binary)."""
    path = path or vocabulary_path()
    scratch = Scratch(docs.sparkSession, "pack")
    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for whole in batches:
            for at in range(0, whole.num_rows, 1_000):
                b = whole.slice(at, 1_000)
                ids, bounds = e.encode(b["text"], END_ID)
                points = project(ids, bounds)
                small = ids.astype("<u2") if ids.max(initial=0) < 1 << 16 else ids.astype("<u4")
                yield pa.RecordBatch.from_arrays([b["doc_id"], *map(pa.array, points.T), pa.array(np.diff(bounds)), pa.array([small[s:t].tobytes() for s, t in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)], pa.binary())], ["doc_id", *_AXES, "n", "ids"])
        trim()

    table = scratch.save(rows.mapInArrow(encoded, f"doc_id {kind}, {''.join(f'{c} double, ' for c in _AXES)}n long, ids binary"), "encoded")
    cells = fit_cells(table)

    @F.pandas_udf("long")
    def place(x: pd.DataFrame) -> pd.Series:
        return pd.Series(hilbert(np.stack([np.searchsorted(c, x[n], "right") for c, n in zip(cells, _AXES, strict=True)], axis=1), BITS))

    order = ["key", "tie", "doc_id", "n"]
    n_ranges = -(-(table.agg(F.sum("n").alias("n")).first()["n"] or 1) // RANGE_TOKENS)
    ranged = table.withColumn("key", place(F.struct(*_AXES))).withColumn("tie", F.xxhash64("doc_id")).repartitionByRange(n_ranges, *order).sortWithinPartitions(*order)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filler, part = _Filler(length), 0

        def rows_of(pieces: list[tuple]) -> pa.RecordBatch:
            ids = [np.frombuffer(d[1], "<u2" if len(d[1]) == 2 * d[2] else "<u4")[a:b].astype("<u4").tobytes() for d, a, b, _, _ in pieces]
            longs = [[a for _, a, _, _, _ in pieces], [b - a for _, a, b, _, _ in pieces], [d[2] for d, *_ in pieces], [(part << 36) + s for *_, s, _ in pieces], [o for *_, o in pieces]]
            return pa.RecordBatch.from_arrays([pa.array([d[0] for d, *_ in pieces], kinds[0]), *(pa.array(x, pa.int64()) for x in longs), pa.array(ids, pa.binary())], ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])

        kinds = []
        for b in batches:
            kinds = [b["doc_id"].type]
            done = []
            for doc, n, ids, p in zip(b["doc_id"].to_pylist(), b["n"].to_pylist(), b["ids"], b["part"].to_pylist(), strict=True):
                part = p
                done += filler.add((doc, ids.as_buffer(), n), n)
                if len(done) >= 1_000:
                    yield rows_of(done)
                    done = []
            yield rows_of(done)
        if filler.open:
            yield rows_of(list(filler.finish()))

    return ranged.withColumn("part", F.spark_partition_id().cast("long")).select("doc_id", "n", "ids", "part").mapInArrow(fill, f"doc_id {kind}, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary")


def digests(pieces: DataFrame) -> DataFrame:
    """Pieces with a checksum in place of their ids."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op10_hilbert_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 4096 tokens."""
    return digests(pack(spark.read.parquet(f"{sf_dir}/documents.parquet")))
