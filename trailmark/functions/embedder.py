"""Texts to unit vectors: hashed n-grams, and an embedder learned from a corpus.

A text's words and pairs of neighbouring words are hashed to buckets; a bucket's weight is the
logarithm of its count, times the inverse document frequency where an embedder has learned one.
``hashed`` takes these weights as they are. ``learn`` finds the directions in which a corpus varies
most, the right singular vectors of its matrix of documents and buckets, by randomised subspace
iteration: each round is one pass over the corpus, in which a task multiplies the rows it reads into
a matrix of buckets and directions and hands on that; the driver orthogonalises the sum. What is
sent and kept is of that fixed size, however large the corpus. Texts are hashed once: a table of their
buckets and counts (``counted``) is written, and what goes over the corpus again reads that.

Null and empty texts have no features and no vector.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import shared

BUCKETS, WIDTH, SPARE, ROUNDS = 1 << 13, 64, 16, 3
#: Texts multiplied at once, characters hashed at once, features whose rounds of MD5 are worked out at once.
STRIP, PIECE, LANES = 256, 1 << 20, 8_192
#: MD5 (RFC 1321): additive constants and rotations of its steps, left and right, the state that a message begins with.
SINES = [np.array(int(abs(math.sin(k + 1)) * 2**32), np.uint32) for k in range(64)]
TURNS = [(np.array(t, np.uint32), np.array(32 - t, np.uint32)) for ts in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for t in ts * 4]
STATE = [np.uint32(s) for s in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]
#: What of a word belongs to a message, and its end mark, by the message's bytes from the word on, plus one.
OWN, MARK = np.array([0, 0, 0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], np.uint32), np.array([0, 0x80, 0x8000, 0x800000, 0x80000000, 0], np.uint32)
#: Words of messages that are hashed together: a message and its end mark fit into them. Longer than 55 bytes takes more than one block.
BLOCKS = (4, 7, 14)


def _md5_block(words: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """The first four digest bytes, little-endian, of messages of one block: a row of words a place, the rest zero."""
    a, b, c, d = (np.full(len(bits), s) for s in STATE)
    f = np.empty_like(a)
    for k in range(64):
        if k < 16:
            g = k
            np.bitwise_xor(c, d, out=f)
            f &= b
            f ^= d
        elif k < 32:
            g = (5 * k + 1) % 16
            np.bitwise_xor(b, c, out=f)
            f &= d
            f ^= c
        elif k < 48:
            g = (3 * k + 5) % 16
            np.bitwise_xor(b, c, out=f)
            f ^= d
        else:
            g = 7 * k % 16
            np.invert(d, out=f)
            f |= b
            f ^= c
        a += f
        a += SINES[k]
        if g < len(words):
            a += words[g]
        elif g == 14:
            a += bits
        np.left_shift(a, TURNS[k][0], out=f)
        a >>= TURNS[k][1]
        a |= f
        a += b
        a, b, c, d = d, a, b, c
    return a + STATE[0]


def _hashes(text: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The numbers that the first seven hex digits of the slices' MD5 are."""
    raw, lengths = np.frombuffer(text + bytes(4 * BLOCKS[-1]), np.uint8).astype(np.uint32), ends - starts
    at = raw[:-3] | raw[1:-2] << 8 | raw[2:-1] << 16 | raw[3:] << 24  # the word from every byte on
    out, least = np.zeros(len(starts), np.int64), 0
    for size in BLOCKS:
        some = np.flatnonzero((lengths >= least) & (lengths < 4 * size))
        least = 4 * size
        for s in range(0, len(some), LANES):
            part = some[s : s + LANES]
            begin, long = starts[part], lengths[part]
            words = np.empty((size, len(part)), np.uint32)
            for k in range(size):
                left = np.clip(long - (4 * k - 1), 0, 5)
                words[k] = at[begin + 4 * k] & OWN[left] | MARK[left]
            out[part] = _md5_block(words, (8 * long).astype(np.uint32)).byteswap() >> 4
    for k in np.flatnonzero(lengths >= least).tolist():
        out[k] = int(md5(text[starts[k] : ends[k]], usedforsecurity=False).hexdigest()[:7], 16)
    return out


class Hasher:
    """Features of texts as buckets."""

    def __init__(self, buckets: int):
        self.buckets = buckets

    def counts(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(how many buckets each text has, these buckets, ascending in each, their counts)."""
        parts, held, size = [(np.zeros(0, np.int64),) * 3], [], 0
        for k, text in enumerate(texts):
            held.append(text)
            size += len(text or "")
            if size >= PIECE or k == len(texts) - 1:
                parts.append(self._piece(held))
                held, size = [], 0
        return tuple(map(np.concatenate, zip(*parts, strict=True)))

    def _piece(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        lines = [b" ".join(t.lower().encode().split()) if t else b"" for t in texts]
        joined = b"\n".join([*lines, b""])
        raw = np.frombuffer(joined, np.uint8)
        ends = np.flatnonzero((raw == ord(" ")) | (raw == ord("\n")))
        starts, last = np.append(0, ends[:-1] + 1), raw[ends] == ord("\n")
        row = np.append(0, np.cumsum(last[:-1]))
        word, pair = np.flatnonzero(ends > starts), np.flatnonzero(~last)  # a pair is a word and the one behind it
        found = _hashes(joined, np.append(starts[word], starts[pair]), np.append(ends[word], ends[pair + 1])) % self.buckets
        keys, n = np.unique(np.append(row[word], row[pair]) * self.buckets + found, return_counts=True)
        return np.bincount(keys // self.buckets, minlength=len(texts)), keys % self.buckets, n


def _rows(lengths: np.ndarray, at: np.ndarray, n: np.ndarray, buckets: int, weights: np.ndarray | None) -> np.ndarray:
    """A row a text, of unit length or of zeros, of their buckets and counts."""
    row, w = np.repeat(np.arange(len(lengths)), lengths), np.log1p(n)
    if weights is not None:
        w *= weights[at]
    length = np.sqrt(np.bincount(row, w * w, minlength=len(lengths)))[row]
    out = np.zeros((len(lengths), buckets))
    out[row, at] = np.divide(w, length, out=w, where=length > 0)
    return out


def _dense(hasher: Hasher, texts: list[str | None], weights: np.ndarray | None) -> np.ndarray:
    """Rows of unit length, or of zeros."""
    return _rows(*hasher.counts(texts), hasher.buckets, weights)


def _lists(rows: np.ndarray, there: np.ndarray | None = None) -> pa.Array:
    """A matrix' rows as an array of lists, null where nothing is there."""
    ends = pa.array(np.arange(len(rows) + 1) * rows.shape[1], pa.int32())
    return pa.ListArray.from_arrays(ends, pa.array(rows.ravel(), pa.float64()), mask=None if there is None else pa.array(~there))


def _packed(values: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """Whole numbers behind each other as bytes, so many a row: Spark copies these at once, lists by the element."""
    ends = np.append(0, 4 * np.cumsum(lengths)).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(ends), pa.py_buffer(values.astype("<i4"))])


def _unpacked(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(how many numbers each row has, the numbers)."""
    rows = column.to_pylist()
    return np.fromiter(map(len, rows), np.int64, len(rows)) // 4, np.frombuffer(b"".join(rows), "<i4")


def _counted_strips(b: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """Strips of a batch of a counted table, and what Hasher.counts gave for their texts."""
    for s in range(0, b.num_rows, STRIP):
        part = b.slice(s, STRIP)
        yield part, (*_unpacked(part["at"]), _unpacked(part["n"])[1])


class Embedder:
    """Weights of buckets, and the directions that their rows are projected on."""

    def __init__(self, weights: np.ndarray, directions: np.ndarray):
        self.weights, self.directions = weights, directions

    def units(self, lengths: np.ndarray, at: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(vectors of counted texts, which of them there are)."""
        x = _rows(lengths, at, n, len(self.weights), self.weights) @ self.directions
        length = np.linalg.norm(x, axis=1)
        there = length > 1e-12
        return np.divide(x, length[:, None], out=x, where=there[:, None]), there

    def vectors(self, texts: list[str | None], hasher: Hasher | None = None) -> list[list[float] | None]:
        """A unit vector a text; None without features, or if no direction has to do with them."""
        hasher, out = hasher or Hasher(len(self.weights)), []
        for s in range(0, len(texts), STRIP):
            x, there = self.units(*hasher.counts(texts[s : s + STRIP]))
            out += [v if t else None for v, t in zip(x.tolist(), there.tolist(), strict=True)]
        return out

    def save(self, spark: SparkSession, path: str) -> None:
        """A row a bucket: its weight and its part in every direction."""
        rows = [(k, float(w), d.tolist()) for k, (w, d) in enumerate(zip(self.weights, self.directions, strict=True))]
        spark.createDataFrame(rows, "bucket int, weight double, direction array<double>").coalesce(1).write.mode("overwrite").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> Embedder:
        rows = spark.read.parquet(path).orderBy("bucket").collect()  # as many as buckets
        return Embedder(np.array([r["weight"] for r in rows]), np.array([r["direction"] for r in rows]))


def counted(df: DataFrame, buckets: int = BUCKETS, text: str = "text") -> DataFrame:
    """df with its texts' buckets and their counts in place of the texts: the columns at and n, packed numbers."""
    kept = [c for c in df.columns if c != text]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(buckets)
        for whole in batches:
            for s in range(0, whole.num_rows, STRIP):
                b = whole.slice(s, STRIP)
                lengths, at, n = hasher.counts(b[text].to_pylist())
                yield pa.RecordBatch.from_arrays([*(b[c] for c in kept), _packed(at, lengths), _packed(n, lengths)], [*kept, "at", "n"])

    return df.mapInArrow(each, T.StructType([*(df.schema[c] for c in kept), T.StructField("at", T.BinaryType()), T.StructField("n", T.BinaryType())]))


def embed(df: DataFrame, embedder: Embedder, text: str = "text", vector: str = "vector") -> DataFrame:
    """df with the vectors of its texts, in batches."""
    held = df.sparkSession.sparkContext.broadcast(embedder)
    return _with_vectors(df, text, vector, len(embedder.weights), lambda counts: held.value.units(*counts))


def embed_counted(df: DataFrame, embedder: Embedder, vector: str = "vector") -> DataFrame:
    """The same of a table of ``counted``, with vectors in place of the counts."""
    held = df.sparkSession.sparkContext.broadcast(embedder)
    kept = [c for c in df.columns if c not in ("at", "n", vector)]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b, counts in _counted_strips(whole):
                x, there = held.value.units(*counts)
                yield pa.RecordBatch.from_arrays([*(b[c] for c in kept), _lists(x, there)], [*kept, vector])

    return df.mapInArrow(each, T.StructType([*(df.schema[c] for c in kept), T.StructField(vector, T.ArrayType(T.DoubleType()))]))


def hashed(df: DataFrame, buckets: int, text: str = "text", vector: str = "vector") -> DataFrame:
    """df with its texts' hashed weights themselves, at unit length."""
    return _with_vectors(df, text, vector, buckets, lambda counts: (_rows(*counts, buckets, None), counts[0] > 0))


def _with_vectors(df: DataFrame, text: str, vector: str, buckets: int, rows) -> DataFrame:
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(buckets)
        for whole in batches:
            for s in range(0, whole.num_rows, STRIP):
                b = whole.slice(s, STRIP)
                x, there = rows(hasher.counts(b[text].to_pylist()))
                yield pa.RecordBatch.from_arrays([*b.columns, _lists(x, there)], [*b.schema.names, vector])

    kept = df.drop(vector)
    return kept.mapInArrow(each, T.StructType([*kept.schema.fields, T.StructField(vector, T.ArrayType(T.DoubleType()))]))


def document_weights(counts: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Inverse document frequencies of the buckets over a table of ``counted``."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, n = np.zeros(buckets, np.int64), 0
        for b in batches:
            lengths, at = _unpacked(b["at"])
            found += np.bincount(at, minlength=buckets)
            n += int(np.count_nonzero(lengths))
        at = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(found[at], n))], ["bucket", "n"])

    frequency, total = np.zeros(buckets), 0
    for r in counts.select("at").mapInArrow(each, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # as many as buckets
        if r["bucket"] < 0:
            total = r["n"]
        else:
            frequency[r["bucket"]] = r["n"]
    return np.log((1 + total) / (1 + frequency)) + 1


def _multiplied(counts: DataFrame, weights: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """The corpus' matrix, transposed, times itself times the basis: a pass over a table of ``counted``."""
    buckets, width = basis.shape
    held = counts.sparkSession.sparkContext.broadcast((weights, basis))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, basis = held.value
        total = np.zeros((buckets, width))
        for b in batches:
            for _, part in _counted_strips(b):
                x = _rows(*part, buckets, weights)
                total += x.T @ (x @ basis)
        at = np.flatnonzero(total.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(at), _lists(total[at])], ["bucket", "part"])

    made = counts.select("at", "n").mapInArrow(each, "bucket long, part array<double>")
    summed = made.groupBy("bucket").agg(*(F.sum(F.get("part", F.lit(k))).alias(f"p{k}") for k in range(width)))
    out = np.zeros((buckets, width))
    for r in summed.collect():  # as many as buckets
        out[r["bucket"]] = list(r)[1:]
    held.destroy()
    return out


def learn(texts: DataFrame, **sizes) -> Embedder:
    """An embedder of the directions that texts(text) vary most in."""
    return learn_counted(shared.written(counted(texts.select("text"), sizes.get("buckets", BUCKETS)), "counted"), **sizes)


def learn_counted(counts: DataFrame, width: int = WIDTH, buckets: int = BUCKETS, rounds: int = ROUNDS, seed: int = 11) -> Embedder:
    """The same of a table of ``counted``, which every round reads: written, so that no round hashes anew."""
    weights = document_weights(counts, buckets)
    basis = np.linalg.qr(np.random.default_rng(seed).standard_normal((buckets, width + SPARE)))[0]
    for k in range(rounds):
        product = _multiplied(counts, weights, basis)
        if k == rounds - 1:  # the directions within the basis, largest first
            values, turn = np.linalg.eigh(basis.T @ product)
            basis = basis @ turn[:, ::-1]
        else:
            basis = np.linalg.qr(product)[0]
    return Embedder(weights, basis[:, :width])
