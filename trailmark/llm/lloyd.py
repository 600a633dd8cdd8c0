"""Vector codes by product quantisation, with Lloyd's rounds maintained by deltas.

Vectors become integers and are cut into equal consecutive parts; each part position has a codebook.
They are written once, bucketed by a row number, and so are their assignments after every round: a
round joins both without a shuffle, assigns every part anew, and keeps running integer sums and
counts of all codebook entries on the driver. What a round sends is, for each task, what parts that
changed their entry add to the new one and take from the old one, summed by entry; a task where
nothing changed sends nothing. The first round's contributions are all plus.

Sums are integers, so the entries are the same in whatever order and partitions they are added.

Defined results: null vectors and those that hold null or non-finite components are dropped; vectors
of different widths have codebooks of their own (a width that 8 doesn't divide is cut as evenly as
possible, earlier parts shorter); with fewer vectors than entries there are fewer entries; of rows that share a
vec_id the smaller vectors come first, rows without one come last; repeated rows each get a row;
components of any finite size are exact, an error beyond 64 bits is null; an empty table has no
rows; extra columns are not carried, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4_096
#: Bytes of vectors in one bucket; parts compared with all entries at once.
BUCKET_BYTES, STRIP = 256 << 20, 4_096
#: Components up to this size (after scaling) are multiplied as 64-bit integers, others as Python's.
SMALL = 1 << 24


def scaled(vector: np.ndarray, scale: int = SCALE) -> list[int] | np.ndarray:
    """Components times scale, rounded down."""
    x = vector.astype(np.float64)
    if np.abs(x).max(initial=0) < SMALL / scale:
        return np.floor(x * scale).astype(np.int64)
    return [math.floor(int(v) * scale) if abs(v) > 1 << 60 else math.floor(v * scale) for v in x.tolist()]


def cuts(width: int) -> list[int]:
    return [width * k // PARTS for k in range(PARTS + 1)]


Books = dict[int, list[list[list[int]]]]  # by width: parts of entries of components


def nearest(block: np.ndarray, entries: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of the nearest entry for each row of whole numbers; ties go to the lower index."""
    kind = block.dtype if max((abs(c) for e in entries for c in e), default=0) < SMALL else object
    book = np.array(entries, dtype=kind).reshape(len(entries), block.shape[1])
    index, least = np.zeros(len(block), np.int64), np.zeros(len(block), kind)
    for s in range(0, len(block), STRIP):
        d = block[s : s + STRIP].astype(kind)[:, None, :] - book[None]
        d = (d * d).sum(axis=2)
        index[s : s + STRIP] = d.argmin(axis=1)
        least[s : s + STRIP] = d[np.arange(len(d)), index[s : s + STRIP]]
    return index, least


def _blocks(b: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, matrix) of a batch's vectors, by width and by whether they fit 64 bits."""
    small, big = b["small"], b["big"]
    widths = b["width"].to_numpy(zero_copy_only=False)
    plain = small.is_valid().to_numpy(zero_copy_only=False)
    for width in np.unique(widths).tolist():
        at = np.flatnonzero((widths == width) & plain)
        if len(at):
            flat = b"".join(small[k].as_buffer() for k in at.tolist())
            yield at, np.frombuffer(flat, np.int32).astype(np.int64).reshape(len(at), width)
        at = np.flatnonzero((widths == width) & ~plain)
        if len(at):
            yield at, np.array([[int(x) for x in big[k].as_py()] for k in at.tolist()], dtype=object).reshape(len(at), width)


def _prepared(vectors: DataFrame) -> DataFrame:
    """vectors(vec_id, embedding, label) with whole numbers: 32-bit ones in small, else decimal text in big."""
    kinds = {f.name: f.dataType.simpleString() for f in vectors.schema}

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, width, small, big = [], [], [], []
            for k, v in enumerate(b["embedding"]):
                x = v.values.to_numpy(zero_copy_only=False).astype(np.float64) if v.is_valid else None
                if x is None or v.values.null_count or not np.isfinite(x).all():
                    continue
                whole = scaled(x)
                at.append(k)
                width.append(len(x))
                small.append(whole.astype(np.int32).tobytes() if isinstance(whole, np.ndarray) else None)
                big.append(None if isinstance(whole, np.ndarray) else list(map(str, whole)))
            kept = b.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([kept["vec_id"], kept["label"], pa.array(width, pa.int32()), pa.array(small, pa.binary()), pa.array(big, pa.list_(pa.string()))], ["vec_id", "label", "width", "small", "big"])

    return vectors.select("vec_id", "embedding", "label").mapInArrow(each, f"vec_id {kinds['vec_id']}, label {kinds['label']}, width int, small binary, big array<string>")


def first_entries(rows: DataFrame, widths: list[int]) -> Books:
    """Codebooks of the vectors of the smallest ids, for each width."""
    found: Books = {}
    for width in widths:
        order = [F.asc_nulls_last("vec_id"), "small", "big"]
        first = rows.where(F.col("width") == width).orderBy(*order).select("small", "big").limit(ENTRIES).collect()
        if first:
            whole = [np.frombuffer(r["small"], np.int32).tolist() if r["small"] is not None else list(map(int, r["big"])) for r in first]
            at = cuts(width)
            found[width] = [[v[s:e] for v in whole] for s, e in zip(at[:-1], at[1:], strict=True)]
    return found


def assigned(block: np.ndarray, book: list[list[list[int]]]) -> tuple[np.ndarray, np.ndarray]:
    """(indexes, squared distances) of all parts of vectors, a column a part."""
    at = cuts(block.shape[1])
    both = [nearest(block[:, s:e], entries) for s, e, entries in zip(at[:-1], at[1:], book, strict=True)]
    return np.stack([i for i, _ in both], axis=1), np.stack([d for _, d in both], axis=1)


def _round(rows: DataFrame, books: Books) -> DataFrame:
    """rows with their previous codes -> (row, codes, delta): all rows' codes; a task's last rows have its deltas instead.

    delta: what is added to an entry, less what is taken from it, as a count and decimal sums.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int, int], list] = {}
        some = None

        def add(width: int, part: int, values: np.ndarray, entries: np.ndarray, sign: int) -> None:
            for e in np.unique(entries).tolist():
                mine = values[entries == e]
                n, total = sums.get((width, part, e), (0, 0))
                sums[width, part, e] = (n + sign * len(mine), total + sign * mine.sum(axis=0).astype(object))

        for b in batches:
            codes = np.zeros((b.num_rows, PARTS), np.uint8)
            for at, block in _blocks(b):
                new, _ = assigned(block, books[block.shape[1]])
                codes[at] = new
                before = [b["codes"][k].as_py() for k in at.tolist()]
                old = np.array([list(c) if c is not None else [-1] * PARTS for c in before], np.int64).reshape(-1, PARTS)
                cut = cuts(block.shape[1])
                for p in range(PARTS):
                    moved = old[:, p] != new[:, p]
                    if not moved.any():
                        continue
                    values = block[moved, cut[p] : cut[p + 1]]
                    add(block.shape[1], p, values, new[moved, p], 1)
                    was = old[moved, p]
                    add(block.shape[1], p, values[was >= 0], was[was >= 0], -1)
            some = b["row"][-1].as_py() if b.num_rows else some
            none = pa.nulls(b.num_rows, DELTA)
            yield pa.RecordBatch.from_arrays([b["row"], pa.array([c.tobytes() for c in codes], pa.binary()), none], ["row", "codes", "delta"])
        if sums:
            deltas = [{"width": w, "part": p, "entry": e, "n": n, "sums": list(map(str, np.atleast_1d(total)))} for (w, p, e), (n, total) in sums.items()]
            # in the bucket of the task's rows
            yield pa.RecordBatch.from_arrays([pa.array([some] * len(deltas), pa.int64()), pa.nulls(len(deltas), pa.binary()), pa.array(deltas, DELTA)], ["row", "codes", "delta"])

    return rows.select("row", "width", "small", "big", "codes").mapInArrow(each, "row long, codes binary, delta struct<width:int,part:int,entry:int,n:long,sums:array<string>>")


DELTA = pa.struct([("width", pa.int32()), ("part", pa.int32()), ("entry", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.string()))])


def _added(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """Sums of the tasks' deltas of one entry: a row a task at most."""
    total = [sum(map(int, c)) for c in zip(*table["sums"].to_pylist(), strict=True)]
    width, part, entry = (k.as_py() for k in key)
    return pa.table({"width": pa.array([width], pa.int32()), "part": pa.array([part], pa.int32()), "entry": pa.array([entry], pa.int32()), "n": pa.array([sum(table["n"].to_pylist())], pa.int64()), "sums": pa.array([list(map(str, total))], pa.list_(pa.string()))})


class Bucketed:
    """Tables of the shared folder, bucketed alike by row: joined by it without a shuffle."""

    def __init__(self, scratch: Scratch, buckets: int):
        self.scratch, self.buckets, self.spark = scratch, buckets, scratch.spark

    def save(self, df: DataFrame, name: str) -> str:
        table = f"{name}_{uuid.uuid4().hex}"
        df.write.bucketBy(self.buckets, "row").option("path", self.scratch.path(name)).option("compression", "zstd").saveAsTable(table)
        return table

    def drop(self, table: str) -> None:
        df = self.spark.table(table)
        df._scratch_path = os.path.dirname(df.inputFiles()[0]) if df.inputFiles() else None
        self.spark.sql(f"DROP TABLE {table}")
        if df._scratch_path:
            self.scratch.drop(df)


def quantise(vectors: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """vectors(vec_id, embedding, label) -> (vec_id, label, codes, error, book), a row for every kept vector.

    book: the decimal components of all entries of the vector's width, by part, entry and place.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "lloyd")
    sizes = vectors.where("embedding is not null").groupBy(F.size("embedding").alias("width")).agg(F.count("*").alias("n")).collect()
    buckets = max(spark.sparkContext.defaultParallelism, math.ceil(sum(4 * r["width"] * r["n"] for r in sizes) / BUCKET_BYTES))
    tables = Bucketed(scratch, buckets)
    rows = _prepared(vectors).withColumn("row", F.monotonically_increasing_id())
    kept = tables.save(rows.repartition(buckets, "row"), "vectors")
    books = first_entries(spark.table(kept), sorted(r["width"] for r in sizes))
    running = {(w, p, e): (0, [0] * len(c)) for w, book in books.items() for p, entries in enumerate(book) for e, c in enumerate(entries)}
    before = None
    for _ in range(rounds if books else 0):
        found = spark.table(kept)
        if before:
            found = found.join(spark.table(before).where("codes is not null").select("row", "codes").hint("shuffle_hash"), "row", "left")
        else:
            found = found.withColumn("codes", F.lit(None).cast("binary"))
        now = tables.save(_round(found, books), "codes")
        if before:
            tables.drop(before)
        before = now
        changes = spark.table(now).where("delta is not null").select("delta.*").groupBy("width", "part", "entry").applyInArrow(_added, "width int, part int, entry int, n long, sums array<string>").collect()
        if not changes:  # the same entries from here on
            break
        for c in changes:
            n, sums = running[c["width"], c["part"], c["entry"]]
            n, sums = n + c["n"], [a + int(b) for a, b in zip(sums, c["sums"], strict=True)]
            running[c["width"], c["part"], c["entry"]] = n, sums
            if n:
                books[c["width"]][c["part"]][c["entry"]] = [x // n for x in sums]
    out = scratch.save(_coded(spark.table(kept), books), "codes")
    for table in filter(None, (before, kept)):
        tables.drop(table)
    written = [(w, ",".join(str(x) for entries in book for e in entries for x in e)) for w, book in books.items()]
    listed = F.create_map(*(F.lit(x) for pair in written for x in pair)) if written else F.lit(None).cast("map<int,string>")
    return out.withColumn("book", listed[F.col("width")])


def _coded(rows: DataFrame, books: Books) -> DataFrame:
    """Codes and errors by the finished codebooks."""
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes, errors = [b""] * b.num_rows, [0] * b.num_rows
            for at, block in _blocks(b):
                index, distance = assigned(block, books[block.shape[1]])
                for k, i, d in zip(at.tolist(), index.astype(np.uint8), distance.astype(object).sum(axis=1).tolist(), strict=True):
                    codes[k], errors[k] = i.tobytes(), d if d < 1 << 63 else None
            yield pa.RecordBatch.from_arrays([b["vec_id"], b["label"], b["width"], pa.array(codes, pa.binary()), pa.array(errors, pa.int64())], ["vec_id", "label", "width", "codes", "error"])

    return rows.select("vec_id", "label", "width", "small", "big").mapInArrow(each, f"vec_id {kinds['vec_id']}, label {kinds['label']}, width int, codes binary, error long")


def with_label_errors(coded: DataFrame) -> DataFrame:
    """coded with label_error, the error summed over rows of equal labels, nulls together."""
    sums = coded.groupBy(F.col("label").alias("of")).agg(F.try_sum("error").alias("label_error"))
    return coded.join(sums, F.col("label").eqNullSafe(F.col("of"))).drop("of")


def op12_delta_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all vectors, their errors, and a digest of the codebooks."""
    found = with_label_errors(quantise(spark.read.parquet(f"{sf_dir}/embeddings.parquet")))
    return found.select("vec_id", F.lower(F.hex("codes")).alias("code"), "error", "label_error", F.sha2("book", 256).alias("codebooks_sha256"))


def oracle() -> str:
    """The rounds as chained tables in DuckDB SQL, every part of every vector against every entry."""
    floor_mean = "CAST((s - ((s % n) + n) % n) // n AS BIGINT)"
    steps = [
        f"""v AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings
             WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        p AS (SELECT vec_id, part, v[part * len(v) // {PARTS} + 1 : (part + 1) * len(v) // {PARTS}] AS x FROM v, range({PARTS}) t(part)),
        r AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM v),
        c0 AS (SELECT part, entry, x AS c FROM p JOIN r USING (vec_id) WHERE entry < {ENTRIES})"""
    ]
    for k in range(ROUNDS + 1):
        distance = "list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
        steps.append(f"d{k} AS (SELECT vec_id, part, entry, {distance}::BIGINT AS d FROM p JOIN c{k} USING (part))")
        steps.append(f"a{k} AS (SELECT vec_id, part, min(d) AS d, arg_min(entry, (d, entry)) AS entry FROM d{k} GROUP BY 1, 2)")
        if k < ROUNDS:
            steps.append(f"e{k} AS (SELECT part, entry, unnest(range(1, len(x) + 1)) AS i, unnest(x) AS y FROM a{k} JOIN p USING (vec_id, part))")
            steps.append(f"m{k} AS (SELECT part, entry, i, {floor_mean} AS y FROM (SELECT part, entry, i, sum(y) AS s, count(*) AS n FROM e{k} GROUP BY 1, 2, 3))")
            steps.append(f"n{k} AS (SELECT part, entry, list(y ORDER BY i) AS c FROM m{k} GROUP BY 1, 2)")
            steps.append(f"c{k + 1} AS (SELECT part, entry, coalesce(n{k}.c, c{k}.c) AS c FROM c{k} LEFT JOIN n{k} USING (part, entry))")
    return f"""
    WITH {", ".join(steps)},
    book AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) AS h FROM c{ROUNDS}),
    out AS (SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a{ROUNDS} GROUP BY 1)
    SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, h AS codebooks_sha256 FROM out JOIN v USING (vec_id), book
    """
