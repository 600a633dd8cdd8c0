"""What several operators share: the shared folder, run-wise Arrow processing, components."""

from __future__ import annotations

import itertools
import math
import re
import string
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only in local mode, where none is named."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not re.fullmatch(r"local(\[[^-]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="trailmark-shared-")
        spark.sparkContext.setCheckpointDir(root)
    return root


class Scratch:
    """Tables written to the shared folder: they cut lineage and outlive lost executors."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.base = f"{shared_root(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
        self._count = 0

    def path(self, name: str) -> str:
        self._count += 1
        return f"{self.base}/{self._count:03d}-{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """df as a table: written, then read again."""
        schema, where = df.schema, self.path(name)
        df.write.option("compression", "zstd").parquet(where)
        read = self.spark.read.schema(schema).parquet(where)
        read._scratch_path = where
        return read

    def drop(self, df: DataFrame) -> None:
        """Remove a table of save() that nothing reads any more."""
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(df._scratch_path)
        where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


_HELD: dict = {}


def held(key, make: Callable):
    """What a Python worker keeps between batches and tasks; another key takes its place, so
    that the stages of a job don't pile up in a worker that runs them all."""
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = make()
    return _HELD[key]


def uniform(*columns) -> F.Column:
    """A number in [0, 1) that depends on the columns' values only; for bounded samples."""
    return F.pmod(F.xxhash64(*columns), F.lit(1 << 30)) / F.lit(float(1 << 30))


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of consecutive rows whose keys are equal, from batches sorted by those keys.

    Small runs are yielded together (a table then holds several whole runs), so that a
    caller can process many of them at once; no run is split.
    """
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        last = [table[k][-1].as_py() for k in keys]
        # rows of the last run stay until the next batch shows where it ends
        cut = table.num_rows
        low, high = 0, table.num_rows - 1
        while low < high:  # first row of the last run; keys are sorted
            mid = (low + high) // 2
            if [table[k][mid].as_py() for k in keys] == last:
                high = mid
            else:
                low = mid + 1
        cut = low
        if held and cut == 0:
            if [held[-1][k][-1].as_py() for k in keys] != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch)
            continue
        if cut:
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = []
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held)


class WordIndex(dict):
    """Numbers of words, in order of their first use."""

    def number(self, words: pa.Array) -> tuple[np.ndarray, pa.Array]:
        """(numbers of distinct words, those of the words that are new)."""
        listed = words.to_numpy(zero_copy_only=False).tolist()
        found = np.fromiter(map(self.get, listed, itertools.repeat(-1)), np.int64, len(listed))
        new = np.flatnonzero(found < 0)
        found[new] = np.arange(len(self), len(self) + len(new))
        self.update(zip(map(listed.__getitem__, new.tolist()), found[new].tolist(), strict=True))
        return found, words.take(pa.array(new))


def raw_texts(column: pa.Array) -> list[bytes | None]:
    """The bytes of a binary column."""
    return [x.as_buffer().to_pybytes() if x.is_valid else None for x in column]


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Classes of bytes: 0 ASCII white space; letters 1, digits 2, marks but the apostrophe 4; all else 8.
_PLAIN, _CLASSES = np.full(256, 8, np.uint8), np.full(256, 8, np.uint8)
_CLASSES[[c for c in range(128) if chr(c).isalpha()]] = 1
_CLASSES[[c for c in range(128) if chr(c).isdigit()]] = 2
_CLASSES[list(string.punctuation.replace("'", "").encode())] = 4
_PLAIN[list(b" \t\n\x0b\f\r")] = _CLASSES[list(b" \t\n\x0b\f\r")] = 0


def cut_words(column: pa.Array, lower: bool = True, classes: bool = False) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """(codes, words, bounds) of a binary column: the words of text k are words[c] for the codes c in codes[bounds[k]:bounds[k + 1]]. Words are distinct, runs between ASCII white space, with
    A-Z lowered if asked for; with classes they also end where ASCII letters, digits and marks
    (but the apostrophe) meet. Null counts as empty.
    """
    column = column.fill_null(b"") if column.null_count else column
    n, wide = len(column), pa.types.is_large_binary(column.type)
    if not n:
        return np.zeros(0, np.int64), pa.array([], pa.binary()), np.zeros(1, np.int64)
    _, ends, raw = column.buffers()
    ends = np.frombuffer(ends, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(raw, np.uint8)[ends[0] : ends[-1]] if raw is not None else np.zeros(0, np.uint8)
    ends = ends - ends[0]
    if not len(data):
        return np.zeros(0, np.int64), pa.array([], pa.binary()), np.zeros(n + 1, np.int64)
    kind = (_CLASSES if classes else _PLAIN)[data]
    before = np.empty_like(kind)
    before[0], before[1:] = 0, kind[:-1]
    before[ends[:-1][ends[:-1] < len(data)]] = 0
    inside = kind != 0
    begins = inside & ((before == 0) | ((before != kind) & ((before | kind) < 8)) if classes else before == 0)
    starts = np.flatnonzero(begins[inside])
    bounds = np.searchsorted(np.flatnonzero(begins), ends)
    flat = data[inside]
    flat = _LOWER[flat] if lower else flat
    kind_, size = (pa.binary(), np.int32) if len(flat) < 1 << 31 else (pa.large_binary(), np.int64)
    found = pa.Array.from_buffers(kind_, len(starts), [None, pa.py_buffer(np.append(starts, len(flat)).astype(size)), pa.py_buffer(flat)]).dictionary_encode()
    return found.indices.to_numpy(), found.dictionary, bounds


_TRIM = None


def trim() -> None:
    """Gives memory that a worker no longer uses back to the machine; for the end of a task."""
    global _TRIM
    pa.default_memory_pool().release_unused()
    if _TRIM is None:
        try:
            import ctypes

            _TRIM = ctypes.CDLL(None).malloc_trim
        except (OSError, AttributeError):  # another C library
            _TRIM = lambda _: 0
    _TRIM(0)


def components(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """Connected components of edges(a, b): rows (node, root) for every node of an edge.

    Rounds of hooking each node to its least neighbour, then contracting. Keys should be
    random (digests), which keeps the number of rounds logarithmic. Each round's tables are
    written to the shared folder; minima are aggregated before the shuffle, and the joins
    read written tables on both sides, so a hub's rows can be split.
    """
    both = edges.where("a <> b").select("a", "b")
    both = scratch.save(both.union(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    chain: list[DataFrame] = []
    while not both.isEmpty():
        hook = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("p"))
        hook = scratch.save(hook, "hook")
        # follow the pointers once more: chains shrink twice as fast
        jump = hook.alias("x").join(hook.alias("y"), F.col("x.p") == F.col("y.a")).select(F.col("x.a").alias("a"), F.col("y.p").alias("p"))
        jump = scratch.save(jump, "jump")
        chain.append(jump)
        left = both.join(jump.select("a", F.col("p").alias("pa")), "a")
        moved = left.join(jump.select(F.col("a").alias("b"), F.col("p").alias("pb")), "b")
        fewer = scratch.save(moved.where("pa <> pb").select(F.col("pa").alias("a"), F.col("pb").alias("b")).distinct(), "edges")
        scratch.drop(both)
        both = fewer
    if not chain:
        return both.select(F.col("a").alias("node"), F.col("b").alias("root"))
    found = chain[-1].select(F.col("a").alias("node"), F.col("p").alias("root"))
    for step in reversed(chain[:-1]):
        up = found.select(F.col("node").alias("p"), F.col("root").alias("r"))
        found = step.select(F.col("a").alias("node"), "p").join(up, "p", "left").select("node", F.coalesce("r", "p").alias("root"))
        found = scratch.save(found, "roots")
    return found


def block_pairs(rows: DataFrame, key: str, member: str, count: str, block: int) -> DataFrame:
    """Rows of a bucket dealt to pairs of blocks, so that no task holds a large bucket.

    A bucket of ``count`` rows has ceil(count / block) blocks by the member's hash. Each row
    goes once to every pair (pi, pj) that its block is in; side is 1 in the pair's second block.
    """
    blocks = F.ceil(F.col(count) / F.lit(block)).cast("int")
    own = F.pmod(F.xxhash64(member, key), F.col("_blocks")).cast("int")
    out = rows.withColumn("_blocks", blocks).withColumn("_own", own).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    out = out.withColumn("pi", F.least("_own", "_other")).withColumn("pj", F.greatest("_own", "_other"))
    return out.withColumn("side", (F.col("_own") != F.col("pi")).cast("int")).drop("_blocks", "_own", "_other")


def range_count(df: DataFrame, column: str, size: int) -> list[int]:
    """The number of ranges to deal df's rows to, for repartitionByRange: none where the session's
    number makes ranges of at most so many bytes of a column, else as many as that takes."""
    n = math.ceil((df.agg(F.sum(F.octet_length(column)).alias("n")).first()["n"] or 0) / size)
    return [n] if n > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else []


def run_bounds(*columns: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal keys, and the end."""
    n = len(columns[0])
    change = np.zeros(n, bool)
    for c in columns:
        change[1:] |= c[1:] != c[:-1]
    change[:1] = True
    return np.append(np.flatnonzero(change), n)


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For nodes 0..n-1 and links a-b, the least node of each node's component."""
    label = np.arange(n)
    while True:
        new = label.copy()
        np.minimum.at(new, a, label[b])
        np.minimum.at(new, b, label[a])
        new = new[new]
        if np.array_equal(new, label):
            return label
        label = new
