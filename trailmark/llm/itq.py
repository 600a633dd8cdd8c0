"""Embedding near-duplicates by iterative quantisation.

Rotations that balance binary codes are learned on a bounded sample (alternating between the
codes and the orthogonal matrix that best maps the centred, whitened-order components to
them). The code bits are cut into substrings, one hash table each: vectors whose codes agree
on a substring share a bucket. Substring length follows the number of vectors, so that a
bucket of unlike vectors stays small; the number of tables (over several rotations from
different starts) follows from the target recall at the least similarity. Buckets are compared
with the original vectors in double precision, large ones in pairs of blocks.

Equal vectors are one class before the search. A pair that shares several buckets is counted
in the first table only, so links are counted without listing pairs.

Defined results: null, empty, zero and non-finite vectors link with nothing; vectors link only
within one width; rows that share a vec_id are vectors of their own; a null vec_id is a
component id only where there is no other; an empty table has no rows; extra columns are not carried.
A similarity so low that it takes more than ``TABLES`` tables is refused.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, block_pairs, components, local_roots, run_bounds, runs, uniform

SIMILARITY, TARGET_RECALL = 0.95, 0.98
#: The rotations are learned on about so many vectors at most.
SAMPLE, ITERATIONS = 10_000, 30
#: More tables have no number of their own.
TABLES = 1 << 12
#: Vectors of a block, and those of them that are compared with the other block at once.
BLOCK, STRIP = 1_024, 256


def unit(vector: np.ndarray) -> np.ndarray:
    return vector / np.linalg.norm(vector)


def learn_rotations(sample: np.ndarray, n_rotations: int, iterations: int = ITERATIONS, seed: int = 7) -> list[np.ndarray]:
    """Rotations of iterative quantisation, one a start.

    The vectors are not centred: cosine is about the origin, and a centre amid a large group
    of near copies would give its members unlike codes.
    """
    d = sample.shape[1]
    axes = np.linalg.eigh(sample.T @ sample)[1][:, ::-1] if len(sample) else np.eye(d)
    projected, out = sample @ axes, []
    for k in range(n_rotations):
        rotation, _ = np.linalg.qr(np.random.default_rng(seed + k).standard_normal((d, d)))
        for _ in range(iterations if len(sample) else 0):
            codes = np.where(projected @ rotation >= 0, 1.0, -1.0)
            left, _, right = np.linalg.svd(codes.T @ projected)
            rotation = (left @ right).T
        out.append(axes @ rotation)
    return out


def plan_tables(n: int, width: int, similarity: float, target_recall: float) -> tuple[int, int, int]:
    """(bits of a substring, tables, rotations) for n vectors of a width."""
    bits = min(width, 24, max(8, math.ceil(math.log2(max(n, 2)))))
    agree = (1 - math.acos(similarity) / math.pi) ** bits
    tables = math.ceil(math.log(1 - target_recall) / math.log(1 - agree))
    if tables > TABLES:
        raise ValueError(f"{tables} tables for {n} vectors at {similarity}: ask for fewer links or a lower recall")
    return bits, tables, math.ceil(tables / (width // bits))


class Coder:
    """Substring codes of unit vectors: (n, tables) numbers, for each width in the sample."""

    def __init__(self, samples: dict[int, np.ndarray], n: int, similarity: float, target_recall: float):
        self.n, self.similarity, self.target_recall, self.models = n, similarity, target_recall, {}
        for width, sample in samples.items():
            self._fit(width, sample)

    def _fit(self, width: int, sample: np.ndarray) -> None:
        bits, tables, rotations = plan_tables(self.n, width, self.similarity, self.target_recall)
        self.models[width] = (bits, tables, learn_rotations(sample, rotations))

    def codes(self, units: np.ndarray) -> np.ndarray:
        width = units.shape[1]
        if width not in self.models:  # too rare for the sample: rotations of no data
            self._fit(width, np.zeros((0, width)))
        bits, tables, turns = self.models[width]
        signs = np.concatenate([(units @ t >= 0)[:, : width // bits * bits] for t in turns], axis=1)
        parts = signs.reshape(len(units), -1, bits)[:, :tables]
        return (parts * (1 << np.arange(bits, dtype=np.int64))).sum(axis=2)


def _unit_rows(raw: pa.Array, kind: str) -> list[np.ndarray | None]:
    """Vectors at rest as doubles of length one; None for null."""
    return [None if not x.is_valid else _unit(np.frombuffer(x.as_buffer(), kind)) for x in raw]


def _unit(vector: np.ndarray) -> np.ndarray:
    x = vector.astype(np.float64)
    return unit(x / np.abs(x).max())  # no overflow of squares


def _prepared(vectors: DataFrame, kind: str) -> DataFrame:
    """(vec_id, digest, vector at rest) with nulls for vectors that link with nothing."""
    id_kind = vectors.schema["vec_id"].dataType.simpleString()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            digests, raw = [], []
            for v in b["embedding"]:
                x = None if not v.is_valid else v.values.to_numpy(zero_copy_only=False).astype(kind) + 0  # -0 becomes 0
                ok = x is not None and len(x) and np.isfinite(x).all() and np.any(x) and np.isfinite(u := _unit(x)).all()
                raw.append(x.tobytes() if ok else None)
                digests.append(hashlib.blake2b(u.tobytes(), digest_size=16).digest() if ok else None)
            yield pa.RecordBatch.from_arrays([b["vec_id"], pa.array(digests, pa.binary()), pa.array(raw, pa.binary())], ["vec_id", "digest", "vector"])

    return vectors.select("vec_id", "embedding").mapInArrow(each, f"vec_id {id_kind}, digest binary, vector binary")


def _coded(groups: DataFrame, coder: Coder, kind: str) -> DataFrame:
    """groups with the codes of all tables, and the buckets that these are."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 1000):
                b = whole.slice(start, 1000)
                units = _unit_rows(b["vector"], kind)
                widths = np.array([len(u) for u in units])
                for width in np.unique(widths).tolist():
                    at = np.flatnonzero(widths == width)
                    part = b.take(pa.array(at))
                    codes = coder.codes(np.stack([units[k] for k in at])).astype(np.int32)
                    table = np.arange(codes.shape[1], dtype=np.int64)
                    buckets = (np.int64(width) << 44) + (table << 32) + codes
                    yield pa.RecordBatch.from_arrays([part["digest"], part["n"], part["vector"], pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(list(buckets), pa.list_(pa.int64()))], ["digest", "n", "vector", "codes", "buckets"])

    return groups.select("digest", "n", "vector").mapInArrow(each, "digest binary, n long, vector binary, codes binary, buckets array<long>")


def _linked(similarity: float, kind: str):
    """Links and local roots of the vectors of each bucket (block pair)."""

    def pairs(s: int, e: int, side: np.ndarray, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        left, right = np.flatnonzero(side[s:e] == 0), np.flatnonzero(side[s:e] == 1)
        within = not len(right)
        right = left if within else right
        found = []
        for at in range(0, len(left), STRIP):
            strip = left[at : at + STRIP]
            a, b = np.nonzero(units[strip] @ units[right].T >= similarity)
            a, b = strip[a], right[b]
            found.append((a[a < b], b[a < b]) if within else (a, b))
        return np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches, ["bucket", "pi", "pj"]):
            table = table.combine_chunks()
            bucket, pi, pj, side, n = (table[k].to_numpy() for k in ("bucket", "pi", "pj", "side", "n"))
            digests, raw, codes = table["digest"].combine_chunks(), table["vector"].combine_chunks(), table["codes"].combine_chunks()
            bounds = run_bounds(bucket, pi, pj)
            out: dict[str, list] = {"digest": [], "links": [], "root": []}
            for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                if e - s < 2 or pi[s] != pj[s] and (side[s] == side[e - 1]):
                    continue
                units = np.frombuffer(b"".join(x.as_buffer() for x in raw.slice(s, e - s)), kind).reshape(e - s, -1).astype(np.float64)
                units /= np.abs(units).max(axis=1)[:, None]
                units /= np.linalg.norm(units, axis=1)[:, None]
                a, b = pairs(s, e, side, units)
                if not len(a):
                    continue
                at = int(bucket[s] >> 32 & TABLES - 1)  # an earlier table where both fall together has counted the pair
                mine = np.stack([np.frombuffer(codes[k].as_buffer(), np.int32, at) for k in range(s, e)])
                first = np.ones(len(a), bool)
                for t in range(at):
                    first &= mine[a, t] != mine[b, t]
                a, b = a[first], b[first]
                links = np.zeros(e - s, np.int64)
                np.add.at(links, a, n[s:e][b])
                np.add.at(links, b, n[s:e][a])
                root = local_roots(e - s, a, b)
                for k in np.flatnonzero(links).tolist():
                    out["digest"].append(digests[s + k].as_py())
                    out["links"].append(int(links[k]))
                    out["root"].append(digests[s + int(root[k])].as_py())
            yield pa.RecordBatch.from_arrays([pa.array(out["digest"], pa.binary()), pa.array(out["links"], pa.int64()), pa.array(out["root"], pa.binary())], ["digest", "links", "root"])

    return each


def near_duplicates(vectors: DataFrame, similarity: float = SIMILARITY, target_recall: float = TARGET_RECALL) -> DataFrame:
    """vectors(vec_id, embedding) -> (vec_id, n_links, component_id, kept), a row for every row."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "itq")
    kind = "<f4" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "<f8"
    rows = scratch.save(_prepared(vectors, kind), "prepared")
    groups = rows.where("digest is not null").groupBy("digest").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"), F.first("vector").alias("vector"))
    groups = scratch.save(groups, "groups")
    total = groups.count()
    share = min(1.0, SAMPLE / max(total, 1))
    widths: dict[int, list] = {}
    for r in groups.where(uniform("digest") < share).select("vector").toLocalIterator():
        v = _unit(np.frombuffer(r["vector"], kind))
        widths.setdefault(len(v), []).append(v)
    coder = Coder({w: np.stack(v) for w, v in widths.items()}, total, similarity, target_recall)
    coded = scratch.save(_coded(groups, coder, kind), "codes")
    # buckets are found and dealt by keys alone; vectors travel once, to buckets that hold another
    keys = coded.select("digest", F.explode("buckets").alias("bucket"))
    sizes = scratch.save(keys.groupBy("bucket").agg(F.count("*").alias("c")).where("c > 1"), "sizes")
    dealt = block_pairs(keys.join(sizes, "bucket"), "bucket", "digest", "c", BLOCK)
    paired = dealt.join(coded.select("digest", "n", "codes", "vector"), "digest")
    paired = paired.repartition("bucket", "pi", "pj").sortWithinPartitions("bucket", "pi", "pj", "side")
    found = paired.select("bucket", "pi", "pj", "side", "digest", "n", "codes", "vector").mapInArrow(_linked(similarity, kind), "digest binary, links long, root binary")
    found = scratch.save(found, "links")
    roots = components(scratch, found.select(F.col("digest").alias("a"), F.col("root").alias("b")))
    reached = roots.join(groups.select(F.col("digest").alias("node"), "rep"), "node")
    least = scratch.save(reached.groupBy("root").agg(F.min("rep").alias("component_id")), "components")
    links = found.groupBy("digest").agg(F.sum("links").alias("links"))
    result = groups.select("digest", "rep", "n").join(links, "digest", "left").join(roots.join(least, "root").select(F.col("node").alias("digest"), "component_id"), "digest", "left")
    result = scratch.save(result.select("digest", F.coalesce("component_id", "rep").alias("component_id"), (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")), "result")
    out = rows.select("vec_id", "digest").join(result, "digest", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op1_itq_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicates among all vectors at cosine 0.95."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def oracle() -> str:
    """All pairs and recursion in DuckDB SQL."""
    return """
    WITH RECURSIVE e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
    ok AS (SELECT vec_id, v FROM e WHERE v IS NOT NULL AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_dot_product(v, v) > 0),
    l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.v, b.v) >= 0.95),
    reach(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN l ON l.a = r.b),
    c AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY 1)
    SELECT vec_id, (SELECT count(*) FROM l WHERE l.a = c.vec_id) AS n_links, component_id, vec_id = component_id AS kept FROM c
    """
