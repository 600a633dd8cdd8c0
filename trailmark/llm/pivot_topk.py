"""Exact top-k by inner product over a pivot-distance index.

With M the largest norm, every vector x gets one more component sqrt(M^2 - |x|^2) and every
query a zero, so the largest inner product is the least distance:
d(q, x)^2 = |q|^2 + M^2 - 2 q.x. The index keys each vector by its nearest pivot and its
distance to it; a pivot's vectors are sorted by distance and cut into annuli. A query first
searches the annulus it lies in, which gives a bound on its k-th score; then it goes to those
annuli only whose triangle-inequality bound |d(q, p) - d(x, p)| still allows that score, and
within an annulus it expands over slices of the sorted distances and leaves out the slices
that the bound rules out.

Pivots come from a bounded sample, their number grows with the vectors'; every vector is indexed. An annulus of many vectors is
dealt to several blocks by a hash, so no task holds it. Queries go to blocks by the annuli's
summary (pivots times annuli, a bounded table).

Defined results: vectors that are null, empty or hold null or non-finite components take no
part; a vector is a candidate of queries of its width only; rows with the query's own id are
not its candidates; repeated query ids are asked once (least vector), repeated candidates
stand as often as they occur; a null id takes no part; scores are exact integers, those beyond a
long are held at its limits; a component whose scaled value is beyond a double counts as not finite;
an empty table has no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, uniform

PIVOTS, MOST_PIVOTS, SAMPLE, STEPS, BLOCK, SLICE = 16, 256, 4_096, 256, 4_096, 512
#: float64 sums of integers are exact below.
EXACT = 2.0**52
SLACK = 1e-9
#: The least and the greatest score.
LEAST, MOST = -(1 << 63), (1 << 63) - 1


def integers(vectors: DataFrame, scale: float) -> DataFrame:
    """(vec_id, v, norm2): floor(scale * x) of each component as doubles, for vectors that take part."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep, out, norms = [], [], []
            for k, v in enumerate(b["embedding"]):
                if not v.is_valid or not b["vec_id"][k].is_valid or not len(v.values) or v.values.null_count:
                    continue
                x = v.values.to_numpy(zero_copy_only=False).astype(np.float64)
                x = np.floor(scale * x)
                if not np.isfinite(x).all():
                    continue
                keep.append(k)
                out.append(x.tobytes())
                norms.append(float(x @ x))
            yield pa.RecordBatch.from_arrays([b["vec_id"].take(pa.array(keep, pa.int64())), pa.array(out, pa.binary()), pa.array(norms, pa.float64())], ["vec_id", "v", "norm2"])

    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInArrow(each, "vec_id long, v binary, norm2 double")


def pivots_for(n: int) -> int:
    """How many pivots n vectors have: an eighth of the root of n, within bounds."""
    return min(max(PIVOTS, math.isqrt(n) // 8), MOST_PIVOTS)


def choose_pivots(sample: np.ndarray, n: int, rounds: int = 4) -> np.ndarray:
    """n centres of a sample: far points first, then a few rounds of means."""
    centres = [sample[0]]
    least = ((sample - centres[0]) ** 2).sum(axis=1)
    while len(centres) < min(n, len(sample)) and least.max() > 0:
        centres.append(sample[int(least.argmax())])
        least = np.minimum(least, ((sample - centres[-1]) ** 2).sum(axis=1))
    out = np.stack(centres)
    for _ in range(rounds):
        nearest = _distances(sample, out).argmin(axis=1)
        out = np.stack([sample[nearest == k].mean(axis=0) if (nearest == k).any() else c for k, c in enumerate(out)])
    return out


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.stack([np.sqrt(((x - p) ** 2).sum(axis=1)) for p in pivots], axis=1)


def _by_width(raw: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    sizes = np.array([len(x.as_buffer()) // 8 for x in raw], np.int64)
    return {int(w): (at, np.stack([np.frombuffer(raw[int(k)].as_buffer()) for k in at])) for w in np.unique(sizes) for at in [np.flatnonzero(sizes == w)]}


def _keyed(rows: DataFrame, pivots: dict[int, np.ndarray], top2: float) -> DataFrame:
    """rows with width, nearest pivot, distance and its step. pivots: by width, with the further component."""
    step = 2 * np.sqrt(max(top2, 1.0)) / STEPS  # no two points are further apart than 2 M

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for width, (at, x) in _by_width(b["v"]).items():
                part = b.take(pa.array(at))
                full = np.concatenate([x, np.sqrt(np.maximum(top2 - part["norm2"].to_numpy(), 0))[:, None]], axis=1)
                d = _distances(full, pivots.get(width, np.zeros((1, width + 1))))
                near = d.argmin(axis=1)
                dist = d[np.arange(len(d)), near]
                new = [pa.array(np.full(len(d), width), pa.int32()), pa.array(near, pa.int32()), pa.array(dist), pa.array((dist / step).astype(np.int32))]
                yield pa.RecordBatch.from_arrays([*part.columns, *new], [*b.schema.names, "width", "pivot", "dist", "step"])

    return rows.mapInArrow(each, "vec_id long, v binary, norm2 double, width int, pivot int, dist double, step int")


def _annuli(steps: list) -> list[dict]:
    """Neighbouring steps of a pivot joined to annuli of at least half a block."""
    out: list[dict] = []
    for r in sorted(steps, key=lambda r: (r["width"], r["pivot"], r["step"])):
        last = out[-1] if out else None
        if last and (last["width"], last["pivot"]) == (r["width"], r["pivot"]) and last["n"] < BLOCK // 2:
            last["steps"].append(r["step"])
            last["n"] += r["n"]
            last["high"] = r["high"]
        else:
            out.append({"width": r["width"], "pivot": r["pivot"], "steps": [r["step"]], "n": r["n"], "low": r["low"], "high": r["high"]})
    for k, a in enumerate(out):
        a["id"], a["blocks"] = k, -(-a["n"] // BLOCK)
    return out


class _Best:
    """The k best (score, id) of each query of a chunk: higher scores, then smaller ids."""

    def __init__(self, k: int, bound: np.ndarray):
        self.k, self.bound = k, bound.copy()
        self.scores: list[np.ndarray] = [np.zeros(0, np.int64) for _ in bound]
        self.ids: list[np.ndarray] = [np.zeros(0, np.int64) for _ in bound]

    def add(self, q: int, scores: np.ndarray, ids: np.ndarray) -> None:
        hit = scores >= self.bound[q]
        if not hit.any():
            return
        scores, ids = np.concatenate([self.scores[q], scores[hit]]), np.concatenate([self.ids[q], ids[hit]])
        if len(scores) > self.k:
            order = np.lexsort((ids, ~scores))[: self.k]  # ~ reverses the order of integers, the least included
            scores, ids = scores[order], ids[order]
        if len(scores) == self.k:
            self.bound[q] = max(self.bound[q], scores.min())
        self.scores[q], self.ids[q] = scores, ids


def _products(q: np.ndarray, x: np.ndarray, exact: bool) -> np.ndarray:
    """Inner products of integer vectors as 64-bit integers; exact: none exceeds what doubles hold."""
    if exact:
        return (q @ x.T).astype(np.int64)
    q, x = ([[int(c) for c in row] for row in m.tolist()] for m in (q, x))
    return np.array([[min(max(sum(a * b for a, b in zip(p, r, strict=True)), LEAST), MOST) for r in x] for p in q], np.int64)


def _search(k: int, top2: float):
    """Top k of the queries in every block that they were sent to."""
    exact = top2 < EXACT

    def expand(data: dict, queries: pa.Table) -> Iterator[pa.RecordBatch]:
        q = np.stack([np.frombuffer(x.as_buffer()) for x in queries["v"]])
        own, norm2, near, bound = (queries[c].to_numpy() for c in ("vec_id", "norm2", "dist", "bound"))
        best = _Best(k, bound)
        slices = [(s, min(s + SLICE, len(data["ids"]))) for s in range(0, len(data["ids"]), SLICE)]
        middle = float(np.median(near))
        for s, e in sorted(slices, key=lambda x: max(data["dist"][x[0]] - middle, middle - data["dist"][x[1] - 1], 0)):
            gap = np.maximum(np.maximum(data["dist"][s] - near, near - data["dist"][e - 1]), 0)
            ceiling = (norm2 + top2 - gap**2) / 2
            active = np.flatnonzero((ceiling + SLACK * (norm2 + top2) + 1 >= best.bound) | (best.bound == LEAST))
            if not len(active):
                continue
            x = data["v"][s:e]
            scores = _products(q[active], x, exact)
            for row, a in zip(scores, active.tolist(), strict=True):
                other = data["ids"][s:e] != own[a]
                best.add(a, row[other], data["ids"][s:e][other])
        n = [len(x) for x in best.ids]
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(own, n)), pa.array(np.concatenate(best.ids)), pa.array(np.concatenate(best.scores))], ["query_id", "vec_id", "score"])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, data = None, [], None
        for whole in batches:
            keys, kinds = whole["block"].to_numpy(), whole["kind"].to_numpy()
            edges = np.flatnonzero((keys[1:] != keys[:-1]) | (kinds[1:] != kinds[:-1])) + 1
            for s, e in zip([0, *edges.tolist()], [*edges.tolist(), len(keys)], strict=True):
                if s == e:
                    continue
                part = whole.slice(s, e - s)
                if keys[s] != block:
                    block, held, data = keys[s], [], None
                if kinds[s] == 0:
                    held.append(part)
                    continue
                if data is None and held:
                    t = pa.Table.from_batches(held)
                    order = np.argsort(t["dist"].to_numpy(), kind="stable")
                    data = {"ids": t["vec_id"].to_numpy()[order], "dist": t["dist"].to_numpy()[order], "v": np.stack([np.frombuffer(x.as_buffer()) for x in t["v"]])[order]}
                if data is not None:
                    for at in range(0, e - s, 256):
                        yield from expand(data, pa.Table.from_batches([part.slice(at, 256)]))

    return each


def search(vectors: DataFrame, is_query, k: int, scale: float = 1024.0) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best inner products of floor(scale * x) for the rows where is_query holds."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "pivot")
    rows = scratch.save(integers(vectors, scale), "integers")
    facts = rows.agg(F.max("norm2").alias("top2"), F.count("*").alias("n")).first()
    top2, total = facts["top2"] or 0.0, facts["n"]
    samples: dict[int, list] = {}
    for r in rows.where(uniform("vec_id", "v") < min(1.0, SAMPLE / max(total, 1))).select("v", "norm2").toLocalIterator():
        x = np.frombuffer(r["v"])
        samples.setdefault(len(x), []).append(np.append(x, np.sqrt(max(top2 - r["norm2"], 0))))
    pivots = {w: choose_pivots(np.stack(x), pivots_for(total)) for w, x in samples.items()}
    index = scratch.save(_keyed(rows, pivots, top2), "index")
    steps = index.groupBy("width", "pivot", "step").agg(F.count("*").alias("n"), F.min("dist").alias("low"), F.max("dist").alias("high")).collect()
    annuli = _annuli(steps)
    first = np.cumsum([0] + [a["blocks"] for a in annuli]).tolist()
    for a, at in zip(annuli, first, strict=False):
        a["start"] = at
    listed = [(a["width"], a["pivot"], s, a["id"], first[a["id"]], a["blocks"]) for a in annuli for s in a["steps"]]
    table = spark.createDataFrame(listed, "width int, pivot int, step int, annulus int, first long, blocks int")
    placed = index.join(F.broadcast(table), ["width", "pivot", "step"])
    data = placed.select((F.col("first") + F.pmod(F.xxhash64("vec_id", "v"), F.col("blocks"))).alias("block"), F.lit(0).alias("kind"), "vec_id", "v", "norm2", "dist", F.lit(LEAST).alias("bound"))
    data = scratch.save(data, "blocks")
    asked = placed.where(is_query).groupBy("vec_id").agg(F.min(F.struct("v", "norm2", "width", "annulus", "first", "dist")).alias("q")).select("vec_id", "q.*")
    asked = scratch.save(asked, "queries")
    columns = ["block", "kind", "vec_id", "v", "norm2", "dist", "bound"]

    def answers(queries: DataFrame) -> DataFrame:
        both = data.select(columns).unionByName(queries.select(columns)).repartition("block").sortWithinPartitions("block", "kind")
        return scratch.save(both.mapInArrow(_search(k, top2), "query_id long, vec_id long, score long"), "answers")

    home = asked.select(F.col("first").alias("block"), F.lit(1).alias("kind"), "vec_id", "v", "norm2", "dist", F.lit(LEAST).alias("bound"))
    near = answers(home)
    ranked = near.withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    kth = ranked.where(F.col("r") == k).select("query_id", F.col("score").alias("bound"))
    bounded = asked.join(kth, asked["vec_id"] == kth["query_id"], "left").select("vec_id", "v", "norm2", "width", "first", F.coalesce("bound", F.lit(LEAST)).alias("bound"))

    rings = {w: [a for a in annuli if a["width"] == w] for w in {a["width"] for a in annuli}}  # at most pivots times steps a width

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each query once for every block that its bound still allows."""
        for whole in batches:
            for s in range(0, whole.num_rows, 256):
                b = whole.slice(s, 256)
                widths = b["width"].to_numpy()
                for width in np.unique(widths).tolist():
                    part = b.take(pa.array(np.flatnonzero(widths == width)))
                    norm2, bound, own = (part[c].to_numpy() for c in ("norm2", "bound", "first"))
                    x = np.stack([np.append(np.frombuffer(v.as_buffer()), 0.0) for v in part["v"]])
                    low, high, pivot, start, blocks = (np.array([a[c] for a in rings[width]]) for c in ("low", "high", "pivot", "start", "blocks"))
                    d = _distances(x, pivots.get(width, np.zeros((1, width + 1))))[:, pivot]
                    gap = np.maximum(np.maximum(low - d, d - high), 0)
                    most = (norm2 + top2)[:, None]
                    q, ring = np.nonzero(((most - gap**2) / 2 + SLACK * most + 1 >= bound[:, None]) | (bound == LEAST)[:, None])
                    n = blocks[ring]
                    q, ring = np.repeat(q, n), np.repeat(ring, n)
                    block = start[ring] + np.arange(len(ring)) - np.repeat(np.cumsum(n) - n, n)
                    other = block != own[q]
                    q, ring, block = q[other], ring[other], block[other]
                    for at in range(0, len(q), 10_000):  # a vector a block, so few at a time
                        p = slice(at, at + 10_000)
                        rows = part.take(pa.array(q[p]))
                        yield pa.RecordBatch.from_arrays([pa.array(block[p]), pa.array(np.ones(len(rows), np.int32)), rows["vec_id"], rows["v"], rows["norm2"], pa.array(d[q[p], ring[p]]), rows["bound"]], columns)

    rest = bounded.mapInArrow(spread, "block long, kind int, vec_id long, v binary, norm2 double, dist double, bound long")
    found = near.unionByName(answers(rest))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op9_pivot_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best of every query whose id is divisible by 100."""
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 100 == 0, 10)


def oracle() -> str:
    """All inner products in DuckDB SQL."""
    return """
    WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
               WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
    SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 10
    """
