"""Exact top-k search over unit vectors with a confidence gate.

Scores are dot products in double precision, compared to twelve decimals, so that equal vectors tie
whatever the order of their sums; ties go to the smaller id, and a score that is no number is no hit.

Up to ``QUERY_BLOCK`` queries are sent to the tasks as one matrix, the corpus is scanned once where
it lies, and every task hands on at most k rows a query. More queries never meet on the driver: they
are dealt to blocks, the corpus to groups, and every block meets every group in a task that holds
one block of queries and streams its group past it (see ``joined_top_k``).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TOP_K, THRESHOLD, DIGITS = 3, 0.35, 4
#: The most queries that are broadcast.
QUERY_BLOCK = 4_096
#: Beyond: queries of a block, vectors of a group; a task holds a block and a batch. A group is as
#: small as a block, so that the cells are many: one cell is one task's work.
JOIN_BLOCK, GROUP = 32_768, 32_768
#: Queries and vectors that are scored at once, and the decimals that scores are compared to.
STRIP, BATCH, COMPARED = 256, 2_048, 12
#: What a sum in single precision loses at most, for every product and of the vectors' lengths (twice the unit of rounding);
#: vectors longer than LONGEST aren't scored so. Scores that are worked out again at once.
LOST, LONGEST, RESCORED = 2.0**-23, 1e6, 1 << 15
#: Scores are rounded only where they come so near the k-th best, relative to it beyond one: more than rounding can add.
SLACK = 1e-11
HITS = "query_id long, id long, similarity double"


def _single(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows in single precision, their lengths)."""
    with np.errstate(all="ignore"):
        return matrix.astype(np.float32), np.linalg.norm(matrix, axis=1)


def _vectors(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(places of vectors of that width, their matrix)."""
    lengths = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    at = np.flatnonzero(lengths == width)
    if not len(at):
        return at, np.zeros((0, width))
    flat = column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False)
    return at, flat.astype(np.float64).reshape(-1, width)


def _few_alike(ids: np.ndarray, vectors: np.ndarray, most: int) -> np.ndarray:
    """Places of the vectors, of those that are equal bit for bit only the ones of the smallest ids, so many ids."""
    bits = np.ascontiguousarray(vectors).view(np.uint64)
    key = (bits * (np.arange(bits.shape[1], dtype=np.uint64) * np.uint64(2) + np.uint64(0x9E3779B97F4A7C15))).sum(axis=1, dtype=np.uint64)
    order = np.lexsort((ids, key))
    alike = np.append(False, key[order[1:]] == key[order[:-1]])
    at = np.flatnonzero(alike)
    alike[at] = (bits[order[at]] == bits[order[at - 1]]).all(axis=1)
    rank = np.cumsum(np.append(True, ids[order[1:]] != ids[order[:-1]]) | ~alike)  # distinct ids so far
    begins = np.flatnonzero(~alike)
    return np.sort(order[rank - np.repeat(rank[begins], np.diff(np.append(begins, len(order)))) < most])


class Best:
    """The k best hits of each query of a matrix, as vectors stream by.

    All scores are worked out in single precision first, a strip of queries and a batch of vectors that
    stay in the cache; those that can reach the k-th best so far, by the most that rounding can take
    away, are worked out again in double precision. Only these are compared and kept.
    """

    def __init__(self, names: np.ndarray, matrix: np.ndarray, k: int, skip_self: bool):
        self.names, self.matrix, self.k, self.skip_self = names, matrix, k, skip_self
        self.quick, self.lengths = _single(matrix)
        self._ids, self._scores = np.zeros((len(names), k), np.int64), np.full((len(names), k), -np.inf)
        self._there = np.zeros((len(names), k), bool)  # a query's hits stand in order from the left, the k-th best so far at the end

    @property
    def query(self) -> np.ndarray:
        return np.nonzero(self._there)[0]

    @property
    def ids(self) -> np.ndarray:
        return self._ids[self._there]

    @property
    def scores(self) -> np.ndarray:
        return self._scores[self._there]

    def see(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        if not len(ids):
            return
        some = _few_alike(ids, vectors, self.k + 1)  # copies tie, and ties go to the smaller ids: no query's hits are more, itself aside
        ids, vectors = ids[some], vectors[some]
        quick, lengths = _single(vectors)
        fits = lengths <= LONGEST
        for some, single in ((np.flatnonzero(fits), True), (np.flatnonzero(~fits), False)):
            for s in range(0, len(some), BATCH):
                at = some[s : s + BATCH]
                self._see(ids[at], vectors[at], quick[at] if single else None, lengths[at].max())

    def _see(self, ids: np.ndarray, vectors: np.ndarray, quick: np.ndarray | None, longest: float) -> None:
        for q in range(0, len(self.names), STRIP):
            lengths, least = self.lengths[q : q + STRIP], self._scores[q : q + STRIP, -1]
            if quick is not None and (lengths <= LONGEST).all():
                scores, lost = self.quick[q : q + STRIP] @ quick.T, lengths * (longest * LOST * (vectors.shape[1] + 16))
            else:
                scores, lost = self.matrix[q : q + STRIP] @ vectors.T, np.zeros(len(lengths))
            new = np.flatnonzero(np.isneginf(least))
            if len(ids) > self.k and len(new):  # nothing to compare to yet: all that reach the batch's own k-th best
                known = np.where(np.isnan(scores[new]), -np.inf, scores[new])
                if self.skip_self:
                    known[ids[None, :] == self.names[q + new, None]] = -np.inf
                least = least.copy()
                least[new] = np.partition(known, len(ids) - self.k, axis=1)[:, len(ids) - self.k] - lost[new]
            bound = np.where(np.isfinite(least), least - lost - SLACK * np.maximum(1, np.abs(least)), least).astype(scores.dtype)
            reach = scores >= bound[:, None]  # what isn't a number reaches nothing
            some = np.flatnonzero(reach.any(axis=1))
            found = np.flatnonzero(reach[some])
            for s in range(0, len(found), RESCORED):
                row, column = np.divmod(found[s : s + RESCORED], len(ids))
                row = some[row] + q
                exact = np.round(np.einsum("ij,ij->i", self.matrix[row], vectors[column]), COMPARED)
                least = self._scores[row, -1]
                reached = (exact > least) | (exact == least) & ~(self._there[row, -1] & (self._ids[row, -1] <= ids[column]))
                if self.skip_self:
                    reached &= ids[column] != self.names[row]
                self._add(row[reached], ids[column[reached]], exact[reached])

    def _add(self, row: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        rows = np.unique(row)
        old = self._there[rows]
        query = np.append(np.repeat(rows, old.sum(axis=1)), row)
        ids, scores = np.append(self._ids[rows][old], ids), np.append(self._scores[rows][old], scores)
        order = np.lexsort((ids, -scores, query))
        query = query[order]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        kept = place < self.k
        at = query[kept], place[kept]
        self._ids[at], self._scores[at], self._there[at] = ids[order[kept]], scores[order[kept]], True

    def rows(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(self.names[self.query]), pa.array(self.ids), pa.array(self.scores)], ["query_id", "id", "similarity"])


def _scan(corpus: DataFrame, queries: list, k: int, skip_self: bool) -> DataFrame:
    """The k best of each task's part of the corpus for a block of queries of one width."""
    names = np.array([q["query_id"] for q in queries], np.int64)
    matrix = np.array([q["vector"] for q in queries], np.float64)
    held = corpus.sparkSession.sparkContext.broadcast((names, matrix))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(*held.value, k, skip_self)
        for b in batches:
            at, vectors = _vectors(b["vector"], best.matrix.shape[1])
            best.see(b["id"].to_numpy(zero_copy_only=False)[at], vectors)
        yield best.rows()

    return corpus.select(F.col("id").cast("long").alias("id"), "vector").mapInArrow(each, HITS)


def joined_top_k(corpus: DataFrame, queries: DataFrame, k: int, skip_self: bool) -> DataFrame:
    """The k best of each group of the corpus for any number of queries.

    Queries are dealt to blocks by their id and go to every group, vectors to groups and go to
    every block, of their width; cells of block and group are dealt to tasks, in which the
    queries come first.
    """
    sizes = lambda df: {r["width"]: r["n"] for r in df.groupBy(F.size("vector").alias("width")).agg(F.count("*").alias("n")).collect()}
    asked, there = sizes(queries), sizes(corpus)
    widths = sorted(asked.keys() & there.keys())
    if not widths:
        return corpus.sparkSession.createDataFrame([], HITS)
    count = lambda of, size: F.create_map(*(F.lit(x) for w in widths for x in (w, math.ceil(of[w] / size))))[F.col("width")]
    numbered = lambda df: df.withColumn("width", F.size("vector")).where(F.col("width").isin(widths)).withColumn("blocks", count(asked, JOIN_BLOCK)).withColumn("groups", count(there, GROUP))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    of = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    left = numbered(queries.select(F.col("query_id").alias("id"), "vector")).select("width", of("blocks").alias("block"), every("groups").alias("group"), F.lit(0).alias("side"), "id", "vector")
    right = numbered(corpus.select(F.col("id").cast("long").alias("id"), "vector")).select("width", every("blocks").alias("block"), of("groups").alias("group"), F.lit(1).alias("side"), "id", "vector")
    cells = left.select("*", F.col("vector").cast("array<double>").alias("v")).drop("vector").unionByName(right.select("*", F.col("vector").cast("array<double>").alias("v")).drop("vector"))
    cells = cells.repartition("width", "block", "group").sortWithinPartitions("width", "block", "group", "side")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, best, held = None, None, []
        for b in batches:
            keys = np.stack([b[c].to_numpy(zero_copy_only=False) for c in ("width", "block", "group", "side")], axis=1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
            for s, e in zip(cuts[:-1], cuts[1:], strict=True):
                if s == e:
                    continue
                now, side = tuple(keys[s, :3].tolist()), keys[s, 3]
                if now != cell:
                    if best is not None:
                        yield best.rows()
                    cell, best, held = now, None, []
                part = b.slice(s, e - s)
                ids = part["id"].to_numpy(zero_copy_only=False)
                _, vectors = _vectors(part["v"], now[0])
                if side == 0:
                    held.append((ids, vectors))
                    continue
                if best is None and held:
                    best = Best(np.concatenate([i for i, _ in held]), np.concatenate([v for _, v in held]), k, skip_self)
                if best is not None:
                    best.see(ids, vectors)
        if best is not None:
            yield best.rows()

    return cells.mapInArrow(each, HITS)


def top_k(corpus: DataFrame, queries: DataFrame, k: int = TOP_K, skip_self: bool = False) -> DataFrame:
    """corpus(id, vector) x queries(query_id, vector) -> (query_id, rank, id, similarity).

    Queries of another width than a vector don't meet it; k below one finds nothing.
    """
    found = corpus.sparkSession.createDataFrame([], HITS)
    if k > 0:
        asked = queries.where("vector is not null and query_id is not null").select(F.col("query_id").cast("long").alias("query_id"), "vector")
        first = asked.limit(QUERY_BLOCK + 1).collect()
        if len(first) > QUERY_BLOCK:
            found = joined_top_k(corpus.where("vector is not null"), asked, k, skip_self)
        else:
            by_width: dict[int, list] = {}
            for q in first:
                by_width.setdefault(len(q["vector"]), []).append(q)
            found = reduce(DataFrame.unionByName, [_scan(corpus, qs, k, skip_self) for qs in by_width.values()] or [found])
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "id", "similarity")


def gate(hits: DataFrame, queries: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row a query: result, and its hits in order where the best reaches the threshold.

    The threshold is inclusive and holds for the best hit alone.
    """
    best = F.max(F.when(F.col("rank") == 1, F.col("similarity")))
    row = F.struct("rank", "id", "similarity")
    gathered = hits.groupBy("query_id").agg(best.alias("best"), F.sort_array(F.collect_list(row)).alias("chunks"))
    out = queries.select("query_id").join(gathered, "query_id", "left")
    match = F.coalesce(F.col("best") >= threshold, F.lit(False))
    none = F.array().cast("array<struct<rank:int,id:bigint,similarity:double>>")
    return out.select("query_id", F.when(match, "match").otherwise("noConfidentMatch").alias("result"), F.when(match, F.col("chunks")).otherwise(none).alias("chunks"))


def search(corpus: DataFrame, texts: DataFrame, queries: DataFrame, k: int = TOP_K, threshold: float = THRESHOLD) -> DataFrame:
    """Gated hits with what is shown of them: (query_id, rank, id, citation, text, similarity).

    The texts(id, citation, text) are joined to the hits only.
    """
    return show(gate(top_k(corpus, queries, k), queries, threshold), texts)


def show(gated: DataFrame, texts: DataFrame) -> DataFrame:
    """The hits of a gate's rows with citation and text."""
    opened = gated.where("result = 'match'").select("query_id", F.inline("chunks"))
    shown = texts.where("citation is not null and text is not null").select("id", "citation", "text")
    return opened.join(shown, "id").select("query_id", "rank", "id", "citation", "text", "similarity")


def images_for_hits(hits: DataFrame, images: DataFrame) -> DataFrame:
    """Reference images of hit chunks in their order; empty images don't count."""
    some = images.where(F.length("bytes") > 0)
    return hits.select("chunk_id").distinct().join(some, "chunk_id").select("chunk_id", "species_slug", "ordinal", "license", "attribution", "source_url", "bytes").orderBy("chunk_id", "ordinal")


def rounded(similarity: str | Column = "similarity", digits: int = DIGITS) -> Column:
    return F.round(similarity, digits)
