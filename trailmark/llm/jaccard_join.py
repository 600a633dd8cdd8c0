"""N-gram Jaccard join by chosen paths.

Every text is the set of its word shingles, and every set has a signature of minima. A run
starts with all sets in one node; a node is split on one or two coordinates that its id picks
(1 / similarity of them on average), each child holding the sets that share the minimum there,
until a node is small, or keeps most of its parent (its sets are alike), or the path is long.
Nodes that stop are compared by brute force in blocks: first by signatures, which leaves sets
with a partner that may reach the similarity, then these with their whole sets. Several runs with
other coordinates bring the recall to the target; their number follows from the length of the
paths (``runs_for``): a pair is lost more often the more splits it goes through, so sets that
were still in a large node after ``SHALLOW`` splits have further runs among themselves, each set as
many as its own longest path takes (a pair has those that both have). All runs advance together,
level by level.

Equal sets are one class before the join. Leaves with the same members are compared once; a
pair that meets in several leaves is counted in the least of them, so that links are counted
without listing pairs; a block hands on one edge a set, to the root of its local component.

Words: runs of characters other than ASCII white space, of the lower-cased text. A text with
fewer words than a shingle is one shingle; a text without words links with nothing. Null
texts have no words. A very long text is a set like others, its shingles are made twice and
travel only if a signature is like its own. Rows that share a text are copies of each other, also
with one doc_id; a null doc_id counts as a copy but is no class id unless its class has no other.
Extra columns are not carried, but for one named row.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, block_pairs, components, local_roots, run_bounds, runs

WORDS, SIMILARITY, TARGET_RECALL = 5, 0.8, 0.999
COORDINATES, LEAF, DEPTH = 64, 96, 8
#: Sets of a block: where signatures are compared, and where whole sets are; the bytes of a set of a full block, on average.
SIGNATURE_BLOCK, BLOCK, SET_BYTES = 4_096, 1_024, 8_192
#: Signatures that are compared with a block's at once.
STRIP = 256
#: Splits that most paths end within: all sets have the runs that these take, those whose paths are longer have more.
SHALLOW = 2
_MULTIPLY = np.random.default_rng(1).integers(1, 1 << 63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = np.random.default_rng(2).integers(0, 1 << 63, COORDINATES, dtype=np.uint64)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_sets(texts: list[str | None], words: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's shingles."""
    split = [t.lower().encode().split() if t else [] for t in texts]
    flat = np.array([w for s in split for w in s] or [b""], dtype=object)
    hashed = pd.util.hash_array(np.array([w.decode("utf-8", "surrogatepass") for w in flat], dtype=object), categorize=True)
    out, at = [], 0
    for s in split:
        h = hashed[at : at + len(s)]
        at += len(s)
        k = min(words, len(s))
        if not k:
            out.append(np.zeros(0, np.uint64))
            continue
        total = np.full(len(h) - k + 1, k, np.uint64)
        for i in range(k):
            total = total * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - k + 1 + i]
        out.append(np.unique(_mix(total)))
    return out


def signature(shingles: np.ndarray) -> np.ndarray:
    """The least of each coordinate's hashes."""
    least = np.full(COORDINATES, np.iinfo(np.uint32).max, np.uint32)
    for at in range(0, len(shingles), 2048):
        part = shingles[at : at + 2048, None] * _MULTIPLY + _ADD
        np.minimum(least, (part >> np.uint64(32)).astype(np.uint32).min(axis=0), out=least)
    return least


def _digest(shingles: np.ndarray) -> bytes | None:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest() if len(shingles) else None


def signatures(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, digest of the shingle set, signature); null for texts without words.
    Columns row and text_hash (long) of docs are kept."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    row = [c for c in ("row", "text_hash") if c in docs.columns]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                b = whole.slice(at, 500)
                sets = shingle_sets(b["text"].to_pylist(), words)
                sig = [signature(s).astype(np.int32) if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays([b["doc_id"], *(b[c] for c in row), pa.array([_digest(s) for s in sets], pa.binary()), pa.array(sig, pa.list_(pa.int32()))], ["doc_id", *row, "digest", "sig"])

    return docs.select("doc_id", *row, "text").mapInArrow(each, f"doc_id {kind}, {''.join(f'{c} long, ' for c in row)}digest binary, sig array<int>")


def _children(rows: DataFrame, similarity: float) -> DataFrame:
    """(digest, node, size of the parent) for rows (digest, sig, node, c)."""
    first = F.pmod(F.xxhash64("node", F.lit(1)), F.lit(COORDINATES)).cast("int")
    second = F.pmod(first + 1 + F.pmod(F.xxhash64("node", F.lit(2)), F.lit(COORDINATES - 1)), F.lit(COORDINATES)).cast("int")
    two = F.pmod(F.xxhash64("node", F.lit(3)), F.lit(1 << 20)) < (1 / similarity - 1) * (1 << 20)
    at = rows.withColumn("at", F.explode(F.when(two, F.array(first, second)).otherwise(F.array(first))))
    return at.select("digest", F.xxhash64("node", "at", F.get("sig", F.col("at"))).alias("node"), F.col("c").alias("parent"))


def runs_for(depth: int, similarity: float, target: float) -> int:
    """Runs that find a pair of the least similarity with the target chance, if its paths have so many splits.

    A pair that agrees on a share p of the coordinates stays together in a split on one of them
    with chance p, and 1 / similarity are drawn on average; the share varies as the
    coordinates are a sample.
    """
    two = 1 / similarity - 1
    share = np.arange(COORDINATES + 1) / COORDINATES
    together = np.ones(COORDINATES + 1)
    for _ in range(depth):
        apart = 1 - share * together
        together = 1 - (1 - two) * apart - two * apart**2
    weight = np.array([math.comb(COORDINATES, k) * similarity**k * (1 - similarity) ** (COORDINATES - k) for k in range(COORDINATES + 1)])
    n = 1
    while (weight * (1 - (1 - together) ** n)).sum() < target:
        n += 1
    return n


def _walk(sets: DataFrame, total: int, numbers: range, similarity: float, scratch: Scratch) -> tuple[list[DataFrame], list[DataFrame]]:
    """(rows (digest, node, parent) of each level, nodes (node, c, x, s) that stop there) of runs over sets(digest, sig).

    A column runs of sets, if there, is the number of the run that a set has no more.
    """
    stop = F.col("runs") if "runs" in sets.columns else F.lit(numbers.stop)
    start = sets.select("digest", "sig", F.lit(total).cast("long").alias("c"), F.explode(F.sequence(F.lit(numbers.start), stop - 1)).alias("run"))
    rows = _children(start.withColumn("node", F.xxhash64(F.lit("root"), "run")), similarity)
    levels, ends = [], []
    for depth in range(1, DEPTH + 1):
        rows = scratch.save(rows, "level")
        of = F.xxhash64("digest")
        nodes = rows.groupBy("node").agg(F.count("*").alias("c"), F.max("parent").alias("parent"), F.bit_xor(of).alias("x"), F.sum(F.shiftright(of, 20)).alias("s")).where("c > 1")
        stop = (F.col("c") <= LEAF) | (F.col("c") >= similarity * F.col("parent")) | F.lit(depth == DEPTH)
        nodes = scratch.save(nodes.withColumn("stop", stop), "nodes")
        levels.append(rows)
        ends.append(nodes.where("stop").select("node", "c", "x", "s"))
        large = nodes.where("not stop").select("node", "c")
        if large.isEmpty():
            break
        rows = _children(rows.select("digest", "node").join(large, "node").join(sets.select("digest", "sig").hint("merge"), "digest"), similarity)
    return levels, ends


def leaves(sets: DataFrame, similarity: float, target: float, scratch: Scratch) -> DataFrame:
    """Chosen paths over sets(digest, sig): rows (digest, node, c) of leaves with two members or more."""
    union = lambda frames: frames[0] if len(frames) == 1 else union([frames[0].unionByName(frames[1]), *frames[2:]])
    n_runs = runs_for(SHALLOW, similarity, target)
    levels, ends = _walk(sets, sets.count(), range(n_runs), similarity, scratch)
    if len(levels) > SHALLOW:
        # by the longest path of a set, never fewer than one more
        by_depth = [max(n_runs + 1, runs_for(d, similarity, target)) for d in range(SHALLOW + 1, len(levels) + 1)]
        reached = union([r.select("digest", F.lit(d).alias("depth")) for d, r in enumerate(levels[SHALLOW:])])
        deep = reached.groupBy("digest").agg(F.max("depth").alias("depth"))
        deep = scratch.save(deep.select("digest", F.get(F.array(*map(F.lit, by_depth)), F.col("depth")).alias("runs")), "deep")
        again = _walk(sets.join(deep.hint("merge"), "digest"), deep.count(), range(n_runs, by_depth[-1]), similarity, scratch)
        levels, ends = levels + again[0], ends + again[1]
    kept = scratch.save(union(ends).groupBy("c", "x", "s").agg(F.min("node").alias("node")).select("node", "c"), "leaves")
    return scratch.save(union([r.select("digest", "node") for r in levels]).join(kept, "node"), "members")


def least_agreement(similarity: float) -> int:
    """Coordinates that signatures of similar sets share at least, five standard deviations below the mean."""
    return max(1, math.floor(COORDINATES * similarity - 5 * math.sqrt(COORDINATES * similarity * (1 - similarity))))


def _plausible(similarity: float):
    """(digest, node) of sets that have a partner in their leaf whose signature agrees with theirs."""
    least = least_agreement(similarity)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches, ["node", "pi", "pj"]):
            table = table.combine_chunks()
            node, pi, pj, side = (table[k].to_numpy() for k in ("node", "pi", "pj", "side"))
            sig = table["sig"].combine_chunks().flatten().to_numpy().reshape(-1, COORDINATES)
            keep = np.zeros(len(node), bool)
            bounds = run_bounds(node, pi, pj)
            for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                left, right = s + np.flatnonzero(side[s:e] == 0), s + np.flatnonzero(side[s:e] == 1)
                if pi[s] == pj[s]:
                    right = left
                if not len(left) or not len(right):
                    continue
                for at in range(0, len(left), STRIP):
                    part = left[at : at + STRIP]
                    agree = np.zeros((len(part), len(right)), np.uint8)
                    for k in range(COORDINATES):
                        agree += sig[part, k][:, None] == sig[right, k]
                    like = (agree >= least) & (part[:, None] != right)
                    keep[part[like.any(axis=1)]] = True
                    keep[right[like.any(axis=0)]] = True
            at = pa.array(np.flatnonzero(keep))
            yield pa.RecordBatch.from_arrays([table["digest"].combine_chunks().take(at), pa.array(node[keep])], ["digest", "node"])

    return each


def _overlaps(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the sets at left with those at right."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    values, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    common = counts > 1
    place = np.cumsum(common) - 1
    keep = common[inverse]
    owner, column = owner[keep], place[inverse[keep]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    out = np.zeros((len(left), len(right)), np.float32)
    width, last = 4096, int(common.sum())
    for at in range(0, last, width):
        a, b = np.searchsorted(column, [at, at + width])
        m = np.zeros((len(sets), min(width, last - at)), np.float32)
        m[owner[a:b], column[a:b] - at] = 1
        out += m[left] @ m[right].T
    return out.astype(np.int64)


def _compare(node: int, rows: dict, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs (places in rows) that this leaf owns, within a block or between two."""
    sides = rows["side"]
    left, right = np.flatnonzero(sides == 0), np.flatnonzero(sides == 1)
    within = not rows["pair"]
    if within:
        right = left
    if not len(left) or not len(right):
        return left[:0], left[:0]
    size = np.array([len(s) for s in rows["sets"]])
    shared = _overlaps(rows["sets"], left, right)
    jaccard = shared / (size[left][:, None] + size[right][None, :] - shared)
    a, b = np.nonzero(np.triu(jaccard >= similarity, 1) if within else jaccard >= similarity)
    a, b = left[a], right[b]
    if not len(a):
        return a, b
    kinds: dict[tuple, int] = {}
    kind = np.array([kinds.setdefault(tuple(x), len(kinds)) for x in rows["leaves"]])
    lists = [set(x) for x in kinds]
    combos, which = np.unique(kind[a] * len(lists) + kind[b], return_inverse=True)
    owned = np.array([min(lists[c // len(lists)] & lists[c % len(lists)]) == node for c in combos.tolist()])[which]
    return a[owned], b[owned]


def _compare_leaves(similarity: float):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches, ["node", "pi", "pj"]):
            table = table.combine_chunks()
            node, pi, pj = (table[k].to_numpy() for k in ("node", "pi", "pj"))
            digest, lists, n, side = table["digest"].to_pylist(), table["leaves"].to_pylist(), table["n"].to_numpy(), table["side"].to_numpy()
            bounds = run_bounds(node, pi, pj)
            out: dict[str, list] = {"digest": [], "links": [], "root": []}
            for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                if e - s < 2:
                    continue
                places = list({digest[k]: k for k in range(s, e)}.values())  # one row a set, should its text stand under one doc_id twice
                sets = [np.frombuffer(table["shingles"][k].as_buffer(), np.uint64) for k in places]
                rows = {"side": side[places], "pair": pi[s] != pj[s], "sets": sets, "leaves": [lists[k] for k in places]}
                a, b = _compare(int(node[s]), rows, similarity)
                if not len(a):
                    continue
                mult, links = n[places], np.zeros(len(places), np.int64)
                np.add.at(links, a, mult[b])
                np.add.at(links, b, mult[a])
                root = local_roots(len(places), a, b)
                for k in np.flatnonzero(links):
                    out["digest"].append(digest[places[k]])
                    out["links"].append(int(links[k]))
                    out["root"].append(digest[places[root[k]]])
            yield pa.RecordBatch.from_arrays([pa.array(out["digest"], pa.binary()), pa.array(out["links"], pa.int64()), pa.array(out["root"], pa.binary())], ["digest", "links", "root"])

    return each


def join(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY, target_recall: float = TARGET_RECALL, class_key: bool = False) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, class_id, n_links), a row for every row of docs.

    n_links: other documents whose shingle sets have at least the similarity; class_id: the
    least doc_id that links lead to, the document's own included. A column row (long) of docs
    is kept, to tell rows of one doc_id apart; class_key, if asked for, tells classes of one
    class_id apart (null: a text without words).
    """
    # the merge hints keep one plan at every size: none of these sides is small where it matters
    scratch = Scratch(docs.sparkSession, "jaccard")
    kind = docs.schema["doc_id"].dataType.simpleString()
    row = [c for c in docs.columns if c == "row"]
    docs = docs.select("doc_id", *row, "text", F.xxhash64("text").alias("text_hash"))
    signed = scratch.save(signatures(docs, words), "signed")
    sets = signed.where("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n"), F.first("sig").alias("sig"), F.min(F.struct("text_hash", "doc_id")).alias("one"))
    sets = scratch.save(sets, "sets")
    members = leaves(sets, similarity, target_recall, scratch)
    dealt = block_pairs(members.join(sets.select("digest", "sig").hint("merge"), "digest"), "node", "digest", "c", SIGNATURE_BLOCK)
    dealt = dealt.repartition("node", "pi", "pj").sortWithinPartitions("node", "pi", "pj")
    alike = dealt.select("node", "pi", "pj", "side", "digest", "sig").mapInArrow(_plausible(similarity), "digest binary, node long").distinct()
    alike = scratch.save(alike, "alike")
    sizes = scratch.save(alike.groupBy("node").agg(F.count("*").alias("c")), "sizes")
    members = scratch.save(alike.join(sizes, "node"), "members")
    own = members.groupBy("digest").agg(F.sort_array(F.collect_set("node")).alias("leaves"))
    candidates = scratch.save(own.join(sets.select("digest", "one", "n").hint("merge"), "digest"), "candidates")
    # one text of each set, by its hash and doc_id: neither repeated ids nor rows without one meet others' texts
    there = docs.where("text is not null").hint("merge")
    texts = there.join(candidates, (F.col("text_hash") == F.col("one.text_hash")) & F.col("doc_id").eqNullSafe(F.col("one.doc_id"))).select("digest", "n", "leaves", "text")

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                b = whole.slice(at, 500)
                digests = b["digest"].to_pylist()
                b = b.filter(pa.array([d != x for d, x in zip(digests, [last, *digests[:-1]], strict=True)], pa.bool_()))  # repeated rows follow one another
                last = digests[-1]
                found = shingle_sets(b["text"].to_pylist(), words)
                same = [_digest(s) == d for s, d in zip(found, b["digest"].to_pylist(), strict=True)]  # hashes of texts may be equal
                kept = b.filter(pa.array(same, pa.bool_()))
                made = [s.tobytes() for s, x in zip(found, same, strict=True) if x]
                yield pa.RecordBatch.from_arrays([kept["digest"], kept["n"], kept["leaves"], pa.array(made, pa.binary()), pa.array([len(x) for x in made], pa.int64())], ["digest", "n", "leaves", "shingles", "bytes"])

    whole = scratch.save(texts.mapInArrow(again, "digest binary, n long, leaves array<long>, shingles binary, bytes long"), "shingles")
    # a leaf of large sets has more blocks
    large = whole.where(F.col("bytes") > SET_BYTES).select("bytes", F.explode("leaves").alias("node")).groupBy("node").agg(F.ceil(F.sum("bytes") / SET_BYTES).alias("of_large"))
    weighed = members.join(scratch.save(large, "large"), "node", "left").select("digest", "node", (F.col("c") + F.coalesce("of_large", F.lit(0))).alias("c"))
    dealt = block_pairs(weighed.join(whole.hint("merge"), "digest"), "node", "digest", "c", BLOCK)
    dealt = dealt.repartition("node", "pi", "pj").sortWithinPartitions("node", "pi", "pj")
    found = scratch.save(dealt.select("node", "pi", "pj", "side", "digest", "n", "leaves", "shingles").mapInArrow(_compare_leaves(similarity), "digest binary, links long, root binary"), "links")
    roots = components(scratch, found.select(F.col("digest").alias("a"), F.col("root").alias("b")))
    reached = roots.join(sets.select(F.col("digest").alias("node"), "rep"), "node")
    least = scratch.save(reached.groupBy("root").agg(F.min("rep").alias("class_id")), "classes")
    links = found.groupBy("digest").agg(F.sum("links").alias("links"))
    classes = roots.join(least, "root").select(F.col("node").alias("digest"), "class_id", "root")
    result = sets.join(links, "digest", "left").join(classes, "digest", "left")
    keyed = [F.coalesce("root", "digest").alias("class_key")] if class_key else []
    result = result.select("digest", *keyed, F.coalesce("class_id", "rep").alias("class_id"), (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    result = scratch.save(result, "result")
    out = signed.select("doc_id", *row, "digest").join(result, "digest", "left")
    return out.select(F.col("doc_id").cast(kind), *row, *["class_key"] * class_key, F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class and number of links of every document at five-word shingles and 0.8."""
    return join(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("class_id")))


def oracle() -> str:
    """Every pair with a common shingle, and components by recursion, in DuckDB SQL."""
    return r"""
    WITH RECURSIVE w AS (
      SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[ \t-\r]+'), lambda x: x <> '') AS words FROM documents),
    s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [list_aggregate(words, 'string_agg', ' ')]
            ELSE list_transform(range(1, len(words) - 3), lambda i: list_aggregate(words[i:i + 4], 'string_agg', ' ')) END) AS sh FROM w),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
    p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b USING (sh) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
    l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE c / (x.n + y.n - c)::DOUBLE >= 0.8),
    reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, l.b FROM reach r JOIN l ON l.a = r.b),
    cls AS (SELECT a AS doc_id, min(b) AS class_id FROM reach GROUP BY 1)
    SELECT d.doc_id, class_id, (SELECT count(*) FROM l WHERE l.a = d.doc_id) AS n_links, d.doc_id = class_id AS kept
    FROM documents d JOIN cls USING (doc_id)
    """
