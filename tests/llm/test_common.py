import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from trailmark.llm.common import Scratch, block_pairs, components, held, local_roots, run_bounds, runs


def roots(n, links):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        up[b] = a
    return [find(x) for x in range(n)]


def test_components_of_chains_hubs_and_loops(spark):
    rng = random.Random(1)
    name = {k: f"{rng.getrandbits(64):016x}" for k in range(400)}
    links = [(k, k + 1) for k in range(99)] + [(100, k) for k in range(101, 250)] + [(260, 261), (261, 262), (262, 260)] + [(rng.randrange(270, 330), rng.randrange(270, 330)) for _ in range(40)]
    edges = spark.createDataFrame([(name[a], name[b]) for a, b in links] * 2 + [(name[350], name[350])], "a string, b string")
    got = {r.node: r.root for r in components(Scratch(spark, "test"), edges).collect()}
    want = roots(400, links)
    touched = {x for a, b in links if a != b for x in (a, b)}
    assert set(got) == {name[k] for k in touched}
    for a in touched:
        for b in touched:
            assert (got[name[a]] == got[name[b]]) == (want[a] == want[b])
    assert components(Scratch(spark, "test"), edges.limit(0)).count() == 0


def test_runs_are_never_split_and_keep_their_order():
    rng = np.random.default_rng(2)
    for size in (1, 3, 7, 50):
        k = np.sort(rng.integers(0, 12, 60))
        table = pa.table({"k": k, "j": np.zeros(60, np.int64), "v": np.arange(60)})
        parts = list(runs(iter(table.to_batches(max_chunksize=size)), ["k", "j"]))
        assert pa.concat_tables(parts)["v"].to_pylist() == list(range(60))
        seen = [set(p["k"].to_pylist()) for p in parts]
        assert sum(map(len, seen)) == len(set(k.tolist()))
    assert list(runs(iter([]), ["k"])) == []


def test_bounds_and_local_roots():
    assert run_bounds(np.array([1, 1, 2, 2]), np.array([0, 1, 1, 1])).tolist() == [0, 1, 2, 4]
    assert run_bounds(np.zeros(0)).tolist() == [0]
    rng = np.random.default_rng(3)
    a, b = rng.integers(0, 50, 30), rng.integers(0, 50, 30)
    assert local_roots(50, a, b).tolist() == roots(50, list(zip(a.tolist(), b.tolist(), strict=True)))


def test_every_pair_of_a_bucket_meets_in_exactly_one_block_pair(spark):
    rows = spark.range(90).select(F.lit(7).alias("key"), F.col("id").alias("member"), F.lit(90).alias("c"))
    met = {}
    for r in block_pairs(rows, "key", "member", "c", 20).collect():
        met.setdefault((r.pi, r.pj), []).append((r.member, r.side))
    pairs = []
    for (pi, pj), members in met.items():
        left, right = [m for m, s in members if s == 0], [m for m, s in members if s == 1]
        pairs += [(a, b) for a in left for b in left if a < b] if pi == pj else [tuple(sorted((a, b))) for a in left for b in right]
    assert len(pairs) == len(set(pairs)) == 90 * 89 // 2


def test_a_worker_keeps_one_thing():
    first = held("a", lambda: object())
    assert held("a", lambda: object()) is first
    held("b", lambda: object())
    assert held("a", lambda: object()) is not first
