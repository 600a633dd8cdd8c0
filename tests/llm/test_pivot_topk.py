import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from trailmark.llm import pivot_topk as pt


def brute(rows, every, k):
    ok = [(i, [math.floor(1024 * float(x)) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, v in ok:
        if q % every == 0:
            found = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in ok if i != q and len(w) == len(v))
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(found[:k])]
    return sorted(out)


def run(spark, rows, every=5, k=10):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("vec_id", "embedding", "1 AS score", "2 AS pivot")
    return sorted(tuple(r) for r in pt.search(df, F.col("vec_id") % every == 0, k).collect())


@pytest.mark.parametrize("shape", ["unit", "clusters", "norms", "ties", "large"])
def test_the_best_are_those_of_brute_force(spark, shape):
    rng = np.random.default_rng(6)
    x = rng.standard_normal((400, 8))
    if shape == "unit":
        x /= np.linalg.norm(x, axis=1)[:, None]
    elif shape == "clusters":
        x = 3 * rng.standard_normal((5, 8))[rng.integers(0, 5, 400)] + 0.05 * x
    elif shape == "norms":
        x *= rng.exponential(3, 400)[:, None]
    elif shape == "large":
        x = np.round(x * 1e4) + rng.integers(0, 2, x.shape) / 1024  # products beyond 2 ** 52, neighbours one apart
    else:
        x = np.round(x[rng.integers(0, 6, 400)])
    rows = [(k, v.tolist()) for k, v in enumerate(x)]
    assert run(spark, rows) == brute(rows, 5, 10)


def test_hard_rows(spark):
    rows = [(0, [1.0, 2.0]), (5, [1.0]), (7, [2.0]), (8, None), (9, [float("nan"), 1.0]), (10, []), (15, [None, 1.0]), (None, [1.0, 1.0]), (20, [0.0, 0.0]), (21, [float("inf"), 0.0])]
    assert run(spark, rows, k=3) == brute(rows, 5, 3)
    assert run(spark, []) == []


def test_a_crowded_annulus_in_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(pt, "BLOCK", 32)
    rng = np.random.default_rng(8)
    base = rng.standard_normal(16)
    rows = [(k, (base + 0.01 * rng.standard_normal(16)).tolist()) for k in range(300)] + [(1000 + k, base.tolist()) for k in range(200)]
    assert run(spark, rows, every=50) == brute(rows, 50, 10)


def test_scores_beyond_doubles_are_exact_and_beyond_longs_held(spark):
    rows = [(0, [1e4, 3.0]), (1, [1e5 + 1 / 1024, 7.0]), (2, [1e5, 7.0]), (3, [1e8, 0.0]), (4, [-1e8, 0.0])]
    want = brute(rows, 5, 10)
    assert any(abs(s) > 1 << 53 for *_, s in want)
    assert run(spark, rows) == want
    huge = run(spark, [(0, [3e9, 0.0]), (1, [3e9, 0.0]), (2, [-3e9, 0.0])])
    assert [(i, s) for _, _, i, s in huge] == [(1, pt.MOST), (2, pt.LEAST)]


def test_a_large_component_goes_its_way(spark):
    rng = np.random.default_rng(4)
    rows = [(k, (rng.standard_normal(4) * 10.0 ** rng.integers(0, 7)).tolist()) for k in range(120)]
    assert run(spark, rows) == brute(rows, 5, 10)


def test_pivots_grow_and_no_rows(spark):
    assert [pt.pivots_for(n) for n in (0, 10_000, 1_000_000, 10**9)] == [16, 16, 125, 256]
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert pt.search(df, F.col("vec_id") % 2 == 0, 3).count() == 0
