import math

import numpy as np
import pytest

from trailmark.llm import itq


def brute(rows, similarity=0.95):
    """Links of every row, and the least id that links lead to."""
    good = [k for k, (_, v) in enumerate(rows) if v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    links = {k: set() for k in range(len(rows))}
    for i in good:
        for j in good:
            if i != j and len(rows[i][1]) == len(rows[j][1]):
                a, b = np.array(rows[i][1], float), np.array(rows[j][1], float)
                if a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= similarity:
                    links[i].add(j)
    out = []
    for k in range(len(rows)):
        seen, todo = {k}, [k]
        while todo:
            for x in links[todo.pop()] - seen:
                seen.add(x)
                todo.append(x)
        out.append((rows[k][0], len(links[k]), min(rows[x][0] for x in seen)))
    return out


def clusters(n, copies, width, noise, seed):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((n, width))
    rows = [b + noise * rng.standard_normal(width) for b in base for _ in range(copies)]
    return [(k, [float(np.float32(x)) for x in v]) for k, v in enumerate(rows)]


def test_links_and_components_against_all_pairs(spark):
    rows = clusters(60, 4, 32, 0.15, 3)
    rows += [(1000 + k, list(rows[0][1])) for k in range(40)]  # copies
    rows += [(2000, None), (2001, [0.0] * 32), (2002, [float("nan")] * 32), (2003, [float("inf")] + [1.0] * 31), (2004, []), (2005, [None] + [1.0] * 31), (2006, [1.0, 2.0]), (2007, [2.0, 4.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("vec_id", "embedding", "'x' AS digest", "1 AS n")
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in itq.near_duplicates(df).collect())
    want = sorted(brute(rows))
    found, there = sum(g[1] for g in got), sum(w[1] for w in want)
    assert [g[0] for g in got] == [w[0] for w in want]
    assert all(g[1] <= w[1] for g, w in zip(got, want, strict=True)) and found >= 0.97 * there
    assert [g for g in got if g[0] >= 2000] == [w for w in want if w[0] >= 2000]


def test_recall_at_the_edge_of_the_similarity(spark):
    rng = np.random.default_rng(4)
    rows = []
    for k in range(400):
        a = rng.standard_normal(64)
        a /= np.linalg.norm(a)
        b = rng.standard_normal(64)
        b -= (b @ a) * a
        b /= np.linalg.norm(b)
        rows += [(2 * k, a.tolist()), (2 * k + 1, (0.951 * a + math.sqrt(1 - 0.951**2) * b).tolist())]
    got = itq.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sum(r.n_links for r in got) >= 0.95 * 800


def test_a_group_of_near_copies_larger_than_a_block(spark):
    rows = clusters(1, 700, 16, 0.1, 9)
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in itq.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect())
    want = sorted(brute(rows))
    assert sum(g[1] for g in got) >= 0.97 * sum(w[1] for w in want)
    assert [g[2] for g in got] == [w[2] for w in want]


def test_empty_table_and_null_ids(spark):
    assert itq.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    rows = itq.near_duplicates(spark.createDataFrame([(None, [1.0, 0.0]), (4, [1.0, 0.0]), (4, [1.0, 0.0])], "vec_id long, embedding array<float>")).collect()
    assert sorted((str(r.vec_id), r.n_links, r.component_id, r.kept) for r in rows) == [("4", 2, 4, True), ("4", 2, 4, True), ("None", 2, 4, False)]


def test_more_tables_than_a_byte_counts(spark):
    assert 256 < itq.plan_tables(5_000_000, 64, 0.85, 0.98)[1] <= itq.TABLES
    with pytest.raises(ValueError, match="tables"):
        itq.plan_tables(1 << 24, 64, 0.5, 0.98)
