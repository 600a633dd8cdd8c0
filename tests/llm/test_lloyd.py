"""op12 against the rounds written out with whole numbers."""

import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from trailmark.llm import lloyd

NAN, INF = float("nan"), float("inf")


def brute(rows):
    kept = [(i, [math.floor(4096 * x) if abs(x) < 1e300 else math.floor(x) * 4096 for x in v], lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for width in {len(v) for _, v, _ in kept}:
        mine = [r for r in kept if len(r[1]) == width]
        at = [width * p // 8 for p in range(9)]
        parts = [[v[at[p] : at[p + 1]] for p in range(8)] for _, v, _ in mine]
        first = sorted(range(len(mine)), key=lambda k: (mine[k][0] is None, mine[k][0] or 0))[:16]
        books = [[list(parts[k][p]) for k in first] for p in range(8)]

        def assign():
            return [[min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), j) for j, e in enumerate(books[p])) for p, x in enumerate(v)] for v in parts]

        for _ in range(6):
            codes = assign()
            for p in range(8):
                for j in range(len(books[p])):
                    own = [parts[k][p] for k in range(len(mine)) if codes[k][p][1] == j]
                    if own:
                        books[p][j] = [sum(c) // len(own) for c in zip(*own, strict=True)]
        codes = assign()
        h = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
        out += [(i, bytes(j for _, j in c).hex(), sum(d for d, _ in c), lab, h) for (i, _, lab), c in zip(mine, codes, strict=True)]
    sums = {}
    for _, _, e, lab, _ in out:
        sums[lab] = sums.get(lab, 0) + e
    fits = lambda x: x if x < 1 << 63 else None
    return sorted(((i, c, fits(e), fits(sums[lab]), h) for i, c, e, lab, h in out), key=repr)


def ours(spark, rows, tmp_path, kind="array<double>"):
    spark.createDataFrame(rows, f"vec_id long, embedding {kind}, label int").withColumn("row", F.lit(1)).withColumn("codes", F.lit("x")).repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    found = lloyd.op12_delta_lloyd(spark, str(tmp_path))
    return sorted(((r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in found.collect()), key=repr)


def test_rounds_against_whole_numbers(spark, tmp_path):
    rng = random.Random(1)
    centres = [[rng.uniform(-1, 1) for _ in range(16)] for _ in range(20)]
    rows = [(k, [c + rng.gauss(0, 0.2) for c in rng.choice(centres)], rng.choice([1, 2, None])) for k in range(300)]
    rows += [rows[5], (900, None, 1), (901, [NAN] * 16, 1), (902, [INF] * 16, None), (903, [None] + [0.0] * 15, 2)]
    assert ours(spark, rows, tmp_path) == brute(rows)


def test_widths_ids_and_large_components(spark, tmp_path):
    rng = random.Random(2)
    rows = [(k if k % 5 else None, [rng.uniform(-1, 1) for _ in range(8)], k % 3) for k in range(1, 40)]
    rows += [(100 + k, [rng.uniform(-1, 1) for _ in range(11)], None) for k in range(5)] + [(200 + k, [], 4) for k in range(3)]
    got = ours(spark, rows, tmp_path / "a")
    assert [r[:4] for r in got if r[0] and r[0] < 100] and len(got) == len(rows)
    assert [r for r in got if r[0] and 100 <= r[0] < 200] == [r for r in brute(rows) if r[0] and 100 <= r[0] < 200]
    big = [(k, [1e30 * (k % 3), *[0.5 * k] * 7], k % 2) for k in range(30)] + [(99, [1e306] + [0.0] * 7, 9), (98, [3e9] * 8, 8)]
    assert ours(spark, big, tmp_path / "b") == brute(big)


def test_floats_and_no_rows(spark, tmp_path):
    rows = [(k, [float(k % 7) / 8] * 8, 1) for k in range(20)]
    assert ours(spark, rows, tmp_path / "a", "array<float>") == brute(rows)
    assert ours(spark, [], tmp_path / "b") == ours(spark, [(1, None, 1)], tmp_path / "c") == []


@pytest.mark.parametrize("rounds", [0, 1, 20])
def test_rounds_end_when_nothing_moves(spark, rounds):
    rows = [(k, [float(k % 4)] * 8, 0) for k in range(50)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert lloyd.quantise(df, rounds).agg(F.sum("error")).first()[0] == 0


def test_a_round_joins_without_a_shuffle(spark):
    from trailmark.llm.common import Scratch

    df = spark.createDataFrame([(k, [float(k)] * 8, 0) for k in range(40)], "vec_id long, embedding array<double>, label int")
    tables = lloyd.Bucketed(Scratch(spark, "plan"), 3)
    rows = tables.save(lloyd._prepared(df).withColumn("row", F.monotonically_increasing_id()).repartition(3, "row"), "vectors")
    codes = tables.save(spark.table(rows).select("row", F.lit(b"12345678").alias("codes")), "codes")
    joined = spark.table(rows).join(spark.table(codes).hint("shuffle_hash"), "row", "left")
    assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
    tables.drop(rows)
    tables.drop(codes)
