"""Sessions, states and searches whose keys, queries or documents fit no single task."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from trailmark.operators import ordered, search
from trailmark.streaming import transcripts as ts

KINDS = ["partial", "partial", "partial", "final", "error"]


@pytest.fixture()
def small_ranges(monkeypatch):
    monkeypatch.setattr(ordered, "RANGE_ROWS", 400)


def events(spark, n, keys):
    rng = random.Random(4)
    rows = [(k, rng.choice(keys), rng.randrange(40_000), rng.choice(KINDS), f"t{k}", rng.choice([216, 7])) for k in range(n)]
    return spark.createDataFrame(rows, "event_id long, key string, s long, kind string, text string, code int").withColumn("ts", F.timestamp_seconds("s")).drop("s"), rows


def plain_transcripts(rows, gap):
    out, state = [], {}
    for e, key, s, kind, text, code in sorted(rows, key=lambda r: (r[1] or "", r[2], r[0])):
        if kind == "error" and code in ts.BENIGN_CODES:
            continue
        x = state.setdefault(key, {"n": 0, "at": None, "final": True, "session": 0, "said": None})
        if x["final"] or s - x["at"] > gap:
            if x["n"]:
                out.append((key, x["session"], *x["said"], x["n"]))
            x["session"], x["n"] = x["session"] + 1, 0
        x["at"], x["final"] = s, kind == "final"
        if kind != "error":
            x["n"], x["said"] = x["n"] + 1, (text, "final" if kind == "final" else "timeout")
    return sorted([*out, *((k, x["session"], *x["said"], x["n"]) for k, x in state.items() if x["n"])], key=repr)


def test_sessions_of_a_key_over_many_ranges(spark, small_ranges):
    df, rows = events(spark, 6_000, ["hot"] * 8 + ["a", "b", None])
    got = sorted((tuple(r) for r in ts.transcripts(df, 20, ["key"]).collect()), key=repr)
    assert got == plain_transcripts(rows, 20)
    assert ts.transcripts(df.limit(0), 20, ["key"]).count() == 0


def test_states_of_a_key_over_many_ranges(spark, small_ranges):
    names = ["listen", "stop", "ask", "answer", "done", "fail", "reset", "other", None]
    rng = random.Random(5)
    rows = [(rng.choice([1] * 9 + [2, 3]), k, rng.choice(names)) for k in range(9_000)]
    df = spark.createDataFrame(rows, "key long, s long, event string").withColumn("ts", F.timestamp_seconds("s"))
    want = {}
    for key, _, event in rows:
        at = want.get(key, "idle")
        want[key] = ts.STATES.get((at, event), at)
    assert dict(map(tuple, ts.final_state(df).collect())) == want


def test_a_stream_by_event_time_ends_the_same_sessions(spark, tmp_path):
    ts.use_rocksdb(spark)
    df, rows = events(spark, 1_500, ["x", "y", "z"])
    end = spark.createDataFrame([(-1, None, "partial", None, 7)], "event_id long, key string, kind string, text string, code int").withColumn("ts", F.timestamp_seconds(F.lit(90_000)))
    df.unionByName(end).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    query = ts.finish_by_event_time(stream, 20).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    query.awaitTermination()
    got = sorted((tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select("key", "session", "text", "ended_by", "n_events").collect()), key=repr)
    assert got == plain_transcripts(rows, 20)


def test_more_queries_than_are_broadcast(spark, monkeypatch):
    for name, size in (("QUERY_BLOCK", 7), ("JOIN_BLOCK", 11), ("GROUP", 60), ("STRIP", 5), ("BATCH", 32)):
        monkeypatch.setattr(search, name, size)
    rng = np.random.default_rng(1)
    x = rng.standard_normal((300, 12))
    x[200:] = x[100:200]  # ties
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(900, None), (901, [1.0]), (902, [float("nan")] * 12)]
    corpus = spark.createDataFrame(rows, "id long, vector array<double>").repartition(4)
    queries = corpus.where("id < 50 or id > 899").select(F.col("id").alias("query_id"), "vector")
    got = {(r.query_id, r["rank"]): r.id for r in search.top_k(corpus, queries, 4, skip_self=True).collect()}
    scores = np.round(x[:50] @ x.T, 12)
    scores[np.arange(50), np.arange(50)] = -np.inf
    for k in range(50):
        assert [got[k, r] for r in range(1, 5)] == np.argsort(-scores[k], kind="stable")[:4].tolist()
    assert set(q for q, _ in got) == set(range(50))
    monkeypatch.setattr(search, "QUERY_BLOCK", 4_096)
    assert {(r.query_id, r["rank"]): r.id for r in search.top_k(corpus, queries, 4, skip_self=True).collect()} == got


def test_many_queries_meet_the_vectors_in_many_cells(spark):
    corpus = spark.range(70_000).selectExpr("id", "array(double(id % 7), 1.0D) AS vector")
    queries = corpus.where("id < 5").select(F.col("id").alias("query_id"), "vector")
    found = search.joined_top_k(corpus, queries, 1, skip_self=True).collect()
    assert len(found) == 3 * 5  # a row a query and cell: no task has more than GROUP vectors


def test_the_best_of_many_batches(monkeypatch):
    monkeypatch.setattr(search, "BATCH", 16)
    rng = np.random.default_rng(3)
    x = np.round(rng.standard_normal((200, 6)), 1) * 1e6
    x[150:] = x[100:150]
    x[5] = np.nan
    x[6] = [-np.inf] + [0] * 5
    best = search.Best(np.arange(0, 20), np.abs(x[:20]) + 1, 3, skip_self=True)
    best.see(np.arange(200), x)
    scores = np.round((np.abs(x[:20]) + 1) @ x.T, 12)
    for k in range(20):
        scores[k, k] = np.nan
        order = [j for j in np.lexsort((np.arange(200), -scores[k])) if not np.isnan(scores[k, j])]
        assert best.ids[best.query == k].tolist() == order[:3]


@pytest.mark.filterwarnings("ignore::RuntimeWarning")
def test_scores_of_odd_vectors_are_those_of_double_precision(monkeypatch):
    monkeypatch.setattr(search, "BATCH", 64)
    monkeypatch.setattr(search, "STRIP", 16)
    monkeypatch.setattr(search, "RESCORED", 7)
    rng = np.random.default_rng(8)
    x = rng.standard_normal((400, 24))
    x[100:200] = x[0] + 1e-9 * x[100:200]  # nearer to each other than single precision tells apart
    x[200:250] = x[7]
    x[250:255] *= np.array([1e9, 1e-9, 1e-300, 0, 1e200])[:, None]
    x[300, 3], x[301, 4], x[302, 5], x[303] = np.nan, np.inf, -np.inf, np.nan
    asked = np.r_[0:20, 110:120, 205:210, 250:256, 300:304]
    names = rng.permutation(400)
    best = search.Best(names[asked], x[asked], 5, skip_self=True)
    for s in range(0, 400, 150):
        best.see(names[s : s + 150], x[s : s + 150])
    scores = np.round(np.einsum("ij,kj->ik", x[asked], x), 12)
    for k, a in enumerate(asked):
        exact = np.round([np.einsum("j,j", x[a], v) for v in x], 12)
        assert np.allclose(exact, scores[k], rtol=1e-9, atol=1e-11, equal_nan=True)
        order = [j for j in np.lexsort((names, -exact)) if not np.isnan(exact[j]) and j != a][:5]
        got = best.ids[best.query == k].tolist()
        assert len(got) == len(order)
        place = {n: j for j, n in enumerate(names.tolist())}
        assert np.allclose(exact[[place[n] for n in got]], exact[order], rtol=1e-12, atol=2e-12)
        if a in (7, *range(200, 250)):  # equal vectors tie: the smaller ids
            assert got == names[order].tolist() and len({7, *range(200, 250)} & set(order)) >= 2


def test_copies_of_a_vector_are_not_all_compared(monkeypatch):
    added, add = [], search.Best._add
    monkeypatch.setattr(search.Best, "_add", lambda self, row, ids, scores: (added.append(len(row)), add(self, row, ids, scores)))
    x = np.random.default_rng(2).standard_normal((3_000, 8))
    x[:2_000] = x[0]
    best = search.Best(np.arange(0, 3_000, 3), x[::3], 2, skip_self=True)
    best.see(np.arange(3_000), x)
    assert best.ids[best.query == 0].tolist() == [1, 2] and best.ids[best.query == 1].tolist() == [0, 1] and len(best.ids) == 2_000
    assert sum(added) < 40_000  # of 2 million pairs


def test_copies_with_one_id_count_as_before():
    x = np.ones((30, 4))
    best = search.Best(np.array([0]), x[:1], 3, skip_self=True)
    best.see(np.r_[np.zeros(20, np.int64), 5, 5, 6, 7, 8, 9, 9, 9, 9, 9], x)
    assert best.ids.tolist() == [5, 5, 6]


def test_documents_of_many_segments_are_chunked_as_in_one_piece(spark, monkeypatch):
    from trailmark.operators import chunking

    monkeypatch.setattr(chunking, "SEGMENT", 150)
    rng = random.Random(6)

    def line():
        x = rng.random()
        if x < 0.02:
            return f"{rng.randint(1, 9)}.{rng.randint(1, 9)} Wound Care"
        return " ".join(rng.choice(["salve", "wrap", "rest", "cool", "lift"]) + str(rng.randint(0, 99)) for _ in range(250 if x < 0.03 else rng.randint(1, 30)))

    docs = {"long": 60, "short": 2, "plain": 25, "none": 1}
    pages = [(d, p + 1, "" if d == "none" else "\n".join("head of all" if n == 0 and p % 2 else line() if d != "plain" else "word " * 20 + str(rng.random()) for n in range(rng.randint(5, 40)))) for d, n in docs.items() for p in range(n)]
    pages += [("even", p + 1, "\n".join("alike words stand here always the same ones" + f" {p} {n}" for n in range(40))) for p in range(20)]
    df = spark.createDataFrame(pages, "doc string, page int, text string")
    whole = df.groupBy("doc").agg(F.transform(F.sort_array(F.collect_list(F.struct("page", "text"))), lambda x: x["text"]).alias("pages"))
    want = sorted(map(tuple, chunking.chunk_documents(whole).collect()))
    got = sorted(tuple(r) for r in chunking.chunk_pages(df).select("doc", "seq", "text", "section", "page_start", "page_end", "token_count").collect())
    assert got == want and len(want) > 60
    assert chunking.chunk_pages(df.limit(0)).count() == 0


def test_lines_are_folded_by_their_fields_names(spark):
    from trailmark.operators import chunking

    line = "struct<page: int, line: string, heading: string, tokens: int>"
    plain = spark.createDataFrame([("a", [(1, "2. Wound Care", "2. Wound Care", 3), (1, "cover it", None, 120), (2, "hold it", None, 130)]), ("b", [])], f"doc string, lines array<{line}>")
    numbered = plain.withColumn("lines", F.transform("lines", lambda x, k: F.struct(k.alias("number"), x["tokens"].alias("tokens"), x["heading"].alias("heading"), x["line"].alias("line"), x["page"].alias("page"))))
    want = sorted(map(tuple, chunking.fold_documents(plain).collect()))
    assert sorted(map(tuple, chunking.fold_documents(numbered).collect())) == want and [w[2] for w in want] == ["cover it", "hold it"]


def test_row_numbers_of_a_key_over_many_ranges(spark, small_ranges):
    rng = random.Random(7)
    rows = [(rng.choice(["a"] * 8 + ["b", None]), k) for k in rng.sample(range(100_000), 5_000)]
    got = {(r.k, r.v): r.n for r in ordered.number(spark.createDataFrame(rows, "k string, v long"), ["k"], ["v"], "n").collect()}
    for key in ("a", "b", None):
        assert [got[key, v] for v in sorted(v for k, v in rows if k == key)] == list(range(sum(k == key for k, _ in rows)))
