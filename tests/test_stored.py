"""Stored corpora, pages and records: rebuilt in place, looked up without a shuffle, kept apart where they are bad."""

import glob
import hashlib
import os
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from trailmark.functions import embedder, safety
from trailmark.operators import chunking, corpus
from trailmark.sources import files


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_pack_is_rebuilt_in_place(spark, tmp_path):
    path = str(tmp_path / "chunks")
    rows = [(k, f"s{k % 3}", f"text {k}") for k in range(30)]
    corpus.write_by_source(spark.createDataFrame(rows, "id long, filename string, text string"), path)
    files_of = lambda: {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{path}/filename=s[12]/*")}
    before, pack = files_of(), spark.createDataFrame([(2, "b"), (1, "a")], "at int, text string")
    first = None
    for _ in range(2):
        assert corpus.rebuild_source(spark, path, "s0", pack, "at") == 2
        now = sorted(tuple(r) for r in spark.read.parquet(path).select("id", "filename", "text").collect())
        assert first in (None, now) and files_of() == before
        first = now
    assert [r for r in first if r[1] == "s0"] == [(30, "s0", "a"), (31, "s0", "b")] and len(first) == 22
    assert corpus.rebuild_source(spark, path, "s0", pack.limit(0), "at") == 0
    assert spark.read.parquet(path).where("filename = 's0'").count() == 0 and files_of() == before


def test_a_lookup_by_id_shuffles_only_what_is_wanted(spark, tmp_path):
    rows = spark.range(1_000).withColumn("text", F.concat(F.lit("t"), "id"))
    table = corpus.ById.write(rows, "lookup_test", 4, str(tmp_path / "by_id"))
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        found = table.find(spark.createDataFrame([(5, 1), (7, 2), (5, 3), (4_000, 4)], "id long, n int"))
        assert sorted((r.n, r.text) for r in found.collect()) == [(1, "t5"), (2, "t7"), (3, "t5")]
        text = plan(found)
        assert text.count("Exchange hashpartitioning") == text[: text.rindex("FileScan")].count("Exchange hashpartitioning") <= 1 or re.search(r"SelectedBucketsCount: 4 out of 4", text)
        assert "Bucketed: true" in text and "SortMergeJoin" not in text
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        table.drop()


def test_pages_that_fail_are_empty(spark):
    def extract(raw):
        if raw == "closed":
            raise OSError("can't be opened")

        def fail():
            raise RuntimeError("bad page")

        return [raw + "1", fail, None, lambda: raw + "4"]

    df = spark.createDataFrame([(1, "a"), (2, "closed"), (3, None)], "k int, raw string")
    assert sorted(map(tuple, files.page_rows(df, "raw", extract, ["k"]).collect())) == [(1, 1, "a1"), (1, 2, ""), (1, 3, ""), (1, 4, "a4")]
    assert [p() for p in files.html_pages("<article><p>a <b>b</b>\n c</p><p></p></article><p>no</p>")] == ["a b c", ""]
    with pytest.raises(ValueError, match="closed"):
        files.html_pages("<article><p>open</article>")[0]()


def test_kept_and_quarantined_lines_are_all_lines(spark, tmp_path):
    good = '{"messages":[{"role":"a","content":"x"},{"role":"b","content":"y"},{"role":"c","content":"z"}]}'
    lines = [good, good[:-4], "", "[1]", "null", '{"messages":[]}', '{"messages":"x"}', '{"other":1}', good]
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(str(tmp_path / "l"))
    kept, bad = files.sorted_records(spark, str(tmp_path / "l"))
    assert kept.count() == 2 and bad.count() == len(lines) - 2
    assert {r.reason for r in bad.where("line = ''").collect()} == {"blank"}
    assert "no JSON" in {r.reason for r in bad.where(F.col("line") == good[:-4]).collect()}


def test_running_heads_of_pages_in_pieces(spark):
    rows = [("d", p, n, line) for p in range(12) for n, line in enumerate(["head", f"own {p}", "twice" if p < 2 else f"x{p}", "y" * 200])]
    rows += [("d", 0, 9, "head"), ("few", 1, 0, "head"), ("few", 2, 0, "head"), ("few", 3, 0, "head")]
    df = spark.createDataFrame(rows, "doc string, page int, line_no int, line string")
    for part in (df, df.repartition(7), df.repartition(5, "line")):
        assert [tuple(r) for r in chunking.boilerplate(part).collect()] == [("d", "head")]
    assert chunking.boilerplate(df.limit(0)).count() == 0


def test_literals_let_every_match_through(spark):
    texts = ["THE DIAGNOSIS  IS clear", "you have heat\nstroke", "you have a HEART attack", "victim has grade-2", "This İs a grade 3 fracture", "give ٣ mg", "take 5ML", "aſpirin 81 mg", "you should be given x", "I diagnosed", "10 µg / Kg", "ketamine about 4.5 mg", "5 ml slowly IV", "it's a coral snake", "that is a big brown bear", "is probably non-venomous", "you can eat", "universal edibility test", "okay to eat", "this ıs a sprain", "", "plain"]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    plain = F.filter(F.array(*(F.when(F.col("text").rlike(safety.FLAGS + p), F.lit(n)) for n, p in safety.PATTERNS)), lambda x: x.isNotNull())
    rows = df.select("text", plain.alias("want"), safety.matched_patterns(F.col("text")).alias("got")).collect()
    assert [r.got for r in rows] == [r.want for r in rows] and sum(bool(r.want) for r in rows) >= 15


def test_learned_vectors_find_what_exact_hashed_cosines_find(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(F.col("doc_id").alias("id"), "text").where("text is not null")
    learned = embedder.learn(docs)
    learned.save(spark, str(tmp_path / "e"))
    again = embedder.Embedder.load(spark, str(tmp_path / "e"))
    texts = [r.text for r in docs.orderBy("id").collect()]
    ours = again.vectors([*texts, "", None])
    assert ours[-2:] == [None, None]
    exact = embedder._dense(embedder.Hasher(embedder.BUCKETS), texts, learned.weights)
    scores, x = exact @ exact.T, np.array(ours[:-2])
    close = [(a, b) for a, b in zip(*np.nonzero(scores >= 0.5), strict=True) if a != b]
    best = np.argsort(-(x @ x.T), axis=1)[:, :11]
    assert len(close) > 20 and np.mean([b in best[a] for a, b in close]) >= 0.95
    got = {r.id: r.vector for r in embedder.embed(docs, learned).collect()}
    assert len(got) == len(texts) and all(abs(sum(c * c for c in v) - 1) < 1e-9 for v in got.values())


def test_features_are_hashed_as_md5_says():
    rng = np.random.default_rng(9)
    letters = "abcdefghijklmnopqrstuvwxyzÄİΣß€😀"
    words = ["".join(rng.choice(list(letters), n)) for n in [*range(1, 70), 200, 5_000]]
    texts = [" ".join(rng.choice(words, rng.integers(1, 40))) for _ in range(300)]
    texts += [None, "", " \n\t", "a", "A  b\x0b\x0cc\r\nd\x1ce\x85f", "\0 \0", *words]
    for buckets in (256, embedder.BUCKETS):
        lengths, at, n = embedder.Hasher(buckets).counts(texts)
        ends = np.cumsum(lengths)
        assert len(lengths) == len(texts) and len(at) == len(n) == ends[-1]
        for k, text in enumerate(texts):
            own = text.lower().encode().split() if text else []
            found = Counter(int(hashlib.md5(f).hexdigest()[:7], 16) % buckets for f in [*own, *map(b" ".join, zip(own, own[1:], strict=False))])
            part = slice(ends[k] - lengths[k], ends[k])
            assert list(zip(at[part].tolist(), n[part].tolist(), strict=True)) == sorted(found.items())
    assert [len(c) for c in embedder.Hasher(256).counts([])] == [0, 0, 0]


def test_an_embedder_hashes_texts_once(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "one two three"), (2, "two three four"), (3, None), (4, " "), (5, "one two three")], "id long, text string")
    calls, counted = [], embedder.counted
    monkeypatch.setattr(embedder, "counted", lambda *a, **k: (calls.append(1), counted(*a, **k))[1])
    learned = embedder.learn(docs, width=2, rounds=3)
    assert len(calls) == 1
    counts = embedder.counted(docs)
    assert counts.columns == ["id", "at", "n"]
    there = {r.id: r.vector for r in embedder.embed_counted(counts, learned).collect()}
    assert there == {r.id: r.vector for r in embedder.embed(docs, learned).collect()}
    assert there[3] is None and there[4] is None and there[1] == pytest.approx(there[5]) and len(there[2]) == 2
    again = embedder.learn_counted(counts, width=2, rounds=3)
    assert np.allclose(again.directions, learned.directions) and np.allclose(again.weights, learned.weights)
    assert embedder.embed_counted(counts.limit(0), learned).count() == 0
