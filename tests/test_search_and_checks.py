import numpy as np
import pytest
from pyspark.sql import functions as F

from trailmark.functions import safety, vectors, wordpiece
from trailmark.operators import corpus, search, training, validation
from trailmark.plans import fixtures as fx


def corpus_of(spark, rows):
    return spark.createDataFrame(rows, "id long, vector array<double>")


def ask(spark, vector, name=1):
    return spark.createDataFrame([(name, [float(x) for x in vector])], "query_id long, vector array<double>")


def test_ties_go_to_the_smaller_id_and_nan_is_no_hit(spark):
    c = corpus_of(spark, [(5, [1.0, 0.0]), (2, [1.0, 0.0]), (9, [1.0, 0.0]), (1, [float("nan"), 0.0]), (3, None), (4, [1.0])])
    assert [r.id for r in search.top_k(c, ask(spark, [1, 0]), 2).orderBy("rank").collect()] == [2, 5]
    assert [r.id for r in search.top_k(c.repartition(5), ask(spark, [1, 0]), 10).orderBy("rank").collect()] == [2, 5, 9]


def test_many_queries_in_blocks_against_numpy(spark, monkeypatch):
    monkeypatch.setattr(search, "QUERY_BLOCK", 7)
    rng = np.random.default_rng(1)
    x = rng.standard_normal((300, 12))
    c = corpus_of(spark, [(k, v.tolist()) for k, v in enumerate(x)]).repartition(4)
    q = spark.createDataFrame([(k, x[k].tolist()) for k in range(20)], "query_id long, vector array<double>")
    got = {(r.query_id, r.rank): r.id for r in search.top_k(c, q, 4, skip_self=True).collect()}
    scores = x[:20] @ x.T
    scores[np.arange(20), np.arange(20)] = -np.inf
    for k in range(20):
        assert [got[k, r] for r in range(1, 5)] == np.argsort(-scores[k], kind="stable")[:4].tolist()


def test_an_empty_corpus_or_query_set(spark):
    c = corpus_of(spark, [(1, [1.0])])
    assert search.top_k(c.limit(0), ask(spark, [1]), 3).count() == 0
    assert search.top_k(c, ask(spark, [1]).limit(0), 3).count() == 0
    assert [r.result for r in search.gate(search.top_k(c.limit(0), ask(spark, [1]), 3), ask(spark, [1])).collect()] == ["noConfidentMatch"]


def test_store_refusals(spark):
    facts = lambda v: spark.createDataFrame([("embeddings_normalized", v)], "key string, value string")
    for v in ("0", "true", ""):
        with pytest.raises(validation.Refused):
            validation.require_normalized(facts(v))
    validation.require_normalized(facts("1"))
    validation.require_normalized(None)
    assert validation.require_corpus(corpus_of(spark, [(1, [1.0, 0.0])]), 2) == 2
    for rows, expected in (([], None), ([(1, [1.0]), (2, [1.0, 2.0])], None), ([(1, [1.0])], 384)):
        with pytest.raises(validation.Refused):
            validation.require_corpus(corpus_of(spark, rows), expected)
    with pytest.raises(validation.Refused):
        validation.require_rows(spark.range(3), 50, "chunks")
    assert validation.require_rows(spark.range(60), 50, "chunks").count() == 60


def test_unusable_rows_are_skipped_on_load(spark):
    rows = [(1, "c", "t", bytearray(np.array([1, 0], "<f4").tobytes())), (2, None, "t", bytearray(8)), (3, "c", None, bytearray(8)), (4, "c", "t", bytearray()), (5, "c", "t", bytearray(7)), (6, "c", "t", None)]
    df = spark.createDataFrame(rows, "id long, citation string, text string, embedding binary")
    got = corpus.resident(df).collect()
    assert [(r.id, r.vector) for r in got] == [(1, [1.0, 0.0])]


def test_parity(spark):
    ours = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0])], "text string, embedding array<double>")
    theirs = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.6, 0.8]), ("c", [1.0, 0.0])], "text string, embedding array<double>")
    assert {r.text: r.ok for r in validation.parity(ours, theirs).collect()} == {"a": True, "b": False, "c": False}
    validation.require_parity(ours, ours, "m", "m")
    for other, name in ((theirs, "m"), (ours, "n")):
        with pytest.raises(validation.Refused):
            validation.require_parity(ours, other, "m", name)


def test_vector_arithmetic(spark):
    df = spark.createDataFrame([([[1.0, 2.0], [3.0, 4.0], [9.0, 9.0]], [1, 1, 0])], "rows array<array<double>>, mask array<int>")
    row = df.select(vectors.masked_mean(F.col("rows"), F.col("mask")).alias("m"), vectors.normalize(F.col("rows")[1]).alias("n")).first()
    assert row.m == [2.0, 3.0] and row.n == pytest.approx([0.6, 0.8])
    none = df.select(vectors.masked_mean(F.col("rows"), F.array(F.lit(0), F.lit(0), F.lit(0))).alias("m")).first()
    assert none.m == [0.0, 0.0]
    both = df.select(vectors.normalize(vectors.masked_mean(F.col("rows"), F.col("mask"))).alias("u"))
    assert both.first().u == pytest.approx([2 / 13**0.5, 3 / 13**0.5])
    assert both._jdf.queryExecution().analyzed().toString().count("filter(") == 1  # worked out once a row, not once an element
    raw = spark.createDataFrame([(bytearray(b"\xff\xd8\xff\xe0"), bytearray(b"%PDF-1.4")), (bytearray(b"\xff"), None)], "a binary, b binary")
    assert [tuple(r) for r in raw.select(vectors.is_jpeg(F.col("a")), vectors.is_pdf(F.col("b"))).collect()] == [(True, True), (False, False)]


def test_safety_rows(spark):
    assert safety.assert_compiles(spark) == 15
    rows = safety.sanitize(fx.SAFETY.frame(spark)).collect()
    assert {n for n, _ in safety.PATTERNS} == {r.expect_pattern for r in rows if r.expect_pattern}
    for r in rows:
        assert r.was_modified == r.expect_blocked, r.text
        assert r.safe_text == (safety.REPLACEMENT if r.expect_blocked else r.text)
        assert r.expect_pattern is None or r.expect_pattern in r.matched_patterns
    out = safety.sanitize_columns(spark.createDataFrame([("fine", "You can eat it"), (None, "ok")], "a string, error string"), ["a", "error"]).collect()
    assert [tuple(r) for r in out] == [("fine", safety.REPLACEMENT), (None, "ok")]


def test_wordpiece_errors_and_padding():
    config = wordpiece.Config(8, cls_token_id=2, sep_token_id=3, unk_token_id=1)
    vocabulary = wordpiece.read_vocabulary("\r\n".join(fx.VOCABULARY) + "\r\n")
    assert vocabulary["now"] == 11
    assert wordpiece.WordPiece(vocabulary, config).encode("cover") == ([2, 4, 3, 0, 0, 0, 0, 0], [1, 1, 1, 0, 0, 0, 0, 0])
    assert wordpiece.read_vocabulary("a\n\nb") == {"a": 0, "b": 2}
    with pytest.raises(ValueError):
        wordpiece.WordPiece({}, config)
    with pytest.raises(ValueError):
        wordpiece.WordPiece(vocabulary, wordpiece.Config(1))
    again = wordpiece.Config.read(config.write())
    assert again == config and wordpiece.Config.read('{"max_sequence_length": 128, "other": 1}').strip_accents
    assert wordpiece.WordPiece(vocabulary, config).count("cover the cleaned") == 4


def test_dense_ids_and_store(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("x")).repartition(6)
    got = corpus.dense_ids(df, "x").collect()
    assert sorted((r.x, r.id) for r in got) == [(k, k + 1) for k in range(1000)]
    assert corpus.dense_ids(df.limit(0), "x").count() == 0
    files = spark.createDataFrame([("a.pdf",), ("b.pdf",)], "filename string")
    manifest = spark.createDataFrame([("a.pdf", "A")], "filename string, citation_prefix string")
    with pytest.raises(ValueError, match="b.pdf"):
        corpus.require_manifested(files, manifest)
    assert corpus.require_manifested(files, manifest, allow=True).count() == 1
    assert corpus.lookup(None, "x") is None and corpus.lookup(fx.FACTS_OLD.frame(spark), "embedding_dim") == "4"
    assert [r.id for r in corpus.middle(spark.range(1, 11), 3).collect()] == [6, 7, 8]


def test_training_dataset_is_the_same_in_any_number_of_partitions(spark):
    text = "\n".join(f"{k}. Apply the dressing number {k} to the wound" for k in range(4))
    rows = [(k, f"2.{k} Wound Care", f"[c{k}]", f"{text} {k}", 90) for k in range(60)]
    chunks = spark.createDataFrame(rows, "id long, section string, citation string, text string, token_count int")
    one = [r.messages for r in training.dataset(chunks, "S", 20, 7, 12).collect()]
    many = [r.messages for r in training.dataset(chunks.repartition(9), "S", 20, 7, 12).collect()]
    assert one == many and len(one) == 39 and all(len(m) == 3 for m in one)
    assert training.as_json(training.dataset(chunks, "é", 1, 0, 0)).first().value.startswith('{"messages":[{"role":"system","content":"é"}')


def test_training_dataset_refuses_too_few_usable_chunks(spark):
    rows = [(k, "2. Wounds", f"[c{k}]", "1. Apply the dressing to it\n2. Hold it for some minutes", 90 if k < 49 else 79) for k in range(60)]
    chunks = spark.createDataFrame(rows, "id long, section string, citation string, text string, token_count int")
    with pytest.raises(validation.Refused, match="49 chunks"):
        training.dataset(chunks, "S", 20, 7, 12)


def test_service(spark):
    from trailmark.operators import service

    store = fx.STORE.frame(spark)
    row = service.info(None, store.select("id", "vector")).first()
    assert (row.chunk_count, row.dimension, row.threshold, row.top_k) == (3, 4, 0.35, 3)
    asked = spark.createDataFrame([(1, "how to treat a wound", [1.0, 0.0, 0.0, 0.0]), (2, "engine", [0.0, 0.0, 0.0, 1.0]), (3, " \t", [1.0, 0.0, 0.0, 0.0])], "query_id long, question string, vector array<double>")
    got = {r.query_id: r for r in service.ask(store.select("id", "vector"), store, asked, 1).collect()}
    assert set(got) == {1, 2}
    assert got[1].answer == "\n".join(fx.STORE.rows[0][3:5]) and not got[1].was_modified
    assert got[2].result == "noConfidentMatch" and got[2].citation is None and got[2].answer == "NO_MATCHING_PROTOCOL_FOUND"
    unsafe = service.ask(store.select("id", "vector"), store, asked, 1, generate=lambda p: F.concat(F.lit("The diagnosis is: "), p)).collect()
    assert all(r.answer == safety.REPLACEMENT and r.matched_patterns == ["diagnosis_is"] for r in unsafe)


def test_keywords_in_blocks(spark):
    chunks = spark.createDataFrame([(1, "Snake bite of the LEG"), (2, "a leg wound"), (3, "nothing"), (4, None)], "id long, text string")
    words = spark.createDataFrame([("snake",), ("leg",), ("wound",), ("leg",), (None,)], "keyword string")
    want = {("snake", 1), ("leg", 1), ("leg", 2), ("wound", 2)}
    for block in (1, 2, 100):
        rows = training.keyword_chunks(chunks, words, block).collect()
        assert {(r.keyword, r.id) for r in rows} == want and len(rows) == 4


def test_contexts_shuffle_ids_without_the_texts(spark, monkeypatch):
    """Only ids are put in order and written; texts are looked up for the records alone."""
    from trailmark.operators import corpus

    ordered, dense = [], corpus.dense_ids
    monkeypatch.setattr(corpus, "dense_ids", lambda df, *a, **k: ordered.append(df.columns) or dense(df, *a, **k))
    text = "1. Apply the dressing to the wound\n2. Hold it there for some minutes"
    rows = [(k, f"2.{k} Wound Care", f"[c{k}]", f"{text} {k}", 90) for k in range(60)]
    chunks = spark.createDataFrame(rows, "id long, section string, citation string, text string, token_count int")
    got = training.dataset(chunks, "S", 5, 4, 3).collect()
    assert len(got) == 12 and len(ordered) == 3
    assert not any({"text", "citation"} & set(columns) for columns in ordered)
    for r in got:  # two distractors with a chunk, three alone, one or two with a checklist
        n = r.messages[1]["content"].count("[c")
        assert n == {"grounded": 3, "refusal": 3, "deflection": n if n in (2, 3) else 0}[r.kind]
