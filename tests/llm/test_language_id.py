import itertools
import math

import numpy as np
import pytest

from trailmark.llm import language_id as li
from trailmark.llm.columns import fold


def every_segmentation(vocabulary, word, probs):
    """Sum of the products over all ways to cut a word into pieces."""
    total = 0.0
    for cuts in itertools.product([0, 1], repeat=len(word) - 1):
        at = [0, *[k + 1 for k, c in enumerate(cuts) if c], len(word)]
        product = 1.0
        for a, b in itertools.pairwise(at):
            p = vocabulary.ids.get(word[a:b], -1) if b - a <= li.LONGEST_PIECE else -1
            if p < 0 and b - a == 1:
                p = vocabulary.size - 1
            product *= probs[p] if p >= 0 else 0.0
        total += product
    return total


def test_the_forward_sum_is_the_sum_over_all_segmentations():
    vocabulary, rng = li.pieces(li.vocabulary_path()), np.random.default_rng(0)
    probs = rng.random((vocabulary.size, 2))
    words = ["▁the", "▁étreaux", "▁x", "▁⛰⛰a", "▁東京は世", "▁heeninter", "▁"]
    counts = np.array([[2.0, 1.0]] * len(words))
    logs, expected = li.forward(vocabulary, words, probs, counts)
    for k, w in enumerate(words):
        for lang in (0, 1):
            assert math.exp(logs[k, lang]) == pytest.approx(every_segmentation(vocabulary, w, probs[:, lang]), rel=1e-9)
    single = li.forward(vocabulary, ["▁the"], probs, np.ones((1, 2)))[1]
    whole = probs[vocabulary.ids["▁the"]] / np.exp(li.forward(vocabulary, ["▁the"], probs)[0][0])
    assert np.allclose(single[vocabulary.ids["▁the"]], whole)
    assert np.all(expected.sum(axis=0) > 0)


def test_held_out_accuracy_on_the_small_table(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = li.op3_language_id(spark, sf).collect()
    assert len(rows) == len(truth)
    held = [r for r in rows if r.held_out]
    assert len(held) > 100 and all(0 <= r.score <= 1 for r in rows)
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.97 * len(held)


def test_hard_rows(spark):
    rows = [(1, "the words of this", "en", 0.5), (2, "les mots que voilà", "fr", 0.5), (2, "les mots que voilà", "fr", 0.5), (None, None, None, None), (5, "", "en", 1.0), (6, "12 — !! \n", "fr", 1.0), (7, "the " * 50_000, None, 1.0), (8, "x" * 100_000, "en", 1.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    model = li.learn(docs)
    assert model.languages == ["en", "fr"]
    got = li.predict(docs, model).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert [by[k].lang_pred for k in (None, 5, 6, 7, 2)] == ["und", "und", "und", "en", "fr"]
    assert [by[k].score for k in (None, 5, 6)] == [0.0] * 3
    assert li.predict(docs.limit(0), model).count() == 0
    nothing = li.learn(docs.where("lang is null"))
    assert {r.lang_pred for r in li.predict(docs, nothing).collect()} == {"und"}
    assert docs.select(fold("doc_id", 4).alias("f")).where("f is null").count() == 0


def log_sum(vocabulary, word, logs):
    """The forward sum of a word in logs, place by place."""
    at = [0.0]
    for end in range(1, len(word) + 1):
        ways = []
        for k in range(1, min(end, li.LONGEST_PIECE) + 1):
            p = vocabulary.ids.get(word[end - k : end], vocabulary.size - 1 if k == 1 else -1)
            if p >= 0:
                ways.append(at[end - k] + logs[p])
        top = max(ways)
        at.append(top + math.log(sum(math.exp(w - top) for w in ways)))
    return at[-1]


def test_no_length_of_a_word_underflows():
    vocabulary = li.pieces(li.vocabulary_path())
    probs = np.full((vocabulary.size, 2), [1e-9, 3e-5])
    probs[vocabulary.ids["▁the"]] = 0.5
    words = ["▁" + "東京は世界の都市である" * 30, "▁the", "▁" + "q1x" * 40, "▁" + "⛰" * 5_000, "▁heeninter" * 9]
    counts = np.array([[3.0, 2.0]] * len(words))
    logs, expected = li.forward(vocabulary, words, probs, counts)
    for k, w in enumerate(words):
        for lang in (0, 1):
            assert logs[k, lang] == pytest.approx(log_sum(vocabulary, w, np.log(probs[:, lang])), rel=1e-9)
    # pieces cover a word's characters: expected counts times lengths are its characters
    sizes = np.ones(vocabulary.size)
    for p, i in vocabulary.ids.items():
        sizes[i] = len(p)
    assert sizes @ expected == pytest.approx(counts[0] * sum(map(len, words)), rel=1e-9)
    assert li.split_words("a " + "b" * 300) == ["▁a", "▁" + "b" * 300]
    assert [w for part in li.blocks(words * 9_000) for w in (words * 9_000)[part]] == words * 9_000


def test_a_run_of_unseen_script_spoils_no_language(spark):
    rows = [(k, f"the words of this text are plain number {k} and they run on " * 200, "en") for k in range(400)]
    rows += [(1000 + k, "这是一个没有空格的很长的中文句子里面有许多不同的汉字和词语" * 5, "zh") for k in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = li.learn(docs)
    assert np.isfinite(model.probs).all() and np.allclose(model.probs.sum(axis=0), 1)
    got = li.predict(docs, model).collect()
    assert all(r.lang_pred == r.lang and r.score > 0.99 for r in got)


def test_signs_that_become_letters_when_normalised_are_no_letters(spark):
    model = li.Model(li.vocabulary_path(), ["aa", "bb"], np.random.default_rng(1).dirichlet(np.ones(li.pieces(li.vocabulary_path()).size), 2).T)
    texts = ["™ 12", "℃ 3", "Ⓐ", "", None, "a ™"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in li.predict(docs, model).collect()}
    assert [got[k] for k in range(5)] == [("und", 0.0)] * 5 and got[5][0] in ("aa", "bb") and got[5][1] >= 0.5
