import math
from collections import Counter

import numpy as np
import pytest

from trailmark.llm import kneser_ney as kn
from trailmark.llm.common import Scratch

TEXTS = ["the cat sat on the mat.", "the dog sat on the log,", "a cat and a dog sat", "the cat ran on and on", "a dog ran to the cat", "the mat on the log", "on the mat a cat sat", "the dog and the cat"] * 3 + ["odd Words once", "the cat sat"]


def frame(spark, texts):
    return spark.createDataFrame([(None if t is None else bytearray(t.encode()),) for t in texts], "text binary")


def plain(texts, numbers):
    """The same model in dictionaries: P(w | u, v)."""
    three = Counter()
    for t in texts:
        w = [numbers.get(kn.form(x), kn.UNKNOWN) for x in t.encode().split()] + [kn.END]
        h = [kn.BEGIN, kn.BEGIN, *w]
        three.update(zip(h, h[1:], w, strict=False))
    two = Counter((v, w) for _, v, w in three)
    one = Counter(w for _, w in two)

    def discounts(counts):
        n1, n2, n3, n4 = (sum(c == k for c in counts.values()) for k in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2) if n1 + 2 * n2 else 0.5
        raw = [1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.5]
        return [min(max(d, 0.1), k + 0.9) for k, d in enumerate(raw)]

    d3, d2 = discounts(three), discounts(two)
    size = kn.FIRST + len(numbers)

    def p1(w):
        total = sum(one.values())
        return (max(one[w] - 0.75, 0) + 0.75 * len(one) / (size - 1)) / total

    def higher(table, context, w, d, lower):
        inside = {k[-1]: c for k, c in table.items() if k[:-1] == context}
        if not inside:
            return lower
        cut = lambda c: d[min(c, 3) - 1]
        total = sum(inside.values())
        return ((inside[w] - cut(inside[w]) if w in inside else 0) + sum(map(cut, inside.values())) * lower) / total

    return lambda u, v, w: higher(three, (u, v), w, d3, higher(two, (v,), w, d2, p1(w))), size


@pytest.mark.parametrize("entries", [10**6, 40])
def test_probabilities_equal_a_plain_model_and_sum_to_one(spark, entries):
    m = kn.learn(frame(spark, TEXTS), Scratch(spark, "test"), shard_entries=entries)
    assert len(m.shards) == 1 if entries > 10**5 else len(m.shards) > 1
    p, size = plain(TEXTS, m.vocabulary)
    shards = [kn._Shard(s) for s in m.shards]
    words = np.array([w for w in range(size) if w != kn.BEGIN])
    some = [kn.BEGIN, kn.UNKNOWN, m.vocabulary[b"the"], m.vocabulary[b"cat"], m.vocabulary[b"ran"]]
    for u in some:
        for v in some[1:] if u != kn.BEGIN else some:
            logs = shards[v % len(shards)].logs(np.full(len(words), u), np.full(len(words), v), words, m.unigram)
            assert np.allclose(np.exp(logs), [p(u, v, w) for w in words], rtol=1e-5)
            assert np.exp(logs).sum() == pytest.approx(1, abs=1e-5)
    texts = ["the cat sat on the log", "", None, "zebra the", TEXTS[0]]
    got = kn.surprise(frame(spark, texts), m).collect()
    for t, r in zip(texts, got, strict=True):
        w = [m.vocabulary.get(kn.form(x), kn.UNKNOWN) for x in (t or "").encode().split()] + [kn.END]
        h = [kn.BEGIN, kn.BEGIN, *w]
        spelled = sum(m.letters.get(c, m.strange) for x in (t or "").split() if kn.form(x.encode()) not in m.vocabulary for c in [*kn.form(x.encode()).decode(), ""])
        assert r.nats == pytest.approx(-sum(math.log(p(*x)) for x in zip(h, h[1:], w, strict=False)) - spelled, rel=1e-4)
        assert r.n_tokens == len(w)


def test_decisions_on_labelled_documents(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = kn.op4_kneser_ney(spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    good = [r.kept for r in rows if r.doc_id in labels and labels[r.doc_id].quality == 1]
    bad = [r.kept for r in rows if r.doc_id in labels and labels[r.doc_id].quality == 0]
    assert sum(good) >= 0.97 * len(good) and sum(bad) <= 0.5 * len(bad)


def test_hard_rows(spark):
    rows = [(k, t, "en", 1) for k, t in enumerate(TEXTS)] + [(None, None, None, 1), (100, "", "en", 1), (101, "the cat sat " * 40_000, None, 1), (102, "x" * 100_000, "de", 1), (0, TEXTS[0], "en", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, perplexity int")
    labels = spark.createDataFrame([(k, 1, 0) for k in range(len(TEXTS))] + [(None, 1, 0), (3, 0, 0), (4, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    got = kn.classify(docs, labels).collect()
    assert len(got) == len(rows)
    assert [r.kept for r in got if r.doc_id in (None, 100, 102)] == [False, False, False]
    assert kn.classify(docs.limit(0), labels).count() == 0
    none = kn.classify(docs, labels.limit(0)).collect()
    assert sum(r.kept for r in none) == len(rows) - 2
    assert sorted(r.doc_id for r in kn.trusted_ids(labels).collect() if r.doc_id < 7) == [0, 1, 2, 5, 6]


def test_all_trusted_documents_are_learned_from_and_set_the_thresholds(spark, monkeypatch):
    """Each is scored by the counts of the half that it isn't in, all others by the counts of all."""
    held, learn = [], kn.learn
    monkeypatch.setattr(kn, "learn", lambda texts, *a, **k: held.append((texts, learn(texts, *a, **k))) or held[-1][1])
    texts = list(dict.fromkeys(TEXTS)) + [f"{a} the {b} sat on" for a in ("cat", "dog", "mat") for b in ("log", "cat", "dog")]
    docs = spark.createDataFrame([(k, t, "en") for k, t in enumerate([*texts, "a cat on the log", "the dog sat"])], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(k, 1, 0) for k in range(len(texts))], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in kn.classify(docs, labels, shard_entries=30).collect()}
    (learned, m), rows = held[0], held[0][0].collect()
    assert sorted(bytes(r.text).decode() for r in rows) == sorted(texts) and {r.half for r in rows} == {1, 2}
    assert m.n_shards > 1
    half = {bytes(r.text).decode(): r.half for r in rows}
    models = [plain([t for t in texts if not h or half[t] == h], m.vocabulary)[0] for h in (0, 1, 2)]
    for r in docs.collect():
        p = models[(0, 2, 1)[half.get(r.text, 0)]]
        w = [m.vocabulary.get(kn.form(x), kn.UNKNOWN) for x in r.text.encode().split()] + [kn.END]
        h = [kn.BEGIN, kn.BEGIN, *w]
        spelled = sum(m.letters.get(c, m.strange) for x in r.text.split() if kn.form(x.encode()) not in m.vocabulary for c in [*kn.form(x.encode()).decode(), ""])
        nats = -sum(math.log(p(*x)) for x in zip(h, h[1:], w, strict=False)) - spelled
        assert math.log(got[r.doc_id].perplexity) == pytest.approx(nats / len(w), rel=1e-4), r.text
    best = sorted(got[k].perplexity for k in range(len(texts)))
    assert all(g.threshold == pytest.approx(best[-1] * math.exp(kn.SLACK)) for g in got.values())


def test_a_frequent_word_has_several_shards(spark):
    m = kn.learn(frame(spark, TEXTS), Scratch(spark, "test"), shard_entries=6)
    assert m.split[m.vocabulary[b"the"]] > 1 and len(m.rates[0].wide[0])
    p, _ = plain(TEXTS, m.vocabulary)
    texts = ["the cat sat on the log", "on the mat the dog ran to the cat", "the the the"]
    for t, r in zip(texts, kn.surprise(frame(spark, texts), m).collect(), strict=True):
        w = [m.vocabulary[x] for x in t.encode().split()] + [kn.END]
        h = [kn.BEGIN, kn.BEGIN, *w]
        assert r.nats == pytest.approx(-sum(math.log(p(*x)) for x in zip(h, h[1:], w, strict=False)), rel=1e-4)
