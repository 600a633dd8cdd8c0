import math
import zlib
from collections import Counter

import numpy as np
import pytest

from trailmark.llm import brown_lm as bl
from trailmark.llm.common import Scratch


def tokens(text):
    return [*(text or "").encode().lower().split(), None]


def brute(rows, train):
    """Base scores and counts by the formula."""
    c = Counter(w for _, t in train for w in tokens(t))
    n, v = sum(c.values()), len(c)
    out = []
    for d, t in rows:
        w = tokens(t)
        out.append((d, len(w), sum(c[x] > 0 for x in w), sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)))
    return out, n


def test_query_on_the_small_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    held = {d: zlib.crc32(str(d).encode()) % 10 == 0 for d, _ in rows}
    want, n = brute(rows, [r for r in rows if not held[r[0]]])
    got = {r.doc_id: r for r in bl.op7_brown_lm(spark, sf).collect()}
    assert len(got) == len(rows)
    for d, length, known, base in want:
        r = got[d]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (length, known, n, held[d])
        assert r.base_score == pytest.approx(base, rel=1e-9)
    assert sum(r.score for r in got.values() if r.held_out) > sum(r.base_score for r in got.values() if r.held_out)


ROWS = [(1, "the cat sat on the mat"), (2, "The dog sat on a mat"), (3, None), (4, ""), (5, "a dog and the cat ran"), (None, "no id here"), (1, "the cat sat on the mat"), (8, "w " * 30_000), (9, "x" * 50_000)]


def test_the_score_is_the_model_s_and_the_model_sums_to_one(spark):
    docs = spark.createDataFrame([(d, None if t is None else bytearray(t.encode())) for d, t in ROWS], "doc_id long, text binary")
    scratch = Scratch(spark, "test")
    m, counts = bl.learn(docs.select("text"), scratch, symbols=4, endings=8, lookup=6, classes=4)
    got = bl.score(docs, m, counts, scratch).collect()
    assert len(got) == len(ROWS)
    want, _ = brute(ROWS, ROWS)
    key = lambda d, n: (-1 if d is None else d, n)
    for r, (_, n, known, base) in zip(sorted(got, key=lambda r: key(r.doc_id, r.n_tokens)), sorted(want, key=lambda x: key(x[0], x[1])), strict=True):
        assert (r.n_tokens, r.n_known) == (n, known) and r.base_score == pytest.approx(base, rel=1e-9)
    c = Counter(w for _, t in ROWS for w in tokens(t))
    lex = m.lexicon

    def symbol(w):
        return lex.end if w is None else lex.symbols.get(w, lex.end + 1 + zlib.crc32(w[-3:]) % lex.endings)

    def log(w, before):
        s = symbol(w)
        own = math.log10(c[w] + 0.1) if s > lex.end else 0.0
        return m.transition[m.classes[symbol(before)], m.classes[s]] + m.emission[s] + own

    for r in got:
        text = next(t for d, t in ROWS if d == r.doc_id)
        w = tokens(text)
        assert r.score == pytest.approx(sum(log(x, y) for x, y in zip(w, [None, *w[:-1]], strict=True)), rel=1e-9)
    for before in [None, b"the", b"dog"]:
        seen = sum(10 ** log(w, before) for w in c)
        unseen = sum(10 ** (m.transition[m.classes[symbol(before)], m.classes[s]] + m.emission[s]) * 0.1 for s in range(lex.end + 1, lex.size))
        assert seen + unseen == pytest.approx(1, abs=1e-9)


def test_exchange_separates_words_that_stand_apart():
    rng, pairs = np.random.default_rng(0), Counter()
    for _ in range(4000):  # two kinds of words in turn, the end as symbol 20
        a = rng.integers(0, 10)
        pairs[(20, a)] += 1
        for _ in range(5):
            b = rng.integers(10, 20) if a < 10 else rng.integers(0, 10)
            pairs[(int(a), int(b))] += 1
            a = b
        pairs[(int(a), 20)] += 1
    first, second = (np.array([p[k] for p in pairs]) for k in (0, 1))
    of = bl.exchange(first, second, np.array(list(pairs.values())), 21, 20, 3)
    assert len(set(of[:10])) == len(set(of[10:20])) == 1 and len(set(of)) == 3


def test_nothing_to_learn_from_or_to_score(spark):
    docs = spark.createDataFrame([(1, bytearray(b"some words")), (2, None)], "doc_id long, text binary")
    scratch = Scratch(spark, "test")
    m, counts = bl.learn(docs.limit(0).select("text"), scratch)
    rows = bl.score(docs, m, counts, scratch).collect()
    assert sorted((r.doc_id, r.n_tokens, r.n_known) for r in rows) == [(1, 3, 0), (2, 1, 0)]
    assert all(math.isfinite(r.score) and math.isfinite(r.base_score) for r in rows)
    assert bl.score(docs.limit(0), m, counts, scratch).count() == 0


def test_every_word_has_a_class_of_its_own_neighbours(spark):
    # two kinds of rare words with the same endings, told apart by their neighbours only
    names, verbs = [f"n{k}xxx" for k in range(300)], [f"v{k}xxx" for k in range(300)]
    pick = lambda k, words, often: words[k % 300] if k % 2 else often
    rows = [(k, f"the {pick(k, names, 'dog')} of the {pick(k // 2, names, 'dog')} can {pick(k // 3, verbs, 'run')} or can {pick(k, verbs, 'run')} .") for k in range(1_200)]
    rows += [(2_000, None), (2_000, None), (2_001, "the unseenxxx can"), (None, "")]
    docs = spark.createDataFrame([(d, d in (2_001,), None if t is None else bytearray(t.encode())) for d, t in rows], "doc_id long, held_out boolean, text binary")
    train, scratch = docs.where("not held_out").select("text"), Scratch(spark, "test")
    m, counts = bl.learn(train, scratch, symbols=7, endings=4, lookup=10, classes=9)
    table = bl.assign(train, m, counts, scratch)
    found = {r.h: (r.n, r["class"]) for r in table.collect()}
    c = Counter(w for d, t in rows if d != 2_001 for w in tokens(t))
    assert len(found) == len(c) - 1 - len(m.lexicon.symbols)
    of = lambda words: {found[int(bl.hashes_of([w.encode()])[0])][1] for w in words if w.encode() in c}
    assert len(of(names)) == len(of(verbs)) == 1 and of(names) != of(verbs)

    seqs = bl.sequences(docs, m, table, scratch, lookup=50)
    transition, mass = bl.refit(m, table, seqs.where("not held_out"))

    def klass(w):
        if w is None or w in m.lexicon.symbols:
            return m.classes[m.lexicon.end if w is None else m.lexicon.symbols[w]]
        seen = found.get(int(bl.hashes_of([w])[0]))
        return seen[1] if seen else m.classes[m.lexicon.end + 1 + zlib.crc32(w[-3:]) % 4]

    log = lambda w, before: transition[klass(before), klass(w)] + math.log10(c[w] + 0.1) - mass[klass(w)]
    want = sorted(sum(log(x, y) for x, y in zip(tokens(t), [None, *tokens(t)[:-1]], strict=True)) for _, t in rows)
    got = bl.score_sequences(seqs, m, transition, mass).collect()
    assert [r.score for r in sorted(got, key=lambda r: r.score)] == pytest.approx(want, rel=1e-9)
    for before in (None, b"the", names[3].encode()):
        seen = sum(10 ** log(w, before) for w in c)
        unseen = sum(10 ** (transition[klass(before), m.classes[s]] - mass[m.classes[s]]) * 0.1 for s in range(m.lexicon.end + 1, m.lexicon.size))
        assert seen + unseen == pytest.approx(1, abs=1e-9)
    grams = Counter((klass(y), klass(x)) for d, t in rows if d != 2_001 for x, y in zip(tokens(t), [None, *tokens(t)[:-1]], strict=True))
    row = {a: sum(n for (x, _), n in grams.items() if x == a) for a, _ in grams}
    for (a, b), n in grams.items():
        assert 10 ** transition[a, b] == pytest.approx(n / row[a], abs=5 / row[a])


def test_sweeps_go_on_until_none_moves():
    rng = np.random.default_rng(1)
    first, second = np.divmod(rng.choice(120 * 120, 3_000, replace=False), 120)
    n = rng.integers(1, 40, 3_000)

    def likelihood(of):
        g = np.zeros((9, 9))
        np.add.at(g, (of[first], of[second]), n)
        f = lambda x: float((x * np.log(np.maximum(x, 1))).sum())
        return f(g) - f(g.sum(axis=0)) - f(g.sum(axis=1))

    of = bl.exchange(first, second, n, 120, 0, 9)
    best = likelihood(of)
    for w in range(1, 120):
        for b in range(8):
            other = of.copy()
            other[w] = b
            assert likelihood(other) <= best + 1e-6
