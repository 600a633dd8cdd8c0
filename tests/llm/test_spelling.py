"""op11 against words compared pair by pair."""

import random
import re
import zlib
from collections import Counter

from pyspark.sql import functions as F

from trailmark.llm import spelling as sp
from trailmark.llm.common import Scratch

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words_of(rows):
    found = Counter()
    for doc, text in rows:
        for run in RUN.findall(text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            found[run] += 1
    return {w: n for w, n in found.items() if len(w) >= 5 and n >= 3}


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows):
    words, out, forms = words_of(rows), {}, {}
    for w, n in words.items():
        others = sorted((-m, v) for v, m in words.items() if near(w, v))
        forms[w] = others[0][1] if others and -others[0][0] >= 2 * n else None
        out[w] = [forms[w], None, n, len(others), words[forms[w]] if forms[w] else None]
    for w in words:
        at = w
        while forms[at]:
            at = forms[at]
        out[w][1] = at
    return {w: tuple(v) for w, v in out.items()}


def ours(df):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in sp.variants(df).collect()}


def test_variants_against_every_pair(spark):
    rng = random.Random(1)
    letters, rows = "abeé÷", []
    base = ["".join(rng.choices(letters, k=rng.randint(4, 8))) for _ in range(60)] + ["aaaaaaa", "q" * 60, "long" * 30]
    for k in range(300):
        words = []
        for _ in range(rng.randint(0, 30)):
            w = list(rng.choice(base[: rng.choice([5, 20, 63])]))
            if rng.random() < 0.3:
                i = rng.randrange(len(w))
                w[i : i + 1] = rng.choice([[], [rng.choice(letters)], [w[i], rng.choice(letters)]])
            words.append("".join(w).upper() if rng.random() < 0.1 else "".join(w))
        rows.append((rng.choice([k, k, 7, None]), rng.choice([" ", ", ", "_9"]).join(words)))
    rows += [(1, None), (2, ""), (3, "12 — 漢字 _")] + [rows[0]] * 5 + [(5_000 + k, " ".join(["kettle"] * 50 + ["kettla"] * 20 + ["kettna"] * 8)) for k in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows)
    assert len(want) > 100 and any(v[0] for v in want.values()) and any(v[1] != v[0] for v in want.values() if v[0])
    assert ours(df.repartition(5)) == want
    assert ours(df.withColumn("word", F.lit("x")).withColumn("n", F.lit(1)).withColumn("root", F.lit(2)).withColumn("letters", F.lit(3))) == want


def test_no_words_and_tables_without_rows(spark):
    df = spark.createDataFrame([(1, None), (2, "a bb ccc"), (3, "uniqueword")], "doc_id long, text string")
    assert ours(df) == {} and ours(df.limit(0)) == {}


def test_a_class_of_anagrams_is_not_listed_as_pairs(spark):
    rng = random.Random(2)
    words = {"".join(rng.sample("abcdefghij", 10)) for _ in range(3_000)}
    df = spark.createDataFrame([(w, 5) for w in words], "word string, n long")
    found = {r.word: r.n_near for r in sp.near_words(df, Scratch(spark, "anagrams")).collect()}
    assert found == {}  # permutations differ by two letters at least


def test_long_words_and_texts(spark):
    long = "ab" * 5_000
    rows = [(k, f"{long} {long}x {long[:-1]} " + "other " * 20_000) for k in range(200, 203)]
    want = brute(rows)
    assert ours(spark.createDataFrame(rows, "doc_id long, text string")) == want and want[long][3] == 2


def test_keys_wrap_alike_in_sums_and_differences():
    word = "ÿ" * 9_000_000
    key = sp._signed(len(word) * sp.letter_value("ÿ"))
    assert sp._signed(key - sp.letter_value("ÿ")) == sp._signed((len(word) - 1) * sp.letter_value("ÿ"))
    assert sp.anagram_key("listen") == sp.anagram_key("silent") != sp.anagram_key("silens")
