import random

from trailmark.llm import jaccard_join as jj


def shingles(text, words=5):
    w = (text or "").lower().split()
    return {tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set()


def brute(rows):
    sets, out = [shingles(t) for _, t in rows], []
    links = [{j for j, b in enumerate(sets) if j != i and a and b and len(a & b) / len(a | b) >= 0.8} for i, a in enumerate(sets)]
    for k in range(len(rows)):
        seen, todo = {k}, [k]
        while todo:
            for x in links[todo.pop()] - seen:
                seen.add(x)
                todo.append(x)
        out.append((rows[k][0], min(rows[x][0] for x in seen), len(links[k])))
    return sorted(out)


def run(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "'x' AS digest", "0L AS n", "'y' AS sig")
    return sorted((r.doc_id, r.class_id, r.n_links) for r in jj.join(df).collect())


def varied(rng, words, n, edits):
    out = []
    for _ in range(n):
        w = list(words)
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def test_classes_and_links_against_all_pairs(spark):
    rng = random.Random(1)
    words = [f"w{k}" for k in range(400)]
    texts, passage = [], " ".join(rng.choices(words, k=40))
    for _ in range(40):
        texts += varied(rng, rng.choices(words, k=rng.randint(20, 200)), 3, 5)
    texts += [passage + " " + " ".join(rng.choices(words, k=30)) for _ in range(150)]  # a shared passage, too little to link
    texts += [texts[0]] * 20 + ["Same  Words\nhere", "same words here", "one", "", " \n", None]
    rows = list(enumerate(texts))
    assert run(spark, rows) == brute(rows)


def test_a_group_larger_than_a_block(spark):
    rng = random.Random(2)
    base = [f"v{k}" for k in range(150)]
    rows = list(enumerate(varied(rng, base, 700, 4)))
    assert run(spark, rows) == brute(rows)


def test_repeated_rows_null_ids_empty_table_and_long_text(spark):
    long = " ".join(f"x{k}" for k in range(30_000))
    rows = [(1, "a b c d e f g"), (1, "a b c d e f g"), (1, "quite other words stand in this one"), (5, long), (6, long + " end")]
    assert run(spark, rows) == [(1, 1, 0), (1, 1, 1), (1, 1, 1), (5, 5, 1), (6, 5, 1)]
    df = spark.createDataFrame([(None, "p q r s t u"), (9, "p q r s t u"), (None, None)], "doc_id long, text string")
    assert sorted((str(r.doc_id), str(r.class_id), r.n_links) for r in jj.join(df).collect()) == [("9", "9", 1), ("None", "9", 1), ("None", "None", 0)]
    assert jj.join(df.limit(0)).count() == 0


def test_rows_without_an_id_meet_only_their_own_text(spark):
    base = " ".join(f"y{k}" for k in range(30))
    rows = [(None, f"{base} {k // 2} end{k % 2}") for k in range(600)] + [(None, base)] * 300 + [(None, None)] * 50
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "doc_id AS digest", "'x' AS class_id", "1 AS n_links", "2L AS text_hash", "3 AS leaves")
    got = [r.n_links for r in jj.join(df).collect()]
    texts = [t for _, t in rows]
    sets = {t: shingles(t) for t in set(texts) if t}
    near = {t: sum(texts.count(u) for u in sets if len(sets[t] & sets[u]) / len(sets[t] | sets[u]) >= 0.8) - 1 for t in list(sets)[:40]}
    by_text = sorted(got)
    assert by_text[:50] == [0] * 50 and len(got) == len(rows)
    assert set(near.values()) <= set(got)


def test_class_keys_tell_classes_of_one_id_apart(spark):
    one, other = "a b c d e f g h i j k l m n", "q w e r t z u i o p a s d f"
    df = spark.createDataFrame([(7, one, 1), (7, one + " tail", 2), (7, other, 3), (7, "", 4)], "doc_id long, text string, row long")
    keys = {r["row"]: r["class_key"] for r in jj.join(df, class_key=True).collect()}
    assert keys[1] == keys[2] != keys[3] and keys[4] is None


def test_near_copies_are_dealt_to_few_rows(spark, monkeypatch):
    made, plain = [], jj.block_pairs

    def counted(rows, *args):
        made.append((rows.count(), (out := plain(rows, *args)).count()))
        return out

    monkeypatch.setattr(jj, "block_pairs", counted)
    rng = random.Random(4)
    rows = list(enumerate(varied(rng, [f"v{k}" for k in range(150)], 600, 3)))
    assert run(spark, rows) == brute(rows)
    assert len(made) == 2 and all(out == rows for rows, out in made)  # 600 sets are one block


def test_long_texts_make_smaller_blocks(spark, monkeypatch):
    monkeypatch.setattr(jj, "SET_BYTES", 64)
    monkeypatch.setattr(jj, "BLOCK", 50)
    rng = random.Random(5)
    rows = list(enumerate(varied(rng, [f"v{k}" for k in range(80)], 120, 2)))
    assert run(spark, rows) == brute(rows)
