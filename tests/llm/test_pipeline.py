import corpus_pipeline as cp
from tests.llm.test_hilbert_pack import check, library
from tests.llm.test_jaccard_join import shingles

SF = "/root/testdata/sf0.01"


def test_the_stages_against_brute_force_on_the_small_table(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r.doc_id: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    before = {r.doc_id: r for r in docs.collect()}
    for name, stage in cp.STAGES[:3]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        after = {r.doc_id: r for r in docs.collect()}
        assert all(before[d] == r for d, r in after.items())
        clean = [d for d in before if d in labels and labels[d].quality == 1 and not labels[d].toxic]
        if name == "near_duplicates":
            sets = {d: shingles(r.text) for d, r in before.items()}
            linked = lambda a, b: sets[a] and sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8
            kept = sorted(after)
            assert not any(linked(a, b) for i, a in enumerate(kept) for b in kept[:i])
            assert all(any(linked(d, other) for other in before if other != d) for d in before if d not in after)
        else:
            assert sum(d in after for d in clean) >= 0.97 * len(clean), name
        before = after
    check(cp.packing(spark, docs, SF).collect(), {d: library(r.text) for d, r in before.items()})


def test_hard_rows(spark):
    rows = [(1, "some text in words here", "en", "a", 3), (1, "some text in words here", "en", "a", 3), (2, None, None, None, None), (3, "", "en", "a", 0), (4, "?!", "en", "a", 2), (None, "no id but a text all the same", None, None, None), (6, "other words entirely than those above", "en", "b", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for table in (docs, docs.limit(0)):
        out = table
        for _, stage in cp.STAGES[:3]:
            out = stage(spark, out, SF)
        assert out.columns == docs.columns
        ids = sorted(str(r.doc_id) for r in out.collect())
        assert set(ids) <= {"1", "6", "None"} and len(ids) == len(set(ids))
        cp.packing(spark, out, SF).collect()


def test_run_is_the_registered_query(spark):
    import __spark_entry__ as entry

    assert entry.queries()["pipeline"] is cp.run and "pipeline" not in entry.oracle_sql()


def test_a_copy_takes_no_other_row_of_its_id_along(spark):
    text = "this is one text of enough words to have shingles"
    rows = [(1, text), (2, text), (2, "quite another text that nobody else has in here"), (None, text), (None, "a third text without an id that stands alone here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.text) for r in cp.near_duplicates(spark, docs, SF).collect()}
    assert got == {rows[0], rows[2], rows[4]}


def test_names_that_clash_and_rows_of_one_id(spark):
    text = "this is one text of enough words to have shingles"
    rows = [(1, text, "x", "a", 1), (1, text, "x", "b", 1), (1, "another text under the first id that is like no other", "x", "c", 1), (None, "a text without an id of its own here", "x", "d", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _language string, _key string, row int").selectExpr("*", "_key AS _doc", "_key AS _row", "1.0D AS _posterior", "_key AS lang")
    out = cp.near_duplicates(spark, docs, SF)
    assert out.columns == docs.columns
    got = {tuple(r)[:5] for r in out.collect()}
    assert len(got) == 3 and got <= set(rows) and {r[1] for r in got} == {r[1] for r in rows}
    told = cp.language(spark, docs, SF).collect()
    assert all(r["_language"] == "x" and r["_posterior"] == 1.0 for r in told)


def test_one_row_of_a_class_stays_whatever_its_ids(spark):
    a, b, c = (" ".join(f"{x}{k}" for k in range(30)) for x in "abc")
    rows = [(7, a), (7, a + " tail"), (None, b), (None, b + " tail"), (9, c), (9, c.upper().replace(" ", "  ")), (11, ""), (None, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((str(r.doc_id), r.text[:1].lower()) for r in cp.near_duplicates(spark, docs, SF).collect()))
    assert got == [("11", ""), ("7", "a"), ("9", "c"), ("None", ""), ("None", "b")]
