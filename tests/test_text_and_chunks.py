import pytest
from pyspark.sql import functions as F

from trailmark.functions import text as tx
from trailmark.operators import chunking
from trailmark.plans import fixtures as fx


def lines_of(*tokens, page=1):
    return [(page, f"line{k}", None, t) for k, t in enumerate(tokens)]


def sizes(chunks):
    return [c[4] for c in chunks]


def test_budget_overflow_carries_the_end_of_the_chunk():
    chunks = list(chunking.fold(lines_of(100, 100, 40, 100)))
    assert sizes(chunks) == [200, 140] or sizes(chunks) == [200, 140 + 0]
    assert chunks[0][0] == "line0\nline1" and chunks[1][0].startswith("line2")
    chunks = list(chunking.fold(lines_of(100, 80, 40, 220)))
    assert sizes(chunks) == [220, 260]  # carry of 40 and a line of 220 stand unchecked
    assert chunks[1][0] == "line2\nline3"
    assert sizes(chunking.fold(lines_of(172, 48, 220))) == [220, 268]


def test_a_chunk_below_the_least_size_is_dropped_and_its_end_still_carried():
    lines = [(1, "a", None, 10), (1, "Head", "Head", 0), (1, "b", None, 20)]
    chunks = list(chunking.fold(lines))
    assert [(c[0], c[1], c[4]) for c in chunks] == [("a\nb", None, 30)]  # the section before the heading, as something was carried


def test_an_oversized_line_stands_alone_and_the_carry_joins_what_follows():
    chunks = list(chunking.fold(lines_of(30, 300, 10)))
    assert [(c[0], c[4]) for c in chunks] == [("line0", 30), ("line1", 300), ("line0\nline2", 40)]
    assert sizes(chunking.fold(lines_of(30))) == [30] and sizes(chunking.fold(lines_of(23))) == []
    assert [c[0] for c in chunking.fold(lines_of(100, 30, 250))] == ["line0\nline1", "line2", "line1"]  # a pure carry comes again


def test_sections_hold_for_ten_pages_and_change_at_headings():
    lines = [(1, "H", "One", 0), (1, "a", None, 60), (11, "b", None, 60), (12, "c", None, 60), (12, "d", None, 60)]
    chunks = list(chunking.fold(lines))
    assert [(c[1], c[2], c[3]) for c in chunks] == [("One", 1, 12), (None, 12, 12)]
    lines = [(1, "H", "One", 0), (1, "a", None, 60), (1, "H", "Two", 0), (1, "b", None, 60)]
    assert [(c[0], c[1]) for c in chunking.fold(lines)] == [("a", "One"), ("b", "Two")]


def test_documents_are_chunked_as_their_lines_are(spark):
    head = "Running Head of the Manual"
    pages = [f"{head}\n4.{k} Wound Care Basics\n" + "\n".join(f"word{k} " * 30 for _ in range(6)) for k in range(1, 7)]
    docs = spark.createDataFrame([("m", pages), ("none", []), ("null", None), ("some", [None, "", "one two"])], "doc string, pages array<string>")
    chunks = chunking.chunk_documents(docs).collect()
    assert {r.doc for r in chunks} == {"m"} and not any(head in r.text for r in chunks)
    assert {r.section for r in chunks} <= {f"4.{k} Wound Care Basics" for k in range(1, 7)}
    by_count = chunking.chunk_documents(docs, count=len).collect()
    assert len(by_count) != len(chunks)


def test_boilerplate_within_a_document_is_that_of_the_grouped_query(spark):
    pages = fx.PAGES.frame(spark)
    lines = chunking.clean_pages(pages)
    assert {tuple(r) for r in chunking.boilerplate(lines).collect()} == {("manual", "Field Manual Header"), ("manual", "Keep the limb still and the patient warm.")}
    docs = pages.groupBy("doc").agg(F.transform(F.sort_array(F.collect_list(F.struct("page", "text"))), lambda p: p["text"]).alias("pages"))
    whole = chunking.chunk_documents(docs, least=1).where("doc = 'manual'").collect()
    kept = chunking.strip_boilerplate(lines).where("doc = 'manual'").orderBy("page", "line_no").collect()
    assert "\n".join(r.text for r in whole) == "\n".join(r.line for r in kept)


def test_cleaning(spark):
    df = spark.createDataFrame([("ﬁne    line next\x85end",), (None,)], "t string")
    rows = df.select(tx.clean_lines(tx.nfkc(F.coalesce("t", F.lit("")))).alias("l")).collect()
    assert [r.l for r in rows] == [["fine line", "next", "end"], []]


@pytest.mark.parametrize("text,ratio", [("The Quick brown", 2 / 3), ("", 0.0), ("12 34", 0.0), ("O'Neil's hand-Care", 0.5)])
def test_title_case_ratio(spark, text, ratio):
    assert spark.createDataFrame([(text,)], "t string").select(tx.title_case_ratio(F.col("t"))).first()[0] == pytest.approx(ratio)


def test_running_heads_are_the_same_in_parts_of_any_size(spark, monkeypatch):
    pages = [(d, p, "\n".join(["Field Manual" if p % 3 else "other", f"only on {p}", *(f"{d} line {p} {k}" for k in range(20))])) for d in "ab" for p in range(1, 31)]
    lines = chunking.clean_pages(spark.createDataFrame(pages, "doc string, page int, text string").coalesce(1))
    want = {("a", "Field Manual"), ("a", "other"), ("b", "Field Manual"), ("b", "other")}
    for size in (chunking.PART_LINES, 50, 1):
        monkeypatch.setattr(chunking, "PART_LINES", size)
        written, saved = [], chunking.shared.written
        monkeypatch.setattr(chunking.shared, "written", lambda df, label: written.append((label, saved(df, label))) or written[-1][1])
        assert {tuple(r) for r in chunking.boilerplate(lines).collect()} == want
        monkeypatch.setattr(chunking.shared, "written", saved)
        parts = dict(written)["lines"].where("line is null").groupBy("doc").count().agg(F.max("count")).first()[0]
        assert parts == 1 if size > 50 else parts >= 8


def test_nfkc_of_lists_and_texts(spark):
    texts = ["plain", "ﬁne ½", None, "", "Ａ b", "é"]
    df = spark.createDataFrame([(k, t, [t or "", "x", "ﬂ"] if t != "" else None) for k, t in enumerate(texts)], "k int, t string, p array<string>").coalesce(1)
    got = df.select(tx.nfkc(F.col("t")).alias("t"), chunking._nfkc_pages("p").alias("p")).collect()
    want = ["plain", "fine 1⁄2", None, "", "A b", "é"]
    assert [r.t for r in got] == want
    assert [r.p for r in got] == [None if w == "" else [w or "", "x", "fl"] for w in want]
