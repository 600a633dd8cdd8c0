"""Every query with an oracle gives the oracle's rows on the smallest tables."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from trailmark.operators import chunking
from trailmark.plans import catalog

SF = "/root/testdata/sf0.001"


def plain(v):
    if hasattr(v, "asDict"):
        v = v.asDict()
    if isinstance(v, dict):
        return tuple((k, plain(x)) for k, x in v.items())
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return round(v, 6) if isinstance(v, float) else bytes(v) if isinstance(v, bytearray) else v


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_query(spark, tables, name):
    df = catalog.QUERIES[name](spark, SF)
    rows = df.collect()
    found = tables.execute(catalog.ORACLE[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(df.columns)
    order = sorted(columns)
    want = sorted(repr([plain(r[columns.index(c)]) for c in order]) for r in found.fetchall())
    assert sorted(repr([plain(r[c]) for c in order]) for r in rows) == want


def test_sources_in_segments_are_chunked_as_in_one_piece(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    whole = docs.groupBy(F.col("source").alias("doc")).agg(F.sort_array(F.collect_list(F.struct("doc_id", "text"))).alias("p")).select("doc", F.transform("p", lambda x: x["text"]).alias("pages"))
    want = sorted(tuple(r) for r in chunking.chunk_documents(whole).select("doc", "seq", F.md5("text"), "token_count").collect())
    assert sorted(tuple(r) for r in catalog.QUERIES["chunk_sources"](spark, SF).select("doc", "seq", "text_md5", "token_count").collect()) == want


def test_texts_find_the_texts_like_them(spark):
    rows = catalog.QUERIES["text_search"](spark, SF).collect()
    assert set(catalog.QUERIES) - set(catalog.ORACLE) == {"chunk_sources", "text_search"}
    assert {r["rank"] for r in rows} == {1, 2, 3} and all(r["similarity"] <= 1 and r["query_id"] != r["id"] for r in rows)


def test_entry_has_a_stable_schema(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.columns == ["query_id", "result", "rank", "id", "similarity"] and df.count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
