"""The plans are the ones meant: pruned scans, pushed filters, no needless exchanges or Python."""

import re

import pytest
from pyspark.sql import functions as F

from trailmark.operators import chunking, training
from trailmark.plans import catalog

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_and_columns_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "chunks")
    spark.range(100).select("id", (F.col("id") * 3).cast("int").alias("token_count"), F.lit("t").alias("text"), F.lit("c").alias("citation"), F.lit(None).cast("string").alias("section")).write.parquet(path)
    text = plan(training.usable(spark.read.parquet(path)).select("id", "token_count"))
    assert "GreaterThanOrEqual(token_count,80)" in text
    assert re.search(r"ReadSchema: struct<id:bigint,token_count:int>", text)


@pytest.mark.parametrize("name,columns", [("html_clean", {"page_id", "html"}), ("vector_norms", {"vec_id", "embedding"}), ("chunk_greedy", {"doc_id", "text"}), ("citation_format", {"doc_id", "source"})])
def test_scans_read_what_a_query_needs(spark, name, columns):
    read = re.findall(r"ReadSchema: struct<([^\n]*)>", plan(catalog.QUERIES[name](spark, SF)))
    assert all({re.sub(r":.*", "", c) for c in re.split(r",(?=\w+:)", r)} <= columns for r in read)


@pytest.mark.parametrize("name", ["safety_filter", "html_clean", "steps_extract", "license_gate", "vector_norms", "transcript_final"])
def test_queries_of_built_ins_stay_in_the_jvm(spark, name):
    assert not re.search("Python|Pandas|InArrow", plan(catalog.QUERIES[name](spark, SF)))


def test_keywords_are_no_product_with_documents(spark):
    assert not re.search("NestedLoop|Cartesian", plan(catalog.QUERIES["keyword_chunks"](spark, SF)))


def test_steps_are_worked_out_once(spark):
    assert plan(catalog.QUERIES["steps_extract"](spark, SF)).count("split(") <= 2
    assert plan(catalog.QUERIES["training_grounded"](spark, SF)).count("Figure|") <= 1 and "Generate inline" in plan(catalog.QUERIES["training_grounded"](spark, SF))


def test_a_document_is_chunked_without_a_shuffle(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select(F.col("doc_id").alias("doc"), F.array("text").alias("pages"))
    assert "Exchange" not in plan(chunking.chunk_documents(docs))


def test_search_shuffles_hits_and_not_scores(spark):
    text = plan(catalog.QUERIES["vector_topk_batch"](spark, SF))
    assert text.count("Exchange hashpartitioning(query_id") == 1
    assert "WindowGroupLimit" in text and not re.search("Cartesian|NestedLoop", text)
