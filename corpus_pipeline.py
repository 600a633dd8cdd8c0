"""From raw documents to packed token sequences, one operator a stage.

1. language: documents without a letter, and those whose language the model can't tell, go.
2. quality: documents whose perplexity under the model of trusted text is too high go.
3. near_duplicates: of every group of documents linked by 5-word shingles at 0.8, one row stays:
   that of the least doc_id (rows without one come last).
4. packing: what is left becomes sequences of 4096 tokens.

Each stage is written as Parquet and read again. Rows that share doc_id and text are one
document to the stage of near-duplicates; rows that share a doc_id alone are documents of their
own in every stage, as are rows without one. A null text goes in the first stage; texts of any
length are judged whole; an empty table stays empty. Extra columns are carried by all stages but
the last, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmark.llm import hilbert_pack, jaccard_join, kneser_ney, language_id
from trailmark.llm.columns import free
from trailmark.llm.common import Scratch

#: Below this posterior another language is about as likely.
LEAST_POSTERIOR = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language is told with a posterior of at least one half."""
    model = language_id.learn(docs)
    told, posterior = free(docs, "_language", "_posterior")
    found = language_id.predict(docs, model, told, posterior)
    unsure = F.lit(not model.languages) & F.col("text").rlike(r"\p{L}")  # nothing was learned: nothing to reject by
    return found.where(unsure | (F.col(told) != language_id.UNKNOWN) & (F.col(posterior) >= LEAST_POSTERIOR)).select(_columns(docs))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents within their language's threshold of perplexity."""
    found = kneser_ney.classify(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).where("not kept")
    return _without(docs, found)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each class; a text without words is a class of its own."""
    found = Scratch(spark, "near").save(jaccard_join.join(docs.select("doc_id", "text", _row().alias("row")), class_key=True), "classes")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row"))
    stay = found.where("class_key is not null").groupBy("class_key").agg(first.alias("s")).select("s.doc_id", "s.row")
    left = _without(docs, stay.unionByName(found.where("class_key is null").select("doc_id", "row").distinct()), "left_semi")
    again = found.groupBy("doc_id", "row").agg(F.count("*").alias("n")).where("n > 1")
    many = _without(left, again, "left_semi")
    # of rows that share doc_id and text the one whose columns hash to the least
    once = many.groupBy(_row().alias("row"), "doc_id").agg(F.min_by(F.struct(*_columns(docs)), F.xxhash64(F.to_json(F.struct(*_columns(docs))))).alias("kept"))
    return _without(left, again).unionByName(once.select(*(F.col("kept")[c].alias(c) for c in docs.columns)))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the packed sequences, with checksums of their ids."""
    return hilbert_pack.digests(hilbert_pack.pack(docs))


def _row() -> Column:
    """A document by its id and its text."""
    return F.xxhash64("doc_id", "text")


def _without(docs: DataFrame, rows: DataFrame, how: str = "left_anti") -> DataFrame:
    """docs but those of rows(doc_id, row); with left_semi only those."""
    key, doc, row = free(docs, "_key", "_doc", "_row")
    listed = rows.select(F.col("doc_id").alias(doc), F.col("row").alias(row))
    return docs.withColumn(key, _row()).join(listed, (F.col(key) == F.col(row)) & F.col("doc_id").eqNullSafe(F.col(doc)), how).select(_columns(docs))


def _columns(docs: DataFrame) -> list:
    return [F.col(f"`{c}`") for c in docs.columns]


STAGES = [("language", language), ("quality", quality), ("near_duplicates", near_duplicates), ("packing", packing)]

#: Language, quality and packing are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents, each written and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return docs
