"""Queries of corpora that are stored, rebuilt in place and looked up, and of pages and records as they are read."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import shared
from ..operators import chunking, corpus, prompts, search
from ..sources import files
from . import search as sq
from . import store as st


def _chunks(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/documents.parquet").select(F.col("source").alias("filename"), F.col("doc_id").alias("id"), "text", F.octet_length("text").alias("n_bytes"))


def pack_rebuild(spark: SparkSession, sf: str) -> DataFrame:
    """The stored documents with source src0 replaced by its even ones, last first, twice over."""
    path, chunks = shared.folder(spark, "chunks"), _chunks(spark, sf)
    corpus.write_by_source(chunks, path)
    pack = chunks.where("filename = 'src0' and id % 2 = 0").withColumn("at", -F.col("id"))
    for _ in range(2):
        corpus.rebuild_source(spark, path, "src0", pack, "at")
    return spark.read.parquet(path).select("id", "filename", F.md5("text").alias("text_md5"), "n_bytes")


def hit_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """The stored documents of the hits of every search, looked up by id in buckets."""
    hits = search.top_k(sq._corpus(spark, sf), sq._queries(spark, sf), 3, skip_self=True)
    table = corpus.ById.write(_chunks(spark, sf), f"chunks_{uuid.uuid4().hex}", 8, shared.folder(spark, "by_id"))
    found = shared.written(table.find(hits.select("query_id", "rank", "id")), "found")
    table.drop()
    return found.select("query_id", "rank", "id", "filename", F.md5("text").alias("text_md5"))


def page_paragraphs(spark: SparkSession, sf: str) -> DataFrame:
    """Every web page's article by paragraphs; one that isn't closed is an empty page."""
    pages = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "html")
    return files.page_rows(pages, "html", files.html_pages, ["page_id"])


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    """A line for every turn: a record, cut short, of two messages, or blank, by the turn's number."""
    talk = spark.read.parquet(f"{sf}/conversations.parquet")
    at = (F.col("conv_id") * 31 + F.col("turn")) % 7
    three = prompts.messages(F.concat_ws(".", F.lit("id"), "conv_id", "turn"), F.coalesce("text", F.lit("")), F.lit(st.SYSTEM))
    json = F.to_json(F.struct(F.when(at == 1, F.slice(three, 1, 2)).otherwise(three).alias("messages")))
    told = F.when(at == 0, F.expr("left(j, length(j) - 3)")).when(at == 2, " ").otherwise(F.col("j"))
    return talk.withColumn("j", json).select(told.alias("value"))


def records_quarantine(spark: SparkSession, sf: str) -> DataFrame:
    """What becomes of those lines: kept, or why not, and which turns they are of."""
    path = shared.folder(spark, "lines")
    files.write_lines(_lines(spark, sf), path)
    kept, bad = files.sorted_records(spark, path)
    turn = lambda c: F.regexp_extract(c, r"id\.(\d+\.\d+)", 1)
    return kept.select(F.lit("kept").alias("reason"), turn(F.col("messages")[0]["content"]).alias("turn")).unionByName(bad.select("reason", turn(F.col("line")).alias("turn")))


def chunk_sources(spark: SparkSession, sf: str) -> DataFrame:
    """Every source as one long document whose pages are its documents, chunked by segments."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    pages = docs.select(F.col("source").alias("doc"), (F.col("doc_id") + 1).cast("int").alias("page"), "text")
    found = chunking.chunk_pages(pages)
    return found.select("doc", "seq", F.md5("text").alias("text_md5"), "section", "page_start", "page_end", "token_count")


QUERIES = {f.__name__: f for f in (pack_rebuild, hit_lookup, page_paragraphs, records_quarantine, chunk_sources)}
ORACLE = {
    "pack_rebuild": """WITH o AS (SELECT doc_id AS id, source AS filename, text FROM documents WHERE source <> 'src0'),
        p AS (SELECT (SELECT coalesce(max(id), 0) FROM o) + row_number() OVER (ORDER BY doc_id DESC) AS id, source AS filename, text FROM documents WHERE source = 'src0' AND doc_id % 2 = 0)
        SELECT id, filename, md5(text) AS text_md5, strlen(text)::INTEGER AS n_bytes FROM (SELECT * FROM o UNION ALL SELECT * FROM p)""",
    "hit_lookup": f"WITH {sq._OTHERS} SELECT query_id, rank, id, source AS filename, md5(text) AS text_md5 FROM t JOIN documents d ON d.doc_id = t.id",
    "page_paragraphs": r"""WITH b AS (SELECT page_id, string_split(string_split(html, '<article>')[2], '</article>')[1] AS body FROM pages),
        p AS (SELECT page_id, (string_split(body, '<p>'))[2:] AS ps FROM b), e AS (SELECT page_id, unnest(range(1, len(ps) + 1))::INTEGER AS page, unnest(ps) AS t FROM p)
        SELECT page_id, page, CASE WHEN contains(t, '</p>') THEN trim(regexp_replace(regexp_replace(string_split(t, '</p>')[1], '<[^>]+>', '', 'g'), '\s+', ' ', 'g')) ELSE '' END AS text FROM e""",
    "records_quarantine": """SELECT CASE (conv_id * 31 + turn) % 7 WHEN 0 THEN 'no JSON' WHEN 1 THEN 'no record of three messages' WHEN 2 THEN 'blank' ELSE 'kept' END AS reason,
        CASE WHEN (conv_id * 31 + turn) % 7 = 2 THEN '' ELSE conv_id || '.' || turn END AS turn FROM conversations""",
}
