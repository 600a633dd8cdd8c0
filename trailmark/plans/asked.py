"""Queries of search by text: documents ask with their own texts, and every vector asks for its neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import shared
from ..functions import embedder
from ..functions import text as tx
from ..operators import search
from . import search as sq

#: Buckets of the hashed search: few enough that a vector of all of them is small.
BUCKETS = 256


def _documents(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id").alias("id"), "text")


def _asking(vectors: DataFrame) -> DataFrame:
    return vectors.where("id % 20 = 0").select(F.col("id").alias("query_id"), "vector")


def text_search_hashed(spark: SparkSession, sf: str) -> DataFrame:
    """Every twentieth document asks with its hashed words for the three texts most like its own."""
    vectors = shared.written(embedder.hashed(_documents(spark, sf), BUCKETS).drop("text"), "hashed")
    hits = search.top_k(vectors, _asking(vectors), 3, skip_self=True)
    return hits.withColumn("similarity", search.rounded())


def text_search(spark: SparkSession, sf: str) -> DataFrame:
    """The same with an embedder learned from all documents, gated, with citations."""
    counts = shared.written(embedder.counted(_documents(spark, sf)), "counted")
    vectors = shared.written(embedder.embed_counted(counts, embedder.learn_counted(counts)), "embedded")
    gated = search.gate(search.top_k(vectors, _asking(vectors), 3, skip_self=True), _asking(vectors))
    hits = search.show(gated, sq._texts(spark, sf))
    return hits.select("query_id", "rank", "id", "citation", tx.snippet(F.col("text"), 160).alias("snippet"), search.rounded().alias("similarity"))


def vector_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    """The nearest other vector of every vector; so many queries are joined in blocks, not broadcast."""
    corpus = sq._corpus(spark, sf).where("vector is not null")
    hits = search.joined_top_k(corpus, corpus.select(F.col("id").alias("query_id"), "vector"), 1, skip_self=True)
    best = hits.groupBy("query_id").agg(F.max_by(F.struct("id", "similarity"), F.struct("similarity", -F.col("id"))).alias("b"))
    return best.select("query_id", "b.id", search.rounded(F.col("b.similarity")).alias("similarity"))


QUERIES = {f.__name__: f for f in (text_search_hashed, text_search, vector_neighbours)}
_WORDS = r"list_filter(regexp_split_to_array(lower(text), '[ \t\n\x0b\f\r]+'), lambda w: w <> '')"
ORACLE = {
    "text_search_hashed": f"""WITH w AS (SELECT doc_id AS id, {_WORDS} AS w FROM documents WHERE text IS NOT NULL),
        f AS (SELECT id, unnest(w) AS f FROM w UNION ALL SELECT id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM w),
        n AS (SELECT id, ('0x' || substr(md5(f), 1, 7))::BIGINT % {BUCKETS} AS b, ln(1 + count(*)) AS x FROM f GROUP BY 1, 2),
        l AS (SELECT id, sqrt(sum(x * x)) AS l FROM n GROUP BY 1), v AS (SELECT id, b, x / l AS x FROM n JOIN l USING (id)),
        s AS (SELECT q.id AS query_id, c.id, round(sum(q.x * c.x), 12) AS sim FROM v q JOIN v c USING (b) WHERE q.id % 20 = 0 AND q.id <> c.id GROUP BY 1, 2),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, id) AS rank FROM s)
        SELECT query_id, rank::INTEGER AS rank, id, round(sim, 4) AS similarity FROM r WHERE rank <= 3""",
    "vector_neighbours": """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE embedding IS NOT NULL),
        s AS (SELECT q.vec_id AS query_id, c.vec_id AS id, round(list_dot_product(q.v, c.v), 12) AS sim FROM v q JOIN v c ON c.vec_id <> q.vec_id)
        SELECT query_id, id, round(sim, 4) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, id) AS rank FROM s) WHERE rank = 1""",
}
