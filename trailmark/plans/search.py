"""Queries of search, vectors and prompts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import shared
from ..functions import text as tx
from ..functions import vectors as vc
from ..functions import wordpiece
from ..operators import prompts, search, validation
from . import derived
from . import fixtures as fx


def _corpus(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))


def _queries(spark: SparkSession, sf: str) -> DataFrame:
    """Every twentieth vector asks."""
    return spark.read.parquet(f"{sf}/embeddings.parquet").where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))


def vector_topk_batch(spark: SparkSession, sf: str) -> DataFrame:
    return search.top_k(_corpus(spark, sf), _queries(spark, sf), 3, skip_self=True).withColumn("similarity", search.rounded())


def vector_topk_gate(spark: SparkSession, sf: str) -> DataFrame:
    queries = _queries(spark, sf)
    gated = search.gate(search.top_k(_corpus(spark, sf), queries, 3, skip_self=True), queries)
    return gated.select("query_id", "result", F.inline_outer("chunks")).withColumn("similarity", search.rounded())


def vector_gate_summary(spark: SparkSession, sf: str) -> DataFrame:
    queries = _queries(spark, sf)
    gated = search.gate(search.top_k(_corpus(spark, sf), queries, 3, skip_self=True), queries)
    return gated.groupBy("result").agg(F.count("*").alias("n_queries"), F.sum(F.size("chunks")).alias("n_hits"))


def _texts(spark: SparkSession, sf: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    page = (F.col("doc_id") + 1).cast("int")
    return docs.select(F.col("doc_id").alias("id"), tx.citation(F.col("source"), F.lit(None).cast("string"), page, page).alias("citation"), "text")


def search_cited(spark: SparkSession, sf: str) -> DataFrame:
    hits = search.search(_corpus(spark, sf), _texts(spark, sf), _queries(spark, sf), 3, 0.35)
    return hits.select("query_id", "rank", "id", "citation", tx.snippet(F.col("text"), 160).alias("snippet"), search.rounded().alias("similarity"))


def prompt_assembly(spark: SparkSession, sf: str) -> DataFrame:
    queries, texts = _queries(spark, sf), _texts(spark, sf)
    gated = shared.written(search.gate(search.top_k(_corpus(spark, sf), queries, 3), queries), "gated")
    hits = search.show(gated, texts)
    asked = queries.join(texts, queries["query_id"] == texts["id"]).select("query_id", F.col("text").alias("question"))
    out = prompts.build(asked, gated, hits)
    return out.select("query_id", "result", "citation", F.md5("prompt").alias("prompt_md5"), F.length("prompt").alias("prompt_chars"))


def excerpt_prompts(spark: SparkSession, sf: str) -> DataFrame:
    """Numbered excerpts of the two best hits of every search, asked with the whole text."""
    queries, texts = _queries(spark, sf), _texts(spark, sf)
    gated = shared.written(search.gate(search.top_k(_corpus(spark, sf), queries, 2, skip_self=True), queries, 0.6), "gated")
    asked = queries.join(texts, queries["query_id"] == texts["id"]).select("query_id", F.col("text").alias("question"))
    out = prompts.build(asked, gated, search.show(gated, texts), prompts.excerpt_prompt)
    return out.select("query_id", "result", "citation", F.md5("prompt").alias("prompt_md5"))


#: What searches are asked with: (case, k, threshold). A threshold over one is reached by none, k below one finds none.
CASES = [(1, 3, 0.35), (2, 1, 0.6), (3, 0, -1.0), (4, 2, -1.0), (5, 3, 1.1)]


def fixture_search(spark: SparkSession, sf: str) -> DataFrame:
    """Every search with other numbers of hits and thresholds."""
    out = None
    for case, k, threshold in CASES:
        queries = _queries(spark, sf)
        gated = search.gate(search.top_k(_corpus(spark, sf), queries, k, skip_self=True), queries, threshold)
        one = gated.select(F.lit(case).alias("case_id"), "query_id", "result", F.inline_outer("chunks"))
        out = one if out is None else out.unionByName(one)
    return out.select("case_id", "query_id", "result", "rank", "id", search.rounded().alias("similarity"))


def vector_norms(spark: SparkSession, sf: str) -> DataFrame:
    return validation.norms(_corpus(spark, sf)).select("id", F.round("norm", 6).alias("norm"), "unit")


def vector_masked_mean(spark: SparkSession, sf: str) -> DataFrame:
    """Every vector averaged with its reverse and a masked row, at unit length."""
    v = F.col("vector")
    rows = F.array(v, F.reverse(v), F.transform(v, lambda x: x * 0 + 9))
    mean = vc.masked_mean(rows, F.array(F.lit(1), F.lit(1), F.lit(0)))
    norms = tx.let(mean, lambda m: F.struct(vc.norm(m).alias("mean"), vc.norm(vc.normalize(m)).alias("unit")))
    found = _corpus(spark, sf).select("id", F.inline(F.array(norms)))  # a generator's output is worked out once
    return found.select("id", F.round("mean", 6).alias("mean_norm"), F.round("unit", 6).alias("unit_norm"))


def vector_dim_check(spark: SparkSession, sf: str) -> DataFrame:
    return validation.dimensions(_corpus(spark, sf))


def vector_parity(spark: SparkSession, sf: str) -> DataFrame:
    ours = _corpus(spark, sf).select(F.col("id").cast("string").alias("text"), F.col("vector").alias("embedding"))
    fixtures = ours.select("text", vc.rounded(F.col("embedding"), 6).alias("embedding"))
    return validation.parity(ours, fixtures).select("text", F.round("similarity", 4).alias("similarity"), "ok")


def vector_codec_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    packed = _corpus(spark, sf).withColumn("raw", vc.to_float32_le("vector"))
    back = packed.withColumn("back", vc.from_float32_le("raw"))
    return back.select("id", F.length("raw").alias("n_bytes"), (F.col("back") == F.col("vector")).alias("same"))


#: The fixture's vocabulary with all letters as words and as ends of words.
PIECES = [*fx.VOCABULARY, *"abcdefghijklmnopqrstuvwxyz", *(f"##{c}" for c in "abcdefghijklmnopqrstuvwxyz")]
_LETTERS = "[a-z]{1,12}"


def wordpiece_encode(spark: SparkSession, sf: str) -> DataFrame:
    """The fixture's texts in its own vocabulary, and short words of all documents in one that has every letter."""
    config = wordpiece.Config(16, cls_token_id=2, sep_token_id=3, pad_token_id=0, unk_token_id=1)
    words = spark.read.parquet(f"{sf}/documents.parquet").select(F.explode(F.regexp_extract_all("text", F.lit(_LETTERS), 0)).alias("text")).distinct()
    vocabulary = lambda listed: {t: k for k, t in enumerate(listed)}
    rows = wordpiece.encode_column(fx.WORDPIECE.frame(spark).select("text"), vocabulary(fx.VOCABULARY), config).unionByName(wordpiece.encode_column(words, vocabulary(PIECES), config))
    used = F.aggregate("attention_mask", F.lit(0), lambda s, x: s + x)
    return rows.select("text", F.array_join(F.slice("input_ids", F.lit(1), used).cast("array<string>"), " ").alias("ids"), F.size("input_ids").alias("n"))


def images_for_hits(spark: SparkSession, sf: str) -> DataFrame:
    """Images of the chunks that searches hit, and of the fixture's."""
    images = derived.hit_images(spark, sf).withColumnRenamed("payload", "bytes")
    found = search.top_k(_corpus(spark, sf), _queries(spark, sf), 3, skip_self=True).select(F.col("id").alias("chunk_id"))
    hits = spark.createDataFrame([(1,), (2,), (9999,)], "chunk_id long").unionByName(found)
    return search.images_for_hits(hits, images).select("chunk_id", "species_slug", "ordinal", "license", "attribution", "source_url", F.length("bytes").alias("n_bytes"))


_TOP = """v AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS id, list_dot_product(q.v, c.v) AS sim FROM v q JOIN v c ON {join} WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, id) AS rank FROM s),
t AS (SELECT query_id, rank::INTEGER AS rank, id, sim FROM r WHERE rank <= 3),
b AS (SELECT query_id, max(sim) AS best FROM t GROUP BY 1)"""
_OTHERS, _ALL = _TOP.format(join="c.vec_id <> q.vec_id"), _TOP.format(join="true")
_CITED = r"""d AS (SELECT doc_id AS id, '[Source: ' || source || ', p. ' || (doc_id + 1) || ']' AS citation, text, trim(regexp_replace(text, '[ \t\n\x0b\f\r]+', ' ', 'g'), ' ') AS flat FROM documents)"""

QUERIES = {f.__name__: f for f in (vector_topk_batch, vector_topk_gate, vector_gate_summary, search_cited, prompt_assembly, excerpt_prompts, fixture_search, vector_norms, vector_masked_mean, vector_dim_check, vector_parity, vector_codec_roundtrip, wordpiece_encode, images_for_hits)}
ORACLE = {
    "vector_topk_batch": f"WITH {_OTHERS} SELECT query_id, rank, id, round(sim, 4) AS similarity FROM t",
    "vector_topk_gate": f"""WITH {_OTHERS} SELECT b.query_id, CASE WHEN best >= 0.35 THEN 'match' ELSE 'noConfidentMatch' END AS result,
        t.rank, t.id, round(t.sim, 4) AS similarity FROM b LEFT JOIN t ON t.query_id = b.query_id AND best >= 0.35""",
    "vector_gate_summary": f"""WITH {_OTHERS} SELECT CASE WHEN best >= 0.35 THEN 'match' ELSE 'noConfidentMatch' END AS result, count(*) AS n_queries,
        CAST(sum(CASE WHEN best >= 0.35 THEN n ELSE 0 END) AS BIGINT) AS n_hits FROM b JOIN (SELECT query_id, count(*) AS n FROM t GROUP BY 1) c USING (query_id) GROUP BY 1""",
    "search_cited": f"""WITH {_ALL}, {_CITED} SELECT query_id, rank, id, citation, substr(flat, 1, 160) AS snippet, round(sim, 4) AS similarity FROM t JOIN d USING (id) JOIN b USING (query_id) WHERE best >= 0.35""",
    "prompt_assembly": f"""WITH {_ALL}, {_CITED},
        x AS (SELECT query_id, string_agg(citation || chr(10) || text, chr(10) || chr(10) ORDER BY rank) AS ctx, min_by(citation, rank) AS top FROM t JOIN d USING (id) JOIN b USING (query_id) WHERE best >= 0.35 GROUP BY 1),
        p AS (SELECT b.query_id, CASE WHEN best >= 0.35 THEN 'match' ELSE 'noConfidentMatch' END AS result, CASE WHEN best >= 0.35 THEN top END AS citation,
              'Retrieved context:' || chr(10) || CASE WHEN best >= 0.35 THEN ctx ELSE 'NO_MATCHING_PROTOCOL_FOUND' END || chr(10) || chr(10) || 'User question: ' || trim(text) AS prompt
              FROM b JOIN d ON d.id = b.query_id LEFT JOIN x USING (query_id) WHERE trim(text) <> '')
        SELECT query_id, result, citation, md5(prompt) AS prompt_md5, length(prompt)::INTEGER AS prompt_chars FROM p""",
    "excerpt_prompts": f"""WITH {_OTHERS}, {_CITED},
        x AS (SELECT query_id, string_agg('[EXCERPT ' || rank || '] ' || citation || chr(10) || text, chr(10) || chr(10) ORDER BY rank) AS ctx, min_by(citation, rank) AS top FROM t JOIN d USING (id) WHERE rank <= 2 GROUP BY 1)
        SELECT b.query_id, CASE WHEN best >= 0.6 THEN 'match' ELSE 'noConfidentMatch' END AS result, CASE WHEN best >= 0.6 THEN top END AS citation,
        md5(CASE WHEN best >= 0.6 THEN 'Retrieved excerpts:' || chr(10) || chr(10) || ctx || chr(10) || chr(10) || 'Responder asked: ' || trim(text) || chr(10) || chr(10)
        || 'If these excerpts genuinely cover the question, answer from them and open with the citation. If they do not, say that no matching protocol was found.'
        ELSE 'No protocol excerpt matched this question with sufficient confidence.' || chr(10) || chr(10) || 'Responder asked: ' || trim(text) END) AS prompt_md5
        FROM b JOIN d ON d.id = b.query_id LEFT JOIN x USING (query_id) WHERE trim(text) <> ''""",
    "fixture_search": f"""WITH {_OTHERS}, cases(case_id, k, least) AS (VALUES {", ".join(f"({c}::INTEGER, {k}, {t}::DOUBLE)" for c, k, t in CASES)}),
        q AS (SELECT vec_id AS query_id FROM embeddings WHERE vec_id % 20 = 0), m AS (SELECT * FROM cases, q LEFT JOIN b USING (query_id)),
        y AS (SELECT *, coalesce(k > 0 AND best >= least, false) AS ok FROM m)
        SELECT case_id, y.query_id, CASE WHEN ok THEN 'match' ELSE 'noConfidentMatch' END AS result, rank, id, round(sim, 4) AS similarity FROM y LEFT JOIN t ON t.query_id = y.query_id AND ok AND rank <= k""",
    "vector_norms": "SELECT vec_id AS id, round(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS norm, abs(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) - 1) <= 1e-3 AS \"unit\" FROM embeddings",
    "vector_masked_mean": """WITH m AS (SELECT vec_id AS id, list_transform(list_zip(embedding::DOUBLE[], list_reverse(embedding::DOUBLE[])), lambda p: (p[1] + p[2]) / 2) AS m FROM embeddings)
        SELECT id, round(sqrt(list_dot_product(m, m)), 6) AS mean_norm, 1.0::DOUBLE AS unit_norm FROM m""",
    "vector_dim_check": "SELECT count(*) AS n, min(len(embedding))::INTEGER AS min_dim, max(len(embedding))::INTEGER AS max_dim, min(len(embedding)) = max(len(embedding)) AS uniform FROM embeddings WHERE embedding IS NOT NULL",
    "vector_parity": """WITH v AS (SELECT vec_id::VARCHAR AS text, embedding::DOUBLE[] AS a, list_transform(embedding::DOUBLE[], lambda x: round(x, 6)) AS b FROM embeddings)
        SELECT text, round(list_dot_product(a, b), 4) AS similarity, list_dot_product(a, b) >= 0.999 AS ok FROM v""",
    "vector_codec_roundtrip": "SELECT vec_id AS id, (4 * len(embedding))::INTEGER AS n_bytes, true AS same FROM embeddings",
    "wordpiece_encode": f"""WITH RECURSIVE {fx.WORDPIECE.values('f')}, v(id, piece) AS (VALUES {", ".join(f"({k}, '{p}')" for k, p in enumerate(PIECES))}),
        w AS (SELECT DISTINCT unnest(regexp_extract_all(text, '{_LETTERS}')) AS text FROM documents),
        st(text, rest, ids) AS (SELECT text, text, '2' FROM w UNION ALL
            SELECT text, arg_max(substr(rest, length(replace(piece, '##', '')) + 1), length(piece)), ids || ' ' || arg_max(id, length(piece))
            FROM st JOIN v ON CASE WHEN ids = '2' THEN starts_with(rest, piece) ELSE starts_with('##' || rest, piece) AND starts_with(piece, '##') END WHERE rest <> '' GROUP BY text, rest, ids)
        SELECT text, ids, 16::INTEGER AS n FROM f UNION ALL SELECT text, ids || ' 3', 16 FROM st WHERE rest = ''""",
    "images_for_hits": f"""WITH {fx.HIT_IMAGES.values('fi')}, i AS (SELECT * FROM fi UNION ALL {derived.HIT_IMAGES_SQL}), {_OTHERS}
        SELECT chunk_id, species_slug, ordinal, license, attribution, source_url, size AS n_bytes FROM i WHERE size > 0 AND (chunk_id IN (1, 2, 9999) OR chunk_id IN (SELECT id FROM t))""",
}
