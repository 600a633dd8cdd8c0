"""Queries of what a build writes and a service reads back: manifests, stores, records, answers, states.

What is read back was written to the shared folder by the same query.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import shared
from ..functions import safety
from ..functions import text as tx
from ..functions import vectors as vc
from ..functions import wordpiece
from ..operators import chunking, corpus, prompts, search, service, training, validation
from ..sources import files, manifests
from ..streaming import transcripts as ts
from . import derived
from . import fixtures as fx
from . import search as sq
from . import store as st
from . import texts as tq


def _file(spark: SparkSession, text: str) -> str:
    """The path of a text, written as one file."""
    path = shared.folder(spark, "file")
    files.write_lines(spark.createDataFrame([(text,)], "value string").coalesce(1), path)
    return path


def chunk_sections(spark: SparkSession, sf: str) -> DataFrame:
    """Guides of several pages under headings, and every document, chunked with their sections."""
    docs = spark.createDataFrame(fx.GUIDES, "doc string, pages array<string>")
    docs = docs.unionByName(spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id").cast("string").alias("doc"), F.array("text").alias("pages")))
    return chunking.chunk_documents(docs).select("doc", "seq", F.md5("text").alias("text_md5"), "section", "page_start", "page_end", "token_count")


def source_manifest(spark: SparkSession, sf: str) -> DataFrame:
    """A manifest of all documents' sources, in which one file is listed twice."""
    entries = [{"filename": f, "title": t, "license": "CC0", "citation_prefix": p} for f, t, p in fx.SOURCES.rows]
    entries += [{"filename": r["source"], "title": f"Title of {r['source']}", "license": "CC0", "citation_prefix": "Manual"} for r in derived.source_names(spark, sf).collect()]  # a manifest is written by hand
    first = {**entries[0], "title": "Replaced by the entry behind"}
    return manifests.sources(spark, _file(spark, json.dumps({"sources": [first, *entries]}))).select("filename", "title", "citation_prefix")


def card_manifest(spark: SparkSession, sf: str) -> DataFrame:
    """The fixture's cards, and one for every source, without their optional keys: the defaults are filled in."""
    cards = [{"slug": r[1], "common_name": r[2], "scientific_name": r[3], "hazard_class": r[4], "identification": r[6], "field_response": r[8], "source_citation": r[10], "commons_categories": [r[3]]} for r in fx.CARDS.rows]
    cards += [{"slug": r["source"], "common_name": r["source"], "scientific_name": "Nomen nudum", "hazard_class": "None", "identification": "none", "field_response": ["rest"], "source_citation": "M", "commons_categories": ["C"]} for r in derived.source_names(spark, sf).collect()]
    return manifests.cards(spark, _file(spark, json.dumps({"species": cards}))).select("slug", "region", "lookalikes", F.size("do_not").alias("n_do_not"), "max_images")


def _pinned(spark: SparkSession, sf: str) -> DataFrame:
    """image_pick's images as a lockfile that was written and read."""
    path = shared.folder(spark, "lock")
    image = F.struct("title", "license", F.lit("").alias("attribution"), F.lit("").alias("credit"), F.lit("").alias("descriptor_url"), F.lit("").alias("thumb_url"), F.lit(640).alias("width"), F.lit(480).alias("height"))
    picked = tq.image_pick(spark, sf).groupBy("slug").agg(F.sort_array(F.collect_list(F.struct("ordinal", image.alias("image")))).alias("i"))
    manifests.write_lockfile(picked.select("slug", F.transform("i", lambda x: x["image"]).alias("images")), path)
    return manifests.lockfile(spark, path)


def lockfile_images(spark: SparkSession, sf: str) -> DataFrame:
    return _pinned(spark, sf).select("slug", F.posexplode("images").alias("ordinal", "image")).select("slug", "ordinal", "image.title", "image.license")


def cards_imageless(spark: SparkSession, sf: str) -> DataFrame:
    """Cards that neither the lockfile nor the answers give an image; a build of them is refused."""
    cards = spark.createDataFrame([("ivy",), ("viper",), ("nettle",)], "slug string").unionByName(derived.source_names(spark, sf).toDF("slug"))
    pinned = _pinned(spark, sf)
    found = corpus.pinned_or_resolved(cards, pinned, pinned.limit(0))
    return validation.cards_without_images(cards, found.where(F.size("images") > 0)).select("slug")


def image_bytes(spark: SparkSession, sf: str) -> DataFrame:
    """Bytes of the image table by card; every payload but the first begins as a JPEG does."""
    body = F.concat(F.when(F.col("ordinal") > 0, "x").otherwise("").cast("binary"), "payload")
    raw = F.when(F.col("ordinal") == 0, F.concat(F.unhex(F.lit("FFD8FF")), body)).otherwise(body)
    return corpus.image_bytes(derived.hit_images(spark, sf).withColumn("bytes", raw))


def store_info(spark: SparkSession, sf: str) -> DataFrame:
    """Facts of a store of all vectors that was written and read; rows without a citation aren't loaded."""
    base = shared.folder(spark, "store")
    cited = F.when(F.col("vec_id") % 10 != 3, F.concat(F.lit("[Source: "), F.col("vec_id").cast("string"), F.lit("]")))
    chunks = spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").alias("id"), cited.alias("citation"), F.lit("text").alias("text"), vc.to_float32_le("embedding").alias("embedding"))
    corpus.write(spark, base, chunks=chunks, meta=spark.createDataFrame([("embeddings_normalized", "1")], "key string, value string"))
    return service.info(spark.read.parquet(f"{base}/meta"), corpus.resident(spark.read.parquet(f"{base}/chunks")))


def service_answers(spark: SparkSession, sf: str) -> DataFrame:
    """Every query vector's answer: the context of its hits behind the safety filter."""
    queries, texts = sq._queries(spark, sf), sq._texts(spark, sf)
    asked = queries.join(texts, queries["query_id"] == texts["id"]).select("query_id", "vector", F.col("text").alias("question"))
    out = service.ask(sq._corpus(spark, sf), texts, asked)
    return out.select("query_id", "result", "citation", F.md5("answer").alias("answer_md5"), "was_modified")


def middle_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.middle(st._store(spark, sf)[1]).select("id", "source_id", "citation")


def records_reload(spark: SparkSession, sf: str) -> DataFrame:
    """Records of all users' turns, written as lines of JSON and read again."""
    path = shared.folder(spark, "records")
    talk = spark.read.parquet(f"{sf}/conversations.parquet").where("role = 'user'")
    files.write_lines(training.as_json(talk.withColumnRenamed("text", "question").select(prompts.messages(F.lit(st.SYSTEM), F.col("question"), F.lit(training.NO_MATCH)).alias("messages"))), path)
    return training.valid_records(files.records(spark, path)).select(F.md5(F.col("messages")[1]["content"]).alias("question_md5"), F.size("messages").alias("n_messages"))


def training_dataset(spark: SparkSession, sf: str) -> DataFrame:
    """Records of the whole dataset by kind."""
    return training.dataset(st._training(spark, sf), st.SYSTEM).groupBy("kind").agg(F.count("*").alias("n"), F.sum(F.size("messages")).alias("n_messages"))


def parity_reload(spark: SparkSession, sf: str) -> DataFrame:
    """The store's texts, and labels with a count and the ends of their ids for a vector, as a parity file, written and read."""
    path = shared.folder(spark, "parity")
    ends = F.array(*(f(F.col("vec_id")).cast("double") for f in (F.count, F.min, F.max)), F.lit(0.0))
    labels = spark.read.parquet(f"{sf}/embeddings.parquet").groupBy("label").agg(ends.alias("vector")).select(F.concat(F.lit("label "), "label").alias("text"), "vector")
    files.write_lines(files.parity_json(fx.STORE.frame(spark).select("text", "vector").unionByName(labels), "fixture-model", 4), path)
    found = files.parity_fixtures(spark, path)
    return found.select("embedding_model", "embedding_dim", "normalized", "text", F.array_join(F.transform("embedding", lambda x: x.cast("int").cast("string")), " ").alias("vector"))


def vocabulary_reload(spark: SparkSession, sf: str) -> DataFrame:
    """A vocabulary with a blank line and line ends of either kind, and a tokenizer file beside it."""
    config = wordpiece.Config.read(files.tokenizer_config(spark, _file(spark, '{"max_sequence_length": 16, "unk_token_id": 1}')).write())
    names = sorted(r["source"] for r in derived.source_names(spark, sf).collect())
    listed = files.vocabulary(spark, _file(spark, "\r\n".join([*fx.VOCABULARY, "", "last", *names])))
    return spark.createDataFrame(list(listed.items()), "token string, id int").select("token", "id", F.lit(config.max_sequence_length).alias("longest"))


def sanitized_columns(spark: SparkSession, sf: str) -> DataFrame:
    """What a turn says and an error that quotes it, both behind the filter."""
    talk = spark.read.parquet(f"{sf}/conversations.parquet")
    out = safety.sanitize_columns(talk.select("conv_id", "turn", "text", F.concat(F.lit("failed at: "), "text").alias("error")), ["text", "error"])
    return out.select("conv_id", "turn", F.md5("text").alias("text_md5"), F.md5("error").alias("error_md5"))


_EVENTS = ["listen", "stop", "ask", "answer", "done", "fail", "reset"]


def screen_states(spark: SparkSession, sf: str) -> DataFrame:
    """The state of each user's screen after all events, whose names go by their id."""
    name = F.get(F.array(*map(F.lit, _EVENTS)), (F.col("event_id") % len(_EVENTS)).cast("int"))
    events = spark.read.parquet(f"{sf}/events.parquet").select(F.col("user_id").alias("key"), "ts", name.alias("event"))
    return ts.final_state(events).select(F.col("key").alias("user_id"), "state")


QUERIES = {f.__name__: f for f in (chunk_sections, source_manifest, card_manifest, lockfile_images, cards_imageless, image_bytes, store_info, service_answers, middle_chunks, records_reload, training_dataset, parity_reload, vocabulary_reload, sanitized_columns, screen_states)}
_BAD = lambda text: f"(len(list_filter([{', '.join(tq._matches(n, p, text) for n, p in safety.PATTERNS)}], lambda x: x)) > 0)"
_NAME = "[" + ", ".join(f"'{e}'" for e in _EVENTS) + "]"
_STEP = "CASE " + " ".join(f"WHEN s = '{s}' AND e = '{e}' THEN '{to}'" for (s, e), to in ts.STATES.items()) + " ELSE s END"
_WORDS = ", ".join(f"({k}, '{t}')" for k, t in enumerate([*fx.VOCABULARY, "", "last"]))
ORACLE = {
    "chunk_sections": f"WITH RECURSIVE {fx.GUIDE_CHUNKS.values('g')}, {tq._FOLD} SELECT doc, seq, md5(text) AS text_md5, section, page_start, page_end, token_count FROM g UNION ALL SELECT doc::VARCHAR, seq, text_md5, section, page_start, page_end, token_count FROM ch",
    "source_manifest": f"WITH {fx.SOURCES.values('s')} SELECT * FROM s UNION ALL SELECT DISTINCT source, 'Title of ' || source, 'Manual' FROM documents",
    "card_manifest": "SELECT * FROM (VALUES ('fixture-ivy', '', '', 0::INTEGER, 3::INTEGER), ('fixture-viper', '', '', 0, 3)) AS t(slug, region, lookalikes, n_do_not, max_images) UNION ALL SELECT DISTINCT source, '', '', 0, 3 FROM documents",
    "lockfile_images": f"WITH {tq._PICK} SELECT slug, ordinal, title, license FROM pick WHERE ordinal < 3",
    "cards_imageless": f"WITH {tq._PICK} SELECT slug FROM (SELECT * FROM (VALUES ('ivy'), ('viper'), ('nettle')) UNION ALL SELECT DISTINCT source FROM documents) AS c(slug) ANTI JOIN pick USING (slug)",
    "image_bytes": f"WITH {fx.HIT_IMAGES.values('fi')}, i AS (SELECT * FROM fi UNION ALL {derived.HIT_IMAGES_SQL}) SELECT species_slug, count(*) AS n_images, count(*) FILTER (ordinal = 0) AS n_jpeg, CAST(sum(size + CASE WHEN ordinal = 0 THEN 3 ELSE 1 END) AS BIGINT) AS total_bytes FROM i GROUP BY 1",
    "store_info": "SELECT count(*) AS chunk_count, max(len(embedding))::INTEGER AS dimension, 0.35::DOUBLE AS threshold, 3::INTEGER AS top_k FROM embeddings WHERE embedding IS NOT NULL AND vec_id % 10 <> 3",
    "service_answers": f"""WITH {sq._ALL}, {sq._CITED},
        x AS (SELECT query_id, string_agg(citation || chr(10) || text, chr(10) || chr(10) ORDER BY rank) AS ctx, min_by(citation, rank) AS top FROM t JOIN d USING (id) JOIN b USING (query_id) WHERE best >= {search.THRESHOLD} GROUP BY 1),
        a AS (SELECT b.query_id, CASE WHEN best >= {search.THRESHOLD} THEN 'match' ELSE 'noConfidentMatch' END AS result, top AS citation, coalesce(ctx, '{prompts.NO_MATCH}') AS raw
              FROM b JOIN d ON d.id = b.query_id LEFT JOIN x USING (query_id) WHERE trim(flat) <> ''),
        m AS (SELECT *, {_BAD("raw")} AS bad FROM a)
        SELECT query_id, result, citation, md5(CASE WHEN bad THEN '{safety.REPLACEMENT}' ELSE raw END) AS answer_md5, bad AS was_modified FROM m""",
    "middle_chunks": f"WITH {st._DOCS} SELECT id, source_id, citation FROM c WHERE id > (SELECT count(*) FROM c) // 2 AND id <= (SELECT count(*) FROM c) // 2 + 3",
    "records_reload": "WITH f AS (SELECT text AS question FROM conversations WHERE role = 'user') SELECT md5(question) AS question_md5, 3::INTEGER AS n_messages FROM f",
    "training_dataset": f"""WITH {st._TRAIN.replace("SEED", "17")}, {st._STEPS} s AS (SELECT id, {st._TAKE.format(n=5)} AS s FROM lists),
        n AS (SELECT 'grounded' AS kind, least(600, count(*)) AS n FROM s WHERE len(s) >= 2 UNION ALL SELECT 'refusal', 90 UNION ALL SELECT 'deflection', 120)
        SELECT kind, n, 3 * n AS n_messages FROM n WHERE n > 0""",
    "parity_reload": f"WITH {fx.STORE.values('s')} SELECT 'fixture-model' AS embedding_model, 4::INTEGER AS embedding_dim, true AS normalized, text, array_to_string(list_transform(vector, lambda x: x::INTEGER), ' ') AS vector FROM s UNION ALL SELECT 'fixture-model', 4, true, 'label ' || label, count(*) || ' ' || min(vec_id) || ' ' || max(vec_id) || ' 0' FROM embeddings GROUP BY label",
    "vocabulary_reload": f"SELECT token, id::INTEGER AS id, 16::INTEGER AS longest FROM (VALUES {_WORDS}) AS t(id, token) WHERE token <> '' UNION ALL SELECT source, (row_number() OVER (ORDER BY source) + {len(fx.VOCABULARY) + 1})::INTEGER, 16 FROM (SELECT DISTINCT source FROM documents)",
    "sanitized_columns": f"""WITH c AS (SELECT conv_id, turn, text, 'failed at: ' || text AS error FROM conversations)
        SELECT conv_id, turn, md5(CASE WHEN {_BAD("coalesce(text, '')")} THEN '{safety.REPLACEMENT}' ELSE text END) AS text_md5, md5(CASE WHEN {_BAD("coalesce(error, '')")} THEN '{safety.REPLACEMENT}' ELSE error END) AS error_md5 FROM c""",
    "screen_states": f"""WITH e AS (SELECT user_id, list({_NAME}[event_id % {len(_EVENTS)} + 1] ORDER BY ts, {_NAME}[event_id % {len(_EVENTS)} + 1]) AS names FROM events GROUP BY 1)
        SELECT user_id, list_reduce(list_prepend('idle', names), lambda s, e: {_STEP}) AS state FROM e""",
}
