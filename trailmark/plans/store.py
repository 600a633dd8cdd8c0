"""Queries of the store, training records and transcripts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import shared
from ..functions import text as tx
from ..functions import vectors as vc
from ..operators import corpus, prompts, training, validation
from ..streaming import transcripts as ts
from . import fixtures as fx

SYSTEM = "You read from the provided protocol excerpts only."


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/documents.parquet")


def _manifest(spark: SparkSession, sf: str) -> DataFrame:
    """Entries for all sources but those whose name ends in 9, in order of name."""
    names = _docs(spark, sf).select(F.col("source").alias("filename")).distinct().where("not filename like '%9'")
    listed = names.withColumn("citation_prefix", F.concat(F.lit("Manual "), "filename"))
    return corpus.dense_ids(listed, "filename", name="pos")


def _chunks(spark: SparkSession, sf: str) -> DataFrame:
    """A chunk for every document: section by language, tokens by words."""
    docs = _docs(spark, sf)
    section = F.when(F.col("lang") != "es", F.concat(F.lit("2.1 Notes in "), F.upper("lang")))
    return docs.select(F.col("source").alias("filename"), F.col("doc_id").alias("seq"), section.alias("section"), F.lit(1).alias("page_start"), (F.lit(1) + F.col("doc_id") % 2).cast("int").alias("page_end"), "text", tx.word_count(F.col("text")).alias("token_count"), F.lit(None).cast("binary").alias("embedding"))


def _store(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    blank = {c: F.lit("") for c in ("title", "publisher", "license", "url")}
    return corpus.build(_manifest(spark, sf).withColumns(blank), _chunks(spark, sf))


def chunk_ids(spark: SparkSession, sf: str) -> DataFrame:
    _, chunks = _store(spark, sf)
    return chunks.select("id", "source_id", "section", "citation", "token_count")


def sources_with_chunks(spark: SparkSession, sf: str) -> DataFrame:
    sources, _ = _store(spark, sf)
    return sources.select("id", "filename", "citation_prefix")


def unmanifested(spark: SparkSession, sf: str) -> DataFrame:
    files = _docs(spark, sf).select(F.col("source").alias("filename")).distinct()
    return corpus.unmanifested(files, _manifest(spark, sf))


def corpus_facts(spark: SparkSession, sf: str) -> DataFrame:
    sources, chunks = _store(spark, sf)
    return corpus.facts(chunks, sources, built_at="2024-01-01T00:00:00+00:00", embedding_dim=64, chunk_tokens=220, overlap_tokens=48)


def section_summary(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.summary(_store(spark, sf)[1])


def meta_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """The fixture's facts, and each source's documents counted, then the ids of every other source's last."""
    by_source = _docs(spark, sf).groupBy(F.col("source").alias("key")).agg(F.count("*").cast("string").alias("n"), F.max("doc_id").alias("last"))
    new = by_source.where("last % 2 = 1").select("key", F.col("last").cast("string").alias("value"))
    return corpus.upsert(fx.FACTS_OLD.frame(spark).unionByName(by_source.select("key", F.col("n").alias("value"))), fx.FACTS_NEW.frame(spark).unionByName(new))


def pack_replace(spark: SparkSession, sf: str) -> DataFrame:
    """The whole store with the fixture's cards in place of source src0."""
    sources, chunks = _store(spark, sf)
    cards = fx.CARDS.frame(spark)
    vectors = cards.select("slug", vc.to_float32_le(F.array(F.lit(1.0), F.lit(0.0))).alias("embedding"))
    _, out, _ = corpus.replace_pack(sources, chunks, cards, filename="src0", title="Hazard cards", publisher="", license_text="", citation_prefix="Hazard Card", embeddings=vectors)
    return out.select("id", "source_id", "citation", F.md5("text").alias("text_md5"), "token_count")


def orphan_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Labels, and those of twice their ids, that no document bears."""
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id")
    labels = labels.unionByName(labels.select((2 * F.col("doc_id") + 1).alias("doc_id")))
    return validation.orphans(labels, "doc_id", _docs(spark, sf), "doc_id").select("doc_id")


def duplicate_texts(spark: SparkSession, sf: str) -> DataFrame:
    return validation.duplicates(_docs(spark, sf).select(F.md5("text").alias("text_md5")), "text_md5")


def steps_extract(spark: SparkSession, sf: str) -> DataFrame:
    rows = fx.STEPS.frame(spark).select((-F.col("id")).alias("id"), "text").unionByName(_docs(spark, sf).select(F.col("doc_id").alias("id"), "text"))
    return rows.select("id", F.array_join(training.steps(F.col("text"), 5), "|").alias("steps"))


def _training(spark: SparkSession, sf: str) -> DataFrame:
    docs = _docs(spark, sf)
    page = F.lit(1)
    chunks = docs.select((F.col("doc_id") + 1).alias("id"), F.concat(F.lit("3.2 Notes "), "source").alias("section"), tx.citation(F.col("source"), F.lit(None).cast("string"), page, page).alias("citation"), "text", tx.word_count(F.col("text")).alias("token_count"))
    return training.usable(chunks)


def training_grounded(spark: SparkSession, sf: str) -> DataFrame:
    rows = training.grounded(_training(spark, sf), SYSTEM)
    return rows.select("id", "question", F.md5("answer").alias("answer_md5"), F.size("messages").alias("n_messages"), F.md5(F.col("messages")[1]["content"]).alias("user_md5"))


def training_refusal(spark: SparkSession, sf: str) -> DataFrame:
    rows = training.refusals(_training(spark, sf), 90, SYSTEM)
    return rows.select("index", "question", "answer", F.md5(F.col("messages")[1]["content"]).alias("user_md5"))


def training_deflect(spark: SparkSession, sf: str) -> DataFrame:
    rows = training.deflections(_training(spark, sf), 120, SYSTEM)
    return rows.select("index", "question", "keyword", F.col("answer").alias("answer"), F.md5(F.col("messages")[1]["content"]).alias("user_md5"))


def messages_json(spark: SparkSession, sf: str) -> DataFrame:
    """Every user's turn as a record of three messages."""
    first = spark.read.parquet(f"{sf}/conversations.parquet").where("role = 'user'").withColumnRenamed("text", "question")
    record = first.select("conv_id", F.to_json(F.struct(prompts.messages(F.lit(SYSTEM), F.col("question"), F.lit(training.NO_MATCH)).alias("messages"))).alias("json"))
    back = record.select("conv_id", F.from_json("json", "messages array<struct<role: string, content: string>>").alias("r"))
    return training.valid_records(back.select("conv_id", "r.messages")).select("conv_id", F.inline("messages"))


def conversation_concat(spark: SparkSession, sf: str) -> DataFrame:
    talk = spark.read.parquet(f"{sf}/conversations.parquet")
    return prompts.ordered_concat(talk, "conv_id", "turn", "text", "\n").select("conv_id", F.md5("text").alias("text_md5"))


def keyword_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Benchmark items that a document holds."""
    items = spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", F.lower("text").alias("keyword"))
    docs = _docs(spark, sf).select(F.col("doc_id").alias("id"), "text")
    return training.keyword_chunks(docs, items).join(items, "keyword").select("item_id", F.col("id").alias("doc_id"))


def _events(spark: SparkSession, sf: str) -> DataFrame:
    """Purchases end a transcript, errors are errors (of odd users benign), all else is partial."""
    kind = F.when(F.col("event_type") == "purchase", "final").when(F.col("event_type") == "error", "error").otherwise("partial")
    return spark.read.parquet(f"{sf}/events.parquet").select("event_id", "ts", "user_id", kind.alias("kind"), F.col("props").alias("text"), F.when(F.col("user_id") % 2 == 1, 216).otherwise(7).alias("code"))


def transcript_final(spark: SparkSession, sf: str) -> DataFrame:
    """Transcripts with the wait scaled to 12 hours, as the events are sparse."""
    return ts.transcripts(_events(spark, sf), 12 * 3600, ["user_id"])


def transcript_stream(spark: SparkSession, sf: str) -> DataFrame:
    """The same transcripts from a stream of the events, by event time.

    A last event without a user, two gaps on, moves the watermark past all others.
    """
    ts.use_rocksdb(spark)
    events, base = _events(spark, sf).withColumnRenamed("user_id", "key"), shared.folder(spark, "stream")
    gap = F.expr("interval 24 hours")
    end = events.agg((F.max("ts") + gap).alias("ts")).select(F.lit(-1).cast("long").alias("event_id"), "ts", F.lit(None).cast("long").alias("key"), F.lit("partial").alias("kind"), F.lit("").alias("text"), F.lit(0).alias("code"))
    events.unionByName(end).write.parquet(f"{base}/in")
    found = ts.finish_by_event_time(spark.readStream.schema(events.schema).parquet(f"{base}/in"), 12 * 3600)
    found.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    out = spark.read.schema(found.schema).parquet(f"{base}/out")
    return out.select(F.col("key").alias("user_id"), "session", "text", "ended_by", "n_events")


def transcript_latest(spark: SparkSession, sf: str) -> DataFrame:
    """Each user's transcript as it stands after the last event."""
    events = ts.meaningful(_events(spark, sf)).withColumnRenamed("user_id", "key")
    return ts.latest(events).select(F.col("key").alias("user_id"), "text")


def card_store(spark: SparkSession, sf: str) -> DataFrame:
    """The fixture's cards as the card table of a store that replaces a pack."""
    sources, chunks = _store(spark, sf)
    cards = fx.CARDS.frame(spark)
    vectors = cards.select("slug", vc.to_float32_le(F.array(F.lit(1.0))).alias("embedding"))
    _, _, out = corpus.replace_pack(sources, chunks, cards, filename="cards", title="", publisher="", license_text="", citation_prefix="Hazard Card", embeddings=vectors)
    return out.select("id", "chunk_id", "slug", "field_response", "do_not")


_DOCS = """m AS (SELECT filename, row_number() OVER (ORDER BY filename) AS id FROM (SELECT DISTINCT source AS filename FROM documents WHERE NOT source LIKE '%9')),
c AS (SELECT row_number() OVER (ORDER BY source, doc_id) AS id, m.id AS source_id, source, doc_id, text, CASE WHEN lang <> 'es' THEN '2.1 Notes in ' || upper(lang) END AS section,
  '[Source: Manual ' || source || CASE WHEN lang <> 'es' THEN ', Section 2.1 Notes in ' || upper(lang) ELSE '' END || CASE WHEN doc_id % 2 = 0 THEN ', p. 1]' ELSE ', pp. 1-2]' END AS citation,
  len(list_filter(regexp_split_to_array(text, '[ \\t\\n\\x0b\\f\\r]+'), lambda w: w <> ''))::INTEGER AS token_count FROM documents JOIN m ON m.filename = source)"""
_STEPS = r"""raw AS (SELECT id, regexp_split_to_array(text, '\r\n|[\n\r\x0b\f]') AS ls FROM tx),
pos AS (SELECT id, unnest(range(1, len(ls) + 1)) AS i, ls FROM raw),
st AS (SELECT id, i, trim(ls[i], ' ' || chr(9)) AS raw, trim(regexp_replace(regexp_replace(trim(ls[i], ' ' || chr(9)), '^[ •\-*\t]+', ''), '(?i)^(?:\d+[.):]|[a-z][.)]|[ivx]+\.)\s*', ''), ' ' || chr(9)) AS step FROM pos),
good AS (SELECT id, i, step, step <> raw AS marked FROM st WHERE length(step) BETWEEN 15 AND 200 AND NOT regexp_matches(step, '(?i)^(figure|table|references|revision date|note:|aliases)')),
lists AS (SELECT id, coalesce(list(step ORDER BY i) FILTER (marked), []) AS a, coalesce(list(step ORDER BY i) FILTER (NOT marked), []) AS b FROM good GROUP BY 1),
"""
_TAKE = "list_slice(list_concat(list_slice(a, 1, {n}), list_filter(b, lambda x: NOT list_contains(list_slice(a, 1, {n}), x))), 1, {n})"
_TRAIN = r"""k AS (SELECT doc_id + 1 AS id, 'Notes ' || source AS topic, '[Source: ' || source || ', p. 1]' AS citation, text FROM documents WHERE len(list_filter(regexp_split_to_array(text, '[ \t\n\x0b\f\r]+'), lambda w: w <> '')) >= 80),
tx AS (SELECT id, text FROM k),
pl AS (SELECT *, row_number() OVER (ORDER BY md5('SEED|' || id), id) - 1 AS place, count(*) OVER () AS total FROM k)"""
_CHOICE = "(('0x' || substr(md5('{seed}|' || {c}), 1, 8))::BIGINT)"
_OFF = "[" + ", ".join("'" + q.replace("'", "''") + "'" for q in training.OFF_TOPIC) + "]"
_QS = "[" + ", ".join("'" + q.replace("'", "''") + "'" for q in training.QUESTIONS) + "]"
_BAIT = ", ".join("({}, '{}', '{}')".format(k, q.replace("'", "''"), w) for k, (q, w) in enumerate(training.BAIT))
_NL2 = "chr(10) || chr(10)"

QUERIES = {f.__name__: f for f in (chunk_ids, sources_with_chunks, unmanifested, corpus_facts, section_summary, meta_upsert, pack_replace, orphan_labels, duplicate_texts, steps_extract, training_grounded, training_refusal, training_deflect, messages_json, conversation_concat, keyword_chunks, transcript_final, transcript_stream, transcript_latest, card_store)}
_CARD_ROWS = """cd AS (SELECT * FROM (VALUES (1, '[Source: Hazard Card - Fixture Ivy (Hedera exempli); derived from Manual A]',
  'Fixture Ivy (Hedera exempli). Hazard: Contact dermatitis.' || chr(10) || 'Where found: Everywhere.' || chr(10) || 'Field identification: Three leaflets.' || chr(10) || 'Field response checklist: 1. Wash the skin. 2. Remove clothing.' || chr(10) || 'Identification must be confirmed by the responder against the reference images; this assistant does not identify species.'),
  (2, '[Source: Hazard Card - Fixture Viper (Vipera exempli); derived from Manual B]',
  'Fixture Viper (Vipera exempli). Hazard: Venomous snake.' || chr(10) || 'Where found: Hills.' || chr(10) || 'Field identification: Broad head.' || chr(10) || 'Commonly confused with: Water snake' || chr(10) || 'Field response checklist: 1. Keep still.' || chr(10) || 'Do not: Do not cut. Do not suck.' || chr(10) || 'Identification must be confirmed by the responder against the reference images; this assistant does not identify species.')) AS t(n, citation, text))"""
ORACLE = {
    "chunk_ids": f"WITH {_DOCS} SELECT id, source_id, section, citation, token_count FROM c",
    "sources_with_chunks": f"WITH {_DOCS} SELECT id, filename, 'Manual ' || filename AS citation_prefix FROM m",
    "unmanifested": "SELECT DISTINCT source AS filename FROM documents WHERE source LIKE '%9'",
    "corpus_facts": f"""WITH {_DOCS} SELECT * FROM (VALUES ('schema_version', '1'), ('embeddings_normalized', '1'), ('embedding_dtype', 'float32_le'), ('built_at', '2024-01-01T00:00:00+00:00'), ('embedding_dim', '64'), ('chunk_tokens', '220'), ('overlap_tokens', '48')) AS t(key, value)
        UNION ALL SELECT 'chunk_count', count(*)::VARCHAR FROM c UNION ALL SELECT 'source_count', count(*)::VARCHAR FROM m""",
    "section_summary": f"WITH {_DOCS} SELECT count(*) AS chunk_count, count(*) FILTER (section <> '') AS sectioned, count(DISTINCT source_id) AS source_count FROM c",
    "meta_upsert": f"""WITH {fx.FACTS_OLD.values('fo')}, {fx.FACTS_NEW.values('fn')}, s AS (SELECT source AS key, count(*)::VARCHAR AS n, max(doc_id) AS last FROM documents GROUP BY 1),
        o AS (SELECT * FROM fo UNION ALL SELECT key, n FROM s), n AS (SELECT * FROM fn UNION ALL SELECT key, last::VARCHAR FROM s WHERE last % 2 = 1)
        SELECT * FROM n UNION ALL SELECT * FROM o ANTI JOIN n USING (key)""",
    "pack_replace": rf"""WITH {_DOCS}, {_CARD_ROWS}, kept AS (SELECT * FROM c WHERE source <> 'src0')
        SELECT id, source_id, citation, md5(text) AS text_md5, token_count FROM kept UNION ALL
        SELECT (SELECT max(id) FROM kept) + n, (SELECT max(id) FROM m WHERE filename <> 'src0') + 1, citation, md5(text), len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> ''))::INTEGER FROM cd""",
    "orphan_labels": "SELECT doc_id FROM (SELECT doc_id FROM labels UNION ALL SELECT 2 * doc_id + 1 FROM labels) ANTI JOIN documents USING (doc_id)",
    "duplicate_texts": "SELECT md5(text) AS text_md5, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1",
    "steps_extract": f"WITH {fx.STEPS.values('f')}, tx AS (SELECT -id AS id, text FROM f UNION ALL SELECT doc_id, text FROM documents), {_STEPS} s AS (SELECT id, {_TAKE.format(n=5)} AS s FROM lists) SELECT tx.id, coalesce(array_to_string(s, '|'), '') AS steps FROM tx LEFT JOIN s USING (id)",
    "training_grounded": f"""WITH {_TRAIN.replace("SEED", "17")}, {_STEPS} s AS (SELECT id, {_TAKE.format(n=5)} AS s FROM lists),
        g AS (SELECT pl.*, s FROM pl JOIN s USING (id) WHERE len(s) >= 2),
        d AS (SELECT g.id, o.citation, o.text FROM g JOIN pl o ON o.place IN ((g.place + 1) % g.total, (g.place + 2) % g.total) AND o.id <> g.id UNION ALL SELECT id, citation, text FROM g),
        x AS (SELECT id, string_agg(citation || chr(10) || text, {_NL2} ORDER BY md5('17' || text), citation, text) AS ctx FROM d GROUP BY 1),
        q AS (SELECT g.id, {_QS}[{_CHOICE.format(seed=18, c="g.id")} % 4 + 1] || lower(topic) AS question, citation || chr(10) || array_to_string(list_transform(s, lambda v, i: i || '. ' || v), chr(10)) AS answer, ctx FROM g JOIN x USING (id))
        SELECT id, question, md5(answer) AS answer_md5, 3::INTEGER AS n_messages, md5('Retrieved protocol excerpts:' || chr(10) || ctx || {_NL2} || 'Responder asked: ' || question) AS user_md5 FROM q""",
    "training_refusal": f"""WITH {_TRAIN.replace("SEED", "19")}, a AS (SELECT range AS index, {_OFF}[range % 6 + 1] AS question FROM range(90)),
        w AS (SELECT index, question, unnest(range(0, 3)) AS step FROM a),
        x AS (SELECT w.index, w.question, string_agg(citation || chr(10) || text, {_NL2} ORDER BY step) AS ctx FROM w JOIN pl ON pl.place = ({_CHOICE.format(seed=19, c="w.index")} + step) % pl.total GROUP BY 1, 2)
        SELECT index, question, '{training.NO_MATCH.replace("'", "''")}' AS answer, md5('Retrieved protocol excerpts:' || chr(10) || ctx || {_NL2} || 'Responder asked: ' || question) AS user_md5 FROM x""",
    "training_deflect": f"""WITH {_TRAIN.replace("SEED", "21")}, b(k, question, keyword) AS (VALUES {_BAIT}), {_STEPS} s AS (SELECT id, {_TAKE.format(n=3)} AS s FROM lists),
        mt AS (SELECT keyword, k2.id, citation, text, row_number() OVER (PARTITION BY keyword ORDER BY md5('20|' || keyword || '|' || k2.id), k2.id) AS nth, count(*) OVER (PARTITION BY keyword) AS n
               FROM (SELECT DISTINCT keyword FROM b) kw JOIN k k2 ON contains(lower(text), keyword)),
        a AS (SELECT range AS index, question, b.keyword, floor(range / 10) AS round FROM range(120) JOIN b ON b.k = range % 10),
        r AS (SELECT a.index, a.question, a.keyword, mt.id, mt.citation, mt.text, s FROM a LEFT JOIN mt ON mt.keyword = a.keyword AND mt.nth = a.round % least(mt.n, 120) + 1 LEFT JOIN s ON s.id = mt.id),
        w AS (SELECT index, unnest(range(0, 2)) AS step FROM a),
        x AS (SELECT w.index, string_agg(citation || chr(10) || text, {_NL2} ORDER BY step) AS ctx FROM w JOIN pl ON pl.place = ({_CHOICE.format(seed=21, c="w.index")} + step) % pl.total GROUP BY 1)
        SELECT index, question, keyword, '{training.DEFLECTION.replace("'", "''")}' || CASE WHEN len(s) > 0 THEN {_NL2} || citation || chr(10) || array_to_string(list_transform(s, lambda v, i: i || '. ' || v), chr(10)) ELSE '' END AS answer,
          md5('Retrieved protocol excerpts:' || chr(10) || CASE WHEN text IS NOT NULL THEN citation || chr(10) || text || {_NL2} ELSE '' END || ctx || {_NL2} || 'Responder asked: ' || question) AS user_md5 FROM r JOIN x USING (index)""",
    "messages_json": f"""WITH f AS (SELECT conv_id, text AS question FROM conversations WHERE role = 'user')
        SELECT conv_id, 'system' AS role, '{SYSTEM}' AS content FROM f UNION ALL SELECT conv_id, 'user', question FROM f UNION ALL SELECT conv_id, 'assistant', '{training.NO_MATCH.replace("'", "''")}' FROM f""",
    "conversation_concat": "SELECT conv_id, md5(string_agg(text, chr(10) ORDER BY turn, text)) AS text_md5 FROM conversations GROUP BY 1",
    "keyword_chunks": "SELECT item_id, doc_id FROM benchmark b JOIN documents d ON contains(lower(d.text), lower(b.text))",
    "transcript_final": """WITH e AS (SELECT event_id, ts, user_id, props AS text, CASE event_type WHEN 'purchase' THEN 'final' WHEN 'error' THEN 'error' ELSE 'partial' END AS kind FROM events),
        k AS (SELECT * FROM e WHERE kind <> 'error' OR user_id % 2 = 0),
        g AS (SELECT *, lag(ts) OVER w AS pt, lag(kind) OVER w AS pk FROM k WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
        s AS (SELECT *, CAST(sum(CASE WHEN pt IS NULL OR epoch_us(ts) - epoch_us(pt) > 43200000000 OR pk = 'final' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS session FROM g),
        l AS (SELECT user_id, session, last(text ORDER BY ts, event_id) AS text, last(kind ORDER BY ts, event_id) AS kind, count(*) AS n_events FROM s WHERE kind <> 'error' GROUP BY 1, 2)
        SELECT user_id, session, text, CASE WHEN kind = 'final' THEN 'final' ELSE 'timeout' END AS ended_by, n_events FROM l""",
    "transcript_latest": """WITH e AS (SELECT * FROM events WHERE event_type <> 'error') SELECT user_id, arg_max(props, ts) AS text FROM e GROUP BY 1""",
    "card_store": f"""WITH {_DOCS} SELECT n AS id, (SELECT count(*) FROM c) + n AS chunk_id, slug, field_response, do_not FROM (VALUES (1::BIGINT, 'fixture-ivy', 'Wash the skin.' || chr(10) || 'Remove clothing.', ''),
        (2, 'fixture-viper', 'Keep still.', 'Do not cut.' || chr(10) || 'Do not suck.')) AS t(n, slug, field_response, do_not)""",
}
ORACLE["transcript_stream"] = ORACLE["transcript_final"]
