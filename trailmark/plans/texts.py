"""Queries of cleaning, headings, chunking, safety and licences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import licensing, safety
from ..functions import text as tx
from ..operators import chunking
from . import derived
from . import fixtures as fx


def _documents(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/documents.parquet")


def _pages(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as the pages of their source, and the fixture's pages."""
    docs = _documents(spark, sf).select(F.col("source").alias("doc"), F.col("doc_id").cast("int").alias("page"), "text")
    return docs.unionByName(fx.PAGES.frame(spark))


def line_clean(spark: SparkSession, sf: str) -> DataFrame:
    return chunking.clean_pages(_pages(spark, sf))


def boilerplate_lines(spark: SparkSession, sf: str) -> DataFrame:
    return chunking.boilerplate(chunking.clean_pages(_pages(spark, sf)))


def boilerplate_strip(spark: SparkSession, sf: str) -> DataFrame:
    kept = chunking.strip_boilerplate(chunking.clean_pages(_pages(spark, sf)))
    return kept.groupBy("doc").agg(F.count("*").alias("n_lines"), F.sum(F.length("line")).alias("n_chars"))


def html_clean(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/pages.parquet").select("page_id", tx.strip_html(F.col("html")).alias("text"))


def heading_detect(spark: SparkSession, sf: str) -> DataFrame:
    lines = chunking.clean_pages(_pages(spark, sf)).select("line").unionByName(fx.HEADINGS.frame(spark).select("line"))
    return lines.distinct().select("line", tx.heading(F.col("line")).alias("heading"))


def heading_fixture(spark: SparkSession, sf: str) -> DataFrame:
    """The fixture's lines, and a numbered one for every document."""
    numbered = F.concat(F.lit("4."), F.col("doc_id") % 120, F.lit(" Notes In "), F.upper(F.coalesce("lang", F.lit("und"))))
    lines = fx.HEADINGS.frame(spark).select("line").unionByName(_documents(spark, sf).select(numbered.alias("line")))
    return lines.select("line", tx.heading(F.col("line")).alias("heading"))


def citation_format(spark: SparkSession, sf: str) -> DataFrame:
    """The fixture's places, and pages of every document."""
    first = (F.col("doc_id") + 1).cast("int")
    docs = _documents(spark, sf).select(F.col("source").alias("prefix"), F.lit(None).cast("string").alias("section"), first.alias("page_start"), (first + F.col("doc_id") % 2).cast("int").alias("page_end"))
    f = fx.CITATIONS.frame(spark).drop("expected").unionByName(docs)
    return f.select("section", "page_start", "page_end", tx.citation(F.col("prefix"), F.col("section"), F.col("page_start"), F.col("page_end")).alias("citation"))


def chunk_greedy(spark: SparkSession, sf: str) -> DataFrame:
    """Every document chunked with overlap, tokens being words."""
    docs = _documents(spark, sf).select(F.col("doc_id").alias("doc"), F.array("text").alias("pages"))
    chunks = chunking.chunk_documents(docs)
    return chunks.select("doc", "seq", F.md5("text").alias("text_md5"), "section", "page_start", "page_end", "token_count")


def chunk_stats(spark: SparkSession, sf: str) -> DataFrame:
    chunks = chunk_greedy(spark, sf)
    return chunks.agg(F.count("*").alias("n_chunks"), F.countDistinct("doc").alias("n_docs"), F.sum("token_count").alias("n_tokens"), F.max("token_count").alias("max_tokens"), F.count_if(F.col("token_count") > 220).alias("over_budget"))


def safety_filter(spark: SparkSession, sf: str) -> DataFrame:
    """The fixture's, the documents' and the conversations' texts through the filter."""
    texts = fx.SAFETY.frame(spark).select(F.lit("fixture").alias("origin"), "text")
    texts = texts.unionByName(_documents(spark, sf).select(F.lit("document").alias("origin"), "text"))
    texts = texts.unionByName(spark.read.parquet(f"{sf}/conversations.parquet").select(F.lit("conversation").alias("origin"), "text"))
    out = safety.sanitize(texts)
    return out.select("origin", F.md5("text").alias("text_md5"), "was_modified", F.array_join("matched_patterns", ",").alias("matched"), F.md5("safe_text").alias("safe_md5"))


def safety_summary(spark: SparkSession, sf: str) -> DataFrame:
    """How often each pattern matches in the texts of safety_filter."""
    matched = safety_filter(spark, sf).select(F.explode(F.split("matched", ",")).alias("pattern")).where("pattern <> ''")
    return matched.groupBy("pattern").agg(F.count("*").alias("n"))


def license_gate(spark: SparkSession, sf: str) -> DataFrame:
    """Every licence named in documents, and the fixture's, with the allowlist's decision."""
    named = _documents(spark, sf).select(F.explode(F.regexp_extract_all("text", F.lit(_LICENSE), 1)).alias("license"))
    both = named.unionByName(fx.LICENCES.frame(spark).select("license"))
    return both.select("license", licensing.is_allowed(F.col("license")).alias("allowed"))


def image_pick(spark: SparkSession, sf: str) -> DataFrame:
    images = derived.images(spark, sf)
    good = images.where(licensing.is_usable(F.col("title"), F.col("license"), F.col("width"), F.col("url")))
    return licensing.pick_images(good).select("slug", "ordinal", "title", "license")


def image_resolve(spark: SparkSession, sf: str) -> DataFrame:
    """Image-info answers to the first admitted images of each card."""
    found = licensing.pick_images(licensing.resolve_category(derived.answers(spark, sf)))
    return found.select("slug", "ordinal", "title", "license", "attribution", "thumb_url", "width")


def license_report(spark: SparkSession, sf: str) -> DataFrame:
    return licensing.license_report(image_pick(spark, sf))


_LICENSE = r"(?i)(CC BY[-A-Z ]*[0-9.]*[0-9]|Apache License|MIT License|General Public License|public domain|CC0)"


# Patterns for the oracle's engine, which has no lookbehind: what the lookbehinds let pass is blanked first.
def _matches(name: str, pattern: str, text: str) -> str:
    if name == "species_id":
        text, pattern = rf"regexp_replace({text}, '(?i)(if |whether )(this|that|it)\b', '\1#', 'g')", pattern.replace("(?<!if )(?<!whether )", "")
    pattern = pattern.replace("'", "''")
    return f"regexp_matches({text}, '(?i){pattern}')"


_LIST = "list_filter([" + ", ".join(f"CASE WHEN {_matches(n, p, 'text')} THEN '{n}' END" for n, p in safety.PATTERNS) + "], lambda x: x IS NOT NULL)"
_SAFE = f"""f AS (SELECT origin, text, {_LIST} AS m FROM t)"""
_LINES = rf"""{fx.PAGES.values("fixture")},
pg AS (SELECT source AS doc, doc_id::INTEGER AS page, text FROM documents UNION ALL SELECT doc, page, text FROM fixture),
raw AS (SELECT doc, page, regexp_split_to_array(regexp_replace(coalesce(text, ''), '(\w)-\n(\w)', '\1\2', 'g'), '\r\n|[\n\r\x0b\f]') AS ls FROM pg),
pos AS (SELECT doc, page, unnest(range(1, len(ls) + 1)) AS i, ls FROM raw),
cl AS (SELECT doc, page, i, trim(regexp_replace(ls[i], '[ \t\x{{a0}}]+', ' ', 'g')) AS line FROM pos),
ok AS (SELECT * FROM cl WHERE line <> '' AND NOT regexp_matches(line, '(?i)^\s*(page\s+)?\d+\s*(of\s+\d+)?\s*$') AND NOT regexp_matches(line, '(?i)^[ivxlc]+$') AND NOT regexp_matches(line, '\.{{4,}}|…{{2,}}|_{{4,}}')),
ln AS (SELECT doc, page, (row_number() OVER (PARTITION BY doc, page ORDER BY i) - 1)::INTEGER AS line_no, line FROM ok)"""
_RUNNING = """once AS (SELECT DISTINCT doc, page, line FROM ln),
np AS (SELECT doc, count(DISTINCT page) AS pages FROM once GROUP BY 1),
bp AS (SELECT o.doc, o.line FROM once o JOIN np USING (doc) WHERE pages >= 4 AND length(o.line) <= 120 GROUP BY 1, 2, pages HAVING count(*) >= greatest(3, floor(pages * 0.2)))"""
_RATIO = "(CASE WHEN len(regexp_extract_all({t}, '[A-Za-z][A-Za-z''/-]*')) > 0 THEN len(regexp_extract_all({t}, '\\b[A-Z][A-Za-z''/-]*'))::DOUBLE / len(regexp_extract_all({t}, '[A-Za-z][A-Za-z''/-]*')) ELSE 0 END)"
_NUM = r"(?i)^\s*(?:(?:section|chapter|appendix)\s+)?(\d+(?:\.\d+)*)[.:\)\s-]+([A-Za-z][^\n]{2,80})$"
_WORDS = ", ".join(f"'{w}'" for w in tx.FUNCTION_WORDS + tx.ADMONITIONS)
_HEADING = rf"""h AS (SELECT line, regexp_extract(line, '{_NUM}', 1) AS num, trim(regexp_extract(line, '{_NUM}', 2)) AS title FROM src),
hd AS (SELECT line, CASE
  WHEN length(line) > 90 OR regexp_matches(line, '\b(19|20)\d{{2}}\b') OR regexp_matches(line, '(?i)\b(january|february|march|april|may|june|july|august|september|october|november|december)\b') OR regexp_matches(line, '(?i)\b[A-Z]{{2,4}}\s?\d+[-.]\d+') THEN NULL
  WHEN num <> '' THEN CASE WHEN length(ltrim(string_split(num, '.')[1], '0')) <= 2 AND length(regexp_replace(title, '[^A-Za-z]', '', 'g')) >= 3 AND length(title) <= 60 AND NOT regexp_matches(title, '[.,;:]$')
       AND {_RATIO.format(t="title")} >= 0.6 AND (regexp_matches(lower(trim(line)), '^(section|chapter|appendix)') OR contains(num, '.')) THEN num || ' ' || title END
  WHEN regexp_full_match(line, '[A-Z][A-Z &/,''()\-]{{3,70}}') AND NOT regexp_matches(line, '[.,;:]$') AND len(list_filter(regexp_extract_all(lower(line), '[a-z]+'), lambda w: w NOT IN ({_WORDS}))) > 0
  THEN list_aggregate(list_transform(range(1, length(line) + 1), lambda k: CASE WHEN k > 1 AND regexp_matches(line[k - 1], '[A-Z]') THEN lower(line[k]) ELSE line[k] END), 'string_agg', '') END AS heading FROM h)"""
_CARRY = "list_slice({b}, list_min(list_filter(range(1, len({b}) + 2), lambda j: coalesce(list_sum(list_transform(list_slice({b}, j, len({b})), lambda x: x.t)), 0) <= 48)), len({b}))"
_SUM = "coalesce(list_sum(list_transform(s.buf, lambda x: x.t)), 0)"
_FOLD = rf"""raw AS (SELECT doc_id AS doc, regexp_split_to_array(text, '\r\n|[\n\r\x0b\f]') AS ls FROM documents),
pos AS (SELECT doc, unnest(range(1, len(ls) + 1)) AS i, ls FROM raw),
cl AS (SELECT doc, i, trim(regexp_replace(ls[i], '[ \t\x{{a0}}]+', ' ', 'g')) AS line FROM pos),
ok AS (SELECT * FROM cl WHERE line <> '' AND NOT regexp_matches(line, '(?i)^\s*(page\s+)?\d+\s*(of\s+\d+)?\s*$') AND NOT regexp_matches(line, '(?i)^[ivxlc]+$') AND NOT regexp_matches(line, '\.{{4,}}|…{{2,}}|_{{4,}}')),
ln AS (SELECT doc, row_number() OVER (PARTITION BY doc ORDER BY i) AS i, line, len(list_filter(regexp_split_to_array(line, '\s+'), lambda w: w <> ''))::INTEGER AS t FROM ok),
st(doc, i, buf, out1, out2) AS (
  SELECT doc, 0::BIGINT, []::STRUCT(l VARCHAR, t INTEGER)[], NULL::STRUCT(l VARCHAR, t INTEGER)[], NULL::STRUCT(l VARCHAR, t INTEGER)[] FROM (SELECT DISTINCT doc FROM ln)
  UNION ALL
  SELECT s.doc, s.i + 1,
    CASE WHEN l.t > 220 THEN {_CARRY.format(b="s.buf")} WHEN {_SUM} + l.t > 220 THEN list_append({_CARRY.format(b="s.buf")}, {{'l': l.line, 't': l.t}}) ELSE list_append(s.buf, {{'l': l.line, 't': l.t}}) END,
    CASE WHEN (l.t > 220 OR {_SUM} + l.t > 220) AND len(s.buf) > 0 AND {_SUM} >= 24 THEN s.buf END,
    CASE WHEN l.t > 220 THEN [{{'l': l.line, 't': l.t}}] END
  FROM st s JOIN ln l ON l.doc = s.doc AND l.i = s.i + 1),
ends AS (SELECT doc, max(i) AS i FROM st GROUP BY 1),
outs AS (SELECT doc, i, 1 AS o, out1 AS c FROM st WHERE out1 IS NOT NULL UNION ALL SELECT doc, i, 2, out2 FROM st WHERE out2 IS NOT NULL
  UNION ALL SELECT st.doc, st.i, 3, buf FROM st JOIN ends USING (doc, i) WHERE coalesce(list_sum(list_transform(buf, lambda x: x.t)), 0) >= 24),
ch AS (SELECT doc, (row_number() OVER (PARTITION BY doc ORDER BY i, o) - 1)::INTEGER AS seq, md5(list_aggregate(list_transform(c, lambda x: x.l), 'string_agg', chr(10))) AS text_md5,
  NULL::VARCHAR AS section, 1::INTEGER AS page_start, 1::INTEGER AS page_end, list_sum(list_transform(c, lambda x: x.t))::INTEGER AS token_count FROM outs)"""

QUERIES = {f.__name__: f for f in (line_clean, boilerplate_lines, boilerplate_strip, html_clean, heading_detect, heading_fixture, citation_format, chunk_greedy, chunk_stats, safety_filter, safety_summary, license_gate, image_pick, image_resolve, license_report)}
_PICKED = rf"""good AS (SELECT * FROM i WHERE regexp_matches(title, '(?i)\.(jpg|jpeg|png)$') AND NOT regexp_matches(title, '{licensing.NAME_DENYLIST.replace("(?iU)", "(?i)")}')
  AND regexp_matches(trim(license), '(?i)^(public domain|cc0|cc[-\s]?pd|cc by[-\s]?(sa[-\s]?)?\d)') AND coalesce(width, 0) >= 800 AND url <> ''),
once AS (SELECT slug, title, any_value(license) AS license, min(category_pos) AS category_pos FROM good GROUP BY 1, 2),
pick AS (SELECT slug, (row_number() OVER (PARTITION BY slug ORDER BY category_pos, title) - 1)::INTEGER AS ordinal, title, license FROM once)"""
_PICK = f"""{fx.IMAGES.values("fi")}, i AS (SELECT * FROM fi UNION ALL {derived.IMAGES_SQL}), {_PICKED}"""
ORACLE = {
    "line_clean": f"WITH {_LINES} SELECT doc, page, line_no, line FROM ln",
    "boilerplate_lines": f"WITH {_LINES}, {_RUNNING} SELECT doc, line FROM bp",
    "boilerplate_strip": f"WITH {_LINES}, {_RUNNING} SELECT doc, count(*) AS n_lines, CAST(sum(length(line)) AS BIGINT) AS n_chars FROM ln ANTI JOIN bp USING (doc, line) GROUP BY 1",
    "html_clean": r"SELECT page_id, regexp_replace(regexp_replace(regexp_replace(html, '<[^>]+>', '', 'g'), '[ \t\n\x0b\f\r]+', ' ', 'g'), '^ | $', '', 'g') AS text FROM pages",
    "heading_detect": f"WITH {_LINES}, {fx.HEADINGS.values('hf')}, src AS (SELECT line FROM ln UNION SELECT line FROM hf), {_HEADING} SELECT line, heading FROM hd",
    "heading_fixture": f"WITH {fx.HEADINGS.values('hf')}, d AS (SELECT '4.' || (doc_id % 120) || ' Notes In ' || upper(coalesce(lang, 'und')) AS line FROM documents) SELECT line, expected AS heading FROM hf UNION ALL SELECT line, line FROM d",
    "citation_format": f"""WITH {fx.CITATIONS.values('c')} SELECT section, page_start, page_end, expected AS citation FROM c UNION ALL
        SELECT NULL, (doc_id + 1)::INTEGER, (doc_id + 1 + doc_id % 2)::INTEGER, '[Source: ' || source || CASE WHEN doc_id % 2 = 0 THEN ', p. ' || (doc_id + 1) ELSE ', pp. ' || (doc_id + 1) || '-' || (doc_id + 2) END || ']' FROM documents""",
    "chunk_greedy": f"WITH RECURSIVE {_FOLD} SELECT * FROM ch",
    "chunk_stats": f"WITH RECURSIVE {_FOLD} SELECT count(*) AS n_chunks, count(DISTINCT doc) AS n_docs, CAST(sum(token_count) AS BIGINT) AS n_tokens, max(token_count) AS max_tokens, count(*) FILTER (token_count > 220) AS over_budget FROM ch",
    "safety_filter": f"""WITH {fx.SAFETY.values("x")}, t AS (SELECT 'fixture' AS origin, text FROM x UNION ALL SELECT 'document', text FROM documents UNION ALL SELECT 'conversation', text FROM conversations), {_SAFE}
        SELECT origin, md5(text) AS text_md5, len(m) > 0 AS was_modified, array_to_string(m, ',') AS matched, md5(CASE WHEN len(m) > 0 THEN '{safety.REPLACEMENT}' ELSE text END) AS safe_md5 FROM f""",
    "safety_summary": f"WITH {fx.SAFETY.values('x')}, t AS (SELECT 'fixture' AS origin, text FROM x UNION ALL SELECT 'document', text FROM documents UNION ALL SELECT 'conversation', text FROM conversations), {_SAFE} SELECT pattern, count(*) AS n FROM (SELECT unnest(m) AS pattern FROM f) GROUP BY 1",
    "license_gate": f"""WITH {fx.LICENCES.values("l")}, n AS (SELECT unnest(regexp_extract_all(text, '{_LICENSE}', 1)) AS license FROM documents)
        SELECT license, allowed FROM l UNION ALL SELECT license, regexp_matches(license, '(?i)^(public domain|cc0|cc[-\\s]?pd|cc by[-\\s]?(sa[-\\s]?)?\\d)') AS allowed FROM n WHERE license <> ''""",
    "image_pick": f"WITH {_PICK} SELECT * FROM pick WHERE ordinal < 3",
    "image_resolve": f"""WITH {fx.RESOLVED.values('r')}, i AS ({derived.IMAGES_SQL}), {_PICKED}
        SELECT * FROM r UNION ALL SELECT slug, ordinal, title, license, 'Some ' || slug, url, 640 FROM pick JOIN (SELECT slug, title, min(url) AS url FROM i GROUP BY 1, 2) USING (slug, title) WHERE ordinal < 3""",
    "license_report": f"WITH {_PICK} SELECT slug, count(*) AS n_images, string_agg(DISTINCT license, ', ' ORDER BY license) AS licenses FROM pick WHERE ordinal < 3 GROUP BY 1",
}
