"""Tables of the corpus store and of the hazard-card pack."""

from __future__ import annotations

from pyspark.sql import types as T

S, L, I, B = T.StringType(), T.LongType(), T.IntegerType(), T.BinaryType()


def _table(*fields: tuple) -> T.StructType:
    return T.StructType([T.StructField(name, kind, null) for name, kind, null in fields])


META = _table(("key", S, False), ("value", S, False))
SOURCES = _table(("id", L, False), ("filename", S, False), ("title", S, False), ("publisher", S, False), ("license", S, False), ("url", S, False), ("citation_prefix", S, False))
CHUNKS = _table(("id", L, False), ("source_id", L, False), ("section", S, True), ("page_start", I, False), ("page_end", I, False), ("citation", S, False), ("text", S, False), ("token_count", I, False), ("embedding", B, False))
CARDS = _table(("id", L, False), ("chunk_id", L, False), ("slug", S, False), ("common_name", S, False), ("scientific_name", S, False), ("hazard_class", S, False), ("region", S, False), ("identification", S, False), ("lookalikes", S, False), ("field_response", S, False), ("do_not", S, False))
CHUNK_IMAGES = _table(("id", L, False), ("chunk_id", L, False), ("species_slug", S, False), ("ordinal", I, False), ("license", S, False), ("attribution", S, False), ("source_url", S, False), ("mime", S, False), ("width", I, False), ("height", I, False), ("bytes", B, False))

IMAGE = T.StructType([T.StructField(n, k) for n, k in (("title", S), ("license", S), ("attribution", S), ("credit", S), ("descriptor_url", S), ("thumb_url", S), ("width", I), ("height", I))])
SOURCE_ENTRY = T.StructType([T.StructField(n, S) for n in ("filename", "title", "publisher", "license", "url", "mirror_url", "citation_prefix", "notes", "ingest_caution")])
SOURCE_MANIFEST = T.StructType([T.StructField("sources", T.ArrayType(SOURCE_ENTRY))])
CARD_ENTRY = T.StructType(
    [T.StructField(n, S) for n in ("slug", "common_name", "scientific_name", "hazard_class", "region", "identification", "lookalikes")]
    + [T.StructField("field_response", T.ArrayType(S)), T.StructField("do_not", T.ArrayType(S)), T.StructField("source_citation", S), T.StructField("commons_categories", T.ArrayType(S)), T.StructField("max_images", I)]
)
CARD_MANIFEST = T.StructType([T.StructField("license", S), T.StructField("citation_prefix", S), T.StructField("species", T.ArrayType(CARD_ENTRY))])
LOCKFILE = T.StructType([T.StructField("species", T.MapType(S, T.ArrayType(IMAGE)))])
MESSAGE = T.StructType([T.StructField("role", S), T.StructField("content", S)])
RECORD = T.StructType([T.StructField("messages", T.ArrayType(MESSAGE))])
PARITY = T.StructType([T.StructField("embedding_model", S), T.StructField("embedding_dim", I), T.StructField("normalized", T.BooleanType()), T.StructField("fixtures", T.ArrayType(T.StructType([T.StructField("text", S), T.StructField("embedding", T.ArrayType(T.DoubleType()))])))])
CHUNK = T.StructType([T.StructField("seq", I), T.StructField("text", S), T.StructField("section", S), T.StructField("page_start", I), T.StructField("page_end", I), T.StructField("token_count", I)])
