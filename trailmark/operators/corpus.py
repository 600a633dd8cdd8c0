"""The corpus store: sources, chunks, cards, images and key-value facts as tables."""

from __future__ import annotations

from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import shared
from ..functions import text as tx
from ..functions import vectors as vc

SCHEMA_VERSION = 1


def dense_ids(df: DataFrame, *order: str, name: str = "id") -> DataFrame:
    """df with ids 1..n in the given order.

    Rows are range-sorted; each range counts its rows, and a row's id is its place in its
    range behind the rows of the ranges before. No task holds the whole table, as a window
    without partitions would. The placed rows are written, so that counts and rows are
    of one dealing whatever is lost and recomputed.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = ranged.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    placed = shared.written(placed, "placed")
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_part", "_before")  # a row a range
    return placed.join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + F.col("_at") + 1).drop("_part", "_at", "_before")


def manifested(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """files(filename) that the manifest lists, with its entries."""
    return files.join(manifest, "filename")


def unmanifested(files: DataFrame, manifest: DataFrame) -> DataFrame:
    return files.join(manifest, "filename", "left_anti")


def require_manifested(files: DataFrame, manifest: DataFrame, allow: bool = False) -> DataFrame:
    """files, or an error that names those the manifest lacks."""
    if not allow:
        lost = [r["filename"] for r in unmanifested(files, manifest).select("filename").orderBy("filename").limit(20).collect()]
        if lost:
            raise ValueError(f"not in the manifest: {', '.join(lost)}")
    return manifested(files, manifest)


def with_chunks(sources: DataFrame, chunks: DataFrame) -> DataFrame:
    """Sources of which there is a chunk."""
    return sources.join(chunks.select("filename"), "filename", "left_semi")


def build(sources: DataFrame, chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sources, chunks) of a store.

    sources(pos, filename, ...) in manifest order; chunks(filename, seq, section, page_start,
    page_end, text, token_count, embedding) by file, then sequence.
    """
    numbered = dense_ids(with_chunks(sources, chunks), "pos")
    stored = numbered.select("id", "filename", *(F.coalesce(c, F.lit("")).alias(c) for c in ("title", "publisher", "license", "url", "citation_prefix")))
    owned = chunks.join(stored.select(F.col("id").alias("source_id"), "filename", "citation_prefix"), "filename")
    cited = owned.withColumn("citation", tx.citation(F.col("citation_prefix"), F.col("section"), F.col("page_start"), F.col("page_end")))
    ordered = dense_ids(cited, "filename", "seq")
    columns = ["id", "source_id", "section", "page_start", "page_end", "citation", "text", "token_count", "embedding"]
    return stored, ordered.select(*columns)


def built_now() -> str:
    """The time of a build: UTC, in whole seconds."""
    return datetime.now(UTC).isoformat(timespec="seconds")


def facts(chunks: DataFrame, sources: DataFrame, built_at: str | None = None, **settings) -> DataFrame:
    """(key, value) of a build, all values as text; both counts from the tables as they are; built_at: now unless given."""
    spark = chunks.sparkSession
    counted = lambda df, key: df.agg(F.count("*").cast("string").alias("value")).select(F.lit(key).alias("key"), "value")
    fixed = {"schema_version": SCHEMA_VERSION, "embeddings_normalized": "1", "embedding_dtype": "float32_le", "built_at": built_at or built_now()} | settings
    given = spark.createDataFrame([(k, str(v)) for k, v in fixed.items()], "key string, value string")
    return given.unionByName(counted(chunks, "chunk_count")).unionByName(counted(sources, "source_count"))


def upsert(old: DataFrame, new: DataFrame) -> DataFrame:
    """Key-value rows: new ones take the place of old ones; of equal new keys the greatest value stays."""
    both = old.select("key", "value", F.lit(0).alias("_new")).unionByName(new.select("key", F.col("value").cast("string").alias("value"), F.lit(1).alias("_new")))
    return both.groupBy("key").agg(F.max(F.struct("_new", "value")).alias("_m")).select("key", "_m.value")


def lookup(meta: DataFrame | None, key: str) -> str | None:
    """A fact, or None if the table or the key is missing."""
    row = meta.where(F.col("key") == key).select("value").first() if meta is not None else None
    return row["value"] if row else None


def summary(chunks: DataFrame) -> DataFrame:
    """Chunks, chunks with a section (an empty one is none), sources."""
    return chunks.agg(F.count("*").alias("chunk_count"), F.count_if(F.coalesce(F.col("section") != "", F.lit(False))).alias("sectioned"), F.countDistinct("source_id").alias("source_count"))


def middle(chunks: DataFrame, n: int = 3) -> DataFrame:
    """n chunks from the middle of the ids, for a look."""
    start = chunks.agg(F.count("*").alias("n")).first()["n"] // 2
    return chunks.where((F.col("id") > start) & (F.col("id") <= start + n)).orderBy("id")


def without_source(sources: DataFrame, chunks: DataFrame, filename: str) -> tuple[DataFrame, DataFrame]:
    """The store without a source and its chunks."""
    gone = sources.where(F.col("filename") == filename).select(F.col("id").alias("source_id"))
    return sources.where(F.col("filename") != filename), chunks.join(F.broadcast(gone), "source_id", "left_anti").select(chunks.columns)


def replace_pack(sources: DataFrame, chunks: DataFrame, cards: DataFrame, *, filename: str, title: str, publisher: str, license_text: str, citation_prefix: str, embeddings: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sources, chunks, cards) with a pack of cards in place of an earlier one of that name.

    cards as of the card manifest with their pos; embeddings(slug, embedding).
    """
    spark = sources.sparkSession
    kept_sources, kept_chunks = without_source(sources, chunks, filename)
    top = kept_sources.agg(F.coalesce(F.max("id"), F.lit(0)).alias("s")).first()["s"]
    top_chunk = kept_chunks.agg(F.coalesce(F.max("id"), F.lit(0)).alias("c")).first()["c"]
    source = spark.createDataFrame([(top + 1, filename, title, publisher, license_text, "", citation_prefix)], kept_sources.select("id", "filename", "title", "publisher", "license", "url", "citation_prefix").schema)
    written = dense_ids(cards, "pos").withColumn("chunk_id", F.col("id") + top_chunk)
    text = tx.card_text(F.col)
    made = written.join(embeddings, "slug").select(
        F.col("chunk_id").alias("id"),
        F.lit(top + 1).cast("long").alias("source_id"),
        F.concat_ws(" — ", "hazard_class", "common_name").alias("section"),
        F.lit(0).alias("page_start"),
        F.lit(0).alias("page_end"),
        tx.card_citation(F.lit(citation_prefix), F.col("common_name"), F.col("scientific_name"), F.col("source_citation")).alias("citation"),
        text.alias("text"),
        tx.word_count(text).alias("token_count"),
        "embedding",
    )
    stored = written.select("id", "chunk_id", "slug", "common_name", "scientific_name", "hazard_class", "region", "identification", "lookalikes", F.array_join("field_response", "\n").alias("field_response"), F.array_join("do_not", "\n").alias("do_not"))
    return kept_sources.unionByName(source), kept_chunks.unionByName(made), stored


def card_images(cards: DataFrame, images: DataFrame, payloads: DataFrame) -> DataFrame:
    """Rows of the image table: cards(chunk_id, slug), images(slug, images array), payloads(thumb_url, bytes, width, height)."""
    each = images.select("slug", F.posexplode("images").alias("ordinal", "i"))
    rows = each.join(cards.select("chunk_id", "slug"), "slug").join(payloads.select(F.col("thumb_url").alias("_url"), "bytes", "width", "height"), F.col("i.thumb_url") == F.col("_url"))
    url = F.coalesce(F.when(F.col("i.descriptor_url") != "", F.col("i.descriptor_url")), F.col("i.thumb_url"))
    return rows.select("chunk_id", F.col("slug").alias("species_slug"), "ordinal", F.col("i.license").alias("license"), F.col("i.attribution").alias("attribution"), url.alias("source_url"), F.lit("image/jpeg").alias("mime"), "width", "height", "bytes")


def image_bytes(images: DataFrame) -> DataFrame:
    """(species_slug, n_images, n_jpeg, total_bytes) of an image table."""
    raw = F.col("bytes")
    return images.groupBy("species_slug").agg(F.count("*").alias("n_images"), F.count_if(vc.is_jpeg(raw)).alias("n_jpeg"), F.coalesce(F.sum(F.octet_length(raw)), F.lit(0)).alias("total_bytes"))


def pinned_or_resolved(cards: DataFrame, locked: DataFrame, resolved: DataFrame) -> DataFrame:
    """cards with images: pinned ones (slug, images) where there are any, else resolved ones."""
    pins = locked.select("slug", F.col("images").alias("_pinned"))
    found = resolved.select("slug", F.col("images").alias("_found"))
    some = F.when(F.size("_pinned") > 0, F.col("_pinned"))
    return cards.join(pins, "slug", "left").join(found, "slug", "left").withColumn("images", F.coalesce(some, "_found")).drop("_pinned", "_found")


def attach_embeddings(chunks: DataFrame, embed: Callable[[Column], Column]) -> DataFrame:
    """chunks with the stored bytes of what an embedder column function makes of their text."""
    return chunks.withColumn("embedding", vc.to_float32_le(embed(F.col("text"))))


def resident(chunks: DataFrame) -> DataFrame:
    """(id, citation, text, vector) of usable rows: those without citation, text or whole floats are skipped."""
    return chunks.where("citation is not null and text is not null").withColumn("vector", vc.from_float32_le("embedding")).where("vector is not null").select("id", "citation", "text", "vector")


def write(spark: SparkSession, base: str, **tables: DataFrame) -> None:
    """Each table as Parquet at base/name, in place of what was there."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{base.rstrip('/')}/{name}")


def write_by_source(chunks: DataFrame, path: str, source: str = "filename") -> None:
    """chunks as a table with a folder for each source."""
    chunks.repartition(source).write.mode("overwrite").partitionBy(source).parquet(path)


def rebuild_source(spark: SparkSession, path: str, filename: str, pack: DataFrame, *order: str, source: str = "filename") -> int:
    """A source's chunks in a table of write_by_source replaced by a pack; how many there are now.

    Ids go on from the greatest of all other sources, in the given order, so a pack that is built
    again gets the same ones. Only the source's own folder is written: files of others stay as they
    are, and readers of them aren't disturbed. An empty pack removes the source.
    """
    there = spark.read.parquet(path)
    top = there.where(F.col(source) != filename).agg(F.coalesce(F.max("id"), F.lit(0)).alias("top")).first()["top"]
    numbered = dense_ids(pack, *order).withColumn("id", F.col("id") + top).withColumn(source, F.lit(filename))
    kinds = {f.name: f.dataType for f in there.schema}
    made = shared.written(numbered.select(*(F.col(c).cast(kinds[c]).alias(c) for c in there.columns)), "pack")
    n = made.count()
    if n:
        made.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(source).parquet(path)
    else:
        shared.remove(spark, f"{path.rstrip('/')}/{source}={filename}")
    return n


class ById:
    """Rows that are looked up by id: a table in buckets of ids, each sorted by them.

    A lookup deals only the wanted ids to the buckets; the table is read where it lies.
    """

    def __init__(self, spark: SparkSession, name: str, buckets: int):
        self.spark, self.name, self.buckets = spark, name, buckets

    @classmethod
    def write(cls, rows: DataFrame, name: str, buckets: int, path: str | None = None) -> ById:
        """rows(id, ...) as table name, at a path or where the catalogue keeps tables."""
        made = rows.repartition(buckets, "id").write.mode("overwrite").bucketBy(buckets, "id").sortBy("id")
        (made.option("path", path) if path else made).saveAsTable(name)
        return cls(rows.sparkSession, name, buckets)

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def find(self, wanted: DataFrame) -> DataFrame:
        """wanted(id, ...) with the columns of their rows; ids that aren't there are left out."""
        return wanted.hint("shuffle_hash").join(self.rows(), "id")

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
