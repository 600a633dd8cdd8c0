"""Manifests and the image lockfile: nested JSON with required keys."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schema
from ..functions.licensing import MOST_IMAGES

SOURCE_KEYS = ["filename", "title", "license", "citation_prefix"]
CARD_KEYS = ["slug", "common_name", "scientific_name", "hazard_class", "identification", "field_response", "source_citation", "commons_categories"]


class ManifestError(ValueError):
    """A manifest is missing, empty or lacks a required key."""


def _json(spark: SparkSession, path: str, kind) -> DataFrame:
    return spark.read.schema(kind).option("multiLine", True).json(path)


def _empty(df: DataFrame, key: str) -> Column:
    kind = dict(df.dtypes)[key]
    return F.col(key).isNull() | (F.size(key) == 0 if kind.startswith("array") else F.col(key) == "")


def missing_keys(entries: DataFrame, keys: list[str]) -> DataFrame:
    """(pos, missing) of entries that lack a key or leave it empty."""
    lost = F.filter(F.array(*(F.when(_empty(entries, k), F.lit(k)) for k in keys)), lambda x: x.isNotNull())
    return entries.select("pos", lost.alias("missing")).where(F.size("missing") > 0)


def _checked(entries: DataFrame, keys: list[str]) -> DataFrame:
    bad = missing_keys(entries, keys).orderBy("pos").first()
    if bad:
        raise ManifestError(f"entry {bad['pos']} lacks {', '.join(bad['missing'])}")
    return entries


def last_wins(entries: DataFrame, key: str) -> DataFrame:
    """Of entries with equal keys the one listed last."""
    order = Window.partitionBy(key).orderBy(F.desc("pos"))
    return entries.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def sources(spark: SparkSession, path: str) -> DataFrame:
    """(pos, filename, title, ...) of a source manifest."""
    entries = _json(spark, path, schema.SOURCE_MANIFEST).select(F.posexplode("sources").alias("pos", "e")).select("pos", "e.*")
    return last_wins(_checked(entries, SOURCE_KEYS), "filename")


def cards(spark: SparkSession, path: str) -> DataFrame:
    """(pos, slug, ...) of a card manifest, defaults filled in."""
    entries = _json(spark, path, schema.CARD_MANIFEST).select(F.posexplode("species").alias("pos", "e")).select("pos", "e.*")
    if _checked(entries, CARD_KEYS).isEmpty():
        raise ManifestError("the manifest has no entries")
    blank, none = F.lit(""), F.array().cast("array<string>")
    return entries.withColumns({"region": F.coalesce("region", blank), "lookalikes": F.coalesce("lookalikes", blank), "do_not": F.coalesce("do_not", none), "max_images": F.coalesce("max_images", F.lit(MOST_IMAGES))})


def lockfile(spark: SparkSession, path: str) -> DataFrame:
    """(slug, images) of a lockfile; no rows if there is none."""
    try:
        found = _json(spark, path, schema.LOCKFILE)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        found = spark.createDataFrame([], schema.LOCKFILE)
    return found.select(F.explode("species").alias("slug", "images"))


def write_lockfile(images: DataFrame, path: str) -> None:
    """images(slug, images) as one JSON object."""
    entry = F.sort_array(F.collect_list(F.struct("slug", "images")))
    images.agg(F.to_json(F.struct(F.map_from_entries(entry).alias("species"))).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def should_write_lock(refresh: bool, locked: DataFrame) -> bool:
    """A lockfile is written on request, or where none was read."""
    return refresh or locked.isEmpty()
