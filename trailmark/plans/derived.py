"""Rows that queries derive from the given tables, beside the fixtures' few: each as a frame and as SQL.

Web pages stand for images of cards, sources for manifests' entries, documents' words for a tokenizer's.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fixtures as fx

LICENSES = ["Public domain", "CC0", "CC BY 4.0", "CC BY-NC 4.0", "cc by-sa 3.0", "MIT"]
ENDINGS = [".jpg", ".png", ".svg", " range map.jpg", ".JPEG"]


def _sql(listed: list[str], at: str) -> str:
    return "[" + ", ".join(f"'{x}'" for x in listed) + f"][{at} % {len(listed)} + 1]"


_IMAGE = {
    "slug": "'src' || (page_id % 25)",
    "category_pos": "CAST(page_id % 3 AS INTEGER)",
    "title": f"'File:x' || page_id || {_sql(ENDINGS, 'page_id')}",
    "width": "CAST(600 + page_id * 37 % 900 AS INTEGER)",
    "license": _sql(LICENSES, "page_id"),
    "url": "url",
}
IMAGES_SQL = "SELECT " + ", ".join(f"{e} AS {c}" for c, e in _IMAGE.items()) + " FROM pages"
HIT_IMAGES_SQL = f"SELECT page_id AS chunk_id, {_IMAGE['slug']} AS species_slug, {_IMAGE['category_pos']} AS ordinal, {_IMAGE['license']} AS license, url AS attribution, url AS source_url, CAST(strlen(html) AS INTEGER) AS size FROM pages"


def _listed(values: list[str], at: str) -> F.Column:
    return F.get(F.array(*map(F.lit, values)), (F.col(at) % len(values)).cast("int"))


def pages(spark: SparkSession, sf: str) -> DataFrame:
    """Pages with what they are as images of cards."""
    found = spark.read.parquet(f"{sf}/pages.parquet")
    return found.select(
        "page_id",
        "html",
        "url",
        F.concat(F.lit("src"), F.col("page_id") % 25).alias("slug"),
        (F.col("page_id") % 3).cast("int").alias("category_pos"),
        F.concat(F.lit("File:x"), "page_id", _listed(ENDINGS, "page_id")).alias("title"),
        (600 + F.col("page_id") * 37 % 900).cast("int").alias("width"),
        _listed(LICENSES, "page_id").alias("license"),
    )


def images(spark: SparkSession, sf: str) -> DataFrame:
    return fx.IMAGES.frame(spark).unionByName(pages(spark, sf).select("slug", "category_pos", "title", "width", "license", "url"))


def hit_images(spark: SparkSession, sf: str) -> DataFrame:
    """Images of chunks with a payload of their size."""
    rows = pages(spark, sf).select(F.col("page_id").alias("chunk_id"), F.col("slug").alias("species_slug"), F.col("category_pos").alias("ordinal"), "license", F.col("url").alias("attribution"), F.col("url").alias("source_url"), F.octet_length("html").alias("size"), F.col("html").cast("binary").alias("payload"))
    return fx.HIT_IMAGES.frame(spark).withColumn("payload", F.expr("cast(repeat('x', size) as binary)")).unionByName(rows)


def answers(spark: SparkSession, sf: str) -> DataFrame:
    """Image-info answers of one page each, licence and artist marked up."""
    value = lambda c: F.struct(c.alias("value"))
    meta = F.struct(value(F.concat(F.lit("<i>"), "license", F.lit("</i>"))).alias("LicenseShortName"), value(F.concat(F.lit("<b>Some  "), "slug", F.lit("</b>"))).alias("Artist"))
    info = F.struct(F.lit("full").alias("url"), F.col("url").alias("thumburl"), F.lit("page").alias("descriptionurl"), "width", F.lit(600).alias("height"), F.lit(640).alias("thumbwidth"), F.lit(480).alias("thumbheight"), meta.alias("extmetadata"))
    page = F.struct("title", F.array(info).alias("imageinfo"))
    body = F.to_json(F.struct(F.struct(F.array(page).alias("pages")).alias("query")))
    return fx.ANSWERS.frame(spark).unionByName(pages(spark, sf).select("slug", "category_pos", body.alias("body")))


def source_names(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/documents.parquet").select("source").distinct()
