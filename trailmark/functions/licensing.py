"""Licence allowlist and image filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .text import strip, strip_html

# Admitted licences, useless image names, image extensions.
ALLOWED = r"(?iU)^(public domain|cc0|cc[-\s]?pd|cc by(?![-\s]?n[cd])[-\s]?(sa[-\s]?)?\d)"
NAME_DENYLIST = r"(?iU)\b(map|range|distribution|chart|graph|diagram|logo|sign|stamp|label|phylogen|cladogram|locator|icon|banner)\b"
EXTENSIONS = r"(?i)\.(jpg|jpeg|png)$"
LEAST_WIDTH, MOST_IMAGES = 800, 3
IMAGE_INFO = "query struct<pages: array<struct<title: string, imageinfo: array<struct<url: string, thumburl: string, descriptionurl: string, width: int, height: int, thumbwidth: int, thumbheight: int, extmetadata: struct<LicenseShortName: struct<value: string>, Artist: struct<value: string>, Credit: struct<value: string>>>>>>>"


def is_allowed(license_name: Column) -> Column:
    """Public domain, CC0 and versioned CC BY or BY-SA; whatever is empty or unknown is not."""
    return F.coalesce(strip(license_name).rlike(ALLOWED), F.lit(False))


def is_usable(title: Column, license_name: Column, width: Column, url: Column, least_width: int = LEAST_WIDTH) -> Column:
    usable = title.rlike(EXTENSIONS) & ~title.rlike(NAME_DENYLIST) & is_allowed(license_name) & (F.coalesce(width, F.lit(0)) >= least_width) & (F.coalesce(url, F.lit("")) != "")
    return F.coalesce(usable, F.lit(False))


def resolve_category(payloads: DataFrame, least_width: int = LEAST_WIDTH) -> DataFrame:
    """Images of image-info answers: payloads(slug, category_pos, body) -> a row for every admitted image."""
    page = payloads.withColumn("page", F.explode(F.from_json("body", IMAGE_INFO)["query"]["pages"]))
    info = F.get(F.col("page.imageinfo"), F.lit(0))
    some = lambda a, b: F.coalesce(F.when(a != "", a), b)
    size = lambda a, b: F.coalesce(F.when(a != 0, a), b, F.lit(0))
    plain = lambda c: F.coalesce(strip_html(c), F.lit(""))
    meta = info["extmetadata"]
    rows = page.where(info.isNotNull()).select(
        "slug",
        "category_pos",
        F.coalesce(F.col("page.title"), F.lit("")).alias("title"),
        plain(meta["LicenseShortName"]["value"]).alias("license"),
        some(plain(meta["Artist"]["value"]), F.lit("Unknown author")).alias("attribution"),
        plain(meta["Credit"]["value"]).alias("credit"),
        F.coalesce(info["descriptionurl"], F.lit("")).alias("descriptor_url"),
        some(info["thumburl"], info["url"]).alias("thumb_url"),
        size(info["thumbwidth"], info["width"]).alias("width"),
        size(info["thumbheight"], info["height"]).alias("height"),
        info["width"].alias("_source_width"),
    )
    return rows.where(is_usable(F.col("title"), F.col("license"), F.col("_source_width"), F.col("thumb_url"), least_width)).drop("_source_width")


def pick_images(images: DataFrame, most: int | Column = MOST_IMAGES) -> DataFrame:
    """images(slug, category_pos, title, ...) -> the first distinct titles of each slug, with their 0-based ordinal.

    Order: categories as listed, then titles; a title counts where it first occurs.
    """
    first = Window.partitionBy("slug", "title").orderBy("category_pos")
    order = Window.partitionBy("slug").orderBy("category_pos", "title")
    once = images.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    ranked = once.withColumn("ordinal", F.row_number().over(order) - 1)
    return ranked.where(F.col("ordinal") < (most if isinstance(most, Column) else F.lit(most)))


def disallowed(images: DataFrame) -> DataFrame:
    """Pinned images whose licence is no longer admitted."""
    return images.where(~is_allowed(F.col("license")))


def license_report(images: DataFrame) -> DataFrame:
    """Images and sorted distinct licences of each slug."""
    return images.groupBy("slug").agg(F.count("*").alias("n_images"), F.array_join(F.sort_array(F.collect_set("license")), ", ").alias("licenses"))
