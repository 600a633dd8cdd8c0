"""Checks that refuse a corpus, a pack or a build rather than answer from it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import licensing as lc
from ..functions import vectors as vc
from . import corpus

PARITY = 0.999


class Refused(ValueError):
    """A table breaks a rule that answers depend on."""


def require_normalized(meta: DataFrame | None) -> None:
    """A stated value other than "1" refuses the corpus; no statement does not."""
    stated = corpus.lookup(meta, "embeddings_normalized")
    if stated not in (None, "1"):
        raise Refused("the corpus isn't normalized: a dot product is no cosine there")


def dimensions(vectors: DataFrame) -> DataFrame:
    """Count, least and greatest width, and whether all are alike."""
    size = F.size("vector")
    return vectors.where("vector is not null").agg(F.count("*").alias("n"), F.min(size).alias("min_dim"), F.max(size).alias("max_dim")).withColumn("uniform", F.coalesce(F.col("min_dim") == F.col("max_dim"), F.lit(False)))


def require_corpus(vectors: DataFrame, expected: int | None = None) -> int:
    """The width of all vectors of a corpus that isn't empty."""
    row = dimensions(vectors).first()
    if not row["n"]:
        raise Refused("the corpus is empty")
    if not row["uniform"] or expected not in (None, row["min_dim"]):
        raise Refused(f"widths from {row['min_dim']} to {row['max_dim']}, expected {expected or 'one'}")
    return row["min_dim"]


def norms(vectors: DataFrame, tolerance: float = 1e-3) -> DataFrame:
    """(id, norm, unit) of every vector."""
    return vectors.select("id", vc.norm(F.col("vector")).alias("norm")).withColumn("unit", F.abs(F.col("norm") - 1) <= tolerance)


def parity(ours: DataFrame, fixtures: DataFrame, least: float = PARITY) -> DataFrame:
    """(text, similarity, ok): two embedders' vectors of the same texts; a missing one is not ok."""
    pair = fixtures.select("text", F.col("embedding").alias("_a")).join(ours.select("text", F.col("embedding").alias("_b")), "text", "left")
    score = F.when(F.size("_a") == F.size("_b"), vc.dot(F.col("_a"), F.col("_b")))
    return pair.select("text", score.alias("similarity"), F.coalesce(score >= least, F.lit(False)).alias("ok"))


def require_parity(ours: DataFrame, fixtures: DataFrame, our_model: str, fixture_model: str) -> None:
    if our_model != fixture_model:
        raise Refused(f"fixtures are of {fixture_model}, not of {our_model}")
    if not parity(ours, fixtures).where("not ok").isEmpty():
        raise Refused("the embedders disagree")


def cards_without_images(cards: DataFrame, images: DataFrame) -> DataFrame:
    return cards.join(images.select("slug"), "slug", "left_anti")


def require_images(cards: DataFrame, images: DataFrame) -> None:
    bad = lc.disallowed(images).select("slug", "title", "license").limit(20).collect()
    if bad:
        raise Refused("licence not admitted: " + ", ".join(f"{r['slug']}: {r['title']} ({r['license']})" for r in bad))
    lost = [r["slug"] for r in cards_without_images(cards, images).select("slug").limit(20).collect()]
    if lost:
        raise Refused(f"no admitted image: {', '.join(lost)}")


def require_rows(df: DataFrame, least: int, what: str) -> DataFrame:
    """df, if it has so many rows."""
    n = df.limit(least).count()
    if n < least:
        raise Refused(f"only {n} {what}; {least} are needed")
    return df


def documents_without_chunks(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """Documents to warn about."""
    return docs.join(chunks.select("doc"), "doc", "left_anti")


def orphans(child: DataFrame, key: str, parent: DataFrame, parent_key: str = "id") -> DataFrame:
    """Child rows that refer to no parent row."""
    return child.join(parent.select(F.col(parent_key).alias(key)), key, "left_anti")


def duplicates(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")
