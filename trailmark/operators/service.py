"""What a caller of a search service gets, as tables: facts of a store, and a gated, filtered answer."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import shared
from ..functions import safety
from ..functions.text import not_blank
from . import prompts, search, validation


def info(meta: DataFrame | None, vectors: DataFrame, threshold: float = search.THRESHOLD, k: int = search.TOP_K) -> DataFrame:
    """One row: chunks, width, threshold and k of a store; a store that must not be asked is refused."""
    validation.require_normalized(meta)
    width = validation.require_corpus(vectors)
    return vectors.agg(F.count("*").alias("chunk_count")).select("chunk_count", F.lit(width).alias("dimension"), F.lit(threshold).alias("threshold"), F.lit(k).alias("top_k"))


def ask(vectors: DataFrame, texts: DataFrame, questions: DataFrame, k: int = search.TOP_K, threshold: float = search.THRESHOLD, generate: Callable[[Column], Column] | None = None) -> DataFrame:
    """questions(query_id, question, vector) -> (query_id, result, citation, prompt, answer, was_modified, matched_patterns).

    Blank questions aren't asked. generate makes a text of a prompt; without one the answer is
    the retrieved context. Whatever the answer says passes the safety filter.
    """
    asked = questions.where(not_blank(F.col("question")))
    gated = shared.written(search.gate(search.top_k(vectors, asked, k), asked, threshold), "gated")  # read twice, searched once
    shown = search.show(gated, texts)
    built = prompts.build(asked, gated, shown)
    if generate is not None:
        answered = built.withColumn("raw", generate(F.col("prompt")))
    else:
        context = prompts.gather(shown).select("query_id", prompts.context(F.col("chunks")).alias("raw"))
        answered = built.join(context, "query_id", "left").withColumn("raw", F.coalesce("raw", F.lit(prompts.NO_MATCH)))
    out = safety.sanitize(answered, "raw")
    return out.select("query_id", "result", "citation", "prompt", F.col("safe_text").alias("answer"), "was_modified", "matched_patterns")
