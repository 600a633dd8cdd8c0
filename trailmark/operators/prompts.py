"""Prompts from gated hits, and chat records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The sentinel and the layouts of a prompt.
NO_MATCH = "NO_MATCHING_PROTOCOL_FOUND"
APP_LAYOUT = "Retrieved context:\n{context}\n\nUser question: {question}"
NO_MATCH_LAYOUT = "No protocol excerpt matched this question with sufficient confidence.\n\nResponder asked: {question}"
EXCERPT_LAYOUT = "Retrieved excerpts:\n\n{context}\n\nResponder asked: {question}\n\nIf these excerpts genuinely cover the question, answer from them and open with the citation. If they do not, say that no matching protocol was found."


def fill(layout: str, **values: Column) -> Column:
    """A layout with columns in place of its names."""
    parts, rest = [], layout
    while "{" in rest:
        before, _, tail = rest.partition("{")
        name, _, rest = tail.partition("}")
        parts += [F.lit(before), values[name]]
    return F.concat(*parts, F.lit(rest))


def context(chunks: Column) -> Column:
    """Citation and text of chunks (structs in order), a blank line between."""
    return F.array_join(F.transform(chunks, lambda c: F.concat(c["citation"], F.lit("\n"), c["text"])), "\n\n")


def excerpts(chunks: Column) -> Column:
    """The same with numbers, from 1."""
    return F.array_join(F.transform(chunks, lambda c, i: F.concat(F.lit("[EXCERPT "), (i + 1).cast("string"), F.lit("] "), c["citation"], F.lit("\n"), c["text"])), "\n\n")


def gather(hits: DataFrame) -> DataFrame:
    """hits(query_id, rank, citation, text) -> (query_id, chunks in order)."""
    return hits.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "citation", "text"))).alias("chunks"))


def app_prompt(result: Column, chunks: Column, question: Column) -> Column:
    return fill(APP_LAYOUT, context=F.when(result == "match", context(chunks)).otherwise(NO_MATCH), question=question)


def excerpt_prompt(result: Column, chunks: Column, question: Column) -> Column:
    return F.when(result == "match", fill(EXCERPT_LAYOUT, context=excerpts(chunks), question=question)).otherwise(fill(NO_MATCH_LAYOUT, question=question))


def build(questions: DataFrame, gated: DataFrame, hits: DataFrame, prompt=app_prompt) -> DataFrame:
    """(query_id, result, citation, prompt): questions(query_id, question), the gate's rows and the shown hits.

    The citation is the best hit's. Blank questions are not asked.
    """
    rows = questions.where(F.trim("question") != "").join(gated.select("query_id", "result"), "query_id", "left").join(gather(hits), "query_id", "left")
    result = F.coalesce("result", F.lit("noConfidentMatch"))
    best = F.when(result == "match", F.get("chunks", F.lit(0))["citation"])
    return rows.select("query_id", result.alias("result"), best.alias("citation"), prompt(result, F.col("chunks"), F.trim("question")).alias("prompt"))


def messages(system: Column, user: Column, assistant: Column) -> Column:
    """A chat record's three messages."""
    return F.array(*(F.struct(F.lit(role).alias("role"), c.alias("content")) for role, c in (("system", system), ("user", user), ("assistant", assistant))))


def ordered_concat(df: DataFrame, key: str, order: str, text: str, separator: str = "") -> DataFrame:
    """(key, text) of streamed parts put together in their order."""
    parts = F.sort_array(F.collect_list(F.struct(order, text)))
    return df.groupBy(key).agg(F.array_join(F.transform(parts, lambda p: p[text]), separator).alias(text))
