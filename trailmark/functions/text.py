"""Cleaning, headings, citations and cards as column expressions.

Everything here stays in the JVM except NFKC, which has no built-in and is Arrow-batched.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Patterns of line cleaning and heading detection.
HYPHEN_BREAK = r"(?U)(\w)-\n(\w)"
LINE_BREAK = r"\r\n|[\n\r\x0b\f\x1c-\x1e\x85\u2028\u2029]"
SPACES = r"[ \t\u00a0]{2,}|[\t\u00a0]"
WHITE = "\t\n\x0b\f\r\x1c\x1d\x1e\x1f \x85\u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
PAGE_ARTIFACT = r"(?iU)^\s*(page\s+)?\d+\s*(of\s+\d+)?\s*$"
ROMAN_PAGE = r"(?i)^[ivxlc]+$"
DOT_LEADER = r"\.{4,}|…{2,}|_{4,}"
NUMBERED_HEADING = r"(?iU)^\s*(?:(?:section|chapter|appendix)\s+)?(\d+(?:\.\d+)*)[.:\)\s-]+([A-Za-z][^\n]{2,80})$"
CAPS_HEADING = r"^[A-Z][A-Z &/,'()\-]{3,70}$"
YEAR = r"(?U)\b(19|20)\d{2}\b"
MONTH = r"(?iU)\b(january|february|march|april|may|june|july|august|september|october|november|december)\b"
DOC_ID = r"(?iU)\b[A-Z]{2,4}\s?\d+[-.]\d+"
FUNCTION_WORDS = ["a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "if", "in", "is", "not", "of", "on", "or", "the", "to", "with"]
ADMONITIONS = ["warning", "caution", "note", "notes", "danger", "important", "figure", "table"]
BOILERPLATE_LENGTH, HEADING_LENGTH = 120, 90


def nfkc_array(texts: pa.Array) -> pa.Array:
    """Texts in NFKC; those of ASCII letters stay as they are, and become no Python objects."""
    other = np.flatnonzero(pc.invert(pc.string_is_ascii(texts)).fill_null(False).to_numpy(zero_copy_only=False))
    if not len(other):
        return texts
    pieces, at = [], 0
    for k in other.tolist():
        pieces += [texts.slice(at, k - at), pa.array([unicodedata.normalize("NFKC", texts[k].as_py())], texts.type)]
        at = k + 1
    return pa.concat_arrays([*pieces, texts.slice(at)])


@F.arrow_udf(T.StringType())
def nfkc(text: pa.Array) -> pa.Array:
    return nfkc_array(text)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is worked out once, however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITE))


def join_hyphens(text: Column) -> Column:
    return F.when(F.contains(text, F.lit("-\n")), F.regexp_replace(text, HYPHEN_BREAK, "$1$2")).otherwise(text)


def split_lines(text: Column) -> Column:
    """Lines; a break at the very end begins no line of its own."""
    return let(F.split(text, LINE_BREAK), lambda x: F.when(F.element_at(x, -1) == "", F.slice(x, 1, F.size(x) - 1)).otherwise(x))


def clean_line(line: Column) -> Column:
    return strip(F.regexp_replace(line, SPACES, " "))


def is_content(line: Column) -> Column:
    """Neither empty, nor a page number in either script, nor a line with a dot leader."""
    return (line != "") & ~line.rlike(PAGE_ARTIFACT) & ~line.rlike(ROMAN_PAGE) & ~line.rlike(DOT_LEADER)


def clean_lines(text: Column) -> Column:
    """Array of the cleaned lines of a page that are content."""
    return F.filter(F.transform(split_lines(join_hyphens(text)), clean_line), is_content)


def title_case_ratio(text: Column) -> Column:
    words = F.regexp_extract_all(text, F.lit(r"([A-Za-z][A-Za-z'/-]*)"), 1)
    capital = F.filter(words, lambda w: w.rlike("^[A-Z]"))
    return F.when(F.size(words) > 0, F.size(capital) / F.size(words)).otherwise(F.lit(0.0))


def ends_open(text: Column) -> Column:
    return text.rlike("[.,;:]$")


def numbered_heading(line: Column) -> Column:
    """ "number title" of a numbered heading, else null."""
    number, title = F.regexp_extract(line, NUMBERED_HEADING, 1), strip(F.regexp_extract(line, NUMBERED_HEADING, 2))
    top = F.split(number, r"\.")[0]
    holds = (
        (F.length(F.regexp_replace(top, "^0+", "")) <= 2)
        & (F.length(F.regexp_replace(title, "[^A-Za-z]", "")) >= 3)
        & (F.length(title) <= 60)
        & ~ends_open(title)
        & (title_case_ratio(title) >= 0.6)
        & (F.lower(strip(line)).rlike("^(section|chapter|appendix)") | number.contains("."))
    )
    return F.when(holds, F.concat_ws(" ", number, title))


def caps_heading(line: Column) -> Column:
    """The line itself if it is a heading in capitals, else null."""
    words = F.regexp_extract_all(F.lower(line), F.lit("([a-z]+)"), 1)
    other = F.exists(words, lambda w: ~w.isin(FUNCTION_WORDS + ADMONITIONS))
    return F.when(line.rlike(CAPS_HEADING) & ~ends_open(line) & other, line)


def titled(capitals: Column) -> Column:
    """A line of capitals with a capital behind every character that is no letter, and small letters else."""
    parts = F.split(F.lower(capitals), "(?<=[^a-z])")
    return F.array_join(F.transform(parts, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, HEADING_LENGTH))), "")


def heading(line: Column) -> Column:
    """A section label, or null for body text. Numbered steps are no headings."""
    excluded = (F.length(line) > HEADING_LENGTH) | line.rlike(YEAR) | line.rlike(MONTH) | line.rlike(DOC_ID)
    return F.when(excluded, None).when(line.rlike(NUMBERED_HEADING), numbered_heading(line)).otherwise(titled(caps_heading(line)))


def citation(prefix: Column, section: Column, page_start: Column, page_end: Column) -> Column:
    named = F.when(section.rlike(r"^\p{Nd}"), F.concat(F.lit("Section "), section)).when(section != "", section)
    pages = F.when(page_start == page_end, F.concat(F.lit("p. "), page_start.cast("string"))).otherwise(F.concat(F.lit("pp. "), page_start.cast("string"), F.lit("-"), page_end.cast("string")))
    return F.concat(F.lit("[Source: "), F.concat_ws(", ", prefix, named, pages), F.lit("]"))


def card_citation(prefix: Column, common: Column, scientific: Column, derived_from: Column) -> Column:
    return F.concat(F.lit("[Source: "), prefix, F.lit(" - "), common, F.lit(" ("), scientific, F.lit("); derived from "), derived_from, F.lit("]"))


def numbered(steps: Column, separator: str) -> Column:
    """ "1. first", "2. second" and so on, joined."""
    return F.array_join(F.transform(steps, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x)), separator)


def card_text(card) -> Column:
    """What of a hazard card is embedded and spoken. card: a function from field names to columns."""
    some = lambda c, out: F.when(c != "", out)
    return F.concat_ws(
        "\n",
        F.concat(card("common_name"), F.lit(" ("), card("scientific_name"), F.lit("). Hazard: "), card("hazard_class"), F.lit(".")),
        F.concat(F.lit("Where found: "), card("region"), F.lit(".")),
        F.concat(F.lit("Field identification: "), card("identification")),
        some(card("lookalikes"), F.concat(F.lit("Commonly confused with: "), card("lookalikes"))),
        F.concat(F.lit("Field response checklist: "), numbered(card("field_response"), " ")),
        F.when(F.size(card("do_not")) > 0, F.concat(F.lit("Do not: "), F.array_join(card("do_not"), " "))),
        F.lit("Identification must be confirmed by the responder against the reference images; this assistant does not identify species."),
    )


def strip_html(text: Column) -> Column:
    """Text without tags, white space collapsed."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(text, "<[^>]+>", ""), r"\s+", " "), "^ | $", "")


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))


def snippet(text: Column, length: int) -> Column:
    return F.substring(F.regexp_replace(F.regexp_replace(text, r"\s+", " "), "^ | $", ""), 1, length)


def not_blank(text: Column) -> Column:
    return strip(text) != ""
