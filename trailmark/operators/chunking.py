"""Documents into token-budgeted chunks that keep their section and pages.

A document is one row until it is chunked, so nothing is shuffled: pages are cleaned, headings
found and lines counted as columns, then a fold over the document's lines cuts the chunks.
"""

from __future__ import annotations

from collections import Counter, deque
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import shared
from ..functions import text as tx
from . import ordered
from .corpus import dense_ids

CHUNK_TOKENS, OVERLAP_TOKENS, LEAST_TOKENS, RATIO, SECTION_SPAN = 220, 48, 24, 0.2, 10
#: Distinct lines that a task counts before it hands them on, lines and documents that it makes Python objects of at once.
PART_LINES, SLICE, DOCUMENTS = 100_000, 1_000, 50


def clean_pages(pages: DataFrame) -> DataFrame:
    """pages(doc, page, text) -> (doc, page, line_no, line): the content lines in their order."""
    lines = tx.clean_lines(tx.nfkc(F.coalesce("text", F.lit(""))))
    return pages.select("doc", "page", F.posexplode(lines).alias("line_no", "line"))


def boilerplate(lines: DataFrame, ratio: float = RATIO) -> DataFrame:
    """(doc, line) of short lines on max(3, floor(pages * ratio)) pages at least, in documents of four pages with content.

    Every task first counts the lines of what it reads, a part of at most ``PART_LINES`` distinct lines
    (and one page) at a time, and writes the counts. A line that is on so many pages is on its share of
    them in at least one part, so only lines that reach that share somewhere are candidates. Only candidates' lines are then shuffled and counted exactly: what is rare
    everywhere stays where it is.
    """
    kind = lines.schema["doc"].dataType.simpleString()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, held, size = {}, [None, None, set()], 0

        def close() -> int:  # a page's distinct lines; how many are new
            doc, page, seen = held
            if page is None and not seen:
                return 0
            counts = found.setdefault(doc, Counter())
            before = len(counts)
            counts[None] += 1  # the document is in this part
            counts.update(seen)
            return len(counts) - before

        def rows() -> Iterator[pa.RecordBatch]:
            for doc, counts in found.items():
                n = len(counts)
                yield pa.RecordBatch.from_arrays([pa.array([doc] * n, doc_type), pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["doc", "line", "n"])
            found.clear()

        for whole in batches:
            doc_type = whole.schema.field("doc").type
            for s in range(0, whole.num_rows, SLICE):
                b = whole.slice(s, SLICE)
                for doc, page, line in zip(b["doc"].to_pylist(), b["page"].to_pylist(), b["line"].to_pylist(), strict=True):
                    if doc != held[0] or page != held[1]:
                        size += close()
                        held[:] = doc, page, set()
                        if size >= PART_LINES:
                            yield from rows()
                            size = 0
                    if len(line) <= tx.BOILERPLATE_LENGTH:
                        held[2].add(line)
        close()
        yield from rows()

    # at least the pages that a line is on: more, where a page's lines don't stand together
    counts = shared.written(lines.select("doc", "page", "line").mapInArrow(each, f"doc {kind}, line string, n long"), "lines")
    pages = lines.select("doc", "page").distinct().groupBy("doc").agg(F.count("*").alias("pages")).where("pages >= 4")
    sizes = pages.join(counts.where("line is null").groupBy("doc").agg(F.count("*").alias("parts")), "doc")
    least = F.greatest(F.lit(3), F.floor(F.col("pages") * ratio))
    some = counts.where("line is not null").join(sizes.select("doc", least.alias("least"), F.ceil(least / F.col("parts")).alias("share")), "doc")
    some = shared.written(some.where(F.col("n") >= F.col("share")).select("doc", "line", "least").distinct(), "candidates")
    once = lines.select("doc", "page", "line").join(some, ["doc", "line"]).distinct()
    return once.groupBy("doc", "line", "least").agg(F.count("*").alias("n")).where(F.col("n") >= F.col("least")).select("doc", "line")


def strip_boilerplate(lines: DataFrame, ratio: float = RATIO) -> DataFrame:
    return lines.join(boilerplate(lines, ratio), ["doc", "line"], "left_anti")


class _Buffer:
    """Lines gathered for the next chunk. A line is (text, tokens, page)."""

    def __init__(self, overlap: int, least: int):
        self.overlap, self.least = overlap, least
        self.lines: deque[tuple[str, int, int]] = deque()
        self.tokens, self.section = 0, None

    def chunk(self) -> tuple | None:
        """The lines as a chunk, if they are enough."""
        if not self.lines or self.tokens < self.least:
            return None
        pages = [p for *_, p in self.lines]
        return "\n".join(t for t, *_ in self.lines), self.section, min(pages), max(pages), self.tokens

    def carry(self, section: str | None) -> None:
        """Keeps the last lines that fit the overlap, under the section that holds now."""
        if not self.lines:
            return
        kept: deque[tuple[str, int, int]] = deque()
        tokens = 0
        while self.lines and tokens + self.lines[-1][1] <= self.overlap:
            kept.appendleft(self.lines.pop())
            tokens += kept[0][1]
        self.lines, self.tokens, self.section = kept, tokens, section


class Fold:
    """The fold over a document's lines, a line at a time."""

    def __init__(self, budget: int = CHUNK_TOKENS, overlap: int = OVERLAP_TOKENS, least: int = LEAST_TOKENS, span: int = SECTION_SPAN, section: str | None = None, since: int = 0):
        self.budget, self.span = budget, span
        self.held, self.section, self.since, self.page = _Buffer(overlap, least), section, since, 0

    def feed(self, at: int, text: str, heading: str | None, tokens: int) -> Iterator[tuple]:
        """The chunks that a line completes."""
        held = self.held
        if at != self.page:
            self.page = at
            if self.section and at - self.since > self.span:
                self.section = None
        if heading:
            if (done := held.chunk()) is not None:
                yield done
            held.carry(self.section)
            self.section, self.since = heading, at
            if not held.lines:
                held.section = heading
            return
        if tokens > self.budget or held.tokens + tokens > self.budget:
            if (done := held.chunk()) is not None:
                yield done
            held.carry(self.section)
        if tokens > self.budget:
            yield text, self.section, at, at, tokens
            return
        if not held.lines:
            held.section = self.section
        held.lines.append((text, tokens, at))
        held.tokens += tokens

    def end(self) -> Iterator[tuple]:
        if (done := self.held.chunk()) is not None:
            yield done


def fold(lines: Iterable[tuple[int, str, str | None, int]], **limits) -> Iterator[tuple]:
    """Chunks (text, section, page_start, page_end, tokens) of lines (page, text, heading, tokens) in order.

    A heading ends a chunk and is no part of one. What is carried over keeps the section of
    the time it was carried, so a chunk behind a heading bears the section before it unless
    nothing was carried. A line over the budget is a chunk of its own. A chunk below the least
    size is dropped, its end still carried. A section holds for ``span`` pages, looked at where a
    page begins.
    """
    state = Fold(**limits)
    for line in lines:
        yield from state.feed(*line)
    yield from state.end()


def fold_documents(docs: DataFrame, count: Callable[[str], int] | None = None, **limits) -> DataFrame:
    """docs(doc, lines array<struct<page, line, heading, tokens>>) -> (doc, seq, text, section, page_start, page_end, token_count).

    count, if given, takes the place of the tokens column (a tokenizer's count).
    """
    kind = docs.schema["doc"].dataType.simpleString()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            kinds = [whole.schema.field("doc").type, pa.int32(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32()]
            for s in range(0, whole.num_rows, DOCUMENTS):
                b = whole.slice(s, DOCUMENTS)
                out: list[tuple] = []
                for doc, lines in zip(b["doc"].to_pylist(), b["lines"], strict=True):
                    out += [(doc, seq, *c) for seq, c in enumerate(fold(_line_rows(lines.values, count), **limits))]
                columns = list(zip(*out, strict=True)) or [[]] * 7
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc", "seq", "text", "section", "page_start", "page_end", "token_count"])

    return docs.select("doc", "lines").mapInArrow(each, f"doc {kind}, seq int, text string, section string, page_start int, page_end int, token_count int")


def _line_rows(lines: pa.StructArray | None, count: Callable[[str], int] | None) -> Iterator[tuple[int, str, str | None, int]]:
    """The structs of a document's lines as tuples, so many at once."""
    for s in range(0, len(lines) if lines is not None else 0, SLICE):
        fields = dict(zip((f.name for f in lines.type), lines.slice(s, SLICE).flatten(), strict=True))
        page, line, heading, tokens = (fields[c].to_pylist() for c in ("page", "line", "heading", "tokens"))
        yield from zip(page, line, heading, map(count, line) if count else tokens, strict=True)


def document_lines(pages: Column, tokens: Callable[[Column], Column] = tx.word_count, boilerplate_lines: Column | None = None) -> Column:
    """Array of line structs of an array of page texts; boilerplate lines are left out."""
    return _line_structs(F.transform(pages, tx.clean_lines), tokens, boilerplate_lines)


def _line_structs(lines: Column, tokens: Callable[[Column], Column], boilerplate_lines: Column | None) -> Column:
    """The same of an array of pages' lines."""
    flat = F.flatten(F.transform(lines, lambda p, i: F.transform(p, lambda line: F.struct((i + 1).alias("page"), line.alias("line")))))
    if boilerplate_lines is not None:
        flat = F.filter(flat, lambda x: ~F.array_contains(boilerplate_lines, x["line"]))
    return F.transform(flat, lambda x: F.struct(x["page"].alias("page"), x["line"].alias("line"), tx.heading(x["line"]).alias("heading"), tokens(x["line"]).alias("tokens")))


def _once(df: DataFrame, name: str, column: Column) -> DataFrame:
    """df with a column that is worked out once a row, also where a lambda reads it for every element: a generator's output isn't inlined."""
    return df.select("*", F.inline(F.array(F.struct(column.alias(name)))))


def chunk_documents(docs: DataFrame, count: Callable[[str], int] | None = None, ratio: float = RATIO, **limits) -> DataFrame:
    """docs(doc, pages array<string>) -> chunks; running heads and feet are found within each document."""
    cleaned = docs.select("doc", F.transform("pages", lambda p: F.coalesce(p, F.lit(""))).alias("pages"))
    found = _once(cleaned.withColumn("pages", _nfkc_pages("pages")), "_lines", F.transform("pages", tx.clean_lines))
    found = _once(found, "_sets", F.filter(F.transform("_lines", F.array_distinct), lambda x: F.size(x) > 0))
    flat = F.filter(F.flatten("_sets"), lambda x: F.length(x) <= tx.BOILERPLATE_LENGTH)
    least = F.greatest(F.lit(3), F.floor(F.size("_sets") * F.lit(ratio)))
    # equal lines stand together once sorted: a line on at least `least` pages equals the one `least - 1` before it
    found = _once(found, "_sorted", F.array_sort(flat))
    repeated = F.array_distinct(F.filter("_sorted", lambda x, i: (i >= least - 1) & (x == F.get(F.col("_sorted"), (i - least + 1).cast("int")))))
    found = _once(found, "_running", F.when(F.size("_sets") >= 4, repeated).otherwise(F.array().cast("array<string>")))
    return fold_documents(found.select("doc", _line_structs(F.col("_lines"), tx.word_count, F.col("_running")).alias("lines")), count, **limits)


@F.arrow_udf(T.ArrayType(T.StringType()))
def _nfkc_pages(pages: pa.Array) -> pa.Array:
    return type(pages).from_arrays(_offsets(pages), tx.nfkc_array(pages.flatten()), mask=pages.is_null() if pages.null_count else None)


def _offsets(lists: pa.Array) -> pa.Array:
    """Where the lists of an array begin and end among its flattened values."""
    ends = np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    return pa.array(np.append(0, ends), pa.int64() if pa.types.is_large_list(lists.type) else pa.int32())


#: Lines of a segment; a task folds one and as much of the next as it takes to meet that one's own fold.
SEGMENT = 5_000
#: A chunk's place: four times the number of the line that completed it, and which of the line's it is.
PLACES, AT_END = 4, 2


def fold_segment(lines: list[tuple], start: int, sections: dict[int, tuple[str, int]], last: bool, **limits) -> tuple[list[tuple], int | None]:
    """(chunks, where the next segment's own fold is met) of a segment's lines and those of the next.

    lines: (number, doc, page, text, heading, tokens) in order; start: the next segment's first number;
    sections: the section and its page that hold where a segment begins, by number. A chunk is (doc,
    place, chunk).

    Two folds are alike once their buffers begin with the same line under the same section: which section
    a line stands in doesn't depend on where the fold began.
    """

    def run(rows: list[tuple], own: dict[int, tuple] | None) -> tuple[list[tuple], dict[int, tuple], int | None]:
        doc, state, held, out, states, before = None, None, [], [], {}, 0
        for number, of, *line in rows:
            if state is None or of != doc:
                if state is not None:
                    out += [(doc, PLACES * before + AT_END, c) for c in state.end()]
                section, since = sections.get(number, (None, 0)) if state is None else (None, 0)
                doc, state, held = of, Fold(**limits, section=section, since=since), []
            states[number] = (held[0], state.held.section) if held else None
            if own is not None and number >= start and own[number] == states[number]:
                return out, states, number
            out += [(doc, PLACES * number + k, c) for k, c in enumerate(state.feed(*line))]
            _, _, heading, tokens = line
            if not heading and tokens <= state.budget:
                held.append(number)
            held = held[len(held) - len(state.held.lines) :]  # what is carried are the last lines
            before = number
        if last and state is not None:
            out += [(doc, PLACES * before + AT_END, c) for c in state.end()]
        return out, states, None

    following = [r for r in lines if r[0] >= start]
    chunks, _, met = run(lines, run(following, None)[1] if following else None)
    return chunks, met


def chunk_pages(pages: DataFrame, ratio: float = RATIO, **limits) -> DataFrame:
    """pages(doc, page, text) -> chunks as of chunk_documents, of documents of any size.

    Lines are numbered through, and cut into segments that are folded at once: each from an empty
    buffer and on into the next segment until its buffer is that of the next segment's own fold,
    from where on that one's chunks are right. A document whose folds don't meet within a segment is
    folded in one piece.
    """
    lines = strip_boilerplate(clean_pages(pages), ratio)
    marked = lines.select("doc", "page", "line_no", "line", tx.heading(F.col("line")).alias("heading"), tx.word_count(F.col("line")).alias("tokens"))
    size = SEGMENT
    numbered = dense_ids(marked, "doc", "page", "line_no", name="number").withColumn("segment", F.floor((F.col("number") - 1) / size))
    # the last heading before each segment of a document: a row a segment and document
    of = numbered.groupBy("doc", "segment").agg(F.min("number").alias("number"), F.max(F.when(F.col("heading").isNotNull(), F.struct("number", "heading", "page"))).alias("h"))
    earlier = F.last("h", ignorenulls=True).over(Window.partitionBy("doc").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1))
    open_ = of.withColumn("h", earlier).where("h is not null").select("segment", F.struct("number", F.col("h.heading").alias("heading"), F.col("h.page").alias("page")).alias("s"))
    both = lambda df: df.withColumn("owner", F.explode(F.array("segment", F.col("segment") - 1))).where("owner >= 0")
    found = both(numbered).join(both(open_).groupBy("owner").agg(F.collect_list("s").alias("sections")), "owner", "left")
    found = found.select("owner", "number", "doc", "page", "line", "heading", "tokens", "sections").repartition("owner").sortWithinPartitions("owner", "number")
    kind = pages.schema["doc"].dataType.simpleString()
    names = ["doc", "at", "text", "section", "page_start", "page_end", "token_count", "owner", "met", "broken"]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owner, rows, sections, doc_type = None, [], {}, None

        def folded() -> Iterator[pa.RecordBatch]:
            start = (owner + 1) * size + 1
            last = rows[-1][0] < start
            chunks, met = fold_segment(rows, start, sections, last, **limits)
            broken = None if last or met is not None else rows[-1][1]
            table = [(doc, at, *c, owner, None, None) for doc, at, c in chunks] + [(None,) * 7 + (owner + 1, met, broken)]
            kinds = [doc_type, pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), doc_type]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*table, strict=True), kinds, strict=True)], names)

        for b in batches:
            doc_type = b.schema.field("doc").type
            owners = b["owner"].to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(owners[1:] != owners[:-1]) + 1).tolist(), len(owners)]
            for s, e in zip(cuts[:-1], cuts[1:], strict=True):
                if s == e:
                    continue
                if owners[s] != owner:
                    if rows:
                        yield from folded()
                    owner, rows = int(owners[s]), []
                    sections = {x["number"]: (x["heading"], x["page"]) for x in b["sections"][s].as_py() or []}  # every row of a segment has them
                part = b.slice(s, e - s)
                rows += zip(*(part[c].to_pylist() for c in ("number", "doc", "page", "line", "heading", "tokens")), strict=True)
        if rows:
            yield from folded()

    made = shared.written(found.mapInArrow(each, f"doc {kind}, at long, text string, section string, page_start int, page_end int, token_count int, owner long, met long, broken {kind}"), "folded")
    marks = made.where("at is null").select("owner", F.col("met").alias("_met"))  # a row a segment
    broken = made.where("broken is not null").select(F.col("broken").alias("doc")).distinct()
    right = made.where("at is not null").join(marks, "owner", "left").where(F.coalesce(F.col("at") >= PLACES * F.col("_met"), F.lit(True)))
    columns = ["doc", "seq", "text", "section", "page_start", "page_end", "token_count"]
    out = ordered.number(right.join(broken, "doc", "left_anti"), ["doc"], ["at"], "seq").withColumn("seq", F.col("seq").cast("int")).select(columns)
    line = F.struct("number", "page", "line", "heading", "tokens")
    pieces = numbered.join(broken, "doc", "left_semi").groupBy("doc").agg(F.sort_array(F.collect_list(line)).alias("lines"))
    return out.unionByName(fold_documents(pieces, **limits).select(columns))
