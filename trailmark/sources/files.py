"""Files as tables: page texts of binary documents, JSONL records, vocabularies, SQLite stores."""

from __future__ import annotations

import re
import sqlite3
from collections.abc import Callable, Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThanOrEqual, InputPartition
from pyspark.sql.types import StringType, StructField, StructType

from .. import schema
from ..functions import vectors as vc
from ..functions import wordpiece


def binary_files(spark: SparkSession, folder: str, pattern: str = "*.pdf") -> DataFrame:
    """(filename, path, content) of a folder's files of a pattern."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    return found.select(F.element_at(F.split("path", "/"), -1).alias("filename"), "path", "content")


def page_texts(files: DataFrame, extract: Callable[[bytes], list[Callable[[], str] | str]]) -> DataFrame:
    """files(filename, content) -> (doc, pages array<string>) by a given extractor.

    The extractor gives a text or a function for every page; a page that fails is empty and the
    others stand.
    """

    def page(p) -> str:
        try:
            return (p() if callable(p) else p) or ""
        except Exception:  # an extractor may fail in any way of its own
            return ""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pages = [[page(p) for p in extract(c)] for c in b["content"].to_pylist()]
            yield pa.RecordBatch.from_arrays([b["filename"], pa.array(pages, pa.list_(pa.string()))], ["doc", "pages"])

    return files.select("filename", "content").mapInArrow(each, "doc string, pages array<string>")


def page_rows(df: DataFrame, content: str, extract: Callable[[bytes | str], list[Callable[[], str] | str]], keep: list[str]) -> DataFrame:
    """A row for every page of every document: the columns to keep, page (from 1) and text.

    A table function in a lateral join, so a document's pages needn't stand in one row. A page whose
    function fails is empty and the others stand; a document that can't be opened has no pages.
    """

    class Pages:
        def eval(self, raw) -> Iterator[tuple[int, str]]:
            try:
                listed = extract(raw) if raw is not None else []
            except Exception:  # an extractor may fail in any way of its own
                return
            for n, p in enumerate(listed):
                try:
                    text = (p() if callable(p) else p) or ""
                except Exception:
                    text = ""
                yield n + 1, text

    pages = F.udtf(Pages, returnType="page int, text string")
    return df.lateralJoin(pages(F.col(content).outer())).select(*keep, "page", "text")


def html_pages(html: str) -> list[Callable[[], str]]:
    """Paragraphs of an HTML article as pages; one that isn't closed can't be read."""

    def page(part: str) -> str:
        inside, closed, _ = part.partition("</p>")
        if not closed:
            raise ValueError("a paragraph isn't closed")
        return " ".join(re.sub("<[^>]+>", "", inside).split())

    body = html.partition("<article>")[2].partition("</article>")[0]
    return [partial(page, part) for part in body.split("<p>")[1:]]


def first_success(df: DataFrame, *contents: str) -> DataFrame:
    """df with content: the first of the columns that is a PDF; null if none is."""
    return df.withColumn("content", F.coalesce(*(F.when(vc.is_pdf(F.col(c)), F.col(c)) for c in contents)))


def records(spark: SparkSession, path: str) -> DataFrame:
    """Chat records of a JSONL file."""
    return spark.read.schema(schema.RECORD).json(path)


def sorted_records(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(kept, quarantined) of the lines of a JSONL file: together they are all of its lines.

    kept(messages) are chat records of three messages; quarantined(line, reason) are blank lines, lines
    that are no JSON, and JSON that is no such record. Each line is parsed once.
    """
    kind = StructType([*schema.RECORD.fields, StructField("_corrupt", StringType())])
    lines = spark.read.text(path)
    read = lines.select("value", F.inline(F.array(F.from_json("value", kind, {"columnNameOfCorruptRecord": "_corrupt"}))))
    blank, good = F.trim("value") == "", F.coalesce(F.size("messages") == 3, F.lit(False)) & F.col("_corrupt").isNull()
    reason = F.when(blank, "blank").when(F.col("_corrupt").isNotNull(), "no JSON").when(~good, "no record of three messages")
    told = read.withColumn("reason", reason)
    return told.where("reason is null").select("messages"), told.where("reason is not null").select(F.col("value").alias("line"), "reason")


def write_lines(lines: DataFrame, path: str) -> None:
    lines.write.mode("overwrite").text(path)


def parity_fixtures(spark: SparkSession, path: str) -> DataFrame:
    """(embedding_model, embedding_dim, normalized, text, embedding) of a fixture file."""
    found = spark.read.schema(schema.PARITY).option("multiLine", True).json(path)
    return found.select("embedding_model", "embedding_dim", "normalized", F.inline("fixtures"))


def parity_json(vectors: DataFrame, model: str, width: int, digits: int = 6) -> DataFrame:
    """vectors(text, vector) as one JSON object with rounded components."""
    entry = F.struct("text", vc.rounded(F.col("vector"), digits).alias("embedding"))
    whole = F.struct(F.lit(model).alias("embedding_model"), F.lit(width).alias("embedding_dim"), F.lit(True).alias("normalized"), F.sort_array(F.collect_list(entry)).alias("fixtures"))
    return vectors.agg(F.to_json(whole).alias("value"))


def vocabulary(spark: SparkSession, path: str) -> dict[str, int]:
    """Token -> line number of a vocabulary file, read through Spark's file systems."""
    rows = spark.read.format("binaryFile").load(path).select("content").collect()  # one file
    return wordpiece.read_vocabulary(bytes(rows[0]["content"]).decode("utf-8"))


def tokenizer_config(spark: SparkSession, path: str) -> wordpiece.Config:
    return wordpiece.Config.read("\n".join(r["value"] for r in spark.read.text(path).collect()))


class _Range(InputPartition):
    def __init__(self, low: int, high: int):
        self.low, self.high = low, high


class SqliteReader(DataSourceReader):
    """Rows of one table, in parts by rowid; equality and >= go to SQLite.

    The file must be readable at its path wherever tasks run.
    """

    def __init__(self, kind: StructType, options: dict):
        self.columns = [f.name for f in kind.fields]
        self.path, self.table, self.parts = options["path"], options["table"], int(options.get("numpartitions", 4))
        self.where: list[tuple[str, object]] = []

    def _quoted(self, name: str) -> str:
        return '"' + name.replace('"', '""') + '"'

    def _open(self) -> sqlite3.Connection:
        return sqlite3.connect(f"file:{self.path}?mode=ro", uri=True)

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            sign = {EqualTo: "=", GreaterThanOrEqual: ">="}.get(type(f))
            if sign and len(f.attribute) == 1:
                self.where.append((f"{self._quoted(f.attribute[0])} {sign} ?", f.value))
            else:
                yield f

    def partitions(self) -> list[_Range]:
        db = self._open()
        try:
            low, high = db.execute(f"SELECT min(rowid), max(rowid) FROM {self._quoted(self.table)}").fetchone()
        finally:
            db.close()
        if low is None:
            return [_Range(0, 0)]
        step = -(-(high - low + 1) // self.parts)
        return [_Range(a, a + step) for a in range(low, high + 1, step)]

    def read(self, partition: _Range) -> Iterator[tuple]:
        clauses = ["rowid >= ? AND rowid < ?", *(w for w, _ in self.where)]
        sql = f"SELECT {', '.join(map(self._quoted, self.columns))} FROM {self._quoted(self.table)} WHERE {' AND '.join(clauses)}"
        db = self._open()
        try:
            yield from db.execute(sql, [partition.low, partition.high, *(v for _, v in self.where)])
        finally:
            db.close()


class SqliteSource(DataSource):
    """Format "sqlite_table": options path, table, numPartitions; the schema is the store's."""

    TABLES = {"meta": schema.META, "sources": schema.SOURCES, "chunks": schema.CHUNKS, "species": schema.CARDS, "chunk_images": schema.CHUNK_IMAGES}

    @classmethod
    def name(cls) -> str:
        return "sqlite_table"

    def schema(self) -> StructType:
        return self.TABLES[self.options["table"]]

    def reader(self, schema: StructType) -> SqliteReader:
        return SqliteReader(schema, dict(self.options))


def sqlite_table(spark: SparkSession, path: str, table: str, columns: StructType | None = None) -> DataFrame | None:
    """A table of a SQLite store, or None if the store has no such table; a missing store is an error."""
    db = sqlite3.connect(f"file:{path}?mode=ro", uri=True)
    try:
        there = db.execute("SELECT 1 FROM sqlite_master WHERE type = 'table' AND name = ?", [table]).fetchone()
    finally:
        db.close()
    if not there:
        return None
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SqliteSource)
    reader = spark.read.format("sqlite_table").option("path", path).option("table", table)
    return (reader.schema(columns) if columns is not None else reader).load()
