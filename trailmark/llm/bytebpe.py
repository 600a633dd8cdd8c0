"""Byte-level BPE encoding by overlapping chunks, and decoding by concatenating raw bytes.

A text of at most ``chunk_chars`` characters is one chunk. A longer one is dealt to tasks as
overlapping chunks. Each chunk is pre-tokenised on its own; within an overlap the two scans
share a boundary as soon as the later one has found its step (the pattern never looks back, so
from a shared boundary on both scans are the scan of the whole text). The text is cut at the
least shared boundary of each overlap, and the pieces are encoded separately. A text with an
overlap that has no shared boundary (a run of letters longer than the overlap) is encoded whole.

Defined results: null and empty texts have no ids; rows that share doc_id and text each get a
row; a null doc_id is kept; extra columns are not carried.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
CHUNK_CHARS, OVERLAP_CHARS = 16_384, 1_024
#: A contraction needs so many characters of text behind a boundary to show itself.
MARGIN = 4
_CODECS: dict[str, Codec] = {}


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Codec:
    """Ranks, the pre-token pattern and the table of raw bytes of one vocabulary file."""

    def __init__(self, path: str):
        import public_tokenizers
        import regex
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        self.raw: list[bytes] = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.raw[rank] = token

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        return np.asarray(self.encoding.encode_to_numpy(text, disallowed_special=()), "<u4").tobytes()

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.raw.__getitem__, np.frombuffer(ids, "<u4").tolist()))

    def boundaries(self, text: str) -> np.ndarray:
        """Ends of the pre-tokens of a text."""
        return np.fromiter((m.end() for m in self.pattern.finditer(text)), np.int64)


def codec(path: str) -> Codec:
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def chunks(text: str, size: int, overlap: int) -> list[str]:
    """Chunk k starts at k * size and reaches overlap characters into the next."""
    return [text[at : at + size + overlap] for at in range(0, len(text), size)]


def stitch(heads: list[np.ndarray], tails: list[np.ndarray]) -> list[int] | None:
    """Cuts 1.. of a text: the least boundary that chunk k - 1 (tail) and chunk k (head) share, or None."""
    cuts = []
    for tail, head in zip(tails, heads[1:], strict=False):
        both = np.intersect1d(tail, head)
        if not len(both):
            return None
        cuts.append(int(both[0]))
    return cuts


def zones(codec_: Codec, chunk: str, k: int, last: bool, size: int, overlap: int) -> tuple[np.ndarray, np.ndarray]:
    """A chunk's boundaries, as places in the text, within its first and its last overlap."""
    ends = codec_.boundaries(chunk)
    if not last:
        ends = ends[ends <= len(chunk) - MARGIN]
    return ends[ends <= overlap - MARGIN] + k * size, ends[ends > size] + k * size


def encode(docs: DataFrame, path: str | None = None, chunk_chars: int = CHUNK_CHARS, overlap_chars: int = OVERLAP_CHARS) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, ids binary): little-endian unsigned 32-bit ids of the whole text."""
    path = path or vocabulary_path()
    if overlap_chars <= 2 * MARGIN or overlap_chars > chunk_chars:
        raise ValueError("the overlap must exceed 8 characters and not exceed a chunk")
    scratch = Scratch(docs.sparkSession, "bytebpe")
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    id_type = docs.schema["doc_id"].dataType
    kind = id_type.simpleString()
    one_chunk, several = F.length("text") <= chunk_chars, F.length("text") > chunk_chars

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in batches:
            for part in _parts(b):
                yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array([c.encode(x) for x in part["text"].to_pylist()], pa.binary())], ["doc_id", "ids"])

    def cut_up(batches):
        for b in batches:
            for doc, text in zip(b["doc_id"], b["text"].to_pylist(), strict=True):
                pieces, key = chunks(text, chunk_chars, overlap_chars), hashlib.blake2b(text.encode(), digest_size=16).digest()
                for k, piece in enumerate(pieces):
                    yield pa.RecordBatch.from_arrays([pa.array([doc.as_py()], b["doc_id"].type), pa.array([key], pa.binary()), pa.array([k], pa.int32()), pa.array([len(pieces)], pa.int32()), pa.array([piece])], ["doc_id", "key", "k", "n", "chunk"])

    def scan(batches):
        c = codec(path)
        for b in batches:
            found = [zones(c, x, k, k == n - 1, chunk_chars, overlap_chars) for x, k, n in zip(b["chunk"].to_pylist(), b["k"].to_pylist(), b["n"].to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["key"], b["k"], b["n"], *(pa.array([f[i].tolist() for f in found], pa.list_(pa.int64())) for i in (0, 1))], ["doc_id", "key", "k", "n", "head", "tail"])

    def pieces(batches):
        c = codec(path)
        for b in batches:
            ids = []
            for chunk, k, start, end in zip(b["chunk"].to_pylist(), b["k"].to_pylist(), b["start"].to_pylist(), b["end"].to_pylist(), strict=True):
                base = k * chunk_chars
                ids.append(c.encode(chunk[start - base : None if end is None else end - base]))
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["key"], b["k"], b["n"], pa.array(ids, pa.binary())], ["doc_id", "key", "k", "n", "ids"])

    def joined(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array([b"".join(x) for x in b["parts"].to_pylist()], pa.binary())], ["doc_id", "ids"])

    short = docs.where(one_chunk).mapInArrow(whole, f"doc_id {kind}, ids binary")
    cut = docs.where(several).mapInArrow(cut_up, f"doc_id {kind}, key binary, k int, n int, chunk string")
    cut = scratch.save(cut.repartition("doc_id", "key", "k"), "chunks")  # chunks of one text go to many tasks
    # rows that share doc_id and text have the same chunks: each is handled once, and counted
    marks = cut.mapInArrow(scan, f"doc_id {kind}, key binary, k int, n int, head array<long>, tail array<long>")
    marks = scratch.save(marks.groupBy("key", "k").agg(F.first("n").alias("n"), F.first("head").alias("head"), F.first("tail").alias("tail")), "marks")
    after = marks.select("key", (F.col("k") - 1).alias("k"), F.col("head").alias("next_head"))
    seams = marks.where("k < n - 1").join(after, ["key", "k"]).select("key", "k", F.array_min(F.array_intersect("tail", "next_head")).alias("at"))
    lost = seams.where("at is null").select("key").distinct()
    seams = scratch.save(seams, "seams")
    starts = seams.select("key", (F.col("k") + 1).alias("k"), F.col("at").alias("start"))
    ends = seams.select("key", "k", F.col("at").alias("end"))
    apart = cut.join(lost, "key", "left_anti").join(starts, ["key", "k"], "left").join(ends, ["key", "k"], "left").withColumn("start", F.coalesce("start", F.lit(0).cast("long")))
    coded = apart.mapInArrow(pieces, f"doc_id {kind}, key binary, k int, n int, ids binary")
    parts = coded.groupBy("doc_id", "key").agg(F.sort_array(F.collect_set(F.struct("k", "ids"))).alias("s"), (F.count("*") / F.first("n")).cast("int").alias("copies"))
    parts = parts.select("doc_id", F.col("s.ids").alias("parts"), F.explode(F.sequence(F.lit(1), "copies")))
    stitched = parts.select("doc_id", "parts").mapInArrow(joined, f"doc_id {kind}, ids binary")
    # a text without a shared boundary somewhere: all its chunks again as one text
    alone = cut.join(lost, "key", "left_semi").select("doc_id", "key", "k", "n", F.substring("chunk", 1, chunk_chars).alias("chunk"))
    alone = alone.groupBy("doc_id", "key").agg(F.sort_array(F.collect_set(F.struct("k", "chunk"))).alias("s"), (F.count("*") / F.first("n")).cast("int").alias("copies"))
    alone = alone.select("doc_id", F.array_join("s.chunk", "").alias("text"), F.explode(F.sequence(F.lit(1), "copies"))).select("doc_id", "text")
    return short.union(stitched).union(alone.mapInArrow(whole, f"doc_id {kind}, ids binary"))


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids) -> (doc_id, ids, raw binary): the ids' raw bytes one after another."""
    path = path or vocabulary_path()
    kind = encoded.schema["doc_id"].dataType.simpleString()

    def back(batches):
        c = codec(path)
        for b in batches:
            for part in _parts(b):
                yield pa.RecordBatch.from_arrays([part["doc_id"], part["ids"], pa.array([c.decode(x) for x in part["ids"].to_pylist()], pa.binary())], ["doc_id", "ids", "raw"])

    return encoded.select("doc_id", "ids").mapInArrow(back, f"doc_id {kind}, ids binary, raw binary")


def _parts(batch: pa.RecordBatch, rows: int = 1_000) -> Iterator[pa.RecordBatch]:
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document and what they decode to, as digests."""
    back = decode(encode(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    return back.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("raw", 256).alias("decoded_sha256"))
