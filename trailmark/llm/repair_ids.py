"""Token ids in shard files compressed by Re-Pair grammars.

A shard holds the ids of a range of documents in ascending doc_id order. Re-Pair replaces the
most frequent pairs of neighbouring ids by nonterminals, round after round: each round takes the
frequent pairs that don't compete for ids (a pair's first id is no other's second), and replaces
their occurrences from left to right, until no pair occurs ``LEAST_COUNT`` times. Documents are
compressed apart, so that no nonterminal crosses a document's end. Rules are kept with the lengths of their
expansions, and documents with their places, so any document, or any stretch of one, is decoded
without the rest of the shard.

File format of a shard, little-endian:
  magic b"RPG1", then unsigned 32-bit: ids below which a symbol is a terminal, rules, documents,
  symbols; rules as (left, right) pairs and the expansion length of each; a flag and the doc_id
  (signed 64-bit) of each document; the first symbol of each document and one past the last
  (unsigned 64-bit); the ids before each document in the shard and in all (unsigned 64-bit);
  the symbols, as unsigned 16-bit numbers where all fit, else 32-bit.
The files are the ``payload`` column of a table that Spark writes, one row a shard.

Defined results: null and empty texts are the end id alone; rows that share a doc_id follow
one another, in an order by a hash of the text; a null doc_id comes first; an id that is no
terminal is refused; a very long text is a document like others, in a shard of its own size;
extra columns are not carried.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, range_count, trim
from .wordbpe import encoder, spans, vocabulary_path

END_ID = 2
#: Terminal ids lie below, nonterminals from here on.
TERMINALS = 49_408
LEAST_COUNT, SHARD_IDS, RANGE_BYTES = 16, 1_000_000, 32_000_000
MAGIC = b"RPG1"


class Grammar:
    """Rules of one shard: nonterminal TERMINALS + k stands for (left[k], right[k])."""

    def __init__(self, left: np.ndarray, right: np.ndarray, length: np.ndarray, terminals: int):
        self.left, self.right, self.length, self.terminals = left, right, length, terminals

    def _tables(self) -> tuple[np.ndarray, np.ndarray]:
        """All expansions one after another, terminals' first, and where each begins."""
        if not hasattr(self, "_flat"):
            flat = [np.arange(self.terminals, dtype=np.uint32)]
            starts, at = np.append(np.arange(self.terminals), np.zeros(len(self.left), np.int64)), self.terminals
            size = np.append(np.ones(self.terminals, np.int64), self.length)
            depth = np.zeros(len(starts), np.int64)
            for k, (a, b) in enumerate(zip(self.left.tolist(), self.right.tolist(), strict=True)):
                depth[self.terminals + k] = 1 + max(depth[a], depth[b])
            for d in range(1, int(depth.max(initial=0)) + 1):
                rules = np.flatnonzero(depth == d)
                parts = np.stack([self.left[rules - self.terminals], self.right[rules - self.terminals]], axis=1).reshape(-1)
                whole = np.concatenate(flat)
                flat = [whole, whole[spans(starts[parts], size[parts])]]
                starts[rules] = at + np.cumsum(size[rules]) - size[rules]
                at += int(size[rules].sum())
            self._flat, self._starts = np.concatenate(flat), starts
        return self._flat, self._starts

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        """The ids that symbols stand for."""
        flat, starts = self._tables()
        return flat[spans(starts[symbols], self.lengths(symbols))]

    def lengths(self, symbols: np.ndarray) -> np.ndarray:
        out = np.ones(len(symbols), np.int64)
        big = symbols >= self.terminals
        out[big] = self.length[symbols[big].astype(np.int64) - self.terminals]
        return out

    def part(self, symbols: np.ndarray, start: int, stop: int) -> np.ndarray:
        """ids[start:stop] of what symbols stand for; only the symbols that reach into it are expanded."""
        ends = np.cumsum(self.lengths(symbols))
        a, b = np.searchsorted(ends, start, "right"), np.searchsorted(ends, stop, "left")
        before = int(ends[a - 1]) if a else 0
        return self.expand(symbols[a : b + 1])[start - before : stop - before]


def _counted(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct codes in order, how often each occurs)."""
    codes = np.sort(codes)
    at = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]])) if len(codes) else np.zeros(0, np.int64)
    return codes[at], np.diff(np.append(at, len(codes)))


def _every_second(at: np.ndarray) -> np.ndarray:
    """Of places in order the first, third and so on of each run of neighbours."""
    if not len(at):
        return at
    first = np.concatenate([[True], np.diff(at) > 1])
    return at[(at - at[first][np.cumsum(first) - 1]) % 2 == 0]


def compress(ids: np.ndarray, breaks: np.ndarray, terminals: int = TERMINALS, least: int = LEAST_COUNT) -> tuple[np.ndarray, np.ndarray, Grammar]:
    """(symbols, breaks, grammar) of ids whose documents start at breaks[:-1]; breaks[-1] is their number.

    Rounds go on until no pair occurs ``least`` times. Every pair that a round brings forth
    holds one of its nonterminals, so a pair's count only falls after the round it came from:
    the frequent pairs are kept in a sorted table, from which replaced neighbours are taken off.
    """
    text, marks = ids.astype(np.uint32), np.array(breaks, np.int64)
    code = lambda a, b: (a.astype(np.uint64) << np.uint64(32)) | b
    left, right, length = [], [], np.ones(0, np.int64)

    def frequent(first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        narrow = terminals + len(left) <= 1 << 16  # then a pair fits 32 bits, which sort faster
        codes, n = _counted((first << np.uint32(16)) | second if narrow else code(first, second))
        codes, n = codes[n >= least], n[n >= least]
        return (code(codes >> np.uint32(16), codes & np.uint32(0xFFFF)) if narrow else codes), n

    def neighbours() -> tuple[np.ndarray, np.ndarray]:
        """Whether two ids are of one document, and whether they are alike as well."""
        joined = np.ones(max(len(text) - 1, 0), bool)
        joined[marks[1:-1] - 1] = False
        return joined, joined & (text[1:] == text[:-1])

    joined, alike = neighbours()
    other = joined & ~alike
    table, counts = frequent(text[:-1][other], text[1:][other])
    while len(text) > 1:
        doubles = _every_second(np.flatnonzero(alike))
        twice, n_twice = _counted(text[doubles])
        twice, n_twice = twice[n_twice >= least], n_twice[n_twice >= least]
        pairs = np.concatenate([table, code(twice, twice)])
        order = np.argsort(-np.concatenate([counts, n_twice]), kind="stable")
        firsts, seconds, taken = set(), set(), []
        by_count = pairs[order]
        for k, a, b in zip(order.tolist(), (by_count >> np.uint64(32)).tolist(), (by_count & np.uint64(0xFFFFFFFF)).tolist(), strict=True):
            if a not in seconds and b not in firsts and (a != b or a not in firsts and b not in seconds):  # chosen pairs never overlap
                firsts.add(a)
                seconds.add(b)
                taken.append(k)
        if not taken:
            break
        chosen = np.sort(pairs[taken])
        size = terminals + len(left)
        role = np.zeros(size, np.uint8)
        role[list(firsts)] = 1
        role[list(seconds)] += 2
        role = role[text]
        at = np.flatnonzero((role[:-1] & (role[1:] >> 1) & 1).view(bool) & joined)
        codes = code(text[at], text[at + 1])
        place = np.minimum(np.searchsorted(chosen, codes), len(chosen) - 1)
        hit = chosen[place] == codes
        at, place = at[hit], place[hit]
        if len(doubles) and alike[at].any():
            whole = ~alike
            whole[doubles] = True
            ok = whole[at]
            at, place = at[ok], place[ok]
        if len(table):
            # neighbours that are lost: those of a replaced pair to its left and to its right, each once
            edge = np.zeros(len(text) + 1, bool)
            edge[at] = edge[at + 2] = True
            edge = np.flatnonzero(edge[1:-1] & joined)
            lost, n = _counted(code(text[edge], text[edge + 1]))
            where = np.minimum(np.searchsorted(table, lost), len(table) - 1)
            same = table[where] == lost
            counts[where[same]] -= n[same]
            counts[np.isin(table, chosen, assume_unique=True)] = 0
        text[at] = (size + place).astype(np.uint32)
        keep = np.ones(len(text), bool)
        keep[at + 1] = False
        text, marks = text[keep], marks - np.searchsorted(at + 1, marks)
        a, b = (chosen >> np.uint64(32)).astype(np.int64), (chosen & np.uint64(0xFFFFFFFF)).astype(np.int64)
        sizes = np.append(np.ones(terminals, np.int64), length)
        length = np.concatenate([length, sizes[a] + sizes[b]])
        left.extend(a.tolist())
        right.extend(b.tolist())
        joined, alike = neighbours()
        new = text >= size
        born = np.flatnonzero((new[:-1] | new[1:]) & joined & ~alike)
        codes, n = frequent(text[born], text[born + 1])
        alive = counts >= least
        table, counts = np.concatenate([table[alive], codes]), np.concatenate([counts[alive], n])
        order = np.argsort(table)
        table, counts = table[order], counts[order]
    return text, marks, Grammar(np.array(left, np.int64), np.array(right, np.int64), length, terminals)


def pack(doc_ids: list, ids: np.ndarray, bounds: np.ndarray, terminals: int = TERMINALS) -> bytes:
    """A shard file of documents with ids[bounds[k]:bounds[k + 1]], each of one id at least."""
    if len(ids) and int(ids.max()) >= terminals:
        raise ValueError(f"id {int(ids.max())} is no terminal: they lie below {terminals}")
    symbols, marks, g = compress(ids, bounds, terminals)
    small = len(symbols) == 0 or int(symbols.max()) < 1 << 16
    head = np.array([g.terminals, len(g.left), len(doc_ids), len(symbols), 16 if small else 32], "<u4")
    flags = np.array([d is not None for d in doc_ids], "u1")
    parts = [MAGIC, head.tobytes(), np.stack([g.left, g.right], axis=1).astype("<u4").tobytes(), g.length.astype("<u4").tobytes(), flags.tobytes()]
    parts += [np.array([d or 0 for d in doc_ids], "<i8").tobytes(), marks.astype("<u8").tobytes(), bounds[:-1].astype("<u8").tobytes()]
    parts += [symbols.astype("<u2" if small else "<u4").tobytes()]
    return b"".join(parts)


class Shard:
    """A shard file, opened for reading."""

    def __init__(self, payload: bytes):
        if payload[:4] != MAGIC:
            raise ValueError("not a shard file")
        terminals, rules, docs, symbols, width = np.frombuffer(payload, "<u4", 5, 4).tolist()
        at = 24

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(payload, kind, n, at)
            at += out.nbytes
            return out

        pairs = take("<u4", 2 * rules).reshape(-1, 2).astype(np.int64)
        self.grammar = Grammar(pairs[:, 0], pairs[:, 1], take("<u4", rules).astype(np.int64), terminals)
        flags = take("u1", docs)
        self.doc_ids = [int(d) if f else None for d, f in zip(take("<i8", docs), flags, strict=True)]
        self.marks, self.before = take("<u8", docs + 1).astype(np.int64), take("<u8", docs).astype(np.int64)
        self.symbols = take("<u2" if width == 16 else "<u4", symbols)

    def document(self, k: int) -> np.ndarray:
        return self.grammar.expand(self.symbols[self.marks[k] : self.marks[k + 1]])

    def part(self, k: int, start: int, stop: int) -> np.ndarray:
        """ids[start:stop] of a document."""
        return self.grammar.part(self.symbols[self.marks[k] : self.marks[k + 1]], start, stop)

    def all_ids(self) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all documents, expanded together, and their bounds)."""
        ends = np.append(0, np.cumsum(self.grammar.lengths(self.symbols)))
        return self.grammar.expand(self.symbols), ends[self.marks]

    def documents(self) -> Iterator[np.ndarray]:
        ids, bounds = self.all_ids()
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            yield ids[a:b]


def write(docs: DataFrame, where: str, path: str | None = None, shard_ids: int = SHARD_IDS) -> None:
    """Shard files of docs(doc_id, text) at a path, in ascending order of doc_id."""
    path = path or vocabulary_path()

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e, held, lengths, names, first = encoder(path), [], [], [], None

        def close() -> pa.RecordBatch:
            ids, bounds = np.concatenate(held), np.concatenate([[0], np.cumsum(lengths)])
            out = pa.RecordBatch.from_arrays([pa.array([first], pa.int32()), pa.array([names[0]], pa.int64()), pa.array([count], pa.int32()), pa.array([len(names)], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([pack(names, ids, bounds)], pa.large_binary())], ["part", "first_doc", "number", "n_docs", "n_ids", "payload"])
            return out.set_column(5, "payload", out["payload"].cast(pa.binary()))

        count = 0
        for whole in batches:
            for at in range(0, whole.num_rows, 1_000):
                b = whole.slice(at, 1_000)
                ids, bounds = e.encode(b["text"], END_ID)
                first = b["part"][0].as_py()
                held.append(ids)
                lengths.extend(np.diff(bounds).tolist())
                names.extend(b["doc_id"].to_pylist())
                if sum(map(len, held)) >= shard_ids:
                    yield close()
                    held, lengths, names, count = [], [], [], count + 1
        if names:
            yield close()
        trim()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("tie")]
    parts = range_count(rows, "text", RANGE_BYTES)
    ranged = rows.withColumn("tie", F.xxhash64("text")).repartitionByRange(*parts, *order).sortWithinPartitions(*order).select("doc_id", "text")
    ranged.withColumn("part", F.spark_partition_id()).mapInArrow(shards, "part int, first_doc long, number int, n_docs long, n_ids long, payload binary").write.parquet(where)


def read(spark: SparkSession, where: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids binary) of every document in shard files: start counts the ids before it."""
    listed = spark.read.parquet(where)
    before, total = [], 0
    for r in listed.select("part", "number", "n_ids").orderBy("part", "number").collect():  # a row a shard file
        before.append((r["part"], r["number"], total))
        total += r["n_ids"]
    starts = spark.createDataFrame(before, "part int, number int, base long")

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for payload, base in zip(b["payload"], b["base"].to_pylist(), strict=True):
                s = Shard(payload.as_buffer().to_pybytes())
                ids, bounds = s.all_ids()
                ids = ids.astype("<u4", copy=False)
                for at in range(0, len(s.doc_ids), 1_000):
                    cut = bounds[at : at + 1_001]
                    n = np.diff(cut)
                    # the column's bytes are the ids themselves: no copy a document
                    raw = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(((cut - cut[0]) * 4).astype(np.int32)), pa.py_buffer(ids[cut[0] : cut[-1]])])
                    yield pa.RecordBatch.from_arrays([pa.array(s.doc_ids[at : at + 1_000], pa.int64()), pa.array(base + s.before[at : at + 1_000]), pa.array(n), raw], ["doc_id", "start", "n_tokens", "ids"])

    # a row for a shard of a million ids: this table stays small enough to send whole
    return listed.join(F.broadcast(starts), ["part", "number"]).select("base", "payload").mapInArrow(unpack, "doc_id long, start long, n_tokens long, ids binary")


def op8_repair_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place and checksum, from shard files written and read again."""
    where = Scratch(spark, "repair").path("shards")
    write(spark.read.parquet(f"{sf_dir}/documents.parquet"), where)
    return read(spark, where).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
