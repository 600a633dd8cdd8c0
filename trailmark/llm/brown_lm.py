"""Language-model scoring by Brown classes.

log10 P(text) is the sum over its tokens of log P(class | class before) + log P(token | class).
Exchange clustering assigns words to classes: starting from classes by rank, each word moves
to the class that raises the likelihood of the class bigrams most, until a sweep moves none.

The ``symbols`` most frequent words are clustered as themselves on the driver, every other word
at first through the symbol of its ending (``endings`` of them). Then every other word of the
corpus gets the class that makes its own neighbours' classes likeliest (``assign``: a count of
class neighbours of each word, dealt by word), texts become sequences of these classes, and
transitions and emissions are counted anew from them (``refit``). Only words never seen in
training stay with the class of their ending, with additive mass. The ``lookup`` most frequent
of the other words are sent to the tasks, all others are joined by hash.

``score`` is the model before ``assign``: endings stand for all words but the most frequent.

Tokens: words of the text with A-Z lowered, runs of bytes other than ASCII white space, then
one end per text. Null texts are empty. Rows that share doc_id and text get equal results each;
a null doc_id is kept; extra columns are not carried. Without training texts every probability
is the additive mass.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .columns import append, fold
from .common import Scratch, WordIndex, cut_words, run_bounds, runs, trim

SYMBOLS, ENDINGS, LOOKUP, CLASSES = 3_072, 512, 65_536, 64
ENDING_BYTES, DELTA, ALPHA = 3, 0.1, 5.0
CACHE_WORDS, FLUSH_TOKENS, FLUSH_NEIGHBOURS, ROWS = 300_000, 1 << 30, 1_000_000, 50_000
#: Ranges that the codes of bigrams are dealt to, and words of a part of the neighbours' counts.
RANGES, PART_WORDS = 512, 1_000_000


def endings_of(words: list[bytes], endings: int) -> np.ndarray:
    """The ending symbol of each word."""
    return np.fromiter((zlib.crc32(w[-ENDING_BYTES:]) % endings for w in words), np.int64, len(words))


def hashes_of(words: list[bytes]) -> np.ndarray:
    """A 64-bit hash of each word, the same in every task."""
    if not words:
        return np.zeros(0, np.int64)
    return pd.util.hash_array(np.array([w.decode("utf-8", "surrogateescape") for w in words], dtype=object), categorize=False).view(np.int64)


def count_words(texts: DataFrame, endings: int) -> DataFrame:
    """(h, word, ending, n) of all words of texts(text binary)."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[bytes, int] = {}

        def flush() -> pa.RecordBatch:
            words = list(found)
            return pa.RecordBatch.from_arrays([pa.array(hashes_of(words)), pa.array(words, pa.binary()), pa.array(endings_of(words, endings)), pa.array(list(found.values()), pa.int64())], ["h", "word", "ending", "n"])

        for whole in batches:
            for at in range(0, whole.num_rows, 1_000):
                codes, words, _ = cut_words(whole["text"].slice(at, 1_000))
                for w, n in zip(words.to_numpy(zero_copy_only=False).tolist(), np.bincount(codes, minlength=len(words)).tolist(), strict=True):
                    found[w] = found.get(w, 0) + n
                if len(found) > CACHE_WORDS:
                    yield flush()
                    found = {}
        yield flush()
        found = {}
        trim()

    parts = texts.mapInArrow(each, "h long, word binary, ending long, n long")
    return parts.groupBy("h", "word", "ending").agg(F.sum("n").alias("n"))


class Lexicon:
    """Symbols of words: 0.. the clustered words, then the end, then the endings."""

    def __init__(self, symbols: dict[bytes, int], counts: dict[bytes, int], endings: int):
        self.symbols, self.counts, self.endings = symbols, counts, endings
        self.end = len(symbols)
        self.size = len(symbols) + 1 + endings

    def open(self) -> Lexicon:
        """Makes ready the table of the words seen in a task."""
        self.known = WordIndex()
        self.symbol, self.count, self.hash = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        return self

    def read(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(numbers of the words, bounds) of texts (binary); symbol, count (-1: to be joined) and hash are by number."""
        if len(self.known) > CACHE_WORDS:
            self.open()
        codes, words, bounds = cut_words(texts)
        number, fresh = self.known.number(words)
        if len(fresh):
            fresh = fresh.to_numpy(zero_copy_only=False).tolist()
            by_ending = self.end + 1 + endings_of(fresh, self.endings)
            symbol = np.fromiter((self.symbols.get(w, -1) for w in fresh), np.int64, len(fresh))
            self.symbol = np.concatenate([self.symbol, np.where(symbol >= 0, symbol, by_ending)])
            self.count = np.concatenate([self.count, np.fromiter((self.counts.get(w, -1) for w in fresh), np.int64, len(fresh))])
            self.hash = np.concatenate([self.hash, hashes_of(fresh)])
        return number[codes], bounds

    def tokens(self, index: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(symbols with each text's end behind it, bounds of the texts among them)."""
        out = np.full(len(index) + len(bounds) - 1, self.end, np.int64)
        out[np.arange(len(index)) + np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))] = self.symbol[index]
        return out, bounds + np.arange(len(bounds))


def count_bigrams(texts: DataFrame, lexicon: Lexicon) -> DataFrame:
    """(code, n): bigrams of symbols, code = first * size + second; an end stands before each text.

    A task counts in one table of all codes and hands on a row for each range of them.
    """
    held = texts.sparkSession.sparkContext.broadcast(lexicon)
    step = -(-(lexicon.size**2) // RANGES)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex, n_tokens = held.value.open(), 0
        table = np.zeros(step * RANGES, np.int32)

        def flush() -> pa.RecordBatch:
            codes = np.flatnonzero(table)
            cuts = np.searchsorted(codes, np.arange(RANGES + 1) * step)
            places, n = (codes % step).astype(np.int32), table[codes]
            blobs = [[x[a:b].tobytes() for a, b in itertools.pairwise(cuts.tolist())] for x in (places, n)]
            table[:] = 0
            return pa.RecordBatch.from_arrays([pa.array(range(RANGES), pa.int32()), *(pa.array(x, pa.binary()) for x in blobs)], ["range", "places", "n"])

        for whole in batches:
            for at in range(0, whole.num_rows, 1_000):
                tokens, _ = lex.tokens(*lex.read(whole["text"].slice(at, 1_000)))
                if n_tokens + len(tokens) > FLUSH_TOKENS:
                    yield flush()
                    n_tokens = 0
                np.add.at(table, np.append(lex.end, tokens[:-1]) * lex.size + tokens, np.int32(1))
                n_tokens += len(tokens)
        yield flush()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict[int, np.ndarray] = {}
        for b in batches:
            for k, places, n in zip(b["range"].to_pylist(), b["places"], b["n"], strict=True):
                table = tables.setdefault(k, np.zeros(step, np.int64))
                table[np.frombuffer(places.as_buffer(), np.int32)] += np.frombuffer(n.as_buffer(), np.int32)
        for k, table in tables.items():
            places = np.flatnonzero(table)
            yield pa.RecordBatch.from_arrays([pa.array(k * step + places), pa.array(table[places])], ["code", "n"])

    return texts.mapInArrow(each, "range int, places binary, n binary").repartition("range").mapInArrow(add, "code long, n long")


def _f(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def exchange(first: np.ndarray, second: np.ndarray, n: np.ndarray, size: int, fixed: int, classes: int) -> np.ndarray:
    """Class of each of size symbols from bigram counts; the fixed symbol keeps a class of its own (the last).

    Objective: sum f(n(c, c')) - sum f(n(c, .)) - sum f(n(., c)) with f(x) = x log x, which is the
    log likelihood of the class bigrams up to a constant.
    """
    n = n.astype(np.float64)
    total = np.bincount(first, n, size) + np.bincount(second, n, size)
    order = np.argsort(-total, kind="stable")
    order = order[order != fixed]
    k = max(1, min(classes - 1, len(order)))
    of = np.zeros(size, np.int64)
    of[order] = np.arange(len(order)) % k
    of[fixed] = k
    grams = np.zeros((k + 1, k + 1))
    np.add.at(grams, (of[first], of[second]), n)
    out, into = np.zeros((size, k + 1)), np.zeros((size, k + 1))
    np.add.at(out, (first, of[second]), n)
    np.add.at(into, (second, of[first]), n)
    by_first, by_second = (np.argsort(x, kind="stable").astype(np.int32) for x in (first, second))
    at_first, at_second = np.searchsorted(first[by_first], np.arange(size + 1)), np.searchsorted(second[by_second], np.arange(size + 1))
    diagonal = np.arange(k + 1)
    least = 1e-9 + 1e-13 * float(_f(n.sum()))  # below, a gain may be rounding, and moves could go in circles
    moved = 1
    while moved:
        moved = 0
        for w in order.tolist():
            if not total[w]:
                continue
            after, before = by_first[at_first[w] : at_first[w + 1]], by_second[at_second[w] : at_second[w + 1]]
            own = float(n[after][second[after] == w].sum())
            a = int(of[w])
            o, i = out[w].copy(), into[w].copy()
            grams[a] -= o
            grams[:, a] -= i
            grams[a, a] += own
            o[a] -= own
            i[a] -= own
            rows, columns = grams.sum(axis=1) + i, grams.sum(axis=0) + o  # what leads to and from the word counts, wherever it goes
            base = _f(grams)
            wide, tall = _f(grams + o) - base, _f(grams + i[:, None]) - base
            gain = wide.sum(axis=1) - wide[diagonal, diagonal] + tall.sum(axis=0) - tall[diagonal, diagonal]
            corner = grams[diagonal, diagonal]
            gain += _f(corner + o + i + own) - _f(corner)
            gain -= _f(rows + o.sum() + own) - _f(rows) + _f(columns + i.sum() + own) - _f(columns)
            gain[k] = -np.inf
            b = int(gain.argmax())
            if gain[b] <= gain[a] + least:
                b = a
            grams[b] += o
            grams[:, b] += i
            grams[b, b] += own
            if b != a:
                moved += 1
                of[w] = b
                into[second[after], a] -= n[after]
                into[second[after], b] += n[after]
                out[first[before], a] -= n[before]
                out[first[before], b] += n[before]
    return of


class Model:
    """Class transitions and emissions in log10; emission[symbol] holds all of P(token | class)
    but the log of (count + delta) that a word of an ending symbol has of its own."""

    def __init__(self, lexicon: Lexicon, classes: np.ndarray, transition: np.ndarray, emission: np.ndarray, unigram: np.ndarray, n_end: int, n_tokens: int, n_types: int):
        self.lexicon, self.classes, self.transition, self.emission, self.unigram = lexicon, classes, transition, emission, unigram
        self.n_end, self.n_tokens, self.n_types = n_end, n_tokens, n_types


def learn(texts: DataFrame, scratch: Scratch, symbols: int = SYMBOLS, endings: int = ENDINGS, lookup: int = LOOKUP, classes: int = CLASSES) -> tuple[Model, DataFrame]:
    """A model and the table of all word counts (h, n) from texts(text binary)."""
    counts = scratch.save(count_words(texts, endings), "counts")
    n_docs = texts.count()
    facts = counts.groupBy("ending").agg(F.sum("n").alias("n"), F.count("*").alias("types")).collect()  # a row an ending
    top = counts.orderBy(F.desc("n"), "word").limit(lookup).select("word", "ending", "n").collect()
    inside = {bytes(r["word"]): k for k, r in enumerate(top[:symbols])}
    lexicon = Lexicon(inside, {bytes(r["word"]): r["n"] for r in top}, endings)
    by_ending, types = np.zeros(endings), np.zeros(endings)
    for r in facts:
        by_ending[r["ending"]], types[r["ending"]] = r["n"], r["types"]
    for r in top[:symbols]:
        by_ending[r["ending"]] -= r["n"]
        types[r["ending"]] -= 1
    # at most the square of the number of symbols
    pairs = count_bigrams(texts, lexicon).select((F.col("code") / lexicon.size).cast("int").alias("first"), (F.col("code") % lexicon.size).cast("int").alias("second"), "n").toArrow()
    first, second, n = (pairs[c].to_numpy() for c in ("first", "second", "n"))
    del pairs
    of = exchange(first, second, n, lexicon.size, lexicon.end, classes)
    k = int(of.max()) + 1
    grams = np.zeros((k, k))
    np.add.at(grams, (of[first], of[second]), n)
    alone = np.array([*(r["n"] for r in top[:symbols]), n_docs, *by_ending], np.float64)
    size = np.bincount(of, minlength=k)
    mass = np.bincount(of, alone, k)
    unigram = (mass + 1) / (mass.sum() + k)
    transition = np.log10((grams + ALPHA * unigram) / (grams.sum(axis=1, keepdims=True) + ALPHA))
    emission = np.log10((alone + DELTA) / (mass + DELTA * size)[of])
    emission[lexicon.end + 1 :] -= np.log10(by_ending + DELTA * (types + 1))
    n_words, n_types = sum(r["n"] for r in facts), sum(r["types"] for r in facts)
    return Model(lexicon, of, transition, emission, unigram, n_docs, n_words + n_docs, n_types + (n_docs > 0)), counts.groupBy("h").agg(F.sum("n").alias("n"))


def score(docs: DataFrame, model: Model, counts: DataFrame, scratch: Scratch) -> DataFrame:
    """docs(doc_id, text binary) -> (doc_id, n_tokens, n_known, base_score, score)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    held = docs.sparkSession.sparkContext.broadcast(model)  # bounded by symbols and lookup
    normal = float(np.log10(model.n_tokens + DELTA * (model.n_types + 1)))
    keyed = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("row"), "text")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        lex = m.lexicon.open()
        for whole in batches:
            for at in range(0, whole.num_rows, 1_000):
                b = whole.slice(at, 1_000)
                index, bounds = lex.read(b["text"])
                tokens, ends = lex.tokens(index, bounds)
                n_docs, n_tokens = len(bounds) - 1, np.diff(ends)
                before = np.append(lex.end, tokens[:-1])
                logs = m.transition[m.classes[before], m.classes[tokens]] + m.emission[tokens]
                total = np.add.reduceat(logs, ends[:-1]) if n_docs else logs
                owner = np.repeat(np.arange(n_docs), np.diff(bounds))
                count = lex.count[index]
                near = count >= 0
                base = np.bincount(owner[near], np.log10(count[near] + DELTA) - normal, n_docs) + np.log10(m.n_end + DELTA) - normal
                through = near & (lex.symbol[index] > lex.end)
                total = total + np.bincount(owner[through], np.log10(count[through] + DELTA), n_docs)
                known = np.bincount(owner[near & (count > 0)], minlength=n_docs) + (m.n_end > 0)
                far = np.flatnonzero(~near)
                tail, times = np.unique(np.stack([owner[far], index[far]]), axis=1, return_counts=True) if len(far) else (np.zeros((2, 0), np.int64), np.zeros(0, np.int64))
                offsets = np.searchsorted(tail[0], np.arange(n_docs + 1)).astype(np.int32)
                pairs = pa.StructArray.from_arrays([pa.array(lex.hash[tail[1]]), pa.array(times.astype(np.int32))], ["h", "m"])
                yield pa.RecordBatch.from_arrays([b["doc_id"], b["row"], pa.array(n_tokens.astype(np.int64)), pa.array(known.astype(np.int64)), pa.array(base), pa.array(total), pa.ListArray.from_arrays(pa.array(offsets), pairs)], ["doc_id", "row", "n_tokens", "known", "base", "total", "tail"])

    parts = keyed.mapInArrow(each, f"doc_id {kind}, row long, n_tokens long, known long, base double, total double, tail array<struct<h: long, m: int>>")
    parts = scratch.save(parts, "parts")
    rare = parts.select("doc_id", "row", F.inline("tail")).join(counts, "h", "left")
    own = F.coalesce("n", F.lit(0))
    log = F.col("m") * F.log10(own + DELTA)
    rare = rare.groupBy("doc_id", "row").agg(F.sum(log).alias("s"), F.sum(log - F.col("m") * normal).alias("b"), F.sum(F.when(own > 0, F.col("m")).otherwise(0)).alias("k"))
    # equal rows have met in one group: each copy gets its share
    copies = parts.groupBy("doc_id", "row").agg(F.count("*").alias("copies"), F.first("n_tokens").alias("n_tokens"), F.first("known").alias("known"), F.first("base").alias("base"), F.first("total").alias("total"))
    both = copies.join(rare, copies["doc_id"].eqNullSafe(rare["doc_id"]) & (copies["row"] == rare["row"]), "left").select(copies["doc_id"], "copies", "n_tokens", "known", "base", "total", F.coalesce(F.col("b") / F.col("copies"), F.lit(0.0)).alias("b"), F.coalesce(F.col("s") / F.col("copies"), F.lit(0.0)).alias("s"), F.coalesce(F.col("k") / F.col("copies"), F.lit(0)).cast("long").alias("k"))
    out = both.select("doc_id", "n_tokens", (F.col("known") + F.col("k")).alias("n_known"), (F.col("base") + F.col("b")).alias("base_score"), (F.col("total") + F.col("s")).alias("score"), F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))
    return out.drop("copy")


def assign(texts: DataFrame, model: Model, counts: DataFrame, scratch: Scratch) -> DataFrame:
    """(h, n, class) of every word of texts that isn't clustered as itself."""
    held = texts.sparkSession.sparkContext.broadcast(model)
    k = len(model.transition)

    def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        lex, found, size = m.lexicon.open(), [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            key, n = np.unique(np.concatenate(found), return_counts=True)
            pairs = np.stack([key % k**2, n], axis=1).astype(np.int32)
            starts = run_bounds(key // k**2)
            words = key[starts[:-1]] // k**2
            for x in range(0, len(words), ROWS):
                cuts = starts[x : x + ROWS + 1]
                blobs = [None, pa.py_buffer(((cuts - cuts[0]) * 8).astype(np.int32)), pa.py_buffer(pairs[cuts[0] : cuts[-1]])]
                yield pa.RecordBatch.from_arrays([pa.array(lex.hash[words[x : x + ROWS]]), pa.Array.from_buffers(pa.binary(), len(cuts) - 1, blobs)], ["h", "found"])

        for whole in batches:
            for at in range(0, whole.num_rows, 1_000):
                if found and (len(lex.known) > CACHE_WORDS or size > FLUSH_NEIGHBOURS):
                    yield from flush()
                    found, size = [], 0
                index, bounds = lex.read(whole["text"].slice(at, 1_000))
                tokens, _ = lex.tokens(index, bounds)
                of = m.classes[tokens]
                place = np.arange(len(index)) + np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
                other = lex.symbol[index] > lex.end
                place = place[other]
                found.append((index[other] * k + np.append(m.classes[lex.end], of[:-1])[place]) * k + of[place + 1])
                size += len(place)
        if size:
            yield from flush()

    log = model.transition
    of_before, of_after = log - np.log10(model.unigram), log.T.copy()  # (neighbour, class): P(class | before) / P(class), P(after | class)
    of_before[:, model.classes[model.lexicon.end]] = -np.inf  # the end's class is its own

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches, ["h"]):
            h, blobs = table["h"].to_numpy(), table["found"].combine_chunks().cast(pa.large_binary())
            cuts = np.frombuffer(blobs.buffers()[1], np.int64)[blobs.offset : blobs.offset + len(h) + 1] // 8
            pairs = np.frombuffer(blobs.buffers()[2], np.int32, cuts[-1] * 2).reshape(-1, 2)[cuts[0] :]
            starts = run_bounds(h)
            owner = np.repeat(np.arange(len(starts) - 1), np.diff(cuts[starts]))
            n, sums = np.bincount(owner, pairs[:, 1]).astype(np.int64), np.zeros((len(starts) - 1, k))
            for at in range(0, len(pairs), ROWS):
                (code, times), of = pairs[at : at + ROWS].T, owner[at : at + ROWS]
                part = run_bounds(of)[:-1]
                sums[of[part]] += np.add.reduceat((of_before[code // k] + of_after[code % k]) * times[:, None], part)
            yield pa.RecordBatch.from_arrays([pa.array(h[starts[:-1]]), pa.array(n), pa.array(np.round(sums, 6).argmax(axis=1).astype(np.int32))], ["h", "n", "class"])

    parts = -(-counts.count() // PART_WORDS)
    parts = [parts] if parts > int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")) else []
    found = texts.mapInArrow(neighbours, "h long, found binary").repartition(*parts, "h").sortWithinPartitions("h")
    # every word that isn't clustered as itself has its count in its neighbours
    table = scratch.save(found.mapInArrow(best, "h long, n long, class int"), "classes")
    held.destroy()
    return table


def sequences(docs: DataFrame, model: Model, table: DataFrame, scratch: Scratch, lookup: int = LOOKUP) -> DataFrame:
    """docs(doc_id, text binary, ...) -> their other columns, n_tokens, n_known, base_score, own
    (the sum of the tokens' log10 of count + delta) and classes (16 bits a token)."""
    near = table.orderBy(F.desc("n"), "h").limit(lookup).toArrow().sort_by("h")
    held = docs.sparkSession.sparkContext.broadcast((model, *(near[c].to_numpy() for c in ("h", "n", "class"))))
    k, normal = len(model.transition), float(np.log10(model.n_tokens + DELTA * (model.n_types + 1)))
    others = [f for f in docs.schema.fields if f.name != "text"]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in others)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, near_h, near_n, near_class = held.value
        lex, core = m.lexicon.open(), np.array([*(m.lexicon.counts[w] for w in m.lexicon.symbols), m.n_end], np.int64)
        seen, klass, count = lex.known, np.zeros(0, np.int64), np.zeros(0, np.int64)  # by word: class, and count (-1: to be joined)
        for whole in batches:
            for at in range(0, whole.num_rows, 1_000):
                b = whole.slice(at, 1_000)
                index, bounds = lex.read(b["text"])
                n_docs = len(bounds) - 1
                if seen is not lex.known:  # the words seen were given up
                    klass, count, seen = klass[:0], count[:0], lex.known
                if len(klass) < len(lex.hash):
                    symbol, h = lex.symbol[len(klass) :], lex.hash[len(klass) :]
                    c, x = m.classes[symbol], np.where(symbol <= lex.end, core[np.minimum(symbol, lex.end)], -1)
                    if len(near_h):
                        where = np.minimum(np.searchsorted(near_h, h), len(near_h) - 1)
                        hit = (near_h[where] == h) & (x < 0)
                        c, x = np.where(hit, near_class[where], c), np.where(hit, near_n[where], x)
                    klass, count = np.concatenate([klass, c]), np.concatenate([count, x])
                owner = np.repeat(np.arange(n_docs), np.diff(bounds))
                is_far = count[index] < 0
                far = np.flatnonzero(is_far)
                own = np.bincount(owner[~is_far], np.log10(count[index[~is_far]] + DELTA), n_docs) + np.log10(m.n_end + DELTA)
                known = np.bincount(owner[~is_far], minlength=n_docs) + (m.n_end > 0)
                pairs, inverse = np.unique(owner[far] * len(lex.hash) + index[far], return_inverse=True)
                tail = pairs // max(len(lex.hash), 1), pairs % max(len(lex.hash), 1)
                offsets = np.searchsorted(tail[0], np.arange(n_docs + 1)).astype(np.int32)
                # a class, or -1 - the place in the text's list of words to be joined
                codes = np.full(len(index) + n_docs, m.classes[lex.end], np.int32)
                of = klass[index]
                of[far] = -1 - (inverse - offsets[owner[far]])
                codes[np.arange(len(index)) + owner] = of
                ends = bounds + np.arange(n_docs + 1)
                words = pa.StructArray.from_arrays([pa.array(lex.hash[tail[1]]), pa.array(klass[tail[1]].astype(np.int32))], ["h", "e"])
                yield pa.RecordBatch.from_arrays(
                    [*(b[f.name] for f in others), pa.array(known.astype(np.int64)), pa.array(own), pa.array([codes[x:y].tobytes() for x, y in zip(ends[:-1], ends[1:], strict=True)], pa.binary()), pa.ListArray.from_arrays(pa.array(offsets), words)],
                    [*(f.name for f in others), "known", "own", "codes", "tail"],
                )

    parts = docs.mapInArrow(read, f"{kinds}, known long, own double, codes binary, tail array<struct<h: long, e: int>>")
    parts = scratch.save(parts.withColumn("uid", F.monotonically_increasing_id()), "codes")  # written: a row keeps its number
    held.destroy()
    far = parts.select("uid", F.posexplode("tail").alias("place", "t")).select("uid", "place", F.col("t.h").alias("h"), F.col("t.e").alias("e"))
    far = far.join(table, "h", "left").select("uid", F.struct("place", F.coalesce("class", "e").alias("class"), F.coalesce("n", F.lit(0)).alias("n")).alias("x"))
    both = parts.drop("tail").join(far.groupBy("uid").agg(F.collect_list("x").alias("tail")), "uid", "left")

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1_000):
                b = whole.slice(at, 1_000)
                codes = [np.frombuffer(x.as_buffer(), np.int32) for x in b["codes"]]
                known, own, lengths, out = b["known"].to_numpy().copy(), b["own"].to_numpy().copy(), [], []
                flat = b["tail"].flatten()
                place, klass, n = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(3))
                ends = np.append(0, np.cumsum(b["tail"].value_lengths().fill_null(0).to_numpy()))
                for j, c in enumerate(codes):
                    part = slice(ends[j], ends[j + 1])
                    missing = c < 0
                    if missing.any():
                        order = np.argsort(place[part])
                        at_place = -1 - c[missing]
                        c = c.copy()
                        c[missing] = klass[part][order][at_place]
                        count = n[part][order][at_place]
                        own[j] += np.log10(count + DELTA).sum()
                        known[j] += (count > 0).sum()
                    lengths.append(len(c))
                    out.append(c.astype(np.int16).tobytes())
                size = np.array(lengths, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [*(b[f.name] for f in others), pa.array(size), pa.array(known), pa.array(own - size * normal), pa.array(own), pa.array(out, pa.binary())],
                    [*(f.name for f in others), "n_tokens", "n_known", "base_score", "own", "classes"],
                )

    names = [*(f"`{f.name}`" for f in others), "known", "own", "codes", "tail"]
    filled = both.select(*names).mapInArrow(fill, f"{kinds}, n_tokens long, n_known long, base_score double, own double, classes binary")
    return scratch.save(filled, "sequences")


def refit(model: Model, table: DataFrame, trained: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(log10 P(class | class before), log10 of each class's mass) from the words' final classes and
    the training texts' sequences; P(token | class) is (count + delta) / mass."""
    k, end = len(model.transition), model.classes[model.lexicon.end]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = np.zeros(k * k, np.int64)
        for b in batches:
            if b.num_rows:
                c = np.frombuffer(b"".join(x.as_py() for x in b["classes"]), np.int16).astype(np.int64)
                grams += np.bincount(np.append(end, c[:-1]) * k + c, minlength=k * k)
        code = np.flatnonzero(grams)
        yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(grams[code])], ["code", "n"])

    grams = np.zeros(k * k)
    for r in trained.select("classes").mapInArrow(each, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).collect():  # the classes' square
        grams[r["code"]] = r["n"]
    grams = grams.reshape(k, k)
    lex = model.lexicon
    mass = np.bincount(model.classes[: lex.end + 1], [*(lex.counts[w] for w in lex.symbols), model.n_end], k)
    size = np.bincount(model.classes, minlength=k).astype(float)  # an ending's symbol is a word never seen
    for r in table.groupBy("class").agg(F.sum("n").alias("n"), F.count("*").alias("types")).collect():  # a row a class
        mass[r["class"]] += r["n"]
        size[r["class"]] += r["types"]
    unigram = (mass + 1) / (mass.sum() + k)
    return np.log10((grams + ALPHA * unigram) / (grams.sum(axis=1, keepdims=True) + ALPHA)), np.log10(mass + DELTA * size)


def score_sequences(rows: DataFrame, model: Model, transition: np.ndarray, mass: np.ndarray) -> DataFrame:
    """rows of sequences() with their score in place of own and classes."""
    end = model.classes[model.lexicon.end]
    step = transition - mass  # (before, class)

    def each(b: pa.RecordBatch) -> list:
        out = b["own"].to_numpy().copy()
        for j, x in enumerate(b["classes"]):
            c = np.frombuffer(x.as_buffer(), np.int16)
            out[j] += step[np.append(end, c[:-1]), c].sum()
        return [out]

    return append(rows, each, [("score", T.DoubleType())]).drop("own", "classes")


def op7_brown_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by a model of the folds 1 to 9 of 10."""
    scratch = Scratch(spark, "brown")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", (fold("doc_id", 10) == 0).alias("held_out"), F.col("text").cast("binary").alias("text"))
    train = docs.where("not held_out").select("text")
    model, counts = learn(train, scratch)
    table = assign(train, model, counts, scratch)
    rows = sequences(docs, model, table, scratch)
    scored = score_sequences(rows, model, *refit(model, table, rows.where("not held_out")))
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.n_tokens).cast("long").alias("train_tokens"), "base_score", "score")
