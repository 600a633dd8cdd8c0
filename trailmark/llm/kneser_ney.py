"""Quality by the perplexity under an interpolated modified Kneser-Ney model of trusted text.

Learning: the trigrams of all trusted documents are counted, dealt to shards by the word before the
predicted one, so that all that one token needs lies in one shard: its trigram, the bigram, both
contexts. A word that is more than a shard is dealt on by the word before it, and its bigrams (no
more than the vocabulary) are summed over its shards. Counts of lower orders are numbers of different
predecessors; three discounts an order come from the counts of counts. A shard has about
``SHARD_ENTRIES`` tokens; there are as many shards as the trusted texts take.

Scoring: the texts' tokens are dealt like the trigrams and meet their shard's counts, which tell
each n-gram's interpolated probability and each context's back-off weight; the sums go back to the
texts. Nothing but what shards share (unigrams, discounts, the most frequent words' bigrams) is sent
to all tasks.

Words outside the vocabulary are one word to the n-grams, times a spelling probability by
single characters. A language's threshold is a high quantile of its trusted documents' perplexities,
each under the counts of the half of them that it isn't in; languages with few of those use all
languages'. Other documents are scored by the counts of all trusted ones.

Words: runs between ASCII white space without full stops, commas, colons, semicolons at their
end; lower-cased unless a letter behind the first is a capital. Every text ends with an end
token. Defined results: a text without words has the perplexity of its end token and isn't
kept; a null language is a language of its own; without trusted texts all texts with words are
kept; rows are never dropped here; repeated rows each get their result.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import Scratch, WordIndex, cut_words, held, run_bounds, trim

VOCABULARY, LEAST_COUNT = 60_000, 2
QUANTILE, FEW, SLACK = 0.995, 30, 0.05
SHARD_ENTRIES, CACHE_WORDS = 4_000_000, 250_000
#: Tokens that a task deals at once; the share of the tokens from which a word has several shards.
GROUP_TOKENS, MOST_SPLIT = 2_000_000, 128
#: Word numbers: unknown, end, and begin (which only stands before); vocabulary follows.
UNKNOWN, END, BEGIN, FIRST = 0, 1, 2, 3
_BITS = 20
_MASK = (1 << _BITS) - 1


def form(word: bytes) -> bytes:
    """What a run of characters counts as."""
    word = word.rstrip(b".,:;") or word
    text = word.decode("utf-8", "replace")
    return text.lower().encode() if text[1:] == text[1:].lower() else word


class Reader:
    """Texts as word numbers, and the spelling of words outside the vocabulary."""

    def __init__(self, vocabulary: dict[bytes, int], letters: dict[str, float], strange: float):
        self.vocabulary, self.letters, self.strange = vocabulary, letters, strange
        self._clear()

    def _clear(self) -> None:
        self.known, self.number, self.spelled = WordIndex(), np.zeros(0, np.int64), np.zeros(0)

    def read(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(numbers with each text's end, spelling logs, bounds) of texts (binary)."""
        if len(self.known) > CACHE_WORDS:
            self._clear()
        codes, words, cuts = cut_words(texts, lower=False)
        index, fresh = self.known.number(words)
        if len(fresh):
            forms = [form(w) for w in fresh.to_numpy(zero_copy_only=False)]
            number = np.fromiter((self.vocabulary.get(w, UNKNOWN) for w in forms), np.int64, len(forms))
            letter, strange = self.letters.get, self.strange
            spelled = np.fromiter((0.0 if n else sum(letter(c, strange) for c in w.decode("utf-8", "replace")) + letter("", strange) for w, n in zip(forms, number.tolist(), strict=True)), np.float64, len(forms))
            self.number, self.spelled = np.concatenate([self.number, number]), np.concatenate([self.spelled, spelled])
        at, bounds = index[codes], cuts + np.arange(len(texts) + 1)
        place = np.arange(len(at)) + np.repeat(np.arange(len(texts)), np.diff(cuts))
        numbers, spelled = np.full(int(bounds[-1]), END, np.int64), np.zeros(int(bounds[-1]))
        numbers[place], spelled[place] = self.number[at], self.spelled[at]
        return numbers, spelled, bounds


def histories(numbers: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The word before each token and the one before that; begins stand before each text."""
    one, two = np.append(BEGIN, numbers[:-1]), np.append([BEGIN, BEGIN], numbers[:-2])[: len(numbers)]
    starts = bounds[:-1][np.diff(bounds) > 0]
    one[starts] = BEGIN
    two[starts] = BEGIN
    second = starts + 1
    two[second[second < len(numbers)]] = BEGIN
    return two, one


def _pack(*columns: np.ndarray, kind: str = "<u4") -> bytes:
    """Whole numbers of equally long columns, compressed byte by byte of equal weight."""
    width = np.dtype(kind).itemsize
    planes = [np.ascontiguousarray(c.astype(kind).view(np.uint8).reshape(-1, width).T) for c in columns]
    return pa.compress(b"".join(p.tobytes() for p in planes), codec="zstd", asbytes=True)


def _unpack(blob: bytes, n: int, columns: int, kind: str = "<u4") -> list[np.ndarray]:
    width = np.dtype(kind).itemsize
    raw = np.frombuffer(pa.decompress(blob, n * columns * width, codec="zstd"), np.uint8).reshape(columns, width, n)
    return [np.ascontiguousarray(raw[k].T).view(kind).ravel().astype(np.int64) for k in range(columns)]


def _code(u: np.ndarray, v: np.ndarray, w: np.ndarray) -> np.ndarray:
    """A trigram as one number; the word before the predicted one leads."""
    return (v << 2 * _BITS) | (u << _BITS) | w


def _shard_of(u: np.ndarray, v: np.ndarray, n: int, split: np.ndarray) -> np.ndarray:
    """The shard of tokens with these histories: that of v, but a very frequent v has several, by u."""
    return (v + u % split[v]) % n


def _first(*columns: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return run_bounds(*columns)[:-1]


def _bigrams(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(vw, number of different words before) of distinct trigrams."""
    return np.unique(((keys >> 2 * _BITS) << _BITS) | (keys & _MASK), return_counts=True)


def _discounts(n: dict[int, int]) -> list[float]:
    """D1, D2, D3+ from the counts of counts (Chen and Goodman's estimates, kept within 0..k)."""
    n1, n2, n3, n4 = (n.get(k, 0) for k in (1, 2, 3, 4))
    y = n1 / (n1 + 2 * n2) if n1 + 2 * n2 else 0.5
    raw = [1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    return [min(max(d, 0.1), k + 0.9) for k, d in enumerate(raw)]


class Rates:
    """What all shards of a model share: discounts, unigram probabilities, bigrams of the words that have several shards."""

    def __init__(self, stats: pa.Table, size: int):
        kind, key, n = (stats[c].to_numpy() for c in ("kind", "key", "n"))
        self.wide = key[kind == 0], n[kind == 0]
        of = lambda k: dict(zip(key[kind == k].tolist(), n[kind == k].tolist(), strict=True))
        two, unigram = Counter(of(2)), np.zeros(size)
        two.update(np.minimum(self.wide[1], 5).tolist())
        unigram[key[kind == 1]] = n[kind == 1]
        np.add.at(unigram, self.wide[0] & _MASK, 1)
        total = unigram.sum()
        small = 0.75 * np.minimum(unigram, 1)
        unigram = (unigram - small) / total + small.sum() / total / (size - 1) if total else np.full(size, 1 / (size - 1))
        unigram[BEGIN] = 0  # is never predicted
        self.discounts, self.unigram = (_discounts(two), _discounts(of(3))), unigram


class Model:
    """Numbers, what shards share for each set of texts, and the trigrams' counts by shard.

    sets: all texts, then those of either half. A shard (a function without parameters) tells its part of the first set's model.
    """

    def __init__(self, vocabulary, letters, strange, n_shards, split, counted, rates):
        self.vocabulary, self.letters, self.strange = vocabulary, letters, strange
        self.n_shards, self.split, self.counted, self.rates = n_shards, split, counted, rates
        self.unigram = np.log(np.maximum(rates[0].unigram, 1e-300))
        self.shards = [partial(self._fetch, s) for s in range(n_shards)]

    def _fetch(self, s: int) -> tuple:
        row = self.counted.where(F.col("s") == s).first()
        keys, counts = _counted(row["blob"], row["n"]) if row else (np.zeros(0, np.int64), np.zeros((2, 0), np.int64))
        return keys, counts.sum(axis=0), self.rates[0], self.split


def _counted(blob: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(trigrams, counts in either half) of a shard's row."""
    steps, *counts = _unpack(blob, n, 3, "<i8")
    return np.cumsum(steps), np.stack(counts)


def _groups(batches: Iterator[pa.RecordBatch], reader: Reader) -> Iterator[tuple]:
    """(rows, numbers, spelling logs, bounds) of consecutive rows with about GROUP_TOKENS tokens together."""
    held_, size = [], 0
    for whole in batches:
        for at in range(0, whole.num_rows, 1_000):
            b = whole.slice(at, 1_000)
            held_.append((b, *reader.read(b["text"])))
            size += len(held_[-1][1])
            if size >= GROUP_TOKENS:
                yield _joined(held_)
                held_, size = [], 0
    if held_:
        yield _joined(held_)


def _joined(parts: list[tuple]) -> tuple:
    ends = np.cumsum([0, *(p[3][-1] for p in parts)])
    bounds = np.concatenate([p[3][:-1] + e for p, e in zip(parts, ends, strict=False)] + [ends[-1:]])
    return [p[0] for p in parts], np.concatenate([p[1] for p in parts]), np.concatenate([p[2] for p in parts]), bounds


def _dealt(numbers: np.ndarray, bounds: np.ndarray, n_shards: int, split: np.ndarray) -> Iterator[tuple[int, bytes, int]]:
    """(shard, tokens with histories and the places of their texts, number) of a group's tokens; sorted by v, then text."""
    u, v = histories(numbers, bounds)
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    s = _shard_of(u, v, n_shards, split)
    order = np.lexsort((v, s))
    s, u, v, w, text = s[order], u[order], v[order], numbers[order], text[order]
    ends = run_bounds(s)
    for a, b in zip(ends, ends[1:], strict=False):
        begins = np.zeros(b - a, bool)
        begins[_first(v[a:b])] = True
        step = np.where(begins, text[a:b], np.diff(text[a:b], prepend=0))
        yield int(s[a]), _pack(np.diff(v[a:b], prepend=0), step, u[a:b], w[a:b]), int(b - a)


def _tokens(blob: bytes, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(u, v, w, place of the text) of _dealt()'s tokens."""
    step, text, u, w = _unpack(blob, n, 4)
    v = np.cumsum(step)
    total, first = np.cumsum(text), _first(v)
    return u, v, w, total - np.repeat(total[first] - text[first], np.diff(np.append(first, n)))


def learn(texts: DataFrame, scratch: Scratch, vocabulary: int = VOCABULARY, least: int = LEAST_COUNT, shard_entries: int = SHARD_ENTRIES) -> Model | None:
    """A model of texts(text binary[, half int: 1 or 2]); None without words."""
    halves = "half" in texts.columns
    texts = texts if halves else texts.withColumn("half", F.lit(1))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for whole in batches:
            for at in range(0, whole.num_rows, 1_000):
                codes, words, _ = cut_words(whole["text"].slice(at, 1_000), lower=False)
                n = np.bincount(codes, minlength=len(words)).tolist()
                for w, k in zip(words.to_pylist(), n, strict=True):
                    found[w] += k
        formed: Counter = Counter()
        for w, k in found.items():
            formed[form(w)] += k
        yield pa.RecordBatch.from_arrays([pa.array(list(formed), pa.binary()), pa.array(list(formed.values()), pa.int64())], ["word", "n"])

    words = scratch.save(texts.mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")), "words")
    top = words.where(F.col("n") >= least).orderBy(F.desc("n"), "word").limit(vocabulary).collect()
    if not top:
        return None
    assert FIRST + len(top) <= 1 << _BITS
    numbers = {bytes(r["word"]): FIRST + k for k, r in enumerate(top)}
    spelled = words.select(F.explode(F.split(F.decode("word", "UTF-8"), "")).alias("c")).groupBy("c").agg(F.count("*").alias("n")).collect()
    letters = {r["c"]: r["n"] for r in spelled if r["c"]}
    sums = words.agg(F.count("*").alias("n"), F.sum("n").alias("tokens")).first()
    letters[""], total = sums["n"], sums["tokens"]
    mass = sum(letters.values()) + len(letters) + 1
    logs, strange = {c: float(np.log((n + 1) / mass)) for c, n in letters.items()}, float(np.log(1 / mass))
    size, n_shards = FIRST + len(top), max(1, -(-total // shard_entries))
    seen = np.zeros(size, np.int64)
    seen[FIRST:] = [r["n"] for r in top]
    seen[UNKNOWN] = total - seen.sum()
    split = np.clip(-(-seen // max(shard_entries, total // MOST_SPLIT)), 1, n_shards)
    sent = texts.sparkSession.sparkContext.broadcast(numbers)

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, w, _, bounds in _groups(batches, Reader(sent.value, {}, 0.0)):
            half = np.concatenate([b["half"].to_numpy() for b in rows])
            # a text's place is its half from here on
            out = []
            for h in (1, 2):
                mine = np.repeat(half == h, np.diff(bounds))
                if mine.any():
                    out += [(s, h, blob, n) for s, blob, n in _dealt(w[mine], np.append(0, np.cumsum(np.diff(bounds)[half == h])), n_shards, split)]
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate((pa.int32(), pa.int32(), pa.binary(), pa.int64()))], ["s", "half", "blob", "n"])
        trim()

    def merged(rows: pa.Table) -> pa.Table:
        codes, halves_ = [], []
        for h, blob, n in zip(rows["half"].to_pylist(), rows["blob"].to_pylist(), rows["n"].to_pylist(), strict=True):
            u, v, w, _ = _tokens(blob, n)
            codes.append(_code(u, v, w))
            halves_.append(np.full(n, h == 2))
        keys, place = np.unique(np.concatenate(codes), return_inverse=True)
        both = np.bincount(place * 2 + np.concatenate(halves_), minlength=2 * len(keys)).reshape(-1, 2)
        blob = _pack(np.diff(keys, prepend=0), both[:, 0], both[:, 1], kind="<i8")
        return pa.table({"s": rows["s"][:1], "blob": pa.array([blob], pa.binary()), "n": pa.array([len(keys)], pa.int64())})

    counted = texts.select("text", "half").mapInArrow(grams, "s int, half int, blob binary, n long").groupBy("s").applyInArrow(merged, "s int, blob binary, n long")
    counted = scratch.save(counted, "counted")

    def stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for blob, n in zip(b["blob"].to_pylist(), b["n"].to_pylist(), strict=True):
                keys, counts = _counted(blob, n)
                for k, c in enumerate((counts.sum(axis=0), *counts) if halves else (counts[0],)):
                    vw, two = _bigrams(keys[c > 0])
                    wide = split[vw >> _BITS] > 1
                    parts = [(3, np.minimum(c[c > 0], 5), None), (2, np.minimum(two[~wide], 5), None), (1, vw[~wide] & _MASK, None), (0, vw[wide], two[wide])]
                    for kind, key, n_ in parts:
                        key, n_ = np.unique(key, return_counts=True) if n_ is None else (key, n_)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), k, np.int32)), pa.array(np.full(len(key), kind, np.int32)), pa.array(key.astype(np.int64)), pa.array(n_.astype(np.int64))], ["of", "kind", "key", "n"])
        trim()

    # rows a word of the vocabulary, and bigrams of at most MOST_SPLIT words
    found = counted.mapInArrow(stats, "of int, kind int, key long, n long").groupBy("of", "kind", "key").agg(F.sum("n").alias("n")).toArrow()
    of = found["of"].to_numpy()
    rates = [Rates(found.filter(pa.array(of == k)), size) for k in range(3 if halves else 1)]
    return Model(numbers, logs, strange, n_shards, split, counted, rates)


class _Shard:
    """Sorted keys and log values of a shard's four tables."""

    def __init__(self, part):
        keys, c, rates, split = part() if callable(part) else part
        keys, c = keys[c > 0], c[c > 0]
        cut = lambda n, d: np.array([0, *d])[np.minimum(n, 3)]
        two_d, three_d = rates.discounts
        vw, n = _bigrams(keys)
        own = split[vw >> _BITS] == 1
        vw, n = np.concatenate([vw[own], rates.wide[0]]), np.concatenate([n[own], rates.wide[1]])
        order = np.argsort(vw, kind="stable")
        vw, n = vw[order], n[order]
        v, weight, p = self._level(vw >> _BITS, n, cut(n, two_d), rates.unigram[vw & _MASK])
        low = p[np.minimum(np.searchsorted(vw, ((keys >> 2 * _BITS) << _BITS) | (keys & _MASK)), max(len(vw) - 1, 0))] if len(vw) else p
        vu, left, top = self._level(keys >> _BITS, c, cut(c, three_d), low)
        self.tables = [(k, np.log(x).astype(np.float32)) for k, x in ((v, weight), (vu, left), (vw, p), (keys, top))]

    @staticmethod
    def _level(context: np.ndarray, n: np.ndarray, cut: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(contexts, their back-off weights, interpolated probabilities) of n-grams sorted by context."""
        ends = run_bounds(context) if len(context) else np.zeros(1, np.int64)
        if len(ends) < 2:
            return context, np.zeros(0), np.zeros(0)
        total, left = np.add.reduceat(n, ends[:-1]), np.add.reduceat(cut, ends[:-1])
        wide = np.diff(ends)
        return context[ends[:-1]], left / total, (n - cut) / np.repeat(total, wide) + np.repeat(left / total, wide) * lower

    def find(self, kind: int, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        have, values = self.tables[kind]
        if not len(have):
            return np.zeros(len(keys), bool), np.zeros(len(keys), np.float32)
        at = np.minimum(np.searchsorted(have, keys), len(have) - 1)
        return have[at] == keys, values[at]

    def logs(self, u: np.ndarray, v: np.ndarray, w: np.ndarray, unigram: np.ndarray) -> np.ndarray:
        """log P(w | u, v): the longest n-gram seen, with the back-off weights of longer contexts seen."""
        vw, vu = (v << _BITS) | w, (v << _BITS) | u
        out = np.empty(len(w))
        hit, value = self.find(3, _code(u, v, w))
        out[hit] = value[hit]
        rest = np.flatnonzero(~hit)
        seen, weight = self.find(1, vu[rest])
        out[rest] = np.where(seen, weight, 0)
        hit, value = self.find(2, vw[rest])
        out[rest[hit]] += value[hit]
        rest = rest[~hit]
        seen, weight = self.find(0, v[rest])
        out[rest] += np.where(seen, weight, 0) + unigram[w[rest]]
        return out


def _scored(docs: DataFrame, model: Model, out: str = "nats", tokens: str = "n_tokens", half: str | None = None) -> DataFrame:
    """docs(text binary, ...) without the text, with - log P(text), the number of tokens, and _group and _at, by which rows keep their order.

    half: a column; rows of half 1 or 2 are scored by the model of the other half, all others by that of all texts. A group's
    tokens are dealt to the shards (cell: a shard, and a share of the groups where there are few shards), which meet the
    shards' counts there; the sums go back to the group's rows.
    """
    spark = docs.sparkSession
    base = spark.sparkContext.broadcast((model.vocabulary, model.letters, model.strange))
    shared = spark.sparkContext.broadcast((model.rates, [np.log(np.maximum(r.unigram, 1e-300)) for r in model.rates]))
    n_shards, split, mark = model.n_shards, model.split, uuid.uuid4().hex
    copies = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // (4 * n_shards))
    kept = docs.drop("text", out, tokens)
    extra = T.StructType.fromDDL("_cell int, _kind int, _group long, _at long, _n long, _blob binary, _which binary").fields
    fields = [*(T.StructField(f.name, f.dataType) for f in kept.schema.fields), T.StructField(tokens, T.LongType()), T.StructField(out, T.DoubleType()), *extra]
    schema = to_arrow_schema(T.StructType(fields))
    names = kept.columns

    def made(columns: dict, n: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) if isinstance(columns.get(f.name), pa.Array) else pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, first = held(mark, lambda: Reader(*base.value)), TaskContext.get().partitionId() << 33
        for g, (rows, w, spelled, bounds) in enumerate(_groups(batches, reader), first):
            sums, at = -np.add.reduceat(spelled, bounds[:-1]), 0
            which = np.concatenate([b[half].fill_null(0).to_numpy() for b in rows]).astype(np.uint8) if half else np.zeros(len(sums), np.uint8)
            for b in rows:
                here = slice(at, at + b.num_rows)
                yield made({c: b[c] for c in names} | {tokens: np.diff(bounds)[here], out: sums[here], "_cell": np.full(b.num_rows, g % (n_shards * copies)), "_kind": np.full(b.num_rows, 2), "_group": np.full(b.num_rows, g), "_at": np.arange(at, at + b.num_rows)}, b.num_rows)
                at += b.num_rows
            for s, blob, n in _dealt(w, bounds, n_shards, split):
                yield made({"_cell": [s * copies + g % copies], "_kind": [1], "_group": [g], "_at": [-1], "_n": [n], "_blob": [blob], "_which": [which.tobytes()]}, 1)
        trim()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, shards = None, []
        rates, unigrams = shared.value
        for b in batches:
            kind = b["_kind"].to_numpy()
            if (kind == 2).any():
                yield b.filter(pa.array(kind == 2))
            for k in np.flatnonzero(kind < 2).tolist():
                n, blob = b["_n"][k].as_py(), b["_blob"][k].as_py()
                if kind[k] == 0:
                    shards, (keys, counts) = [], _counted(blob, n)
                    cell = b["_cell"][k].as_py()
                    of = [counts.sum(axis=0), *counts][: len(rates)]
                    shards = [_Shard((keys, c, r, split)) for c, r in zip(of, rates, strict=True)]
                    continue
                if b["_cell"][k].as_py() != cell:  # no text that was learned from has these words before
                    cell = b["_cell"][k].as_py()
                    none = np.zeros(0, np.int64)
                    shards = [_Shard((none, none, r, split)) for r in rates]
                u, v, w, text = _tokens(blob, n)
                which = np.frombuffer(b["_which"][k].as_py(), np.uint8)
                by = np.array([0, 2, 1])[which][text]
                logs = np.zeros(n)
                for m, shard in enumerate(shards):
                    mine = np.flatnonzero(by == m)
                    logs[mine] = shard.logs(u[mine], v[mine], w[mine], unigrams[m])
                sums = np.bincount(text, -logs, len(which)).astype(np.float32)
                yield made({"_kind": [1], "_group": b["_group"].slice(k, 1), "_at": [-1], "_n": [len(which)], "_blob": [_pack(sums.view("<u4"))]}, 1)
        trim()

    def back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, sums = None, np.zeros(0)
        for b in batches:
            kind, groups = b["_kind"].to_numpy(), b["_group"].to_numpy()
            ends = run_bounds(groups, kind)
            for x, y in zip(ends, ends[1:], strict=False):
                if groups[x] != group:
                    group, sums = groups[x], np.zeros(0)
                rows = b.slice(x, y - x)
                if kind[x] == 1:
                    for n, blob in zip(rows["_n"].to_pylist(), rows["_blob"].to_pylist(), strict=True):
                        part = _unpack(blob, n, 1)[0].astype("<u4").view("<f4").astype(np.float64)
                        sums = sums + part if len(sums) else part
                else:
                    total = rows[out].to_numpy() + (sums[rows["_at"].to_numpy()] if len(sums) else 0)
                    yield pa.RecordBatch.from_arrays([*(rows[c] for c in (*names, tokens)), pa.array(total), rows["_group"], rows["_at"]], [*names, tokens, out, "_group", "_at"])

    kind = T.StructType(fields)
    dealt = docs.drop(out, tokens).mapInArrow(deal, kind)
    tables = model.counted.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    given = {"_cell": (F.col("s") * copies + F.col("_copy")).cast("int"), "_kind": F.lit(0), "_n": F.col("n"), "_blob": F.col("blob")}
    tables = tables.select(*(given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in fields))
    met = dealt.union(tables).repartition("_cell").sortWithinPartitions("_cell", "_kind").mapInArrow(meet, kind)
    met = met.repartition("_group").sortWithinPartitions("_group", "_kind", "_at")
    return met.mapInArrow(back, T.StructType([f for f in fields if f.name not in ("_cell", "_kind", "_n", "_blob", "_which")]))


def surprise(docs: DataFrame, model: Model, out: str = "nats", tokens: str = "n_tokens") -> DataFrame:
    """docs(text binary, ...) in their order, without the text, with - log P(text) and the number of tokens."""
    return _scored(docs, model, out, tokens).orderBy("_group", "_at").drop("_group", "_at")


def trusted_ids(labels: DataFrame) -> DataFrame:
    """doc_id of documents that every label calls good, and none toxic; null labels say nothing."""
    by = labels.where("doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("q"), F.max(F.coalesce("toxic", F.lit(0))).alias("t"))
    return by.where("q = 1 and t = 0").select("doc_id")


def classify(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, shard_entries: int = SHARD_ENTRIES) -> DataFrame:
    """docs(doc_id, text, lang) -> (doc_id, row, lang, n_tokens, perplexity, threshold, kept), a row for every row.

    row: a hash of doc_id and text, by which rows of one doc_id are told apart. All trusted documents are
    counted, and all of them set the thresholds: each by the model of the half that it isn't in (copies of a text are in one half).
    """
    scratch = Scratch(docs.sparkSession, "kneser")
    good = scratch.save(trusted_ids(labels), "trusted")
    half = F.when(F.col("_good"), 1 + F.pmod(F.xxhash64("text"), F.lit(2))).otherwise(0).cast("int")
    rows = docs.select("doc_id", "lang", "text").join(F.broadcast(good.withColumn("_good", F.lit(True))), "doc_id", "left")
    rows = rows.select("doc_id", "lang", F.xxhash64("doc_id", "text").alias("row"), half.alias("half"), F.col("text").cast("binary").alias("text"))
    model = learn(rows.where("half > 0").select("text", "half"), scratch, shard_entries=shard_entries)
    if model is None:
        words = F.size(F.array_remove(F.split(F.coalesce(F.col("text").cast("string"), F.lit("")), r"[ \t-\r]+"), ""))
        return rows.select("doc_id", "row", "lang", (words + 1).cast("long").alias("n_tokens"), F.lit(None).cast("double").alias("perplexity"), F.lit(None).cast("double").alias("threshold"), (words > 0).alias("kept"))
    scored = _scored(rows, model, half="half").select("doc_id", "row", "lang", "half", "n_tokens", (F.col("nats") / F.col("n_tokens")).alias("rate"))
    scored = scratch.save(scored, "scored")
    fresh = scored.where("n_tokens > 1 and half > 0")
    limit = F.percentile_approx("rate", quantile, 10_000) + SLACK
    by_lang = fresh.groupBy("lang").agg(limit.alias("of_lang"), F.count("*").alias("n")).where(F.col("n") >= FEW)
    overall = fresh.agg(limit.alias("t")).first()["t"]
    table = scored.join(F.broadcast(by_lang).withColumnRenamed("lang", "l"), F.col("lang").eqNullSafe(F.col("l")), "left")
    threshold = F.coalesce("of_lang", F.lit(overall if overall is not None else float("inf")).cast("double"))
    exp = lambda c: F.exp(F.least(c, F.lit(700.0)))
    return table.select("doc_id", "row", "lang", "n_tokens", exp(F.col("rate")).alias("perplexity"), exp(threshold).alias("threshold"), ((F.col("rate") <= threshold) & (F.col("n_tokens") > 1)).alias("kept"))


def op4_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Perplexity and decision of every document."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return classify(docs, labels).drop("row")
