"""Spelling variants by anagram hashing.

A word's anagram key is the sum of its letters' fifth powers, so equal multisets of letters have
equal keys whatever their order. Words that differ by one letter have keys that differ by that
letter's value (one more or one less) or by the difference of two (one for another): a word's key
less one of its letters is another word's key, or another word's key less one of its own. These
values are joined first; only words whose value is met by another go on.

Then the order of letters is verified, without comparing words pair by pair: words with equal
letters before and behind a gap differ there by one letter, and a word without one of its letters
is another word. Both are equalities, so they are grouped, not listed as pairs within an anagram
class; a group has at most one word for each letter of the alphabet (or, around a shorter word,
each letter and place), whatever the input.

Counting takes texts in batches of bounded bytes and hands on a bounded table of words at a time.

Defined results: null and letterless texts have no words; texts and words of any length are whole;
repeated rows count each; a null doc_id counts as an empty text in the checksum; an empty table
has no words; ties of equal counts go to the smaller word in code-point order; extra columns are
not read, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, WordIndex, trim

LEAST_LENGTH, LEAST_COUNT = 5, 3
#: A run of a document is damaged where this divides the checksum; letters' values are their code points to this power.
DAMAGE, POWER = 97, 5
#: Bytes of texts that are cut at once, and words that a task counts before it hands them on.
CUT_BYTES, HELD_WORDS = 4 << 20, 1 << 18
#: The letters around a gap stand as they are up to so many bytes, beyond as digests of either side.
PLAIN_BYTES = 40

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LEAD = 0xC3  # of U+00C0 to U+00FF in UTF-8


def cut_runs(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(text numbers, codes, words) of the runs of letters in a large-binary array without nulls: run k is words[codes[k]], A-Z lowered."""
    _, ends, raw = texts.buffers()
    ends = np.frombuffer(ends, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(raw, np.uint8)[ends[0] : ends[-1]] if raw is not None else np.zeros(0, np.uint8)
    ends = ends - ends[0]
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), pa.array([], pa.large_binary())
    lead = data == _LEAD
    inside = _LETTER[data] | lead
    inside[1:] |= lead[:-1]
    before = np.empty_like(inside)
    before[0], before[1:] = False, inside[:-1]
    before[ends[:-1][ends[:-1] < len(data)]] = False
    begins = np.flatnonzero(inside & ~before)
    starts = np.flatnonzero((inside & ~before)[inside])
    flat = _LOWER[data[inside]]
    runs = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(np.append(starts, len(flat)).astype(np.int64)), pa.py_buffer(flat)])
    found = runs.dictionary_encode()
    return np.searchsorted(ends, begins, side="right") - 1, found.indices.to_numpy().astype(np.int64), found.dictionary


def damaged(ids: list[str], of: np.ndarray, codes: np.ndarray, words: list[bytes]) -> Iterator[tuple[int, bytes]]:
    """(place, what is left) of those pairs of text and word of which the checksum takes a letter."""
    at, prefix = -1, 0
    for k, (t, c) in enumerate(zip(of.tolist(), codes.tolist(), strict=True)):
        if t != at:
            at, prefix = t, zlib.crc32(f"{ids[t]}:".encode())
        h = zlib.crc32(words[c], prefix)
        if not h % DAMAGE:
            run = words[c].decode()
            i = h % len(run)
            yield k, (run[:i] + run[i + 1 :]).encode()


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose texts have so many bytes, or one text."""
    size = np.cumsum(pc.binary_length(batch["text"]).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    s = 0
    while s < batch.num_rows:
        e = max(s + 1, int(np.searchsorted(size, (size[s - 1] if s else 0) + CUT_BYTES, side="right")))
        yield batch.slice(s, e - s)
        s = e


def count_words(docs: DataFrame, least_length: int = LEAST_LENGTH) -> DataFrame:
    """(word, n) of the damaged runs of docs(doc_id, text) with so many code points or more."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, counts = WordIndex(), np.zeros(0, np.int64)

        def add(words: pa.Array, n: np.ndarray) -> None:
            nonlocal counts
            numbers, _ = index.number(words)
            counts = np.append(counts, np.zeros(len(index) - len(counts), np.int64))
            np.add.at(counts, numbers, n)

        def out() -> pa.RecordBatch:
            some = counts > 0
            words = [w.decode() for w, s in zip(index, some.tolist(), strict=True) if s]
            return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(counts[some])], ["word", "n"])

        for whole in batches:
            for b in _slices(whole):
                texts = b["text"].cast(pa.large_binary()).fill_null(b"")
                ids = ["" if x is None else str(x) for x in b["doc_id"].to_pylist()]
                of, codes, words = cut_runs(texts)
                if not len(codes):
                    continue
                long = words.to_numpy(zero_copy_only=False).tolist()
                enough = np.fromiter(map(len, long), np.int64, len(long)) >= least_length  # bytes: a first sieve
                some = enough[codes]
                pairs, n = np.unique(of[some] * len(long) + codes[some], return_counts=True)
                left, lost = n.copy(), []
                for k, word in damaged(ids, pairs // len(long), pairs % len(long), long):
                    lost.append((word, int(n[k])))
                    left[k] = 0
                add(words, np.bincount(pairs % len(long), left, len(long)).astype(np.int64))
                if lost:
                    again = pa.array([w for w, _ in lost], pa.large_binary()).dictionary_encode()
                    add(again.dictionary, np.bincount(again.indices.to_numpy(), [k for _, k in lost], len(again.dictionary)).astype(np.int64))
                if len(index) > HELD_WORDS:
                    yield out()
                    index, counts = WordIndex(), np.zeros(0, np.int64)
        yield out()
        trim()

    found = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(each, "word string, n long")
    return found.where(F.length("word") >= least_length).groupBy("word").agg(F.sum("n").alias("n"))


def letter_value(letter: str) -> int:
    return ord(letter) ** POWER


def anagram_key(word: str) -> int:
    """The sum of the letters' values as a signed 64-bit integer; what is beyond wraps, in sums and differences alike."""
    return _signed(sum(map(letter_value, word)))


def _signed(x: int) -> int:
    return (x + (1 << 63)) % (1 << 64) - (1 << 63)


def _keyed(words: DataFrame) -> DataFrame:
    """words with their anagram key, and that key less each of their letters."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            listed = b["word"].to_pylist()
            keys = [anagram_key(w) for w in listed]
            less = [[_signed(k - letter_value(c)) for c in set(w)] for w, k in zip(listed, keys, strict=True)]
            yield pa.RecordBatch.from_arrays([b["word"], b["n"], pa.array(keys, pa.int64()), pa.array(less, pa.list_(pa.int64()))], ["word", "n", "key", "less"])

    return words.mapInArrow(each, "word string, n long, key long, less array<long>")


#: What stands for a word in a group: letters around a gap, those left without one, the whole word.
GAP, WITHOUT, WHOLE = 0, 1, 2


def forms(word: str, letters: set[str], whole: bool) -> Iterator[tuple[bytes, int]]:
    """(letters, kind) for each place of the word that holds one of the letters, and for the whole word if asked for.

    A word without either of two equal neighbours is the same, and is given once.
    """
    raw = [c.encode() for c in word]
    plain = sum(map(len, raw)) <= PLAIN_BYTES
    bare = (lambda x: x) if plain else (lambda x: blake2b(x, digest_size=32).digest())
    if whole:
        yield bare(b"".join(raw)), WHOLE
    behind = [blake2b(digest_size=16)]
    if not plain:  # digests of all ends of the word, each from the one before
        for c in reversed(raw):
            behind.append(behind[-1].copy())
            behind[-1].update(c)
    before = blake2b(digest_size=16)
    for i, c in enumerate(word):
        if c in letters:
            left, right = (b"".join(raw[:i]), b"".join(raw[i + 1 :])) if plain or not i or word[i - 1] != c else (b"", b"")
            yield left + b"\0" + right if plain else before.digest() + behind[len(raw) - 1 - i].digest(), GAP
            if not i or word[i - 1] != c:
                yield bare(left + right), WITHOUT
        if not plain:
            before.update(raw[i])


def _spelled(met: DataFrame) -> DataFrame:
    """met(word, n, key, value) -> (letters, kind, word, n): what to group by to verify the order of letters."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in range(0, batch.num_rows, 2_000):
                b = batch.slice(s, 2_000)
                at, letters, kinds = [], [], []
                for k, (word, key, value) in enumerate(zip(b["word"].to_pylist(), b["key"].to_pylist(), b["value"].to_pylist(), strict=True)):
                    for x, kind in forms(word, {c for c in set(word) if _signed(key - letter_value(c)) == value}, key == value):
                        at.append(k)
                        letters.append(x)
                        kinds.append(kind)
                taken = b.take(pa.array(at, pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(letters, pa.binary()), pa.array(kinds, pa.int32()), taken["word"], taken["n"]], ["letters", "kind", "word", "n"])

    return met.mapInArrow(each, "letters binary, kind int, word string, n long")


def near_words(words: DataFrame, scratch: Scratch) -> DataFrame:
    """words(word, n), distinct -> (word, n_near, best), a row for each word with a near one.

    best: (minus, word) of the near word with the largest n, then the smallest.
    """
    keyed = scratch.save(_keyed(words), "keys")
    values = keyed.select("word", "n", "key", F.col("key").alias("value")).unionByName(keyed.select("word", "n", "key", F.explode("less").alias("value")))
    own = F.col("value") == F.col("key")
    sums = values.groupBy("value").agg(F.count_if(own).alias("full"), F.count_if(~own).alias("less"))
    met = values.join(sums.where("less > 1 or less > 0 and full > 0").select("value"), "value")
    spelled = _spelled(met.select("word", "n", "key", "value"))
    rows = F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("minus"), "word", "kind")))  # no more than the alphabet has letters, for each place
    together = spelled.groupBy("letters", (F.col("kind") == GAP).alias("gap")).agg(rows.alias("rows")).where(F.size("rows") > 1)
    first, second = F.get("rows", F.lit(0)), F.get("rows", F.lit(1))
    gap = together.where("gap").select(F.explode("rows").alias("r"), F.when(F.col("r.word") == first["word"], second).otherwise(first).alias("best"), (F.size("rows") - 1).alias("k"))
    split = lambda kind: F.filter("rows", lambda r: r["kind"] == kind)
    short = together.where("not gap").select(F.get(split(WHOLE), F.lit(0)).alias("w"), split(WITHOUT).alias("longer")).where("w is not null and size(longer) > 0")
    shorter = short.select(F.col("w").alias("r"), F.get("longer", F.lit(0)).alias("best"), F.size("longer").alias("k"))
    longer = short.select(F.explode("longer").alias("r"), F.col("w").alias("best"), F.lit(1).alias("k"))
    found = gap.unionByName(shorter).unionByName(longer).select("r.word", "k", F.struct("best.minus", "best.word").alias("best"))
    return found.groupBy("word").agg(F.sum("k").alias("n_near"), F.min("best").alias("best"))


def roots(forms_: DataFrame, scratch: Scratch) -> DataFrame:
    """forms(word, form) -> (word, root): forms followed to the last. Each step skips twice as many.

    Counts at least double from a word to its form, so a chain has no more steps than the largest count has binary digits.
    """
    found = scratch.save(forms_.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), "roots")
    while not found.where("moved").isEmpty():
        on = found.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = found.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        found, last = scratch.save(step, "roots"), found
        scratch.drop(last)
    return found.select("word", "root")


def variants(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """docs(doc_id, text) -> (word, n, n_near, form, form_n, root): frequent words, and of which a rarer one is a spelling."""
    scratch = Scratch(docs.sparkSession, "spelling")
    words = scratch.save(count_words(docs, least_length).where(F.col("n") >= least_count), "words")
    near = near_words(words, scratch)
    best = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.col("best.word").alias("best"), (-F.col("best.minus")).alias("best_n"))
    has = F.col("best_n") >= 2 * F.col("n")
    formed = scratch.save(best.select("word", "n", "n_near", F.when(has, F.col("best")).alias("form"), F.when(has, F.col("best_n")).alias("form_n")), "forms")
    last = roots(formed.where("form is not null"), scratch)
    return formed.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_anagram_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spelling variants among the words of all documents."""
    return variants(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def oracle() -> str:
    """The same in DuckDB SQL: checksums by a table worked out in SQL, near words by their letters around each place."""
    letters, small = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
    WITH RECURSIVE bits(i, c, k) AS (
        SELECT i, i, 0 FROM range(256) t(i)
        UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
    tab AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8),
    runs AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\u00C0-\u00FF]+')), '{letters}', '{small}') AS w FROM documents),
    counted AS (SELECT doc_id, w, count(*) AS k FROM runs GROUP BY 1, 2),
    summed AS (SELECT w, k, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':' || w, ''),
                   lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [195::BIGINT, unicode(c)::BIGINT - 64] END))),
                   lambda s, b: xor(s >> 8, t[(xor(s, b) & 255) + 1]))) AS h FROM counted, tab),
    left_over AS (SELECT CASE WHEN h % 97 = 0 THEN substr(w, 1, (h % length(w))::BIGINT) || substr(w, (h % length(w))::BIGINT + 2) ELSE w END AS word, k FROM summed),
    words AS (SELECT word, sum(k)::BIGINT AS n FROM left_over WHERE length(word) >= {LEAST_LENGTH} GROUP BY 1 HAVING sum(k) >= {LEAST_COUNT}),
    places AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words),
    around AS (SELECT word, n, i, substr(word, 1, i - 1) AS l, substr(word, i + 1) AS r FROM places),
    shorter AS (SELECT DISTINCT a.word AS longer, a.n AS longer_n, w.word, w.n FROM around a JOIN words w ON w.word = a.l || a.r),
    near AS (SELECT a.word, b.word AS other, b.n AS other_n FROM around a JOIN around b ON a.i = b.i AND a.l = b.l AND a.r = b.r AND a.word <> b.word
             UNION ALL SELECT longer, word, n FROM shorter UNION ALL SELECT word, longer, longer_n FROM shorter),
    best AS (SELECT word, count(*) AS n_near, max(other_n) AS m FROM near GROUP BY 1),
    formed AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 2 * w.n THEN m END AS form_n,
                      CASE WHEN m >= 2 * w.n THEN (SELECT min(other) FROM near x WHERE x.word = w.word AND x.other_n = m) END AS form
               FROM words w LEFT JOIN best USING (word)),
    chain(word, root) AS (SELECT word, word FROM formed UNION ALL SELECT c.word, f.form FROM chain c JOIN formed f ON f.word = c.root WHERE f.form IS NOT NULL),
    ends AS (SELECT c.word, c.root FROM chain c JOIN formed f ON f.word = c.root AND f.form IS NULL)
    SELECT f.word, f.form, r.root, f.n, f.n_near, f.form_n FROM formed f JOIN ends r ON r.word = f.word
    """
