"""Language identification by segmentation-marginalised unigrams.

A fixed public vocabulary of pieces gives the words' segmentations; every language has its own
piece probabilities. A word's probability in a language is the sum over all its segmentations
(forward algorithm), a text's the product over its words, and the languages' posterior under
equal priors is the score. Piece probabilities are learned by expectation maximisation: the
forward and backward sums give each piece's expected count over the training words.

Learning uses a bounded sample of labelled rows (about ``docs_per_language`` of each language,
chosen by a hash); prediction reads every whole text. Pieces never cross white space, so a word
is scored once and looked up after.

Defined results: a null text or one without a letter is ``und`` with score 0, as is every text
where nothing could be learned; ties go to the first language by name; rows are never dropped.
"""

from __future__ import annotations

import itertools
import unicodedata
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .columns import append, fold
from .common import Scratch, held, uniform

VOCABULARY = "piece_bpe_32k.model"
DOCS_PER_LANGUAGE, ROUNDS, SMOOTHING = 4_000, 3, 0.1
LONGEST_PIECE, CACHE_WORDS = 16, 200_000
BLOCK_WORDS, BLOCK_CHARS, FLUSH_ARCS = 20_000, 500_000, 200_000
#: A sum below this gets a new scale; pieces are likelier than 1e-17, so none underflows before.
SMALL = 2.0**-256
UNKNOWN = "und"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pieces(path: str) -> Pieces:
    return held(("pieces", path), lambda: Pieces(path))


class Pieces:
    """The vocabulary's pieces as a trie that all words walk at once."""

    #: The most frequent characters have a column each in a dense table of steps; others are searched.
    DENSE = 128

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        listed = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        listed = sorted({p.lower() for p in listed if 0 < len(p) <= LONGEST_PIECE})
        self.size = len(listed) + 1  # the last: a character that is no piece
        self.ids = {p: i for i, p in enumerate(listed)}
        chars = Counter(c for p in listed for c in p)
        self.code = np.zeros(0x110000, np.int32)  # 0: a character of no piece
        for k, (c, _) in enumerate(chars.most_common()):
            self.code[ord(c)] = k + 1
        self.wide = len(chars) + 1
        steps: dict[tuple[int, int], int] = {}
        self.piece = [-1]
        for p, i in self.ids.items():
            node = 0
            for c in p:
                node = steps.setdefault((node, int(self.code[ord(c)])), len(self.piece))
                if node == len(self.piece):
                    self.piece.append(-1)
            self.piece[node] = i
        self.piece = np.array(self.piece, np.int64)
        self.dense = np.zeros((len(self.piece), self.DENSE), np.int32)
        for (node, c), to in steps.items():
            if c < self.DENSE:
                self.dense[node, c] = to
        rare = sorted((node * self.wide + c, to) for (node, c), to in steps.items() if c >= self.DENSE)
        self.rare = np.array([k for k, _ in rare] or [-1], np.int64), np.array([t for _, t in rare] or [0], np.int64)

    def _step(self, node: np.ndarray, code: np.ndarray) -> np.ndarray:
        out = np.where(code < self.DENSE, self.dense[node, np.minimum(code, self.DENSE - 1)], 0).astype(np.int64)
        far = np.flatnonzero(code >= self.DENSE)
        if len(far):
            keys = node[far] * self.wide + code[far]
            at = np.minimum(np.searchsorted(self.rare[0], keys), len(self.rare[0]) - 1)
            out[far] = np.where(self.rare[0][at] == keys, self.rare[1][at], 0)
        return out

    def arcs(self, words: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For the lengths 1, 2, ..: (places of the first characters in all words joined, pieces)."""
        length = np.fromiter(map(len, words), np.int64, len(words))
        code = self.code[np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)]
        n = len(code)
        left = np.repeat(np.cumsum(length), length) - np.arange(n)
        at, node, out = np.arange(n), np.zeros(n, np.int64), []
        for k in range(LONGEST_PIECE):
            going = left[at] > k
            at, node = at[going], node[going]
            if not len(at):
                break
            node = self._step(node, code[at + k])
            if k == 0:
                piece = np.where(node > 0, self.piece[node], -1)
                out.append((at, np.where(piece < 0, self.size - 1, piece)))
            going = node > 0
            at, node = at[going], node[going]
            if k:
                whole = self.piece[node] >= 0
                out.append((at[whole], self.piece[node[whole]]))
        return out


def split_words(text: str | None) -> list[str]:
    """Lower-cased, NFKC-normalised words behind the word mark, each whole."""
    return ["▁" + w for w in unicodedata.normalize("NFKC", text).lower().split()] if text else []


def blocks(words: list[str]) -> Iterator[slice]:
    """Slices of words, of bounded characters unless one word alone has more."""
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
    at = 0
    while at < len(words):
        fit = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + BLOCK_CHARS, side="right"))
        to = min(max(fit, at + 1), at + BLOCK_WORDS)
        yield slice(at, to)
        at = to


def forward(vocabulary: Pieces, words: list[str], probs: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray | None]:
    """log of the sum over all segmentations, (words, languages); and with counts (words,
    languages) given, the pieces' expected counts (pieces, languages).

    alpha has a place before each character and one behind each word. All words advance
    together, one end of an arc at a time. A place's alpha is kept times two to the power of
    its scale, and beta divided by it, so that words of any length stay within doubles.
    """
    length = np.fromiter(map(len, words), np.int64, len(words))
    word = np.repeat(np.arange(len(words)), length)
    first = np.cumsum(length) - length
    inside = np.arange(len(word)) - first[word]
    narrow = np.int16 if len(words) and length.max() < 2**15 else np.int32
    groups: list[list] = [[] for _ in range(int(length.max()) + 1 if len(words) else 0)]  # by end within the word: (length, places, pieces)
    for k, (at, piece) in enumerate(vocabulary.arcs(words)):
        end = (inside[at] + k + 1).astype(narrow)
        order = np.argsort(end, kind="stable")
        place, piece, end = (at + word[at])[order], piece[order], end[order]
        cuts = [0, *(np.flatnonzero(np.diff(end)) + 1).tolist(), len(end)]
        for x, y in itertools.pairwise(cuts):
            if x < y:
                groups[end[x]].append((k + 1, place[x:y], piece[x:y]))
    alpha = np.zeros((len(word) + len(words), probs.shape[1]))
    scale: np.ndarray | None = None  # of places, from the first small sum on
    start = first + np.arange(len(words))
    alpha[start] = 1.0
    for group in groups:
        if not group:
            continue
        before = group[0][1]  # of length 1: such an arc leads to every place
        small = alpha[before] < SMALL
        if small.any() and scale is None:
            scale = np.zeros(alpha.shape, np.int32)
        if scale is not None:
            scale[before + 1] = scale[before] - np.where(small, np.frexp(alpha[before])[1], 0)
        for k, at, piece in group:
            part = alpha[at] * probs[piece]
            alpha[at + k] += part if scale is None else np.ldexp(part, scale[at + k] - scale[at])
    total = alpha[start + length]
    with np.errstate(divide="ignore"):
        logs = np.log(total)
    if scale is not None:
        logs -= scale[start + length] * np.log(2)
    if counts is None:
        return logs, None
    beta, expected = np.zeros_like(alpha), np.zeros((vocabulary.size, probs.shape[1]))
    beta[start + length] = counts / total
    parts: list[tuple[np.ndarray, np.ndarray]] = []

    def add() -> None:
        piece, part = (np.concatenate(x) for x in zip(*parts, strict=True))
        for lang in range(probs.shape[1]):
            expected[:, lang] += np.bincount(piece, part[:, lang], vocabulary.size)
        parts.clear()

    held_arcs = 0
    for group in reversed(groups):
        for k, at, piece in group:
            part = beta[at + k] * probs[piece]
            if scale is not None:
                part = np.ldexp(part, scale[at + k] - scale[at])
            beta[at] += part
            part *= alpha[at]
            parts.append((piece, part))
            held_arcs += len(piece)
        if held_arcs > FLUSH_ARCS:
            add()
            held_arcs = 0
    if parts:
        add()
    return logs, expected


class Scorer:
    """Words' log probabilities in all languages, each computed once and kept in a bounded cache."""

    def __init__(self, vocabulary: Pieces, probs: np.ndarray):
        self.vocabulary, self.probs = vocabulary, probs
        self._clear()

    def _clear(self) -> None:
        self.known: dict[str, int] = {}
        self.logs = np.zeros((0, self.probs.shape[1]))

    def score(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(log probabilities, whether a letter occurs in the text as it is) of texts."""
        if len(self.known) > CACHE_WORDS:
            self._clear()
        known, index, counts, fresh = self.known, [], [], []
        for text in texts:
            words = split_words(text)
            counts.append(len(words))
            for w in words:
                if w not in known:
                    known[w] = len(known)
                    fresh.append(w)
            index.extend(map(known.__getitem__, words))
        if fresh:
            new = [forward(self.vocabulary, fresh[part], self.probs)[0] for part in blocks(fresh)]
            self.logs = np.concatenate([self.logs, *new])
        at = np.array(index, np.int64)
        ends = np.cumsum(counts)
        bounds = np.concatenate([[0], ends])
        logs = np.zeros((len(texts), self.probs.shape[1]))
        letters = np.fromiter((any(map(str.isalpha, text or "")) for text in texts), bool, len(texts))  # normalising makes letters of some signs
        some = np.flatnonzero(np.diff(bounds))
        if len(some):
            logs[some] = np.add.reduceat(self.logs[at], bounds[some])
        return logs, letters


class Model:
    """Languages and their piece probabilities over one vocabulary file."""

    def __init__(self, path: str, languages: list[str], probs: np.ndarray):
        self.path, self.languages, self.probs = path, languages, probs


def learn(labelled: DataFrame, path: str | None = None, docs_per_language: int = DOCS_PER_LANGUAGE, rounds: int = ROUNDS) -> Model:
    """A model from labelled(doc_id, text, lang); rows without text or label don't count."""
    path = path or vocabulary_path()
    scratch = Scratch(labelled.sparkSession, "language")
    rows = labelled.select("doc_id", "text", "lang").where("text is not null and lang is not null")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(sizes)
    if not languages:
        return Model(path, [], np.zeros((1, 0)))
    share = F.create_map(*(x for k in languages for x in (F.lit(k), F.lit(docs_per_language / sizes[k]))))
    sample = rows.where(uniform("doc_id", "text") < share[F.col("lang")]).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, Counter] = {}
        for b in batches:
            for lang, text in zip(b["lang"].to_pylist(), b["text"].to_pylist(), strict=True):
                found.setdefault(lang, Counter()).update(split_words(text))
        for lang, words in found.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(words)), pa.array(list(words)), pa.array(list(words.values()), pa.int64())], ["lang", "word", "n"])

    words = sample.mapInArrow(count, "lang string, word string, n long").groupBy("word").pivot("lang", languages).agg(F.sum("n"))
    words = scratch.save(words.na.fill(0).toDF("word", *(f"n{k}" for k in range(len(languages)))), "words")
    size = pieces(path).size
    probs = np.full((size, len(languages)), 1 / size)
    for _ in range(rounds):
        sent = labelled.sparkSession.sparkContext.broadcast(probs)  # pieces times languages

        def expect(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            vocabulary, total = pieces(path), np.zeros((size, len(languages)))
            for b in batches:
                listed = b.column(0).to_pylist()
                n = np.stack([b.column(k + 1).to_numpy() for k in range(len(languages))], axis=1).astype(float)
                for part in blocks(listed):
                    total += forward(vocabulary, listed[part], sent.value, n[part])[1]
            piece, lang = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(piece, pa.int32()), pa.array(lang, pa.int32()), pa.array(total[piece, lang])], ["piece", "lang", "n"])

        counts = np.full((size, len(languages)), SMOOTHING)
        for r in words.mapInArrow(expect, "piece int, lang int, n double").groupBy("piece", "lang").agg(F.sum("n").alias("n")).toLocalIterator():
            counts[r["piece"], r["lang"]] += r["n"]
        probs = counts / counts.sum(axis=0)
        sent.destroy()
    return Model(path, languages, probs)


def predict(docs: DataFrame, model: Model, predicted: str = "lang_pred", score: str = "score") -> DataFrame:
    """docs(text, ...) with two more columns: the likeliest language, and its posterior."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    mark = uuid.uuid4().hex

    def each(b: pa.RecordBatch) -> list:
        m = sent.value
        if not m.languages:
            return [[UNKNOWN] * b.num_rows, [0.0] * b.num_rows]
        logs, letters = held(mark, lambda: Scorer(Pieces(m.path), m.probs)).score(b["text"].to_pylist())
        best = logs.argmax(axis=1)
        posterior = 1 / np.exp(logs - logs.max(axis=1, keepdims=True)).sum(axis=1)
        return [[m.languages[k] if ok else UNKNOWN for k, ok in zip(best, letters, strict=True)], np.where(letters, posterior, 0.0)]

    return append(docs, each, [(predicted, T.StringType()), (score, T.DoubleType())])


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document; learned from the folds 0, 1 and 3 of 4."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang").withColumn("held_out", fold("doc_id", 4) == 2)
    model = learn(docs.where("not held_out"))
    return predict(docs.select("doc_id", "held_out", "text"), model).select("doc_id", "held_out", "lang_pred", "score")
