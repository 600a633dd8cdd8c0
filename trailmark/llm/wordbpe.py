"""Token ids of a tokenizers file for whole texts, with every distinct word encoded once.

The vocabulary's pre-tokenizer never joins characters across white space, nor ASCII letters,
digits and marks (the apostrophe apart, which may begin a contraction), so a text's ids are
those of its words cut there, in order. The library encodes each word and decides the rest. A
text that holds one of the vocabulary's added tokens goes to the library whole.
"""

from __future__ import annotations

import os
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import WordIndex, cut_words, held

DEFAULT_VOCABULARY = "word_bpe_49k.json"
CACHE_WORDS = 250_000


def vocabulary_path(name: str = DEFAULT_VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encoder(path: str) -> WordEncoder:
    """The encoder that a Python worker keeps for a vocabulary file."""
    return held(("words", path), lambda: WordEncoder(path))


class WordEncoder:
    """encode(texts) -> (ids, bounds): text k's ids are ids[bounds[k]:bounds[k + 1]]."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        # lower-cased ASCII letters are what the normaliser and the byte mapping leave as they are
        self.ascii = Tokenizer.from_file(path)
        self.ascii.normalizer, self.ascii.pre_tokenizer = normalizers.Sequence([]), pre_tokenizers.WhitespaceSplit()
        for t in (self.tokenizer, self.ascii):
            if hasattr(t.model, "_resize_cache"):
                t.model._resize_cache(0)  # the words are kept here
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        ends = {i for t, i in self.tokenizer.get_vocab().items() if t.endswith("</w>")}
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.ends[list(ends)] = True
        self._clear()

    def _clear(self) -> None:
        self.known = WordIndex()
        self.starts = np.zeros(0, np.int64)
        self.lengths = np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.uint32)

    def _call(self, tokenizer, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _letters(self, words: pa.Array, tokenizer) -> tuple[np.ndarray, np.ndarray]:
        """(ids, lengths) of words of letters: one pre-token each, so many can share a call."""
        lists = pa.ListArray.from_arrays(pa.array(np.append(np.arange(0, len(words), 200), len(words)).astype(np.int32)), words)
        ids = np.fromiter(chain.from_iterable(self._call(tokenizer, pc.binary_join(lists, " ").to_pylist())), np.uint32)
        at = np.flatnonzero(self.ends[ids]) + 1
        if len(at) != len(words) or len(ids) and at[-1] != len(ids):  # a letter that the library sees otherwise
            return self._each(words)
        return ids, np.diff(at, prepend=0)

    def _each(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        ids = self._call(self.tokenizer, words.to_pylist())
        return np.fromiter(chain.from_iterable(ids), np.uint32), np.fromiter(map(len, ids), np.int64, len(ids))

    def _learn(self, fresh: pa.Array) -> None:
        """Ids of the fresh words."""
        fresh = fresh.cast(pa.string())
        plain, letters = (f(fresh).to_numpy(zero_copy_only=False) for f in (pc.ascii_is_alpha, pc.utf8_is_alpha))
        groups = [np.flatnonzero(x) for x in (plain, letters & ~plain, ~letters)]
        of = [fresh.take(pa.array(g)) for g in groups]
        found = [self._letters(of[0], self.ascii), self._letters(of[1], self.tokenizer), self._each(of[2])]
        lengths = np.concatenate([n for _, n in found])
        starts = np.cumsum(lengths) - lengths
        back = np.argsort(np.concatenate(groups))
        self.starts = np.concatenate([self.starts, len(self.flat) + starts[back]])
        self.flat = np.concatenate([self.flat, *(ids for ids, _ in found)])
        self.lengths = np.concatenate([self.lengths, lengths[back]])

    def encode(self, texts: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (binary) one after another, each followed by end_id if one is given; null counts as empty."""
        if len(self.known) > CACHE_WORDS:
            self._clear()
        codes, words, cuts = cut_words(texts, classes=True)
        number, fresh = self.known.number(words)
        if len(fresh):
            self._learn(fresh)
        at = number[codes]
        lengths = self.lengths[at]
        ids = self.flat[spans(self.starts[at], lengths)]
        bounds = np.append(0, np.cumsum(lengths))[cuts]
        whole = [k for t in self.added for k in pc.indices_nonzero(pc.match_substring(texts, t).fill_null(False)).to_pylist()]
        if whole:
            parts = np.split(ids, bounds[1:-1])
            for k in set(whole):
                parts[k] = np.array(self._call(self.tokenizer, [texts[k].as_py().decode()])[0], np.uint32)
            ids, bounds = np.concatenate(parts), np.append(0, np.cumsum([len(p) for p in parts]))
        if end_id is None:
            return ids, bounds
        out = np.full(len(ids) + len(texts), end_id, np.uint32)
        out[np.arange(len(ids)) + np.repeat(np.arange(len(texts)), np.diff(bounds))] = ids
        return out, bounds + np.arange(len(texts) + 1)


def spans(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places starts[k] .. starts[k] + lengths[k] - 1 of all k, one after another."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total)
