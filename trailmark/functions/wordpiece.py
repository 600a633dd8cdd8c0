"""WordPiece encoding of texts for an embedder: basic tokens, greedy pieces, fixed length."""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LONGEST_WORD = 200
CONTINUES = "##"


def read_vocabulary(content: str) -> dict[str, int]:
    """Token -> line number; blank lines keep their number, carriage returns go."""
    lines = [x.removesuffix("\r") for x in content.split("\n")]
    if lines and not lines[-1]:
        lines.pop()
    return {token: k for k, token in enumerate(lines) if token}


@dataclass(frozen=True)
class Config:
    """Settings of a tokenizer file; names are those of its JSON."""

    max_sequence_length: int
    do_lower_case: bool = True
    strip_accents: bool = True
    cls_token_id: int = 101
    sep_token_id: int = 102
    pad_token_id: int = 0
    unk_token_id: int = 100

    @classmethod
    def read(cls, content: str) -> Config:
        found = json.loads(content)
        return cls(**{k: found[k] for k in cls.__dataclass_fields__ if k in found})

    def write(self) -> str:
        return json.dumps({k: getattr(self, k) for k in self.__dataclass_fields__}, indent=2)


def _marks(c: str) -> bool:
    """ASCII symbols count as punctuation on top of the Unicode categories."""
    return "!" <= c <= "/" or ":" <= c <= "@" or "[" <= c <= "`" or "{" <= c <= "~" or unicodedata.category(c)[0] == "P"


class WordPiece:
    def __init__(self, vocabulary: dict[str, int], config: Config):
        if not vocabulary:
            raise ValueError("the vocabulary is empty")
        if config.max_sequence_length < 2:
            raise ValueError("a sequence holds two special tokens at least")
        self.vocabulary, self.config = vocabulary, config
        self.longest = max(map(len, vocabulary))
        self._words: dict[str, list[int]] = {}

    def basic(self, text: str) -> list[str]:
        kept = (" " if c.isspace() else "" if c in "\0\ufffd" or unicodedata.category(c) == "Cc" else c for c in text)
        text = "".join(kept)
        if self.config.do_lower_case:
            text = text.lower()
        if self.config.strip_accents:
            text = "".join(c for c in unicodedata.normalize("NFD", text) if unicodedata.category(c) != "Mn")
        out: list[str] = []
        for word in text.split():
            glued = False
            for c in word:
                if _marks(c):
                    out.append(c)
                    glued = False
                elif glued:
                    out[-1] += c
                else:
                    out.append(c)
                    glued = True
        return out

    def pieces(self, word: str) -> list[int]:
        """Greedy longest pieces; a word with a gap, or an overlong one, is unknown as a whole."""
        if word in self._words:
            return self._words[word]
        found, at, unknown = [], 0, [self.config.unk_token_id]
        if len(word) > LONGEST_WORD:
            return unknown
        while at < len(word):
            mark = CONTINUES if at else ""
            longest = min(len(word), at + self.longest)
            step = next((e for e in range(longest, at, -1) if mark + word[at:e] in self.vocabulary), None)
            if step is None:
                found = unknown
                break
            found.append(self.vocabulary[mark + word[at:step]])
            at = step
        if len(self._words) < 200_000:
            self._words[word] = found
        return found

    def count(self, text: str) -> int:
        return sum(len(self.pieces(w)) for w in self.basic(text))

    def encode(self, text: str) -> tuple[list[int], list[int]]:
        """(ids, mask), both of the sequence's length."""
        c = self.config
        content: list[int] = []
        for word in self.basic(text):
            content += self.pieces(word)
            if len(content) >= c.max_sequence_length - 2:
                break
        ids = [c.cls_token_id, *content[: c.max_sequence_length - 2], c.sep_token_id]
        pad = c.max_sequence_length - len(ids)
        return ids + [c.pad_token_id] * pad, [1] * len(ids) + [0] * pad


def encode_column(df: DataFrame, vocabulary: dict[str, int], config: Config, text: str = "text") -> DataFrame:
    """df with input_ids and attention_mask. The vocabulary is one file's, sent once to every worker."""
    held = df.sparkSession.sparkContext.broadcast(WordPiece(vocabulary, config))

    @F.pandas_udf("input_ids array<int>, attention_mask array<int>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([held.value.encode(t or "") for t in texts], columns=["input_ids", "attention_mask"])

    return df.withColumn("_e", encode(F.col(text))).withColumns({k: F.col(f"_e.{k}") for k in ("input_ids", "attention_mask")}).drop("_e")


def vocabulary_lines(vocabulary: DataFrame) -> DataFrame:
    """A vocabulary(token, id) as the lines of its file, in order of the ids."""
    return vocabulary.orderBy("id").select(F.col("token").alias("value"))


def content_tokens(mask: Column) -> Column:
    return F.aggregate(mask, F.lit(0), lambda s, x: s + x) - 2
