"""Budgets in a model's own tokens; four characters a token where there is no tokenizer."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


class Tokenizer(Protocol):
    """Texts in, numbers out, and back."""

    def encode(self, text: str) -> list[int]: ...

    def decode(self, tokens: list[int]) -> str: ...


class Characters:
    """The stand-in: a token for each four characters begun."""

    def encode(self, text: str) -> list[int]:
        return list(range(math.ceil(len(text) / 4)))

    def head(self, text: str, most: int) -> str:
        return text[: 4 * most]


class Subwords:
    """The tokenizer of a file that the public `tokenizers` library reads."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer as Read

        self.model = Read.from_file(path)

    def encode(self, text: str) -> list[int]:
        return self.model.encode(text, add_special_tokens=False).ids

    def decode(self, tokens: list[int]) -> str:
        return self.model.decode(tokens)

    def head(self, text: str, most: int) -> str:
        """The first tokens' text, cut from the text itself so that nothing is respelled."""
        spans = self.model.encode(text, add_special_tokens=False).offsets
        return text if len(spans) <= most else text[: spans[most - 1][1]] if most else ""


def subwords(path: str) -> Callable[[], object]:
    """A maker of Subwords, or of Characters where the file or the library is missing."""

    def make():
        try:
            return Subwords(path)
        except Exception:  # a budget in characters is better than no budget
            return Characters()

    return make


def count_tokens(make: Callable[[], Tokenizer]) -> Callable[[Column], Column]:
    """A function from text to its number of tokens, null for null; make() builds the tokenizer once in each worker."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make()
        for texts in batches:
            yield texts.map(lambda t: None if t is None else len(model.encode(t))).astype("Int64")

    return F.pandas_udf(run, "bigint")


def truncate_tokens(make: Callable[[], Tokenizer], most: int, suffix: str = "") -> Callable[[Column], Column]:
    """A function from text to its first `most` tokens, with the suffix where something was cut; null for null."""

    def cut(model, text: str | None) -> str | None:
        if text is None:
            return None
        if hasattr(model, "head"):
            head = model.head(text, most)
        else:
            tokens = model.encode(text)
            head = text if len(tokens) <= most else model.decode(tokens[:most])
        return text if head == text else head + suffix

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make()
        for texts in batches:
            yield texts.map(lambda t: cut(model, t))

    return F.pandas_udf(run, "string")
