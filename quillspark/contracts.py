"""What a storage, an index, an embedder and a language model must do to take part."""

from __future__ import annotations

from typing import Protocol, runtime_checkable

from pyspark.sql import DataFrame, Row

from quillspark.functions.embed import Embedder
from quillspark.functions.tokens import Tokenizer
from quillspark.operators.rag import Provider

__all__ = ["Embedder", "Index", "Provider", "Storage", "Tokenizer"]


@runtime_checkable
class Storage(Protocol):
    """Rows of id, vector, metadata and timestamp; the latest of an id counts. Collection is one."""

    def append(self, rows: DataFrame) -> None: ...

    def rows(self) -> DataFrame: ...

    def get(self, id_: str) -> Row | None: ...

    def get_batch(self, ids: list[str]) -> DataFrame: ...

    def delete(self, id_: str) -> bool: ...

    def filter(self, spec: dict | None) -> DataFrame: ...

    def count(self) -> int: ...

    def clear(self) -> None: ...


@runtime_checkable
class Index(Protocol):
    """Nearest rows of many queries, kept up as rows come and go. GraphIndex is one."""

    def build(self, rows: DataFrame, dimensions: int) -> None: ...

    def add(self, rows: DataFrame, removed: DataFrame | None = None) -> None: ...

    def search(self, queries: DataFrame, k: int) -> DataFrame: ...

    def stats(self) -> DataFrame: ...
