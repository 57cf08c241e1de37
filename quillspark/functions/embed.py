"""Embeddings without a model file, and the contract that a model fulfils."""

import math
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.errors import DimensionMismatch
from quillspark.functions import vectors
from quillspark.functions.bind import let
from quillspark.functions.text import string_hash


class Embedder(Protocol):
    """Texts in, vectors of `dimensions` out, a batch at a time."""

    dimensions: int

    def embed(self, texts: list[str]) -> list[list[float]]: ...


def hash_embedding(text: Column, dimensions: int = 64) -> Column:
    """sin(hash + i) / 2 for each component i, to length 1: the same text, the same vector."""
    raw = let(string_hash(text), lambda h: F.transform(F.sequence(F.lit(0), F.lit(dimensions - 1)), lambda i: F.sin((h + i).cast("double")) * 0.5))
    return let(raw, vectors.normalise)


class HashEmbedder:
    """hash_embedding() as an Embedder: no model, the same text always the same vector."""

    def __init__(self, dimensions: int = 64):
        self.dimensions = dimensions

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = []
        for text in texts:
            h = 0
            for c in text:
                h = (h * 31 + ord(c)) % 2**32
            h = h - 2**32 if h >= 2**31 else h
            raw = [math.sin(float(h + i)) * 0.5 for i in range(self.dimensions)]
            length = math.sqrt(sum(x * x for x in raw))
            out.append([x / length if length else x for x in raw])
        return out


def vectors_of(output, dimensions: int | None = None) -> list[list[float]]:
    """What a model gives for a batch, as one vector a text: one vector alone, a list of them, token states (pooled by their mean), or {"data", "dims"} of a flat array."""
    if isinstance(output, dict):
        output = np.asarray(output["data"], np.float64).reshape(output["dims"])
    x = np.asarray(output, np.float64)
    if x.ndim == 1:
        x = x.reshape(-1, dimensions or len(x))
    if x.ndim == 3:
        x = x.mean(axis=1)
    if x.ndim != 2 or (dimensions and x.shape[1] != dimensions):
        raise DimensionMismatch(dimensions or 0, x.shape[-1])
    return x.tolist()


def mean_pool(states: Column, tokens: int, width: int) -> Column:
    """The mean over tokens of a flat [tokens, width] array, to length 1."""
    mean = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda j: F.aggregate(F.transform(F.sequence(F.lit(0), F.lit(tokens - 1)), lambda t: F.element_at(states, (t * width + j + 1).cast("int")).cast("double")), F.lit(0.0), lambda s, x: s + x) / tokens)
    return vectors.normalise(mean)


def byte_embedding(data: Column, dimensions: int = 64) -> Column:
    """The share of bytes at each position modulo the dimensions, for images without a model; length 1."""
    codes = F.filter(F.split(F.hex(data), "(?<=\\G..)"), lambda x: x != "")
    values = F.transform(codes, lambda x: F.conv(x, 16, 10).cast("double") / 255)
    return vectors.normalise(F.transform(F.sequence(F.lit(0), F.lit(dimensions - 1)), lambda i: F.coalesce(F.aggregate(F.filter(F.transform(values, lambda v, j: F.when(j % dimensions == i, v)), lambda v: v.isNotNull()), F.lit(0.0), lambda s, v: s + v), F.lit(0.0))))


def images(spark: SparkSession, folder: str, pattern: str = "*.{png,jpg,jpeg,gif,webp,bmp}") -> DataFrame:
    """path and content of the image files under a folder, for model_udf(..., from_bytes=True) or byte_embedding()."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder).select("path", "content")


def model_udf(make, dimensions: int, from_bytes: bool = False):
    """A pandas UDF from text (or the bytes of images) to vectors; make() builds the Embedder once in each worker.

    A model of both texts and images gives one UDF of each kind, so that either
    is searched with the other's vectors.
    """

    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make()
        if model.dimensions != dimensions:
            raise DimensionMismatch(dimensions, model.dimensions)
        for texts in batches:
            given = [b"" if x is None else bytes(x) for x in texts] if from_bytes else texts.fillna("").tolist()
            yield pd.Series(list(model.embed(given)))

    return F.pandas_udf(embed, "array<float>")
