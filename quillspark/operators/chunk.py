"""Sentence-aware chunks with overlap, as a table function over Arrow batches."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from quillspark.functions.words import steps

_BREAK = re.compile(r"(?<=[.!?])\s+")


def approx_tokens(text: str) -> int:
    return max(len(text.split()), math.ceil(len(text) / 4))


def split_sentences(text: str) -> list[str]:
    return [s for s in (part.strip() for part in _BREAK.split(text)) if s]


@dataclass(frozen=True)
class Chunker:
    """size and overlap in approximate tokens; a last chunk under least joins the one before it."""

    size: int = 256
    overlap: int = 32
    least: int = 64

    def chunks(self, text: str | None) -> list[tuple[int, int, str]]:
        """(index, start offset, text). Sentences are never cut: one over size is a chunk by itself."""
        clean = (text or "").replace("\r\n", "\n").strip()
        sentences = split_sentences(clean)
        if not sentences:
            return []
        overlap = self.overlap if self.overlap < self.size else self.size // 4
        weight = [approx_tokens(s) for s in sentences]
        offsets, at = [], 0
        for s in sentences:
            at = clean.index(s, at)
            offsets.append(at)
            at += len(s)
        out: list[tuple[int, int, str]] = []

        def close(first: int, end: int) -> None:
            joined = " ".join(sentences[first:end])
            if out and approx_tokens(joined) < self.least:
                out[-1] = (*out[-1][:2], f"{out[-1][2]} {joined}")
            else:
                out.append((len(out), offsets[first], joined))

        first, load = 0, 0
        for i, w in enumerate(weight):
            if i > first and load + w > self.size:
                close(first, i)
                # whole sentences come back until they reach the overlap
                first, load = i, 0
                while first > 0 and load < overlap:
                    first -= 1
                    load += weight[first]
            load += w
        close(first, len(sentences))
        return out


def register_sql(spark: SparkSession, name: str = "chunk_text", chunker: Chunker = Chunker()) -> None:
    """Makes the chunker callable from SQL: select d.id, c.* from docs d, lateral chunk_text(d.text) c."""

    class Chunks:
        def eval(self, text: str):
            yield from chunker.chunks(text)

    spark.udtf.register(name, udtf(Chunks, returnType="chunk_index int, start_offset bigint, chunk string"))


def chunk_documents(docs: DataFrame, chunker: Chunker = Chunker(), id_col: str = "id", text_col: str = "text") -> DataFrame:
    """id, chunk_id (id#index), chunk_index, start_offset, chunk of every document; null and blank texts have none."""
    inner = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = inner.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # so much text at a time: a batch of long texts would be in memory several times over
        for batch in steps(batches, "text"):
            row, index, start, text = [], [], [], []
            for r, t in enumerate(batch.column(1).to_pylist()):
                for i, at, chunk in chunker.chunks(t):
                    row.append(r)
                    index.append(i)
                    start.append(at)
                    text.append(chunk)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), pa.array(index, pa.int32()), pa.array(start, pa.int64()), pa.array(text, pa.string())], names=["id", "chunk_index", "start_offset", "chunk"])

    out = inner.mapInArrow(run, f"id {kind}, chunk_index int, start_offset bigint, chunk string")
    return out.withColumn("chunk_id", F.concat_ws("#", F.col("id").cast("string"), F.col("chunk_index").cast("string")))
