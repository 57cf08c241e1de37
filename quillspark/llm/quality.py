"""Quality rules from a suffix array: how much of a text repeats itself.

Every text gets a suffix array over its characters. Intervals of the common
prefixes of at least `min_length` are its repeated substrings; the union of
their spans, copies and originals alike, is the covered part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.frames import filter_rows, pieces, table, utf8
from quillspark.llm.suffix import common_prefixes, suffix_array

MIN_LENGTH, MAX_FRACTION, MAX_LONGEST = 50, 0.3, 500
#: Text for one suffix array; it takes some 60 bytes for each byte.
STEP_BYTES = 1 << 20


def repetition(buf: np.ndarray, offs: np.ndarray, least: int = MIN_LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each text its characters, those inside repeated substrings of at least `least`, and the longest repeat (0: none that long)."""
    docs = len(offs) - 1
    points = np.frombuffer(buf.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    heads = np.zeros(len(buf) + 1, np.int32)
    np.cumsum((buf & 0xC0) != 0x80, out=heads[1:])
    ends = heads[offs].astype(np.int64)
    chars = np.diff(ends)
    seen = np.zeros(int(points.max(initial=0)) + 1, np.uint32)
    seen[points] = 1
    ranks = np.cumsum(seen, dtype=np.uint32)
    n = len(points) + docs
    owner = np.repeat(np.arange(docs), chars + 1)
    stops = ends[1:] + np.arange(docs)
    symbols = np.zeros(n + 64, np.uint32)
    inside = np.ones(n, bool)
    inside[stops] = False
    symbols[:n][inside] = ranks[points]
    bits = max(1, int(ranks[-1] if len(ranks) else 1).bit_length())
    depth = max(1, min((64 - docs.bit_length()) // bits, least, 60))
    key = owner.astype(np.uint64)
    for j in range(depth):
        key <<= np.uint64(bits)
        key |= symbols[j : j + n]
    order, split = suffix_array(key, depth)
    symbols = symbols[:n]
    lcp = common_prefixes(symbols, order, split, least)
    longest = np.zeros(docs, np.int64)
    covered = np.zeros(docs, np.int64)
    hit = np.flatnonzero(lcp)
    if len(hit):
        np.maximum.at(longest, owner[order[hit]], lcp[hit])
        edge = np.zeros(n + 1, np.int32)
        for place in (order[hit], order[hit - 1]):
            np.add.at(edge, place, 1)
            np.add.at(edge, place + lcp[hit], -1)
        covered = np.add.reduceat((np.cumsum(edge[:n]) > 0).astype(np.int64), stops - chars)
    return chars, covered, longest


def repetition_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH, max_fraction: float = MAX_FRACTION, max_longest: int = MAX_LONGEST) -> DataFrame:
    """One row for each input row: id, n_chars, covered_chars, longest_repeat, keep.

    A text is kept if the characters inside repeated substrings (min_length at
    least, overlapping repeats included) are at most max_fraction of it and its
    longest repeat is at most max_longest. A null text counts as empty; an empty
    or short text has no repeat and is kept. Null ids pass through; repeated
    rows are judged each by itself; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text", STEP_BYTES):
            chars, covered, longest = repetition(*utf8(piece.column(1)), min_length)
            yield table(piece, ["id"], n_chars=chars, covered_chars=covered, longest_repeat=longest, keep=(covered <= max_fraction * chars) & (longest <= max_longest))

    inner = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = inner.schema["id"].dataType.simpleString()
    out = inner.mapInArrow(run, f"id {kind}, n_chars bigint, covered_chars bigint, longest_repeat bigint, keep boolean")
    return out.withColumnRenamed("id", id_col)


def keep_unrepetitive(docs: DataFrame, text_col: str = "text", min_length: int = MIN_LENGTH, max_fraction: float = MAX_FRACTION, max_longest: int = MAX_LONGEST) -> DataFrame:
    """The rows that repetition_report() keeps, all columns unchanged whatever their names; no shuffle.

    Null, empty and short texts stay, repeated rows are judged each by itself,
    an empty table stays empty.
    """

    def keeps(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
        out, at = np.ones(len(offs) - 1, bool), 0
        while at < len(out):
            to = max(at + 1, int(np.searchsorted(offs, offs[at] + STEP_BYTES, "right")) - 1)
            chars, covered, longest = repetition(buf[offs[at] : offs[to]], offs[at : to + 1] - offs[at], min_length)
            out[at:to] = (covered <= max_fraction * chars) & (longest <= max_longest)
            at = to
        return out

    return filter_rows(docs, text_col, keeps)
