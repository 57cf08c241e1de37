"""What the operators share: Arrow text as numpy bytes, word hashes, sized broadcasts."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast only up to this size, counted before; beyond it the join shuffles.
BROADCAST_BYTES = 32 << 20
#: Text that one numpy step holds at a time; a longer single document is a step of its own.
PIECE_BYTES = 4 << 20

_U = np.uint64
RADIX = _U(0x9E3779B97F4A7C15)
INVERSE_RADIX = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


_BYTE = mix((np.arange(256, dtype=_U) + _U(1)) * RADIX)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from the session; set here only where it is unset and all runs on this machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if not found:
        found = context.getCheckpointDir()
    if not found and context.master.split("[")[0] != "local":
        raise RuntimeError("a cluster needs spark.checkpoint.dir, a folder that all executors share")
    if not found:
        found = os.path.join(tempfile.gettempdir(), "quillspark-checkpoints")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(found)
    return found


def cut(df: DataFrame) -> DataFrame:
    """The same rows, computed once and kept in the shared folder, so that lost executors cost nothing before it."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def sized(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """df (already cut) hinted for broadcast if its counted size is within limit, else as it is."""
    return F.broadcast(df) if df.count() * row_bytes <= limit else df


def pieces(batches: Iterable[pa.RecordBatch], text: str, most: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Each batch in slices of at most so many bytes of text, one row at least."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        size = np.asarray(pc.fill_null(pc.binary_length(batch.column(text)), 0), dtype=np.int64)
        total = np.cumsum(size)
        at = 0
        while at < n:
            base = total[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(total, base + most, "right")))
            yield batch.slice(at, to - at)
            at = to


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in a row and the offset of each; null counts as empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, where, data = column.buffers()
    offs = np.frombuffer(where, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None and offs[-1] > offs[0] else np.zeros(0, np.uint8)
    return raw, offs - offs[0]


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def fold(buf: np.ndarray) -> np.ndarray:
    """Lower case byte for byte, so that offsets stay: ASCII, Latin-1, Greek and Cyrillic capitals."""
    out = _LOWER[buf]
    if len(buf) < 2 or not (buf >= 0xC3).any():
        return out
    lead, low = buf[:-1], buf[1:]
    after = out[1:]
    after[(lead == 0xC3) & (low >= 0x80) & (low <= 0x9E) & (low != 0x97)] += 0x20
    after[((lead == 0xCE) & (low >= 0x91) & (low <= 0x9F)) | ((lead == 0xD0) & (low >= 0x90) & (low <= 0x9F))] += 0x20
    for first, lo, hi, to in ((0xCE, 0xA0, 0xA9, 0xCF), (0xD0, 0xA0, 0xAF, 0xD1)):
        at = np.flatnonzero((lead == first) & (low >= lo) & (low <= hi))
        out[at] = to
        out[at + 1] = buf[at + 1] - 0x20
    return out


NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[9, 10, 11, 12, 13, 32]] = False
#: Letters, digits and every byte of a character beyond ASCII.
WORD_BYTE = np.zeros(256, bool)
WORD_BYTE[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def spans(buf: np.ndarray, offs: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words (runs of bytes in table), and the first word of each text (one more at the end). No word crosses texts."""
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    is_in = table[buf]
    first = is_in.copy()
    first[1:] &= ~is_in[:-1]
    last = is_in.copy()
    last[:-1] &= ~is_in[1:]
    heads = offs[:-1][offs[:-1] < offs[1:]]
    first[heads] = is_in[heads]
    tails = heads[heads > 0] - 1
    last[tails] = is_in[tails]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offs)


_POWERS = np.ones(1, _U)


def powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        _POWERS = np.full(max(n, 2 * len(_POWERS)), RADIX, _U)
        _POWERS[0] = 1
        np.multiply.accumulate(_POWERS, out=_POWERS)
    return _POWERS[:n]


def hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every span of bytes."""
    if not len(starts):
        return np.zeros(0, _U)
    size = ends - starts
    at = np.cumsum(size) - size
    within = np.arange(int(size.sum())) - np.repeat(at, size)
    values = _BYTE[buf[np.repeat(starts, size) + within]]
    values *= powers(int(size.max()))[within]
    # reduceat would copy the next element of an empty span
    return mix(np.where(size > 0, np.add.reduceat(values, np.minimum(at, max(len(values) - 1, 0))), _U(0)) + size.astype(_U)) if len(values) else mix(size.astype(_U))


def rolling(values: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each k consecutive values; as many as there are values, those at the end not meaningful."""
    n = len(values)
    if n < k:
        return np.zeros(n, _U)
    up = np.full(n, RADIX, _U)
    down = np.full(n, INVERSE_RADIX, _U)
    up[0] = down[0] = 1
    np.multiply.accumulate(up, out=up)
    np.multiply.accumulate(down, out=down)
    total = np.concatenate([np.zeros(1, _U), np.cumsum(values * up, dtype=_U)])
    out = np.zeros(n, _U)
    out[: n - k + 1] = mix((total[k:] - total[:-k]) * down[: n - k + 1])
    return out


def table(batch: pa.RecordBatch, names: list[str], **columns) -> pa.RecordBatch:
    """The named columns of batch and then new ones."""
    arrays = [batch.column(n) for n in names] + [c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c) for c in columns.values()]
    return pa.RecordBatch.from_arrays(arrays, names=[*names, *columns])


def filter_rows(docs: DataFrame, text: str, keeps) -> DataFrame:
    """The rows of docs whose text keeps(bytes, offsets) holds for; all columns pass as they are, whatever their names."""
    names = docs.columns
    at = next(i for i, n in enumerate(names) if n == text)
    inner = docs.toDF(*[f"c{i}" for i in range(len(names))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, f"c{at}"):
            yield piece.filter(pa.array(np.asarray(keeps(*utf8(piece.column(at))), dtype=bool)))

    return inner.mapInArrow(run, inner.schema).toDF(*names)
