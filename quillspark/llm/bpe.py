"""Byte-level BPE over padded numpy matrices, and back.

A text is split by the vocabulary's pattern. The distinct pieces of a batch
that aren't known yet are laid out as matrices of symbols, one for each length
class; each round every row merges its leftmost pair of least rank, found in a
hash table of pairs, and rows without a pair leave the matrix. The row's further
pairs of that rank, which come next unless a merge makes a pair of a lower one,
are merged in the same round; a row where one does goes back to the leftmost.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.frames import mix, pieces, utf8

#: Where the public rank file is on the driver's machine; executors without it get a copy.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
STEP_BYTES = 2 << 20
#: Symbols of a matrix, unless one row alone has more.
MATRIX_CELLS = 8 << 20
#: Pieces kept between batches of a task; a memory bound, the result doesn't depend on it.
KNOWN_PIECES = 300_000
_NONE = np.int32(2**31 - 1)
_U = np.uint64


class Pairs:
    """A hash table in numpy from pairs of symbols to the rank of what they merge into."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray):
        key = (left.astype(_U) << _U(32)) | right.astype(_U)
        bits = max(10, int(4 * len(key)).bit_length())
        self.mask = _U((1 << bits) - 1)
        self.keys = np.full(1 << bits, _U(2**64 - 1))
        self.ranks = np.full(1 << bits, _NONE, np.int32)
        rest, at = np.arange(len(key)), mix(key) & self.mask
        while len(rest):
            free = self.keys[at[rest]] == _U(2**64 - 1)
            first = rest[free][np.unique(at[rest[free]], return_index=True)[1]]
            self.keys[at[first]] = key[first]
            self.ranks[at[first]] = rank[first]
            rest = rest[~np.isin(rest, first)]
            at[rest] = (at[rest] + _U(1)) & self.mask

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of every pair, _NONE where they don't merge."""
        key = (left.astype(_U) << _U(32)) | (right.astype(_U) & _U(0xFFFFFFFF))
        at = mix(key) & self.mask
        held = self.keys[at]
        out = np.where(held == key, self.ranks[at], _NONE)
        rest = np.flatnonzero((held != key) & (held != _U(2**64 - 1)))
        while len(rest):
            at[rest] = (at[rest] + _U(1)) & self.mask
            held = self.keys[at[rest]]
            same = held == key[rest]
            out[rest[same]] = self.ranks[at[rest[same]]]
            rest = rest[~same & (held != _U(2**64 - 1))]
        return out


class ByteBPE:
    """Encoder and decoder of one rank file (base64 of a token and its rank on each line)."""

    def __init__(self, path: str, pattern: str = PATTERN):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.pattern = regex.compile(pattern)
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        merges = [(ranks[t[:i]], ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        self.pairs = Pairs(*(np.array(c, np.int64) for c in zip(*merges)))
        size = np.zeros(max(ranks.values()) + 1, np.int64)
        for t, r in ranks.items():
            size[r] = len(t)
        self.ends = np.cumsum(size)
        self.sizes = size
        flat = bytearray(int(self.ends[-1]))
        for t, r in ranks.items():
            flat[self.ends[r] - len(t) : self.ends[r]] = t
        self.flat = np.frombuffer(bytes(flat), np.uint8)

    def merge(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of all rows (-1: padding) after their merges, and how many each row has."""
        n, w = rows.shape
        out = np.full((n, w), -1, np.int32)
        live = np.arange(n)
        rank = np.full((n, w), _NONE, np.int32)
        if w > 1:
            real = np.nonzero(rows[:, 1:] >= 0)
            rank[real] = self.pairs.find(rows[:, :-1][real], rows[:, 1:][real])
        while True:
            least = rank.min(1)
            done = least == _NONE
            if done.any():
                out[live[done], : rows.shape[1]] = rows[done]
                go = ~done
                rows, rank, live, least = rows[go], rank[go], live[go], least[go]
            if not len(rows):
                break
            r, c = np.nonzero(rank == least[:, None])
            # of pairs that overlap every second one from the left
            new = np.ones(len(r), bool)
            new[1:] = (r[1:] != r[:-1]) | (c[1:] != c[:-1] + 1)
            head = np.flatnonzero(new)
            take = (np.arange(len(r)) - head[np.cumsum(new) - 1]) % 2 == 0
            r, c = r[take], c[take]
            packed, ranks, lower = self._round(rows, rank, least, r, c)
            if lower.any():
                back = np.flatnonzero(lower)
                one, one_rank, _ = self._round(rows[back], rank[back], least[back], np.arange(len(back)), rank[back].argmin(1))
                if one.shape[1] > packed.shape[1]:
                    more = ((0, 0), (0, one.shape[1] - packed.shape[1]))
                    packed, ranks = np.pad(packed, more, constant_values=-1), np.pad(ranks, more, constant_values=_NONE)
                packed[back], ranks[back] = -1, _NONE
                packed[back, : one.shape[1]], ranks[back, : one.shape[1]] = one, one_rank
            rows, rank = packed, ranks
        return out, (out >= 0).sum(1)

    def _round(self, rows: np.ndarray, rank: np.ndarray, least: np.ndarray, r: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """rows and ranks with the pairs at (r, c), in order, merged; and the rows with several where a merge makes a pair below their rank."""
        lower = np.zeros(len(rows), bool)
        # a merge beside the next one: for a while the pair between them is there
        beside = np.flatnonzero((r[1:] == r[:-1]) & (c[1:] == c[:-1] + 2))
        lower[r[beside]] = self.pairs.find(least[r[beside]], rows[r[beside], c[beside] + 2]) < least[r[beside]]
        rows = rows.copy()
        rows[r, c] = least[r]
        # compaction: the right symbol of each pair goes, what follows moves up
        keep = rows >= 0
        keep[r, c + 1] = False
        size = keep.sum(1)
        width = int(size.max())
        inside = np.arange(width) < size[:, None]
        packed, ranks = np.full((len(rows), width), -1, np.int32), np.full((len(rows), width), _NONE, np.int32)
        packed[inside], ranks[inside] = rows[keep], rank[keep]
        # new neighbours on either side of what was merged: a place less for each merge before it in its row
        first = np.searchsorted(r, np.arange(len(rows)))
        at = c - (np.arange(len(r)) - first[r])
        ranks[r, at] = _NONE
        for near in (at - 1, at):
            ok = np.flatnonzero((near >= 0) & (near + 1 < size[r]))
            own, place = r[ok], near[ok]
            ranks[own, place] = found = self.pairs.find(packed[own, place], packed[own, place + 1])
            lower[own[found < least[own]]] = True
        return packed, ranks, lower & (np.bincount(r, minlength=len(rows)) > 1)

    def encode_pieces(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of all words in a row, and how many each has."""
        raw = [w.encode() for w in words]
        size = np.array([len(x) for x in raw], np.int64)
        buf = self.single[np.frombuffer(b"".join(raw), np.uint8)]
        ends = np.cumsum(size)
        count = np.zeros(len(raw), np.int64)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        width, low = 4, 0
        while low < int(size.max(initial=0)):
            every = np.flatnonzero((size > low) & (size <= width))
            # rows of a class of long pieces a few at a time
            for a in range(0, len(every), most := max(1, MATRIX_CELLS // width)):
                own = every[a : a + most]
                rows = np.full((len(own), width), -1, np.int32)
                inside = np.arange(width) < size[own][:, None]
                rows[inside] = buf[(ends[own] - size[own]).repeat(size[own]) + np.nonzero(inside)[1]]
                out, n = self.merge(rows)
                count[own] = n
                found.append((own, out[out >= 0]))
            low, width = width, width * 2
        to = np.cumsum(count) - count
        flat = np.empty(int(count.sum()), np.int32)
        for own, tokens in found:
            n = count[own]
            flat[np.repeat(to[own] - (np.cumsum(n) - n), n) + np.arange(len(tokens))] = tokens
        return flat, count

    def known(self, tokens: np.ndarray) -> np.ndarray:
        """Which numbers are tokens."""
        inside = (tokens >= 0) & (tokens < len(self.sizes))
        return inside & (self.sizes[np.where(inside, tokens, 0)] > 0)

    def decode(self, tokens: np.ndarray) -> bytes:
        """The bytes of tokens in a row; all must be known()."""
        size = self.sizes[tokens]
        at = np.repeat(self.ends[tokens] - np.cumsum(size), size) + np.arange(int(size.sum()))
        return self.flat[at].tobytes()


@lru_cache(maxsize=4)
def load(path: str = VOCABULARY, pattern: str = PATTERN) -> ByteBPE:
    """The vocabulary at that path, or the copy of it that ship() sent to this worker."""
    return ByteBPE(path if os.path.exists(path) else SparkFiles.get(os.path.basename(path)), pattern)


def ship(spark: SparkSession, path: str) -> None:
    """Sends a vocabulary of the driver's machine to all executors, once."""
    if os.path.exists(path) and os.path.basename(path) not in {f.rsplit("/", 1)[-1] for f in spark.sparkContext.listFiles}:
        spark.sparkContext.addFile(path)


class Known:
    """Pieces already encoded, by number."""

    def __init__(self, bpe: ByteBPE):
        self.bpe = bpe
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.flat = [np.zeros(0, np.int32)]
        self.count = [np.zeros(0, np.int64)]

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of all texts in a row, and how many each has; null counts as empty."""
        if len(self.number) > KNOWN_PIECES:
            self.clear()
        split = self.bpe.pattern.findall
        words = [split(t) if t else [] for t in texts]
        number = self.number
        new = [w for w in dict.fromkeys(chain.from_iterable(words)) if w not in number]
        if new:
            number.update(zip(new, range(len(number), len(number) + len(new))))
            flat, count = self.bpe.encode_pieces(new)
            self.flat, self.count = [np.concatenate([*self.flat, flat])], [np.concatenate([*self.count, count])]
        per = np.array([len(ws) for ws in words], np.int64)
        ids = np.fromiter(map(number.__getitem__, chain.from_iterable(words)), np.int64, int(per.sum()))
        flat, count = self.flat[0], self.count[0]
        begin = np.cumsum(count) - count
        n = count[ids]
        total = np.cumsum(n)
        tokens = flat[np.repeat(begin[ids] - (total - n), n) + np.arange(int(n.sum()))]
        edge = np.concatenate([[0], total])[np.concatenate([[0], np.cumsum(per)])]
        return tokens, np.diff(edge)


def encode_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """One row for each input row: id, tokens, n_tokens, exact.

    exact says that the tokens decode to the very bytes of the text. A null text
    has null tokens and n_tokens 0, an empty one no tokens. Nothing is special:
    marks such as <|endoftext|> are ordinary text. Null ids and repeated rows
    pass through, an empty table gives no row, other columns are not read,
    whatever their names. Texts and pieces of any length go the same way.
    """
    ship(docs.sparkSession, vocabulary)
    inner = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = inner.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(vocabulary, pattern)
        known = Known(bpe)
        for piece in pieces(batches, "text", STEP_BYTES):
            texts = piece.column(1)
            tokens, count = known.encode(texts.to_pylist())
            offs = np.concatenate([[0], np.cumsum(count)]).astype(np.int32)
            mask = texts.is_null() if texts.null_count else None
            buf, where = utf8(texts)
            back = np.frombuffer(bpe.decode(tokens), np.uint8)
            exact = np.ones(len(count), bool)
            ends = np.concatenate([[0], np.cumsum(bpe.sizes[tokens])])[offs]
            if not (len(back) == len(buf) and (ends == where).all() and (back == buf).all()):
                exact = np.array([ends[i + 1] - ends[i] == where[i + 1] - where[i] and (back[ends[i] : ends[i + 1]] == buf[where[i] : where[i + 1]]).all() for i in range(len(count))])
            lists = pa.ListArray.from_arrays(pa.array(offs), pa.array(tokens), mask=mask)
            yield pa.RecordBatch.from_arrays([piece.column(0), lists, pa.array(count), pa.array(exact)], names=["id", "tokens", "n_tokens", "exact"])

    return inner.mapInArrow(run, f"id {kind}, tokens array<int>, n_tokens bigint, exact boolean").withColumnRenamed("id", id_col)


def _text(bpe: ByteBPE, tokens: list[int | None]) -> str:
    numbers = np.array([-1 if t is None else t for t in tokens], np.int64)
    real = bpe.known(numbers)
    if real.all():
        return bpe.decode(numbers).decode("utf-8", "replace")
    # the mark stands between whole stretches of bytes
    edge = np.flatnonzero(~real)
    parts = [numbers[a:b] for a, b in zip(np.append(0, edge + 1), np.append(edge, len(numbers)))]
    return "\ufffd".join(bpe.decode(p).decode("utf-8", "replace") for p in parts)


def decode_documents(tokens: DataFrame, id_col: str = "doc_id", tokens_col: str = "tokens", vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """id, text of token lists, one row for each input row.

    Null lists give null, empty ones an empty text, bytes that aren't UTF-8 a
    replacement character; so does each null, and each number that is no token
    of the vocabulary. Null ids and repeated rows pass through, an empty table
    gives no row, other columns are not read.
    """
    ship(tokens.sparkSession, vocabulary)
    inner = tokens.select(F.col(id_col).alias("id"), F.col(tokens_col).cast("array<int>").alias("tokens"))
    kind = inner.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(vocabulary, pattern)
        for batch in batches:
            texts = [None if t is None else _text(bpe, t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["id", "text"])

    return inner.mapInArrow(run, f"id {kind}, text string").withColumnRenamed("id", id_col)
