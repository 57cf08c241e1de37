"""Best-fit packing of documents into bins of a fixed number of tokens, certified by lower bounds.

Each partition packs its documents by best-fit decreasing and compares the
number of bins with a bound from dual feasible functions. Partitions above
their bound exchange the documents of their bins that aren't full (a lone one
with a certified partition, another each round), and pack again, full bins'
documents staying in their partition; a round that doesn't lower the total is
undone. That ends when every partition is certified, nothing is left to
exchange with, or ROUNDS rounds in a row were undone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.frames import BROADCAST_BYTES, NOT_SPACE, cut, pieces, spans, utf8

CAPACITY, ROUNDS, DOCS_PER_PARTITION = 2048, 3, 50_000


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, int]:
    """The bin of each size by best-fit decreasing, and the number of bins.

    Of the bins with the least sufficient room the latest is taken; equal sizes
    go in their order. A bit set of the free rooms finds the least one.
    """
    order = np.argsort(-sizes, kind="stable")
    rooms: list[list[int]] = [[] for _ in range(capacity + 1)]
    free, bins, out = 0, 0, np.empty(len(sizes), np.int64)
    for i, size in zip(order.tolist(), sizes[order].tolist()):
        fit = free >> size
        if fit:
            room = size + (fit & -fit).bit_length() - 1
            stack = rooms[room]
            b = stack.pop()
            if not stack:
                free &= ~(1 << room)
        else:
            b, room, bins = bins, capacity, bins + 1
        out[i] = b
        if room > size:
            rooms[room - size].append(b)
            free |= 1 << (room - size)
    return out, bins


def lower_bound(sizes: np.ndarray, capacity: int) -> int:
    """Bins that any packing needs: the best bound over a family of dual feasible functions.

    For each threshold t up to half the capacity, sizes over capacity - t count
    as a whole bin, those from t as they are, those below t not at all; and
    the rounding functions floor((k + 1) x) / k, with exact multiples kept.
    """
    if not len(sizes):
        return 0
    count = np.bincount(sizes, minlength=capacity + 1).astype(np.int64)
    size = np.arange(capacity + 1, dtype=np.int64)
    mass, number = np.cumsum(count * size), np.cumsum(count)
    t = np.arange(0, capacity // 2 + 1)
    big = number[capacity] - number[capacity - t]
    middle = mass[capacity - t] - np.where(t > 0, mass[np.maximum(t - 1, 0)], 0)
    best = int((big + -(-middle // capacity)).max())
    for k in range(1, 21):
        whole = (k + 1) * size // capacity
        exact = (k + 1) * size % capacity == 0
        # in units of 1 / (k * capacity)
        worth = np.where(exact, k * size, whole * capacity)
        best = max(best, -(-int((count * worth).sum()) // (k * capacity)))
    return best


_BIN = "part bigint, bin bigint, doc_ids array<bigint>, start_tokens array<bigint>, sizes array<bigint>, n_tokens bigint, part_bins bigint, part_bound bigint"


def _pack(capacity: int):
    def run(group: pa.Table) -> pa.Table:
        part = int(group.column("part")[0].as_py())
        size = group.column("size").to_numpy()
        start = group.column("start").to_numpy()
        ids = group.column("id").combine_chunks()
        order = np.lexsort((start, np.asarray(ids.fill_null(-1)), size))
        size, start, ids = size[order], start[order], ids.take(pa.array(order))
        bins, n = best_fit(size, capacity)
        bound = lower_bound(size, capacity)
        turn = np.argsort(bins, kind="stable")
        offs = pa.array(np.concatenate([[0], np.cumsum(np.bincount(bins, minlength=n))]).astype(np.int32))
        lists = [pa.ListArray.from_arrays(offs, x) for x in (ids.take(pa.array(turn)), pa.array(start[turn]), pa.array(size[turn]))]
        fill = np.bincount(bins, size, n).astype(np.int64)
        return pa.table([pa.array(np.full(n, part)), pa.array(np.arange(n)), *lists, pa.array(fill), pa.array(np.full(n, n)), pa.array(np.full(n, bound))], names=["part", "bin", "doc_ids", "start_tokens", "sizes", "n_tokens", "part_bins", "part_bound"])

    return run


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens (runs of characters other than white space; null counts as none) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text"):
            _, _, heads = spans(*utf8(piece.column(1)), NOT_SPACE)
            yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(np.diff(heads))], names=["id", "n_tokens"])

    return docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id bigint, n_tokens bigint")


def _hot_ids(rows: DataFrame, per_partition: int) -> DataFrame | None:
    """Ids (null among them) that so many rows of one length have that they would fill a tenth of a partition; none in most tables."""
    counted = rows.groupBy("id", "n").agg(F.count("*").alias("rows")).where(F.col("rows") * 10 > per_partition)
    found = cut(counted.select(F.col("id").alias("q_id"), F.lit(True).alias("hot")).distinct())
    n = found.count()
    if not n:
        return None
    return F.broadcast(found) if n * 16 <= BROADCAST_BYTES else found


def _salted(rows: DataFrame, hot: DataFrame | None, salt: Column) -> DataFrame:
    """rows with a salt: the given one for hot ids, null for others."""
    if hot is None:
        return rows.withColumn("salt", F.lit(None).cast("bigint"))
    return rows.withColumn("own", salt).join(hot, F.col("id").eqNullSafe(F.col("q_id")), "left").withColumn("salt", F.when(F.col("hot"), F.col("own"))).drop("own", "q_id", "hot")


def pack(lengths: DataFrame, capacity: int = CAPACITY, rounds: int = ROUNDS, per_partition: int = DOCS_PER_PARTITION) -> DataFrame:
    """Bins of the documents in lengths (id, n_tokens): one row for each bin.

    part and bin name it; doc_ids, start_tokens and sizes list what it holds, by
    falling size; n_tokens is their sum; part_bins is the number of bins of its
    partition and part_bound a number that no packing of the same pieces can go
    below (equal: certified optimal; more bins than that: uncertified). rounds is
    the number of fruitless rounds of exchange in a row that end it. A document over capacity is cut into
    pieces of capacity, which fill a bin each, and a rest. Null lengths, and
    those of 0 or less, are in no bin; repeated rows are packed each; null ids
    stay null; an empty table has no bin. Other columns are not read, whatever
    their names. Any counts will do: those of encode_documents(), say, for bins
    of a model's own tokens.
    """
    rows = cut(lengths.select("id", F.col("n_tokens").cast("bigint").alias("n")).where("n > 0"))
    parts = max(1, -(-rows.count() // per_partition))
    hot = _hot_ids(rows, per_partition) if parts > 1 else None
    # a null adds nothing to a hash: only rows of a hot id are told apart, by their number; they are kept, so it stays
    part = F.pmod(F.xxhash64("id", "n", "salt"), F.lit(parts)) if parts > 1 else F.lit(0).cast("bigint")
    rows = _salted(rows, hot, F.monotonically_increasing_id()).withColumn("part", part).drop("salt")
    size = F.least(F.lit(capacity), F.col("n") - F.col("start"))
    items = rows.select("part", "id", "n", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1, F.lit(capacity).cast("bigint"))).alias("start")).select("part", "id", "start", size.alias("size"))
    bins = cut(items.groupBy("part").applyInArrow(_pack(capacity), _BIN))
    spark = lengths.sparkSession
    turn = idle = 0
    while idle < rounds:
        gaps = [r["part"] for r in bins.where("part_bins > part_bound").select("part").distinct().orderBy("part").collect()]
        chosen = F.col("part_bins") > F.col("part_bound")
        if len(gaps) == 1:
            others = [r["part"] for r in bins.where("part_bins = part_bound").select("part").distinct().orderBy("part").collect()]
            if others:
                gaps.append(others[turn % len(others)])
                chosen |= F.col("part") == gaps[1]
        if len(gaps) < 2:
            break
        names = spark.createDataFrame(list(enumerate(gaps)), "turn bigint, to bigint")
        names = F.broadcast(names) if len(gaps) * 16 <= BROADCAST_BYTES else names
        before = bins.where(chosen)
        held = before.select("part", "bin", (F.col("n_tokens") < capacity).alias("loose"), F.explode(F.arrays_zip("doc_ids", "start_tokens", "sizes")).alias("x"))
        held = held.select("part", "bin", "loose", F.col("x.doc_ids").alias("id"), F.col("x.start_tokens").alias("start"), F.col("x.sizes").alias("size"))
        held = _salted(held, hot, F.xxhash64("part", "bin")).withColumn("turn", F.pmod(F.xxhash64("id", "start", "size", F.lit(turn), "salt"), F.lit(len(gaps)))).join(names, "turn")
        held = held.select(F.when(F.col("loose"), F.col("to")).otherwise(F.col("part")).alias("part"), "id", "start", "size")
        after = cut(held.groupBy("part").applyInArrow(_pack(capacity), _BIN))
        turn += 1
        if after.count() < before.count():
            idle, bins = 0, bins.where(~chosen).unionByName(after)
            # the plan stays short
            bins = bins if turn % 8 else cut(bins)
        else:
            idle += 1
    return bins


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, rounds: int = ROUNDS, per_partition: int = DOCS_PER_PARTITION) -> DataFrame:
    """pack() of the texts' words at white space, which stand for tokens: see there.

    Null, empty and blank texts are in no bin, long ones are cut; repeated rows
    are packed each, an empty table has no bin, other columns are not read.
    """
    return pack(token_counts(docs, id_col, text_col), capacity, rounds, per_partition)
