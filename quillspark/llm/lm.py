"""Prediction by partial matching: the code length of every document under a byte-context trie.

The trie holds, for every context of 0 to `order` bytes, how often each byte
follows it in the whole corpus. A byte is coded in its longest known context;
where the context hasn't seen it, an escape (method C: as likely as the context
has distinct followers) leads to the context a byte shorter, in which the
symbols already escaped from are excluded.

score() takes each document's own counts off the corpus's first, so that no
document is scored by what it alone says, and a copy still tells of the other.
The trie never has to fit a worker: documents travel in batches of consecutive
rows, a batch asks for the contexts it has, buckets of contexts add up all
batches' counts and send each batch the part of the trie that it asked for.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.frames import mix, pieces, shared_dir, utf8

ORDER = 4
#: Text that is coded at a time, text of a batch, and text whose contexts make a bucket: how the work is cut, not what it gives.
STEP_BYTES, BATCH_BYTES, BUCKET_BYTES = 2 << 20, 32 << 20, 32 << 20
MOST_TASKS = 20_000
_U = np.uint64
_TAG = _U(56)


def _mask(nbytes: int) -> np.uint64:
    return _U((1 << (8 * nbytes)) - 1)


def grams(buf: np.ndarray, offs: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Each byte (lowest) behind its `order` bytes before it, the nearest highest (0 before the start), and its text."""
    size = np.diff(offs)
    docs = len(size)
    padded = np.zeros(len(buf) + docs * order + order, np.uint8)
    owner = np.repeat(np.arange(docs, dtype=_U), size)
    at = np.arange(len(buf)) + owner.astype(np.int64) * order + order
    padded[at] = buf
    key = np.zeros(len(padded), _U)
    for j in range(1, order + 1):
        key[j:] |= padded[:-j].astype(_U) << _U(8 * (order - j + 1))
    key |= padded
    return key[at], owner


def shorter(key: np.ndarray, by: int) -> np.ndarray:
    """Grams with a context `by` bytes shorter; what lies above the gram stays above it."""
    return ((key >> _U(8 * (by + 1))) << _U(8)) | (key & _U(0xFF)) if by else key


def _runs(sorted_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of a sorted array and how often each comes."""
    if not len(sorted_):
        return sorted_, np.zeros(0, np.int64)
    head = np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]]))
    return sorted_[head], np.diff(np.append(head, len(sorted_)))


def _added(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and their counts added up."""
    turn = np.argsort(keys)
    keys, counts = keys[turn], counts[turn]
    if not len(keys):
        return keys, counts
    head = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[head], np.add.reduceat(counts, head)


def _ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each range, one range after the other."""
    return np.repeat(start - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))


def _place(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each key is in a sorted table, and whether it is there."""
    if not len(table):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return at, table[at] == keys


def edges_of(gram: np.ndarray, counts: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """The edges of all orders that distinct grams of the highest stand for, tagged by their order above the context, and their counts."""
    keys, found = [], []
    for k in range(order, -1, -1):
        keys.append(gram | (_U(k) << _TAG))
        found.append(counts)
        if k:
            gram, counts = _added(shorter(gram, 1), counts)
    return np.concatenate(keys[::-1]), np.concatenate(found[::-1])


class Trie:
    """Edges by order (reversed context and follower as one number, sorted), their counts, and the sums of their nodes."""

    def __init__(self, tagged: np.ndarray, counts: np.ndarray, order: int):
        """tagged: sorted, each once."""
        self.order = order
        self.edges, self.seen, self.node, self.parent = [], [], [], []
        self.nodes, self.total, self.distinct, self.excluded = [], [], [], []
        edge = np.searchsorted(tagged, np.arange(order + 2, dtype=_U) << _TAG)
        for k in range(order + 1):
            e = tagged[edge[k] : edge[k + 1]] & _mask(7)
            c = counts[edge[k] : edge[k + 1]].astype(np.float64)
            node, size = _runs(e >> _U(8))
            first = np.cumsum(size) - size
            parent = np.searchsorted(self.edges[k - 1], shorter(e, 1)) if k else np.zeros(0, np.int64)
            self.edges.append(e)
            self.seen.append(c)
            self.parent.append(parent)
            self.nodes.append(node)
            self.node.append(np.repeat(np.arange(len(node)), size))
            self.distinct.append(size.astype(np.float64))
            self.total.append(np.add.reduceat(c, first) if len(c) else np.zeros(0))
            self.excluded.append(np.add.reduceat(self.seen[k - 1][parent], first) if k and len(c) else np.zeros(len(node)))

    def cost_of(self, gram: np.ndarray) -> np.ndarray:
        """Bits of each gram's last byte after the bytes before it, under the counts as they are."""
        bits = np.zeros(len(gram))
        rest = np.arange(len(gram))
        # of the context escaped from: how much of the next one's count it excludes
        cut_total, cut_distinct = np.zeros(len(gram)), np.zeros(len(gram))
        for k in range(self.order, -1, -1):
            if not len(rest):
                break
            key = shorter(gram[rest], self.order - k)
            node, known = _place(self.nodes[k], key >> _U(8))
            at, hit = _place(self.edges[k], key)
            n, r, found = node[known], rest[known], hit[known]
            distinct = self.distinct[k][n] - cut_distinct[r]
            mass = self.total[k][n] - cut_total[r] + distinct
            bits[r[found]] += np.log2(mass[found]) - np.log2(self.seen[k][at[known][found]])
            on = ~found & (distinct > 0)
            bits[r[on]] += np.log2(mass[on]) - np.log2(distinct[on])
            cut_total[r], cut_distinct[r] = self.excluded[k][n], self.distinct[k][n]
            rest = rest[~hit]
        bits[rest] += np.log2(256 - cut_distinct[rest])
        return bits

    def bits(self, buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """The code length of each text."""
        gram, owner = grams(buf, offs, self.order)
        free = _U(64 - 8 * (self.order + 1))
        both, n = _runs(np.sort((gram << free) | owner))
        key, per = _runs(both >> free)
        return np.bincount((both & ((_U(1) << free) - _U(1))).astype(np.int64), n * np.repeat(self.cost_of(key), per), len(offs) - 1)

    def bits_without_own(self, buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """The code length of each text under the counts of all others; the trie must hold the text's own counts."""
        own = _Own(self, *grams(buf, offs, self.order))
        return own.bits(len(offs) - 1)


class _Own:
    """What each text of a piece has itself of the trie's edges, and its code length without that.

    Edges of all orders are numbers of (text, reversed context, follower), so
    that the edges of one text's node, and of its text's next shorter node, lie
    together.
    """

    def __init__(self, trie: Trie, gram: np.ndarray, owner: np.ndarray):
        self.trie, top = trie, trie.order
        self.keys, self.counts, self.heads, self.nodes = [], [], [], []
        whole = (owner << _U(8 * (top + 1))) | gram
        for k in range(top + 1):
            key, n = _runs(np.sort(shorter(whole, top - k)))
            node, size = _runs(key >> _U(8))
            self.keys.append(key)
            self.counts.append(n.astype(np.float64))
            self.nodes.append(node)
            self.heads.append(np.append(0, np.cumsum(size)))

    def _facts(self, k: int, nodes: np.ndarray) -> dict[str, np.ndarray]:
        """Of some of the texts' nodes (by number): their edges, and total and distinct followers without the text's own."""
        trie = self.trie
        size = self.heads[k][nodes + 1] - self.heads[k][nodes]
        edge = _ranges(self.heads[k][nodes], size)
        first = np.cumsum(size) - size
        n = self.counts[k][edge]
        at = np.searchsorted(trie.edges[k], self.keys[k][edge] & _mask(k + 1))
        left = trie.seen[k][at] - n
        where = trie.node[k][at[first]]
        gone = left <= 0
        total = trie.total[k][where] - np.add.reduceat(n, first)
        distinct = trie.distinct[k][where] - np.add.reduceat(gone.astype(np.float64), first)
        return {"edge": edge, "first": first, "size": size, "at": at, "left": left, "gone": gone, "where": where, "total": total, "distinct": distinct}

    def _excluded(self, k: int, nodes: np.ndarray, facts: dict[str, np.ndarray]) -> np.ndarray:
        """How much of the next shorter node's count the followers of these nodes exclude, both without the text's own."""
        trie = self.trie
        out = trie.excluded[k][facts["where"]].copy()
        row = np.repeat(np.arange(len(nodes)), facts["size"])
        gone = np.flatnonzero(facts["gone"])
        if len(gone):
            # a follower that only this text has excludes nothing
            key = shorter(self.keys[k][facts["edge"][gone]], 1)
            own = self.counts[k - 1][np.searchsorted(self.keys[k - 1], key)]
            seen = trie.seen[k - 1][trie.parent[k][facts["at"][gone]]]
            out -= np.bincount(row[gone], seen - own, len(nodes))
        # what the text itself adds to the shorter node, of symbols that the longer one has
        short = np.searchsorted(self.nodes[k - 1], self.nodes[k][nodes] >> _U(8))
        size = self.heads[k - 1][short + 1] - self.heads[k - 1][short]
        edge = _ranges(self.heads[k - 1][short], size)
        row = np.repeat(np.arange(len(nodes)), size)
        key = ((self.nodes[k][nodes][row] & _mask(k)) << _U(8)) | (self.keys[k - 1][edge] & _U(0xFF))
        _, there = _place(trie.edges[k], key)
        return out - np.bincount(row[there], self.counts[k - 1][edge[there]], len(nodes))

    def bits(self, texts: int) -> np.ndarray:
        trie, top = self.trie, self.trie.order
        out = np.zeros(texts)
        if not len(self.keys[top]):
            return out
        # the edges still to be coded, how often each comes, and what the context escaped from excludes
        gram, n = self.keys[top], self.counts[top]
        cut_total = cut_distinct = np.zeros(len(gram))
        for k in range(top, -1, -1):
            key = shorter(gram, top - k)
            if k == top:
                edge = np.arange(len(gram))
                nodes = np.arange(len(self.nodes[k]))
                own = np.repeat(nodes, np.diff(self.heads[k]))
            else:
                edge = np.searchsorted(self.keys[k], key)
                nodes, own = np.unique(np.searchsorted(self.nodes[k], key >> _U(8)), return_inverse=True)
            facts = self._facts(k, nodes)
            # where each edge to be coded lies among the facts' edges
            at = edge - self.heads[k][nodes][own] + facts["first"][own]
            left, distinct = facts["left"][at], facts["distinct"][own] - cut_distinct
            mass = facts["total"][own] - cut_total + distinct
            found = left > 0
            known = facts["distinct"][own] > 0
            cost = np.zeros(len(gram))
            cost[found] = np.log2(mass[found]) - np.log2(left[found])
            on = ~found & known & (distinct > 0)
            cost[on] = np.log2(mass[on]) - np.log2(distinct[on])
            out += np.bincount((gram >> _U(8 * (top + 1))).astype(np.int64), n * cost, texts)
            go = np.flatnonzero(~found)
            if not len(go):
                return out
            gram, n, own, known = gram[go], n[go], own[go], known[go]
            cut_total, cut_distinct = cut_total[go], np.where(known, facts["distinct"][own], cut_distinct[go])
            if k and known.any():
                some, back = np.unique(own[known], return_inverse=True)
                again = self._facts(k, nodes[some])
                cut_total[known] = self._excluded(k, nodes[some], again)[back]
        return out + np.bincount((gram >> _U(8 * (top + 1))).astype(np.int64), n * np.log2(256 - cut_distinct), texts)


def _small(batch: pa.RecordBatch, text: str, order: int) -> Iterator[pa.RecordBatch]:
    """Pieces whose rows can be numbered in the bits that a gram leaves."""
    most = 1 << (64 - 8 * (order + 1))
    for piece in pieces([batch], text, STEP_BYTES):
        for a in range(0, piece.num_rows, most):
            yield piece.slice(a, most)


def _counted(batches: Iterator[pa.RecordBatch], order: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct grams of the highest order in column text, and how often each comes."""
    keys, counts, held = [], [], 0
    for batch in batches:
        for piece in _small(batch, "text", order):
            key, n = _runs(np.sort(grams(*utf8(piece.column("text")), order)[0]))
            keys.append(key)
            counts.append(n)
            held += len(key)
            if held > 4_000_000:
                key, n = _added(np.concatenate(keys), np.concatenate(counts))
                keys, counts, held = [key], [n], 0
    return _added(np.concatenate(keys), np.concatenate(counts)) if keys else (np.zeros(0, _U), np.zeros(0, np.int64))


def _check_order(order: int) -> None:
    if not 1 <= order <= 5:
        raise ValueError("order is from 1 to 5")


def train(docs: DataFrame, text_col: str = "text", order: int = ORDER) -> str:
    """Counts all contexts of all documents and writes the edges as a table in the shared folder; returns its path.

    Null and empty texts add nothing, repeated rows count each time, other
    columns are not read; an empty table gives an empty model.
    """
    _check_order(order)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, n = edges_of(*_counted(batches, order), order)
        for a in range(0, len(key), 1 << 20):
            yield pa.RecordBatch.from_pydict({"key": key[a : a + (1 << 20)].view(np.int64), "n": n[a : a + (1 << 20)]})

    path = f"{shared_dir(docs.sparkSession).rstrip('/')}/lm-{uuid.uuid4().hex}"
    counted = docs.select(F.col(text_col).cast("string").alias("text")).where("text <> ''").mapInArrow(count, "key bigint, n bigint")
    counted.groupBy("key").agg(F.sum("n").alias("n")).write.parquet(path)
    return path


_SCORES = "n_bytes bigint, code_bits double, bits_per_byte double"


def _summary(size: np.ndarray, bits: np.ndarray) -> dict:
    bits = np.round(bits.astype(np.float64), 6)
    return {"n_bytes": pa.array(size), "code_bits": pa.array(bits), "bits_per_byte": pa.array(np.where(size > 0, bits / np.maximum(size, 1), 0.0), mask=size == 0)}


def _numbered(inner: DataFrame, folder: str) -> DataFrame:
    """inner (id, text) with a batch number, written as a table: consecutive rows up to BATCH_BYTES of text, so that no key decides a batch's size."""
    kind = inner.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, turn, held = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            for piece in pieces([batch], "text", STEP_BYTES):
                size = int(piece.column("text").nbytes)
                if held and held + size > BATCH_BYTES:
                    turn, held = turn + 1, 0
                held += size
                number = np.full(piece.num_rows, (part << 24) | turn, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(number), *piece.columns], names=["batch", "id", "text"])

    inner.mapInArrow(run, f"batch bigint, id {kind}, text string").withColumn("size", F.octet_length("text")).write.parquet(f"{folder}/rows")
    return inner.sparkSession.read.parquet(f"{folder}/rows")


def _bucket(key: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of each tagged edge: that of its context."""
    return (mix(key >> _U(8)) % _U(buckets)).astype(np.int32)


def _asked(batches: Iterator[pa.RecordBatch], order: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """For each batch of rows and bucket: the batch's edges and their counts, as bytes."""

    def flush(number: int, parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        key, n = edges_of(*_counted(parts, order), order)
        own = _bucket(key, buckets)
        turn = np.argsort(own, kind="stable")
        key, n, own = key[turn], n[turn].astype(_U), own[turn]
        edge = np.concatenate([[0], np.flatnonzero(np.diff(own)) + 1, [len(own)]]) if len(own) else np.zeros(1, int)
        blobs = [key[a:b].tobytes() + n[a:b].tobytes() for a, b in zip(edge, edge[1:])]
        return pa.RecordBatch.from_pydict({"bucket": pa.array(own[edge[:-1]]), "batch": pa.array(np.full(len(blobs), number)), "blob": pa.array(blobs, pa.binary())})

    held, current = [], None
    for batch in batches:
        number = batch.column("batch").to_numpy()
        edge = np.concatenate([[0], np.flatnonzero(np.diff(number)) + 1, [len(number)]]) if len(number) else np.zeros(1, int)
        for a, b in zip(edge, edge[1:]):
            if held and number[a] != current:
                yield flush(current, held)
                held = []
            current = int(number[a])
            held.append(batch.slice(a, b - a))
    if held:
        yield flush(current, held)


def _unpacked(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(blob, _U)
    return both[: len(both) // 2], both[len(both) // 2 :]


def _answered(asked: pa.Table, keys: np.ndarray, counts: np.ndarray) -> pa.Table:
    """To each batch that asks: all edges (of sorted keys) in the contexts of its own."""
    nodes, size = _runs(keys >> _U(8))
    first = np.cumsum(size) - size
    blobs = []
    for blob in asked.column("blob").to_pylist():
        own, _ = _runs(np.sort(_unpacked(blob)[0] >> _U(8)))
        at, there = _place(nodes, own)
        at = at[there]
        edge = _ranges(first[at], size[at])
        blobs.append(keys[edge].tobytes() + counts[edge].astype(_U).tobytes())
    return pa.table({"batch": asked.column("batch"), "blob": pa.array(blobs, pa.binary())})


def score(docs: DataFrame, model: str | None = None, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER) -> DataFrame:
    """One row for each input row: id, n_bytes, code_bits, bits_per_byte.

    Without a model, under the trie of all the documents less the row's own
    counts; repeated rows and copies tell of each other. With one, under the
    trie that train() wrote. A null or empty text has 0 bytes, 0 bits and null
    bits_per_byte; where nothing is known a byte costs eight bits, so a lone
    document does. Null ids and repeated rows pass through, an empty table gives
    no row; other columns are not read, whatever their names. A text is whole in
    one task, however long.
    """
    _check_order(order)
    spark = docs.sparkSession
    inner = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = inner.schema["id"].dataType.simpleString()
    rows = _numbered(inner, f"{shared_dir(spark).rstrip('/')}/lm-{uuid.uuid4().hex}")
    size, batches = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count_distinct("batch")).first()
    buckets = max(8, -(-size // BUCKET_BYTES))
    # tasks follow the input: a batch or a bucket each, give or take a collision; beyond MOST_TASKS several, one after the other
    tasks, bucket_tasks = min(max(8, 4 * batches), MOST_TASKS), min(buckets, MOST_TASKS)
    asked = rows.select("batch", "text").where("text <> ''").mapInArrow(lambda batches: _asked(batches, order, buckets), "bucket int, batch bigint, blob binary").repartition(bucket_tasks, "bucket")

    def add_up(group: pa.Table) -> pa.Table:
        parts = [_unpacked(b) for b in group.column("blob").to_pylist()]
        return _answered(group, *_added(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])))

    def look_up(group: pa.Table, edges: pa.Table) -> pa.Table:
        return _answered(group, *_added(edges.column("key").to_numpy().view(_U), edges.column("n").to_numpy()))

    if model is None:
        parts = asked.groupBy("bucket").applyInArrow(add_up, "batch bigint, blob binary")
    else:

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                own = _bucket(batch.column(0).to_numpy().view(_U), buckets)
                yield pa.RecordBatch.from_arrays([pa.array(own), *batch.columns], names=["bucket", "key", "n"])

        held = spark.read.parquet(model).select("key", "n").mapInArrow(place, "bucket int, key bigint, n bigint").repartition(bucket_tasks, "bucket")
        parts = asked.groupBy("bucket").cogroup(held.groupBy("bucket")).applyInArrow(look_up, "batch bigint, blob binary")

    def code(texts: pa.Table, trie: pa.Table) -> pa.Table:
        found = [_unpacked(b) for b in trie.column("blob").to_pylist()]
        keys, counts = (np.concatenate([f[i] for f in found]) if found else np.zeros(0, _U) for i in (0, 1))
        # a batch that was read in two parts has asked twice
        keys, first = np.unique(keys, return_index=True)
        held = Trie(keys, counts[first], order)
        out = []
        for batch in texts.select(["id", "text"]).combine_chunks().to_batches():
            for piece in _small(batch, "text", order):
                buf, offs = utf8(piece.column("text"))
                bits = held.bits_without_own(buf, offs) if model is None else held.bits(buf, offs)
                out.append(pa.RecordBatch.from_arrays([piece.column("id"), *_summary(np.diff(offs), bits).values()], names=["id", "n_bytes", "code_bits", "bits_per_byte"]))
        empty = pa.schema([("id", texts.schema.field("id").type), ("n_bytes", pa.int64()), ("code_bits", pa.float64()), ("bits_per_byte", pa.float64())])
        return pa.Table.from_batches(out, empty)

    coded = rows.select("batch", "id", "text").repartition(tasks, "batch").groupBy("batch").cogroup(parts.repartition(tasks, "batch").groupBy("batch")).applyInArrow(code, f"id {kind}, {_SCORES}")
    return coded.withColumnRenamed("id", id_col)


def adaptive_bits(data: bytes, order: int = ORDER) -> float:
    """Code length of one text under a trie that starts empty and learns each byte after coding it."""
    trie: dict[bytes, dict[int, int]] = {}
    bits = 0.0
    for i, s in enumerate(data):
        excluded: set[int] | dict[int, int] = ()
        for k in range(min(order, i), -1, -1):
            seen = trie.get(data[i - k : i])
            if not seen:
                continue
            left = {x: c for x, c in seen.items() if x not in excluded}
            if left:
                mass = sum(left.values()) + len(left)
                if s in left:
                    bits += math.log2(mass / left[s])
                    break
                bits += math.log2(mass / len(left))
            excluded = seen
        else:
            bits += math.log2(256 - len(excluded))
        for k in range(min(order, i) + 1):
            seen = trie.setdefault(data[i - k : i], {})
            seen[s] = seen.get(s, 0) + 1
    return bits


def score_adaptive(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER) -> DataFrame:
    """score() without a corpus: every document is coded by adaptive_bits(), some microseconds a byte.

    One row for each input row, as score() has them: null and empty texts have 0
    bytes, 0 bits and null bits_per_byte, null ids and repeated rows pass
    through, an empty table gives no row, other columns are not read.
    """
    inner = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = inner.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text"):
            raw = [(t or "").encode() for t in piece.column(1).to_pylist()]
            size, bits = np.array([len(x) for x in raw], np.int64), np.array([adaptive_bits(x, order) for x in raw])
            yield pa.RecordBatch.from_arrays([piece.column(0), *_summary(size, bits).values()], names=["id", "n_bytes", "code_bits", "bits_per_byte"])

    return inner.mapInArrow(run, f"id {kind}, {_SCORES}").withColumnRenamed("id", id_col)
