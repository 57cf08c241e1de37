"""Suffix-array deduplication of passages: per-shard suffix arrays, merged across shards.

A window is min_words consecutive words, split at white space; words are equal if
their 64-bit hashes are. It repeats if it occurs at two places, in one document
or in two; every occurrence but the first, in order of (doc_id, text hash,
position), is redundant.

1. Each shard of a few MB sorts its suffixes by words (Larsson-Sadakane) and
   takes Kasai's common prefixes: windows that repeat inside the shard.
2. Of each window its first occurrence in the shard goes to a bucket, as the 64
   bits of its hash. Runs of windows go together to the bucket of their least
   anchor hash (of anchor_words words), so equal windows meet in one bucket, and
   a run costs one header.
3. A bucket merges the sorted runs of all shards by binary search. Windows of
   two shards are equal if their 64 bits are: of m different windows in a bucket
   some m^2 / 2^65 pairs agree by chance. No text is read again to verify one.

Buckets are weighed first. Those over HOT_BYTES, where a line or a passage is in
a great many shards, don't meet in one task: their windows are added up by hash,
partially before they are shuffled, and joined with the first occurrence.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.frames import NOT_SPACE, cut, hashes, mix, pieces, rolling, sized, spans, table, utf8
from quillspark.llm.suffix import common_prefixes, runs, suffix_array

MIN_WORDS, ANCHOR_WORDS = 50, 16
SHARD_BYTES = 3 << 20
BUCKET_BYTES, HOT_BYTES = 4 << 20, 64 << 20
_NULL = np.iinfo(np.int64).max
_RUN = np.dtype([("doc", "<u4"), ("at", "<u4"), ("n", "<u4")])
_DOC = np.dtype([("id", "<i8"), ("hash", "<i8")])
_SPAN = "id bigint, hash bigint, at bigint, n bigint, redundant boolean"


def _span_rows(ids: np.ndarray, hashes_: np.ndarray, doc: np.ndarray, at: np.ndarray, redundant: np.ndarray) -> dict:
    """Runs of consecutive windows of one document and kind; sorted by document and position."""
    if not len(doc):
        return {"id": pa.array([], pa.int64()), "hash": pa.array([], pa.int64()), "at": pa.array([], pa.int64()), "n": pa.array([], pa.int64()), "redundant": pa.array([], pa.bool_())}
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (at[1:] != at[:-1] + 1) | (redundant[1:] != redundant[:-1])
    head = np.flatnonzero(new)
    d = doc[head]
    return {"id": pa.array(ids[d], mask=ids[d] == _NULL), "hash": pa.array(hashes_[d]), "at": pa.array(at[head].astype(np.int64)), "n": pa.array(np.diff(np.append(head, len(doc)))), "redundant": pa.array(redundant[head])}


def least_of(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` consecutive values; the last width - 1 not meaningful."""
    out, have = values.copy(), 1
    while have < width:
        step = min(have, width - have)
        out[:-step] = np.minimum(out[:-step], out[step:])
        have += step
    return out


class Laid:
    """The words of a shard's texts in a row, a separator behind each text, and the hashes of its windows."""

    def __init__(self, buf: np.ndarray, offs: np.ndarray, w: int, k: int, buckets: int):
        starts, ends, heads = spans(buf, offs, NOT_SPACE)
        self.words = hashes(buf, starts, ends)
        self.count = np.diff(heads)
        self.docs = len(offs) - 1
        self.n = len(self.words) + self.docs
        self.owner = np.repeat(np.arange(self.docs), self.count + 1)
        self.first = heads[:-1] + np.arange(self.docs)
        self.stops = self.first + self.count
        self.is_word = np.ones(self.n, bool)
        self.is_word[self.stops] = False
        self.position = np.arange(self.n) - self.first[self.owner]
        self.window = self.is_word & (self.count[self.owner] - self.position >= w)
        values = np.zeros(self.n, np.uint64)
        values[self.is_word] = self.words
        self.prints = rolling(values, w)
        self.anchors = least_of(rolling(values, k), w - k + 1)
        # least values are not uniform: mixed again for the choice of a bucket
        self.bucket = (mix(self.anchors) % np.uint64(buckets)).astype(np.int64)

    def runs(self, window: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of windows, and where among them runs of one text and anchor begin."""
        sent = np.flatnonzero(window)
        new = np.ones(len(sent), bool)
        new[1:] = (sent[1:] != sent[:-1] + 1) | (self.anchors[sent[1:]] != self.anchors[sent[:-1]])
        return sent, np.flatnonzero(new)


def shard(ids: np.ndarray, texts: np.ndarray, buf: np.ndarray, offs: np.ndarray, w: int, k: int, buckets: int, hot: np.ndarray) -> tuple[dict, list[tuple[int, bytes]]]:
    """Rows of windows that repeat inside, and for each bucket that isn't hot the packed runs of first occurrences."""
    _, once = np.unique(np.stack([ids, texts]), axis=1, return_index=True)
    single = np.zeros(len(ids), bool)
    single[once] = True
    laid = Laid(buf, offs, w, k, buckets)
    docs, n, owner, stops, is_word, position = laid.docs, laid.n, laid.owner, laid.stops, laid.is_word, laid.position
    _, sym = np.unique(laid.words, return_inverse=True)
    symbols = np.zeros(n + 2, np.uint64)
    symbols[:n][is_word] = sym.astype(np.uint64) + np.uint64(docs)
    symbols[stops] = np.arange(docs)
    # three words in one key while ranks have 21 bits, else two
    bits, depth = (21, 3) if n < (1 << 21) else (32, 2)
    key = np.zeros(n, np.uint64)
    for j in range(depth):
        key = (key << np.uint64(bits)) | symbols[j : j + n]
    symbols = symbols[:n].astype(np.int64)
    order, split = suffix_array(key, depth)
    lcp = common_prefixes(symbols, order, split, w)
    window = laid.window & single[owner]
    # place of each document in the order of occurrences
    place = np.empty(docs, np.int64)
    place[np.lexsort((texts, ids))] = np.arange(docs)
    lo, hi = runs(lcp >= w)
    members = np.concatenate([np.arange(a - 1, b) for a, b in zip(lo, hi)]) if len(lo) else np.zeros(0, np.int64)
    group = np.repeat(np.arange(len(lo)), hi - lo + 1)
    at = order[members]
    real = single[owner[at]]
    at, group = at[real], group[real]
    many = np.bincount(group, minlength=len(lo))[group] > 1 if len(group) else np.zeros(0, bool)
    at, group = at[many], group[many]
    occurrence = (place[owner[at]] << 32) | position[at]
    turn = np.lexsort((occurrence, group))
    at, group = at[turn], group[turn]
    redundant = np.zeros(len(at), bool)
    redundant[1:] = group[1:] == group[:-1]
    window[at[redundant]] = False
    turn = np.argsort(at)
    at, redundant = at[turn], redundant[turn]
    local = _span_rows(ids, texts, owner[at], position[at], redundant)

    if len(hot):
        window &= ~np.isin(laid.bucket, hot)
    sent, head = laid.runs(window)
    if not len(sent):
        return local, []
    run = np.empty(len(head), _RUN)
    run["doc"], run["at"] = owner[sent[head]], position[sent[head]]
    run["n"] = np.diff(np.append(head, len(sent)))
    bucket = laid.bucket[sent[head]]
    by = np.argsort(bucket, kind="stable")
    run, bucket, head = run[by], bucket[by], head[by]
    size = run["n"].astype(np.int64)
    starts_ = np.cumsum(size) - size
    prints = laid.prints[sent[np.repeat(head - starts_, size) + np.arange(int(size.sum()))]]
    out = []
    edges = np.flatnonzero(np.diff(bucket)) + 1
    for a, b in zip(np.append(0, edges), np.append(edges, len(bucket))):
        part = run[a:b].copy()
        used, part["doc"] = np.unique(part["doc"], return_inverse=True)
        doc = np.empty(len(used), _DOC)
        doc["id"], doc["hash"] = ids[used], texts[used]
        to = starts_[b - 1] + size[b - 1]
        out.append((int(bucket[a]), np.array([len(used), b - a], "<u4").tobytes() + doc.tobytes() + part.tobytes() + prints[starts_[a] : to].tobytes()))
    return local, out


def merge(blobs: list[bytes]) -> dict:
    """Rows of windows that occur in two shards or more; a repeated row of one document is one occurrence."""
    docs, keys, owners, places, base = [], [], [], [], 0
    for blob in blobs:
        n_docs, n_runs = np.frombuffer(blob, "<u4", 2)
        at = 8
        docs.append(np.frombuffer(blob, _DOC, n_docs, at))
        at += n_docs * _DOC.itemsize
        run = np.frombuffer(blob, _RUN, n_runs, at)
        keys.append(np.frombuffer(blob, "<u8", offset=int(at + n_runs * _RUN.itemsize)))
        size = run["n"].astype(np.int64)
        begin = np.cumsum(size) - size
        owners.append(np.repeat(run["doc"].astype(np.int64) + base, size))
        places.append(np.repeat(run["at"].astype(np.int64) - begin, size) + np.arange(int(size.sum())))
        base += int(n_docs)
    doc = np.concatenate(docs)
    # the sorted run of each shard is searched in the merger of all
    merged = np.sort(np.concatenate(keys))
    repeated = merged[1:][merged[1:] == merged[:-1]]
    repeated = repeated[np.concatenate([[True], repeated[1:] != repeated[:-1]])] if len(repeated) else repeated
    del merged
    hit_key, hit_doc, hit_at = [], [], []
    for key, owner, place in zip(keys, owners, places):
        if not len(repeated):
            break
        found = np.minimum(np.searchsorted(repeated, key), len(repeated) - 1)
        hit = np.flatnonzero(repeated[found] == key)
        hit_key.append(found[hit])
        hit_doc.append(owner[hit])
        hit_at.append(place[hit])
    key, owner, at = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (hit_key, hit_doc, hit_at))
    turn = np.lexsort((doc["hash"], doc["id"]))
    same = np.ones(len(doc), bool)
    same[1:] = (doc[turn][1:] != doc[turn][:-1])
    unique = doc[turn][same]
    place = np.empty(len(doc), np.int64)
    place[turn] = np.cumsum(same) - 1
    owner = place[owner]
    turn = np.lexsort((at, owner, key))
    key, owner, at = key[turn], owner[turn], at[turn]
    if len(key):
        other = np.ones(len(key), bool)
        other[1:] = (key[1:] != key[:-1]) | (owner[1:] != owner[:-1]) | (at[1:] != at[:-1])
        key, owner, at = key[other], owner[other], at[other]
        head = np.concatenate([[True], key[1:] != key[:-1]])
        many = np.bincount(np.cumsum(head) - 1)[np.cumsum(head) - 1] > 1
        owner, at, redundant = owner[many], at[many], ~head[many]
    else:
        redundant = np.zeros(0, bool)
    turn = np.lexsort((at, owner))
    return _span_rows(unique["id"], unique["hash"], owner[turn], at[turn], redundant[turn])


def _unite(at: np.ndarray, to: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of half-open intervals."""
    turn = np.argsort(at)
    at, to = at[turn], np.maximum.accumulate(to[turn])
    new = np.ones(len(at), bool)
    new[1:] = at[1:] > to[:-1]
    head = np.flatnonzero(new)
    return at[head], to[np.append(head[1:], len(at)) - 1] if len(at) else to


def _hot_buckets(inner: DataFrame, w: int, k: int, buckets: int) -> np.ndarray:
    """The buckets over HOT_BYTES, in order: at most one for that many bytes of windows."""

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text", SHARD_BYTES):
            laid = Laid(*utf8(piece.column(2)), w, k, buckets)
            sent, head = laid.runs(laid.window)
            own, at = np.unique(laid.bucket[sent[head]], return_inverse=True)
            size = np.bincount(at, _RUN.itemsize + 8 * np.diff(np.append(head, len(sent))), len(own)) if len(own) else np.zeros(0)
            yield pa.RecordBatch.from_pydict({"bucket": pa.array(own, pa.int64()), "size": pa.array(size.astype(np.int64))})

    weighed = inner.mapInArrow(weigh, "bucket bigint, size bigint").groupBy("bucket").agg(F.sum("size").alias("size"))
    return np.sort(weighed.where(F.col("size") > HOT_BYTES).select("bucket").toArrow().column(0).to_numpy())


def _hot_windows(inner: DataFrame, w: int, k: int, buckets: int, hot: np.ndarray) -> DataFrame:
    """Windows of hot buckets that repeat: id, hash, at, n (1), redundant."""

    def list_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text", SHARD_BYTES):
            laid = Laid(*utf8(piece.column(2)), w, k, buckets)
            at = np.flatnonzero(laid.window & np.isin(laid.bucket, hot))
            own = pa.array(laid.owner[at])
            yield pa.RecordBatch.from_arrays([pa.array(laid.prints[at].view(np.int64)), piece.column(0).take(own), piece.column(1).take(own), pa.array(laid.position[at])], names=["print", "id", "hash", "at"])

    # a repeated row of one document is one occurrence
    every = cut(inner.mapInArrow(list_, "print bigint, id bigint, hash bigint, at bigint").distinct())
    place = F.struct(F.col("id").isNull().alias("none"), "id", "hash", "at")
    first = every.groupBy("print").agg(F.min(place).alias("first"), F.count("*").alias("many")).where("many > 1").select(F.col("print").alias("q_print"), "first")
    # adaptive execution splits the many rows of one print
    met = every.join(first, F.col("print") == F.col("q_print"))
    return met.select("id", "hash", "at", F.lit(1).cast("bigint").alias("n"), (place != F.col("first")).alias("redundant"))


def repeated_windows(docs: DataFrame, id_col: str, text_col: str, min_words: int, anchor_words: int) -> DataFrame:
    """One row for each document with a repeated window: id, hash of the text, runs (at, n, redundant)."""
    nothing = {"id": 0, "hash": 0, "at": 0, "n": 0, "redundant": False}
    inner = docs.select(F.col(id_col).cast("bigint").alias("id"), F.xxhash64(text_col).alias("hash"), F.col(text_col).alias("text")).where("text is not null")
    size = inner.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(8, -(-size // BUCKET_BYTES))
    hot = _hot_buckets(inner, min_words, anchor_words, buckets)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for turn, piece in enumerate(pieces(batches, "text", SHARD_BYTES)):
            ids = piece.column(0).fill_null(_NULL).to_numpy(zero_copy_only=False)
            texts = piece.column(1).to_numpy(zero_copy_only=False)
            local, blobs = shard(ids, texts, *utf8(piece.column(2)), min_words, anchor_words, buckets, hot)
            n = len(local["id"])
            if n:
                yield pa.RecordBatch.from_pydict({"bucket": pa.array(np.full(n, (int(texts[0]) + turn) % buckets, np.int32)), "blob": pa.nulls(n, pa.binary()), **local})
            if blobs:
                yield pa.RecordBatch.from_pydict({"bucket": pa.array([b for b, _ in blobs], pa.int32()), "blob": pa.array([x for _, x in blobs], pa.binary()), **{c: pa.array([x] * len(blobs)) for c, x in nothing.items()}})

    def receive(group: pa.Table) -> pa.Table:
        inside = group.filter(group.column("blob").is_null()).select(list(nothing))
        blobs = group.column("blob").drop_null().to_pylist()
        return pa.concat_tables([inside, pa.table(merge(blobs)).cast(inside.schema)]) if blobs else inside

    found = inner.mapInArrow(send, f"bucket int, blob binary, {_SPAN}").groupBy("bucket").applyInArrow(receive, _SPAN)
    if len(hot):
        found = found.unionByName(_hot_windows(inner, min_words, anchor_words, buckets, hot))
    return found.groupBy("id", "hash").agg(F.collect_list(F.struct("at", "n", "redundant")).alias("runs"))


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, anchor_words: int = ANCHOR_WORDS) -> DataFrame:
    """Every maximal stretch of words in repeated windows: id, start_word, end_word (exclusive), redundant_words.

    Documents without a passage of min_words words that occurs twice have no
    row. redundant_words counts those an earlier occurrence covers: 0 for a
    passage at its first place. Null texts and texts shorter than min_words have
    no window. Repeated rows (same id and text) are one document; equal texts
    under two ids are two. Null ids come last in the order of occurrences and
    stay null. An empty table gives no row; texts of any length are taken whole.
    Other columns are not read, whatever their names.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            offs = np.asarray(lists.offsets)
            values = lists.values
            at, n, red = (values.field(i).to_numpy(zero_copy_only=False) for i in range(3))
            row, start, end, extra = [], [], [], []
            for i in range(batch.num_rows):
                s = slice(offs[i], offs[i + 1])
                a, b = _unite(at[s], at[s] + n[s] + min_words - 1)
                r = red[s]
                c, d = _unite(at[s][r], (at[s] + n[s])[r] + min_words - 1)
                row.append(np.full(len(a), i))
                start.append(a)
                end.append(b)
                extra.append(np.bincount(np.searchsorted(a, c, "right") - 1, d - c, len(a)).astype(np.int64) if len(c) else np.zeros(len(a), np.int64))
            if row:
                take = pa.array(np.concatenate(row))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(take), *(pa.array(np.concatenate(x).astype(np.int64)) for x in (start, end, extra))], names=["id", "start_word", "end_word", "redundant_words"])

    found = repeated_windows(docs, id_col, text_col, min_words, anchor_words)
    return found.select("id", "runs").mapInArrow(run, "id bigint, start_word bigint, end_word bigint, redundant_words bigint").withColumnRenamed("id", id_col)


def cut_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str = "n_chars", min_words: int = MIN_WORDS, anchor_words: int = ANCHOR_WORDS) -> DataFrame:
    """docs without redundant passages: every repeated passage stays at its first place alone.

    A cut takes the words and the white space after each of them; chars_col,
    if docs has it, follows for the texts that changed. A text of which no word
    is left goes, with its row. Rows without a redundant passage pass unchanged,
    null and empty texts among them, and so do all other columns.
    """
    found = repeated_windows(docs, id_col, text_col, min_words, anchor_words).where(F.exists("runs", lambda r: r["redundant"]))
    found = cut(found.select(F.col("id").alias("q_id"), F.col("hash").alias("q_hash"), F.filter("runs", lambda r: r["redundant"]).alias("q_runs")))
    names = docs.columns
    inner = docs.toDF(*[f"c{i}" for i in range(len(names))])
    c_id, c_text = (f"c{names.index(x)}" for x in (id_col, text_col))
    chars = names.index(chars_col) if chars_col in names else None
    joined = inner.join(sized(found, 200), F.col(c_id).cast("bigint").eqNullSafe(F.col("q_id")) & (F.xxhash64(c_text) == F.col("q_hash")), "left").drop("q_id", "q_hash")
    t, plain = names.index(text_col), inner.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, c_text):
            lists = piece.column(len(names))
            hit = np.flatnonzero(np.asarray(lists.is_valid()))
            arrays = piece.columns[: len(names)]
            if not len(hit):
                yield pa.RecordBatch.from_arrays(arrays, names=plain)
                continue
            texts, keep = arrays[t].to_pylist(), np.ones(piece.num_rows, bool)
            sizes = arrays[chars].to_pylist() if chars is not None else None
            for i in hit:
                raw = texts[i].encode()
                buf = np.frombuffer(raw, np.uint8)
                starts, _, _ = spans(buf, np.array([0, len(buf)]), NOT_SPACE)
                got = lists[int(i)].as_py()
                a, b = _unite(np.array([g["at"] for g in got]), np.array([g["at"] + g["n"] + min_words - 1 for g in got]))
                limit = np.append(starts, len(buf))
                left, at = [], 0
                for x, y in zip(a, b):
                    left.append(raw[at : limit[x]])
                    at = limit[min(y, len(starts))]
                left.append(raw[at:])
                texts[i] = b"".join(left).decode()
                keep[i] = (b - a).sum() < len(starts)
                if sizes is not None:
                    sizes[i] = len(texts[i])
            arrays[t] = pa.array(texts, arrays[t].type)
            if sizes is not None:
                arrays[chars] = pa.array(sizes, arrays[chars].type)
            yield pa.RecordBatch.from_arrays(arrays, names=plain).filter(pa.array(keep))

    return joined.mapInArrow(run, inner.schema).toDF(*names)
