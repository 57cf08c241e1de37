"""Toxic passages as maximal scoring segments of token log-odds.

Token weights are log-odds between toxic and clean labelled documents with a
Dirichlet prior in proportion to the token's own frequency, and only tokens
whose log-odds are significant count; every other token costs `drift`. A
linear-time scan (Ruzzo and Tompa) finds all maximal segments, and their scores
are calibrated by the extreme-value law of Karlin and Altschul, whose scale
comes from the clean documents' token frequencies.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.frames import WORD_BYTE, cut, filter_rows, fold, hashes, mix, pieces, spans, utf8

#: Labelled rows that the weights are fitted on, at most (the least by hash of the id).
MAX_LABELLED = 20_000
PRIOR, MIN_Z, DRIFT, ALPHA = 0.05, 3.0, 0.25, 0.01
STEP_BYTES = 2 << 20
_U = np.uint64


@dataclass(frozen=True)
class Model:
    """Hashes of the significant tokens in order, their weights, and the law of chance scores."""

    keys: np.ndarray
    weights: np.ndarray
    drift: float
    scale: float

    def expected(self, score: float, tokens: int) -> float:
        """Segments of such a score that a clean document of so many tokens has by chance."""
        return self.scale * self.drift * tokens * math.exp(-self.scale * score)


def _tokens(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word in lower case, and the first word of each text."""
    buf = fold(buf)
    starts, ends, heads = spans(buf, offs, WORD_BYTE)
    return hashes(buf, starts, ends), heads


def chance_scale(rate: np.ndarray, weights: np.ndarray, drift: float) -> float:
    """The positive root of E[exp(scale * weight of a clean token)] = 1."""
    rest = 1.0 - float(rate.sum())

    def excess(x: float) -> float:
        return float((rate * np.exp(x * weights)).sum()) + rest * math.exp(-x * drift) - 1.0

    low, high = 0.0, 1.0
    while excess(high) < 0:
        low, high = high, 2 * high
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if excess(mid) < 0 else (low, mid)
    return low


def weigh(keys: np.ndarray, toxic: np.ndarray, clean: np.ndarray, n_toxic: int, n_clean: int, prior: float = PRIOR, min_z: float = MIN_Z, drift: float = DRIFT) -> Model:
    """A model from the tokens' counts in either class; no significant token means that nothing is toxic."""
    own = prior * (toxic + clean)
    total = prior * (n_toxic + n_clean)
    with np.errstate(divide="ignore", invalid="ignore"):
        odds = np.log((toxic + own) / (n_toxic + total - toxic - own)) - np.log((clean + own) / (n_clean + total - clean - own))
        z = odds / np.sqrt(1 / (toxic + own) + 1 / (clean + own))
    sure = np.flatnonzero((z >= min_z) & np.isfinite(odds))
    sure = sure[np.argsort(keys[sure])]
    rate = (clean + own)[sure] / (n_clean + total)
    # chance scores need a mean below zero
    while len(sure) and float((rate * odds[sure]).sum()) >= drift * (1 - float(rate.sum())):
        least = odds[sure] > odds[sure].min()
        sure, rate = sure[least], rate[least]
    return Model(keys[sure], odds[sure], drift, chance_scale(rate, odds[sure], drift) if len(sure) else 1.0)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_labelled: int = MAX_LABELLED, prior: float = PRIOR, min_z: float = MIN_Z, drift: float = DRIFT) -> Model:
    """Weights from labelled documents, each text once a label.

    A token counts once for each document first; those that are significant
    then count once for each pair of neighbours, so that copies and passages
    that many documents share are not taken for many witnesses.
    At most max_labelled labels are used, the least by hash of the id; rows with a
    null id or label are left out, and so are labels without a document.
    """
    some = labels.select(F.col(id_col).cast("bigint").alias("q_id"), F.col(label_col).cast("int").alias("q_toxic")).where("q_id is not null and q_toxic is not null").distinct()
    some = some.orderBy(F.xxhash64("q_id"), "q_id", "q_toxic").limit(max_labelled)
    texts = docs.select(F.col(id_col).cast("bigint").alias("q_id"), F.col(text_col).alias("text")).where("text is not null").join(F.broadcast(some), "q_id")

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text", STEP_BYTES):
            words, heads = _tokens(*utf8(piece.column(0)))
            toxic = piece.column(1).to_numpy(zero_copy_only=False) > 0
            owner = np.repeat(np.arange(len(toxic)), np.diff(heads))
            turn = np.lexsort((owner, words))
            words, owner = words[turn], owner[turn]
            if len(words):
                new = np.append(True, (words[1:] != words[:-1]) | (owner[1:] != owner[:-1]))
                words, owner = words[new], owner[new]
            keys, first = np.unique(words, return_index=True)
            if len(keys):
                bad = np.add.reduceat(toxic[owner].astype(np.int64), first)
                every = np.diff(np.append(first, len(words)))
                yield pa.RecordBatch.from_pydict({"key": keys.view(np.int64), "toxic": bad, "clean": every - bad})

    once = cut(texts.groupBy(F.xxhash64("text").alias("h"), "q_toxic").agg(F.first("text").alias("text")).select("text", "q_toxic"))
    table = cut(once.mapInArrow(counts, "key bigint, toxic bigint, clean bigint").groupBy("key").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")))
    total = table.agg(F.coalesce(F.sum("toxic"), F.lit(0)), F.coalesce(F.sum("clean"), F.lit(0))).first()
    # only a token more frequent among the toxic ones can weigh; below 3 none passes min_z
    first = _columns(table.where("toxic >= 3").where(F.col("toxic") * F.lit(total[1]) > F.col("clean") * F.lit(total[0])))
    likely = weigh(*first, *total, prior, min_z, drift).keys
    if not len(likely):
        return Model(likely, np.zeros(0), drift, 1.0)

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text", STEP_BYTES):
            words, heads = _tokens(*utf8(piece.column(0)))
            at = np.flatnonzero(np.isin(words, likely))
            if not len(at):
                continue
            owner = np.searchsorted(heads, at, "right") - 1
            before = np.where(at > heads[owner], words[at - 1], _U(0))
            after = np.where(at + 1 < heads[owner + 1], words[np.minimum(at + 1, len(words) - 1)], _U(0))
            yield pa.RecordBatch.from_pydict({"key": words[at].view(np.int64), "context": mix(mix(before) + after).view(np.int64), "bad": piece.column(1).to_numpy(zero_copy_only=False)[owner] > 0})

    found = once.mapInArrow(contexts, "key bigint, context bigint, bad boolean").distinct()
    second = found.groupBy("key").agg(F.count_if("bad").alias("toxic"), F.count_if(~F.col("bad")).alias("clean"))
    return weigh(*_columns(second), *total, prior, min_z, drift)


def _columns(table: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rows = table.select("key", "toxic", "clean").toArrow()
    key, toxic, clean = (rows.column(i).to_numpy() for i in range(3))
    return key.view(_U), toxic, clean


def segments(at: list[int], weight: list[float], drift: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score) of a text whose token at[i] has weight[i], every other -drift."""
    found: list[tuple[int, int, float, float, int]] = []
    total, last = 0.0, -1
    for p, w in zip(at, weight):
        total -= drift * (p - last - 1)
        start, low, last = p, total, p
        total += w
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= low:
                j = found[j][4]
            if j < 0 or found[j][3] >= total:
                found.append((start, p + 1, low, total, j))
                break
            start, low = found[j][0], found[j][2]
            del found[j:]
    return [(a, b, high - low) for a, b, low, high, _ in found]


def judge(model: Model, at: list[int], weight: list[float], tokens: int, alpha: float = ALPHA) -> tuple[list[tuple[int, int, float]], float, float]:
    """Significant segments, the best score, and the document's chance: that of its best r segments, over all r.

    The sum of r normalised scores has the tail x^(r-1) exp(-x) / (r! (r-1)!);
    r is paid for with a factor of 2^r, as the sum statistics are. That tail holds
    where the sum is over r - 1; once it isn't, no further r has such a sum, since
    scores fall.
    """
    every = sorted(segments(at, weight, model.drift), key=lambda s: (-s[2], s[0]))
    base = math.log(max(model.scale * model.drift * tokens, 1e-300))
    chance, total = 1.0, 0.0
    for r, (_, _, s) in enumerate(every, 1):
        total += model.scale * s - base
        if total <= r - 1:
            break
        tail = -total if r == 1 else -total + (r - 1) * math.log(max(total, 1e-9)) - math.lgamma(r + 1) - math.lgamma(r)
        chance = min(chance, -math.expm1(-math.exp(min(tail + r * math.log(2), 50.0))))
    real = [s for s in every if model.expected(s[2], tokens) <= alpha]
    return sorted(real), every[0][2] if every else 0.0, chance


def _judged(model: Model, alpha: float, buf: np.ndarray, offs: np.ndarray):
    """The number of tokens of each text, and judge() of those that have a weighted token."""
    words, heads = _tokens(buf, offs)
    tokens = np.diff(heads)
    if not len(model.keys) or not len(words):
        return tokens, {}
    likely = np.zeros(1 << 16, bool)
    likely[model.keys & _U(0xFFFF)] = True
    hit = np.flatnonzero(likely[words & _U(0xFFFF)])
    place = np.minimum(np.searchsorted(model.keys, words[hit]), len(model.keys) - 1)
    real = model.keys[place] == words[hit]
    hit, place = hit[real], place[real]
    owner = np.searchsorted(heads, hit, "right") - 1
    edge = np.concatenate([[0], np.flatnonzero(np.diff(owner)) + 1, [len(owner)]]) if len(owner) else []
    out = {}
    for a, b in zip(edge[:-1], edge[1:]):
        i = int(owner[a])
        out[i] = judge(model, (hit[a:b] - heads[i]).tolist(), model.weights[place[a:b]].tolist(), int(tokens[i]), alpha)
    return tokens, out


def toxic_report(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", alpha: float = ALPHA) -> DataFrame:
    """One row for each input row: id, n_tokens, passages (start_token, end_token, score), best_score, p_value, toxic.

    passages are the segments of which a clean text of that length has alpha or
    fewer by chance; a text is toxic if p_value is at most alpha. A null or empty
    text has no token, p_value 1 and isn't toxic. Repeated rows are judged each
    by itself, null ids pass through, other columns are not read.
    """
    inner = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = inner.schema["id"].dataType.simpleString()
    item = pa.list_(pa.struct([("start_token", pa.int64()), ("end_token", pa.int64()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text", STEP_BYTES):
            tokens, found = _judged(model, alpha, *utf8(piece.column(1)))
            n = len(tokens)
            passages: list = [[]] * n
            best, chance = np.zeros(n), np.ones(n)
            for i, (real, top, p) in found.items():
                passages[i] = [{"start_token": a, "end_token": b, "score": s} for a, b, s in real]
                best[i], chance[i] = top, p
            yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(tokens), pa.array(passages, item), pa.array(best), pa.array(chance), pa.array(chance <= alpha)], names=["id", "n_tokens", "passages", "best_score", "p_value", "toxic"])

    out = inner.mapInArrow(run, f"id {kind}, n_tokens bigint, passages array<struct<start_token bigint, end_token bigint, score double>>, best_score double, p_value double, toxic boolean")
    return out.withColumnRenamed("id", id_col)


def drop_toxic(docs: DataFrame, model: Model, text_col: str = "text", alpha: float = ALPHA) -> DataFrame:
    """The rows that toxic_report() doesn't call toxic, all columns unchanged whatever their names; no shuffle.

    Null and empty texts stay, each repeated row is judged by itself, an empty
    table stays empty.
    """

    def keeps(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
        out = np.ones(len(offs) - 1, bool)
        for i, (_, _, p) in _judged(model, alpha, buf, offs)[1].items():
            out[i] = p > alpha
        return out

    return filter_rows(docs, text_col, keeps)
