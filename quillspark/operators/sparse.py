"""Keyword ranking: postings, document frequencies, BM25 for any number of queries at once.

Documents are tokenised once for a search: profiles() reads them in one scan and
keeps, in the shared folder, a small row each with what every list needs. Ids
are taken to be unique, as a collection's are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.errors import check_k
from quillspark.functions.text import tokenize
from quillspark.functions.words import Words, steps
from quillspark.session import BROADCAST_BYTES, cut

K1, B = 1.5, 0.75
#: What a query term takes at most of memory, for the bound on those that go to every task.
TERM_BYTES = 64
#: Scores that are held at a time: queries times documents.
CELLS = 1 << 19


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))


def tokens(docs: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """id, term, tf, dl: a row for each distinct term of each document, without a shuffle."""
    inner = _texts(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in steps(batches, "text"):
            words = Words(part.column(1))
            doc, code, n = words.counts()
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(doc)), words.terms.take(pa.array(code)), pa.array(n), pa.array(words.lengths()[doc].astype(np.int32))], names=["id", "term", "tf", "dl"])

    return inner.mapInArrow(run, f"id {inner.schema['id'].dataType.simpleString()}, term string, tf bigint, dl int")


def lengths(docs: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """id, dl: how many tokens each document has; none without a text."""
    inner = _texts(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in steps(batches, "text"):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(Words(part.column(1)).lengths().astype(np.int32))], names=["id", "dl"])

    return inner.mapInArrow(run, f"id {inner.schema['id'].dataType.simpleString()}, dl int")


def document_frequency(postings: DataFrame) -> DataFrame:
    return postings.groupBy("term").agg(F.count("*").alias("df"))


def term_documents(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """term, df straight from the documents: each batch counts its own before anything is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in steps(batches, "text"):
            words = Words(part.column(0))
            yield pa.RecordBatch.from_arrays([words.terms, pa.array(np.bincount(words.counts()[1], minlength=len(words.terms)))], names=["term", "df"])

    counted = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "term string, df bigint").where("df > 0")
    return counted.groupBy("term").agg(F.sum("df").alias("df"))


def corpus_stats(docs: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """n and avgdl in one row; 0 for an empty corpus. Documents without a token count."""
    return _stats(lengths(docs, id_col, text_col))


def _stats(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("*").alias("n"), F.coalesce(F.avg("dl"), F.lit(0.0)).alias("avgdl"))


def query_terms(queries: DataFrame, query_id: str = "query_id", query_text: str = "query") -> DataFrame:
    """query_id, term, qtf."""
    each = queries.select(F.col(query_id).alias("query_id"), F.explode(tokenize(F.col(query_text))).alias("term"))
    return each.groupBy("query_id", "term").agg(F.count("*").alias("qtf"))


class Profiles:
    """Documents as a search needs them: rows of id, dl, norm, kept and words (term, tf) of the query terms; and the queries' terms, here too if they are few."""

    def __init__(self, rows: DataFrame, asked: DataFrame, known: list[tuple] | None, kind: pa.DataType):
        self.rows, self.asked, self.known, self.kind = rows, asked, known, kind
        self._facts: tuple[int, float, dict[str, int]] | None = None

    def kept(self) -> Profiles:
        return Profiles(self.rows.where("kept"), self.asked, self.known, self.kind)

    def postings(self) -> DataFrame:
        return self.rows.select("id", "dl", "norm", F.inline("words"))

    def facts(self) -> tuple[int, float, dict[str, int]]:
        """Number of documents, mean length, and in how many each of the few query terms is."""
        if self._facts is None:

            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    found = batch.column(1).flatten().field("term").dictionary_encode()
                    n = np.bincount(found.indices.to_numpy(), minlength=len(found.dictionary))
                    yield pa.RecordBatch.from_pydict({"term": pa.concat_arrays([found.dictionary.cast(pa.string()), pa.nulls(1, pa.string())]), "df": pa.array(np.append(n, batch.num_rows)), "dl": pa.array(np.append(np.zeros_like(n), pc.sum(batch.column(0)).as_py() or 0))})

            counted = self.rows.select("dl", "words").mapInArrow(run, "term string, df bigint, dl bigint").groupBy("term").agg(F.sum("df").alias("df"), F.sum("dl").alias("dl")).collect()
            every = next((r for r in counted if r["term"] is None), None)
            n = every["df"] if every else 0
            self._facts = n, every["dl"] / n if n else 0.0, {r["term"]: r["df"] for r in counted if r["term"] is not None}
        return self._facts

    def best(self, weights: list[tuple], value, k: int) -> DataFrame:
        """query_id, id, score, rank: the k best of each query by the sum of weight times value(tf, dl, norm) over its terms.

        weights: query_id, term, weight. A dense block of queries by documents is
        added up at a time, and only the best of it leave it.
        """
        weights = sorted(weights, key=lambda x: x[1])
        names = list({q: None for q, _, _ in weights})
        place = {q: i for i, q in enumerate(names)}
        terms, start, count = np.unique(np.array([t for _, t, _ in weights], object), return_index=True, return_counts=True) if weights else (np.zeros(0, object), np.zeros(0, np.int64), np.zeros(0, np.int64))
        who, weight = np.array([place[q] for q, _, _ in weights], np.int64), np.array([w for _, _, w in weights], np.float64)
        lookup = pa.array(terms.tolist(), pa.string())
        q_type, id_type = (d.schema[c].dataType.simpleString() for d, c in ((self.asked, "query_id"), (self.rows, "id")))
        step, kind = max(1, CELLS // max(len(names), 1)), self.kind

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            asked = pa.array(names, kind)
            for batch in batches:
                for a in range(0, batch.num_rows, step) if names else ():
                    part = batch.slice(a, step)
                    lists, n = part.column(3), part.num_rows
                    items = lists.flatten()
                    doc = np.repeat(np.arange(n), np.diff(np.asarray(lists.offsets)))
                    code = pc.fill_null(pc.index_in(items.field("term"), lookup), -1).to_numpy()
                    use = code >= 0
                    code, doc, tf = code[use], doc[use], items.field("tf").to_numpy()[use].astype(np.float64)
                    worth = value(tf, part.column(1).to_numpy()[doc], part.column(2).to_numpy()[doc])
                    many = count[code]
                    at = np.repeat(start[code] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
                    s = np.bincount(who[at] * n + np.repeat(doc, many), weight[at] * np.repeat(worth, many), len(names) * n).reshape(len(names), n)
                    least = -np.partition(-s, min(k, n) - 1, axis=1)[:, min(k, n) - 1]
                    # what ties with the last place to nine digits goes along: ids decide later
                    q, d = np.nonzero((s >= least[:, None] - 2e-9) & (s > 0))
                    yield pa.RecordBatch.from_arrays([asked.take(pa.array(q)), part.column(0).take(pa.array(d)), pa.array(s[q, d])], names=["query_id", "id", "score"])

        return _best(self.rows.select("id", "dl", "norm", "words").mapInArrow(run, f"query_id {q_type}, id {id_type}, score double"), k)


def profiles(docs: DataFrame, queries: DataFrame, id_col: str = "id", text_col: str = "text", query_id: str = "query_id", query_text: str = "query", kept: Column | None = None) -> Profiles:
    """One scan of the documents for all lists of a search.

    Up to BROADCAST_BYTES of query terms, counted as they come, go to every
    task and other terms are left behind in it; more are joined afterwards.
    kept marks the rows that a filter lets through.
    """
    asked = query_terms(queries, query_id, query_text)
    most = BROADCAST_BYTES // TERM_BYTES
    found = asked.limit(most + 1).toArrow()
    known = list(zip(*(found.column(c).to_pylist() for c in ("query_id", "term", "qtf")))) if found.num_rows <= most else None
    wanted = None if known is None else pa.array(sorted({t for _, t, _ in known}), pa.string())
    inner = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), (F.lit(True) if kept is None else F.coalesce(kept, F.lit(False))).alias("kept"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in steps(batches, "text"):
            words = Words(part.column(1))
            doc, code, n = words.counts()
            norm = np.sqrt(np.bincount(doc, n.astype(np.float64) ** 2, words.texts))
            if wanted is not None:
                own = pc.is_in(words.terms, wanted).to_numpy(zero_copy_only=False)[code] if len(code) else np.zeros(0, bool)
                doc, code, n = doc[own], code[own], n[own]
            offs = np.searchsorted(doc, np.arange(words.texts + 1)).astype(np.int32)
            items = pa.StructArray.from_arrays([words.terms.take(pa.array(code)), pa.array(n)], names=["term", "tf"])
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(words.lengths().astype(np.int32)), pa.array(norm), part.column(2), pa.ListArray.from_arrays(pa.array(offs), items)], names=["id", "dl", "norm", "kept", "words"])

    rows = cut(inner.mapInArrow(run, f"id {inner.schema['id'].dataType.simpleString()}, dl int, norm double, kept boolean, words array<struct<term string, tf bigint>>"))
    if known is None:
        terms = asked.select("term").distinct()
        held = rows.select("id", F.inline("words")).join(terms, "term").groupBy("id").agg(F.collect_list(F.struct("term", "tf")).alias("words"))
        rows = cut(rows.drop("words").join(held, "id", "left"))
    return Profiles(rows, asked, known, found.schema.field("query_id").type)


def bm25(docs: DataFrame, queries: DataFrame, k: int | None = None, id_col: str = "id", text_col: str = "text", query_id: str = "query_id", query_text: str = "query", k1: float = K1, b: float = B) -> DataFrame:
    """query_id, id, score, rank for every query; rows without a query term have none. k: only so many of each query.

    A term repeated in a query counts as often.
    """
    if k is not None:
        check_k(k)
    return bm25_of(profiles(docs, queries, id_col, text_col, query_id, query_text), k, k1, b)


def bm25_of(found: Profiles, k: int | None = None, k1: float = K1, b: float = B) -> DataFrame:
    if k is not None and found.known is not None:
        n, avgdl, df = found.facts()
        weights = [(q, t, qtf * math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5))) for q, t, qtf in found.known if t in df]
        return found.best(weights, lambda tf, dl, norm: tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl)), k)
    postings = found.postings()
    return rank(postings, document_frequency(postings), _stats(found.rows), found.asked, k, _hint(found), k1, b)


def _hint(found: Profiles):
    """The queries bound every side that follows from them."""
    return (lambda df: df) if found.known is None else F.broadcast


def rank(postings: DataFrame, df: DataFrame, stats: DataFrame, asked: DataFrame, k: int | None, hint, k1: float = K1, b: float = B) -> DataFrame:
    """query_id, id, score, rank from postings (id, term, tf, dl), df (term, df), stats (n, avgdl, one row) and query_terms()."""
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weights = asked.join(df, "term").crossJoin(F.broadcast(stats)).select("query_id", "term", (F.col("qtf") * idf).alias("w"), "avgdl")
    tf = F.col("tf")
    part = F.col("w") * (tf * (k1 + 1)) / (tf + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    found = postings.join(hint(weights), "term").groupBy("query_id", "id").agg(F.sum(part).alias("score")).where("score > 0")
    return _best(found, k)


def _best(found: DataFrame, k: int | None) -> DataFrame:
    best = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "id")
    ranked = found.withColumn("rank", F.row_number().over(best))
    return ranked if k is None else ranked.where(F.col("rank") <= k)


def bag_cosine(docs: DataFrame, queries: DataFrame, k: int | None = None, id_col: str = "id", text_col: str = "text", query_id: str = "query_id", query_text: str = "query") -> DataFrame:
    """query_id, id, score, rank by the cosine of word counts: a dense model's stand-in, joined by term and never made dense.

    Query terms outside the corpus don't count for the query's length.
    """
    return bag_cosine_of(profiles(docs, queries, id_col, text_col, query_id, query_text), k)


def bag_cosine_of(found: Profiles, k: int | None = None) -> DataFrame:
    if k is not None and found.known is not None:
        df = found.facts()[2]
        square: dict = {}
        for q, t, qtf in found.known:
            if t in df:
                square[q] = square.get(q, 0) + qtf * qtf
        return found.best([(q, t, qtf / math.sqrt(square[q])) for q, t, qtf in found.known if t in df], lambda tf, dl, norm: tf / norm, k)
    held, hint = found.postings(), _hint(found)
    # of the corpus only whether it has a query's term at all
    asked = found.asked.join(held.select("term").distinct(), "term", "left_semi")
    length = asked.groupBy("query_id").agg(F.sqrt(F.sum(F.col("qtf") * F.col("qtf"))).alias("qnorm"))
    dots = held.join(hint(asked), "term").groupBy("query_id", "id").agg(F.sum(F.col("tf") * F.col("qtf")).alias("dot"), F.first("norm").alias("norm"))
    return _best(dots.join(hint(length), "query_id").select("query_id", "id", (F.col("dot") / (F.col("norm") * F.col("qnorm"))).alias("score")), k)
