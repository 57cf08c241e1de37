"""Ranked lists fused and ranked again."""


from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.errors import check_k
from quillspark.functions.bind import let
from quillspark.functions.text import tokenize
from quillspark.operators import sparse

RRF_K, WEIGHT = 60, 0.5


def reciprocal_rank_fusion(dense: DataFrame, keyword: DataFrame, k: int | None = None, rrf_k: int = RRF_K, dense_weight: float = WEIGHT, keyword_weight: float = WEIGHT) -> DataFrame:
    """query_id, id, dense_rank, sparse_rank, score, rank from two lists of query_id, id, rank.

    An id in one list alone has a null rank in the other. Ties go to the better
    dense rank, then sparse rank, then id.
    """
    a = dense.select("query_id", "id", F.col("rank").cast("int").alias("dense_rank"))
    b = keyword.select("query_id", "id", F.col("rank").cast("int").alias("sparse_rank"))
    both = a.join(b, ["query_id", "id"], "full_outer")
    score = F.coalesce(dense_weight / (rrf_k + F.col("dense_rank")), F.lit(0.0)) + F.coalesce(keyword_weight / (rrf_k + F.col("sparse_rank")), F.lit(0.0))
    best = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), F.asc_nulls_last("dense_rank"), F.asc_nulls_last("sparse_rank"), "id")
    ranked = both.withColumn("score", score).withColumn("rank", F.row_number().over(best))
    return ranked if k is None else ranked.where(F.col("rank") <= k)


def hybrid(docs: DataFrame, queries: DataFrame, k: int, where: Column | None = None, faithful: bool = False, id_col: str = "id", text_col: str = "text", query_id: str = "query_id", query_text: str = "query") -> DataFrame:
    """Word-count cosine and BM25, 4 k of each fused, the best k of each query.

    The filter holds for both lists; faithful leaves it to the dense one, as a
    caller of the older behaviour may expect.
    """
    check_k(k)
    # one scan: a filter that holds for both lists goes into it, one for the dense list alone is a mark
    rows = docs if where is None or faithful else docs.where(where)
    found = sparse.profiles(rows, queries, id_col, text_col, query_id, query_text, where if faithful else None)
    dense = sparse.bag_cosine_of(found.kept() if faithful else found, 4 * k)
    words = sparse.bm25_of(found, 4 * k)
    return reciprocal_rank_fusion(dense, words, k)


def lexical_rerank(hits: DataFrame, top_n: int | None = None, query_text: str = "query", content: str = "text") -> DataFrame:
    """hits (query_id, id, score, rank and both texts) by how many of the candidate's tokens are query terms, then by score.

    Only the first top_n of each query are ranked again; the others follow in
    their old order. overlap and new_rank are added.
    """
    overlap = let(F.array_distinct(tokenize(F.col(query_text))), lambda terms: F.size(F.filter(tokenize(F.col(content)), lambda t: F.array_contains(terms, t))))
    head = F.lit(True) if top_n is None else F.col("rank") <= top_n
    marked = hits.withColumn("_head", head).withColumn("overlap", F.when(F.col("_head"), F.greatest(overlap, F.lit(0))))
    order = Window.partitionBy("query_id").orderBy(F.desc("_head"), F.desc_nulls_last("overlap"), F.when(F.col("_head"), -F.round("score", 9)), "rank")
    return marked.withColumn("new_rank", F.row_number().over(order)).drop("_head")


def noop_rerank(hits: DataFrame) -> DataFrame:
    """hits as they are, with new_rank the old one: for where a reranker is asked for and none is wanted."""
    return hits.withColumn("new_rank", F.col("rank"))


def with_dense_rows(fused: DataFrame, dense: DataFrame, columns: list[str], empty: dict[str, Column] | None = None) -> DataFrame:
    """fused with columns of the dense list's rows (query_id, id); what the keyword list alone found is a stub, with the values of `empty` or null."""
    joined = fused.join(dense.select("query_id", "id", *columns), ["query_id", "id"], "left")
    return joined.select(*fused.columns, *(F.coalesce(F.col(c), (empty or {}).get(c, F.lit(None))).alias(c) for c in columns))


def model_rerank(hits: DataFrame, make, query_text: str = "query", content: str = "text", most: int = 512) -> DataFrame:
    """hits with rerank_score and new_rank from a model of text pairs; make() builds it once in each worker.

    Lists of one candidate keep their order; a model that fails leaves all of its
    batch as they were.
    """

    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = make()
        for q, c in batches:
            try:
                yield pd.Series(model(q.fillna("").tolist(), c.fillna("").str.slice(0, most).tolist()), dtype="float64")
            except Exception:  # an unavailable model passes its candidates through
                yield pd.Series([None] * len(q), dtype="float64")

    judge = F.pandas_udf(score, "double")
    order = Window.partitionBy("query_id").orderBy(F.desc_nulls_last("rerank_score"), "rank")
    return hits.withColumn("rerank_score", judge(F.col(query_text), F.col(content))).withColumn("new_rank", F.row_number().over(order))
