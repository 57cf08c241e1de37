"""Seeded unit vectors, and how fast and how completely they are searched."""

from __future__ import annotations

import time

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from quillspark.functions.text import parse_sizes
from quillspark.operators import search


def points(rows: int, dimensions: int = 128, seed: int = 42) -> np.ndarray:
    """Gaussian directions of length 1."""
    x = np.random.default_rng(seed).standard_normal((rows, dimensions))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def table(spark: SparkSession, x: np.ndarray) -> DataFrame:
    """id, vector."""
    return spark.createDataFrame([(i, v.astype(float).tolist()) for i, v in enumerate(x)], "id bigint, vector array<float>")


def truth(x: np.ndarray, queries: int, k: int) -> list[set[int]]:
    """The k nearest of each of the first vectors, by brute force in numpy."""
    x = x.astype(np.float32).astype(np.float64)
    return [set(near.tolist()) for near in np.argsort(-(x[:queries] @ x.T), axis=1, kind="stable")[:, :k]]


def run(spark: SparkSession, scale: str = "1k,10k", queries: tuple[int, ...] = (200, 2000), k: int = 10, dimensions: int = 128) -> list[dict]:
    """For each size and number of queries: seconds for all queries as one batch, milliseconds a query, recall against brute force."""
    out = []
    for n in parse_sizes(scale):
        x = points(n, dimensions)
        rows = table(spark, x).persist()
        rows.count()
        for q in queries:
            q = min(q, n)
            asked = rows.where(f"id < {q}").selectExpr("id as query_id", "vector as query_vector")
            t = time.time()
            hits = search.batch_top_k(rows, asked, k).select("query_id", "id").toArrow()
            took = time.time() - t
            found: list[set[int]] = [set() for _ in range(q)]
            for i, j in zip(hits.column(0).to_pylist(), hits.column(1).to_pylist()):
                found[i].add(j)
            recall = float(np.mean([len(a & b) / min(k, n) for a, b in zip(found, truth(x, q, k))]))
            out.append({"rows": n, "dimensions": dimensions, "queries": q, "hits": hits.num_rows, "seconds": round(took, 3), "ms_a_query": round(1000 * took / q, 3), "recall": round(recall, 6)})
        rows.unpersist()
    return out
