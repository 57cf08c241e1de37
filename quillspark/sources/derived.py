"""Indexes as tables on disk: vectors by cell, postings by term. Both can be made again from their rows at any time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.errors import check_k
from quillspark.operators import search, sparse
from quillspark.session import fits

PARTS = 64


def write_cells(rows: DataFrame, cells: DataFrame, path: str, id_col: str = "id", vector_col: str = "vector", files_per_cell: int = 1) -> None:
    """rows in a folder for each cell (cells: cell, centroid), the cells beside them; a large cell takes several files."""
    placed = search.assign_cells(rows, cells, vector_col)
    spread = placed.repartition(F.col("cell"), F.pmod(F.xxhash64(id_col), F.lit(files_per_cell)))
    spread.write.mode("overwrite").partitionBy("cell").parquet(f"{path}/rows")
    cells.write.mode("overwrite").parquet(f"{path}/cells")


def search_cells(spark: SparkSession, path: str, vector, k: int, probes: int, metric: str = "cosine", id_col: str = "id", vector_col: str = "vector") -> DataFrame:
    """The k nearest rows of the probed cells: the scan opens their folders alone."""
    near = [r["cell"] for r in search.probed(spark.read.parquet(f"{path}/cells"), vector, probes, metric).collect()]
    rows = spark.read.parquet(f"{path}/rows").where(F.col("cell").isin(near))
    return search.top_k(rows, vector, k, metric, id_col, vector_col)


def write_postings(docs: DataFrame, path: str, id_col: str = "id", text_col: str = "text", parts: int = PARTS) -> None:
    """Postings and document frequencies in a folder for each hash of terms, and the corpus's figures.

    Each task writes the postings of its own documents, by term, to all folders:
    nothing is shuffled but the frequencies, and documents are tokenised once.
    """
    part = F.pmod(F.xxhash64("term"), F.lit(parts)).cast("int")
    found = sparse.tokens(docs, id_col, text_col).withColumn("part", part)
    found.sortWithinPartitions("part", "term").write.mode("overwrite").partitionBy("part").parquet(f"{path}/postings")
    stored = docs.sparkSession.read.schema(found.schema).parquet(f"{path}/postings")
    stored.groupBy("part", "term").agg(F.count("*").alias("df")).write.mode("overwrite").partitionBy("part").parquet(f"{path}/df")
    # the lengths of all documents add up to the terms' counts
    total = stored.agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("total"))
    n = docs.agg(F.count("*").alias("n"))
    stats = n.crossJoin(total).select("n", F.coalesce(F.col("total") / F.nullif("n", F.lit(0)), F.lit(0.0)).alias("avgdl"), F.lit(parts).alias("parts"))
    stats.write.mode("overwrite").parquet(f"{path}/stats")


def search_postings(spark: SparkSession, path: str, queries: DataFrame, k: int, query_id: str = "query_id", query_text: str = "query") -> DataFrame:
    """bm25() from the stored tables: folders without a query term aren't opened."""
    check_k(k)
    stats = spark.read.parquet(f"{path}/stats")
    parts = stats.first()["parts"]
    asked = sparse.query_terms(queries, query_id, query_text)
    hint = F.broadcast if fits(asked) else (lambda df: df)
    terms = asked.select("term", F.pmod(F.xxhash64("term"), F.lit(parts)).cast("int").alias("part")).distinct()
    # at most `parts` numbers; as literals they prune folders before the scan is planned
    wanted = [r["part"] for r in terms.select("part").distinct().collect()]
    held, df = (spark.read.parquet(f"{path}/{t}").where(F.col("part").isin(wanted)).join(hint(terms), ["part", "term"]) for t in ("postings", "df"))
    return sparse.rank(held.select("id", "term", "tf", "dl"), df.select("term", "df"), stats.select("n", "avgdl"), asked, k, hint)
