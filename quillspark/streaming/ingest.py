"""Micro-batches into a collection: each batch upserts, the last row of an id by sequence wins.

A batch that runs again after a failure writes the same rows under the same
sequence numbers, so the state doesn't change.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from quillspark.operators import sparse
from quillspark.session import fits
from quillspark.sources.collection import Collection

FILES_PER_BATCH, INTERVAL = 100, "100 milliseconds"


def last_by_key(batch: DataFrame, key: str, seq: str) -> DataFrame:
    """The row of each key with the highest sequence: deletes and puts stay in their order."""
    order = Window.partitionBy(key).orderBy(F.desc(seq))
    return batch.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def ingest(stream: DataFrame, collection: Collection, checkpoint: str, once: bool = True, interval: str = INTERVAL) -> StreamingQuery:
    """A running query that puts a stream of id, vector, metadata, timestamp, seq, deleted into a collection."""

    def write(batch: DataFrame, batch_id: int) -> None:
        collection.append(last_by_key(batch, "id", "seq"))

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=interval)).start()


def upsert_table(stream: DataFrame, path: str, key: str, seq: str, checkpoint: str) -> StreamingQuery:
    """The last row of each key of a finite stream in a table of batches, each under its own batch's folder."""

    def write(batch: DataFrame, batch_id: int) -> None:
        last_by_key(batch, key, seq).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_upserts(spark: SparkSession, path: str, key: str, seq: str) -> DataFrame:
    """The state: the latest row of each key over all batches."""
    rows = spark.read.parquet(path).drop("batch")
    return rows.groupBy(F.col(key).alias("_k")).agg(F.max_by(F.struct(*rows.columns), F.col(seq)).alias("r")).select("r.*")


def term_counts(stream: DataFrame, text_col: str = "text") -> DataFrame:
    """Document frequencies of a growing corpus, for output in update mode."""
    from quillspark.functions.text import tokenize

    return stream.select(F.explode(F.array_distinct(tokenize(F.col(text_col)))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def index_terms(stream: DataFrame, path: str, checkpoint: str, id_col: str = "id", text_col: str = "text", seq: str = "seq") -> StreamingQuery:
    """A growing keyword index of a finite stream of documents (id, text, seq, deleted): each batch adds its postings under its own folder.

    A batch that runs again writes the same folder again. A later row of an id
    replaces the earlier one's postings when they are read; a deleted one has none.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = last_by_key(batch, id_col, seq)
        dead = F.coalesce(F.col("deleted"), F.lit(False)) if "deleted" in rows.columns else F.lit(False)
        rows = rows.select(F.col(id_col).alias("id"), F.when(~dead, F.col(text_col)).alias("text"), F.col(seq).cast("bigint").alias("seq"), dead.alias("deleted")).persist()
        sizes = sparse.lengths(rows)
        sizes.join(rows.select("id", "seq", "deleted"), "id").write.mode("overwrite").parquet(f"{path}/documents/batch={batch_id}")
        sparse.tokens(rows).write.mode("overwrite").parquet(f"{path}/postings/batch={batch_id}")
        rows.unpersist()

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def search_terms(spark: SparkSession, path: str, queries: DataFrame, k: int, query_id: str = "query_id", query_text: str = "query") -> DataFrame:
    """BM25 over what index_terms() has written so far: query_id, id, score, rank."""
    docs = spark.read.parquet(f"{path}/documents")
    newest = docs.groupBy("id").agg(F.max_by(F.struct("batch", "dl", "deleted"), F.struct("seq", "batch")).alias("r")).select("id", "r.*").where("not deleted")
    asked = sparse.query_terms(queries, query_id, query_text)
    hint = F.broadcast if fits(asked) else (lambda df: df)
    # of the postings only the query terms' are joined with the documents that hold
    held = spark.read.parquet(f"{path}/postings").join(hint(asked.select("term").distinct()), "term").drop("dl")
    postings = held.join(newest.select("id", "batch", "dl"), ["id", "batch"]).select("id", "term", "tf", "dl")
    stats = newest.agg(F.count("*").alias("n"), F.coalesce(F.avg("dl"), F.lit(0.0)).alias("avgdl"))
    return sparse.rank(postings, sparse.document_frequency(postings), stats, asked, k, hint)


class Progress(StreamingQueryListener):
    """Rows taken in so far, and what each batch took."""

    def __init__(self):
        self.rows, self.batches = 0, []

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        self.rows += event.progress.numInputRows
        self.batches.append((event.progress.batchId, event.progress.numInputRows))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass
