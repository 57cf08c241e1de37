"""A collection: rows of id, vector, metadata and timestamp in a folder of Parquet files.

Writes append to a log beside a base of unique rows; the latest row of an id
counts, and a delete appends a tombstone. Readers take the base as it is, without
the ids of the log, so only the log is shuffled. compact() rewrites both into a
new base once dead rows outnumber 0.3 of the live ones. Each rewrite is a folder
of its own: readers take the newest whole one, so they never see a gap, and a
writer that is lost leaves the old one as it was. One writer at a time.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from quillspark.errors import DimensionMismatch, InvalidParams, check_vector, sanitise
from quillspark.functions.filters import Json, condition
from quillspark.operators import search
from quillspark.session import small

SCHEMA = "id string, vector array<float>, metadata string, timestamp bigint, seq bigint, deleted boolean"


def new_id() -> str:
    return f"{int(time.time() * 1000)}-{uuid.uuid4().hex[:9]}"


class Collection:
    def __init__(self, spark: SparkSession, folder: str, dimensions: int, metric: str = "cosine", embedder=None):
        if embedder is not None and embedder.dimensions != dimensions:
            raise DimensionMismatch(dimensions, embedder.dimensions)
        self.spark, self.folder, self.dimensions, self.metric, self.embedder = spark, folder.rstrip("/"), dimensions, metric, embedder

    # Tables

    def _fs(self):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def _versions(self) -> list[str]:
        """Names of whole tables, oldest first."""
        fs, at = self._fs()
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
        return sorted(n for n in names if n.startswith("vectors-") and fs.exists(path(f"{self.folder}/{n}/_SUCCESS")))

    def _current(self) -> str:
        return (self._versions() or ["vectors-00000000"])[-1]

    def _rewrite(self, rows: DataFrame) -> None:
        """Unique rows as the newest base, with an empty log. The one before stays for readers that have begun; older ones go."""
        now = int(self._current().split("-")[1])
        rows.write.mode("overwrite").parquet(f"{self.folder}/vectors-{now + 1:08d}")
        fs, at = self._fs()
        for found in list(fs.listStatus(at)):
            kind, _, number = found.getPath().getName().partition("-")
            if kind in ("vectors", "log") and number.isdigit() and int(number) < now:
                fs.delete(found.getPath(), True)

    def _base(self) -> DataFrame:
        return self._read(self._current())

    def _log(self) -> DataFrame:
        """What was written since the base."""
        return self._read(self._current().replace("vectors", "log"))

    def _read(self, name: str) -> DataFrame:
        try:
            return self.spark.read.schema(SCHEMA).parquet(f"{self.folder}/{name}")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], SCHEMA)

    def rows(self) -> DataFrame:
        """Live rows: id, vector, metadata (JSON), timestamp."""
        return self._live(self._base(), self._log())

    @staticmethod
    def _live(base: DataFrame, log: DataFrame) -> DataFrame:
        alive = ~F.coalesce("deleted", F.lit(False))
        columns = ("id", "vector", "metadata", "timestamp")
        newer = search.latest(log).where(alive).select(*columns)
        # the ids alone go to the base if their size allows
        return base.join(small(log.select("id").distinct()), "id", "left_anti").select(*columns).unionByName(newer)

    def append(self, rows: DataFrame) -> None:
        """Rows of id, vector, metadata as JSON, timestamp, seq, deleted; missing columns get their defaults."""
        now = int(time.time() * 1000)
        have = rows.columns
        defaults = {"metadata": F.lit("{}"), "timestamp": F.lit(now), "seq": F.monotonically_increasing_id(), "deleted": F.lit(False)}
        columns = [F.col(c) if c in have else defaults[c].alias(c) for c in ("id", "vector", "metadata", "timestamp", "seq", "deleted")]
        out = rows.select(*columns)
        out.select(*(F.col(c).cast(t).alias(c) for c, t in (x.split(" ", 1) for x in SCHEMA.split(", ")))).write.mode("append").parquet(f"{self.folder}/{self._current().replace('vectors', 'log')}")

    # Single records

    def _record(self, item: dict, i: int, now: int) -> tuple:
        vector, text = item.get("vector"), item.get("text")
        if vector is None and text is None:
            raise InvalidParams("an item needs a vector or a text")
        if vector is None:
            if self.embedder is None:
                raise InvalidParams("a text needs an embedder")
            vector = self.embedder.embed([text])[0]
        metadata = dict(sanitise(item.get("metadata") or {}))
        if text is not None:
            metadata["content"] = text
        metadata["timestamp"] = now
        return item.get("id") or new_id(), check_vector(vector, self.dimensions), json.dumps(metadata), now, i, False

    def insert_batch(self, items: Iterable[dict]) -> list[str]:
        """Ids of items with a vector or a text, and metadata; none is no write. Texts are embedded in one call."""
        items = [dict(x) for x in items]
        todo = [x for x in items if x.get("vector") is None and x.get("text") is not None]
        if todo and self.embedder is not None:
            for x, v in zip(todo, self.embedder.embed([x["text"] for x in todo])):
                x["vector"] = v
        now = int(time.time() * 1000)
        records = [self._record(x, i, now) for i, x in enumerate(items)]
        if records:
            self.append(self.spark.createDataFrame(records, SCHEMA))
        return [r[0] for r in records]

    def insert(self, item: dict) -> str:
        return self.insert_batch([item])[0]

    def get(self, id_: str) -> Row | None:
        found = self._live(*(rows.where(F.col("id") == id_) for rows in (self._base(), self._log()))).collect()
        return found[0] if found else None

    def get_batch(self, ids: list[str]) -> DataFrame:
        """Rows in the order asked, an id asked twice twice, missing ones left out."""
        return get_batch(self.rows(), ids)

    def update(self, id_: str, item: dict) -> bool:
        """Metadata merges by key; vector and content stay unless given. False if there is no such row."""
        old = self.get(id_)
        if old is None:
            return False
        metadata = json.loads(old["metadata"] or "{}") | dict(sanitise(item.get("metadata") or {}))
        vector = item.get("vector")
        if item.get("text") is not None:
            metadata["content"] = item["text"]
            if vector is None and self.embedder is not None:
                vector = self.embedder.embed([item["text"]])[0]
        now = max(int(time.time() * 1000), old["timestamp"] + 1)
        metadata["timestamp"] = now
        vector = check_vector(vector if vector is not None else old["vector"], self.dimensions)
        self.append(self.spark.createDataFrame([(id_, vector, json.dumps(metadata), now, 0, False)], SCHEMA))
        return True

    def delete(self, id_: str) -> bool:
        old = self.get(id_)
        if old is None:
            return False
        self.append(self.spark.createDataFrame([(id_, None, None, max(int(time.time() * 1000), old["timestamp"] + 1), 0, True)], SCHEMA))
        return True

    # Scans

    def count(self) -> int:
        return self.rows().count()

    def clear(self) -> None:
        self._rewrite(self.spark.createDataFrame([], SCHEMA))

    def destroy(self) -> None:
        """Removes the folder."""
        fs, at = self._fs()
        fs.delete(at, True)

    def filter(self, spec: dict | None) -> DataFrame:
        return self.rows().where(condition(spec, Json(F.col("metadata"))))

    def stream(self) -> Iterator[Row]:
        """Rows by id, a partition at a time."""
        return self.rows().orderBy("id").toLocalIterator(prefetchPartitions=True)

    def stats(self) -> DataFrame:
        return search.index_stats(self.rows())

    def search(self, k: int, vector=None, text: str | None = None, filter: dict | None = None, include_vectors: bool = False) -> DataFrame:  # noqa: A002
        """id, score, metadata of the k nearest among the rows that the filter lets through; a vector counts before a text."""
        if vector is None:
            if text is None or self.embedder is None:
                raise InvalidParams("a search needs a vector, or a text and an embedder")
            vector = self.embedder.embed([text])[0]
        where: Column = condition(filter, Json(F.col("metadata")))
        return search.top_k(self.rows(), check_vector(vector, self.dimensions), k, self.metric, where=where, keep=["metadata"], include_vectors=include_vectors)

    def compact(self, force: bool = False) -> bool:
        """Rewrites the live rows if dead ones are too many; True if it did. Readers see the old table until the new one is whole."""
        log = self._log()
        live = self.rows()
        n = live.count()
        if not (force or search.needs_compaction(n, self._base().count() + log.count() - n)):
            return False
        self._rewrite(live.withColumn("seq", F.lit(0).cast("bigint")).withColumn("deleted", F.lit(False)))
        return True


def get_batch(rows: DataFrame, ids: list, id_col: str = "id") -> DataFrame:
    """Rows by a list of ids: pos (place in the list) and all columns; the list is the broadcast side."""
    kind = rows.schema[id_col].dataType.simpleString()
    asked = rows.sparkSession.createDataFrame(list(enumerate(ids)), f"pos int, {id_col} {kind}")
    return rows.join(F.broadcast(asked), id_col).orderBy("pos")
