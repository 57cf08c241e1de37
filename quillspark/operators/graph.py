"""A stored graph index: layered small-world graphs, one for each shard of rows, as a table.

A vector enters at a layer drawn from its id, is linked to the nearest that a
best-first search from above finds, and both sides keep their nearest links.
Each shard is a row of the table; adding rows touches the shards they belong to,
removed rows stay as way points and are left out of results, as are those a
filter leaves out.
"""

from __future__ import annotations

import heapq
import io
import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.errors import DimensionMismatch, check_k
from quillspark.session import cut, fits

M, BUILD_WIDTH, WIDTH, SHARD_ROWS = 16, 200, 64, 20_000
METRICS = ("cosine", "dot", "euclidean")
#: What a query or an id takes at most of memory, for the bound on those that go to every task.
QUERY_BYTES = 8192
#: Queries that one graph answers before it is read again, and those that are multiplied with all of its rows at a time.
BLOCK, STEP = 4096, 256
#: Rows of a graph up to which a search is as wide as it says; beyond, wider by the root of how many times more there are.
WIDTH_ROWS = 1024


def _level(key: int, m: int) -> int:
    """The highest layer of a row: geometric, the same for an id whenever it enters."""
    x = (key * 0x9E3779B97F4A7C15 + 0x7F4A7C15) & (2**64 - 1)
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & (2**64 - 1)
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & (2**64 - 1)
    u = ((x ^ (x >> 31)) + 1) / 2**64
    return min(int(-math.log(u) / math.log(m)), 12)


class Graph:
    """One shard's vectors, their layers and links, in memory."""

    def __init__(self, dimensions: int, metric: str = "cosine", m: int = M, width: int = BUILD_WIDTH):
        self.dimensions, self.metric, self.m, self.width = dimensions, metric, m, width
        self.ids = np.zeros(0, np.int64)
        self.points = np.zeros((0, dimensions), np.float32)
        self.gone = np.zeros(0, bool)
        self.links: list[dict[int, np.ndarray]] = []
        self.number: dict[int, int] = {}
        self.entry, self.top = -1, -1
        self.used = 0

    def _room(self) -> None:
        if self.used == len(self.ids):
            more = max(64, self.used)
            self.ids = np.append(self.ids, np.zeros(more, np.int64))
            self.gone = np.append(self.gone, np.zeros(more, bool))
            self.points = np.vstack([self.points, np.zeros((more, self.dimensions), np.float32)])

    def _prepared(self, vector) -> np.ndarray:
        v = np.asarray(vector, np.float32)
        if v.shape != (self.dimensions,):
            raise DimensionMismatch(self.dimensions, len(v))
        if self.metric == "cosine":
            length = float(np.linalg.norm(v))
            v = v / np.float32(length) if length else v
        return v

    def _away(self, q: np.ndarray, who: np.ndarray) -> np.ndarray:
        x = self.points[who]
        if self.metric == "euclidean":
            d = x - q
            return np.sqrt(np.einsum("ij,ij->i", d, d))
        return (1 if self.metric == "cosine" else 0) - x @ q

    def _walk(self, q: np.ndarray, starts: list[tuple[float, int]], width: int, layer: int) -> list[tuple[float, int]]:
        """The `width` nearest that best-first search meets on a layer, nearest first."""
        seen = {i for _, i in starts}
        todo = list(starts)
        heapq.heapify(todo)
        best = [(-d, i) for d, i in starts]
        heapq.heapify(best)
        while todo:
            d, i = heapq.heappop(todo)
            if len(best) >= width and d > -best[0][0]:
                break
            near = [j for j in self.links[i].get(layer, _NOBODY).tolist() if j not in seen]
            if not near:
                continue
            seen.update(near)
            for away, j in zip(self._away(q, np.array(near)).tolist(), near):
                if len(best) < width or away < -best[0][0]:
                    heapq.heappush(todo, (away, j))
                    heapq.heappush(best, (-away, j))
                    if len(best) > width:
                        heapq.heappop(best)
        return sorted((-d, i) for d, i in best)

    def _descend(self, q: np.ndarray, to: int) -> list[tuple[float, int]]:
        at = [(float(self._away(q, np.array([self.entry]))[0]), self.entry)]
        for layer in range(self.top, to, -1):
            at = self._walk(q, at, 1, layer)
        return at

    def insert(self, id_: int, vector) -> None:
        """Adds a row; one that is there already is marked gone first."""
        self.remove(id_)
        q = self._prepared(vector)
        self._room()
        new, level = self.used, _level(id_, self.m)
        self.ids[new], self.points[new], self.gone[new] = id_, q, False
        self.links.append({layer: _NOBODY for layer in range(level + 1)})
        self.number[id_] = new
        self.used += 1
        if self.entry < 0:
            self.entry, self.top = new, level
            return
        at = self._descend(q, level)
        for layer in range(min(level, self.top), -1, -1):
            at = self._walk(q, at, self.width, layer)
            most = 2 * self.m if layer == 0 else self.m
            near = np.array([i for _, i in at[: self.m]])
            self.links[new][layer] = near
            for i in near.tolist():
                held = np.append(self.links[i].get(layer, _NOBODY), new)
                if len(held) > most:
                    held = held[np.argsort(self._away(self.points[i], held), kind="stable")[:most]]
                self.links[i][layer] = held
        if level > self.top:
            self.entry, self.top = new, level

    def remove(self, id_: int) -> bool:
        """Marks a row as gone; its links stay for others to pass."""
        at = self.number.pop(id_, None)
        if at is None:
            return False
        self.gone[at] = True
        return True

    def search(self, vector, k: int, width: int = WIDTH, allowed: set | None = None) -> list[tuple[int, float]]:
        """(id, distance) of the k nearest rows that are there and allowed; ties by id."""
        if self.entry < 0:
            return []
        q = self._prepared(vector)
        width = self._wide(width, k)
        while True:
            met = self._walk(q, self._descend(q, 0), width, 0)
            out = [(d, int(self.ids[i])) for d, i in met if not self.gone[i] and (allowed is None or int(self.ids[i]) in allowed)]
            # rows that don't count took their places: look wider
            if len(out) >= k or width >= self.used:
                return [(i, d) for d, i in sorted(out)[:k]]
            width *= 4

    def _wide(self, width: int, k: int) -> int:
        """A search of one width misses the more the larger a graph is."""
        return max(k, math.ceil(width * max(1.0, self.used / WIDTH_ROWS) ** 0.5))

    def search_many(self, vectors: np.ndarray, k: int, width: int = WIDTH, allowed: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which query, id and score of the k nearest rows of each that are there and allowed; ties (to 6 places) by id.

        A graph of so few rows that a walk may touch them all is scored as a whole.
        """
        if self.used > self._wide(width, k) * 2 * self.m:
            some = None if allowed is None else set(allowed.tolist())
            found = [(q, i, d) for q, v in enumerate(vectors) for i, d in self.search(v, k, width, some)]
            who, ids, away = (np.array([f[n] for f in found], t) for n, t in enumerate((np.int64, np.int64, np.float64)))
            return who, ids, self._score(away)
        there = np.flatnonzero(~self.gone[: self.used])
        if allowed is not None:
            there = there[np.isin(self.ids[there], allowed)]
        ids, x = self.ids[there], self.points[there].astype(np.float64)
        q = np.asarray(vectors, np.float32)
        if self.metric == "cosine":
            length = np.linalg.norm(q, axis=1, keepdims=True)
            q = q / np.where(length == 0, np.float32(1), length)
        q = q.astype(np.float64)
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        for a in range(0, len(q) if len(ids) else 0, STEP):
            part = q[a : a + STEP]
            s = part @ x.T
            if self.metric == "euclidean":
                s = self._score(np.sqrt(np.maximum((part * part).sum(1)[:, None] + (x * x).sum(1)[None] - 2 * s, 0)))
            n = min(k, len(ids))
            r, c = np.nonzero(s >= np.partition(s, len(ids) - n, axis=1)[:, len(ids) - n, None] - 2e-6)
            turn = np.lexsort((ids[c], -np.round(s[r, c], 6), r))
            r, c = r[turn], c[turn]
            many = np.bincount(r, minlength=len(part))
            keep = np.arange(len(r)) - (np.cumsum(many) - many)[r] < k
            out.append((r[keep] + a, ids[c[keep]], s[r[keep], c[keep]]))
        return tuple(np.concatenate(x) for x in zip(*out))

    def _score(self, away: np.ndarray) -> np.ndarray:
        return 1 - away if self.metric == "cosine" else -away if self.metric == "dot" else 1 / (1 + away)

    def live(self) -> int:
        return len(self.number)

    def to_bytes(self) -> bytes:
        n = self.used
        owner = [(i, layer, near) for i in range(n) for layer, near in self.links[i].items()]
        sink = io.BytesIO()
        np.savez(
            sink, ids=self.ids[:n], points=self.points[:n], gone=self.gone[:n], entry=[self.entry, self.top], node=[o[0] for o in owner], layer=[o[1] for o in owner], count=[len(o[2]) for o in owner],
            flat=np.concatenate([o[2] for o in owner]) if owner else _NOBODY, facts=[self.dimensions, METRICS.index(self.metric), self.m, self.width],
        )
        return sink.getvalue()

    @classmethod
    def from_bytes(cls, raw: bytes) -> Graph:
        held = np.load(io.BytesIO(raw))
        d, metric, m, width = held["facts"].tolist()
        out = cls(d, METRICS[metric], m, width)
        out.ids, out.points, out.gone = held["ids"], held["points"], held["gone"].astype(bool)
        out.used = len(out.ids)
        out.entry, out.top = held["entry"].tolist()
        out.links = [{} for _ in range(out.used)]
        to = np.cumsum(held["count"])
        for i, layer, a, b in zip(held["node"].tolist(), held["layer"].tolist(), (to - held["count"]).astype(int).tolist(), to.astype(int).tolist()):
            out.links[i][layer] = held["flat"][a:b].astype(np.int64)
        out.number = {int(i): n for n, i in enumerate(out.ids) if not out.gone[n]}
        return out


_NOBODY = np.zeros(0, np.int64)
_STORED = "shard int, shards int, live bigint, gone bigint, graph binary"


class GraphIndex:
    """Graphs of all shards in a folder of versions; the newest whole one counts, so readers and a lost writer do no harm."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _versions(self) -> list[str]:
        jvm = self.spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(at):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(at)]
        return sorted(n for n in names if n.startswith("v-") and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{self.path}/{n}/_SUCCESS")))

    def table(self) -> DataFrame | None:
        found = self._versions()
        return self.spark.read.parquet(f"{self.path}/{found[-1]}") if found else None

    def _write(self, graphs: DataFrame) -> None:
        found = self._versions()
        graphs.write.parquet(f"{self.path}/v-{int(found[-1].split('-')[1]) + 1 if found else 0:08d}-{uuid.uuid4().hex[:8]}")

    def build(self, rows: DataFrame, dimensions: int, metric: str = "cosine", m: int = M, width: int = BUILD_WIDTH, shard_rows: int = SHARD_ROWS, id_col: str = "id", vector_col: str = "vector") -> None:
        """A graph for each shard of rows; as many shards as hold shard_rows rows each."""
        shards = max(1, -(-rows.count() // shard_rows))

        def make(group: pa.Table) -> pa.Table:
            graph = Graph(dimensions, metric, m, width)
            _add(graph, group)
            return _row(group.column("shard")[0].as_py(), shards, graph)

        self._write(_sharded(rows, shards, id_col, vector_col).groupBy("shard").applyInArrow(make, _STORED))

    def add(self, rows: DataFrame, removed: DataFrame | None = None, id_col: str = "id", vector_col: str = "vector") -> None:
        """Rows put in (an id that is there is replaced) and ids taken out: the next version of the shards."""
        old = self.table()
        if old is None:
            raise ValueError("there is no index to add to")
        facts = old.select("shards").first()
        shards = facts["shards"]
        new = _sharded(rows, shards, id_col, vector_col)
        if removed is not None:
            gone = removed.select(F.col(id_col).cast("bigint").alias("id"), F.lit(None).cast("array<float>").alias("v"))
            new = new.unionByName(gone.withColumn("shard", _shard_of(F.col("id"), shards)))
        first = Graph.from_bytes(old.select("graph").first()["graph"])
        shape = (first.dimensions, first.metric, first.m, first.width)

        def change(stored: pa.Table, group: pa.Table) -> pa.Table:
            graph = Graph.from_bytes(stored.column("graph")[0].as_py()) if stored.num_rows else Graph(*shape)
            shard = (stored if stored.num_rows else group).column("shard")[0].as_py()
            # rows without a vector are those to be taken out
            for i in group.filter(group.column("v").is_null()).column("id").to_pylist():
                graph.remove(i)
            _add(graph, group.filter(group.column("v").is_valid()))
            return _row(shard, shards, graph)

        self._write(old.groupBy("shard").cogroup(new.groupBy("shard")).applyInArrow(change, _STORED))

    def search(self, queries: DataFrame, k: int, width: int = WIDTH, allowed: DataFrame | None = None, query_id: str = "query_id", query_vector: str = "query_vector", id_col: str = "id") -> DataFrame:
        """query_id, id, score, rank: the k nearest that are there, of all shards. allowed: the ids a filter lets through."""
        check_k(k)
        stored = self.table()
        asked = queries.select(F.col(query_id).cast("bigint").alias("q"), F.col(query_vector).cast("array<float>").alias("v")).where("v is not null")
        parts = max(1, -(-asked.count() // BLOCK))
        packed = asked.withColumn("part", F.pmod(F.xxhash64("q"), F.lit(parts))).groupBy("part").agg(F.collect_list(F.struct("q", "v")).alias("asked")).drop("part")
        packed = F.broadcast(packed) if fits(asked, QUERY_BYTES) else cut(packed)
        rows = stored.select("shard", "graph")
        if allowed is None:
            rows = rows.withColumn("ids", F.lit(None).cast("array<bigint>"))
        else:
            shards = stored.select("shards").first()["shards"]
            own = allowed.select(F.col(id_col).cast("bigint").alias("id")).withColumn("shard", _shard_of(F.col("id"), shards)).groupBy("shard").agg(F.collect_list("id").alias("ids"))
            rows = rows.join(own, "shard")

        def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in range(batch.num_rows):
                    graph = Graph.from_bytes(batch.column(0)[row].as_py())
                    ids = batch.column(1)[row]
                    ids = ids.values.to_numpy(zero_copy_only=False) if ids.is_valid else None
                    block = batch.column(2)[row].values
                    q, v = block.field("q"), block.field("v")
                    sizes = v.value_lengths().to_numpy()
                    if (sizes != graph.dimensions).any():
                        raise DimensionMismatch(graph.dimensions, int(sizes[sizes != graph.dimensions][0]))
                    who, i, score = graph.search_many(v.flatten().to_numpy(zero_copy_only=False).reshape(-1, graph.dimensions), k, width, ids)
                    if len(who):
                        yield pa.RecordBatch.from_pydict({"query_id": q.take(pa.array(who)), "id": pa.array(i), "score": pa.array(score)})

        found = rows.crossJoin(packed).select("graph", "ids", "asked").mapInArrow(ask, "query_id bigint, id bigint, score double")
        best = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 6)), "id")
        return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)

    def stats(self) -> DataFrame:
        """shards, live and gone rows in one row."""
        return self.table().agg(F.count("*").alias("shards"), F.sum("live").alias("live"), F.sum("gone").alias("gone"))


def _shard_of(id_, shards: int):
    return F.pmod(F.xxhash64(id_), F.lit(shards)).cast("int")


def _sharded(rows: DataFrame, shards: int, id_col: str, vector_col: str) -> DataFrame:
    valid = rows.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).cast("array<float>").alias("v")).dropna()
    return valid.withColumn("shard", _shard_of(F.col("id"), shards))


def _add(graph: Graph, group: pa.Table) -> None:
    group = group.combine_chunks().sort_by("id")
    for i, v in zip(group.column("id").to_pylist(), group.column("v").to_pylist()):
        graph.insert(i, v)


def _row(shard: int, shards: int, graph: Graph) -> pa.Table:
    return pa.table({"shard": pa.array([shard], pa.int32()), "shards": pa.array([shards], pa.int32()), "live": [graph.live()], "gone": [graph.used - graph.live()], "graph": pa.array([graph.to_bytes()], pa.binary())})
