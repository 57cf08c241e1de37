"""Nearest vectors: exact top k for one or many queries, filters, cells, tombstones."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.errors import check_k
from quillspark.functions import vectors as V
from quillspark.session import cut, fits

#: A faithful post-filter looks at so many nearest rows, or k if that is more.
OVERSCAN = 50
#: What a query takes at most of memory, for the bound on those that go to every task.
QUERY_BYTES = 8192
#: Rows of a block, and queries that are multiplied with one at a time.
BLOCK, STEP = 4096, 512
#: Bytes of rows that a task meets with its queries at most, and tasks for each core where there are few queries.
SIDE_BYTES, TASKS = 64 << 20, 3


def literal(vector) -> Column:
    return F.array(*[F.lit(float(x)) for x in vector])


def scored(rows: DataFrame, query: Column, metric: str = "cosine", vector_col: str = "vector") -> DataFrame:
    return rows.withColumn("score", V.similarity(metric, F.col(vector_col), query))


def top_k(rows: DataFrame, vector, k: int, metric: str = "cosine", id_col: str = "id", vector_col: str = "vector", where: Column | None = None, keep: list[str] = (), include_vectors: bool = False) -> DataFrame:
    """The k rows nearest to a vector: id, score, kept columns. The filter comes first, ties go by id."""
    check_k(k)
    rows = rows if where is None else rows.where(where)
    columns = [id_col, "score", *keep, *([vector_col] if include_vectors else [])]
    return scored(rows, literal(vector), metric, vector_col).select(*columns).orderBy(F.desc("score"), id_col).limit(k)


def allowed_top_k(rows: DataFrame, allowed: DataFrame, vector, k: int, metric: str = "cosine", id_col: str = "id", vector_col: str = "vector") -> DataFrame:
    """top_k() among the rows whose ids are in a table: the ids come before the search, so k hits come back if so many are allowed."""
    return top_k(rows.join(allowed.select(id_col).distinct(), id_col, "left_semi"), vector, k, metric, id_col, vector_col)


def distinct_hits(hits: DataFrame, query_id: str = "query_id", id_col: str = "id") -> DataFrame:
    """hits with each id once for a query, where it scores best, ranked anew: for lists that met in several indexes."""
    best = hits.groupBy(query_id, id_col).agg(F.max("score").alias("score"))
    order = Window.partitionBy(query_id).orderBy(F.desc("score"), id_col)
    return best.withColumn("rank", F.row_number().over(order))


def post_filtered(rows: DataFrame, vector, k: int, where: Column, metric: str = "cosine", id_col: str = "id", vector_col: str = "vector", overscan: int = OVERSCAN) -> DataFrame:
    """The filter over the max(overscan, k) nearest alone, so that fewer than k can come back."""
    check_k(k)
    near = scored(rows, literal(vector), metric, vector_col).orderBy(F.desc("score"), id_col).limit(max(overscan, k))
    return near.where(where).orderBy(F.desc("score"), id_col).limit(k)


def batch_top_k(rows: DataFrame, queries: DataFrame, k: int, metric: str = "cosine", id_col: str = "id", vector_col: str = "vector", query_id: str = "query_id", query_vector: str = "query_vector", block: int = BLOCK) -> DataFrame:
    """query_id, id, score, rank: the k nearest rows of every query; ties by id.

    Queries and rows go as blocks of at most `block`. A task keeps the k best of
    its queries over all blocks of rows that it meets, and sends on those alone.
    Queries are broadcast if their size, counted before, allows it; otherwise the
    blocks of both sides are made once and meet pair by pair.
    """
    check_k(k)
    left = _blocks(queries, query_id, query_vector, block).toDF("q_ids", "q_points", "q_dim")
    right = _blocks(rows, id_col, vector_col, block).toDF("ids", "points", "dim")
    if fits(queries.select(query_id), QUERY_BYTES):
        pairs = right.crossJoin(F.broadcast(left.withColumn("q_block", F.monotonically_increasing_id())))
    else:
        pairs = _met(left, right)
    return _best(_multiplied(pairs, k, metric), k)


def within_cells(rows: DataFrame, queries: DataFrame, k: int, metric: str = "cosine", id_col: str = "id", vector_col: str = "vector", query_id: str = "query_id", query_vector: str = "query_vector", block: int = BLOCK) -> DataFrame:
    """batch_top_k() where a query meets the rows of its own cells alone. rows: with cell; queries: a row for each of a query's cells.

    Blocks are ranges of cell and id, so that a cell that holds most rows is many
    blocks in many tasks.
    """
    check_k(k)
    left = _blocks(queries, query_id, query_vector, block, "cell").toDF("q_ids", "q_points", "q_dim", "q_cell")
    right = _blocks(rows, id_col, vector_col, block, "cell").toDF("ids", "points", "dim", "cell")
    return _best(_multiplied(_met(left, right, "q_cell", "cell"), k, metric), k)


def _met(left: DataFrame, right: DataFrame, q_by: str | None = None, by: str | None = None) -> DataFrame:
    """Each block of queries with each of rows, or those of its own q_by: a task has a block or few of queries and at most some SIDE_BYTES of rows, whatever the sides' sizes."""
    left, right = cut(left.withColumn("q_block", F.monotonically_increasing_id())), cut(right)
    blocks = max(1, left.count())
    side = right.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("points")), F.lit(0)).alias("bytes")).first()
    spread = -(-TASKS * left.sparkSession.sparkContext.defaultParallelism // blocks)
    parts = max(1, min(max(-(-side["bytes"] // SIDE_BYTES), spread), side["n"]))
    pairs = left.repartition(blocks).hint("shuffle_replicate_nl").crossJoin(right.repartition(parts))
    # a difference, since an equality would become a join by cell: as few tasks as there are cells
    return pairs if by is None else pairs.where(F.col(q_by).cast("bigint") - F.col(by).cast("bigint") == 0)


def _best(pairs: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return pairs.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


class _Nearest:
    """The k best rows met so far of each query of a block, by score to 9 places and then id.

    A product in single precision proposes rows, with a bound on its error; what
    it can't rule out is scored in double precision. Vectors that aren't finite
    skip the proposal.
    """

    def __init__(self, ids: np.ndarray, points: np.ndarray, k: int, metric: str):
        self.ids, self.k, self.metric, self.met = ids, k, metric, 0
        self.points = points.astype(np.float64)
        self.length = np.sqrt((self.points**2).sum(1))
        self.odd = ~np.isfinite(self.length)
        self.side = self._side(self.points, self.length, self.odd, 1.0)
        self.best = np.full((len(ids), 0), -np.inf)
        self.who = np.zeros((len(ids), 0), np.int64)

    def _side(self, x: np.ndarray, length: np.ndarray, odd: np.ndarray, last) -> np.ndarray:
        """What is multiplied: unit vectors for cosine; for distances q x - x^2 / 2, which falls as they grow."""
        x = np.where(odd[:, None], 0.0, x) if odd.any() else x
        if self.metric == "cosine":
            return x / np.where((length == 0) | odd, 1.0, length)[:, None]
        return np.column_stack([x, np.broadcast_to(last, len(x))]) if self.metric == "euclidean" else x

    def _edge(self, product: np.ndarray, a: int) -> np.ndarray:
        """The least product that may still reach, to 9 places, the score of this one."""
        return self._product(self._score(product, a) - 1e-9, a)

    def _score(self, product: np.ndarray, a: int) -> np.ndarray:
        if self.metric != "euclidean":
            return product
        return 1 / (1 + np.sqrt(np.maximum(self.length[a : a + len(product)] ** 2 - 2 * product, 0)))

    def _product(self, score: np.ndarray, a: int) -> np.ndarray:
        if self.metric != "euclidean":
            return score
        away = 1 / np.where(score > 1e-9, score, 1.0) - 1
        return np.where(score > 1e-9, (self.length[a : a + len(score)] ** 2 - away * away) / 2, -np.inf)

    def add(self, ids: np.ndarray, points: np.ndarray) -> None:
        x = points.astype(np.float64)
        length = np.sqrt((x * x).sum(1))
        odd = ~np.isfinite(length)
        side = self._side(x, length, odd, np.where(odd, 0.0, -length * length / 2))
        self.met += len(ids)
        more = min(self.k, self.met) - self.best.shape[1]
        if more > 0:
            self.best = np.hstack([self.best, np.full((len(self.ids), more), -np.inf)])
            self.who = np.hstack([self.who, np.full((len(self.ids), more), np.iinfo(np.int64).max)])
        q_long, x_long = np.sqrt((self.side**2).sum(1)), np.sqrt((side * side).sum(1).max(initial=0))
        single = q_long.max(initial=0) * x_long < 1e30 and max(q_long.max(initial=0), x_long) < 1e30
        # of a sum of products, in any order, and of rounding its factors
        error = (side.shape[1] + 4) * (2.0**-23 if single else 2.0**-52) * q_long * x_long
        left, right = (m.astype(np.float32 if single else np.float64) for m in (self.side, side))
        strange, k = np.flatnonzero(odd), self.k
        for a in range(0, len(left), STEP):
            s, e = left[a : a + STEP] @ right.T, error[a : a + STEP]
            least = np.full(len(s), -np.inf)
            if self.best.shape[1] == k:
                least = self._product(self.best[a : a + STEP, k - 1] - 1e-9, a) - e
            fresh = np.flatnonzero(np.isneginf(least))
            if len(fresh) and s.shape[1] > k and not odd.any():
                product = np.zeros(len(s))
                product[fresh] = np.partition(s[fresh], s.shape[1] - k, axis=1)[:, s.shape[1] - k]
                least[fresh] = (self._edge(product - e, a) - e)[fresh]
            least[self.odd[a : a + STEP]] = -np.inf
            # the next single number below, so that rounding it doesn't raise it
            least = np.nextafter(least.astype(s.dtype), s.dtype.type(-np.inf))
            some = np.flatnonzero(s.max(axis=1, initial=-np.inf) >= least)
            r, c = np.nonzero(s[some] >= least[some, None])
            r = some[r] + a
            if len(strange):
                own = np.isin(c, strange, invert=True)
                every = np.arange(a, a + len(s))
                r, c = np.append(r[own], np.repeat(every, len(strange))), np.append(c[own], np.tile(strange, len(every)))
                turn = np.argsort(r, kind="stable")
                r, c = r[turn], c[turn]
            if len(r):
                self._take(r, ids[c], np.concatenate([self._exact(r[b : b + 32768], x[c[b : b + 32768]], length[c[b : b + 32768]]) for b in range(0, len(r), 32768)]))

    def _exact(self, r: np.ndarray, x: np.ndarray, length: np.ndarray) -> np.ndarray:
        q = self.points[r]
        with np.errstate(invalid="ignore", over="ignore"):
            if self.metric == "euclidean":
                # a difference has no rest where two vectors are equal
                return np.round(1 / (1 + np.sqrt(((q - x) ** 2).sum(1))), 9)
            s = np.einsum("ij,ij->i", q, x)
            if self.metric == "cosine":
                both = self.length[r] * length
                s = np.where(both == 0, 0.0, s / np.where(both == 0, 1.0, both))
            return np.round(s, 9)

    def _take(self, r: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        """Merges rows for queries, the queries in order, with those that are held."""
        real = ~np.isnan(score)
        r, ids, score = r[real], ids[real], score[real]
        if not len(r):
            return
        new = np.append(True, r[1:] != r[:-1])
        rows, width = r[new], self.best.shape[1]
        line = np.append(np.repeat(np.arange(len(rows)), width), np.cumsum(new) - 1)
        ids, score = np.append(self.who[rows].ravel(), ids), np.append(self.best[rows].ravel(), score)
        turn = np.lexsort((ids, -score, line))
        line, ids, score = line[turn], ids[turn], score[turn]
        many = np.bincount(line)
        place = np.arange(len(line)) - (np.cumsum(many) - many)[line]
        keep = place < width
        at = rows[line[keep]], place[keep]
        self.best[at], self.who[at] = score[keep], ids[keep]

    def found(self) -> pa.RecordBatch:
        r, c = np.nonzero(~np.isneginf(self.best))
        return pa.RecordBatch.from_pydict({"query_id": self.ids[r], "id": self.who[r, c], "score": self.best[r, c]})


def _multiplied(pairs: DataFrame, k: int, metric: str) -> DataFrame:
    """query_id, id, score: of each task's blocks of rows the k best of each query."""

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, _Nearest] = {}
        for batch in batches:
            for row in range(batch.num_rows):
                q_block, q_ids, q_points, q_dim, ids, points, dim = (batch.column(i)[row] for i in range(7))
                key = q_block.as_py()
                if key not in held:
                    held[key] = _Nearest(np.frombuffer(q_ids.as_buffer(), np.int64), np.frombuffer(q_points.as_buffer(), np.float32).reshape(-1, q_dim.as_py()), k, metric)
                held[key].add(np.frombuffer(ids.as_buffer(), np.int64), np.frombuffer(points.as_buffer(), np.float32).reshape(-1, dim.as_py()))
        for each in held.values():
            yield each.found()

    return pairs.select("q_block", "q_ids", "q_points", "q_dim", "ids", "points", "dim").mapInArrow(multiply, "query_id bigint, id bigint, score double")


def _blocks(rows: DataFrame, id_col: str, vector_col: str, block: int, by: str | None = None) -> DataFrame:
    """ids, points, dim of blocks of rows; with `by`, of rows of one value of it each, which comes last."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            groups = batch.column(2).to_numpy() if by else np.zeros(batch.num_rows)
            edges = np.concatenate([[0], np.flatnonzero(np.diff(groups)) + 1, [batch.num_rows]]) if batch.num_rows else np.zeros(1, int)
            for low, high in zip(edges[:-1], edges[1:]):
                for a in range(low, high, block):
                    part = batch.slice(a, min(block, high - a))
                    points = np.asarray(part.column(1).flatten(), np.float32)
                    out = {"ids": [part.column(0).to_numpy(zero_copy_only=False).astype(np.int64).tobytes()], "points": [points.tobytes()], "dim": pa.array([len(part.column(1)[0])], pa.int32())}
                    yield pa.RecordBatch.from_pydict(out | ({by: part.column(2).slice(0, 1)} if by else {}))

    valid = rows.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).cast("array<float>").alias("v"), *([F.col(by).cast("int").alias("by")] if by else [])).dropna()
    if by:
        valid = valid.repartitionByRange("by", "id").sortWithinPartitions("by", "id")
    return valid.mapInArrow(pack, "ids binary, points binary, dim int" + (f", {by} int" if by else ""))


def hydrate(hits: DataFrame, rows: DataFrame, id_col: str = "id", keep: list[str] = (), row_bytes: int = 128) -> DataFrame:
    """hits with columns of rows; hits whose row is gone are dropped.

    The hits are made once and counted: if their size allows they go to the rows,
    which then aren't shuffled, and only the columns in keep are read of them.
    """
    held = cut(hits)
    return rows.select(id_col, *keep).join(F.broadcast(held) if fits(held, row_bytes) else held, id_col)


def live(rows: DataFrame, tombstones: DataFrame, id_col: str = "id") -> DataFrame:
    return rows.join(tombstones.select(id_col), id_col, "left_anti")


def needs_compaction(live_rows: int, tombstones: int, ratio: float = 0.3) -> bool:
    """True once tombstones outnumber that share of the live rows."""
    return tombstones > ratio * live_rows


def latest(rows: DataFrame, id_col: str = "id", order: tuple[str, ...] = ("timestamp", "seq")) -> DataFrame:
    """The last written row of each id: one aggregate, combined before its shuffle."""
    columns = rows.columns
    newest = F.max_by(F.struct(*columns), F.struct(*order))
    return rows.groupBy(F.col(id_col).alias("_id")).agg(newest.alias("r")).select("r.*")


def index_stats(rows: DataFrame, vector_col: str = "vector", links: int = 16) -> DataFrame:
    """count, dimensions, memory_bytes (4 a component, 16 a link, 64 a row) in one row."""
    n, d = F.count("*"), F.max(F.size(vector_col))
    return rows.agg(n.alias("count"), F.coalesce(d, F.lit(0)).cast("bigint").alias("dimensions"), F.coalesce(n * (4 * d + 16 * links + 64), F.lit(0)).cast("bigint").alias("memory_bytes"))


# Cells: an inverted file over centroids, for tables too large to scan for each query.


def centroids(rows: DataFrame, cell_col: str, vector_col: str = "vector") -> DataFrame:
    """The mean vector of each cell: sums of each batch in numpy, and only those are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cells, own = np.unique(batch.column(0).to_numpy(), return_inverse=True)
                x = np.asarray(batch.column(1).flatten(), np.float64).reshape(batch.num_rows, -1)
                sums = np.zeros((len(cells), x.shape[1]))
                np.add.at(sums, own, x)
                yield pa.RecordBatch.from_pydict({"cell": pa.array(cells, pa.int32()), "n": np.bincount(own), "sums": pa.array(list(sums), pa.list_(pa.float64()))})

    parts = rows.select(F.col(cell_col).cast("int").alias("cell"), F.col(vector_col).cast("array<float>").alias("v")).dropna()
    each = parts.mapInArrow(run, "cell int, n bigint, sums array<double>").select("cell", "n", F.posexplode("sums").alias("at", "x"))
    mean = each.groupBy("cell", "at").agg((F.sum("x") / F.sum("n")).alias("x"))
    return mean.groupBy("cell").agg(F.array_sort(F.collect_list(F.struct("at", "x"))).alias("p")).select("cell", F.transform("p", lambda p: p["x"]).alias("centroid"))


def train_cells(rows: DataFrame, cells: int, rounds: int = 5, id_col: str = "id", vector_col: str = "vector", seed: int = 7) -> DataFrame:
    """cell, centroid by Lloyd's rounds from the vectors that come first by hash; for rows to be assigned to. A cell that loses its rows stays where it was."""
    first = rows.orderBy(F.md5(F.concat_ws(":", F.col(id_col).cast("string"), F.lit(str(seed)))), id_col).limit(cells)
    means = [(i, [float(x) for x in r[0]]) for i, r in enumerate(first.select(vector_col).collect())]
    spark = rows.sparkSession
    for _ in range(rounds):
        table = spark.createDataFrame(means, "cell int, centroid array<double>")
        found = centroids(assign_cells(rows, table, vector_col), "cell", vector_col).collect()
        moved = {r["cell"]: list(r["centroid"]) for r in found}
        means = [(c, moved.get(c, v)) for c, v in means]
    return spark.createDataFrame(means, "cell int, centroid array<double>")


def assign_cells(rows: DataFrame, table: DataFrame, vector_col: str = "vector", probes: int = 1) -> DataFrame:
    """rows with the cell of the nearest centroid (cosine to 9 places; ties by cell); with probes, a row for each of so many cells.

    The table is one row for each cell; it goes to every task.
    """
    cells = table.orderBy("cell").collect()
    ids = np.array([r["cell"] for r in cells], np.int32)
    means = np.array([r["centroid"] for r in cells], np.float64)
    means /= np.maximum(np.linalg.norm(means, axis=1, keepdims=True), 1e-12)

    def similar(v: pd.Series) -> np.ndarray:
        x = np.stack(v.to_numpy()).astype(np.float64)
        return np.round(x @ means.T / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12), 9)

    @F.pandas_udf("int")
    def nearest(v: pd.Series) -> pd.Series:
        return pd.Series(ids[similar(v).argmax(1)])

    @F.pandas_udf("array<int>")
    def several(v: pd.Series) -> pd.Series:
        return pd.Series(list(ids[np.argsort(-similar(v), 1, kind="stable")[:, :probes]]))

    return rows.withColumn("cell", nearest(F.col(vector_col)) if probes == 1 else F.explode(several(F.col(vector_col))))


def probed(table: DataFrame, vector, probes: int, metric: str = "cosine") -> DataFrame:
    """The cells whose centroids are nearest to the vector."""
    return scored(table, literal(vector), metric, "centroid").orderBy(F.desc("score"), "cell").limit(probes).select("cell")


def cell_top_k(rows: DataFrame, table: DataFrame, vector, k: int, probes: int, metric: str = "cosine", id_col: str = "id", vector_col: str = "vector") -> DataFrame:
    """top_k() among the rows of the probed cells alone; written by cell, the others aren't read."""
    return top_k(rows.join(F.broadcast(probed(table, vector, probes, metric)), "cell", "left_semi"), vector, k, metric, id_col, vector_col)


def valid_rows(rows: DataFrame, dimensions: int, vector_col: str = "vector") -> DataFrame:
    return rows.where(V.is_valid(F.col(vector_col), dimensions))

