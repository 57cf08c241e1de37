"""Approximate nearest neighbours of every vector, from robust-pruned directed graphs.

Each shard of vectors gets a graph over its distinct directions: points come in
batches, a greedy beam search over the graph so far proposes neighbours, and
relaxed pruning keeps those that no kept one is much closer to; edges back are
pruned alike. The distinct directions of the query set then are taken by beam
search through each shard, in blocks; the points they meet stand for all their
rows, and the best of all shards are the neighbours. Searches run for many
queries at a time in numpy.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.frames import cut

K, DEGREE, BUILD_BEAM, BEAM, ALPHA = 10, 32, 48, 64, 1.2
SHARD_ROWS = 8192
BATCH, WIDTH, STARTS = 512, 4, 128
#: The query set of the registered query: the rows whose id it divides, against all rows.
QUERY_EVERY = 50
_FAR = np.float32(9.0)


def beam_search(points: np.ndarray, links: np.ndarray, starts: np.ndarray, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """The `beam` nearest points that greedy search meets, nearest first, and their distances (1 - cosine); -1: none."""
    q = len(queries)
    near = 1 - queries @ points[starts].T
    first = min(beam, 4, len(starts))
    pick = np.argpartition(near, first - 1, axis=1)[:, :first] if first < len(starts) else np.tile(np.arange(first), (q, 1))
    ids = np.full((q, beam), -1, np.int32)
    far = np.full((q, beam), _FAR, np.float32)
    d = np.take_along_axis(near, pick, 1)
    turn = np.argsort(d, 1)
    ids[:, :first] = starts[np.take_along_axis(pick, turn, 1)]
    far[:, :first] = np.take_along_axis(d, turn, 1)
    open_ = ids >= 0
    seen = np.zeros((q, len(points)), np.int32)
    rows = np.arange(q)
    seen[rows[:, None], ids[:, :first]] = -1
    live = rows
    degree = links.shape[1]
    while len(live):
        o = open_[live]
        some = o.any(1)
        live = live[some]
        if not len(live):
            break
        o = o[some]
        rank = np.cumsum(o, 1)
        now = o & (rank <= WIDTH)
        r, c = np.nonzero(now)
        open_[live[r], c] = False
        row = np.repeat(live[r], degree)
        cand = links[ids[live[r], c]].ravel()
        ok = cand >= 0
        row, cand = row[ok], cand[ok]
        ok = seen[row, cand] >= 0
        row, cand = row[ok], cand[ok]
        # of a point that comes twice for one query the last writer stays
        tick = np.arange(1, len(row) + 1, dtype=np.int32)
        seen[row, cand] = tick
        ok = seen[row, cand] == tick
        row, cand = row[ok], cand[ok]
        seen[row, cand] = -1
        if not len(row):
            continue
        d = 1 - np.einsum("ij,ij->i", queries[row], points[cand])
        ok = d < far[row, -1]
        row, cand, d = row[ok], cand[ok], d[ok]
        if not len(row):
            continue
        head = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
        count = np.diff(np.append(head, len(row)))
        own = row[head]
        col = np.arange(len(row)) - np.repeat(head, count)
        wide = int(count.max())
        new_id = np.full((len(own), beam + wide), -1, np.int32)
        new_d = np.full((len(own), beam + wide), _FAR, np.float32)
        new_o = np.zeros((len(own), beam + wide), bool)
        new_id[:, :beam], new_d[:, :beam], new_o[:, :beam] = ids[own], far[own], open_[own]
        line = np.repeat(np.arange(len(own)), count)
        new_id[line, beam + col], new_d[line, beam + col], new_o[line, beam + col] = cand, d, True
        turn = np.argsort(new_d, 1, kind="stable")[:, :beam]
        ids[own], far[own], open_[own] = np.take_along_axis(new_id, turn, 1), np.take_along_axis(new_d, turn, 1), np.take_along_axis(new_o, turn, 1)
    return ids, far


def robust_prune(points: np.ndarray, who: np.ndarray, cand: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Of each row's candidates (-1: none) the neighbours to keep: the nearest left, again and again, without those it is alpha times closer to."""
    n, c = cand.shape
    x = points[np.maximum(cand, 0)]
    d = 1 - np.einsum("ncd,nd->nc", x, points[who])
    d[(cand < 0) | (cand == who[:, None])] = _FAR
    turn = np.argsort(d, 1, kind="stable")
    cand, d = np.take_along_axis(cand, turn, 1), np.take_along_axis(d, turn, 1)
    x = np.take_along_axis(x, turn[:, :, None], 1)
    between = 1 - x @ x.transpose(0, 2, 1)
    alive = d < _FAR
    # a candidate that comes twice
    for_id = np.argsort(cand, 1, kind="stable")
    by_id = np.take_along_axis(cand, for_id, 1)
    twice = np.zeros_like(alive)
    np.put_along_axis(twice, for_id[:, 1:], by_id[:, 1:] == by_id[:, :-1], 1)
    alive &= ~twice
    out = np.full((n, degree), -1, np.int32)
    row = np.arange(n)
    for j in range(degree):
        first = alive.argmax(1)
        real = alive[row, first]
        if not real.any():
            break
        out[real, j] = cand[row, first][real]
        # distances are squared ones, halved
        alive &= ~(real[:, None] & (alpha * alpha * between[row, first] <= d))
        alive[row, first] = False
    return out


def build(points: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, alpha: float = ALPHA) -> tuple[np.ndarray, np.ndarray]:
    """Links of each point (-1: none) and the points that searches start from."""
    n = len(points)
    rng = np.random.default_rng(7)
    order = rng.permutation(n)
    links = np.full((n, degree), -1, np.int32)
    base = order[: min(n, 4 * degree)]
    links[base] = robust_prune(points, base, np.tile(base.astype(np.int32), (len(base), 1)), degree, alpha)
    at = len(base)
    while at < n:
        to = min(n, at + min(at, BATCH))
        new = order[at:to]
        starts = order[: min(at, STARTS)]
        ids, _ = beam_search(points, links, starts, points[new], beam)
        links[new] = robust_prune(points, new, ids, degree, alpha)
        _link_back(points, links, new, degree, alpha)
        at = to
    return links, order[: min(n, STARTS)]


def _link_back(points: np.ndarray, links: np.ndarray, new: np.ndarray, degree: int, alpha: float) -> None:
    """Adds the edges from the neighbours of new points back to them, and prunes those with too many."""
    source, target = np.repeat(new, degree).astype(np.int32), links[new].ravel()
    ok = target >= 0
    source, target = source[ok], target[ok]
    turn = np.argsort(target, kind="stable")
    source, target = source[turn], target[turn]
    head = np.flatnonzero(np.concatenate([[True], target[1:] != target[:-1]])) if len(target) else np.zeros(0, np.int64)
    count = np.diff(np.append(head, len(target)))
    who = target[head]
    have = (links[who] >= 0).sum(1)
    line = np.repeat(np.arange(len(who)), count)
    col = np.arange(len(target)) - np.repeat(head, count)
    fits = have + count <= degree
    inside = fits[line]
    links[target[inside], have[line[inside]] + col[inside]] = source[inside]
    over = np.flatnonzero(~fits)
    over = over[np.argsort(count[over])]
    a = 0
    while a < len(over):
        # rows of like width, at most some 8 million distances at a time
        b = a + 1
        while b < len(over) and (b + 1 - a) * (degree + count[over[b]]) ** 2 <= 1 << 21:
            b += 1
        rows = over[a:b]
        wide = int(count[rows].max())
        cand = np.full((len(rows), degree + wide), -1, np.int32)
        cand[:, :degree] = links[who[rows]]
        at = np.full(len(who), -1)
        at[rows] = np.arange(len(rows))
        own = np.flatnonzero(at[line] >= 0)
        cand[at[line[own]], degree + col[own]] = source[own]
        links[who[rows]] = robust_prune(points, who[rows], cand, degree, alpha)
        a = b


def search(points: np.ndarray, links: np.ndarray, starts: np.ndarray, queries: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
    """beam_search() of any number of queries, a block at a time."""
    parts = [beam_search(points, links, starts, queries[a : a + BATCH], beam) for a in range(0, len(queries), BATCH)]
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def _unit(column: pa.Array, dim: int) -> np.ndarray:
    x = np.asarray(column.flatten(), np.float32).reshape(-1, dim).astype(np.float64)
    # no -0.0, so that equal vectors are equal bytes
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32) + np.float32(0)


def distinct(points: np.ndarray, ids: np.ndarray, none: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct points in the order they come, all rows by point and then as ties go, and the first row of each point (one more at the end)."""
    _, first, own = np.unique(np.ascontiguousarray(points).view(np.dtype((np.void, points.shape[1] * points.itemsize))).ravel(), return_index=True, return_inverse=True)
    place = np.empty(len(first), np.int64)
    place[np.argsort(first)] = np.arange(len(first))
    own = place[own]
    return points[np.sort(first)], np.lexsort((hashes, ids, none, own)), np.append(0, np.cumsum(np.bincount(own, minlength=len(first))))


def best_rows(points: np.ndarray, heads: np.ndarray, ties: tuple[np.ndarray, ...], queries: np.ndarray, found: np.ndarray, far: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each query the `most` best rows (-1: none) of the points it met, and their scores; equal scores go by ties, the last key first.

    A point of the most-th distance or nearer is needed, and of a point no more
    than its first `most` rows. Scores are computed anew, the same for equal
    vectors wherever they lie.
    """
    reach = far[:, min(most, far.shape[1]) - 1]
    r, c = np.nonzero((found >= 0) & (far <= reach[:, None] + np.float32(1e-6)))
    p = found[r, c]
    score = np.einsum("ij,ij->i", queries[r].astype(np.float64), points[p].astype(np.float64)).astype(np.float32)
    n = np.minimum(heads[p + 1] - heads[p], most)
    row = np.repeat(heads[p] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    r, score = np.repeat(r, n), np.repeat(score, n)
    turn = np.lexsort((*(t[row] for t in ties), -score, r))
    r, row, score = r[turn], row[turn], score[turn]
    count = np.bincount(r, minlength=len(queries))
    rank = np.arange(len(r)) - (np.cumsum(count) - count)[r]
    keep = rank < most
    out = np.full((len(queries), most), -1, np.int64)
    scores = np.zeros((len(queries), most), np.float32)
    out[r[keep], rank[keep]], scores[r[keep], rank[keep]] = row[keep], score[keep]
    return out, scores


def _packed(points: np.ndarray, ids: pa.Array, hashes: np.ndarray) -> tuple[np.ndarray, dict[str, bytes]]:
    """distinct() of the rows, and all of it as bytes."""
    none = np.asarray(ids.is_null())
    ids = ids.fill_null(0).to_numpy(zero_copy_only=False)
    points, turn, heads = distinct(points, ids, none, hashes)
    return points, {"points": points.tobytes(), "heads": heads.astype(np.int64).tobytes(), "ids": ids[turn].tobytes(), "none": none[turn].tobytes(), "hashes": hashes[turn].tobytes()}


_PACKED = ("points", "heads", "ids", "none", "hashes")


def _blocks(asked: DataFrame, by: str, dim: int) -> DataFrame:
    """The rows of asked (id, v, hash) packed as queries, a block for each value of `by`."""

    def block(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        _, packed = _packed(_unit(group.column("v").combine_chunks(), dim), group.column("id").combine_chunks(), group.column("hash").to_numpy())
        return pa.table({by: group.column(by).slice(0, 1), **{f"q_{x}": [packed[x]] for x in _PACKED}})

    return asked.groupBy(by).applyInArrow(block, f"{by} int, " + ", ".join(f"q_{x} binary" for x in _PACKED))


def _laid(rows: DataFrame, dim: int, shards: int, shard_rows: int, probes: int) -> tuple[DataFrame, DataFrame]:
    """rows with the cell of their nearest pivot and a shard of it; and rows once for each of their nearest cells (q_cell).

    Pivots are the distinct vectors that come first by hash: one for shard_rows
    rows. A cell over shard_rows is several shards, which its queries all visit.
    """
    pivots = rows.groupBy("hash").agg(F.min("id").alias("id"), F.first("v").alias("v")).orderBy(F.xxhash64("hash", "id"), "hash", "id").limit(shards).select("v").toArrow().column(0).combine_chunks()
    pivots = _unit(pivots, dim)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                near = np.argsort(-(_unit(batch.column(1), dim) @ pivots.T), 1, kind="stable")[:, :probes].astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(near) + 1, dtype=np.int32) * near.shape[1]), pa.array(near.ravel()))
                yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=["id", "v", "hash", "cells"])

    placed = cut(rows.select("id", "v", "hash").mapInArrow(route, "id bigint, v array<float>, hash bigint, cells array<int>").withColumn("cell", F.col("cells")[0]))
    sizes = placed.groupBy("cell").agg(F.ceil(F.count("*") / shard_rows).cast("int").alias("n"))
    # shards of one cell are numbered after those of the cells before it
    first = sizes.select("cell", "n", (F.sum("n").over(Window.orderBy("cell")) - F.col("n")).cast("int").alias("first"))
    laid = placed.join(first, "cell").withColumn("shard", (F.col("first") + F.pmod(F.xxhash64("id", "hash"), F.col("n"))).cast("int")).select("id", "v", "hash", "cell", "shard")

    return laid, placed.select(F.explode("cells").alias("q_cell"), "id", "v", "hash")


def nearest(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, degree: int = DEGREE, beam: int = BEAM, alpha: float = ALPHA, shard_rows: int = SHARD_ROWS, probes: int | None = None, every: int = 1) -> DataFrame:
    """id, rank (1 to k), neighbor_id, score (cosine) for the query set, against all rows; the vector itself is not its neighbour.

    Queries are the rows whose id `every` divides (1: all rows, those without an
    id too). Ties go by neighbor_id, null last. Vectors that are null, hold a
    null or a number that isn't finite, have no length, or have another dimension
    than most (of equally frequent dimensions the largest counts) are neither
    query nor neighbour. Repeated rows (same id and vector) are one; equal vectors
    under two ids are neighbours, and so are two vectors of one id. Fewer than
    k + 1 vectors give fewer ranks; an empty table or query set gives no row.
    Other columns are not read, whatever their names.

    Every query visits every shard. With probes, vectors are laid by the nearest
    of as many pivots as there are shards, and a query visits those of its
    nearest `probes` pivots alone: work in proportion to the rows, and a recall
    that depends on how much the vectors cluster.
    """
    v = F.col("v")
    rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).cast("array<float>").alias("v")).where(v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0))
    dims = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    dim = dims["d"] if dims else 1
    rows = cut(rows.where(F.size("v") == dim).withColumn("hash", F.xxhash64("v")).dropDuplicates(["id", "hash"]))
    shards = max(1, -(-rows.count() // shard_rows))
    routed = probes is not None and probes < shards
    chosen = F.lit(True) if every == 1 else F.coalesce(F.col("id") % every == 0, F.lit(False))
    if routed:
        rows, each = _laid(rows, dim, shards, shard_rows, probes)
        asked = _blocks(each.where(chosen), "q_cell", dim)
    else:
        each = rows.where(chosen)
        blocks = max(1, -(-each.count() // shard_rows))
        asked = cut(_blocks(each.withColumn("part", F.pmod(F.xxhash64("hash", "id"), F.lit(blocks)).cast("int")), "part", dim)).drop("part")
        rows = rows.withColumn("shard", F.pmod(F.xxhash64("id", "hash"), F.lit(shards)).cast("int")).withColumn("cell", F.lit(0))

    def graph(group: pa.Table) -> pa.Table:
        group = group.combine_chunks().sort_by([("hash", "ascending"), ("id", "ascending")])
        points, packed = _packed(_unit(group.column("v").combine_chunks(), dim), group.column("id").combine_chunks(), group.column("hash").to_numpy())
        links, starts = build(points, degree, BUILD_BEAM, alpha)
        return pa.table({"shard": group.column("shard").slice(0, 1), "cell": group.column("cell").slice(0, 1), **{x: [packed[x]] for x in _PACKED}, "links": [links.tobytes()], "starts": [starts.astype(np.int64).tobytes()]})

    graphs = cut(rows.groupBy("shard").applyInArrow(graph, "shard int, cell int, " + ", ".join(f"{x} binary" for x in (*_PACKED, "links", "starts"))))
    if routed:
        pairs = graphs.join(asked, F.col("cell") == F.col("q_cell")).drop("q_cell")
    else:
        # blocks of the query set against blocks of all rows
        pairs = graphs.repartition(shards).crossJoin(asked.repartition(blocks))
    pairs = pairs.drop("shard", "cell")

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                raw = {name: batch.column(name)[row].as_buffer() for name in batch.schema.names}
                points, queries = (np.frombuffer(raw[x], np.float32).reshape(-1, dim) for x in ("points", "q_points"))
                ids, hashes, heads, q_ids, q_hashes, q_heads, starts = (np.frombuffer(raw[x], np.int64) for x in ("ids", "hashes", "heads", "q_ids", "q_hashes", "q_heads", "starts"))
                none, q_none = (np.frombuffer(raw[x], bool) for x in ("none", "q_none"))
                links = np.frombuffer(raw["links"], np.int32).reshape(-1, degree)
                for a in range(0, len(queries), 4 * BATCH):
                    some = queries[a : a + 4 * BATCH]
                    # one more, as a row isn't its own neighbour
                    best, score = best_rows(points, heads, (hashes, ids, none), some, *search(points, links, starts, some, beam), k + 1)
                    q = np.arange(q_heads[a], q_heads[a + len(some)])
                    own = np.repeat(np.arange(len(some)), np.diff(q_heads[a : a + len(some) + 1]))
                    found = best[own]
                    same = (ids[found] == q_ids[q][:, None]) & (hashes[found] == q_hashes[q][:, None]) & (none[found] == q_none[q][:, None])
                    ok = (found >= 0) & ~same
                    ok &= np.cumsum(ok, 1) <= k
                    r, c = np.nonzero(ok)
                    hit = found[r, c]
                    yield pa.RecordBatch.from_arrays([pa.array(q_ids[q[r]], mask=q_none[q[r]]), pa.array(q_hashes[q[r]]), pa.array(ids[hit], mask=none[hit]), pa.array(hashes[hit]), pa.array(score[own[r], c].astype(np.float64))], names=["id", "hash", "neighbor_id", "neighbor_hash", "score"])

    found = pairs.mapInArrow(ask, "id bigint, hash bigint, neighbor_id bigint, neighbor_hash bigint, score double")
    best = Window.partitionBy("id", "hash").orderBy(F.desc("score"), F.asc_nulls_last("neighbor_id"), "neighbor_hash")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select(F.col("id").alias(id_col), "rank", "neighbor_id", "score")
