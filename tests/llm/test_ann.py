"""Graph searches against brute force."""

import numpy as np
import pytest

from quillspark.llm import ann


def data(n, d=24, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, d)).astype(np.float32)
    x[n // 2 :] = x[rng.integers(0, n // 4, n - n // 2)] + 0.05 * rng.standard_normal((n - n // 2, d)).astype(np.float32)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def truth(x, k):
    s = x.astype(np.float64) @ x.T.astype(np.float64)
    np.fill_diagonal(s, -9)
    return -np.sort(-s, 1)[:, k - 1], s


def test_pruning_by_its_rule():
    x = data(60)
    got = ann.robust_prune(x, np.array([0]), np.arange(60, dtype=np.int32)[None].repeat(1, 0), 8, 1.2)[0]
    d = 1 - x @ x.T
    left, want = sorted(range(1, 60), key=lambda j: d[0, j]), []
    while left and len(want) < 8:
        p = left.pop(0)
        want.append(p)
        left = [c for c in left if 1.44 * d[p, c] > d[0, c]]
    assert [g for g in got if g >= 0] == want


def test_recall_in_one_shard():
    x = data(2000)
    links, starts = ann.build(x)
    assert links.shape == (2000, ann.DEGREE) and (links < 2000).all() and not (links == np.arange(2000)[:, None]).any()
    ids, _ = ann.search(x, links, starts, x)
    kth, s = truth(x, 10)
    hits = [sum(s[i, j] >= kth[i] - 1e-6 for j in ids[i] if j >= 0 and j != i) for i in range(2000)]
    assert np.minimum(hits, 10).mean() >= 9.5


@pytest.mark.parametrize("shard_rows, probes", [(10_000, None), (150, None), (150, 3), (150, 4)])
def test_recall_over_shards(spark, shard_rows, probes):
    x = data(600)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<float>")
    got = {}
    for r in ann.nearest(rows, shard_rows=shard_rows, probes=probes).collect():
        got.setdefault(r["vec_id"], {})[r["rank"]] = (r["neighbor_id"], r["score"])
    kth, s = truth(x, 10)
    assert set(got) == set(range(600)) and all(sorted(g) == list(range(1, 11)) for g in got.values())
    assert all(n != i and abs(score - s[i, n]) < 1e-5 for i, g in got.items() for n, score in g.values())
    recall = np.mean([sum(s[i, n] >= kth[i] - 1e-6 for n, _ in g.values()) / 10 for i, g in got.items()])
    assert recall >= (0.8 if probes == 3 else 0.9)


@pytest.mark.parametrize("shard_rows, probes", [(10_000, None), (300, None), (300, 2)])
def test_equal_vectors_are_neighbours(spark, shard_rows, probes):
    x, copies = data(400, 64, 2), [12, 40, 300]
    who = np.concatenate([np.arange(400), *(np.full(g - 1, i) for i, g in enumerate(copies))])
    order = np.random.default_rng(8).permutation(len(who))
    # copies of another length are equal by cosine
    rows = [(i, (x[w] * (2 if i % 5 == 0 else 1)).tolist()) for i, w in enumerate(who[order].tolist())]
    got = {}
    for r in ann.nearest(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>"), shard_rows=shard_rows, probes=probes).collect():
        got.setdefault(r["vec_id"], {})[r["rank"]] = r["neighbor_id"]
    right = []
    for w, g in enumerate(copies):
        own = np.flatnonzero(who[order] == w).tolist()
        assert len(own) == g
        right += [[got[i][r] for r in range(1, 11)] == [j for j in own if j != i][:10] for i in own]
    assert np.mean(right) >= 0.99
    s = x[who[order]].astype(np.float64) @ x[who[order]].T.astype(np.float64)
    np.fill_diagonal(s, -9)
    kth = -np.sort(-s, 1)[:, 9]
    recall = np.mean([np.mean([s[i, n] >= kth[i] - 1e-6 for n in g.values()]) for i, g in got.items()])
    assert len(got) == len(rows) and recall >= (0.9 if probes is None else 0.8)


def test_edges(spark):
    rows = [(1, [1.0, 0.0], "x"), (1, [1.0, 0.0], "x"), (2, [1.0, 0.0], "y"), (3, [0.0, 1.0], "z"), (None, [1.0, 1.0], None), (4, None, ""), (5, [0.0, 0.0], ""), (6, [1.0, float("nan")], ""), (7, [1.0, None], ""), (8, [1.0, 2.0, 3.0], ""), (3, [2.0, 1.0], "w")]
    docs = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, rank string")
    got = {}
    for r in ann.nearest(docs, k=2).collect():
        got.setdefault(r["vec_id"], []).append((r["rank"], r["neighbor_id"]))
    assert set(got) == {1, 2, 3, None} and sorted(got[1]) == [(1, 2), (2, 3)] and sorted(got[2]) == [(1, 1), (2, 3)]
    assert len(got[3]) == 4 and len(got[None]) == 2
    assert ann.nearest(docs.limit(0)).count() == 0 and ann.nearest(docs.where("vec_id = 2")).count() == 0


def test_query_set_against_all_rows(spark):
    """The registered query's form, over several shards of the embeddings table, against brute force."""
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    table = rows.select("vec_id", "embedding").toPandas()
    ids, x = table["vec_id"].to_numpy(), np.stack(table["embedding"].to_numpy()).astype(np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    got = {}
    for r in ann.nearest(rows, shard_rows=500, every=50).collect():
        got.setdefault(r["vec_id"], []).append(r["neighbor_id"])
    asked = np.flatnonzero(ids % 50 == 0)
    assert set(got) == set(ids[asked].tolist()) and all(len(g) == 10 for g in got.values())
    s = x[asked] @ x.T
    s[np.arange(len(asked)), asked] = -9
    want = {ids[i]: set(ids[np.argsort(-row)[:10]].tolist()) for i, row in zip(asked, s)}
    assert np.mean([len(want[i] & set(g)) / 10 for i, g in got.items()]) >= 0.9
    some = spark.createDataFrame([(None, [1.0, 0.0]), (1, [0.0, 1.0])], "vec_id bigint, embedding array<float>")
    assert ann.nearest(some, every=50).count() == 0
