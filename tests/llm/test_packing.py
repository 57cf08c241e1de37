"""Bins against exhaustive packing and the properties that hold for any."""

import random

import numpy as np
import pytest

from quillspark.llm import packing


def naive_best_fit(sizes, capacity):
    bins = []
    for s in sorted(sizes, reverse=True):
        rooms = [r for r in bins if r >= s]
        if rooms:
            bins.remove(min(rooms))
            bins.append(min(rooms) - s)
        else:
            bins.append(capacity - s)
    return len(bins)


def optimum(sizes, capacity):
    best = [len(sizes)]

    def go(left, bins):
        if len(bins) >= best[0]:
            return
        if not left:
            best[0] = len(bins)
            return
        s, rest = left[0], left[1:]
        for i in range(len(bins)):
            if bins[i] >= s and bins[i] not in bins[:i]:
                go(rest, [*bins[:i], bins[i] - s, *bins[i + 1 :]])
        go(rest, [*bins, capacity - s])

    go(sorted(sizes, reverse=True), [])
    return best[0]


@pytest.mark.parametrize("seed", range(25))
def test_best_fit_and_bound(seed):
    rng = random.Random(seed)
    capacity = rng.choice([10, 37, 100])
    sizes = np.array([rng.randint(1, capacity) for _ in range(rng.randint(0, 9))], np.int64)
    bins, n = packing.best_fit(sizes, capacity)
    assert n == naive_best_fit(sizes.tolist(), capacity)
    assert all(sizes[bins == b].sum() <= capacity for b in range(n)) and len(set(bins.tolist())) == n
    assert packing.lower_bound(sizes, capacity) <= optimum(sizes.tolist(), capacity) <= n


def check(bins, lengths, capacity):
    held = {}
    for r in bins:
        assert sum(r["sizes"]) == r["n_tokens"] <= capacity and r["part_bound"] <= r["part_bins"]
        for d, a, s in zip(r["doc_ids"], r["start_tokens"], r["sizes"]):
            held.setdefault(d, []).append((a, s))
    for d, n in lengths.items():
        at = 0
        for a, s in sorted(held.pop(d, [])):
            assert a == at and (s == capacity or a + s == n)
            at += s
        assert at == max(n, 0)
    assert not held
    for part in {r["part"] for r in bins}:
        own = [r for r in bins if r["part"] == part]
        assert len(own) == own[0]["part_bins"] and sorted(r["bin"] for r in own) == list(range(len(own)))


@pytest.mark.parametrize("per_partition", [10_000, 40])
def test_every_token_in_one_bin(spark, per_partition):
    rng = random.Random(4)
    lengths = {i: rng.choice([0, 1, 7, 34, 50, 51, 99, 100, 101, 350]) for i in range(500)}
    rows = spark.createDataFrame(list(lengths.items()), "id bigint, n_tokens bigint")
    check(packing.pack(rows, 100, per_partition=per_partition).collect(), lengths, 100)


def test_exchange_never_adds_bins(spark):
    rng = random.Random(9)
    rows = spark.createDataFrame([(i, rng.choice([34, 35, 51, 67])) for i in range(400)], "id bigint, n_tokens bigint")
    counts = [packing.pack(rows, 100, rounds=r, per_partition=15).count() for r in (0, 3)]
    assert counts[1] <= counts[0]
    check(packing.pack(rows, 100, per_partition=15).collect(), {r["id"]: r["n_tokens"] for r in rows.collect()}, 100)


def test_a_lone_gap_partition_exchanges_too(spark):
    rng = random.Random(0)
    lengths = {i: rng.randint(20, 60) for i in range(60)}
    rows = spark.createDataFrame(list(lengths.items()), "id bigint, n_tokens bigint")
    alone = packing.pack(rows, 100, rounds=0, per_partition=30).collect()
    assert len({r["part"] for r in alone}) == 2 and len({r["part"] for r in alone if r["part_bins"] > r["part_bound"]}) == 1
    got = packing.pack(rows, 100, per_partition=30).collect()
    check(got, lengths, 100)
    assert len(got) < len(alone) and all(r["part_bins"] == r["part_bound"] for r in got)


def test_documents_and_edges(spark):
    docs = spark.createDataFrame([(1, "a b c", 9), (2, None, 9), (3, " \n", 9), (None, "d e", 9), (1, "a b c", 9), (4, "w " * 5000, 9)], "doc_id bigint, text string, bin int")
    got = packing.pack_documents(docs, capacity=4).collect()
    assert sum(r["n_tokens"] for r in got) == 3 + 2 + 3 + 5000 and len(got) == 2 + 1 + 1250
    assert sorted(str(d) for r in got for d in set(r["doc_ids"]) if d != 4) == ["1", "1", "None"]
    assert packing.pack_documents(docs.limit(0)).count() == 0


def test_equal_rows_are_spread(spark):
    """A third of all rows without an id and of one length doesn't make one partition."""
    rows = spark.createDataFrame([(None, 7)] * 300 + [(i, 5) for i in range(600)], "id bigint, n_tokens bigint")
    got = packing.pack(rows, 100, rounds=1, per_partition=90).collect()
    pieces = {}
    for r in got:
        pieces[r["part"]] = pieces.get(r["part"], 0) + len(r["sizes"])
    assert sum(pieces.values()) == 900 and len(pieces) == 10 and max(pieces.values()) < 180


def test_a_models_own_tokens(spark):
    from quillspark.llm import bpe

    docs = spark.createDataFrame([(i, f"Some text number {i} with words. " * (i + 1)) for i in range(20)], "doc_id bigint, text string")
    tokens = bpe.encode_documents(docs).selectExpr("doc_id as id", "n_tokens")
    check(packing.pack(tokens, 64).collect(), {r["id"]: r["n_tokens"] for r in tokens.collect()}, 64)
