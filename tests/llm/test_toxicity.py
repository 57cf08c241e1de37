"""Segments against brute force, and what is called toxic."""

import math
import random

import numpy as np
import pytest

from quillspark.llm import toxicity as T


def brute_segments(score):
    """All maximal segments by definition: the best one first, then those left and right of it."""
    out = []

    def go(a, b):
        best, total = None, {}
        for i in range(a, b):
            s = 0.0
            for j in range(i, b):
                s += score[j]
                if s > 1e-12 and (best is None or s > total[best] + 1e-9 or (abs(s - total[best]) <= 1e-9 and j + 1 - i < best[1] - best[0])):
                    best = (i, j + 1)
                    total[best] = s
        if best:
            go(a, best[0])
            out.append((*best, total[best]))
            go(best[1], b)

    go(0, len(score))
    return out


@pytest.mark.parametrize("seed", range(30))
def test_segments_equal_brute_force(seed):
    rng = random.Random(seed)
    n, drift = rng.randint(0, 40), 0.25
    hits = sorted(rng.sample(range(n), rng.randint(0, n // 2)))
    weights = [round(rng.uniform(0.1, 3), 3) for _ in hits]
    score = [-drift] * n
    for p, w in zip(hits, weights):
        score[p] = w
    got = T.segments(hits, weights, drift)
    assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in brute_segments(score)]
    assert np.allclose([s for *_, s in got], [s for *_, s in brute_segments(score)])


def test_chance_scale_solves_its_equation():
    rate, weights = np.array([1e-4, 1e-3]), np.array([4.0, 2.0])
    x = T.chance_scale(rate, weights, 0.25)
    assert x > 0 and abs((rate * np.exp(x * weights)).sum() + (1 - rate.sum()) * np.exp(-x * 0.25) - 1) < 1e-9


def test_chance_of_clean_text_is_kept():
    # the calibrated share of clean texts with a segment of that score holds in simulation
    rng = np.random.default_rng(5)
    rate, weights, drift, n = np.array([0.004, 0.002]), np.array([3.0, 4.5]), 0.25, 200
    model = T.Model(np.arange(2, dtype=np.uint64), weights, drift, T.chance_scale(rate, weights, drift))
    bad = 0
    for _ in range(4000):
        draw = rng.random(n)
        at = np.flatnonzero(draw < rate.sum())
        w = np.where(draw[at] < rate[0], weights[0], weights[1])
        bad += T.judge(model, at.tolist(), w.tolist(), n)[2] <= 0.01
    assert bad / 4000 <= 0.015


@pytest.mark.parametrize("n", [3, 101, 180])
def test_chance_is_the_least_over_all_segments(n):
    # segments of like scores, which each add to the evidence: the least chance is that of all of them
    model = T.Model(np.zeros(1, np.uint64), np.ones(1), 0.25, 1.0)
    gap, weight = 60, 10.0
    tokens = n * gap
    x = weight - math.log(0.25 * tokens)
    tails = [-r * x + (r - 1) * math.log(r * x) - math.lgamma(r + 1) - math.lgamma(r) + r * math.log(2) for r in range(1, n + 1) if r * x > r - 1]
    want = -math.expm1(-math.exp(min(tails)))
    assert 0 < x and min(tails) == tails[-1] and len(tails) == n
    got = T.judge(model, [i * gap for i in range(n)], [weight] * n, tokens)
    assert got[2] == pytest.approx(want, rel=1e-6, abs=0) and got[2] > 0


def docs(spark, n=400, seed=1):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(400)]
    rows, labels = [], []
    for i in range(n):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(30, 150))]
        toxic = i % 8 == 0
        if toxic:
            for _ in range(rng.randint(4, 9)):
                words[rng.randrange(len(words))] = rng.choice(["Idiot", "scum", "trash!"])
        rows.append((i, " ".join(words), "p"))
        if i % 2 == 0:
            labels.append((i, int(toxic)))
    return spark.createDataFrame(rows, "doc_id bigint, text string, passages string"), spark.createDataFrame(labels, "doc_id bigint, toxic int")


def test_held_out_accuracy_and_edges(spark):
    d, l = docs(spark)
    model = T.fit(d, l)
    other, _ = docs(spark, 200, 2)
    got = {r["doc_id"]: r for r in T.toxic_report(other, model).collect()}
    want = {i for i in range(200) if i % 8 == 0}
    called = {i for i, r in got.items() if r["toxic"]}
    assert len(called & want) >= 0.9 * len(want) and not called - want
    assert all(r["passages"] for i, r in got.items() if i in called)
    left = T.drop_toxic(other, model)
    assert left.columns == other.columns and {r["doc_id"] for r in left.collect()} == set(range(200)) - called
    odd = spark.createDataFrame([(1, None), (2, ""), (None, "idiot scum trash idiot scum"), (3, "idiot scum " * 20000)], "doc_id bigint, text string")
    twice = spark.createDataFrame([(7, "idiot scum trash idiot scum", "a")] * 3 + [(8, "plain words", "b")] * 2, "doc_id bigint, text string, toxic string")
    assert sorted((r["doc_id"], r["toxic"]) for r in T.toxic_report(twice, model).collect()) == [(7, True)] * 3 + [(8, False)] * 2
    assert sorted(r["doc_id"] for r in T.drop_toxic(twice, model).collect()) == [8, 8] and T.drop_toxic(twice, model).columns == twice.columns
    assert {(r["doc_id"], r["n_tokens"], r["toxic"]) for r in T.toxic_report(odd, model).collect()} == {(1, 0, False), (2, 0, False), (None, 5, True), (3, 40000, True)}
    assert T.toxic_report(odd.limit(0), model).count() == 0


def test_without_labels_nothing_is_toxic(spark):
    d, l = docs(spark, 40)
    for none in (l.limit(0), l.selectExpr("doc_id", "cast(null as int) toxic"), l.where("toxic = 0")):
        model = T.fit(d, none)
        assert not len(model.keys) and T.drop_toxic(d, model).count() == 40
    assert not len(T.fit(d.limit(0), l).keys)


def test_copies_are_one_witness(spark):
    # a passage copied into many toxic documents doesn't make its own words toxic
    passage = "rare words that nobody else would ever write down"
    rows = [(i, f"{passage} {'idiot ' if i % 2 else ''}filler{i} more{i % 7}") for i in range(60)]
    d = spark.createDataFrame(rows + [(100 + i, f"filler{i} more{i % 7} plain") for i in range(200)], "doc_id bigint, text string")
    l = spark.createDataFrame([(i, 1) for i in range(60)] + [(100 + i, 0) for i in range(200)], "doc_id bigint, toxic int")
    model = T.fit(d, l)
    clean = spark.createDataFrame([(1, f"a b c {passage} d e f")], "doc_id bigint, text string")
    assert not T.toxic_report(clean, model).first()["toxic"]
