"""Code lengths against a trie of dictionaries."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import lm


def brute(texts, order):
    """A function of a text, and of a text whose own counts are to be taken off."""
    counts = defaultdict(Counter)

    def each(t):
        x = b"\0" * order + t.encode()
        for p in range(order, len(x)):
            for k in range(order + 1):
                yield x[p - k : p], x[p]

    for t in texts:
        for context, s in each(t):
            counts[context][s] += 1

    def bits(t, own=""):
        less = defaultdict(Counter)
        for context, s in each(own):
            less[context][s] += 1
        x, total = b"\0" * order + t.encode(), 0.0
        for p in range(order, len(x)):
            excluded = ()
            for k in range(order, -1, -1):
                c = x[p - k : p]
                f = {s: n - less[c][s] for s, n in counts[c].items() if n > less[c][s]} if c in counts else {}
                if not f:
                    continue
                left = {s: n for s, n in f.items() if s not in excluded}
                if left:
                    mass = sum(left.values()) + len(left)
                    if x[p] in left:
                        total += math.log2(mass / left[x[p]])
                        break
                    total += math.log2(mass / len(left))
                excluded = f
            else:
                total += math.log2(256 - len(excluded))
        return total

    return bits


def texts(seed, n=40):
    rng = random.Random(seed)
    return ["".join(rng.choice(["the ", "cat ", "sat. ", "é", "x", "\n", "日"]) for _ in range(rng.randint(0, 80))) for _ in range(n)]


@pytest.mark.parametrize("order", [1, 3, 4, 5])
def test_pretrained_equals_brute_force(spark, order):
    own = texts(order)
    docs = spark.createDataFrame(list(enumerate(own)), "doc_id int, text string").repartition(3)
    bits = brute(own, order)
    other = texts(order + 50) + own + ["\x00\x01zzz"]
    asked = spark.createDataFrame(list(enumerate(other)), "doc_id int, text string")
    got = lm.score(asked, lm.train(docs, order=order), order=order).collect()
    assert len(got) == len(other)
    assert all(abs(r["code_bits"] - bits(other[r["doc_id"]])) < 1e-5 and r["n_bytes"] == len(other[r["doc_id"]].encode()) for r in got)


@pytest.mark.parametrize("order, step, batch", [(1, 1 << 20, 1 << 20), (3, 200, 1 << 20), (4, 100, 300), (5, 50, 1)])
def test_own_counts_are_taken_off(spark, monkeypatch, order, step, batch):
    monkeypatch.setattr(lm, "STEP_BYTES", step)
    monkeypatch.setattr(lm, "BATCH_BYTES", batch)
    own = texts(order) + ["only here: qwertz", "twice qwertz!", "twice qwertz!", "aaaaaaaaaaaa"]
    docs = spark.createDataFrame(list(enumerate(own)), "doc_id int, text string").repartition(3)
    bits = brute(own, order)
    got = {r["doc_id"]: r["code_bits"] for r in lm.score(docs, order=order).collect()}
    assert set(got) == set(range(len(own)))
    assert all(abs(got[i] - bits(t, t)) < 1e-5 for i, t in enumerate(own))


def test_numpy_pieces_equal_brute_force():
    for order in (1, 2, 4):
        own = texts(order + 7, 60)
        bits = brute(own, order)
        raw = [t.encode() for t in own]
        offs = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
        buf = np.frombuffer(b"".join(raw), np.uint8)
        trie = lm.Trie(*lm.edges_of(*lm._runs(np.sort(lm.grams(buf, offs, order)[0])), order), order)
        assert np.allclose(trie.bits_without_own(buf, offs), [bits(t, t) for t in own])
        assert np.allclose(trie.bits(buf, offs), [bits(t) for t in own])


def test_edges(spark):
    docs = spark.createDataFrame([(1, "some text", 1), (2, None, 2), (3, "", 3), (None, "some text", 4), (1, "some text", 1), (4, "some text " * 40000, 5)], "doc_id int, text string, n_bytes int").withColumn("batch", F.lit("x"))
    for model in (None, lm.train(docs)):
        by = defaultdict(list)
        for r in lm.score(docs, model).collect():
            by[r["doc_id"]].append((r["n_bytes"], r["bits_per_byte"] is None))
        assert by == {1: [(9, False)] * 2, 2: [(0, True)], 3: [(0, True)], None: [(9, False)], 4: [(400000, False)]}
    assert lm.score(docs.limit(0)).count() == 0 == lm.score(docs.limit(0), lm.train(docs.limit(0))).count()
    # nothing known: a byte costs eight bits
    one = docs.where("doc_id = 1").limit(1)
    for model in (None, lm.train(docs.limit(0))):
        assert abs(lm.score(one, model).first()["bits_per_byte"] - 8) < 1e-9


def test_adaptive(spark):
    assert lm.adaptive_bits(b"") == 0 and lm.adaptive_bits(b"a") == 8
    # a: 8 bits; then "a" is known after nothing: one count and one escape
    assert lm.adaptive_bits(b"aa", 1) == 9
    again = lm.adaptive_bits(b"abcdefgh" * 50)
    rng = random.Random(1)
    assert again < 0.3 * lm.adaptive_bits(bytes(rng.randrange(256) for _ in range(400)))
    docs = spark.createDataFrame([(1, "abab", 0), (2, None, 0), (3, "", 0), (None, "abab", 0), (1, "abab", 0)], "doc_id int, text string, code_bits int")
    got = sorted(((r["doc_id"] or 0, r["code_bits"], r["bits_per_byte"] is None) for r in lm.score_adaptive(docs).collect()))
    cost = round(lm.adaptive_bits(b"abab"), 6)
    assert got == [(0, cost, False), (1, cost, False), (1, cost, False), (2, 0, True), (3, 0, True)]
    assert lm.score_adaptive(docs.limit(0)).count() == 0


def test_junk_costs_more_than_prose(spark):
    rng = random.Random(2)
    prose = [" ".join(rng.choice("the quick brown fox jumps over lazy dogs and sleeps".split()) for _ in range(60)) for _ in range(60)]
    junk = ["".join(chr(rng.randint(33, 126)) for _ in range(300)) for _ in range(5)]
    docs = spark.createDataFrame(list(enumerate(prose + junk)), "doc_id int, text string")
    got = {r["doc_id"]: r["bits_per_byte"] for r in lm.score(docs).collect()}
    assert max(got[i] for i in range(60)) < min(got[i] for i in range(60, 65))
