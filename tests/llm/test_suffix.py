"""Suffix arrays, repeated passages and repetition rules against brute force."""

import random
from collections import defaultdict

import numpy as np
import pytest

from quillspark.llm import quality, suffix_dedup
from quillspark.llm.suffix import common_prefixes, suffix_array

TEXTS = ["", "a", "banana banana banana", "abcabcabc" * 5, "ééé ünï ünï", "x" * 300]


def brute_repetition(text, least):
    covered, longest = np.zeros(len(text), bool), 0
    for a in range(len(text)):
        for b in range(a + 1, len(text)):
            n = 0
            while b + n < len(text) and text[a + n] == text[b + n]:
                n += 1
            if n >= least:
                longest = max(longest, n)
                covered[a : a + n] = covered[b : b + n] = True
    return len(text), int(covered.sum()), longest


@pytest.mark.parametrize("least", [2, 5, 9])
def test_repetition_equals_brute_force(least):
    rng = random.Random(least)
    texts = TEXTS + ["".join(rng.choice("abé ") for _ in range(rng.randint(0, 120))) for _ in range(25)]
    raw = [t.encode() for t in texts]
    offs = np.concatenate([[0], np.cumsum([len(x) for x in raw])])
    got = quality.repetition(np.frombuffer(b"".join(raw), np.uint8), offs, least)
    assert list(zip(*(x.tolist() for x in got))) == [brute_repetition(t, least) for t in texts]


def test_suffix_array_orders_all_suffixes():
    rng = np.random.default_rng(3)
    symbols = np.append(rng.integers(1, 4, 200), 0).astype(np.int64)
    order, split = suffix_array(symbols.astype(np.uint64), 1)
    want = sorted(range(201), key=lambda i: symbols[i:].tolist())
    assert order.tolist() == want
    lcp = common_prefixes(symbols, order, split, 2)
    for i in range(1, 201):
        a, b, n = symbols[want[i] :], symbols[want[i - 1] :], 0
        while n < min(len(a), len(b)) and a[n] == b[n]:
            n += 1
        assert lcp[i] == (n if n >= 2 else 0)


def test_repetition_report(spark):
    rows = spark.createDataFrame([(1, "ab " * 200, "x"), (2, None, "y"), (3, "", "z"), (None, "Only words that differ.", None), (1, "ab " * 200, "x")], "doc_id int, text string, keep string")
    got = {(r["doc_id"], r["n_chars"], r["keep"]) for r in quality.repetition_report(rows).collect()}
    assert got == {(1, 600, False), (2, 0, True), (3, 0, True), (None, 23, True)}
    left = quality.keep_unrepetitive(rows)
    assert left.columns == rows.columns and sorted(str(r["doc_id"]) for r in left.collect()) == ["2", "3", "None"]
    assert quality.repetition_report(rows.limit(0)).count() == 0


def brute_passages(docs, w):
    """Stretches in repeated windows, and how many of their words an earlier occurrence covers."""
    places = defaultdict(list)
    for d in sorted(docs):
        words = docs[d].split()
        for i in range(len(words) - w + 1):
            places[tuple(words[i : i + w])].append((d, i))
    inside, extra = defaultdict(set), defaultdict(set)
    for found in places.values():
        if len(found) > 1:
            for n, (d, i) in enumerate(sorted(found)):
                inside[d].update(range(i, i + w))
                if n:
                    extra[d].update(range(i, i + w))
    out = set()
    for d, at in inside.items():
        at = sorted(at)
        start = prev = at[0]
        for x in [*at[1:], None]:
            if x is None or x != prev + 1:
                out.add((d, start, prev + 1, len([e for e in extra[d] if start <= e <= prev])))
                start = x
            prev = x
    return out


@pytest.mark.parametrize("seed, hot", [(1, None), (2, 1 << 30), (3, 600), (4, 0)])
def test_passages_equal_brute_force(spark, seed, hot, monkeypatch):
    rng = random.Random(seed)
    shared = [" ".join(rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(12)) for _ in range(4)]
    docs = {}
    for d in range(30):
        parts = [" ".join(rng.choice("pqrstuvwxyz") * rng.randint(1, 4) for _ in range(rng.randint(0, 20))) for _ in range(3)]
        for s in rng.sample(shared, rng.randint(0, 2)):
            parts.insert(rng.randint(0, 3), s)
        docs[d] = " ".join(p for p in parts if p)
    docs[30] = docs[0]
    docs[31] = "word " * 40
    # a passage in every shard, with another neighbour each time
    everywhere = " ".join(f"all{i}" for i in range(11))
    for d in range(32, 60):
        docs[d] = f"{rng.random()} {everywhere} {rng.random()} tail"
    # many small shards, so that passages meet in the merge
    monkeypatch.setattr(suffix_dedup, "SHARD_BYTES", 400)
    monkeypatch.setattr(suffix_dedup, "BUCKET_BYTES", 500)
    if hot is not None:
        monkeypatch.setattr(suffix_dedup, "HOT_BYTES", hot)
    rows = spark.createDataFrame(list(docs.items()), "doc_id bigint, text string").repartition(3)
    got = {tuple(r) for r in suffix_dedup.repeated_passages(rows, min_words=8, anchor_words=3).collect()}
    assert got == {x for x in brute_passages(docs, 8)}


def test_windows_of_different_words_are_not_equal():
    # among some 360,000 windows of one anchor there are pairs whose last 32 bits of hash agree
    vocabulary = [f"v{i}" for i in range(600)]

    def packed(text):
        buf = np.frombuffer(text.encode(), np.uint8)
        return buf, np.array([0, len(buf)])

    buf, offs = packed(" ".join(vocabulary))
    starts, ends, _ = suffix_dedup.spans(buf, offs, suffix_dedup.NOT_SPACE)
    words = suffix_dedup.hashes(buf, starts, ends)
    least = int(suffix_dedup.rolling(words, 1).argmin())
    a, b = (x.ravel() for x in np.meshgrid(np.arange(600), np.arange(600)))
    low = suffix_dedup.rolling(words[np.stack([np.full(len(a), least), a, b], 1)].ravel(), 3)[::3].astype(np.uint32)
    turn = np.argsort(low)
    same = np.flatnonzero(low[turn][1:] == low[turn][:-1])
    assert len(same)
    for i in same[:5]:
        blobs = []
        for doc, j in enumerate((turn[i], turn[i + 1])):
            text = " ".join(vocabulary[x] for x in (least, a[j], b[j]))
            blobs += suffix_dedup.shard(np.array([doc]), np.array([doc]), *packed(text), 3, 1, 1, np.zeros(0, np.int64))[1]
        assert len(blobs) == 2 and not len(suffix_dedup.merge([x for _, x in blobs])["id"])
        assert len(suffix_dedup.merge([blobs[0][1], suffix_dedup.shard(np.array([9]), np.array([9]), *packed(" ".join(vocabulary[x] for x in (least, a[turn[i]], b[turn[i]]))), 3, 1, 1, np.zeros(0, np.int64))[1][0][1]])["id"]) == 2


@pytest.mark.parametrize("hot", [None, 0])
def test_cut_keeps_each_passage_once(spark, hot, monkeypatch):
    if hot is not None:
        monkeypatch.setattr(suffix_dedup, "HOT_BYTES", hot)
    passage = " ".join(f"w{i}" for i in range(60))
    rows = [(1, f"start one {passage} end one", 7, "a"), (2, f"start two {passage}\nlast two", 7, "b"), (3, passage, 7, None), (4, None, 7, "d"), (5, "", None, "e"), (None, "free text", 9, "f"), (2, f"start two {passage}\nlast two", 7, "b")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, n_chars bigint, at string")
    got = {(r["doc_id"], r["text"], r["n_chars"], r["at"]) for r in suffix_dedup.cut_repeats(docs).collect()}
    assert got == {(1, f"start one {passage} end one", 7, "a"), (2, "start two last two", 18, "b"), (4, None, 7, "d"), (5, "", None, "e"), (None, "free text", 9, "f")}
    assert suffix_dedup.cut_repeats(docs.limit(0)).count() == 0
    assert suffix_dedup.repeated_passages(docs.limit(0)).count() == 0


def test_hot_buckets_are_found_by_their_weight(spark, monkeypatch):
    passage = " ".join(f"w{i}" for i in range(50))
    rows = [(i, f"{passage} {i}") for i in range(300)] + [(300 + i, " ".join(f"x{i}y{j}" for j in range(60))) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("doc_id", "xxhash64(text) h", "text").repartition(3)
    monkeypatch.setattr(suffix_dedup, "HOT_BYTES", 2000)
    assert 1 <= len(suffix_dedup._hot_buckets(docs, 50, 16, 64)) <= 4


def test_long_texts(spark):
    """Texts longer than a shard, one of which repeats a passage of another."""
    rng = random.Random(1)
    words = [" ".join(str(rng.randrange(10**9)) for _ in range(40_000)) for _ in range(2)]
    passage = " ".join(words[0].split()[1000:1100])
    docs = spark.createDataFrame([(1, words[0]), (2, f"{words[1]} {passage}")], "doc_id bigint, text string")
    assert sorted(tuple(r) for r in suffix_dedup.repeated_passages(docs).collect()) == [(1, 1000, 1100, 0), (2, 40_000, 40_100, 100)]
    left = {r["doc_id"]: r["text"].rstrip() for r in suffix_dedup.cut_repeats(docs).collect()}
    assert left == {1: words[0], 2: words[1]}


def test_long_text_of_one_character(spark):
    rows = spark.createDataFrame([(1, "x" * 300_000), (2, " ".join(f"{i * 7919 % 1000003}" for i in range(40_000)))], "doc_id int, text string")
    got = {r["doc_id"]: (r["n_chars"], r["keep"]) for r in quality.repetition_report(rows).collect()}
    assert got[1] == (300_000, False) and got[2][1]
