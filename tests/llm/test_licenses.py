"""Notices against every template laid at every place."""

import random

import numpy as np
import pytest

from quillspark.llm import licenses as L

APACHE = "Licensed under the Apache License, Version 2.0"


def brute(words, templates):
    """All places at which a whole template stands, by comparing words."""
    out = set()
    for t, goal in enumerate(templates):
        for a in range(len(words) - len(goal) + 1):
            if len(goal) >= L.K and (words[a : a + len(goal)] == goal).all():
                out.add((t, a, a + len(goal)))
    return out


def lcs(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


@pytest.mark.parametrize("seed", range(5))
def test_similarity_is_the_common_subsequence(seed):
    rng = np.random.default_rng(seed)
    a, b = rng.integers(0, 4, rng.integers(1, 20)), rng.integers(0, 4, rng.integers(1, 20))
    assert abs(L.similarity(a, b) - 2 * lcs(a.tolist(), b.tolist()) / (len(a) + len(b))) < 1e-12


def test_exact_notices_equal_brute_force(spark):
    rng = random.Random(3)
    fill = ["lorem", "under", "the", "license", "version", "released", "ipsum", "dolor"]
    texts = []
    for _ in range(40):
        parts = [" ".join(rng.choice(fill) for _ in range(rng.randint(0, 30))) for _ in range(3)]
        for _ in range(rng.randint(0, 2)):
            parts.insert(rng.randint(0, 3), rng.choice(L.TEMPLATES)[1].upper() if rng.random() < 0.3 else rng.choice(L.TEMPLATES)[1])
        texts.append(" ".join(parts))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    got = {(r["doc_id"], r["template"], r["start_word"], r["end_word"]) for r in L.license_spans(docs, min_similarity=1.0).collect()}
    goals = [L.words_of(t) for _, t in L.TEMPLATES]
    want = {(i, *x) for i, t in enumerate(texts) for x in brute(L.words_of(t), goals)}
    # of notices inside longer ones the longest stands
    clear = {x for x in want if not any(y[0] == x[0] and y != x and y[2] < x[3] and x[2] < y[3] for y in want)}
    assert got <= want and clear <= got and len(clear) > 20


def test_changed_words_are_found(spark):
    long = next(t for n, t in L.TEMPLATES if n == "MIT" and "free of charge" in t)
    words = long.split()
    rows = [(1, "x y " + " ".join([*words[:6], "NEW", *words[6:15], *words[16:]]) + " z"), (2, " ".join(words[:5])), (3, "The words license and apache alone. Licensed under something else, a longer sentence that is no notice.")]
    got = {r["doc_id"]: r for r in L.license_spans(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert set(got) == {1} and got[1]["license"] == "MIT" and got[1]["similarity"] > 0.9 and got[1]["start_word"] <= 3


def test_edges(spark):
    rows = [(1, APACHE, "a"), (1, APACHE, "a"), (2, APACHE, "b"), (None, f"{APACHE}. {APACHE}", None), (3, None, "c"), (4, "", "d"), (5, "word " * 50000 + APACHE, "e")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, license string")
    got = sorted((str(r["doc_id"]), r["license"], r["start_word"], r["end_word"]) for r in L.license_spans(docs).collect())
    assert got == [("1", "Apache-2.0", 0, 8), ("2", "Apache-2.0", 0, 8), ("5", "Apache-2.0", 50000, 50008), ("None", "Apache-2.0", 0, 8), ("None", "Apache-2.0", 8, 16)]
    assert L.license_spans(docs.limit(0)).count() == 0 and L.license_spans(docs, templates=[]).count() == 0


def test_templates_of_a_table(spark, monkeypatch):
    own = spark.createDataFrame([("House-1", "every reader of this house may copy the house rules freely", 1), ("House-1", "every reader of this house may copy the house rules freely", 1), (None, "x y z w", 1), ("House-2", None, 1)], "license string, text string, k int")
    assert L.read_templates(own) == [("House-1", "every reader of this house may copy the house rules freely")]
    docs = spark.createDataFrame([(1, "so: Every reader of this house may copy the house rules freely!"), (2, "other")], "doc_id bigint, text string")
    assert [(r["doc_id"], r["license"], r["start_word"]) for r in L.license_spans(docs, templates=own).collect()] == [(1, "House-1", 1)]
    monkeypatch.setattr(L, "TEMPLATE_BYTES", 10)
    with pytest.raises(ValueError):
        L.read_templates(own)
