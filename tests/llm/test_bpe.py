"""Tokens against a public library's, and back."""

import base64
import os
import random

import numpy as np
import pytest

from quillspark.llm import bpe

pytestmark = pytest.mark.skipif(not os.path.exists(bpe.VOCABULARY), reason="no vocabulary here")
TEXTS = ["", " ", "Hello, world! It's 12345 o'clock.", "don't  won't\t\n\n x ", "a" * 1001, "ab" * 400, " " * 500 + "z", "日本語のテキスト、そして🎉 émojis", "<|endoftext|> is text", "naïve café — “quotes”", "\r\n\r\n\x00\x01"]


@pytest.fixture(scope="module")
def library():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(bpe.VOCABULARY, "rb"))}
    return tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts(seed):
    rng = random.Random(seed)
    alphabet = "abcdefghij ABC  .,'\n0129éüß日🎉"
    return TEXTS + ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 300))) for _ in range(60)]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_equals_the_library(library, seed, monkeypatch):
    monkeypatch.setattr(bpe, "KNOWN_PIECES", 50)
    known = bpe.Known(bpe.load())
    for part in (texts(seed), [None, *texts(seed + 10)]):
        tokens, count = known.encode(part)
        ends = np.cumsum(count)
        assert [tokens[e - c : e].tolist() for e, c in zip(ends, count)] == [library.encode_ordinary(t or "") for t in part]


def one_by_one(m, row):
    """The leftmost pair of least rank, again and again."""
    row = row.tolist()
    while len(row) > 1:
        rank = m.pairs.find(np.array(row[:-1]), np.array(row[1:]))
        at = int(rank.argmin())
        if rank[at] == bpe._NONE:
            break
        row[at : at + 2] = [int(rank[at])]
    return row


def test_long_rows_merge_as_if_one_by_one():
    m = bpe.load()
    for word in ("aaaaabaaaaab" * 9, "thethethe" * 12, "x" * 700, "ababababa" * 11, "".join(random.Random(4).choices("abcdeth", k=900))):
        row = m.single[np.frombuffer(word.encode(), np.uint8)]
        got, n = m.merge(row[None].copy())
        assert got[0, : n[0]].tolist() == one_by_one(m, row)


@pytest.mark.parametrize("seed", range(6))
def test_any_order_of_ranks(tmp_path, seed):
    """Ranks that no training would give: a longer token may come before its parts."""
    rng = random.Random(seed)
    tokens = {"".join(rng.choices("abc", k=rng.randint(2, 5))) for _ in range(60)}
    ranks = [bytes([b]) for b in range(256)] + [t.encode() for t in rng.sample(sorted(tokens), len(tokens))]
    (tmp_path / "own").write_bytes(b"\n".join(base64.b64encode(t) + b" " + str(i).encode() for i, t in enumerate(ranks)))
    m = bpe.ByteBPE(str(tmp_path / "own"))
    words = ["".join(rng.choices("abc", k=k)) for k in (1, 2, 3, 7, 16, 40, 90, 200, 300) for _ in range(4)] + ["a" * 77, "ab" * 50, "cab" * 60]
    tokens, count = m.encode_pieces(words)
    ends = np.cumsum(count)
    assert [tokens[e - c : e].tolist() for e, c in zip(ends, count)] == [one_by_one(m, m.single[np.frombuffer(w.encode(), np.uint8)]) for w in words]


def test_pair_table_holds_all_pairs():
    rng = np.random.default_rng(0)
    left, right = rng.integers(0, 500, (2, 4000))
    keys = np.unique(left * 1000 + right)
    table = bpe.Pairs(keys // 1000, keys % 1000, np.arange(len(keys)))
    assert (table.find(keys // 1000, keys % 1000) == np.arange(len(keys))).all()
    assert (table.find(np.array([999]), np.array([1])) == bpe._NONE).all()


def test_round_trip_of_a_table(spark, library):
    rows = [(i, t, 1) for i, t in enumerate(texts(7))] + [(None, "no id", 2), (5, None, 3), (5, "again", 4), (5, "again", 4), (900, "long words and " * 30000, 5)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, tokens int")
    out = bpe.encode_documents(docs).cache()
    assert out.count() == len(rows) and out.where("not exact").count() == 0
    assert sorted((r["tokens"] or [-1]) for r in out.collect()) == sorted((library.encode_ordinary(t) or [-1]) if t is not None else [-1] for _, t, _ in rows)
    back = sorted(map(str, ((r["doc_id"], r["text"]) for r in bpe.decode_documents(out).collect())))
    assert back == sorted(map(str, ((i, t) for i, t, _ in rows)))
    assert bpe.encode_documents(docs.limit(0)).count() == 0


def test_tokens_that_are_none(spark):
    rows = [(1, [50], 0), (2, [-1, 50], 0), (3, [50, 1_000_000, 50], 0), (4, [None, 50], 0), (5, [], 0), (6, None, 0), (None, [50], 0), (1, [50], 0)]
    got = spark.createDataFrame(rows, "doc_id int, tokens array<int>, text int")
    one = bpe.load().decode(np.array([50])).decode()
    back = [(r["doc_id"], r["text"]) for r in bpe.decode_documents(got).collect()]
    assert back == [(1, one), (2, "\ufffd" + one), (3, one + "\ufffd" + one), (4, "\ufffd" + one), (5, ""), (6, None), (None, one), (1, one)]
    assert bpe.decode_documents(got.limit(0)).count() == 0
