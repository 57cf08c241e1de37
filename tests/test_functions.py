import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark import errors
from quillspark.functions import embed, quant
from quillspark.functions import text as T
from quillspark.functions import vectors as V
from quillspark.models import Device, Registry, recommend
from quillspark.operators import chunk, rag


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x"))).first()[0]


def test_tokenize(spark):
    assert one(spark, T.tokenize, "The Indemnification, Clause 4.2!") == ["indemnification", "clause"]
    assert one(spark, T.tokenize, "The of a an") == []
    assert one(spark, T.tokenize, "") == []
    assert one(spark, T.tokenize, None) is None
    assert len(T.STOPWORDS) == 42


@pytest.mark.parametrize("text", ["", "  \n ", "One. Two! Three?", "a\r\nb. c", "no end", "x" * 5000, "A.  B.\n\nC."])
def test_sentences_as_the_chunker_splits(spark, text):
    assert one(spark, T.sentences, text) == chunk.split_sentences(text.replace("\r\n", "\n").strip())
    assert one(spark, T.approx_tokens, text) == chunk.approx_tokens(text)


def test_truncate(spark):
    assert one(spark, lambda c: T.truncate(c, 10), "short") == "short"
    assert one(spark, lambda c: T.truncate(c, 5, "!"), "a" * 30) == "a" * 20 + "...!"
    assert one(spark, lambda c: T.truncate(c, 5), "a" * 17 + "." + "b" * 20) == "a" * 17 + "."
    assert one(spark, lambda c: T.truncate(c, 5), "a." + "b" * 40) == "a." + "b" * 18 + "..."


def test_prompt_replaces_in_order_and_literally(spark):
    got = one(spark, lambda c: T.prompt(F.lit("{system}|{context}|{question}"), F.lit("S{context}"), c, F.lit("$1")), "C")
    assert got == "SC|{context}|$1"


def test_escape(spark):
    raw = "<a href=\"x\">&'/"
    assert one(spark, T.escape, raw) == errors.escape(raw) == "&lt;a href=&quot;x&quot;&gt;&&#x27;&#x2F;"
    assert errors.sanitise({"a": ["<", {"b": "/"}], "n": 1, "t": True, "z": None}) == {"a": ["&lt;", {"b": "&#x2F;"}], "n": 1, "t": True, "z": None}
    with pytest.raises(errors.InvalidParams):
        errors.sanitise({"f": print})


def test_hashes(spark):
    def h(s):
        x = 0
        for c in s:
            x = (x * 31 + ord(c)) % 2**32
        return x

    for s in ("", "abc", "The quick brown fox jumps over the lazy dog" * 3):
        assert one(spark, T.string_hash, s) == (h(s) - 2**32 if h(s) >= 2**31 else h(s))
    ids = one(spark, T.hash_tokens, "Ab 12, c")
    assert ids == [h("Ab") % 30000 + 1000, h("12") % 30000 + 1000, h("c") % 30000 + 1000, 102] + [0] * 92
    assert one(spark, T.hash_tokens, "?!") == [101, 102] + [0] * 94
    v = one(spark, lambda c: embed.hash_embedding(c, 8), "hello")
    assert math.isclose(sum(x * x for x in v), 1)


def test_distances(spark):
    rng = np.random.default_rng(1)
    pairs = [(rng.standard_normal(8).tolist(), rng.standard_normal(8).tolist()) for _ in range(20)] + [([0.0] * 8, [1.0] * 8)]
    rows = spark.createDataFrame(pairs, "a array<float>, b array<float>")
    got = rows.select("a", "b", *(V.similarity(m, F.col("a"), F.col("b")).alias(m) for m in V.METRICS)).collect()
    for r in got:
        a, b = np.array(r["a"]), np.array(r["b"])
        n = np.linalg.norm(a) * np.linalg.norm(b)
        assert math.isclose(r["cosine"], a @ b / n if n else 0.0, abs_tol=1e-9)
        assert math.isclose(r["dot"], a @ b, abs_tol=1e-9)
        assert math.isclose(r["euclidean"], 1 / (1 + np.linalg.norm(a - b)), abs_tol=1e-9)
    odd = spark.createDataFrame([([1.0, float("nan")],), ([1.0],), (None,), ([1.0, None],), ([1.0, float("inf")],), ([3.0, 4.0],)], "v array<float>")
    assert [r[0] for r in odd.select(V.is_valid(F.col("v"), 2)).collect()] == [False, False, False, False, False, True]
    assert one(spark, V.normalise, [0.0, 0.0], "array<float>") == [0.0, 0.0]


@pytest.mark.parametrize("size", [384, 128, 64, 33, 10, 1])
def test_quantisation(spark, size):
    v = np.random.default_rng(size).standard_normal(size).astype(np.float32).tolist()
    rows = spark.createDataFrame([(v,), ([0.0] * size,), ([1.0] * size,)], "v array<float>")
    for form, steps in (("int8", 127), ("int4", 7)):
        q = rows.select("v", quant.quantise(F.col("v"), form).alias("q")).select("v", quant.dequantise(F.col("q"), form).alias("back"), "q")
        for r in q.collect():
            top = max(abs(x) for x in r["v"])
            assert len(r["back"]) == size
            assert max(abs(a - b) for a, b in zip(r["v"], r["back"])) <= top / steps / 2 + 1e-6
    codes = rows.select(quant.int4(F.col("v")).alias("c"))
    assert all(r[0] == r[1] for r in codes.select("c", quant.int4_unpacked(quant.int4_packed(F.col("c")), F.size("c"))).collect())
    same = rows.select("v", quant.quantise(F.col("v"), "fp16").alias("q")).first()
    assert same["q"]["data"] == same["v"] and same["q"]["format"] == "fp16"
    assert rows.select(quant.quantise(F.col("v"), "odd").alias("q")).first()["q"]["format"] == "fp32"


def test_chunker():
    c = chunk.Chunker(32, 8, 4)
    assert c.chunks("") == c.chunks("  \n") == c.chunks(None) == []
    assert c.chunks("One sentence.") == [(0, 0, "One sentence.")]
    text = " ".join(f"Sentence number {i} has a few words in it." for i in range(40))
    got = c.chunks(text)
    assert [g[0] for g in got] == list(range(len(got))) and len(got) > 5
    # every sentence is there, neighbours overlap, starts fit
    assert all(f"number {i} " in " ".join(g[2] for g in got) for i in range(40))
    assert all(text[g[1] :].startswith(g[2][:20]) for g in got)
    assert any(a[2].split(". ")[-1] in b[2] for a, b in zip(got, got[1:]))
    assert len(chunk.Chunker(10, 100, 1).chunks(" ".join(["Tiny one."] * 8))) >= 1
    tail = chunk.Chunker(16, 2, 8).chunks(" ".join(["A sentence of some words here."] * 20) + " tiny.")
    assert tail[-1][2].endswith("tiny.") and chunk.approx_tokens(tail[-1][2]) >= 8


def test_chunks_of_a_table(spark):
    docs = spark.createDataFrame([(1, "One. Two."), (2, None), (3, ""), (None, "Three.")], "id int, text string")
    got = {(r["id"], r["chunk"], r["chunk_id"]) for r in chunk.chunk_documents(docs).collect()}
    assert got == {(1, "One. Two.", "1#0"), (None, "Three.", "0")}


def test_checks():
    for k in (0, -1, 1.5, 10_001, True):
        with pytest.raises(errors.InvalidParams):
            errors.check_k(k)
    assert errors.check_k(10_000) == 10_000
    with pytest.raises(errors.DimensionMismatch):
        errors.check_vector([1.0], 2)
    for bad in (float("nan"), float("inf")):
        with pytest.raises(errors.InvalidVector):
            errors.check_vector([1.0, bad], 2)
    waits, turns = [], []

    def fails():
        turns.append(1)
        raise ValueError("no")

    with pytest.raises(ValueError):
        errors.with_retry(fails, sleep=waits.append)
    assert len(turns) == 3 and waits == [0.1, 0.2]


def test_sizes_and_models(spark):
    assert T.parse_sizes("1k, 10k,500") == [1000, 10000, 500]
    reg = Registry([("small", 384, 25, "low"), ("large", 1024, 420, "high")], [("a", "gpu", 1.0, "low", True), ("b", "gpu", 4.8, "high", True), ("c", "cpu", 0.8, "low", False)])
    reg.check_dimensions("unknown", 3)
    with pytest.raises(errors.DimensionMismatch):
        reg.check_dimensions("small", 512)
    assert not reg.can_run("a", Device("low", gpu=False))[0] and reg.can_run("a", Device("low", gpu=True))[0]
    assert not reg.can_run("large", Device("mid"))[0] and reg.can_run("nobody", Device())[0] and not reg.can_run("c", Device("low", memory_gb=0.5))[0]
    _, language = reg.tables(spark)
    assert recommend(language, Device("low", gpu=True), "gpu").first()["id"] == "a"
    assert recommend(language, Device("low", gpu=False), "gpu").first()["id"] == "c"


def test_cascade_and_extractive():
    class Broken:
        def is_available(self):
            return True

        def generate(self, prompt, **options):
            raise RuntimeError("down")

        def stream(self, prompt, **options):
            yield "half"
            raise RuntimeError("down")

    both = rag.Cascade([Broken(), rag.Extractive()])
    prompt = "Passages:\nThe cat sat. The dog ran away.\n\nQuestion: where did the dog run?"
    assert "dog ran" in both.generate(prompt)
    with pytest.raises(RuntimeError):
        list(both.stream(prompt))
    with pytest.raises(errors.EngineError):
        rag.Cascade([]).generate(prompt)
