"""Graph index, token budgets, contracts, streams of keywords, plans that read little."""

import json
import os
import warnings

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark import cli, contracts, errors, session
from quillspark.functions import embed, tokens
from quillspark.functions import text as T
from quillspark.functions.filters import Typed, condition
from quillspark.functions.words import Words
from quillspark.models import tier_of
from quillspark.operators import chunk, fusion, graph, rag, search, sparse, vector_bench
from quillspark.sources import derived, exchange
from quillspark.sources.collection import Collection
from quillspark.streaming import ingest
from quillspark.tools import Tools


def unit(n, d, seed=42):
    x = np.random.default_rng(seed).standard_normal((n, d)).astype(np.float32)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def nearest(x, q, k, without=()):
    s = x @ q
    return [i for i in np.argsort(-s, kind="stable") if i not in without][:k]


# The graph


@pytest.mark.parametrize("metric", ["cosine", "dot", "euclidean"])
def test_graph_recall_and_round_trip(metric):
    x = unit(800, 24)
    g = graph.Graph(24, metric, m=8, width=80)
    for i, v in enumerate(x):
        g.insert(i, v)
    assert all(len(near) <= (16 if layer == 0 else 8) for held in g.links for layer, near in held.items())
    again = graph.Graph.from_bytes(g.to_bytes())
    hits = [{i for i, _ in again.search(q, 10)} for q in x[:100]]
    assert np.mean([len(h & set(nearest(x, q, 10))) / 10 for h, q in zip(hits, x)]) > 0.95
    assert again.search(x[3], 1)[0][0] == 3 and abs(again.search(x[3], 1)[0][1] - {"cosine": 0, "dot": -1, "euclidean": 0}[metric]) < 1e-5
    assert [h for h in again.search(x[5], 10)] == g.search(x[5], 10)


def test_graph_removes_replaces_and_filters():
    x = unit(300, 16)
    g = graph.Graph(16, m=6, width=60)
    for i, v in enumerate(x):
        g.insert(i, v)
    assert g.remove(7) and not g.remove(7) and g.live() == 299
    assert 7 not in {i for i, _ in g.search(x[7], 20)}
    g.insert(8, x[7])
    assert g.live() == 299 and g.search(x[7], 1)[0][0] == 8
    # so few are allowed that the search must go on through all others
    some = {1, 50, 299}
    assert {i for i, _ in g.search(x[0], 5, 10, some)} == some
    assert graph.Graph(4).search([1, 0, 0, 0], 3) == []
    with pytest.raises(errors.DimensionMismatch):
        g.insert(1, [1.0])


def test_graph_recall_holds_in_larger_graphs():
    x = unit(6200, 64, 11)
    g = graph.Graph(64, m=8, width=60)
    for i, v in enumerate(x[:6000]):
        g.insert(i, v)
    hits = [{i for i, _ in g.search(q, 10, 96)} for q in x[6000:]]
    assert np.mean([len(h & set(nearest(x[:6000], q, 10))) / 10 for h, q in zip(hits, x[6000:])]) > 0.85


@pytest.mark.parametrize("metric", ["cosine", "dot", "euclidean"])
def test_small_graphs_answer_many_queries_at_once(metric, monkeypatch):
    x = unit(300, 16)
    x[200:230] = x[0]
    g = graph.Graph(16, metric, m=8, width=60)
    for i, v in enumerate(x):
        g.insert(i, v)
    g.remove(0)
    monkeypatch.setattr(graph.Graph, "_walk", None)
    who, ids, score = g.search_many(x[:50], 5)
    got = {}
    for q, i, s in zip(who.tolist(), ids.tolist(), score.tolist()):
        got.setdefault(q, []).append(i)
        assert abs(s - {"cosine": x[q] @ x[i], "dot": x[q] @ x[i], "euclidean": 1 / (1 + np.linalg.norm(x[q] - x[i]))}[metric]) < 1e-5
    assert got[0] == [200, 201, 202, 203, 204]
    assert all(got[q] == nearest(x, x[q], 5, {0}) for q in range(1, 50) if 200 not in nearest(x, x[q], 40, {0})[:5])
    who, ids, _ = g.search_many(x[:3], 5, allowed=np.array([7, 9]))
    assert sorted(ids[who == 2].tolist()) == [7, 9]
    assert len(graph.Graph(16).search_many(x[:3], 5)[0]) == 0


def test_graph_index(spark, tmp_path):
    x = unit(400, 16)
    rows = spark.createDataFrame([(i, v.tolist(), i % 4) for i, v in enumerate(x)], "id bigint, vector array<float>, kind int")
    at = graph.GraphIndex(spark, f"file://{tmp_path}/g")
    assert at.table() is None
    with pytest.raises(ValueError):
        at.add(rows)
    at.build(rows.where("id < 300"), 16, m=8, width=80, shard_rows=100)
    asked = rows.where("id % 20 = 0").select(F.col("id").alias("query_id"), F.col("vector").alias("query_vector"))

    def found(**more):
        out = {}
        for r in at.search(asked, 5, **more).orderBy("query_id", "rank").collect():
            out.setdefault(r["query_id"], []).append(r["id"])
        return out

    first = found()
    assert at.stats().first().asDict() == {"shards": 3, "live": 300, "gone": 0}
    assert np.mean([len(set(first[q]) & set(nearest(x[:300], x[q], 5))) / 5 for q in first]) > 0.9
    at.add(rows.where("id >= 300"), removed=rows.where("id < 10"))
    gone = set(range(10))
    after = found()
    assert np.mean([len(set(after[q]) & set(nearest(x, x[q], 5, gone))) / 5 for q in after]) > 0.9
    assert at.stats().first().asDict() == {"shards": 3, "live": 390, "gone": 10}
    only = found(allowed=rows.where("kind = 1").select("id"))
    assert all(i % 4 == 1 for ids in only.values() for i in ids) and all(len(ids) == 5 for ids in only.values())
    # a version without its mark is not read
    os.makedirs(f"{tmp_path}/g/v-99999999-lost")
    assert found() == after
    assert at.search(asked.limit(0), 5).count() == 0


def test_contracts(spark, tmp_path):
    assert isinstance(Collection(spark, f"{tmp_path}/c", 3), contracts.Storage)
    assert isinstance(graph.GraphIndex(spark, f"{tmp_path}/g"), contracts.Index)
    assert {"Embedder", "Provider", "Tokenizer"} <= set(contracts.__all__)


# Text


TEXTS = ["The Cat sat, on the mat! A1 b2", "", None, "x y zz", "naïve café 42", "Kelvin İstanbul aKb", "one" * 50, "to be or not", "tab\tand\nline\rbreaks\x0bvt", "ends with a letter q", "q starts"]


def test_batch_tokens_equal_the_column(spark):
    rows = spark.createDataFrame(list(enumerate(TEXTS * 3)), "id int, text string").repartition(2)
    want = {(r["id"], r["term"], r["tf"], r["dl"]) for r in rows.select("id", T.tokenize(F.col("text")).alias("w")).select("id", F.size("w").alias("dl"), F.explode("w").alias("term")).groupBy("id", "term", "dl").agg(F.count("*").alias("tf")).select("id", "term", "tf", "dl").collect()}
    assert {tuple(r) for r in sparse.tokens(rows).select("id", "term", "tf", "dl").collect()} == want
    df = {r["term"]: r["df"] for r in sparse.document_frequency(sparse.tokens(rows)).collect()}
    assert df == {r["term"]: r["df"] for r in sparse.term_documents(rows).collect()}
    assert {r["id"]: r["dl"] for r in sparse.lengths(rows).collect()} == {r["id"]: max(r["n"], 0) if r["n"] is not None else 0 for r in rows.select("id", F.size(T.tokenize(F.col("text"))).alias("n")).collect()}


def test_words_of_nothing():
    import pyarrow as pa

    for texts in ([], [None], ["", ""], ["a b c"], ["é"]):
        w = Words(pa.array(texts, pa.string()))
        assert w.lengths().tolist() == [0] * len(texts) and not len(w.counts()[0])


def test_many_query_terms_are_joined(spark, monkeypatch):
    docs = spark.createDataFrame([("a", "alpha beta beta"), ("b", "beta gamma"), ("c", None)], "id string, text string")
    asked = spark.createDataFrame([(1, "beta alpha"), (2, "gamma delta")], "query_id int, query string")

    def both():
        return [[tuple(r)[:2] + (round(r["score"], 9),) for r in f(docs, asked).orderBy("query_id", "rank").collect()] for f in (sparse.bm25, sparse.bag_cosine)]

    few = both()
    monkeypatch.setattr(sparse, "TERM_BYTES", sparse.BROADCAST_BYTES)
    assert both() == few and len(few[0]) == 3


def test_token_budgets(spark):
    class Halves:
        """Two characters a token."""

        def encode(self, text):
            return [i for i in range((len(text) + 1) // 2)]

        def decode(self, numbers):
            return "ab" * len(numbers)

    rows = spark.createDataFrame([("abababab",), ("ab",), ("",), (None,)], "t string")
    got = rows.select(tokens.count_tokens(Halves)(F.col("t")), tokens.truncate_tokens(Halves, 2, "~")(F.col("t"))).collect()
    assert [tuple(r) for r in got] == [(4, "abab~"), (1, "ab"), (0, ""), (None, None)]
    bare = tokens.subwords("/nowhere/at/all.json")
    got = rows.select(tokens.count_tokens(bare)(F.col("t")), tokens.truncate_tokens(bare, 1)(F.col("t"))).collect()
    assert [tuple(r) for r in got] == [(2, "abab"), (1, "ab"), (0, ""), (None, None)]


@pytest.mark.skipif(not os.path.exists("/opt/tokenizers/byte_bpe_50k.json"), reason="no vocabulary here")
def test_subwords(spark):
    make = tokens.subwords("/opt/tokenizers/byte_bpe_50k.json")
    text = "Hello there, general tokens of a vocabulary!"
    n = len(make().encode(text))
    row = spark.createDataFrame([(text,)], "t string").select(tokens.count_tokens(make)(F.col("t")).alias("n"), tokens.truncate_tokens(make, 3)(F.col("t")).alias("h")).first()
    assert row["n"] == n < len(text) / 2 and text.startswith(row["h"]) and len(make().encode(row["h"])) == 3


def test_chunker_in_sql(spark):
    texts = [" ".join(f"Sentence {i} of text {d} says something." for i in range(90)) for d in range(3)] + ["", None, "One."]
    docs = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    small = chunk.Chunker(64, 16, 8)
    chunk.register_sql(spark, "cut_up", small)
    docs.createOrReplaceTempView("cut_docs")
    got = {tuple(r) for r in spark.sql("select d.id, c.* from cut_docs d, lateral cut_up(d.text) c").collect()}
    assert got == {(r["id"], r["chunk_index"], r["start_offset"], r["chunk"]) for r in chunk.chunk_documents(docs, small).collect()} and len(got) > 20


# Retrieval


def test_scans_take_filters_over(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")

    def pushed(spec):
        plan = rows.where(condition(spec, Typed(rows.schema))).select("doc_id")._jdf.queryExecution().executedPlan().toString()
        return plan.split("PushedFilters: [")[1].split("]")[0]

    assert "EqualTo(lang,en)" in pushed({"field": "lang", "operator": "eq", "value": "en"})
    assert "Not(EqualTo(lang,en))" in pushed({"field": "lang", "operator": "ne", "value": "en"})
    assert "GreaterThan(n_chars,5)" in pushed({"field": "n_chars", "operator": "gt", "value": 5})
    assert "In(source, [src1,src2" in pushed({"field": "source", "operator": "in", "value": ["src1", "src2"]})
    assert "StringContains(text,abc)" in pushed({"field": "text", "operator": "contains", "value": "abc"})
    assert "Or(EqualTo(lang,en),LessThan(n_chars,9))" in pushed({"operator": "or", "filters": [{"field": "lang", "operator": "eq", "value": "en"}, {"field": "n_chars", "operator": "lt", "value": 9}]})


@pytest.mark.parametrize("search_", ["bm25", "hybrid", "faithful"])
def test_documents_are_scanned_once(spark, search_):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    asked = spark.createDataFrame([(1, "alpha beta")], "query_id int, query string")
    if search_ == "bm25":
        out = sparse.bm25(docs, asked, 5, "doc_id")
    else:
        out = fusion.hybrid(docs, asked, 5, F.col("lang") == "en" if search_ == "faithful" else None, search_ == "faithful", "doc_id")
    # the one scan lies before the cut
    assert "documents.parquet" not in out._jdf.queryExecution().executedPlan().toString()


def test_equal_vectors_tie_in_euclidean_batches(spark):
    x = unit(200, 48, 3)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(np.vstack([x, x * 1.0, x[:50]]))], "id bigint, vector array<float>")
    asked = rows.select(F.col("id").alias("query_id"), F.col("vector").alias("query_vector"))
    got = {}
    for r in search.batch_top_k(rows, asked, 3, "euclidean", block=37).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["id"], r["score"]))
    for q, hits in got.items():
        same = [i for i in range(450) if i % 200 == q % 200 and i < 450][:3]
        assert [i for i, s in hits if s == 1.0] == same


def test_batches_beyond_a_broadcast(spark, monkeypatch):
    x = unit(150, 8)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id bigint, vector array<float>")
    asked = rows.select(F.col("id").alias("query_id"), F.col("vector").alias("query_vector"))
    want = {tuple(r) for r in search.batch_top_k(rows, asked, 4, block=32).select("query_id", "id", "rank").collect()}
    monkeypatch.setattr(search, "fits", lambda *a: False)
    assert {tuple(r) for r in search.batch_top_k(rows, asked, 4, block=32).select("query_id", "id", "rank").collect()} == want
    cells = rows.withColumn("cell", F.when(F.col("id") < 100, 0).otherwise(1))
    near = asked.crossJoin(spark.range(2).select(F.col("id").alias("cell")))
    assert {tuple(r) for r in search.within_cells(cells, near, 4, block=16).select("query_id", "id", "rank").collect()} == want


@pytest.mark.parametrize("metric", ["cosine", "dot", "euclidean"])
def test_blocks_of_rows_send_on_the_best_of_a_task_alone(spark, monkeypatch, metric):
    x = unit(600, 8)
    # copies tie by id, a vector without length and a long one go along
    x[300:420], x[5], x[6] = x[:120], 0, x[6] * 1e4
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id bigint, vector array<float>").repartition(3)
    asked = rows.withColumnsRenamed({"id": "query_id", "vector": "query_vector"})
    sent, best = [], search._best
    monkeypatch.setattr(search, "QUERY_BYTES", session.BROADCAST_BYTES)
    monkeypatch.setattr(search, "_best", lambda pairs, k: sent.append(pairs.count()) or best(pairs, k))
    got = {}
    for r in search.batch_top_k(rows, asked, 4, metric, block=16).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["id"])
    x = x.astype(np.float64)
    if metric == "euclidean":
        s = 1 / (1 + np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)))
    else:
        length = np.outer(*[np.linalg.norm(x, axis=1)] * 2)
        s = x @ x.T if metric == "dot" else np.where(length == 0, 0, x @ x.T / np.where(length == 0, 1, length))
    s = np.round(s, 9)
    assert got == {i: np.lexsort((np.arange(600), -s[i]))[:4].tolist() for i in range(600)}
    # a list for each of a dozen tasks at most, not for each of forty blocks
    assert sent[0] <= 600 * 4 * 12


def test_means_of_cells(spark):
    x = unit(100, 5)
    rows = spark.createDataFrame([(i, v.tolist(), i % 3) for i, v in enumerate(x)] + [(100, None, 1)], "id int, vector array<float>, cell int").repartition(4)
    got = {r["cell"]: r["centroid"] for r in search.centroids(rows, "cell").collect()}
    assert all(np.allclose(got[c], x[c::3].mean(0), atol=1e-6) for c in range(3)) and len(got) == 3


DOCS = [("d1", "Payment is due within thirty days of the invoice."), ("d2", "The warranty covers defects for two years."), ("d3", "Payment disputes go to arbitration.")]


def test_stubs_and_rerankers(spark):
    docs = spark.createDataFrame(DOCS, "id string, text string")
    asked = spark.createDataFrame([(1, "payment arbitration")], "query_id int, query string")
    plain = rag.retrieve(docs, asked, rag.Profile(top_k=3)).orderBy("rank").collect()
    noop = rag.retrieve(docs, asked, rag.Profile(top_k=3, rerank="noop")).orderBy("rank").collect()
    assert plain == noop and all(r["content"] for r in plain)
    hits = spark.createDataFrame([(1, "a", 0.5, 1), (1, "b", 0.4, 2)], "query_id int, id string, score double, rank int")
    assert [r["new_rank"] for r in fusion.noop_rerank(hits).collect()] == [1, 2]
    dense = spark.createDataFrame([(1, "a", "text of a")], "query_id int, id string, text string")
    rows = fusion.with_dense_rows(hits, dense, ["text"], {"text": F.lit("")}).orderBy("rank").collect()
    assert [(r["id"], r["text"]) for r in rows] == [("a", "text of a"), ("b", "")]


def test_answers_as_a_plan(spark):
    docs = spark.createDataFrame(DOCS, "id string, text string")
    asked = spark.createDataFrame([(1, "When is payment due?"), (2, "zebra")], "query_id int, query string")
    got = {r["query_id"]: r for r in rag.answers(docs, asked, profile=rag.Profile(top_k=2)).collect()}
    here = {a.query_id: a for a in rag.answer(docs, asked, profile=rag.Profile(top_k=2))}
    assert set(got) == {1, 2} and all(got[q]["answer"] == here[q].answer and got[q]["context_tokens"] == here[q].prompt_tokens for q in got)
    assert got[1]["citations"][0]["id"] == "d1" and got[2]["citations"] is None


def test_stream_of_keywords(spark, tmp_path):
    kind = "id string, text string, seq int, deleted boolean"
    first = [("d1", "alpha beta", 1, False), ("d2", "beta gamma gamma", 2, False), ("d3", "alpha", 3, False)]
    second = [("d1", "gamma only now", 4, False), ("d3", None, 5, True), ("d4", "alpha alpha", 6, False), ("d4", "beta at last", 7, False)]
    os.makedirs(f"{tmp_path}/in")
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    asked = spark.createDataFrame([(1, "alpha gamma")], "query_id int, query string")
    for rows, state in ((first, [r[:2] for r in first]), (second, [("d1", "gamma only now"), ("d2", "beta gamma gamma"), ("d4", "beta at last")])):
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        ingest.index_terms(stream, f"{tmp_path}/terms", f"{tmp_path}/log").awaitTermination()
        got = [(r["id"], r["rank"], round(r["score"], 9)) for r in ingest.search_terms(spark, f"{tmp_path}/terms", asked, 5).orderBy("rank").collect()]
        want = sparse.bm25(spark.createDataFrame(state, "id string, text string"), asked, 5).orderBy("rank").collect()
        assert got == [(r["id"], r["rank"], round(r["score"], 9)) for r in want] and got


def test_no_task_holds_all_documents_of_a_stream(spark, tmp_path):
    from quillspark.plans import api as catalog

    held = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    rows = spark.createDataFrame([(i, f"alpha beta{i % 7} gamma{i}") for i in range(400)], "doc_id bigint, text string")
    rows.repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 0) for i in range(0, 400, 9)], "doc_id bigint, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "alpha beta3")], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    at, shared = f"{tmp_path}/work", catalog.QUERIES["r70_stream_bm25"].__globals__["shared"]
    catalog.QUERIES["r70_stream_bm25"].__globals__["shared"] = lambda spark: at
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        assert catalog.QUERIES["r70_stream_bm25"](spark, str(tmp_path)).count() == 10
    finally:
        catalog.QUERIES["r70_stream_bm25"].__globals__["shared"] = shared
        spark.conf.set("spark.sql.files.maxPartitionBytes", held[0])
        spark.conf.set("spark.sql.files.openCostInBytes", held[1])
    each = spark.read.parquet(f"{at}/in").where("seq = 1").groupBy(F.input_file_name()).count().collect()
    assert sum(r["count"] for r in each) == 400 and max(r["count"] for r in each) < 200


def test_postings_are_written_by_the_tasks_that_read(spark, tmp_path, monkeypatch):
    docs = spark.createDataFrame([(i, None if i == 5 else f"alpha beta{i % 7} gamma{i}") for i in range(200)], "id bigint, text string").repartition(4).withColumn("text", F.col("text"))
    docs.write.parquet(f"{tmp_path}/docs")
    read = []
    monkeypatch.setattr(sparse, "corpus_stats", lambda *a: read.append(a))
    derived.write_postings(spark.read.parquet(f"{tmp_path}/docs"), f"{tmp_path}/at", parts=3)
    assert not read
    want = sparse._stats(sparse.lengths(docs)).first()
    got = spark.read.parquet(f"{tmp_path}/at/stats").first()
    assert (got["n"], round(got["avgdl"], 9), got["parts"]) == (200, round(want["avgdl"], 9), 3)
    # a folder's postings come from several tasks
    assert all(len([f for f in os.listdir(f"{tmp_path}/at/postings/part={p}") if f.endswith(".parquet")]) > 1 for p in range(3))
    asked = spark.createDataFrame([(1, "alpha beta3 gamma9")], "query_id int, query string")
    rows = lambda df: [(r["id"], r["rank"], round(r["score"], 9)) for r in df.orderBy("rank").collect()]
    assert rows(derived.search_postings(spark, f"{tmp_path}/at", asked, 8)) == rows(sparse.bm25(docs, asked, 8))
    derived.write_postings(docs.limit(0), f"{tmp_path}/none", parts=3)
    assert tuple(spark.read.parquet(f"{tmp_path}/none/stats").first()) == (0, 0.0, 3)


# Collections, models, command line


def test_json_export_is_one_object_over_many_lines(spark, tmp_path):
    rows = spark.createDataFrame([(f"i{i:03}", [float(i), -0.5], json.dumps({"a": "x,\n],"}) if i % 3 else None, i) for i in range(120)], "id string, vector array<float>, metadata string, timestamp bigint").repartition(3)
    for n in (120, 1, 0):
        path = f"{tmp_path}/{n}"
        some = rows.orderBy("id").limit(n)
        exchange.export_json(some, path)
        files = sorted(f for f in os.listdir(path) if f.endswith(".txt"))
        lines = [x for f in files for x in open(f"{path}/{f}")]
        assert len(lines) == n + 2
        whole = json.loads("".join(lines))
        assert [v["id"] for v in whole["vectors"]] == [f"i{i:03}" for i in range(n)] and whole["metadata"]["vectorCount"] == n and whole["version"] == exchange.VERSION
        back, envelope = exchange.read_export(spark, path)
        assert {tuple(map(str, r)) for r in back.collect()} == {tuple(map(str, r)) for r in some.collect()}
        assert envelope["metadata"]["vectorCount"] == n and "vectors" not in envelope
    # the same object on one line, and over other lines, is read too
    for name, text in (("one", json.dumps(json.loads("".join(lines)) | {"vectors": [{"id": "a", "vector": [1.0], "timestamp": 1}]})), ("laid", '{"version":"1.0.0","config":{},"vectors":[\n{"id":"a",\n"vector":[1.0],"timestamp":1}\n],"index":"","metadata":{}}')):
        os.makedirs(f"{tmp_path}/{name}")
        open(f"{tmp_path}/{name}/a.txt", "w").write(text)
        assert [r["id"] for r in exchange.read_export(spark, f"{tmp_path}/{name}")[0].collect()] == ["a"]


def test_counting_words_of_a_large_batch_takes_little_memory():
    import tracemalloc

    import pyarrow as pa

    from quillspark.functions.words import steps

    batch = pa.RecordBatch.from_pydict({"text": [" ".join(f"word{(i * j) % 977} the" for j in range(200)) for i in range(6000)]})
    tracemalloc.start()
    try:
        n = sum(int(Words(part.column(0)).counts()[2].sum()) for part in steps(iter([batch]), "text"))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert n == 1_200_000 and peak < 32e6


def test_chunks_of_long_texts_are_sent_on_in_slices(spark):
    import pyarrow as pa

    class Docs:
        schema = spark.range(1).schema

        def select(self, *columns):
            return self

        def mapInArrow(self, run, kind):
            raise StopIteration(run)

    with pytest.raises(StopIteration) as found:
        chunk.chunk_documents(Docs())
    batch = pa.RecordBatch.from_pydict({"id": pa.array(range(6), pa.int64()), "text": ["A sentence here. " * 150_000, None, "One. Two.", "", "B sentence. " * 200_000, "End."]})
    parts = list(found.value.args[0](iter([batch])))
    assert len(parts) > 1 and [i for p in parts for i in dict.fromkeys(p.column(0).to_pylist())] == [0, 2, 4, 5]


def test_rewrites_are_versions(spark, tmp_path):
    held = Collection(spark, f"file://{tmp_path}/c", 2)
    held.insert_batch([{"id": str(i), "vector": [float(i), 1.0]} for i in range(10)])
    before = held.rows()
    for i in range(4):
        held.delete(str(i))
    assert held.compact() and held.count() == 6
    # a reader that began before still has its table
    assert before.count() == 10
    # a writer that was lost on the way changes nothing
    os.makedirs(f"{tmp_path}/c/vectors-00000099")
    assert held.count() == 6
    held.compact(force=True)
    assert held.count() == 6 and not os.path.exists(f"{tmp_path}/c/log-00000000") and os.path.exists(f"{tmp_path}/c/vectors-00000001")
    held.insert({"id": "new", "vector": [0.0, 1.0]})
    assert held.count() == 7 and held.search(1, vector=[0.0, 1.0], include_vectors=True).first()["vector"] == [0.0, 1.0]


def test_the_base_is_not_shuffled(spark, tmp_path):
    held = Collection(spark, f"file://{tmp_path}/c", 2)
    held.insert_batch([{"id": str(i), "vector": [float(i), 1.0]} for i in range(20)])
    held.compact(force=True)
    held.insert({"id": "3", "vector": [9.0, 9.0]})
    held.delete("4")
    rows = {r["id"]: list(r["vector"]) for r in held.rows().collect()}
    assert len(rows) == 19 and rows["3"] == [9.0, 9.0] and "4" not in rows
    plan = held.rows()._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "LeftAnti" in plan and "SortMergeJoin" not in plan


def test_hits_go_to_their_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").withColumnRenamed("doc_id", "id")
    hits = spark.createDataFrame([(1, 3), (1, 5), (2, 3), (2, -1)], "query_id int, id bigint")
    out = search.hydrate(hits, docs, keep=["lang"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert out.count() == 3 and "BroadcastHashJoin" in plan and "ReadSchema: struct<doc_id:bigint,lang:string>" in plan


def test_a_cluster_needs_a_shared_folder(spark):
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(name, default=None):
                return default

    with pytest.raises(errors.EngineError, match="checkpoint"):
        session.shared_folder(Session())


def test_later_versions_warn(spark):
    rows = spark.createDataFrame([("a", [1.0])], "id string, vector array<float>")
    with pytest.warns(UserWarning, match="1.9"):
        exchange.validate(rows, {"version": "1.9.0"})
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        exchange.validate(rows, {"version": "1.0.3"})


def test_pools_images_and_models(spark, tmp_path):
    row = spark.createDataFrame([([1.0, 0.0, 3.0, 0.0, 2.0, 0.0],)], "s array<double>").select(embed.mean_pool(F.col("s"), 3, 2).alias("v")).first()
    assert row["v"] == [1.0, 0.0]
    (tmp_path / "a.png").write_bytes(bytes([255, 0, 0, 255]))
    (tmp_path / "b.txt").write_bytes(b"no image")
    found = embed.images(spark, f"file://{tmp_path}")
    assert found.count() == 1
    v = found.select(embed.byte_embedding(F.col("content"), 2).alias("v")).first()["v"]
    assert np.allclose(v, [0.5**0.5] * 2)

    class Both:
        dimensions = 2

        def embed(self, items):
            return [[float(len(x)), 1.0] for x in items]

    assert list(found.select(embed.model_udf(Both, 2, from_bytes=True)("content").alias("v")).first()["v"]) == [4.0, 1.0]
    assert list(spark.createDataFrame([("abc",)], "t string").select(embed.model_udf(Both, 2)("t").alias("v")).first()["v"]) == [3.0, 1.0]
    with pytest.raises(Exception, match="dimension"):
        found.select(embed.model_udf(Both, 3, from_bytes=True)("content")).collect()
    tiers = spark.createDataFrame([(16.0, 8, True), (16.0, 8, False), (2.0, 8, True)], "m double, c int, g boolean").select(tier_of(F.col("m"), F.col("c"), F.col("g")).alias("t"))
    assert [r["t"] for r in tiers.collect()] == ["high", "mid", "low"]


def test_commands(spark, tmp_path, monkeypatch, capsys):
    monkeypatch.setattr(cli.session, "create", lambda: spark)
    at = f"file://{tmp_path}/c"
    assert cli.main(["init", at, "--dimensions", "2"]) == 0
    assert cli.main(["init", at, "--dimensions", "2"]) == 1
    assert cli.main(["capabilities"]) == 0
    told = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert told["spark"] == spark.version and told["libraries"]["numpy"] and told["tier"] in ("low", "mid", "high")
    held = Collection(spark, at, 2)
    calls = [json.dumps({"tool": "insert_document", "params": {"text": "x", "id": "a", "vector": [1, 0]}}), "", "nonsense", json.dumps({"tool": "search_vectors", "params": {"vector": [1, 0], "k": 1}}), json.dumps({"tool": "none"})]
    out = [json.loads(x) for x in cli.serve(Tools(held), calls)]
    assert out[0] == {"result": "a"} and out[1]["error"] and out[2]["result"][0]["id"] == "a" and out[3]["error"]["code"] == "UNKNOWN_TOOL"


def test_vector_bench_knows_the_truth(spark):
    got = vector_bench.run(spark, "1k", (50,), dimensions=16)
    assert got[0]["recall"] == 1.0 and got[0]["hits"] == 500
    x = vector_bench.points(100, 8)
    assert vector_bench.truth(x, 2, 3)[0] == set(np.argsort(-(x @ x[0]))[:3].tolist())


def test_tools_over_http(spark, tmp_path):
    import threading
    import urllib.request

    held = Collection(spark, f"file://{tmp_path}/c", 2)
    held.clear()
    server = cli.http_server(Tools(held))
    threading.Thread(target=server.serve_forever, daemon=True).start()
    at = f"http://127.0.0.1:{server.server_port}/"
    try:
        with urllib.request.urlopen(at, timeout=20) as r:
            assert [t["name"] for t in json.load(r)] == Tools(held).names()
        call = json.dumps({"tool": "insert_document", "params": {"text": "x", "id": "a", "vector": [1, 0]}}).encode()
        with urllib.request.urlopen(at, data=call, timeout=60) as r:
            assert json.load(r) == {"result": "a"}
        with urllib.request.urlopen(at, data=b"{}", timeout=20) as r:
            assert "error" in json.load(r)
    finally:
        server.shutdown()
        server.server_close()


def test_outputs_of_models():
    assert embed.vectors_of([1.0, 2.0]) == [[1.0, 2.0]]
    assert embed.vectors_of([1.0, 2.0, 3.0, 4.0], 2) == [[1.0, 2.0], [3.0, 4.0]]
    assert embed.vectors_of([[[1.0, 3.0], [3.0, 5.0]]]) == [[2.0, 4.0]]
    assert embed.vectors_of({"data": [1, 2, 3, 4], "dims": [2, 2]}) == [[1.0, 2.0], [3.0, 4.0]]
    with pytest.raises(errors.DimensionMismatch):
        embed.vectors_of([[1.0, 2.0]], 3)


def test_hash_embedder_equals_the_column(spark):
    texts = ["", "abc", "Ünïcode ✓", "a" * 300]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(embed.hash_embedding(F.col("t"), 16).alias("v")).collect()
    assert np.allclose([r["v"] for r in rows], embed.HashEmbedder(16).embed(texts))
