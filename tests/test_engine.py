import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark import errors
from quillspark.operators import evaluation, fusion, rag, search, sparse
from quillspark.sources import exchange
from quillspark.sources.collection import Collection
from quillspark.streaming import ingest
from quillspark.tools import Scope, Tools, check_params


class Letters:
    """Counts of letters: an embedder for tests."""

    dimensions = 26

    def embed(self, texts):
        return [[float(t.lower().count(chr(97 + i))) for i in range(26)] for t in texts]


def unit(n, d, seed=42):
    x = np.random.default_rng(seed).standard_normal((n, d))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@pytest.fixture
def held(spark, tmp_path):
    return Collection(spark, f"file://{tmp_path}/c", 26, embedder=Letters())


def test_smooth_vectors_find_themselves(spark):
    x = np.array([[np.sin(0.7 * i + j) + np.cos(0.3 * i) for j in range(8)] for i in range(200)])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id bigint, vector array<float>")
    top = search.top_k(rows, x[5], 5).collect()
    assert top[0]["id"] == 5 and top[0]["score"] > 0.999
    gone = spark.createDataFrame([(5,)], "id bigint")
    left = search.live(rows, gone)
    assert left.count() == 199 and 5 not in [r["id"] for r in search.top_k(left, x[5], 5).collect()]


@pytest.mark.parametrize("metric", ["cosine", "dot", "euclidean"])
def test_batch_search_is_exact(spark, metric):
    x = unit(300, 32)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(300, x[0].tolist()), (301, None)], "id bigint, vector array<float>")
    asked = rows.select(F.col("id").alias("query_id"), F.col("vector").alias("query_vector"))
    got = {}
    for r in search.batch_top_k(rows, asked, 5, metric, block=64).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["id"])
    y = np.vstack([x, x[:1]])
    s = y @ y.T if metric != "euclidean" else -np.linalg.norm(y[:, None] - y[None], axis=2)
    want = {i: sorted(range(301), key=lambda j, i=i: (-round(s[i, j], 6), j))[:5] for i in range(301)}
    assert len(got) == 301 and np.mean([len(set(got[i]) & set(want[i])) / 5 for i in want]) > 0.999
    assert got[0][:2] == [0, 300]


def test_cells_recall(spark):
    x = unit(600, 32)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id bigint, vector array<float>").cache()
    cells = search.train_cells(rows, 8).cache()
    placed = search.assign_cells(rows, cells).cache()
    want = {r["id"] for r in search.top_k(rows, x[3], 10).collect()}
    some = {r["id"] for r in search.cell_top_k(placed, cells, x[3], 10, 6).collect()}
    every = {r["id"] for r in search.cell_top_k(placed, cells, x[3], 10, 8).collect()}
    assert every == want and len(some & want) >= 7


def test_post_filter_can_miss(spark):
    rows = spark.createDataFrame([(i, [1.0, i / 100], i % 50) for i in range(200)], "id int, vector array<float>, kind int")
    hits = search.post_filtered(rows, [1.0, 0.0], 5, F.col("kind") == 49).count()
    assert hits < 5 == search.top_k(rows, [1.0, 0.0], 5, where=F.col("kind") > 1).count()


DOCS = [("d1", "The indemnification clause."), ("d2", "Payment is due in thirty days."), ("d3", "Indemnification, indemnification and indemnification again.")]


def test_bm25_and_fusion(spark):
    docs = spark.createDataFrame([*DOCS, ("d4", None), ("d5", "")], "id string, text string")
    asked = spark.createDataFrame([(1, "indemnification"), (2, "nothing here"), (3, ""), (4, None)], "query_id int, query string")
    got = [(r["query_id"], r["id"]) for r in sparse.bm25(docs, asked).orderBy("query_id", "rank").collect()]
    assert got == [(1, "d3"), (1, "d1")]
    a = spark.createDataFrame([(1, x, i + 1) for i, x in enumerate("abc")], "query_id int, id string, rank int")
    b = spark.createDataFrame([(1, x, i + 1) for i, x in enumerate("bda")], "query_id int, id string, rank int")
    fused = [r["id"] for r in fusion.reciprocal_rank_fusion(a, b).orderBy("rank").collect()]
    assert set(fused[:2]) == {"a", "b"} and set(fused[2:]) == {"c", "d"}
    alone = [r["id"] for r in fusion.reciprocal_rank_fusion(a, b.limit(0)).orderBy("rank").collect()]
    assert alone == ["a", "b", "c"]
    swapped = {r["id"]: r["score"] for r in fusion.reciprocal_rank_fusion(b, a, dense_weight=0.3, keyword_weight=0.7).collect()}
    assert swapped == {r["id"]: r["score"] for r in fusion.reciprocal_rank_fusion(a, b, dense_weight=0.7, keyword_weight=0.3).collect()}
    assert sparse.corpus_stats(docs.limit(0)).first()["avgdl"] == 0


def test_model_rerank_passes_failures_through(spark):
    hits = spark.createDataFrame([(1, "a", 1, "q", "x"), (1, "b", 2, "q", "xxx")], "query_id int, id string, rank int, query string, text string")

    def by_length():
        return lambda q, c: [float(len(x)) for x in c]

    def down():
        def fail(q, c):
            raise RuntimeError("no model")

        return fail

    def order(make):
        return [r["id"] for r in fusion.model_rerank(hits, make).orderBy("new_rank").collect()]

    assert order(by_length) == ["b", "a"] and order(down) == ["a", "b"]


def test_answers(spark):
    docs = spark.createDataFrame(DOCS, "id string, text string")
    asked = spark.createDataFrame([(1, "When is payment due?"), (2, "zebra")], "query_id int, query string")
    got = rag.answer(docs, asked, profile=rag.Profile(top_k=2, rerank=True))
    assert "thirty days" in got[0].answer and got[0].citations[0]["id"] == "d2" and got[1].citations == []
    kinds = [k for k, _ in rag.answer_stream(docs, "When is payment due?")]
    assert kinds[0] == "retrieval" and kinds[-1] == "complete" and "generation" in kinds


def test_evaluation_counts_a_short_list_as_a_miss(spark):
    ranked = spark.createDataFrame([(1, "x", 1), (2, "a", 1), (2, "b", 2)], "query_id int, id string, rank int")
    expected = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "query_id int, expected_id string")
    r = evaluation.expected_ranks(ranked, expected, 3).first()
    assert (r["queries"], round(r["recall"], 4), round(r["mean_rank"], 4)) == (3, 0.3333, 1.6667)


def test_collection_life(held):
    ids = held.insert_batch([{"text": "abc", "metadata": {"category": "a/b"}}, {"text": "xyz", "metadata": {"category": "tech"}}, {"vector": [1.0] * 26}])
    assert len(set(ids)) == 3 and held.insert_batch([]) == [] and held.count() == 3
    hit = held.search(2, text="cab").collect()
    assert hit[0]["id"] == ids[0] and hit[0]["score"] > 0.99 and json.loads(hit[0]["metadata"])["content"] == "abc"
    # stored strings are escaped, values asked for are not
    assert held.filter({"field": "category", "operator": "eq", "value": "a&#x2F;b"}).count() == 1
    assert held.search(5, text="abc", filter={"field": "category", "operator": "eq", "value": "tech"}).count() == 1
    assert held.update(ids[0], {"metadata": {"more": 1}}) and not held.update("none", {})
    assert json.loads(held.get(ids[0])["metadata"]) | {"timestamp": 0} == {"category": "a&#x2F;b", "more": 1, "content": "abc", "timestamp": 0}
    assert [r["id"] for r in held.get_batch([ids[1], "none", ids[0], ids[1]]).collect()] == [ids[1], ids[0], ids[1]]
    assert held.delete(ids[1]) and not held.delete(ids[1]) and held.get(ids[1]) is None and held.count() == 2
    assert [r["id"] for r in held.stream()] == sorted([ids[0], ids[2]])
    assert held.compact() and held.count() == 2 and not held.compact()
    assert held.stats().first()["dimensions"] == 26
    for bad in ({}, {"vector": [1.0]}):
        with pytest.raises(errors.EngineError):
            held.insert(bad)
    held.clear()
    assert held.count() == 0
    held.destroy()
    assert held.count() == 0


@pytest.mark.parametrize("form", ["ndjson", "json"])
def test_export_and_import(spark, held, tmp_path, form):
    held.insert_batch([{"text": f"text {i} {'abcde'[i % 5]}", "metadata": {"title": "Test", "tags": ["x", "y"], "nested": {"key": i}}} for i in range(50)])
    path = f"file://{tmp_path}/out"
    if form == "json":
        exchange.export_json(held.rows(), path)
    else:
        exchange.export_ndjson(held.rows(), path, chunk=20)
        kinds = [json.loads(r["value"])["type"] for r in spark.read.text(path).collect()]
        assert kinds.count("vectors") == 3 and kinds.count("metadata") == kinds.count("index") == 1
    rows, envelope = exchange.read_export(spark, path)
    assert envelope["metadata"]["vectorCount"] == 50
    other = Collection(spark, f"file://{tmp_path}/d", 26)
    assert exchange.import_into(other, path) == 50
    want = {r["id"]: (list(r["vector"]), json.loads(r["metadata"])) for r in held.rows().collect()}
    assert {r["id"]: (list(r["vector"]), json.loads(r["metadata"])) for r in other.rows().collect()} == want
    exchange.import_into(other, path, clear=False)
    assert other.count() == 50
    with pytest.raises(errors.ImportFailed):
        exchange.validate(rows, envelope | {"version": "2.0.0"})
    with pytest.raises(errors.ImportFailed):
        exchange.validate(rows, envelope, 3)
    with pytest.raises(errors.ImportFailed):
        exchange.validate(rows, envelope | {"metadata": {"vectorCount": 49}})


def test_stream_into_a_collection(spark, held, tmp_path):
    rows = [(str(i % 20), [float(i)] * 26, "{}", i, i, i >= 90) for i in range(100)]
    kind = "id string, vector array<float>, metadata string, timestamp bigint, seq bigint, deleted boolean"
    spark.createDataFrame(rows, kind).repartitionByRange(5, "seq").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 2).parquet(f"{tmp_path}/in")
    listener = ingest.Progress()
    spark.streams.addListener(listener)
    ingest.ingest(stream, held, f"{tmp_path}/log").awaitTermination()
    spark.streams.removeListener(listener)
    got = {r["id"]: r["timestamp"] for r in held.rows().collect()}
    assert got == {str(i): 80 + i for i in range(10)}


def test_tools(held):
    scope = Scope("team", "red")
    tools = Tools(held, scope)
    assert tools.names() == ["search_vectors", "insert_document", "delete_document", "rag_query"]
    mine = tools.execute("insert_document", {"text": "payment is due in thirty days", "metadata": {"team": "blue"}, "id": "m1"})
    theirs = held.insert({"text": "payment of others", "metadata": {"team": "blue"}})
    assert mine == "m1" and [r["id"] for r in tools.execute("search_vectors", {"query": "payment"})] == ["m1"]
    assert not tools.execute("delete_document", {"id": theirs})
    assert "thirty days" in tools.execute("rag_query", {"query": "when is payment due"})["answer"]
    assert tools.execute("delete_document", {"id": "m1"})
    for name, params in (("search_vectors", {"k": 101}), ("search_vectors", {"k": "5"}), ("delete_document", {}), ("rag_query", {"query": 3}), ("nothing", {})):
        with pytest.raises(errors.EngineError):
            tools.execute(name, params)
    check_params({"a": None, "b": 1}, {"properties": {"a": {"type": "string"}}})
    with pytest.raises(errors.InvalidParams):
        check_params({"b": 1}, {"properties": {}, "additionalProperties": False})
    with pytest.raises(errors.InvalidParams):
        check_params({"a": "z"}, {"properties": {"a": {"type": "string", "enum": ["x"]}}})


def test_stored_indexes_open_few_folders(spark, tmp_path):
    from quillspark.sources import derived

    x = unit(200, 16)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id bigint, vector array<float>")
    cells = search.train_cells(rows, 8)
    derived.write_cells(rows, cells, f"{tmp_path}/v")
    found = derived.search_cells(spark, f"{tmp_path}/v", x[3].tolist(), 5, 8)
    assert [r["id"] for r in found.collect()] == [r["id"] for r in search.top_k(rows, x[3], 5).collect()]
    plan = derived.search_cells(spark, f"{tmp_path}/v", x[3].tolist(), 5, 2)._jdf.queryExecution().toString()
    assert "PartitionFilters: [cell" in plan.replace("isnotnull(cell#", "cell#")
    docs = spark.createDataFrame(DOCS, "id string, text string")
    derived.write_postings(docs, f"{tmp_path}/p", parts=16)
    asked = spark.createDataFrame([(1, "indemnification")], "query_id int, query string")
    got = derived.search_postings(spark, f"{tmp_path}/p", asked, 5)
    assert [(r["id"], r["rank"]) for r in got.orderBy("rank").collect()] == [("d3", 1), ("d1", 2)]
    assert "PartitionFilters: [part" in got._jdf.queryExecution().toString().replace("isnotnull(part#", "part#")


def test_profile_and_latest(spark):
    from quillspark.session import Latest

    p = rag.Profile.from_json('{"top_k": 3, "hybrid": false, "scope": ["team", "red"]}')
    assert p.top_k == 3 and not p.hybrid and p.scope == ("team", "red")
    with pytest.raises(TypeError):
        rag.Profile.from_json('{"other": 1}')
    latest = Latest(spark)
    assert latest.run(lambda: spark.range(5).count()) == 5 and latest.run(lambda: spark.range(6).count()) == 6


def test_growing_frequencies(spark, tmp_path):
    spark.createDataFrame(DOCS, "id string, text string").repartition(3).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("id string, text string").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = ingest.term_counts(stream).writeStream.outputMode("complete").format("memory").queryName("df").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {r["term"]: r["df"] for r in spark.table("df").collect()}["indemnification"] == 2
