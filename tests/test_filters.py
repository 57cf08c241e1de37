import pytest
from pyspark.sql import functions as F

from quillspark.functions.filters import Json, Typed, compile_filter, host_allowed, scoped

ROWS = [("filter-1", "document", 10, ["important", "urgent"]), ("filter-2", "image", 20, ["important"]), ("filter-3", "document", 15, ["urgent"])]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(ROWS, "id string, type string, score int, tags array<string>").cache()


def leaf(field, operator, value):
    return {"field": field, "operator": operator, "value": value}


def both(op, *filters):
    return {"operator": op, "filters": list(filters)}


CASES = [
    (leaf("type", "eq", "document"), {1, 3}), (leaf("type", "ne", "document"), {2}), (leaf("score", "gt", 10), {2, 3}), (leaf("score", "lte", 15), {1, 3}),
    (leaf("score", "gte", 15), {2, 3}), (leaf("score", "lt", 15), {1}), (leaf("type", "in", ["document", "video"]), {1, 3}), (leaf("type", "in", "document"), set()),
    (leaf("type", "in", []), set()), (leaf("tags", "contains", "urgent"), {1, 3}), (leaf("type", "contains", "docu"), {1, 3}), (leaf("score", "contains", 1), set()),
    (leaf("type", "eq", "nonexistent"), set()), (leaf("score", "eq", "10"), set()), (leaf("score", "gt", "12"), {2, 3}), (leaf("missing", "ne", 1), set()),
    (leaf("type", "like", "d"), set()), (both("and", leaf("type", "eq", "document"), leaf("score", "gte", 15)), {3}), (both("or", leaf("type", "eq", "image"), leaf("score", "eq", 10)), {1, 2}),
    (both("and", both("or", leaf("type", "eq", "document"), leaf("type", "eq", "image")), leaf("tags", "contains", "important")), {1, 2}), (both("and"), {1, 2, 3}), (both("or"), {1, 2, 3}), (None, {1, 2, 3}),
    (scoped(leaf("score", "gt", 10), "type", "document"), {3}),
]


@pytest.mark.parametrize("spec, want", CASES, ids=[str(i) for i in range(len(CASES))])
def test_typed_and_json_agree(rows, spec, want):
    typed = {int(r["id"][-1]) for r in rows.where(compile_filter(spec, Typed(rows.schema))).collect()}
    data = rows.select("id", F.to_json(F.struct("type", "score", "tags")).alias("m"))
    json = {int(r["id"][-1]) for r in data.where(compile_filter(spec, Json(F.col("m")))).collect()}
    assert (typed, json) == (want, want)


def test_json_null_missing_and_nested(spark):
    docs = spark.createDataFrame([(1, '{"a": null}'), (2, "{}"), (3, '{"a": {"b": true}}'), (4, "not json"), (5, None), (6, '{"a": {"b": "x"}}')], "id int, m string")

    def ids(spec):
        return {r["id"] for r in docs.where(compile_filter(spec, Json(F.col("m")))).collect()}

    assert ids(leaf("a", "ne", 5)) == {1, 3, 6}
    assert ids(leaf("a", "eq", None)) == {1}
    assert ids(leaf("a.b", "eq", True)) == {3}
    assert ids(leaf("a.b", "contains", "x")) == {6}
    # an or with a missing side isn't null
    assert ids(both("or", leaf("z", "eq", 1), leaf("a.b", "eq", "x"))) == {6}


def test_host_allow_list(spark):
    urls = spark.createDataFrame([("https://A.example/x",), ("https://b.example/",), ("/relative",), (None,), ("::",)], "u string")
    assert [r[0] for r in urls.select(host_allowed(F.col("u"), ["a.example"])).collect()] == [True, False, True, True, True]
