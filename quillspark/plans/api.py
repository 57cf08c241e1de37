"""Registered queries of the library's interface: collections, tools, profiles, answers, checks; each with its SQL."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark import errors, models
from quillspark.functions import embed, quant
from quillspark.functions import text as T
from quillspark.functions.text import parse_sizes
from quillspark.operators import fusion, rag, search
from quillspark.plans.catalog import COS, ORACLE_SQL, Q0, QUERIES, RRF, _bag_sql, _bm25_sql, first_vector, questions, r6, register, shared, table, vectors
from quillspark.sources import exchange
from quillspark.sources.collection import Collection
from quillspark.tools import Scope, Tools, check_params


__all__ = ["ORACLE_SQL", "QUERIES"]


def collection(spark: SparkSession, sf_dir: str, embedder=None) -> Collection:
    """The embeddings as a collection in a new folder: ids as text, the label as metadata."""
    held = Collection(spark, shared(spark), 64, embedder=embedder)
    held.append(vectors(spark, sf_dir).select(F.col("id").cast("string").alias("id"), "vector", F.to_json(F.struct("label")).alias("metadata"), F.lit(1).alias("timestamp")))
    return held


def total():
    return F.round(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double")), 4)


@register("r71_collection_life", "select vec_id::varchar id, case when vec_id % 7 = 0 then label + 100 else label end as label, round(list_sum(embedding::double[]), 4) total from embeddings where vec_id % 11 <> 0 and (case when vec_id % 7 = 0 then label + 100 else label end) >= 2")
def collection_life(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Put, put again, delete, compact, filter."""
    held = collection(spark, sf_dir)
    rows = vectors(spark, sf_dir).select(F.col("id").cast("string").alias("id"), "vector", "label", F.col("id").alias("n"))
    held.append(rows.where("n % 7 = 0").select("id", "vector", F.to_json(F.struct((F.col("label") + 100).alias("label"))).alias("metadata"), F.lit(2).alias("timestamp")))
    held.append(rows.where("n % 11 = 0").select("id", F.lit(None).cast("array<float>").alias("vector"), F.lit(3).alias("timestamp"), F.lit(True).alias("deleted")))
    held.compact(force=True)
    found = held.filter({"field": "label", "operator": "gte", "value": 2})
    return found.select("id", F.get_json_object("metadata", "$.label").cast("int").alias("label"), total().alias("total"))


@register("r72_collection_counts", "select count(*) stored, count(*) - 2 after_delete, 3 asked_again, 2 in_order, 0 after_clear from embeddings")
def collection_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Count, get, delete by id, get several, clear."""
    held = collection(spark, sf_dir)
    stored = held.count()
    gone = [held.delete("0"), held.delete("1"), held.delete("no such id")]
    left = held.count()
    again = [r["id"] for r in held.get_batch(["3", "0", "2", "3"]).collect()]
    found = held.get("2") is not None and held.get("1") is None
    held.clear()
    row = (stored, left, len(again) if gone == [True, True, False] and found else -1, 2 if again[:2] == ["3", "2"] else -1, held.count())
    return spark.createDataFrame([row], "stored bigint, after_delete bigint, asked_again int, in_order int, after_clear bigint")


@register("r73_json_import", "select vec_id::varchar id, label, round(list_sum(embedding::double[]), 4) total from embeddings")
def json_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A collection out as one JSON object, checked, and into another one twice: an id is there once."""
    held, other, path = collection(spark, sf_dir), Collection(spark, shared(spark), 64), shared(spark)
    exchange.export_json(held.rows(), path)
    exchange.import_into(other, path)
    exchange.import_into(other, path, clear=False)
    return other.rows().select("id", F.get_json_object("metadata", "$.label").cast("int").alias("label"), total().alias("total"))


@register("r74_update_metadata", "select vec_id::varchar id, label, vec_id = 5 as marked from embeddings where vec_id < 10")
def update_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata merges on update; keys that are there stay."""
    held = collection(spark, sf_dir)
    held.update("5", {"metadata": {"marked": True}})
    rows = held.rows().where(F.col("id").cast("int") < 10)
    return rows.select("id", F.get_json_object("metadata", "$.label").cast("int").alias("label"), F.coalesce(F.get_json_object("metadata", "$.marked") == "true", F.lit(False)).alias("marked"))


_HASHED = "list_transform(range(0, 64), lambda i: sin((case when {0} >= 2147483648 then {0} - 4294967296 else {0} end + i)::double) * 0.5)"
_CODE = "list_reduce(list_prepend(0::bigint, list_transform(string_split({}, ''), lambda c: unicode(c)::bigint)), lambda h, c: (h * 31 + c) % 4294967296)"


@register("r75_text_search", f"with h as (select item_id, {_CODE.format('text')} u from benchmark), v as (select item_id, {_HASHED.format('u')}::float[] e from h), q as (select e::double[] e from v where item_id = (select min(item_id) from benchmark)) select v.item_id::varchar id, round(list_cosine_similarity(v.e::double[], q.e), 4) score from v, q order by list_cosine_similarity(v.e::double[], q.e) desc, v.item_id limit 3")
def text_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts stored with their hash vectors, and one of them asked for as text."""
    rows = table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("id"), "text", "item_id")
    held = Collection(spark, shared(spark), 64, embedder=embed.HashEmbedder(64))
    held.append(rows.select("id", embed.hash_embedding(F.col("text"), 64).cast("array<float>").alias("vector"), F.to_json(F.struct(F.col("text").alias("content"))).alias("metadata")))
    first = rows.select(F.min_by("text", "item_id")).first()[0]
    return held.search(3, text=first).select("id", F.round("score", 4).alias("score"))


@register("r76_model_rerank", f"with {_bm25_sql(k=8)}, m as (select br.*, length(substr(d.text, 1, 512)) % 17 s from br join documents d on d.doc_id = br.id) select query_id, id, row_number() over (partition by query_id order by s desc, rank) new_rank from m")
def model_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model of text pairs ranks again; here one that only measures."""
    from quillspark.operators import sparse

    docs, asked = table(spark, sf_dir, "documents"), questions(spark, sf_dir)
    hits = search.hydrate(sparse.bm25(docs, asked, 8, "doc_id"), docs.withColumnRenamed("doc_id", "id"), keep=["text"]).join(asked, "query_id")

    def make():
        return lambda q, c: [float(len(x) % 17) for x in c]

    return fusion.model_rerank(hits, make).select("query_id", "id", F.col("new_rank").cast("bigint").alias("new_rank"))


_BUDGET = "substr(context, 1, 400)"
_STOP = f"greatest(case when instr(reverse({_BUDGET}), '.') > 0 then 400 - instr(reverse({_BUDGET}), '.') else -1 end, case when instr(reverse({_BUDGET}), chr(10)) > 0 then 400 - instr(reverse({_BUDGET}), chr(10)) else -1 end)"
#: What the model is asked with a budget of 100 tokens for its passages.
PROMPTED = f"""{_bm25_sql(k=12)}, {_bag_sql(k=12)}, {RRF},
    c as (select b.item_id query_id, b.text question, coalesce(string_agg('[' || fr.rank || '] ' || d.text, chr(10) || chr(10) order by fr.rank), '{T.NOTHING_FOUND}') context from benchmark b left join fr on fr.query_id = b.item_id and fr.rank <= 3 left join documents d on d.doc_id = fr.id group by all),
    k as (select query_id, question, case when length(context) <= 400 then context when {_STOP} > 320 then substr(context, 1, ({_STOP} + 1)::bigint) else {_BUDGET} || '...' end context from c),
    a as (select query_id, 'S|' || context || '|' || question prompt, ceil(length(context) / 4)::bigint context_tokens from k)"""
PROFILE = json.dumps({"top_k": 3, "system": "S", "template": "{system}|{context}|{question}", "max_context_tokens": 100})


@register("r77_context_budget", f"with {PROMPTED} select query_id, md5(prompt) digest, context_tokens from a")
def context_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts of a profile from JSON whose passages are cut to a hundred tokens."""
    profile = rag.Profile.from_json(PROFILE)
    asked = questions(spark, sf_dir)
    hits = rag.retrieve(table(spark, sf_dir, "documents"), asked, profile, id_col="doc_id")
    return rag.prompts(hits, asked, profile).select("query_id", F.md5("prompt").alias("digest"), "context_tokens")


class _Down:
    def is_available(self) -> bool:
        return False


class _Broken:
    def is_available(self) -> bool:
        return True

    def generate(self, prompt: str, **options) -> str:
        raise RuntimeError("no answer today")


class _Digest:
    def is_available(self) -> bool:
        return True

    def generate(self, prompt: str, **options) -> str:
        from hashlib import md5

        return md5(prompt.encode()).hexdigest()


@register("r78_answers", f"with {PROMPTED} select query_id, md5(prompt) answer, context_tokens, (select count(*) from fr where fr.query_id = a.query_id and fr.rank <= 3) citations from a")
def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of the first model that is there and doesn't fail, with their citations."""
    got = rag.answers(table(spark, sf_dir, "documents"), questions(spark, sf_dir), lambda: rag.Cascade([_Down(), _Broken(), _Digest()]), rag.Profile.from_json(PROFILE), id_col="doc_id")
    return got.select("query_id", "answer", "context_tokens", F.greatest(F.size("citations"), F.lit(0)).cast("bigint").alias("citations"))


@register("r79_quant_formats", "select vec_id, f.format as format, round(list_sum(embedding::double[]), 4) total, 0 scales from embeddings, (values ('fp32', 'fp32'), ('fp16', 'fp16'), ('other', 'fp32')) f(asked, format)")
def quant_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formats that only carry a name, and one that nobody knows."""
    parts = [vectors(spark, sf_dir).select(F.col("id").alias("vec_id"), quant.quantise(F.col("vector"), form).alias("q")).select("vec_id", F.col("q.format").alias("format"), quant.dequantise(F.col("q"), form).alias("vector"), F.size("q.scales").alias("scales")) for form in ("fp32", "fp16", "other")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).select("vec_id", "format", total().alias("total"), "scales")


@register("r80_model_choice", "with m as (select p_name id, p_brand provider, p_retailprice size_gb, case when p_size < 15 then 'low' when p_size < 35 then 'mid' else 'high' end tier, p_size % 3 = 0 needs_gpu from part) (select 'cpu' device, id from m where tier <> 'high' and not needs_gpu order by size_gb, id limit 1) union all (select 'gpu' device, id from m order by (provider = (select min(p_brand) from part)) desc, size_gb, id limit 1)")
def model_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The smallest model that a device runs, one of the GPU's provider first; parts stand in for models."""
    rows = table(spark, sf_dir, "part").select(F.col("p_name").alias("id"), F.col("p_brand").alias("provider"), F.col("p_retailprice").alias("size_gb"), F.when(F.col("p_size") < 15, "low").when(F.col("p_size") < 35, "mid").otherwise("high").alias("tier"), (F.col("p_size") % 3 == 0).alias("needs_gpu"))
    own = rows.agg(F.min("provider")).first()[0]
    cpu = models.recommend(rows, models.Device("mid", False), "nobody's").select(F.lit("cpu").alias("device"), "id")
    return cpu.unionByName(models.recommend(rows, models.Device("high", True), own).select(F.lit("gpu").alias("device"), "id"))


@register("r81_tools_search", Q0.format(COS) + " select vec_id::varchar id, round(score, 6) score from s where label = 2 order by s.score desc, vec_id::varchar limit 4")
def tools_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tool's answer to a caller that is held to one label and asks for another one besides."""
    tools = Tools(collection(spark, sf_dir), Scope("label", 2))
    found = tools.execute("search_vectors", {"vector": first_vector(spark, sf_dir), "k": 4, "filter": {"operator": "or", "filters": [{"field": "label", "operator": "eq", "value": 2}, {"field": "label", "operator": "eq", "value": 3}]}})
    return spark.createDataFrame([(r["id"], float(r["score"])) for r in found], "id string, score double").select("id", r6("score"))


@register("r82_scoped_writes", "select 'kept' id, 'red' team union all select 'mine' id, 'red' team")
def scoped_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes and deletes of a caller who is held to one team."""
    held = Collection(spark, shared(spark), 8, embedder=embed.HashEmbedder(8))
    held.insert({"id": "theirs", "text": "of others", "metadata": {"team": "blue"}})
    tools = Tools(held, Scope("team", "red"))
    for id_ in ("mine", "kept", "gone"):
        tools.execute("insert_document", {"id": id_, "text": f"text {id_}", "metadata": {"team": "blue"}})
    tools.execute("delete_document", {"id": "gone"})
    tools.execute("delete_document", {"id": "theirs"})
    return held.filter({"field": "team", "operator": "eq", "value": "red"}).select("id", F.get_json_object("metadata", "$.team").alias("team"))


@register("r83_allowed_top_k", Q0.format(COS) + " select vec_id, round(score, 6) score from s where vec_id in (select user_id from events where value > 50) order by s.score desc, vec_id limit 10")
def allowed_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    allowed = table(spark, sf_dir, "events").where("value > 50").select(F.col("user_id").alias("id"))
    return search.allowed_top_k(vectors(spark, sf_dir), allowed, first_vector(spark, sf_dir), 10).select(F.col("id").alias("vec_id"), r6("score"))


@register("r84_distinct_hits", f"with {_bm25_sql(k=10)}, {_bag_sql(k=10)}, b as (select query_id, id, max(round(score, 6)) score from (select query_id, id, score from br union all select query_id, id, score from gr) group by all) select query_id, id, score, row_number() over (partition by query_id order by score desc, id) rank from b")
def distinct_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspark.operators import sparse

    found = sparse.profiles(table(spark, sf_dir, "documents"), questions(spark, sf_dir), "doc_id")
    both = sparse.bm25_of(found, 10).unionByName(sparse.bag_cosine_of(found, 10)).withColumn("score", F.round("score", 6))
    return search.distinct_hits(both).select("query_id", "id", "score", F.col("rank").cast("bigint").alias("rank"))


@register("r85_record_codec", "select case when vec_id % 5 = 3 then null else vec_id::varchar end id, case when vec_id % 5 = 4 then 0 else 64 end dimensions, case when vec_id % 5 = 3 then 'no id' when vec_id % 5 = 4 then 'no vector' when vec_id % 5 = 2 then 'no timestamp' end error, round(case when vec_id % 5 = 4 then 0 else list_sum(embedding::double[]) end, 3) total from embeddings")
def record_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored records with vectors of both forms, some of which lack something."""
    n = F.col("id") % 5
    numbered = F.map_from_entries(F.transform("vector", lambda x, i: F.struct(i.cast("string").alias("key"), x.alias("value"))))
    json_ = F.when(n == 1, F.to_json(F.struct(F.col("id").cast("string").alias("id"), numbered.alias("vector"), F.struct("label").alias("metadata"), F.lit(5).alias("timestamp"))))
    for k, fields in ((3, ("vector", "metadata", "timestamp")), (4, ("id", "metadata", "timestamp")), (2, ("id", "vector", "metadata"))):
        have = {"id": F.col("id").cast("string").alias("id"), "vector": F.col("vector"), "metadata": F.struct("label").alias("metadata"), "timestamp": F.lit(5).alias("timestamp")}
        json_ = json_.when(n == k, F.to_json(F.struct(*(have[f] for f in fields))))
    json_ = json_.otherwise(F.to_json(F.struct(F.col("id").cast("string").alias("id"), "vector", F.struct("label").alias("metadata"), F.lit(5).alias("timestamp"))))
    rows = exchange.decode_records(vectors(spark, sf_dir).select(json_.alias("value")))
    sums = F.coalesce(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double")), F.lit(0.0))
    return rows.select("id", F.greatest(F.size("vector"), F.lit(0)).alias("dimensions"), "error", F.round(sums, 3).alias("total"))


def _code(action) -> str:
    try:
        action()
    except errors.EngineError as e:
        return e.code
    return "none"


@register("r86_checks", "select * from (values ('k of 0', 'INVALID_PARAMS'), ('k of 10001', 'INVALID_PARAMS'), ('k of 2.5', 'INVALID_PARAMS'), ('k of 7', 'none'), ('short vector', 'DIMENSION_MISMATCH'), ('endless vector', 'INVALID_VECTOR'), ('text for a vector', 'INVALID_VECTOR'), ('item of nothing', 'INVALID_PARAMS'), ('embedder of another size', 'DIMENSION_MISMATCH'), ('model of another size', 'DIMENSION_MISMATCH'), ('unknown model', 'none'), ('version 2', 'IMPORT_ERROR'), ('wrong count', 'IMPORT_ERROR'), ('missing parameter', 'INVALID_PARAMS'), ('parameter of a wrong type', 'INVALID_PARAMS'), ('parameter out of range', 'INVALID_PARAMS'), ('null parameter', 'none'), ('unknown tool', 'UNKNOWN_TOOL'), ('no model answers', 'NO_PROVIDER'), ('third try', 'none'), ('function in metadata', 'INVALID_PARAMS')) t(name, code)")
def checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is refused, and with which code."""
    held = Collection(spark, shared(spark), 3)
    tools, known = Tools(held), models.Registry([("m", 384, 30, "low")])
    one = spark.createDataFrame([("a", [1.0, 0.0, 0.0])], "id string, vector array<float>")
    tries: list[int] = []

    def third() -> None:
        tries.append(1)
        if len(tries) < 3:
            raise RuntimeError("not yet")

    number = {"properties": {"n": {"type": "number", "maximum": 5}}, "required": ["n"]}
    cases = {
        "k of 0": lambda: errors.check_k(0), "k of 10001": lambda: errors.check_k(10001), "k of 2.5": lambda: errors.check_k(2.5), "k of 7": lambda: errors.check_k(7),
        "short vector": lambda: errors.check_vector([1.0], 3), "endless vector": lambda: errors.check_vector([1.0, float("inf"), 0.0], 3), "text for a vector": lambda: errors.check_vector("abc", 3), "item of nothing": lambda: held.insert({}),
        "embedder of another size": lambda: Collection(spark, "file:/nowhere", 3, embedder=embed.HashEmbedder(4)), "model of another size": lambda: known.check_dimensions("m", 3), "unknown model": lambda: known.check_dimensions("x", 3),
        "version 2": lambda: exchange.validate(one, {"version": "2.0.0"}), "wrong count": lambda: exchange.validate(one, {"version": "1.0.0", "metadata": {"vectorCount": 2}}),
        "missing parameter": lambda: check_params({}, number), "parameter of a wrong type": lambda: check_params({"n": "1"}, number), "parameter out of range": lambda: check_params({"n": 6}, number), "null parameter": lambda: check_params({"n": None}, number),
        "unknown tool": lambda: tools.execute("none", {}), "no model answers": lambda: rag.Cascade([_Down(), _Broken()]).generate("x"), "third try": lambda: errors.with_retry(third, sleep=lambda s: None), "function in metadata": lambda: errors.sanitise({"f": print}),
    }
    return spark.createDataFrame([(name, _code(f)) for name, f in cases.items()], "name string, code string")


@register("r87_size_parse", "select * from (values ('1k,10k', 0, 1000), ('1k,10k', 1, 10000), ('0.5k, 2m,7', 0, 500), ('0.5k, 2m,7', 1, 2000000), ('0.5k, 2m,7', 2, 7)) t(spec, pos, size)")
def size_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(spec, i, n) for spec in ("1k,10k", "0.5k, 2m,7") for i, n in enumerate(parse_sizes(spec))], "spec string, pos int, size int")


@register("r88_with_vectors", Q0.format(COS) + " select vec_id, round(score, 6) score, round(list_sum(embedding::double[]), 4) total from s order by s.score desc, vec_id limit 10")
def with_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = search.top_k(vectors(spark, sf_dir), first_vector(spark, sf_dir), 10, include_vectors=True)
    return hits.select(F.col("id").alias("vec_id"), r6("score"), total().alias("total"))


@register("r89_stream_pull", "select vec_id::varchar id, row_number() over (order by vec_id::varchar) - 1 pos from embeddings where label = 0")
def stream_pull(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A collection of one label, read row by row by a caller who pulls."""
    held = Collection(spark, shared(spark), 64)
    held.append(vectors(spark, sf_dir).where("label = 0").select(F.col("id").cast("string").alias("id"), "vector"))
    return spark.createDataFrame([(r["id"], i) for i, r in enumerate(held.stream())], "id string, pos bigint")
