"""Every registered query of the retrieval operators, with the SQL that checks it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.functions import embed, quant
from quillspark.functions import text as T
from quillspark.functions import vectors as V
from quillspark.functions.filters import Json, Typed, condition, host_allowed, scoped
from quillspark.operators import chunk, evaluation, fusion, graph, rag, search, sparse
from quillspark.plans import known
from quillspark.session import shared_folder
from quillspark.sources import derived, exchange
from quillspark.sources.collection import get_batch
from quillspark.streaming import ingest

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared(spark: SparkSession) -> str:
    """A new folder below the one that all executors share."""
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").withColumnsRenamed({"vec_id": "id", "embedding": "vector"})


def first_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    """The vector that single searches ask for: that of the least id."""
    rows = vectors(spark, sf_dir)
    return [float(x) for x in rows.select(F.min_by("vector", "id")).first()[0]]


def r6(column: str):
    return F.round(column, 6).alias(column)


Q0 = "with q as (select arg_min(embedding, vec_id)::double[] v from embeddings), s as (select vec_id, label, embedding, {} as score from embeddings, q)"
COS = "coalesce(list_cosine_similarity(embedding::double[], q.v), 0)"
DOT = "list_inner_product(embedding::double[], q.v)"
EUC = "1 / (1 + list_distance(embedding::double[], q.v))"


def _top(metric: str, k: int = 10):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        hits = search.top_k(vectors(spark, sf_dir), first_vector(spark, sf_dir), k, metric)
        return hits.select(F.col("id").alias("vec_id"), r6("score"))

    return run


for _name, _metric, _sql in (("r01_vec_topk_cosine", "cosine", COS), ("r02_vec_topk_dot", "dot", DOT), ("r03_vec_topk_euclid", "euclidean", EUC)):
    register(_name, Q0.format(_sql) + " select vec_id, round(score, 6) score from s order by s.score desc, vec_id limit 10")(_top(_metric))


@register("r04_vec_topk_filtered", Q0.format(COS) + " select vec_id, round(score, 6) score from s where label = 3 order by s.score desc, vec_id limit 10")
def vec_topk_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors(spark, sf_dir)
    where = condition({"field": "label", "operator": "eq", "value": 3}, Typed(rows.schema))
    return search.top_k(rows, first_vector(spark, sf_dir), 10, where=where).select(F.col("id").alias("vec_id"), r6("score"))


@register("r05_vec_postfilter", Q0.format(COS) + ", n as (select * from s order by score desc, vec_id limit 50) select vec_id, round(score, 6) score from n where label = 3 order by n.score desc, vec_id limit 10")
def vec_postfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = search.post_filtered(vectors(spark, sf_dir), first_vector(spark, sf_dir), 10, F.coalesce(F.col("label") == 3, F.lit(False)))
    return hits.select(F.col("id").alias("vec_id"), r6("score"))


ALL_PAIRS = "p as (select a.vec_id query_id, b.vec_id id, b.label, round(coalesce(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 0), 9) score from embeddings a, embeddings b), r as (select *, row_number() over (partition by query_id order by score desc, id) rank from p)"


@register("r06_vec_batch_knn", f"with {ALL_PAIRS} select query_id, id, rank, round(score, 6) score from r where rank <= 10")
def vec_batch_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors(spark, sf_dir)
    asked = rows.select(F.col("id").alias("query_id"), F.col("vector").alias("query_vector"))
    return search.batch_top_k(rows, asked, 10).select("query_id", "id", F.col("rank").cast("bigint").alias("rank"), r6("score"))


def _batch(metric: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = vectors(spark, sf_dir)
        asked = rows.select(F.col("id").alias("query_id"), F.col("vector").alias("query_vector"))
        return search.batch_top_k(rows, asked, 10, metric).select("query_id", "id", F.col("rank").cast("bigint").alias("rank"), r6("score"))

    return run


for _name, _metric, _sql in (("r06b_vec_batch_euclid", "euclidean", "1 / (1 + list_distance(a.embedding::double[], b.embedding::double[]))"), ("r06c_vec_batch_dot", "dot", "list_inner_product(a.embedding::double[], b.embedding::double[])")):
    register(_name, f"with p as (select a.vec_id query_id, b.vec_id id, round({_sql}, 9) score from embeddings a, embeddings b), r as (select *, row_number() over (partition by query_id order by score desc, id) rank from p) select query_id, id, rank, round(score, 6) score from r where rank <= 10")(_batch(_metric))


@register("r07_vec_normalise", "select vec_id, len(embedding) = 64 and len(list_filter(embedding, lambda x: not isfinite(x))) = 0 valid, round(list_sum(list_transform(embedding::double[], lambda x: x / sqrt(list_inner_product(embedding::double[], embedding::double[])))), 6) total from embeddings")
def vec_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    unit = V.normalise(F.col("vector"))
    total = F.aggregate(unit, F.lit(0.0), lambda s, x: s + x)
    return vectors(spark, sf_dir).select(F.col("id").alias("vec_id"), V.is_valid(F.col("vector"), 64).alias("valid"), F.round(total, 6).alias("total"))


@register("r08_vec_tombstones", Q0.format(COS) + " select vec_id, round(score, 6) score from s where vec_id not in (select vec_id from embeddings where label = 4) order by s.score desc, vec_id limit 10")
def vec_tombstones(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors(spark, sf_dir)
    return search.top_k(search.live(rows, rows.where("label = 4")), first_vector(spark, sf_dir), 10).select(F.col("id").alias("vec_id"), r6("score"))


@register("r09_upsert_latest", "select user_id, event_id, event_type, value from events qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1")
def upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.latest(table(spark, sf_dir, "events"), "user_id", ("ts", "event_id")).select("user_id", "event_id", "event_type", "value")


@register("r10_vec_hydrate", Q0.format(COS) + " select vec_id, label, round(score, 6) score, round(list_sum(embedding::double[]), 6) total from s order by s.score desc, vec_id limit 10")
def vec_hydrate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors(spark, sf_dir)
    hits = search.top_k(rows, first_vector(spark, sf_dir), 10)
    total = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double"))
    return search.hydrate(hits, rows, keep=["label", "vector"]).select(F.col("id").alias("vec_id"), "label", r6("score"), F.round(total, 6).alias("total"))


@register("r11_index_stats", "select count(*) count, max(len(embedding)) dimensions, count(*) * (4 * max(len(embedding)) + 320) memory_bytes from embeddings")
def index_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.index_stats(vectors(spark, sf_dir))


CELLS = "u as (select label, generate_subscripts(embedding, 1) as pos, unnest(embedding)::double as x from embeddings), m as (select label, pos, avg(x) as x from u group by all), c as (select label as cell, list(x order by pos) as centroid from m group by 1)"


@register("r12_ivf_topk", f"with q as (select arg_min(embedding, vec_id)::double[] v from embeddings), {CELLS}, b as (select cell from c, q order by list_cosine_similarity(centroid, q.v) desc, cell limit 3), s as (select vec_id, {COS} score from embeddings, q where label in (select cell from b)) select vec_id, round(score, 6) score from s order by s.score desc, vec_id limit 10")
def ivf_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors(spark, sf_dir).withColumn("cell", F.col("label"))
    return search.cell_top_k(rows, search.centroids(rows, "cell"), first_vector(spark, sf_dir), 10, 3).select(F.col("id").alias("vec_id"), r6("score"))


@register("r13_recall_at_k", f"with {ALL_PAIRS}, {CELLS}, e as (select vec_id query_id, cell, row_number() over (partition by vec_id order by round(list_cosine_similarity(embedding::double[], centroid), 9) desc, cell) n from embeddings, c), g as (select p.*, row_number() over (partition by query_id order by score desc, id) k from p join e using (query_id) where p.label = e.cell and e.n <= 3) select (select count(*) from embeddings) queries, count(*) hits, round(count(*) / ((select count(*) from embeddings) * 10.0), 6) recall from g join r using (query_id, id) where g.k <= 10 and r.rank <= 10")
def recall_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors(spark, sf_dir)
    asked = rows.select(F.col("id").alias("query_id"), F.col("vector").alias("query_vector"))
    truth = search.batch_top_k(rows, asked, 10)
    near = search.assign_cells(asked, search.centroids(rows, "label"), "query_vector", probes=3)
    found = search.within_cells(rows.withColumn("cell", F.col("label")), near, 10)
    return evaluation.recall_at_k(found, truth, 10).withColumn("recall", F.round("recall", 6))


def _filter(name: str, source: str, spec: dict, sql: str, key: str):
    @register(name, f"select {key} from {source} where {sql}")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = table(spark, sf_dir, source)
        return rows.where(condition(spec, Typed(rows.schema))).select(key)


def _leaf(field: str, operator: str, value) -> dict:
    return {"field": field, "operator": operator, "value": value}


_filter("r14_filter_eq", "documents", _leaf("lang", "eq", "en"), "lang = 'en'", "doc_id")
_filter("r15_filter_ne", "documents", _leaf("lang", "ne", "en"), "lang <> 'en'", "doc_id")
_filter("r16_filter_range", "orders", {"operator": "and", "filters": [_leaf("o_totalprice", "gt", 1000), _leaf("o_totalprice", "lte", 150000.5), _leaf("o_orderpriority", "gte", "2"), _leaf("o_orderpriority", "lt", "5")]}, "o_totalprice > 1000 and o_totalprice <= 150000.5 and o_orderpriority >= '2' and o_orderpriority < '5'", "o_orderkey")
_filter("r17_filter_in", "documents", _leaf("source", "in", ["src1", "src2", 7]), "source in ('src1', 'src2')", "doc_id")
_filter("r18_filter_contains_text", "documents", _leaf("text", "contains", "tion"), "contains(text, 'tion')", "doc_id")
_filter("r21_filter_nested", "documents", {"operator": "and", "filters": [{"operator": "or", "filters": [_leaf("lang", "eq", "de"), _leaf("n_chars", "gt", 5000)]}, {"operator": "or", "filters": [_leaf("source", "ne", "src0"), _leaf("text", "contains", "the")]}]}, "(lang = 'de' or n_chars > 5000) and (source <> 'src0' or contains(text, 'the'))", "doc_id")
_filter("r22_filter_empty", "documents", {"operator": "or", "filters": [{"operator": "and", "filters": []}, _leaf("lang", "like", "en")]}, "true", "doc_id")


_filter("r22c_filter_unknown", "documents", {"operator": "and", "filters": [_leaf("n_chars", "lt", 2000), {"operator": "or", "filters": [_leaf("lang", "like", "en"), _leaf("nowhere", "ne", 1), _leaf("source", "eq", "src2")]}]}, "n_chars < 2000 and (false or false or source = 'src2')", "doc_id")
_filter("r22d_filter_no_match", "documents", _leaf("lang", "matches", "en"), "false", "doc_id")


@register("r19_filter_contains_array", "select conv_id from conversations group by 1 having list_contains(list(role), 'system')")
def filter_contains_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.collect_set("role").alias("roles"))
    return rows.where(condition(_leaf("roles", "contains", "system"), Typed(rows.schema))).select("conv_id")


@register("r20_filter_json_path", "select event_id from events where (props->>'$.k')::double >= 50 or (props->>'$.k')::double in (3, 7)")
def filter_json_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = {"operator": "or", "filters": [_leaf("k", "gte", 50), _leaf("k", "in", [3, 7, "9"]), _leaf("missing.path", "ne", 1)]}
    return table(spark, sf_dir, "events").where(condition(spec, Json(F.col("props")))).select("event_id")


@register("r22b_filter_scoped", "select doc_id from documents where source = 'src3' and (lang = 'en' or n_chars < 500)")
def filter_scoped(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents")
    spec = {"operator": "or", "filters": [_leaf("lang", "eq", "en"), _leaf("n_chars", "lt", 500)]}
    return rows.where(condition(scoped(spec, "source", "src3"), Typed(rows.schema))).select("doc_id")


_STOP = ", ".join(f"'{w}'" for w in T.STOPWORDS)


def _tok(column: str = "text") -> str:
    return rf"list_filter(regexp_split_to_array(regexp_replace(lower({column}), '[^a-z0-9\s]', ' ', 'g'), '\s+'), lambda w: length(w) > 1 and w not in ({_STOP}))"


@register("r23_tokenize_counts", f"select doc_id, len({_tok()}) n_tokens from documents")
def tokenize_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sparse.lengths(table(spark, sf_dir, "documents"), "doc_id").select(F.col("id").alias("doc_id"), F.col("dl").cast("bigint").alias("n_tokens"))


@register("r24_doc_freq", f"select term, count(distinct doc_id) df from (select doc_id, unnest({_tok()}) term from documents) group by 1")
def doc_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sparse.term_documents(table(spark, sf_dir, "documents"))


def _bm25_sql(docs: str = "documents", k: int = 10) -> str:
    return f"""bd as (select doc_id id, {_tok()} w from {docs}), bs as (select count(*) n, avg(len(w)) avgdl from bd),
        bp as (select id, term, count(*) tf, any_value(dl) dl from (select id, len(w) dl, unnest(w) term from bd) group by all),
        bf as (select term, count(*) df from bp group by 1),
        bq as (select query_id, term, count(*) qtf from (select item_id query_id, unnest({_tok()}) term from benchmark) group by all),
        bm as (select query_id, id, sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) score from bq join bp using (term) join bf using (term), bs group by all),
        br as (select query_id, id, score, row_number() over (partition by query_id order by round(score, 9) desc, id) rank from bm qualify rank <= {k})"""


def _bag_sql(docs: str = "documents", k: int = 10) -> str:
    return f"""gp as (select id, term, count(*) tf from (select doc_id id, unnest({_tok()}) term from {docs}) group by all),
        gn as (select id, sqrt(sum(tf * tf)) norm from gp group by 1),
        gq as (select query_id, term, count(*) qtf from (select item_id query_id, unnest({_tok()}) term from benchmark) where term in (select term from gp) group by all),
        gl as (select query_id, sqrt(sum(qtf * qtf)) qnorm from gq group by 1),
        gs as (select query_id, id, sum(tf * qtf) dot from gp join gq using (term) group by all),
        gc as (select query_id, id, dot / (norm * qnorm) score from gs join gn using (id) join gl using (query_id)),
        gr as (select query_id, id, score, row_number() over (partition by query_id order by round(score, 9) desc, id) rank from gc qualify rank <= {k})"""


RRF = """fu as (select query_id, id, gr.rank dense_rank, br.rank sparse_rank, coalesce(0.5 / (60 + gr.rank), 0) + coalesce(0.5 / (60 + br.rank), 0) score from gr full outer join br using (query_id, id)),
    fr as (select *, row_number() over (partition by query_id order by round(score, 9) desc, dense_rank nulls last, sparse_rank nulls last, id) rank from fu)"""


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def _ranked(rows: DataFrame) -> DataFrame:
    return rows.select("query_id", "id", F.col("rank").cast("bigint").alias("rank"), r6("score"))


@register("r25_bm25_topk", f"with {_bm25_sql()} select query_id, id, rank, round(score, 6) score from br")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranked(sparse.bm25(table(spark, sf_dir, "documents"), questions(spark, sf_dir), 10, "doc_id"))


LIVE = "(select * from documents where doc_id not in (select doc_id from labels where quality = 0))"


@register("r26_bm25_after_delete", f"with {_bm25_sql(LIVE)} select query_id, id, rank, round(score, 6) score from br")
def bm25_after_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = search.live(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").where("quality = 0"), "doc_id")
    return _ranked(sparse.bm25(docs, questions(spark, sf_dir), 10, "doc_id"))


@register("r27_rrf_fuse", f"with {_bm25_sql()}, {_bag_sql()}, {RRF} select query_id, id, dense_rank::int dense_rank, sparse_rank::int sparse_rank, rank, round(score, 6) score from fr")
def rrf_fuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, asked = table(spark, sf_dir, "documents"), questions(spark, sf_dir)
    found = sparse.profiles(docs, asked, "doc_id")
    fused = fusion.reciprocal_rank_fusion(sparse.bag_cosine_of(found, 10), sparse.bm25_of(found, 10))
    return fused.select("query_id", "id", "dense_rank", "sparse_rank", F.col("rank").cast("bigint").alias("rank"), r6("score"))


@register("r28_hybrid_topk", f"with {_bm25_sql(k=40)}, {_bag_sql(k=40)}, {RRF} select query_id, id, rank, round(score, 6) score from fr where rank <= 10")
def hybrid_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranked(fusion.hybrid(table(spark, sf_dir, "documents"), questions(spark, sf_dir), 10, id_col="doc_id"))


ENGLISH = "(select * from documents where lang = 'en')"


@register("r29_hybrid_filtered", f"with {_bm25_sql(ENGLISH, 40)}, {_bag_sql(ENGLISH, 40)}, {RRF} select query_id, id, rank, round(score, 6) score from fr where rank <= 10")
def hybrid_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    where = F.col("lang") == "en"
    return _ranked(fusion.hybrid(table(spark, sf_dir, "documents"), questions(spark, sf_dir), 10, where, id_col="doc_id"))


@register("r29b_hybrid_faithful", f"with {_bm25_sql(k=40)}, {_bag_sql(ENGLISH, 40)}, {RRF} select query_id, id, rank, round(score, 6) score from fr where rank <= 10")
def hybrid_faithful(spark: SparkSession, sf_dir: str) -> DataFrame:
    where = F.col("lang") == "en"
    return _ranked(fusion.hybrid(table(spark, sf_dir, "documents"), questions(spark, sf_dir), 10, where, True, "doc_id"))


_OVERLAP = f"len(list_filter({_tok('d.text')}, lambda t: list_contains({_tok('b.text')}, t)))"


@register("r30_lexical_rerank", f"with {_bm25_sql()}, o as (select br.*, case when rank <= 5 then {_OVERLAP} end overlap from br join documents d on d.doc_id = br.id join benchmark b on b.item_id = br.query_id) select query_id, id, overlap, row_number() over (partition by query_id order by rank <= 5 desc, overlap desc nulls last, case when rank <= 5 then -round(score, 9) end, rank) new_rank from o")
def lexical_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, asked = table(spark, sf_dir, "documents"), questions(spark, sf_dir)
    hits = search.hydrate(sparse.bm25(docs, asked, 10, "doc_id"), docs.withColumnRenamed("doc_id", "id"), keep=["text"]).join(asked, "query_id")
    return fusion.lexical_rerank(hits, 5).select("query_id", "id", F.col("overlap").cast("bigint").alias("overlap"), F.col("new_rank").cast("bigint").alias("new_rank"))


_TRIM = r"regexp_replace(replace(text, chr(13) || chr(10), chr(10)), '^\s+|\s+$', '', 'g')"
_SENT = rf"list_filter(list_transform(string_split(regexp_replace({_TRIM}, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), lambda s: s <> '')"


@register("r31_sentence_split", f"select doc_id, len({_SENT}) n_sentences, coalesce(list_max(list_transform({_SENT}, lambda s: length(s))), 0) longest from documents")
def sentence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "documents").select("doc_id", T.sentences(F.col("text")).alias("s"))
    return parts.select("doc_id", F.size("s").cast("bigint").alias("n_sentences"), F.coalesce(F.array_max(F.transform("s", F.length)), F.lit(0)).cast("bigint").alias("longest"))


@register("r32_approx_tokens", r"select doc_id, ceil(length(text) / 4)::bigint by_chars, greatest(len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')), ceil(length(text) / 4)::bigint) approx from documents")
def approx_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.char_tokens(F.col("text")).alias("by_chars"), T.approx_tokens(F.col("text")).alias("approx"))


_WORDS = r"len(list_filter(regexp_split_to_array({0}, '\s+'), lambda w: w <> ''))"
_WEIGHT = f"greatest({_WORDS.format('{0}')}, ceil(length({{0}}) / 4)::bigint)".format
#: Chunks by folding over sentences: where chunks begin and end, where sentences begin, short last chunks joined to the one before.
CHUNKS = rf"""cs as (select doc_id, {_TRIM} clean, {_SENT} s from documents), cw as (select doc_id, clean, s, list_transform(s, lambda x: {_WEIGHT('x')}) w from cs where len(s) > 0),
    cp as (select *, list_transform(range(0, len(w) + 1), lambda j: coalesce(list_sum(w[1:j]), 0)::bigint) p from cw),
    cf as (select *, list_reduce(list_prepend({{'f': 0::bigint, 'a': []::bigint[], 'b': []::bigint[]}}, list_transform(range(0, len(w)), lambda i: {{'f': i, 'a': []::bigint[], 'b': []::bigint[]}})), lambda acc, x:
            case when x.f > acc.f and p[x.f + 1] - p[acc.f + 1] + w[x.f + 1] > 256 then {{'f': list_max(list_filter(range(0, x.f + 1), lambda g: g = 0 or p[x.f + 1] - p[g + 1] >= 32)), 'a': list_append(acc.a, acc.f), 'b': list_append(acc.b, x.f)}} else acc end) r,
        list_reduce(list_prepend({{'t': 0::bigint, 'o': []::bigint[], 's': ''}}, list_transform(s, lambda x: {{'t': 0::bigint, 'o': []::bigint[], 's': x}})), lambda acc, x: {{'t': acc.t + instr(substr(clean, acc.t + 1), x.s) - 1 + length(x.s), 'o': list_append(acc.o, acc.t + instr(substr(clean, acc.t + 1), x.s) - 1), 's': ''}}).o o from cp),
    ce as (select doc_id, s, o, unnest(list_append(r.a, r.f)) a, unnest(list_append(r.b, len(s))) b, unnest(range(0, len(r.a) + 1)) e from cf),
    cj as (select *, array_to_string(s[a + 1 : b], ' ') j from ce), cn as (select *, sum((not (e > 0 and {_WEIGHT('j')} < 64))::int) over (partition by doc_id order by e) - 1 n from cj),
    ch as (select doc_id, n::int chunk_index, arg_min(o[a + 1], e) start_offset, string_agg(j, ' ' order by e) as chunk, doc_id || '#' || n::int chunk_id from cn group by doc_id, n)"""


@register("r33_chunk_documents", f"with {CHUNKS} select doc_id, chunk_index, start_offset, chunk, chunk_id from ch")
def chunk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk.chunk_documents(table(spark, sf_dir, "documents"), id_col="doc_id").withColumnRenamed("id", "doc_id")


@register("r33b_word_windows", r"with d as (select doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '') w from documents), s as (select doc_id, w, unnest(generate_series(0, greatest(len(w) - 1, 0), 80)) s from d) select doc_id, (s / 80)::int index, length(array_to_string(w[s + 1 : s + 100], ' ')) n_chars from s where len(w) > 0")
def word_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.explode_outer(T.word_windows(F.col("text"), 100, 20)).alias("c")).where("c is not null")
    return rows.select("doc_id", "c.index", F.length("c.text").cast("bigint").alias("n_chars"))


_HEAD = "substr(text, 1, 400)"
_AT = f"greatest(case when instr(reverse({_HEAD}), '.') > 0 then 400 - instr(reverse({_HEAD}), '.') else -1 end, case when instr(reverse({_HEAD}), chr(10)) > 0 then 400 - instr(reverse({_HEAD}), chr(10)) else -1 end)"
_CUT = f"case when length(text) <= 400 then text when {_AT} > 320 then substr(text, 1, ({_AT} + 1)::bigint) || ' [cut]' else {_HEAD} || '...' || ' [cut]' end"


@register("r34_truncate_context", f"select doc_id, md5({_CUT}) digest, length({_CUT}) n_chars from documents")
def truncate_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = T.truncate(F.col("text"), 100, " [cut]")
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(cut).alias("digest"), F.length(cut).cast("bigint").alias("n_chars"))


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    hits = sparse.bm25(docs, questions(spark, sf_dir), 5, "doc_id")
    scored = hits.select("query_id", "id", "rank", F.round("score", 6).alias("score"), F.col("score").alias("raw"))
    return search.hydrate(scored, docs.select(F.col("doc_id").alias("id"), F.col("text").alias("content"), F.col("source").alias("title")), keep=["content", "title"])


@register("r35_prompts", f"with {_bm25_sql(k=5)}, c as (select query_id, string_agg('[' || rank || '] ' || d.text, chr(10) || chr(10) order by rank) context from br join documents d on d.doc_id = br.id group by 1) select item_id query_id, length(coalesce(context, '{T.NOTHING_FOUND}')) context_chars, md5('S' || coalesce(context, '{T.NOTHING_FOUND}') || '?' || text) digest from benchmark b left join c on b.item_id = c.query_id")
def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rag.context(_hits(spark, sf_dir))
    every = questions(spark, sf_dir).join(found, "query_id", "left").withColumn("context", F.coalesce("context", F.lit(T.NOTHING_FOUND)))
    prompt = T.prompt(F.lit("{system}{context}?{question}"), F.lit("S"), F.col("context"), F.col("query"))
    return every.select("query_id", F.length("context").cast("bigint").alias("context_chars"), F.md5(prompt).alias("digest"))


@register("r36_citations", f"with {_bm25_sql(k=5)} select query_id, id, rank, round(score, 6) score, case when length(text) > 0 then substr(text, 1, 280) else coalesce(source, '') end snippet from br join documents d on d.doc_id = br.id")
def citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rag.citations(_hits(spark, sf_dir)).select("query_id", "id", F.col("rank").cast("bigint").alias("rank"), "score", "snippet")


@register("r37_sanitise", "select page_id, md5(replace(replace(replace(replace(replace(html, '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;'), '/', '&#x2F;')) digest from pages")
def sanitise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.md5(T.escape(F.col("html"))).alias("digest"))


_H = "list_reduce(list_prepend(0::bigint, list_transform(string_split({}, ''), lambda c: unicode(c)::bigint)), lambda h, c: (h * 31 + c) % 4294967296)"


@register("r38_hash_embedding", f"with h as (select url, {_H.format('url')} u from (select distinct url from pages)), g as (select url, case when u >= 2147483648 then u - 4294967296 else u end h from h), v as (select url, list_transform(range(0, 16), lambda i: sin((h + i)::double) * 0.5) v from g) select url, round(v[1] / sqrt(list_inner_product(v, v)), 6) first, round(list_sum(v) / sqrt(list_inner_product(v, v)), 6) total from v")
def hash_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "pages").select("url").distinct().select("url", embed.hash_embedding(F.col("url"), 16).alias("v"))
    return v.select("url", F.round(F.col("v")[0], 6).alias("first"), F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


_W = f"list_transform(regexp_extract_all(text, '[A-Za-z0-9]+')[1:96], lambda w: {_H.format('w')} % 30000 + 1000)"


@register("r39_hash_tokens", f"with i as (select item_id, {_W} ids from benchmark), j as (select item_id, case when len(ids) = 0 then [101, 102] else list_append(ids, 102) end ids from i) select item_id, array_to_string(list_concat(ids, list_transform(range(96), lambda x: 0))[1:96], ' ') ids from j")
def hash_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", F.array_join(T.hash_tokens(F.col("text")).cast("array<string>"), " ").alias("ids"))


_S = "list_max(list_transform(embedding, lambda x: abs(x)))::double"
_Q8 = f"list_transform(embedding, lambda x: case when {_S} = 0 then 0 else floor(x::double / {_S} * 127 + 0.5) end::int)"


@register("r40_quant_int8", f"select vec_id, array_to_string({_Q8}, ' ') codes, round({_S}, 6) scale from embeddings")
def quant_int8(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = quant.quantise(F.col("vector"), "int8")
    return vectors(spark, sf_dir).select(F.col("id").alias("vec_id"), q.alias("q")).select("vec_id", F.array_join(F.col("q.data").cast("array<string>"), " ").alias("codes"), F.round(F.col("q.scales")[0], 6).alias("scale"))


@register("r41_dequant_error", f"with e as (select vec_id, embedding, {_Q8} q, {_S} s from embeddings) select vec_id, round(list_max(list_transform(list_zip(embedding, q), lambda p: abs(p[1]::double - p[2] * s / 127))), 6) worst from e")
def dequant_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors(spark, sf_dir).select("id", "vector", quant.quantise(F.col("vector"), "int8").alias("q"))
    back = quant.dequantise(F.col("q"), "int8")
    return rows.select(F.col("id").alias("vec_id"), F.round(F.array_max(F.zip_with("vector", back, lambda a, b: F.abs(a.cast("double") - b))), 6).alias("worst"))


_B4 = "list_transform(range(0, len(embedding)), lambda i: list_max(list_transform(embedding[(i // 32) * 32 + 1 : (i // 32) * 32 + 32], lambda x: abs(x)))::double)"


@register("r42_quant_int4", f"with b as (select vec_id, embedding, {_B4} s from embeddings), q as (select vec_id, embedding, s, list_transform(list_zip(embedding, s), lambda p: case when p[2] = 0 then 0 else least(7, greatest(-7, floor(p[1]::double / p[2] * 7 + 0.5))) end::int) q from b) select vec_id, list_sum(list_transform(q, lambda x: x::bigint))::bigint code_sum, round(list_max(list_transform(list_zip(embedding, q, s), lambda p: abs(p[1]::double - p[2] * p[3] / 7))), 6) worst from q")
def quant_int4(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors(spark, sf_dir).select("id", "vector", quant.quantise(F.col("vector"), "int4").alias("q"))
    packed = quant.int4_packed(F.col("q.data"))
    codes = quant.int4_unpacked(packed, F.size("vector"))
    back = quant.int4_back(codes, F.col("q.scales"))
    return rows.select(F.col("id").alias("vec_id"), F.aggregate(codes, F.lit(0).cast("bigint"), lambda s, x: s + x).alias("code_sum"), F.round(F.array_max(F.zip_with("vector", back, lambda a, b: F.abs(a.cast("double") - b))), 6).alias("worst"))


@register("r43_latency_percentiles", "select event_type, count(value) n, round(min(value), 6) min, round(max(value), 6) max, round(avg(value), 6) mean, round(median(value), 6) median, round(quantile_disc(value, 0.95), 6) p95, round(quantile_disc(value, 0.99), 6) p99 from events group by 1")
def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = evaluation.latency_summary(table(spark, sf_dir, "events"), "value", ["event_type"])
    return out.select("event_type", "n", *(r6(c) for c in ("min", "max", "mean", "median", "p95", "p99")))


@register("r43b_floor_percentiles", "with l as (select event_type, list(value order by value) v from events where value is not null group by 1) select event_type, round(v[least(len(v), floor(len(v) * 0.5) + 1)::int], 6) p50, round(v[least(len(v), floor(len(v) * 0.99) + 1)::int], 6) p99 from l")
def floor_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = evaluation.floor_percentile(table(spark, sf_dir, "events"), "value", {"p50": 0.5, "p99": 0.99}, ["event_type"])
    return out.select("event_type", r6("p50"), r6("p99"))


_KNOWN = f"documents as (select id doc_id, text from {known.values(known.PASSAGES, 'id, text')}), asked as (select * from {known.values(known.QUESTIONS, 'item_id, text, expected')}), benchmark as (select item_id, text from asked)"
_EVAL = "select '{0}' variant, count(*) queries, round(avg((coalesce(h.rank, 999999) <= 3)::int::double), 6) recall, round(avg(coalesce(h.rank, coalesce(z.n, 0) + 1)), 6) mean_rank from asked a left join (select query_id, count(*) n from {1} group by 1) z on z.query_id = a.item_id left join {1} h on h.query_id = a.item_id and h.id = a.expected"
_RERANKED = f"lx as (select fr.query_id, fr.id, row_number() over (partition by fr.query_id order by len(list_filter({_tok('d.text')}, lambda t: list_contains({_tok('b.text')}, t))) desc, -round(fr.score, 9), fr.rank) rank from fr join documents d on d.doc_id = fr.id join benchmark b on b.item_id = fr.query_id where fr.rank <= 12)"


@register("r44_citation_eval", f"with {_KNOWN}, {_bm25_sql(k=12)}, {_bag_sql(k=12)}, {RRF}, {_RERANKED} {_EVAL.format('dense', 'gr')} union all {_EVAL.format('keyword', 'br')} union all {_EVAL.format('hybrid', 'fr')} union all {_EVAL.format('reranked', 'lx')}")
def citation_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.createDataFrame(known.PASSAGES, "id string, text string")
    asked = spark.createDataFrame(known.QUESTIONS, "query_id int, query string, expected_id string")
    found = sparse.profiles(docs, asked.drop("expected_id"))
    dense, words = (f(found, 12) for f in (sparse.bag_cosine_of, sparse.bm25_of))
    fused = fusion.reciprocal_rank_fusion(dense, words)
    pool = fused.where("rank <= 12").join(docs, "id").join(asked.drop("expected_id"), "query_id")
    again = fusion.lexical_rerank(pool).select("query_id", "id", F.col("new_rank").alias("rank"))
    expected = asked.select("query_id", "expected_id")
    parts = [evaluation.expected_ranks(r, expected, 3).select(F.lit(name).alias("variant"), "queries", r6("recall"), r6("mean_rank")) for name, r in (("dense", dense), ("keyword", words), ("hybrid", fused), ("reranked", again))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@register("r45_export_chunks", "select chunk_id, count(*) n, min(vec_id) first, max(vec_id) last from (select vec_id, ((row_number() over (order by vec_id) - 1) // 100)::bigint chunk_id from embeddings) group by 1")
def export_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exchange.numbered(vectors(spark, sf_dir).select("id"), 100).groupBy("chunk_id").agg(F.count("*").alias("n"), F.min("id").alias("first"), F.max("id").alias("last"))


@register("r45b_load_progress", "with c as (select ((row_number() over (order by vec_id) - 1) // 100)::bigint chunk_id from embeddings), n as (select chunk_id, count(*) n from c group by 1) select chunk_id, n, (sum(n) over (order by chunk_id))::bigint loaded, (sum(n) over ())::bigint total, round(sum(n) over (order by chunk_id) * 100.0 / sum(n) over (), 6) percent from n")
def load_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exchange.progress(vectors(spark, sf_dir), 100).select("chunk_id", "n", "loaded", "total", r6("percent"))


@register("r46_ndjson_roundtrip", "select vec_id id, round(list_sum(embedding::double[]), 4) total, label from embeddings")
def ndjson_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors(spark, sf_dir).select(F.col("id").cast("string").alias("id"), "vector", F.to_json(F.struct("label")).alias("metadata"), F.lit(1).cast("bigint").alias("timestamp"))
    path = shared(spark)
    exchange.export_ndjson(rows, path)
    back, envelope = exchange.read_export(spark, path)
    exchange.validate(back, envelope)
    total = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double"))
    return back.select(F.col("id").cast("bigint").alias("id"), F.round(total, 4).alias("total"), F.get_json_object("metadata", "$.label").cast("int").alias("label"))


@register("r47_host_allowlist", r"select page_id, coalesce(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) in ('therin.example.net', 'therha.example.com', ''), true) allowed from pages")
def host_allowlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", host_allowed(F.col("url"), ["therin.example.net", "therha.example.com"]).alias("allowed"))


@register("r48_get_batch", "with a as (select unnest(range(6)) pos, unnest([7, 3, 7, 999999999, 0, 12]) doc_id) select a.pos::int pos, doc_id, lang, n_chars from a join documents using (doc_id)")
def get_by_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return get_batch(table(spark, sf_dir, "documents"), [7, 3, 7, 999999999, 0, 12], "doc_id").select("pos", "doc_id", "lang", "n_chars")


@register("r49_stream_ingest", "select user_id, event_id, event_type, value from events qualify row_number() over (partition by user_id order by event_id desc) = 1")
def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events")
    at = shared(spark)
    # the stream's source is a folder of files, as a feed would leave them
    rows.repartitionByRange(8, "event_id").write.parquet(f"{at}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 3).parquet(f"{at}/in")
    ingest.upsert_table(stream, f"{at}/out", "user_id", "event_id", f"{at}/log").awaitTermination()
    return ingest.read_upserts(spark, f"{at}/out", "user_id", "event_id").select("user_id", "event_id", "event_type", "value")


@register("r50_conversation_context", "with c as (select *, ceil(length(text) / 4)::bigint t, sum(ceil(length(text) / 4)::bigint) over (partition by conv_id order by turn desc) back from conversations) select conv_id, count(*) turns, sum(t)::bigint tokens, md5(string_agg(role || ': ' || text, chr(10) order by turn)) digest from c where back <= 500 group by 1")
def conversation_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").withColumn("t", T.char_tokens(F.col("text")))
    back = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    kept = rows.withColumn("back", F.sum("t").over(back)).where("back <= 500")
    listed = F.array_sort(F.collect_list(F.struct("turn", F.concat_ws(": ", "role", "text").alias("line"))))
    return kept.groupBy("conv_id").agg(F.count("*").alias("turns"), F.sum("t").alias("tokens"), listed.alias("l")).select("conv_id", "turns", "tokens", F.md5(F.array_join(F.transform("l", lambda x: x["line"]), "\n")).alias("digest"))


@register("r51_relevance_eval", f"with {_bm25_sql()} select quality, count(*) hits, count(distinct query_id) queries, round(avg(score), 6) mean_score, round(avg(rank), 6) mean_rank from br join labels l on l.doc_id = br.id group by 1")
def relevance_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = sparse.bm25(table(spark, sf_dir, "documents"), questions(spark, sf_dir), 10, "doc_id")
    rated = hits.join(table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "id"), "id")
    return rated.groupBy("quality").agg(F.count("*").alias("hits"), F.count_distinct("query_id").alias("queries"), F.round(F.avg("score"), 6).alias("mean_score"), F.round(F.avg("rank"), 6).alias("mean_rank"))


@register("r52_score_spread", f"with {ALL_PAIRS} select query_id, count(distinct round(score, 6)) distinct_scores, round(avg(score * score) - avg(score) * avg(score), 6) variance, count(distinct round(score, 6)) > 1 and avg(score * score) - avg(score) * avg(score) > 1e-9 real_scores from r where rank <= 10 group by 1")
def score_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors(spark, sf_dir)
    hits = search.batch_top_k(rows, rows.select(F.col("id").alias("query_id"), F.col("vector").alias("query_vector")), 10)
    return evaluation.score_spread(hits, ["query_id"]).withColumn("variance", F.round("variance", 6))


@register("r53_throughput", "select event_type, count(*) operations, round(sum(value), 4) total_seconds, round(count(*) / nullif(sum(value), 0), 6) per_second, round(1000 * sum(value) / count(*), 4) mean_ms from events group by 1")
def throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = evaluation.throughput(table(spark, sf_dir, "events"), F.col("value"), ["event_type"])
    return out.select("event_type", "operations", F.round("total_seconds", 4).alias("total_seconds"), r6("per_second"), F.round("mean_ms", 4).alias("mean_ms"))


@register("r54_hit_rate", "select event_type, count(*) lookups, round(avg((value > 50)::int::double), 6) hit_rate from events group by 1")
def hit_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.hit_rate(table(spark, sf_dir, "events"), F.col("value") > 50, ["event_type"]).select("event_type", "lookups", r6("hit_rate"))


@register("r55_growth", "select user_id, round(min(value), 6) min, round(max(value), 6) max, round(avg(value), 6) mean, round(arg_max(value, event_id) - arg_min(value, event_id), 6) growth from events group by 1")
def growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.growth(table(spark, sf_dir, "events"), "value", "event_id", ["user_id"]).select("user_id", *(r6(c) for c in ("min", "max", "mean", "growth")))


@register("r56_overlap", "select p_brand brand from part where p_size < 25 intersect select p_brand from part where p_retailprice > 990")
def overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select(F.col("p_brand").alias("brand"), "p_size", "p_retailprice")
    return rows.where("p_size < 25").select("brand").intersect(rows.where("p_retailprice > 990").select("brand"))


@register("r57_bag_of_words_topk", f"with {_bag_sql()} select query_id, id, rank, round(score, 6) score from gr")
def bag_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranked(sparse.bag_cosine(table(spark, sf_dir, "documents"), questions(spark, sf_dir), 10, "doc_id"))


@register("r58_corpus_stats", f"select count(*) n, round(avg(len({_tok()})), 6) avgdl from documents")
def corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sparse.corpus_stats(table(spark, sf_dir, "documents"), "doc_id").select("n", r6("avgdl"))


@register("r59_regressions", "with a as (select l_returnflag || l_linestatus as name, avg(l_quantity) as seconds from lineitem where l_discount < 0.05 group by 1), b as (select l_returnflag || l_linestatus as name, avg(l_extendedprice / 1000) as seconds from lineitem group by 1) select name, round(a.seconds, 4) as before, round(b.seconds, 4) as after, round(b.seconds / a.seconds, 6) as ratio from a join b using (name) where b.seconds / a.seconds > 1.1")
def regressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").withColumn("name", F.concat("l_returnflag", "l_linestatus"))
    before = rows.where("l_discount < 0.05").groupBy("name").agg(F.avg("l_quantity").alias("seconds"))
    after = rows.groupBy("name").agg(F.avg(F.col("l_extendedprice") / 1000).alias("seconds"))
    return evaluation.regressions(before, after).select("name", F.round("before", 4).alias("before"), F.round("after", 4).alias("after"), r6("ratio"))


@register("r60_retrieve_reranked", f"with {_bm25_sql(k=80)}, {_bag_sql(k=80)}, {RRF}, o as (select fr.query_id, fr.id, fr.score, row_number() over (partition by fr.query_id order by {_OVERLAP.replace('br.', 'fr.')} desc, -round(fr.score, 9), fr.rank) new_rank from fr join documents d on d.doc_id = fr.id join benchmark b on b.item_id = fr.query_id where fr.rank <= 20) select query_id, id, new_rank as rank, round(score, 6) score from o where new_rank <= 5")
def retrieve_reranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = rag.retrieve(table(spark, sf_dir, "documents"), questions(spark, sf_dir), rag.Profile(top_k=5, rerank=True), id_col="doc_id")
    return hits.select("query_id", "id", F.col("rank").cast("bigint").alias("rank"), r6("score"))


def _lloyd_sql(cells: int, rounds: int) -> str:
    near = "select vec_id, any_value(embedding) embedding, arg_min(cell, (-round(list_cosine_similarity(embedding::double[], centroid), 9), cell)) cell from embeddings, {0} group by vec_id"
    out = [f"t0 as (select (row_number() over (order by md5(vec_id || ':7'), vec_id) - 1)::int cell, embedding::double[] centroid from embeddings qualify cell < {cells})"]
    for r in range(rounds):
        out.append(f"n{r} as ({near.format(f't{r}')}), u{r} as (select cell, generate_subscripts(embedding, 1) pos, unnest(embedding)::double x from n{r}), m{r} as (select cell, pos, avg(x) x from u{r} group by all), l{r} as (select cell, list(x order by pos) centroid from m{r} group by 1), t{r + 1} as (select cell, coalesce(l{r}.centroid, t{r}.centroid) centroid from t{r} left join l{r} using (cell))")
    return ", ".join(out) + f", placed as ({near.format(f't{rounds}')})"


@register("r61_trained_cells", f"with q as (select arg_min(embedding, vec_id)::double[] v from embeddings), {_lloyd_sql(16, 5)}, b as (select cell from t5, q order by list_cosine_similarity(centroid, q.v) desc, cell limit 6), s as (select vec_id, {COS} score from placed, q where cell in (select cell from b)) select vec_id, round(score, 6) score from s order by s.score desc, vec_id limit 10")
def trained_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors(spark, sf_dir)
    cells = search.train_cells(rows, 16)
    return search.cell_top_k(search.assign_cells(rows, cells), cells, first_vector(spark, sf_dir), 10, 6).select(F.col("id").alias("vec_id"), r6("score"))


_BY_LABEL = "a as (select vec_id, embedding, arg_max(cell, round(list_cosine_similarity(embedding::double[], centroid), 12)) cell from embeddings, c group by all)"


@register("r62_cells_on_disk", f"with q as (select arg_min(embedding, vec_id)::double[] v from embeddings), {CELLS}, {_BY_LABEL}, b as (select cell from c, q order by list_cosine_similarity(centroid, q.v) desc, cell limit 3), s as (select vec_id, {COS} score from a, q where cell in (select cell from b)) select vec_id, round(score, 6) score from s order by s.score desc, vec_id limit 10")
def cells_on_disk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, path = vectors(spark, sf_dir), shared(spark)
    derived.write_cells(rows.select("id", "vector"), search.centroids(rows, "label"), path)
    return derived.search_cells(spark, path, first_vector(spark, sf_dir), 10, 3).select(F.col("id").alias("vec_id"), r6("score"))


@register("r63_postings_on_disk", ORACLE_SQL["r25_bm25_topk"])
def postings_on_disk(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared(spark)
    derived.write_postings(table(spark, sf_dir, "documents"), path, "doc_id", parts=16)
    return _ranked(derived.search_postings(spark, path, questions(spark, sf_dir), 10))


@register("r64_chunk_bm25", f"with {CHUNKS}, {_bm25_sql('(select chunk_id doc_id, chunk as text from ch)')} select query_id, id, rank, round(score, 6) score from br")
def chunk_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages rather than documents: both lists name a chunk by one key."""
    parts = chunk.chunk_documents(table(spark, sf_dir, "documents"), id_col="doc_id").select("chunk_id", F.col("chunk").alias("text"))
    return _ranked(sparse.bm25(parts, questions(spark, sf_dir), 10, "chunk_id"))


@register("r65_graph_recall", "select count(*) queries, true found from embeddings where vec_id % 50 = 0")
def graph_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the stored graph finds nine of ten true neighbours or more, for the rows whose id 50 divides."""
    rows, at = vectors(spark, sf_dir), graph.GraphIndex(spark, shared(spark))
    at.build(rows, 64)
    asked = rows.where("id % 50 = 0").select(F.col("id").alias("query_id"), F.col("vector").alias("query_vector"))
    recall = evaluation.recall_at_k(at.search(asked, 10), search.batch_top_k(rows, asked, 10), 10)
    return recall.select("queries", (F.col("recall") >= 0.9).alias("found"))


@register("r66_graph_changed", "select count(*) queries, count(*) first_is_itself from embeddings where vec_id % 50 = 0 and label <> 1")
def graph_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A graph built from half the rows, the others added, label 1 taken out: every query that is left finds itself first."""
    rows, at = vectors(spark, sf_dir), graph.GraphIndex(spark, shared(spark))
    at.build(rows.where("id % 2 = 0"), 64, shard_rows=1000)
    at.add(rows.where("id % 2 = 1"), removed=rows.where("label = 1"))
    at.add(rows.limit(0), removed=rows.where("label = 1"))
    asked = rows.where("id % 50 = 0 and label <> 1").select(F.col("id").alias("query_id"), F.col("vector").alias("query_vector"))
    hits = at.search(asked, 1)
    return hits.agg(F.count("*").alias("queries"), F.count_if(F.col("query_id") == F.col("id")).alias("first_is_itself"))


@register("r67_stub_rows", f"with {_bm25_sql(k=20)}, {_bag_sql(k=20)}, {RRF} select fr.query_id, fr.id, fr.rank, case when fr.dense_rank is null then 0 else length(d.text) end n_chars from fr join documents d on d.doc_id = fr.id where fr.rank <= 5")
def stub_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = rag.retrieve(table(spark, sf_dir, "documents"), questions(spark, sf_dir), rag.Profile(stubs=True), id_col="doc_id")
    return hits.select("query_id", "id", F.col("rank").cast("bigint").alias("rank"), F.length("content").cast("bigint").alias("n_chars"))


@register("r68_chunk_sql", f"with {CHUNKS} select doc_id, count(*) chunks, sum(length(chunk))::bigint n_chars from ch group by 1")
def chunk_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunker called from SQL."""
    chunk.register_sql(spark)
    table(spark, sf_dir, "documents").createOrReplaceTempView("quillspark_documents")
    return spark.sql("select d.doc_id, count(*) as chunks, sum(length(c.chunk)) as n_chars from quillspark_documents d, lateral chunk_text(d.text) c group by d.doc_id")


@register("r69_context_fields", f"with {_bm25_sql(k=5)}, h as (select br.query_id, br.rank, '#' || rank || ' (' || printf('%.4f', round(round(score, 6), 2)) || ') ' || coalesce(d.source, '') || ' <' || d.doc_id || '> ' || coalesce(d.lang, '') || ': ' || d.text item from br join documents d on d.doc_id = br.id) select query_id, md5(string_agg(item, '|' order by rank)) digest from h group by 1")
def context_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All fields of the item template."""
    hits = _hits(spark, sf_dir).join(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "lang"), "id").withColumn("score", F.round("score", 2))
    return rag.context(hits, "#{index} ({score}) {title} <{id}> {metadata.lang}: {content}", "|", {"lang": F.col("lang")}).select("query_id", F.md5("context").alias("digest"))


@register("r70_stream_bm25", ORACLE_SQL["r26_bm25_after_delete"])
def stream_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keywords of a stream: documents first, then some of them deleted."""
    docs, at = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"), shared(spark)
    dead = table(spark, sf_dir, "labels").where("quality = 0").select(F.col("doc_id").alias("id")).distinct()
    feeds = docs.withColumn("seq", F.lit(1)).withColumn("deleted", F.lit(False)), dead.select("id", F.lit(None).cast("string").alias("text"), F.lit(2).alias("seq"), F.lit(True).alias("deleted"))
    stream = spark.readStream.schema(feeds[0].schema).option("maxFilesPerTrigger", ingest.FILES_PER_BATCH)
    # files as the scans are split: gathered by sequence, all documents would be one task's
    for feed in feeds:
        feed.write.mode("append").parquet(f"{at}/in")
        ingest.index_terms(stream.parquet(f"{at}/in"), f"{at}/terms", f"{at}/log").awaitTermination()
    return _ranked(ingest.search_terms(spark, f"{at}/terms", questions(spark, sf_dir), 10))
