"""From ranked passages to a prompt and an answer with citations, for a table of questions at once."""

from __future__ import annotations

import json
import re
import time
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.errors import EngineError
from quillspark.functions import text as T
from quillspark.operators import fusion, search, sparse
from quillspark.session import cut

ITEM = "[{index}] {content}"
JOIN = "\n\n"
SYSTEM = "Answer from the passages below and name the ones you used by number. Say so if they don't hold the answer."
PROMPT = "{system}\n\nPassages:\n{context}\n\nQuestion: {question}\n\nAnswer:"
MAX_CONTEXT_TOKENS = 2000


@dataclass(frozen=True)
class Profile:
    """How questions are answered; loads from a JSON object of the same names."""

    top_k: int = 5
    hybrid: bool = True
    rerank: bool | str = False  # "noop": the list as it is, called reranked
    rerank_pool: bool = True
    item_template: str = ITEM
    join: str = JOIN
    system: str = SYSTEM
    template: str = PROMPT
    max_context_tokens: int = MAX_CONTEXT_TOKENS
    scope: tuple[str, object] | None = None
    stubs: bool = False  # hits that keywords alone found stay without their text, as a dense index alone would know them

    @classmethod
    def from_json(cls, text: str) -> Profile:
        """A profile from an object of the fields' names; unknown names are refused."""
        given = json.loads(text)
        if given.get("scope") is not None:
            given["scope"] = tuple(given["scope"])
        return cls(**given)


class Provider(Protocol):
    """A language model."""

    def is_available(self) -> bool: ...

    def generate(self, prompt: str, **options) -> str: ...

    def stream(self, prompt: str, **options) -> Iterator[str]: ...


class Extractive:
    """Answers without a model: the sentence of the prompt's passages that shares most words with its question."""

    def is_available(self) -> bool:
        return True

    def generate(self, prompt: str, **options) -> str:
        body, _, rest = prompt.rpartition("Question:")
        asked = set(re.findall(r"[a-z0-9]{2,}", rest.lower())) - set(T.STOPWORDS)
        best = max(re.split(r"(?<=[.!?])\s+", body), key=lambda s: len(asked & set(re.findall(r"[a-z0-9]{2,}", s.lower()))), default="")
        return best.strip() or T.NOTHING_FOUND

    def stream(self, prompt: str, **options) -> Iterator[str]:
        for word in self.generate(prompt, **options).split(" "):
            yield word + " "


class Cascade:
    """The first provider that is available and doesn't fail; once a stream has begun its failure is final."""

    def __init__(self, providers: list[Provider]):
        self.providers = providers

    def is_available(self) -> bool:
        return any(p.is_available() for p in self.providers)

    def generate(self, prompt: str, **options) -> str:
        last: Exception | None = None
        for p in self.providers:
            if p.is_available():
                try:
                    return p.generate(prompt, **options)
                except Exception as e:
                    last = e
        raise EngineError("no language model answered", "NO_PROVIDER") from last

    def stream(self, prompt: str, **options) -> Iterator[str]:
        last: Exception | None = None
        for p in self.providers:
            if not p.is_available():
                continue
            begun = False
            try:
                for piece in p.stream(prompt, **options):
                    begun = True
                    yield piece
                return
            except Exception as e:
                if begun:
                    raise
                last = e
        raise EngineError("no language model answered", "NO_PROVIDER") from last


def context(hits: DataFrame, item_template: str = ITEM, join: str = JOIN, fields: dict[str, Column] | None = None) -> DataFrame:
    """query_id, context: each query's hits (query_id, id, rank, score, content), filled into the template in order.

    {index}, {score} to four places, {content}, {title}, {url}, {id} and
    {metadata.x} for the columns in fields are replaced, literally.
    """
    values = {"index": F.col("rank"), "score": F.format_string("%.4f", F.col("score")), "content": F.col("content")}
    for name in ("title", "url"):
        values[name] = F.col(name) if name in hits.columns else F.lit("")
    values["id"] = F.col("id")
    values |= {f"metadata.{k}": c for k, c in (fields or {}).items()}
    item = T.fill(F.lit(item_template), values)
    listed = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", item.alias("item")))).alias("items"))
    return listed.select("query_id", F.array_join(F.transform("items", lambda x: x["item"]), join).alias("context"))


def citations(hits: DataFrame) -> DataFrame:
    """query_id, id, score, rank and a snippet of each hit."""
    title = F.col("title") if "title" in hits.columns else F.lit(None).cast("string")
    order = Window.partitionBy("query_id").orderBy("rank")
    return hits.select("query_id", "id", "score", F.row_number().over(order).alias("rank"), T.snippet(F.col("content"), title).alias("snippet"))


def prompts(hits: DataFrame, queries: DataFrame, profile: Profile = Profile()) -> DataFrame:
    """query_id, prompt, context_tokens for every query, also for those without hits."""
    found = context(hits, profile.item_template, profile.join)
    every = queries.join(found, "query_id", "left").withColumn("context", F.coalesce("context", F.lit(T.NOTHING_FOUND)))
    most = T.truncate(F.col("context"), profile.max_context_tokens)
    return every.select("query_id", T.prompt(F.lit(profile.template), F.lit(profile.system), most, F.col("query")).alias("prompt"), T.char_tokens(most).alias("context_tokens"))


def retrieve(docs: DataFrame, queries: DataFrame, profile: Profile = Profile(), where: Column | None = None, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """query_id, id, rank, score, content: what each query is answered from. A scope narrows both lists."""
    rows = docs if profile.scope is None else docs.where(F.coalesce(F.col(profile.scope[0]) == F.lit(profile.scope[1]), F.lit(False)))
    rows = rows if where is None else rows.where(where)
    real = profile.rerank and profile.rerank != "noop"
    pool = profile.top_k * 4 if real and profile.rerank_pool else profile.top_k
    if profile.hybrid:
        hits = fusion.hybrid(rows, queries, pool, id_col=id_col, text_col=text_col)
    else:
        hits = sparse.bag_cosine(rows, queries, pool, id_col, text_col)
    stub = F.col("dense_rank").isNull() if profile.hybrid and profile.stubs else F.lit(False)
    hits = search.hydrate(hits.select("query_id", "id", "score", "rank", stub.alias("_stub")), rows.select(F.col(id_col).alias("id"), F.col(text_col).alias("content")), keep=["content"])
    hits = hits.withColumn("content", F.when(F.col("_stub"), F.lit("")).otherwise(F.col("content"))).drop("_stub")
    if real:
        hits = fusion.lexical_rerank(hits.join(queries, "query_id"), content="content").withColumn("rank", F.col("new_rank")).where(F.col("rank") <= profile.top_k)
    return hits.select("query_id", "id", "rank", "score", "content")


@dataclass
class Answer:
    query_id: object
    answer: str
    citations: list[dict]
    prompt_tokens: int
    timings_ms: dict[str, float] = field(default_factory=dict)


def answer(docs: DataFrame, queries: DataFrame, provider: Provider | None = None, profile: Profile = Profile(), id_col: str = "id", text_col: str = "text") -> list[Answer]:
    """Every query answered here and now, for a caller who waits: retrieval and prompts are one plan over all of them, the model runs on the driver. answers() is for tables of queries."""
    provider = provider or Extractive()
    began = time.time()
    hits = retrieve(docs, queries, profile, id_col=id_col, text_col=text_col).persist()
    try:
        cited = citations(hits).orderBy("query_id", "rank").collect()
        asked = prompts(hits, queries, profile).orderBy("query_id").collect()
    finally:
        hits.unpersist()
    retrieved = time.time()
    out, by_query = [], defaultdict(list)
    for c in cited:
        by_query[c["query_id"]].append(c.asDict())
    for row in asked:
        t = time.time()
        text = provider.generate(row["prompt"], max_tokens=512, temperature=0.7, top_p=0.9)
        own = by_query[row["query_id"]]
        out.append(Answer(row["query_id"], text, own, row["context_tokens"], {"retrieval": (retrieved - began) * 1000, "generation": (time.time() - t) * 1000}))
    return out


def answers(docs: DataFrame, queries: DataFrame, make=Extractive, profile: Profile = Profile(), id_col: str = "id", text_col: str = "text", **options) -> DataFrame:
    """query_id, answer, context_tokens, citations of every query as a plan: make() builds the model once in each worker.

    Nothing is gathered on the driver; a model that fails fails the job, so give
    a Cascade where another should take over.
    """
    hits = cut(retrieve(docs, queries, profile, id_col=id_col, text_col=text_col))
    asked = prompts(hits, queries, profile)
    kind = asked.schema["query_id"].dataType.simpleString()

    def generate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for batch in batches:
            yield batch.assign(answer=[model.generate(p, **options) for p in batch["prompt"]])[["query_id", "answer", "context_tokens"]]

    written = asked.mapInPandas(generate, f"query_id {kind}, answer string, context_tokens bigint")
    cited = citations(hits).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "id", "score", "snippet"))).alias("citations"))
    return written.join(cited, "query_id", "left")


def answer_stream(docs: DataFrame, query: str, provider: Provider | None = None, profile: Profile = Profile(), id_col: str = "id", text_col: str = "text") -> Iterator[tuple[str, object]]:
    """("retrieval", hits), ("generation", text) again and again, ("complete", whole text)."""
    provider = provider or Extractive()
    queries = docs.sparkSession.createDataFrame([(0, query)], "query_id int, query string")
    hits = retrieve(docs, queries, profile, id_col=id_col, text_col=text_col).persist()
    yield "retrieval", [r.asDict() for r in citations(hits).orderBy("rank").collect()]
    prompt = prompts(hits, queries, profile).first()["prompt"]
    hits.unpersist()
    whole = []
    for piece in provider.stream(prompt):
        whole.append(piece)
        yield "generation", piece
    yield "complete", "".join(whole)
