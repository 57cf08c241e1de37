"""Operations by name with checked parameters, as assistants call them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import functions as F

from quillspark.errors import EngineError, InvalidParams
from quillspark.functions.filters import scoped
from quillspark.operators import rag
from quillspark.sources.collection import Collection


@dataclass(frozen=True)
class Tool:
    name: str
    description: str
    schema: dict
    run: Callable[[dict], object]


@dataclass(frozen=True)
class Scope:
    """A field that every call is held to; enforce_on lists the tools it binds (none: all)."""

    field: str
    value: object
    enforce_on: tuple[str, ...] = ()

    def binds(self, tool: str) -> bool:
        return not self.enforce_on or tool in self.enforce_on


def _type(value) -> str:
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, (int, float)):
        return "number"
    return {str: "string", list: "array", tuple: "array", dict: "object"}.get(type(value), "null" if value is None else type(value).__name__)


def check_params(params: dict, schema: dict) -> None:
    """Raises on a missing, unknown (if closed), mistyped, unlisted or out-of-range parameter; null passes as any type."""
    for name in schema.get("required", []):
        if name not in params:
            raise InvalidParams(f"parameter {name} is missing", field=name)
    own = schema.get("properties", {})
    for name, value in params.items():
        spec = own.get(name)
        if spec is None:
            if schema.get("additionalProperties") is False:
                raise InvalidParams(f"there is no parameter {name}", field=name)
            continue
        kind = spec.get("type")
        if kind and value is not None and _type(value) != kind:
            raise InvalidParams(f"parameter {name} must be of type {kind}, not {_type(value)}", field=name)
        if "enum" in spec and value not in spec["enum"]:
            raise InvalidParams(f"parameter {name} must be one of {spec['enum']}", field=name)
        if kind == "number" and value is not None:
            if "minimum" in spec and value < spec["minimum"]:
                raise InvalidParams(f"parameter {name} must be at least {spec['minimum']}", field=name)
            if "maximum" in spec and value > spec["maximum"]:
                raise InvalidParams(f"parameter {name} must be at most {spec['maximum']}", field=name)


def _count(most: int) -> dict:
    return {"type": "number", "minimum": 1, "maximum": most}


class Tools:
    """search_vectors, insert_document, delete_document and rag_query over a collection."""

    def __init__(self, collection: Collection, scope: Scope | None = None, provider: rag.Provider | None = None, profile: rag.Profile = rag.Profile()):
        self.collection, self.scope, self.provider, self.profile = collection, scope, provider, profile
        text, obj = {"type": "string"}, {"type": "object"}
        tools = [
            Tool("search_vectors", "Rows nearest to a text or vector.", {"required": [], "properties": {"query": text, "vector": {"type": "array"}, "k": _count(100), "filter": obj}}, self._search),
            Tool("insert_document", "Stores a text with its metadata.", {"required": ["text"], "properties": {"text": text, "metadata": obj, "id": text, "vector": {"type": "array"}}}, self._insert),
            Tool("delete_document", "Removes a row by id.", {"required": ["id"], "properties": {"id": text}}, self._delete),
            Tool("rag_query", "Answers a question from the stored texts.", {"required": ["query"], "properties": {"query": text, "topK": _count(20)}}, self._answer),
        ]
        self.tools = {t.name: t for t in tools}

    def names(self) -> list[str]:
        return list(self.tools)

    def execute(self, name: str, params: dict):
        tool = self.tools.get(name)
        if tool is None:
            raise EngineError(f"there is no tool {name}", "UNKNOWN_TOOL", name=name)
        check_params(params, tool.schema)
        return tool.run(params)

    def _filter(self, tool: str, spec: dict | None) -> dict | None:
        return scoped(spec, self.scope.field, self.scope.value) if self.scope and self.scope.binds(tool) else spec

    def _search(self, p: dict) -> list[dict]:
        found = self.collection.search(int(p.get("k") or 5), vector=p.get("vector"), text=p.get("query"), filter=self._filter("search_vectors", p.get("filter")))
        return [r.asDict() for r in found.collect()]

    def _insert(self, p: dict) -> str:
        metadata = dict(p.get("metadata") or {})
        if self.scope and self.scope.binds("insert_document"):
            metadata[self.scope.field] = self.scope.value
        return self.collection.insert({"id": p.get("id"), "text": p["text"], "vector": p.get("vector"), "metadata": metadata})

    def _delete(self, p: dict) -> bool:
        if self.scope and self.scope.binds("delete_document") and self.collection.filter(self._filter("delete_document", None)).where(f"id = {_quoted(p['id'])}").isEmpty():
            return False
        return self.collection.delete(p["id"])

    def _answer(self, p: dict) -> dict:
        rows = self.collection.filter(self._filter("rag_query", None)).select("id", F.get_json_object("metadata", "$.content").alias("text"))
        asked = self.collection.spark.createDataFrame([(0, p["query"])], "query_id int, query string")
        got = rag.answer(rows, asked, self.provider, replace(self.profile, top_k=int(p.get("topK") or self.profile.top_k)))[0]
        return {"answer": got.answer, "citations": got.citations}


def _quoted(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
