"""Filters as data, compiled to boolean columns.

A leaf is {"field", "operator", "value"} with eq, ne, gt, gte, lt, lte, in or
contains; a node is {"operator": "and" | "or", "filters": [...]}. Conditions are
true or false, never null: a missing field makes every leaf false, ne among
them. Equality heeds types (1 is not "1"); order compares numbers if either
side is one, else text. An empty node, and as well as or, is true; an unknown
operator is false.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_ORDER = {"gt": lambda a, b: a > b, "gte": lambda a, b: a >= b, "lt": lambda a, b: a < b, "lte": lambda a, b: a <= b}


def _number(value) -> float | None:
    """A literal as a number, as comparisons with numbers take it."""
    if isinstance(value, bool):
        return float(value)
    if isinstance(value, (int, float)):
        return float(value)
    if isinstance(value, str):
        try:
            return float(value) if value.strip() else 0.0
        except ValueError:
            return None
    return 0.0 if value is None else None


def _kind(value) -> str:
    return "bool" if isinstance(value, bool) else "number" if isinstance(value, (int, float)) else "text" if isinstance(value, str) else "null" if value is None else "other"


class Typed:
    """Fields that are columns, nested ones by dotted path; SQL null is a missing field."""

    def __init__(self, schema: T.StructType):
        self.schema = schema

    def _type(self, field: str) -> T.DataType | None:
        kind: T.DataType = self.schema
        for name in field.split("."):
            if not isinstance(kind, T.StructType) or name not in kind.fieldNames():
                return None
            kind = kind[name].dataType
        return kind

    def leaf(self, field: str, operator: str, value) -> Column:
        kind = self._type(field)
        if kind is None:
            return F.lit(False)
        column = F.col(".".join(f"`{n}`" for n in field.split(".")))
        own = "bool" if isinstance(kind, T.BooleanType) else "number" if isinstance(kind, T.NumericType) else "text" if isinstance(kind, (T.StringType, T.TimestampType, T.DateType)) else "array" if isinstance(kind, T.ArrayType) else "other"
        if operator in ("eq", "ne"):
            if own == _kind(value):
                return column == F.lit(value) if operator == "eq" else column != F.lit(value)
            return F.lit(False) if operator == "eq" else column.isNotNull()
        if operator in _ORDER:
            compare = _ORDER[operator]
            if own == "text" and isinstance(value, str):
                return compare(column, F.lit(value))
            if isinstance(kind, T.IntegralType) and isinstance(value, int) and not isinstance(value, bool):
                # no cast stands between the column and the scan
                return compare(column, F.lit(value))
            if own in ("number", "bool", "text") and (number := _number(value)) is not None:
                left = column.cast("double") if own != "text" else F.when(F.trim(column) == "", F.lit(0.0)).otherwise(column.try_cast("double"))
                return compare(left, F.lit(number))
            return F.lit(False)
        if operator == "in":
            same = [v for v in value if own == _kind(v)] if isinstance(value, (list, tuple)) else []
            return column.isin(*same) if same else F.lit(False)
        if operator == "contains":
            if own == "array":
                fits = _kind(value) == ("bool" if isinstance(kind.elementType, T.BooleanType) else "number" if isinstance(kind.elementType, T.NumericType) else "text")
                return F.array_contains(column, value) if fits else F.lit(False)
            return column.contains(value) if own == "text" and isinstance(value, str) else F.lit(False)
        return F.lit(False)


class Json:
    """Fields by dotted path inside one column of JSON text, or VARIANT."""

    def __init__(self, column: Column, is_variant: bool = False):
        self.data = column if is_variant else F.try_parse_json(column)

    def leaf(self, field: str, operator: str, value) -> Column:
        path = "$" + "".join(f"['{n}']" if not n.isidentifier() else f".{n}" for n in field.split("."))
        held = F.try_variant_get(self.data, path, "variant")
        kind = F.schema_of_variant(held)
        is_text, is_bool = kind == "STRING", kind == "BOOLEAN"
        is_number = kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL")
        text, number = F.try_variant_get(self.data, path, "string"), F.try_variant_get(self.data, path, "double")
        truth = F.try_variant_get(self.data, path, "boolean")

        def equal(v) -> Column:
            k = _kind(v)
            if k == "text":
                return is_text & (text == v)
            if k == "number":
                return is_number & (number == float(v))
            if k == "bool":
                return is_bool & (truth == v)
            return kind == "VOID" if k == "null" else F.lit(False)

        if operator == "eq":
            return equal(value)
        if operator == "ne":
            return kind.isNotNull() & ~F.coalesce(equal(value), F.lit(False))
        if operator in _ORDER:
            compare = _ORDER[operator]
            as_number = F.when(is_number, number).when(is_bool, truth.cast("double")).when(kind == "VOID", F.lit(0.0))
            if isinstance(value, str):
                as_text = is_text & compare(text, F.lit(value))
                n = _number(value)
                return F.coalesce(as_text, F.lit(False)) | (compare(as_number, F.lit(n)) if n is not None else F.lit(False))
            n = _number(value)
            return compare(F.coalesce(as_number, F.when(is_text, F.when(F.trim(text) == "", F.lit(0.0)).otherwise(text.try_cast("double")))), F.lit(n)) if n is not None else F.lit(False)
        if operator == "in":
            return reduce(lambda a, b: a | b, [F.coalesce(equal(v), F.lit(False)) for v in value], F.lit(False)) if isinstance(value, (list, tuple)) else F.lit(False)
        if operator == "contains":
            items = F.try_variant_get(self.data, path, "array<variant>")
            k = _kind(value)
            to = {"text": "string", "number": "double", "bool": "boolean"}.get(k)
            inside = F.lit(False)
            if to:
                inside = F.exists(items, lambda x: F.coalesce((F.schema_of_variant(x).isin("STRING") if k == "text" else F.schema_of_variant(x).isin("BOOLEAN") if k == "bool" else F.schema_of_variant(x).isin("BIGINT", "DOUBLE", "FLOAT") | F.schema_of_variant(x).startswith("DECIMAL")) & (F.try_variant_get(x, "$", to) == value), F.lit(False)))
            in_text = is_text & text.contains(value) if k == "text" else F.lit(False)
            return F.coalesce(in_text, F.lit(False)) | F.coalesce(inside, F.lit(False))
        return F.lit(False)


def condition(spec: dict | None, fields: Typed | Json) -> Column:
    """The filter for where(), in which null counts as false: plain comparisons, which a scan can take over."""
    if not spec:
        return F.lit(True)
    if "filters" in spec:
        parts = [condition(f, fields) for f in spec["filters"]]
        if not parts:
            return F.lit(True)
        return reduce((lambda a, b: a & b) if spec.get("operator") == "and" else (lambda a, b: a | b), parts)
    return fields.leaf(spec["field"], spec["operator"], spec.get("value"))


def compile_filter(spec: dict | None, fields: Typed | Json) -> Column:
    """A boolean column, true or false in every row, so that it can be negated; no filter is true.

    There is no negation inside a filter, so null at a leaf makes the whole null
    exactly where false would make it false.
    """
    return F.coalesce(condition(spec, fields), F.lit(False))


def scoped(spec: dict | None, field: str, value) -> dict:
    """The filter behind a fixed {field eq value}, which callers can't lift."""
    own = {"field": field, "operator": "eq", "value": value}
    return {"operator": "and", "filters": [own, spec]} if spec else own


def host_allowed(url: Column, hosts: list[str]) -> Column:
    """True if the URL's host is in the list; so is what has no host, as relative addresses stay here."""
    host = F.lower(F.try_parse_url(url, F.lit("HOST")))
    return F.coalesce(host.isin(*[h.lower() for h in hosts]) if hosts else F.lit(False), F.lit(True)) | host.isNull()
