"""Quantised vectors: int8 by vector, int4 by block, and the formats that only carry a name."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.functions.bind import let

BLOCK = 32
FORMATS = ("fp32", "fp16", "int8", "int4")


def scale(v: Column) -> Column:
    """The largest absolute component."""
    return F.array_max(F.transform(v, lambda x: F.abs(x))).cast("double")


def _round(x: Column) -> Column:
    # halves go up
    return F.floor(x + 0.5)


def int8(v: Column) -> Column:
    """Components over the largest one, times 127, rounded; zeros for a zero vector."""
    return let(scale(v), lambda s: F.transform(v, lambda x: F.when(s == 0, F.lit(0).cast("bigint")).otherwise(_round(x.cast("double") / s * 127)).cast("int")))


def int8_back(q: Column, s: Column) -> Column:
    return let(s, lambda one: F.transform(q, lambda x: x.cast("double") * one / 127))


def block_scales(v: Column, block: int = BLOCK) -> Column:
    starts = F.sequence(F.lit(1), F.greatest(F.size(v), F.lit(1)), F.lit(block))
    return F.transform(starts, lambda i: F.coalesce(scale(F.slice(v, i, block)), F.lit(0.0)))


def int4(v: Column, block: int = BLOCK) -> Column:
    """Components from -7 to 7 over their block's largest."""
    def all_by(s: Column) -> Column:
        def one(x: Column, i: Column) -> Column:
            b = F.element_at(s, (F.floor(i / block) + 1).cast("int"))
            return F.when(b == 0, F.lit(0).cast("bigint")).otherwise(F.least(F.lit(7), F.greatest(F.lit(-7), _round(x.cast("double") / b * 7)))).cast("int")

        return F.transform(v, one)

    return let(block_scales(v, block), all_by)


def int4_packed(q: Column) -> Column:
    """Two of int4() to a number from 0 to 255, the first one high."""
    def packed(codes: Column) -> Column:
        size = F.size(codes)
        pairs = F.sequence(F.lit(1), F.greatest(size, F.lit(1)), F.lit(2))
        return F.transform(pairs, lambda i: F.shiftleft(F.element_at(codes, i) + 7, 4) + F.when(i < size, F.element_at(codes, F.least(i + 1, size)) + 7).otherwise(F.lit(0)))

    return let(q, packed)


def int4_unpacked(packed: Column, size: Column) -> Column:
    both = F.flatten(F.transform(packed, lambda b: F.array(F.shiftright(b, 4) - 7, b.bitwiseAND(15) - 7)))
    return F.slice(both, F.lit(1), size)


def int4_back(q: Column, scales: Column, block: int = BLOCK) -> Column:
    return let(scales, lambda s: F.transform(q, lambda x, i: x.cast("double") * F.element_at(s, (F.floor(i / block) + 1).cast("int")) / 7))


def quantise(v: Column, form: str = "int8", block: int = BLOCK) -> Column:
    """A struct of data, format and scales; fp16 keeps the data and an unknown format is fp32."""
    if form == "int8":
        return F.struct(int8(v).alias("data"), F.lit("int8").alias("format"), F.array(scale(v)).alias("scales"))
    if form == "int4":
        return F.struct(int4(v, block).alias("data"), F.lit("int4").alias("format"), block_scales(v, block).alias("scales"))
    return F.struct(v.alias("data"), F.lit(form if form in FORMATS else "fp32").alias("format"), F.array().cast("array<double>").alias("scales"))


def dequantise(q: Column, form: str, block: int = BLOCK) -> Column:
    if form == "int8":
        return int8_back(q["data"], q["scales"][0])
    if form == "int4":
        return int4_back(q["data"], q["scales"], block)
    return q["data"]
