"""Text as columns: tokens, sizes, sentences, cuts, escapes, templates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.errors import ESCAPES
from quillspark.functions.bind import let

STOPWORDS = sorted(
    "a an and are as at be been being but by did do does for from has have in is it its may must no not of on or "
    "shall that the these this those to was were which who whom with".split()
)
NOTHING_FOUND = "No relevant information found."


def tokenize(text: Column) -> Column:
    """Lower-case runs of a-z and 0-9, of two characters or more, without stop words; null for null."""
    words = F.split(F.regexp_replace(F.lower(text), r"[^a-z0-9\s]", " "), r"\s+")
    return F.filter(words, lambda w: (F.length(w) > 1) & ~w.isin(*STOPWORDS))


def trim_all(text: Column) -> Column:
    """Without white space of any kind at either end, \\r\\n as \\n."""
    return F.regexp_replace(F.regexp_replace(text, "\r\n", "\n"), r"^\s+|\s+$", "")


def char_tokens(text: Column) -> Column:
    """Tokens at four characters each, rounded up."""
    return F.ceil(F.length(text) / 4).cast("bigint")


def approx_tokens(text: Column) -> Column:
    """The larger of words and char_tokens()."""
    words = F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))
    return F.greatest(words.cast("bigint"), char_tokens(text))


def sentences(text: Column) -> Column:
    """Split at white space after a full stop, an exclamation or a question mark; trimmed, none of them empty."""
    marked = F.regexp_replace(trim_all(text), r"([.!?])\s+", "$1\u0001")
    return F.filter(F.transform(F.split(marked, "\u0001"), trim_all), lambda s: s != "")


def truncate(text: Column, max_tokens: int, suffix: str = "") -> Column:
    """At most max_tokens at four characters; cut after a sentence or line that ends in the last fifth, else with an ellipsis."""
    most = max_tokens * 4
    head = F.substring(text, 1, most)
    back = F.reverse(head)
    stop, line = F.locate(".", back), F.locate("\n", back)
    # 0 from the end: no such mark
    at = F.greatest(F.when(stop > 0, most - stop).otherwise(-1), F.when(line > 0, most - line).otherwise(-1))
    cut = F.when(at > most * 0.8, F.substring(head, F.lit(1), at + 1)).otherwise(F.concat(head, F.lit("...")))
    return F.when(F.length(text) <= most, text).otherwise(F.concat(cut, F.lit(suffix)))


def escape(text: Column) -> Column:
    for raw, entity in ESCAPES:
        text = F.replace(text, F.lit(raw), F.lit(entity))
    return text


def snippet(content: Column, title: Column, most: int = 280) -> Column:
    """The beginning of the content, else the title, else nothing."""
    return F.coalesce(F.when(F.length(content) > 0, F.substring(content, 1, most)), title, F.lit(""))


def fill(template: Column, values: dict[str, Column]) -> Column:
    """The template with each {name} replaced, everywhere and literally, in the order given; null is empty."""
    for name, value in values.items():
        template = F.replace(template, F.lit("{" + name + "}"), F.coalesce(value.cast("string"), F.lit("")))
    return template


def fill_first(template: Column, name: str, value: Column) -> Column:
    """Only the first {name} replaced."""
    mark = "{" + name + "}"
    at = F.locate(mark, template)
    rest = F.substring(template, at + len(mark), F.length(template))
    return F.when(at > 0, F.concat(F.substring(template, F.lit(1), at - 1), F.coalesce(value, F.lit("")), rest)).otherwise(template)


def prompt(template: Column, system: Column, context: Column, question: Column) -> Column:
    """system, context and question put in one after the other."""
    return fill_first(fill_first(fill_first(template, "system", system), "context", context), "question", question)


def string_hash(text: Column) -> Column:
    """h = 31 h + code over the characters, as a signed 32-bit number."""
    codes = F.transform(F.split(text, ""), lambda c: F.ascii(c).cast("bigint"))
    wrapped = F.aggregate(codes, F.lit(0).cast("bigint"), lambda h, c: F.pmod(h * 31 + c, F.lit(2**32)))
    return F.when(wrapped >= 2**31, wrapped - 2**32).otherwise(wrapped)


def hash_tokens(text: Column, most: int = 96) -> Column:
    """Ids of the first alphanumeric words by hash, then 102, padded with 0; 101 first if there is no word."""
    words = F.slice(F.regexp_extract_all(text, F.lit("([A-Za-z0-9]+)"), F.lit(1)), 1, most)
    ids = F.transform(words, lambda w: F.pmod(F.aggregate(F.transform(F.split(w, ""), lambda c: F.ascii(c).cast("bigint")), F.lit(0).cast("bigint"), lambda h, c: F.pmod(h * 31 + c, F.lit(2**32))), F.lit(30000)) + 1000)
    begun = F.when(F.size(ids) == 0, F.array(F.lit(101).cast("bigint"), F.lit(102).cast("bigint"))).otherwise(F.concat(ids, F.array(F.lit(102).cast("bigint"))))
    return F.slice(F.concat(begun, F.array_repeat(F.lit(0).cast("bigint"), most)), 1, most)


def version_major(version: Column) -> Column:
    return F.split(version, r"\.")[0].try_cast("int")


def word_windows(text: Column, size: int, overlap: int) -> Column:
    """Overlapping windows of words: structs of index and text."""
    return let(F.filter(F.split(text, r"\s+"), lambda w: w != ""), lambda words: _windows(words, size, overlap))


def _windows(words: Column, size: int, overlap: int) -> Column:
    step = size - overlap
    starts = F.sequence(F.lit(0), F.greatest(F.size(words) - 1, F.lit(0)), F.lit(step))
    cut = F.transform(starts, lambda s, i: F.struct(i.alias("index"), F.array_join(F.slice(words, s + 1, size), " ").alias("text")))
    return F.filter(cut, lambda c: c["text"] != "")


def parse_sizes(spec: str) -> list[int]:
    """'1k,10k' as [1000, 10000]."""
    out = []
    for part in (p.strip().lower() for p in spec.split(",")):
        if part:
            out.append(int(float(part[:-1]) * 1000) if part.endswith("k") else int(float(part[:-1]) * 1_000_000) if part.endswith("m") else int(part))
    return out
