"""Collections as JSON and newline-delimited JSON, out and in."""

from __future__ import annotations

import json
import time
import warnings

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.errors import ImportFailed
from quillspark.session import cut

VERSION = "1.0.0"
ENTRY = "struct<id:string,vector:array<float>,metadata:string,timestamp:bigint>"
#: How the lines before and after an export's vectors end and begin.
_OPEN, _CLOSE = ',"vectors":[', '],"index":'


def numbered(rows: DataFrame, chunk: int, id_col: str = "id") -> DataFrame:
    """rows with chunk_id: runs of `chunk` rows by id, numbered from 0 without gathering them in one task.

    Rows are sorted by range into partitions, counted, and numbered within. The
    ranges are kept: drawn again for the count they could differ.
    """
    parts = cut(rows.repartitionByRange(F.col(id_col)).withColumn("_part", F.spark_partition_id()))
    within = F.row_number().over(Window.partitionBy("_part").orderBy(id_col)) - 1
    counts = parts.groupBy("_part").agg(F.count("*").alias("n"))
    # one row for each partition
    before = counts.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    placed = parts.withColumn("_within", within).join(F.broadcast(before), "_part")
    return placed.withColumn("chunk_id", F.floor((F.col("_within") + F.col("before")) / chunk)).drop("_part", "_within", "before")


def progress(rows: DataFrame, chunk: int, id_col: str = "id") -> DataFrame:
    """chunk_id, n, loaded (running), total, percent. All chunks but the last are full, so what is loaded follows from the number alone."""
    counts = numbered(rows.select(id_col), chunk, id_col).groupBy("chunk_id").agg(F.count("*").alias("n"))
    # one row
    total = rows.agg(F.count("*").alias("total"))
    loaded = F.least((F.col("chunk_id") + 1) * chunk, F.col("total"))
    return counts.crossJoin(F.broadcast(total)).select("chunk_id", "n", loaded.alias("loaded"), "total").withColumn("percent", F.col("loaded") * 100.0 / F.col("total"))


def ndjson_lines(rows: DataFrame, chunk: int = 100, metric: str = "cosine", exported_at: int | None = None) -> DataFrame:
    """Lines tagged metadata, vectors (chunks) and index, as one text column with their order."""
    spark = rows.sparkSession
    entry = F.struct("id", "vector", "metadata", "timestamp")
    chunks = numbered(rows, chunk).groupBy("chunk_id").agg(F.array_sort(F.collect_list(entry), lambda a, b: F.when(a["id"] < b["id"], -1).when(a["id"] > b["id"], 1).otherwise(0)).alias("data"))
    vectors = chunks.select((F.col("chunk_id") + 1).alias("at"), F.to_json(F.struct(F.lit("vectors").alias("type"), "data")).alias("value"))
    facts = rows.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size("vector")), F.lit(0)).alias("d"))
    head = facts.select(F.lit(0).cast("bigint").alias("at"), F.to_json(F.struct(F.lit("metadata").alias("type"), F.struct(F.lit(VERSION).alias("version"), F.struct(F.col("d").alias("dimensions"), F.lit(metric).alias("metric")).alias("config"), F.struct(F.lit(exported_at or int(time.time() * 1000)).alias("exportedAt"), F.col("n").alias("vectorCount"), F.col("d").alias("dimensions")).alias("metadata")).alias("data"))).alias("value"))
    tail = spark.range(1).select(F.lit(2**62).alias("at"), F.to_json(F.struct(F.lit("index").alias("type"), F.lit("").alias("data"))).alias("value"))
    return head.unionByName(vectors).unionByName(tail)


def export_ndjson(rows: DataFrame, path: str, chunk: int = 100, metric: str = "cosine") -> None:
    """Files of lines; their order is that of the files' names."""
    ndjson_lines(rows, chunk, metric).orderBy("at").select("value").write.mode("overwrite").text(path)


def export_json(rows: DataFrame, path: str, metric: str = "cosine") -> None:
    """One JSON object of the facts and vectors, a line for each vector: files of lines that make it up in the order of their names, so that no task holds it whole."""
    facts = rows.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size("vector")), F.lit(0)).alias("d"))
    config = F.to_json(F.struct(F.col("d").alias("dimensions"), F.lit(metric).alias("metric")))
    meta = F.to_json(F.struct(F.lit(int(time.time() * 1000)).alias("exportedAt"), F.col("n").alias("vectorCount"), F.col("d").alias("dimensions")))
    head = facts.select(F.lit(0).cast("bigint").alias("at"), F.concat(F.lit(f'{{"version":"{VERSION}","config":'), config, F.lit(_OPEN)).alias("value"))
    tail = facts.select(F.lit(2**62).alias("at"), F.concat(F.lit(_CLOSE + '"","metadata":'), meta, F.lit("}")).alias("value"))
    entry = F.to_json(F.struct("id", "vector", "metadata", "timestamp"))
    each = numbered(rows, 1).crossJoin(F.broadcast(facts)).select((F.col("chunk_id") + 1).alias("at"), F.concat(entry, F.when(F.col("chunk_id") + 1 < F.col("n"), ",").otherwise("")).alias("value"))
    head.unionByName(each).unionByName(tail).orderBy("at").select("value").write.mode("overwrite").text(path)


def _lines(spark: SparkSession, path: str) -> tuple[DataFrame, bool]:
    lines = spark.read.text(path).select(F.trim("value").alias("value")).where("value <> ''")
    # the beginnings alone: a line can be all of an export
    first = lines.select(F.substring("value", 1, 64).alias("value"), F.col("value").endswith("}").alias("whole")).limit(2).collect()
    tagged = bool(first) and all(x["value"].startswith("{") and x["whole"] for x in first) and (len(first) > 1 or '"type":"' in first[0]["value"].replace(" ", "")[:40])
    return (lines, True) if tagged else (spark.read.text(path, wholetext=True), False)


def _laid_out(spark: SparkSession, path: str) -> tuple[DataFrame, str] | None:
    """Rows and facts of what export_json() wrote, if every line is one of its own; the facts as JSON without the vectors."""
    lines = spark.read.text(path)
    v = F.col("value")
    head, tail = v.startswith('{"version":') & v.endswith(_OPEN), v.startswith(_CLOSE) & v.endswith("}")
    entry = ~head & v.startswith("{") & (v.endswith("}") | v.endswith("},"))
    found = lines.agg(F.count_if(head).alias("heads"), F.count_if(tail).alias("tails"), F.count_if(~(head | tail | entry)).alias("others"), F.max(F.when(head, v)).alias("head"), F.max(F.when(tail, v)).alias("tail")).first()
    if (found["heads"], found["tails"], found["others"]) != (1, 1, 0):
        return None
    rows = lines.where(entry).select(F.from_json(F.regexp_replace("value", ",$", ""), ENTRY).alias("e")).select("e.*")
    return rows, found["head"] + found["tail"]


def read_export(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    """Rows (id, vector, metadata, timestamp) and the envelope's facts, of either format, told apart by its lines.

    Lines with unknown tags are passed over.
    """
    laid = _laid_out(spark, path)
    lines, tagged = (None, False) if laid else _lines(spark, path)
    if laid:
        rows, source = laid
        source = json.dumps({k: v for k, v in json.loads(source).items() if k in ("version", "config", "metadata")})
    elif tagged:
        typed = lines.withColumn("type", F.get_json_object("value", "$.type"))
        rows = typed.where("type = 'vectors'").select(F.inline(F.from_json("value", f"data array<{ENTRY}>")["data"]))
        head = typed.where("type = 'metadata'").select(F.get_json_object("value", "$.data").alias("v")).first()
        source = head["v"] if head else "{}"
    else:
        rows = lines.select(F.inline(F.from_json("value", f"vectors array<{ENTRY}>")["vectors"]))
        facts = lines.select(*(F.get_json_object("value", p).alias(c) for p, c in (("$.version", "version"), ("$.config", "config"), ("$.metadata", "metadata")))).first()
        facts = facts.asDict() if facts else {}
        source = json.dumps({k: json.loads(v) if k != "version" and v else v for k, v in facts.items()})
    envelope = {"version": VERSION, "metadata": {}} | {k: v for k, v in json.loads(source).items() if v is not None}
    return rows, envelope


def decode_records(lines: DataFrame, value_col: str = "value") -> DataFrame:
    """id, vector, metadata, timestamp, error of stored records as JSON text.

    The vector is an array, or the object of numbered components that typed
    arrays become in JSON. A record without an id, a vector, metadata or a time
    says in error which it lacks; nothing is dropped.
    """
    text = F.col(value_col)
    array = F.from_json(F.get_json_object(text, "$.vector"), "array<float>")
    pairs = F.from_json(F.get_json_object(text, "$.vector"), "map<string,float>")
    numbered = F.transform(F.map_entries(pairs), lambda e: F.struct(e["key"].try_cast("int").alias("at"), e["value"].alias("x")))
    ordered = F.transform(F.array_sort(numbered), lambda e: e["x"])
    vector = F.when(F.get_json_object(text, "$.vector").startswith("{"), ordered).otherwise(array)
    out = lines.select(F.get_json_object(text, "$.id").alias("id"), vector.alias("vector"), F.get_json_object(text, "$.metadata").alias("metadata"), F.get_json_object(text, "$.timestamp").try_cast("bigint").alias("timestamp"))
    missing = F.array_compact(F.array(*(F.when(F.coalesce(bad, F.lit(True)), F.lit(name)) for name, bad in (("id", F.col("id") == ""), ("vector", F.size("vector") <= 0), ("metadata", F.col("metadata") == ""), ("timestamp", F.col("timestamp") == 0)))))
    return out.withColumn("error", F.when(F.size(missing) > 0, F.concat(F.lit("no "), F.array_join(missing, ", "))))


def validate(rows: DataFrame, envelope: dict, dimensions: int | None = None) -> None:
    """Warns of a later minor version than this one's. Raises unless the version's major is 1, all vectors have the dimensions and the count is that announced."""
    major = str(envelope.get("version", "")).split(".")[0]
    if major != "1":
        raise ImportFailed(f"version {envelope.get('version')!r} can't be read", version=envelope.get("version"))
    minor = (str(envelope["version"]).split(".") + ["0"])[1]
    if minor.isdigit() and int(minor) > int(VERSION.split(".")[1]):
        warnings.warn(f"version {envelope['version']} is later than {VERSION}: some of it may be passed over", stacklevel=2)
    facts = envelope.get("metadata") or {}
    want = dimensions or facts.get("dimensions")
    found = rows.agg(F.count("*").alias("n"), F.count_if(F.col("id").isNull() | F.col("vector").isNull()).alias("broken"), F.min(F.size("vector")).alias("low"), F.max(F.size("vector")).alias("high")).first()
    if found["broken"]:
        raise ImportFailed(f"{found['broken']} rows lack an id or a vector")
    if found["n"] and want and (found["low"], found["high"]) != (want, want):
        raise ImportFailed(f"vectors have {found['low']} to {found['high']} dimensions, not {want}", expected=want)
    if facts.get("vectorCount") and facts["vectorCount"] != found["n"]:
        raise ImportFailed(f"{found['n']} vectors, {facts['vectorCount']} announced")


def import_into(collection, path: str, clear: bool = True, check: bool = True) -> int:
    """Loads an export into a collection; without clear its rows are added, the latest of an id counts. Returns the rows read."""
    rows, envelope = read_export(collection.spark, path)
    if check:
        validate(rows, envelope, collection.dimensions)
    n = rows.count()
    if clear:
        collection.clear()
    collection.append(rows)
    return n
