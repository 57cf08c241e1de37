"""How good and how fast retrieval is, as aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.session import small


def recall_at_k(found: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """One row: queries, hits, recall of found against truth (both query_id, id)."""
    hits = found.join(truth.select("query_id", "id"), ["query_id", "id"], "left_semi").agg(F.count("*").alias("hits"))
    asked = truth.agg(F.count_distinct("query_id").alias("queries"))
    return asked.crossJoin(hits).withColumn("recall", F.when(F.col("queries") > 0, F.col("hits") / (F.col("queries") * k)).otherwise(F.lit(0.0)))


def latency_summary(rows: DataFrame, value: str, by: list[str] = ()) -> DataFrame:
    """n, min, max, mean, median, and p95 and p99 by the ceiling rule."""
    v = F.col(value).cast("double")
    return rows.groupBy(*by).agg(
        F.count(v).alias("n"), F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean"), F.median(v).alias("median"),
        F.expr(f"percentile_disc(0.95) within group (order by {value})").alias("p95"), F.expr(f"percentile_disc(0.99) within group (order by {value})").alias("p99"),
    )


def floor_percentile(rows: DataFrame, value_col: str, shares: dict[str, float], by: list[str]) -> DataFrame:
    """For each share p the value at place min(n - 1, floor(p n)) of the sorted values, counted from 0.

    Sorting by groups in a window keeps no list in memory.
    """
    part = Window.partitionBy(*by)
    ranked = rows.where(F.col(value_col).isNotNull()).select(*by, F.col(value_col).cast("double").alias("v"), (F.row_number().over(part.orderBy(value_col)) - 1).alias("at"), F.count("*").over(part).alias("n"))
    at = {name: F.least(F.col("n") - 1, F.floor(F.col("n") * p)) for name, p in shares.items()}
    return ranked.groupBy(*by).agg(*(F.max(F.when(F.col("at") == place, F.col("v"))).alias(name) for name, place in at.items()))


def score_spread(hits: DataFrame, by: list[str] = ()) -> DataFrame:
    """Distinct scores, their variance (mean square less squared mean), and whether they are real: more than one, and spread."""
    s = F.col("score")
    out = hits.groupBy(*by).agg(F.count_distinct(F.round(s, 6)).alias("distinct_scores"), (F.avg(s * s) - F.avg(s) * F.avg(s)).alias("variance"))
    return out.withColumn("real_scores", (F.col("distinct_scores") > 1) & (F.col("variance") > 1e-9))


def expected_ranks(ranked: DataFrame, expected: DataFrame, k: int) -> DataFrame:
    """queries, recall (expected id among the first k) and mean_rank; an absent id ranks behind the list.

    ranked: query_id, id, rank; expected: query_id, expected_id. A miss is a
    miss however short its list is.
    """
    size = ranked.groupBy("query_id").agg(F.count("*").alias("size"))
    hit = ranked.join(small(expected), "query_id").where("id = expected_id").groupBy("query_id").agg(F.min("rank").alias("hit"))
    rows = expected.join(size, "query_id", "left").join(hit, "query_id", "left")
    rank = F.coalesce("hit", F.coalesce("size", F.lit(0)) + 1)
    return rows.agg(F.count("*").alias("queries"), F.avg((F.coalesce("hit", F.lit(2**31 - 1)) <= k).cast("double")).alias("recall"), F.avg(rank.cast("double")).alias("mean_rank"))


def throughput(rows: DataFrame, seconds: Column, by: list[str] = ()) -> DataFrame:
    """operations, total_seconds, per_second and mean_ms."""
    return rows.groupBy(*by).agg(F.count("*").alias("operations"), F.sum(seconds).alias("total_seconds")).withColumn("per_second", F.col("operations") / F.nullif("total_seconds", F.lit(0.0))).withColumn("mean_ms", 1000 * F.col("total_seconds") / F.col("operations"))


def hit_rate(rows: DataFrame, hit: Column, by: list[str] = ()) -> DataFrame:
    return rows.groupBy(*by).agg(F.count("*").alias("lookups"), F.avg(hit.cast("double")).alias("hit_rate"))


def growth(rows: DataFrame, value: str, order: str, by: list[str] = ()) -> DataFrame:
    """min, max, mean and the last value less the first."""
    v = F.col(value)
    return rows.groupBy(*by).agg(F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean"), (F.max_by(v, F.col(order)) - F.min_by(v, F.col(order))).alias("growth"))


def regressions(before: DataFrame, after: DataFrame, limit: float = 0.1) -> DataFrame:
    """name, before, after, ratio of what became slower by more than limit (both: name, seconds)."""
    both = before.select("name", F.col("seconds").alias("before")).join(after.select("name", F.col("seconds").alias("after")), "name")
    return both.withColumn("ratio", F.col("after") / F.col("before")).where(F.col("ratio") > 1 + limit)
