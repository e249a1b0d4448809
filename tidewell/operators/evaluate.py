"""Retrieval evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.functions.text import path_matches


def metrics(runs: DataFrame, k: int, match=None) -> DataFrame:
    """recall, precision, mrr and ndcg at k of each row; runs: id, results (in order), expected.

    match(a, b) says whether a result is an expected item (equal by default; path_matches for paths).
    Recall with nothing expected is 1, precision without results 0. A result that repeats counts once in ndcg.
    """
    same = match or (lambda a, b: a == b)
    top = runs.withColumn("top", F.slice("results", 1, k))
    hit = F.transform("top", lambda r: F.exists("expected", lambda e: same(r, e)))
    rows = top.withColumn("hit", hit)
    found = F.size(F.filter("expected", lambda e: F.exists("top", lambda r: same(r, e))))
    recall = F.when(F.size("expected") == 0, 1.0).otherwise(found / F.size("expected"))
    precision = F.when(F.size("top") == 0, 0.0).otherwise(F.size(F.filter("hit", lambda x: x)) / F.size("top"))
    first = F.array_position("hit", True)
    mrr = F.when(first > 0, 1 / first).otherwise(0.0)
    gain = lambda i: 1 / F.log2(i + 2.0)
    dcg = F.aggregate(F.transform("top", lambda r, i: F.when(F.get("hit", i) & (F.array_position("top", r) == i + 1), gain(i)).otherwise(0.0)), F.lit(0.0), lambda s, x: s + x)
    n = F.least(F.lit(k), F.size("expected"))
    ideal = F.aggregate(F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: gain(i)), F.lit(0.0), lambda s, x: s + x)
    return rows.select("id", recall.alias("recall"), precision.alias("precision"), mrr.alias("mrr"), F.when(n == 0, 0.0).otherwise(dcg / ideal).alias("ndcg"))


def path_metrics(runs: DataFrame, k: int) -> DataFrame:
    """The same, with paths equal up to a prefix that ends at a slash."""
    return metrics(runs, k, path_matches)


def summary(rows: DataFrame, *keys: str) -> DataFrame:
    """Means of all metrics, by keys."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), *[F.avg(c).alias(c) for c in ("recall", "precision", "mrr", "ndcg") if c in rows.columns])


def compare(before: DataFrame, after: DataFrame, least: float = 0.01) -> DataFrame:
    """How many queries got better and worse by category, and the change of the mean."""
    both = before.select("id", "category", F.col("score").alias("b")).join(after.select("id", F.col("score").alias("a")), "id")
    change: Column = F.col("a") - F.col("b")
    return both.groupBy("category").agg(F.count_if(change > least).alias("improved"), F.count_if(change < -least).alias("degraded"), (F.avg("a") - F.avg("b")).alias("delta"))
