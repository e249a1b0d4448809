"""Operator 2's slices: ids that repeat, or lack, are cut by their texts' hashes."""

import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidewell.llm import parsing


@pytest.fixture(scope="module")
def hot(spark):
    """Half of the rows have one id, a quarter none; one text fills a tenth of the hot id."""
    n = 1200
    i = F.col("i")
    id_ = F.when(i < n // 2, F.lit(77)).when(i < 3 * n // 4, F.lit(None)).otherwise(i).cast("long")
    text = F.when(i % 20 == 0, F.lit("one text many times")).otherwise(F.concat(F.lit("text number "), i.cast("string")))
    extra = [F.lit("x").alias(c) for c in ("slice", "own", "id", "version", "s", "first")]
    return spark.range(n).select(F.col("id").alias("i")).select(id_.alias("doc_id"), text.alias("text"), *extra)


def test_hot_ids_are_spread(hot):
    placed = parsing.in_order(hot, 24).where("own").groupBy("slice").count().toPandas()
    assert placed["count"].sum() == 1200 and placed["count"].max() < 160  # 50 a slice; equal rows stay together
    assert len(placed) > 15


def test_followers_across_slices(spark, hot):
    order = hot.select("doc_id", "text", F.xxhash64("text").alias("h")).orderBy(F.asc_nulls_first("doc_id"), "h").collect()
    want = Counter()
    for k, r in enumerate(order):
        changed = parsing.edited(r.text, order[(k + 1) % len(order)].text)
        want[r.doc_id, hashlib.sha256(changed.encode()).hexdigest()] += 1
    for partitions in ("3", "24"):
        before = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        try:
            assert Counter((r.doc_id, r.edited_sha256) for r in parsing.fingerprint_edits(hot).collect()) == want
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", before)
