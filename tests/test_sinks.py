"""Sinks that batches may reach twice, and the plans of collections laid out for their filters."""

import uuid

from pyspark.sql import functions as F

from tidewell.session import shared_dir
from tidewell.sources.sinks import BoundedSink, write_indexed

ROWS = "key string, value string, score double, at string, seq long"


def batch(spark, *rows):
    return spark.createDataFrame(list(rows), ROWS)


def sink(spark, **how):
    return BoundedSink(spark, f"{shared_dir(spark)}/sink-{uuid.uuid4().hex}", **how)


def test_batches_that_come_again_change_nothing(spark):
    s = sink(spark, kind="list", most=2)
    assert s.rows().count() == 0
    first = batch(spark, ("a", "x", None, "2024-01-01", 1), ("a", "y", None, "2024-01-02", 2), ("b", "z", None, "2024-01-01", 3))
    second = batch(spark, ("a", "w", None, "2024-01-02", 4), (None, "n", None, None, None))
    for b, n in ((first, 0), (second, 1), (first, 0), (second, 1)):
        s.put(b, n)
    want = {("a", "w", 1), ("a", "y", 2), ("b", "z", 1), (None, "n", 1)}
    got = lambda: {(r.key, r.value, r.place) for r in s.rows().collect()}
    assert got() == want
    s.compact()
    s.put(first, 0)
    assert got() == want
    s.put(batch(spark, ("a", "v", None, "2024-01-05", 9)), 2)
    assert got() == {("a", "v", 1), ("a", "w", 2), ("b", "z", 1), (None, "n", 1)}


def test_keys_end_with_their_life(spark):
    s = sink(spark, kind="sorted", most=2, life=86_400)
    s.put(batch(spark, ("a", "x", 1.0, "2024-01-01", 1), ("a", "x", 9.0, "2024-01-04", 2), ("a", "y", 5.0, "2024-01-01", 3), ("a", "z", 2.0, "2024-01-01", 4), ("b", "q", 1.0, "2024-01-02", 5)), 7)
    assert [(r.key, r.value, r.score) for r in s.rows().orderBy("place").collect()] == [("a", "x", 9.0), ("a", "y", 5.0)]
    assert s.rows(now="2024-01-02").where("key = 'b'").count() == 1 and s.rows(now="2024-02-01").count() == 0


def test_layout_saves_exchanges_and_row_groups(spark):
    name = uuid.uuid4().hex
    rows = spark.range(40_000).select(F.col("id").alias("k"), (F.col("id") % 997 * 1_000_003).cast("string").alias("word"), F.lit("x").alias("pad"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        t = write_indexed(rows, f"t_{name}", f"{shared_dir(spark)}/t-{name}", "k", 4, ["k"], {"word": 1000})
        joined = t.join(t.withColumnRenamed("word", "w2"), "k").select("word", "w2")
        assert joined.count() == 40_000
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Bucketed: true" in plan
        found = t.where("word = 'no such word'")
        assert found.count() == 0 and "EqualTo(word,no such word)" in found._jdf.queryExecution().toString()

        def read(df):
            """Rows that the scan of a plan gave on."""
            df.collect()
            node = df._jdf.queryExecution().executedPlan()
            while node.children().size():
                node = node.children().head()
            return node.metrics().apply("numOutputRows").value()

        assert read(found.select("pad")) == 0  # Bloom filters let no row group through
        assert 0 < read(t.where("word = '1000003'").select("pad")) <= 40_000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql(f"DROP TABLE IF EXISTS t_{name}")
