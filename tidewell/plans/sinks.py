"""Queries of bounded sinks and of collections laid out for their filters."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidewell.plans.registry import query
from tidewell.plans.streams import events, streamed
from tidewell.session import shared_dir, table
from tidewell.sources.sinks import BoundedSink, write_indexed


def _sink(spark, name: str, **how) -> BoundedSink:
    return BoundedSink(spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", **how)


@query("""SELECT user_id AS key, event_type AS value, event_id AS seq, place FROM (SELECT *, cast(row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS INTEGER) AS place, max(ts) OVER (PARTITION BY user_id) AS last FROM events)
WHERE place <= 5 AND last >= (SELECT max(ts) FROM events) - INTERVAL 2 DAY""")
def a21_capped_list(spark, sf):
    """The newest five events of each user that had one in the last two days, from a stream."""
    sink = _sink(spark, "list", kind="list", most=5, life=2 * 86_400)
    streamed(spark, sf, lambda s: sink.drive(s.select(F.col("user_id").alias("key"), F.col("event_type").alias("value"), F.col("ts").alias("at"), F.col("event_id").alias("seq"))))
    return sink.rows().select(F.col("key").cast("long").alias("key"), "value", "seq", "place")


@query("""WITH l AS (SELECT event_type AS k, user_id::VARCHAR AS v, max(epoch_us(ts)) AS s FROM events GROUP BY ALL)
SELECT k AS key, v AS value, s::DOUBLE AS score, cast(row_number() OVER (PARTITION BY k ORDER BY s DESC, v) AS INTEGER) AS place FROM l QUALIFY place <= 20""")
def a21_sorted_set(spark, sf):
    """The twenty users of each kind of event that had it last; batches come in order of time, some twice, and a snapshot lies between."""
    sink = _sink(spark, "sorted", kind="sorted", most=20)
    rows = events(spark, sf).select(F.col("event_type").alias("key"), F.col("user_id").alias("value"), F.unix_micros("ts").alias("score"), F.col("ts").alias("at"), F.col("event_id").alias("seq"))
    parts = [rows.where(w) for w in ("at < '2024-01-10'", "at >= '2024-01-10' and at < '2024-01-20'", "at >= '2024-01-20'")]
    for number in (0, 1, 0):
        sink.put(parts[number], number)
    sink.compact()
    for number in (1, 2, 2):
        sink.put(parts[number], number)
    return sink.rows().select("key", "value", "score", "place")


@query("SELECT c_custkey AS key, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE c_name END AS value FROM customer")
def a21_last_value(spark, sf):
    """The last value of each key; of two values of one time that of the greater seq."""
    sink, c = _sink(spark, "last", kind="last"), table(spark, sf, "customer")
    at = F.lit("2024-01-01").cast("timestamp").alias("at")
    sink.put(c.select(F.col("c_custkey").alias("key"), F.col("c_name").alias("value"), at, F.lit(1).alias("seq")), 0)
    sink.put(c.where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("key"), F.col("c_mktsegment").alias("value"), at, F.lit(2).alias("seq")), 1)
    return sink.rows().select(F.col("key").cast("long").alias("key"), "value")


@query("SELECT o_orderpriority AS priority, count(*) AS n, sum(l_linenumber)::BIGINT AS lines FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size = 7) GROUP BY 1")
def a3_indexed_collection(spark, sf):
    """Lines and orders in buckets of the order: their join moves neither, and lines of some parts are found by Bloom filters."""
    name = uuid.uuid4().hex
    at = f"{shared_dir(spark)}/indexed-{name}"
    lines = write_indexed(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), f"lines_{name}", f"{at}/lines", "l_orderkey", 8, ["l_orderkey"], {"l_partkey": 200_000})
    orders = write_indexed(table(spark, sf, "orders").select("o_orderkey", "o_orderpriority"), f"orders_{name}", f"{at}/orders", "o_orderkey", 8, ["o_orderkey"], {})
    parts = table(spark, sf, "part").where("p_size = 7").select("p_partkey")
    wanted = lines.join(parts, F.col("l_partkey") == F.col("p_partkey"), "left_semi")
    return wanted.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy(F.col("o_orderpriority").alias("priority")).agg(F.count("*").alias("n"), F.sum("l_linenumber").cast("long").alias("lines"))
