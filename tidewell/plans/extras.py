"""What Spark itself brings beside the inventory's operators: joins, grouping sets, windows, set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewell.plans.registry import query
from tidewell.session import table


@query("""SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM lineitem WHERE l_shipdate <= DATE '2023-09-02' GROUP BY ALL""")
def x_pricing_summary(spark, sf):
    li = table(spark, sf, "lineitem").where("l_shipdate <= date '2023-09-02'")
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count("*").alias("n"))


@query("""SELECT n_name, round(sum(o_totalprice), 2) AS total FROM customer JOIN orders ON c_custkey = o_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' GROUP BY n_name""")
def x_star_join(spark, sf):
    t = lambda n: table(spark, sf, n)
    small = t("nation").join(t("region").where("r_name = 'ASIA'"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name")
    rows = t("customer").join(F.broadcast(small), F.col("c_nationkey") == F.col("n_nationkey")).join(t("orders"), F.col("c_custkey") == F.col("o_custkey"))
    return rows.groupBy("n_name").agg(F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT event_type, user_id % 3 AS bucket, count(*) AS n FROM events GROUP BY CUBE (event_type, user_id % 3)")
def e29_cube(spark, sf):
    return table(spark, sf, "events").withColumn("bucket", F.col("user_id") % 3).cube("event_type", "bucket").agg(F.count("*").alias("n"))


@query("SELECT event_id, cast(ntile(4) OVER w AS INTEGER) AS quarter, cast(dense_rank() OVER w AS INTEGER) AS dense, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND CURRENT ROW), 4) AS moving FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def f21_window_functions(spark, sf):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf, "events").select("event_id", F.ntile(4).over(w).alias("quarter"), F.dense_rank().over(w).alias("dense"), F.round(F.sum("value").over(w.rowsBetween(-3, 0)), 4).alias("moving"))


@query("SELECT id FROM (SELECT DISTINCT o_custkey AS id FROM orders INTERSECT SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0) EXCEPT SELECT s_suppkey FROM supplier")
def h7_intersect_except(spark, sf):
    a = table(spark, sf, "orders").select(F.col("o_custkey").alias("id"))
    b = table(spark, sf, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("id"))
    return a.intersect(b).subtract(table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id")))


@query("SELECT DISTINCT id FROM (SELECT s_suppkey AS id FROM supplier UNION ALL SELECT p_partkey FROM part)")
def h1_h3_union_distinct(spark, sf):
    return table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id")).unionByName(table(spark, sf, "part").select(F.col("p_partkey").alias("id"))).dropDuplicates(["id"])


@query("SELECT p_partkey AS id FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_orderkey < 100)")
def h2_difference(spark, sf):
    used = table(spark, sf, "lineitem").where("l_orderkey < 100").select(F.col("l_partkey").alias("id"))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id")).join(used, "id", "left_anti")


@query("SELECT min(doc_id) AS doc_id, count(*) AS n FROM documents GROUP BY lower(trim(substr(text, 1, 100)))")
def h4_content_dedup(spark, sf):
    return table(spark, sf, "documents").groupBy(F.lower(F.trim(F.substring("text", 1, 100))).alias("k")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n")).drop("k")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE (o_totalprice, -o_orderkey) < (200000.0, 0) ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def h5_h6_keyset_page(spark, sf):
    return table(spark, sf, "orders").where("o_totalprice < 200000.0 or (o_totalprice = 200000.0 and o_orderkey > 0)").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25).select("o_orderkey", "o_totalprice")


@query("""SELECT c.event_id, p.event_id AS last_purchase FROM (SELECT * FROM events WHERE event_type = 'click') c ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase') p ON c.user_id = p.user_id AND c.ts >= p.ts""")
def d22_as_of_join(spark, sf):
    """One window over both sides, on the key: no pair of rows is made."""
    e = table(spark, sf, "events").where("event_type in ('click', 'purchase')")
    w = Window.partitionBy("user_id").orderBy("ts", F.desc("event_type")).rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(F.col("event_type") == "purchase", F.col("event_id")), ignorenulls=True).over(w)
    return e.withColumn("last_purchase", last).where("event_type = 'click'").select("event_id", "last_purchase")


@query("""WITH o AS (SELECT o_orderkey, o_custkey % 15 AS k, TIMESTAMP '2024-01-01' + (o_orderkey % 28) * INTERVAL 1 DAY + (o_orderkey % 24) * INTERVAL 1 HOUR AS t0 FROM orders)
SELECT o_orderkey, count(*) AS n FROM o JOIN events ON user_id = k AND ts >= t0 AND ts < t0 + INTERVAL 2 DAY GROUP BY o_orderkey""")
def d22_range_join(spark, sf):
    """The range is cut into days, so the join is an equality on (key, day) with a filter."""
    at = F.expr("timestamp_ntz '2024-01-01 00:00:00' + make_dt_interval(cast(o_orderkey % 28 as int), cast(o_orderkey % 24 as int))")
    o = table(spark, sf, "orders").select("o_orderkey", (F.col("o_custkey") % 15).alias("k"), at.alias("at"))
    o = o.withColumn("day", F.explode(F.sequence(F.to_date("at"), F.date_add(F.to_date("at"), 2))))
    e = table(spark, sf, "events").select(F.col("user_id").alias("k"), "ts", F.to_date("ts").alias("day"))
    hit = (F.col("ts") >= F.col("at")) & (F.col("ts") < F.col("at") + F.expr("interval 2 days"))
    return o.join(e, ["k", "day"]).where(hit).groupBy("o_orderkey").agg(F.count("*").alias("n"))
