"""Queries of section 2.5 and of 2.14, evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions import scoring
from tidewell.operators import analytics as A
from tidewell.operators import evaluate as Q
from tidewell.plans.registry import query
from tidewell.session import table

NOW = "TIMESTAMP '2024-01-31 00:00:00'"


def usage(spark, sf) -> DataFrame:
    """The events table as tool usage."""
    e = table(spark, sf, "events")
    return e.select("event_id", F.col("event_type").alias("tool"), F.col("user_id").alias("session"), "ts", F.col("value").alias("duration"), (F.col("event_type") != "error").alias("success"), F.get_json_object("props", "$.k").cast("int").alias("results"), "props")




@query("SELECT count(*) AS n, count(*) FILTER (event_type = 'click' AND value > 10) AS clicks FROM events")
def e1_count(spark, sf):
    return table(spark, sf, "events").agg(F.count("*").alias("n"), F.count_if(F.expr("event_type = 'click' and value > 10")).alias("clicks"))


@query("SELECT lang AS value, count(*) AS n FROM documents WHERE lang IN ('en', 'de', 'pt') GROUP BY 1")
def e2_facet(spark, sf):
    return A.facet(table(spark, sf, "documents"), "lang", ["en", "de", "pt"])


@query("SELECT source AS value, count(*) AS n FROM documents WHERE source <> '' GROUP BY 1")
def e3_aggregate_by_field(spark, sf):
    return A.facet(table(spark, sf, "documents"), "source")


@query("SELECT count(*) AS n, count(DISTINCT source) AS files, max(doc_id) AS newest, count(*) * 1024 * 4 AS memory_bytes, count(*) * (1024 * 4 + 500) AS disk_bytes FROM documents")
def e4_e5_collection_stats(spark, sf):
    return A.collection_stats(table(spark, sf, "documents"), "source", F.col("doc_id"), 1024)


@query("SELECT split_part(event_type || '_' || user_id, '_', 1) AS project, count(*) AS n, count(DISTINCT user_id) AS users, round(sum(value), 4) AS total FROM events GROUP BY 1")
def e6_platform_stats(spark, sf):
    e = table(spark, sf, "events").withColumn("name", F.concat_ws("_", "event_type", "user_id"))
    return e.groupBy(F.split_part("name", F.lit("_"), F.lit(1)).alias("project")).agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"), F.round(F.sum("value"), 4).alias("total"))


@query("SELECT count(*) FILTER (lang = 'en') AS en, count(*) FILTER (lang = 'fr') AS fr, count(*) FILTER (lang = 'pt') AS pt FROM documents")
def e7_type_counts(spark, sf):
    return A.pivot_counts(table(spark, sf, "documents"), "lang", ["en", "fr", "pt"])


@query("SELECT count(*) AS calls, round(avg((event_type <> 'error')::INT), 6) AS success_rate, round(avg(value), 6) AS mean_duration FROM events")
def e8_usage_stats(spark, sf):
    u = A.usage_stats(usage(spark, sf))
    return u.select("calls", F.round("success_rate", 6).alias("success_rate"), F.round("mean_duration", 6).alias("mean_duration"))


@query("SELECT cast(hour(ts) AS INTEGER) AS hour, event_type AS tool, count(*) AS n, count(*) FILTER (event_type = 'error') AS errors FROM events GROUP BY ALL")
def e8_calls_by_hour(spark, sf):
    return usage(spark, sf).groupBy(F.hour("ts").alias("hour"), "tool").agg(F.count("*").alias("n"), F.count_if(~F.col("success")).alias("errors"))


@query("SELECT CASE WHEN event_type IN ('click', 'view') THEN 'memory:' || event_type WHEN event_type = 'error' THEN 'memory:unknown' ELSE event_type END AS command, count(*) AS n FROM events GROUP BY 1")
def e9_command_counts(spark, sf):
    t = F.col("tool")
    key = F.when(t.isin("click", "view"), F.concat(F.lit("memory:"), t)).when(t == "error", "memory:unknown").otherwise(t)
    return usage(spark, sf).groupBy(key.alias("command")).agg(F.count("*").alias("n"))


@query("SELECT event_type AS tool, count(*) AS n, cast(floor(avg(value) + 0.5) AS BIGINT) AS mean_duration FROM events GROUP BY 1")
def e10_tool_preferences(spark, sf):
    return usage(spark, sf).groupBy("tool").agg(F.count("*").alias("n"), F.floor(F.avg("duration") + 0.5).cast("long").alias("mean_duration"))


@query("""WITH w AS (SELECT event_type AS a, lead(event_type, 1) OVER s AS b, lead(event_type, 2) OVER s AS c FROM events WINDOW s AS (PARTITION BY user_id ORDER BY ts, event_id)),
r AS (SELECT a || ' > ' || b AS run FROM w WHERE b IS NOT NULL UNION ALL SELECT a || ' > ' || b || ' > ' || c FROM w WHERE c IS NOT NULL)
SELECT run, count(*) AS n FROM r GROUP BY run HAVING count(*) >= 2 ORDER BY n DESC, run LIMIT 15""")
def e11_workflow_ngrams(spark, sf):
    return A.ngrams(usage(spark, sf), "session", "tool", ["ts", "event_id"])


@query("""WITH s AS (SELECT user_id, count(*) AS n, (epoch_us(max(ts)) - epoch_us(min(ts))) / 60e6 AS m FROM events GROUP BY 1)
SELECT count(*) AS sessions, cast(floor(avg(n) + 0.5) AS BIGINT) AS mean_calls, cast(floor(avg(m) + 0.5) AS BIGINT) AS mean_minutes FROM s""")
def e12_session_stats(spark, sf):
    return A.session_stats(usage(spark, sf), "session", "ts")


@query("""WITH g AS (SELECT substr(event_type || ':' || user_id, 1, 100) AS key, cast(json_extract_string(props, '$.k') AS INT) AS r FROM events WHERE event_type <> 'error')
SELECT key, count(*) AS n, round(avg(r), 6) AS mean_results FROM g WHERE r <= 20 GROUP BY key HAVING count(*) >= 2""")
def e13_knowledge_gaps(spark, sf):
    u = usage(spark, sf)
    g = A.knowledge_gaps(u, F.concat_ws(":", "tool", "session"), F.col("results"), F.col("success"), 20)
    return g.withColumn("mean_results", F.round("mean_results", 6))


@query("""SELECT field, value, n FROM (SELECT field, value, n, row_number() OVER (PARTITION BY field ORDER BY n DESC, value) AS r FROM (
SELECT 'tool' AS field, event_type AS value, count(*) AS n FROM events GROUP BY ALL UNION ALL SELECT 'session', cast(user_id AS VARCHAR), count(*) FROM events GROUP BY ALL
UNION ALL SELECT 'hour', cast(hour(ts) AS VARCHAR), count(*) FROM events GROUP BY ALL)) WHERE r <= 15""")
def e14_profile(spark, sf):
    counted = A.profile(usage(spark, sf).withColumn("hour", F.hour("ts")), ["tool", "session", "hour"])
    r = F.row_number().over(Window.partitionBy("field").orderBy(F.desc("n"), "value"))
    return counted.withColumn("r", r).where("r <= 15").drop("r")


E14_RECENT = "e AS (SELECT * FROM events WHERE ts >= TIMESTAMP '2024-01-31' - INTERVAL 10 DAY)"


@query(f"""WITH {E14_RECENT}, f AS (SELECT 'u' || user_id AS file FROM e WHERE event_type <> 'error' UNION ALL SELECT unnest(['t' || event_type, 'u' || (user_id % 7)]) FROM e WHERE event_id % 2 = 0) SELECT file, count(*) AS n FROM f GROUP BY 1 ORDER BY n DESC, file LIMIT 20""")
def e14_frequent_files(spark, sf):
    e = A.recent(usage(spark, sf), "ts", F.expr("TIMESTAMP '2024-01-31 00:00:00'"), 10)
    one = F.when(F.col("tool") != "error", F.concat(F.lit("u"), "session"))
    many = F.when(F.col("event_id") % 2 == 0, F.array(F.concat(F.lit("t"), "tool"), F.concat(F.lit("u"), F.col("session") % 7)))
    return A.frequent_files(e, one, many)


@query(f"""WITH {E14_RECENT} SELECT substr(trim(lower(' ' || event_type || ' ' || props)), 1, 60) AS pattern, count(*) AS n FROM e GROUP BY 1 HAVING count(*) >= 3 ORDER BY n DESC, pattern LIMIT 10""")
def e14_common_patterns(spark, sf):
    e = A.recent(usage(spark, sf), "ts", F.expr("TIMESTAMP '2024-01-31 00:00:00'"), 10)
    return A.common_patterns(e, F.concat(F.lit(" "), F.upper("tool"), F.lit(" "), "props"))


@query("SELECT CASE doc_id % 4 WHEN 0 THEN 'python' WHEN 1 THEN 'go' ELSE 'kotlin' END AS value, count(*) AS n FROM documents WHERE doc_id % 4 < 3 GROUP BY 1")
def e4_language_facet(spark, sf):
    k = F.col("doc_id") % 4
    d = table(spark, sf, "documents").withColumn("language", F.when(k == 0, "python").when(k == 1, "go").when(k == 2, "kotlin").otherwise(F.col("lang")))
    return A.language_facet(d)


@query("""WITH p AS (SELECT * FROM (VALUES ('1-URGENT', 3.0, 15.0), ('2-HIGH', 5.0, 25.0), ('3-MEDIUM', 1.0, 5.0)) t(model, i, o)),
c AS (SELECT o_orderpriority AS model, l_quantity AS prompt, l_linenumber AS completion FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT c.model, count(*) AS calls, sum(prompt) AS prompt, sum(completion)::BIGINT AS completion, round(sum((prompt * coalesce(i, 0) + completion * coalesce(o, 0)) / 1000000), 6)::DOUBLE AS cost FROM c LEFT JOIN p USING (model) GROUP BY ROLLUP (c.model)""")
def e15_usage_cost(spark, sf):
    prices = spark.createDataFrame([("1-URGENT", 3.0, 15.0), ("2-HIGH", 5.0, 25.0), ("3-MEDIUM", 1.0, 5.0)], "model string, input_price double, output_price double")
    calls = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_orderpriority").alias("model"), F.col("l_quantity").alias("prompt"), F.col("l_linenumber").alias("completion"))
    return A.usage_cost(calls, prices)


@query("""SELECT count(DISTINCT user_id) AS sessions, count(DISTINCT user_id) FILTER (event_type = 'signup') AS started, count(*) FILTER (event_type = 'purchase') AS recalls,
round(count(*) FILTER (event_type = 'purchase') / nullif(count(*) FILTER (event_type = 'view'), 0), 3)::DOUBLE AS per_view, CASE WHEN count(*) FILTER (event_type = 'none') <> 0 THEN 1.0 END::DOUBLE AS none_ratio FROM events""")
def e16_roi(spark, sf):
    t = F.col("tool")
    n = lambda x: F.count_if(t == x)
    return usage(spark, sf).agg(F.count_distinct("session").alias("sessions"), F.count_distinct(F.when(t == "signup", F.col("session"))).alias("started"), n("purchase").alias("recalls"), A.ratio(n("purchase"), n("view")).alias("per_view"), A.ratio(n("view"), n("none")).alias("none_ratio"))


@query(f"""SELECT count(*) AS deliveries, count(*) FILTER (value > 50) AS non_empty, count(DISTINCT user_id) AS sessions FROM events WHERE event_type = 'view' AND ts >= {NOW} - INTERVAL 7 DAY AND ts < {NOW}""")
def e17_digest_stats(spark, sf):
    e = table(spark, sf, "events").where((F.col("event_type") == "view") & (F.col("ts") >= F.expr(f"{NOW} - interval 7 days")) & (F.col("ts") < F.expr(NOW)))
    return e.agg(F.count("*").alias("deliveries"), F.count_if(F.expr("value > 50")).alias("non_empty"), F.count_distinct("user_id").alias("sessions"))


TABLE = {"error": 0.6, "purchase": 0.85, "signup": 0.7, "click": 0.2}
SAL = "CASE WHEN event_type = 'error' THEN 0.9 WHEN event_type = 'purchase' THEN 0.85 WHEN event_type = 'signup' THEN 0.7 WHEN event_type = 'click' THEN 0.2 ELSE 0.3 END"


@query(f"SELECT CASE WHEN {SAL} >= 0.7 THEN 'high' WHEN {SAL} >= 0.4 THEN 'medium' ELSE 'low' END AS bucket, count(*) AS n, round(sum({SAL})::DOUBLE, 4) AS total FROM events GROUP BY 1")
def e18_sensory_stats(spark, sf):
    s = usage(spark, sf).select(F.round(scoring.salience(F.col("tool"), F.col("success"), TABLE), 6).alias("s"))
    return s.groupBy(F.when(F.col("s") >= 0.7, "high").when(F.col("s") >= 0.4, "medium").otherwise("low").alias("bucket")).agg(F.count("*").alias("n"), F.round(F.sum("s"), 4).alias("total"))


@query("""SELECT event_type AS tool, list_sort(list(value))[least(cast(floor(count(value) * 0.5) AS BIGINT) + 1, count(value))] AS p50, list_sort(list(value))[least(cast(floor(count(value) * 0.95) AS BIGINT) + 1, count(value))] AS p95,
list_sort(list(value))[least(cast(floor(count(value) * 0.99) AS BIGINT) + 1, count(value))] AS p99 FROM events WHERE value IS NOT NULL GROUP BY 1""")
def e19_e25_percentiles(spark, sf):
    return A.nearest_rank(usage(spark, sf), "duration", [0.5, 0.95, 0.99], ["tool"])


@query("SELECT round(sum((event_type <> 'error')::INT) / count(*), 6)::DOUBLE AS hit_rate FROM events")
def e20_hit_rate(spark, sf):
    return usage(spark, sf).agg(F.round(F.sum(F.col("success").cast("int")) / F.count("*"), 6).alias("hit_rate"))


@query("""SELECT event_type AS tool, le, count(*) FILTER (value <= le) AS n FROM events, (SELECT unnest([5.0, 10.0, 25.0, 50.0, 100.0, 'inf'::DOUBLE]) AS le) GROUP BY ALL""")
def e21_histogram(spark, sf):
    return A.histogram(usage(spark, sf), "duration", [5.0, 10.0, 25.0, 50.0, 100.0], ["tool"])


@query("""WITH h AS (SELECT event_type AS tool, le, count(*) FILTER (value <= le) AS n FROM events, (SELECT unnest([5.0, 10.0, 25.0, 50.0, 100.0, 'inf'::DOUBLE]) AS le) GROUP BY ALL),
w AS (SELECT *, coalesce(lag(le) OVER s, 0) AS low, coalesce(lag(n) OVER s, 0) AS before, 0.9 * max(n) OVER (PARTITION BY tool) AS rank FROM h WINDOW s AS (PARTITION BY tool ORDER BY le))
SELECT tool, round(min_by(CASE WHEN le = 'inf'::DOUBLE THEN low ELSE low + (le - low) * (rank - before) / (n - before) END, le), 6)::DOUBLE AS value FROM w WHERE n >= rank AND n > before GROUP BY tool""")
def e21_histogram_quantile(spark, sf):
    h = A.histogram(usage(spark, sf), "duration", [5.0, 10.0, 25.0, 50.0, 100.0], ["tool"])
    return A.histogram_quantile(h, 0.9, ["tool"]).withColumn("value", F.round("value", 6))


@query("""SELECT user_id, CASE WHEN p + r < 5 THEN 0.5 ELSE round(greatest(0.4, least(0.8, 0.8 - 0.4 * p / (p + r))), 6) END::DOUBLE AS threshold FROM (
SELECT user_id, count(*) FILTER (event_type = 'purchase') AS p, count(*) FILTER (event_type = 'error') AS r FROM events GROUP BY 1)""")
def e22_adaptive_threshold(spark, sf):
    e = table(spark, sf, "events").groupBy("user_id").agg(F.count_if(F.expr("event_type = 'purchase'")).alias("p"), F.count_if(F.expr("event_type = 'error'")).alias("r"))
    return e.select("user_id", F.round(A.adaptive_threshold(F.col("p"), F.col("r")), 6).alias("threshold"))


@query(f"""SELECT source, count(*) AS ingested, count(*) FILTER (quality = 1) AS promoted, count(*) FILTER (quality = 0) AS rejected, count(*) FILTER (quality IS NULL AND doc_id % 365 <= 7) AS pending,
round(count(*) FILTER (quality = 1) / nullif(count(*) FILTER (quality IS NOT NULL), 0), 3)::DOUBLE AS rate FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source""")
def e23_capture_funnel(spark, sf):
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    q = F.col("quality")
    return A.funnel(d, "source", F.lit(True), q == 1, q == 0, q.isNull() & (F.col("doc_id") % 365 <= 7))


@query("""SELECT conv_id, role, string_agg(cast(conv_id AS VARCHAR) || '.' || turn, ',' ORDER BY conv_id, turn) AS turns FROM conversations GROUP BY conv_id, role""")
def e26_category_lists(spark, sf):
    c = table(spark, sf, "conversations")
    rows = F.array_sort(F.collect_list(F.struct("conv_id", "turn")))
    return c.groupBy("conv_id", "role").agg(F.array_join(F.transform(rows, lambda x: F.concat_ws(".", x["conv_id"], x["turn"])), ",").alias("turns"))


@query("""WITH c AS (SELECT lang, count(*) AS n, count(*) FILTER (quality = 1) AS h FROM documents JOIN labels USING (doc_id) GROUP BY 1) SELECT round(sum(h) / sum(n), 6)::DOUBLE AS micro, round(avg(h / n), 6)::DOUBLE AS macro FROM c""")
def e27_accuracy(spark, sf):
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    return A.micro_macro(d, "lang", F.col("quality") == 1).select(F.round("micro", 6).alias("micro"), F.round("macro", 6).alias("macro"))


@query("""SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 3600 SECOND PRECEDING AND CURRENT ROW) AS demand FROM events""")
def f20_rate_demand(spark, sf):
    return A.rolling_demand(table(spark, sf, "events"), ["user_id"], "ts", 3600).select("event_id", "demand")


# --- evaluation ----------------------------------------------------------------------------------


def judged(spark, sf) -> DataFrame:
    """A retrieval run made from orders: an order's parts in line order against its even parts."""
    li = table(spark, sf, "lineitem")
    rows = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey")))
    results = F.transform(rows, lambda x: F.concat(F.lit("p/"), x["l_partkey"].cast("string")))
    return li.groupBy(F.col("l_orderkey").alias("id")).agg(results.alias("results"), F.array_distinct(F.filter(results, lambda x: F.right(x, F.lit(1)).isin("0", "2", "4"))).alias("expected"))


EVAL = """WITH r AS (SELECT l_orderkey AS id, list('p/' || l_partkey ORDER BY l_linenumber, l_partkey) AS results FROM lineitem GROUP BY 1),
e AS (SELECT id, results, list_distinct(list_filter(results, lambda x: right(x, 1) IN ('0', '2', '4'))) AS expected FROM r),
k AS (SELECT *, results[1:3] AS top FROM e), h AS (SELECT *, list_transform(top, lambda x: list_contains(expected, x)) AS hit FROM k) """


@query(EVAL + """SELECT id, round(CASE WHEN len(expected) = 0 THEN 1 ELSE len(list_filter(expected, lambda x: list_contains(top, x))) / len(expected) END, 6)::DOUBLE AS recall,
round(CASE WHEN len(top) = 0 THEN 0 ELSE len(list_filter(hit, lambda x: x)) / len(top) END, 6)::DOUBLE AS precision, round(coalesce(1 / nullif(list_position(hit, true), 0), 0), 6)::DOUBLE AS mrr FROM h""")
def q1_q2_q3_retrieval_metrics(spark, sf):
    return Q.metrics(judged(spark, sf), 3).select("id", *[F.round(c, 6).alias(c) for c in ("recall", "precision", "mrr")])


@query(EVAL + """SELECT id, round(CASE WHEN least(3, len(expected)) = 0 THEN 0 ELSE coalesce(list_sum(list_transform(range(1, len(top) + 1), lambda i: CASE WHEN hit[i] AND list_position(top, top[i]) = i THEN 1 / log2(i + 1) ELSE 0 END)), 0)
/ list_sum(list_transform(range(1, least(3, len(expected)) + 1), lambda i: 1 / log2(i + 1))) END, 6)::DOUBLE AS ndcg FROM h""")
def q4_ndcg(spark, sf):
    return Q.metrics(judged(spark, sf), 3).select("id", F.round("ndcg", 6).alias("ndcg"))


@query("""SELECT round(avg(CASE WHEN contains(lower(text), 'the') THEN 1.0 WHEN contains(lower(text), 'und') THEN 0.5 END), 6)::DOUBLE AS mean FROM documents""")
def q5_q6_answer_rate(spark, sf):
    low = F.lower("text")
    return table(spark, sf, "documents").agg(F.round(F.avg(F.when(F.contains(low, F.lit("the")), 1.0).when(F.contains(low, F.lit("und")), 0.5)), 6).alias("mean"))


@query("""WITH a AS (SELECT doc_id AS id, lang AS category, n_chars / 1000.0 AS before, (n_chars + doc_id % 3 * 15 - 15) / 1000.0 AS after FROM documents)
SELECT category, count(*) FILTER (after - before > 0.01) AS improved, count(*) FILTER (after - before < -0.01) AS degraded, round(avg(after) - avg(before), 6)::DOUBLE AS delta FROM a GROUP BY category""")
def q7_compare_reports(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("category"), F.col("n_chars"))
    before = d.select("id", "category", (F.col("n_chars") / 1000).alias("score"))
    after = d.select("id", "category", ((F.col("n_chars") + F.col("id") % 3 * 15 - 15) / 1000).alias("score"))
    return Q.compare(before, after).withColumn("delta", F.round("delta", 6))
