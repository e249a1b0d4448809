"""Collections, sinks, filters, validation, maps and model hooks that no other module has."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidewell.functions import models
from tidewell.functions import text as T
from tidewell.operators import search as S
from tidewell.plans.memory import MEM, memories
from tidewell.plans.registry import query
from tidewell.plans.search import COS, SEED, points, vector_of
from tidewell.plans.texts import STOP
from tidewell.session import shared_dir, table
from tidewell.sources import files


@query("SELECT 'p_dense' AS name, 0::BIGINT AS n UNION ALL SELECT 'p_nations', count(*) FROM nation UNION ALL SELECT 'p_regions', 0 FROM region WHERE r_regionkey = 0")
def a1_a9_collections(spark, sf):
    """A collection that is created and stays empty, one that is filled, one that is cleared and one that is dropped."""
    catalog = files.Catalog(spark, f"{shared_dir(spark)}/catalog-{uuid.uuid4().hex}")
    catalog.create("p_dense", "id long, vector array<float>, sparse map<int,float>")
    catalog.create("p_nations", "n_nationkey int, n_name string, n_regionkey int")
    catalog.write("p_nations", table(spark, sf, "nation"))
    catalog.create("p_nations", "n_nationkey int, n_name string, n_regionkey int")
    catalog.write("p_regions", table(spark, sf, "region"))
    catalog.clear("p_regions")
    catalog.write("p_gone", table(spark, sf, "region"))
    catalog.drop("p_gone")
    catalog.write("other", table(spark, sf, "region"))
    return spark.createDataFrame([(n, catalog.read(n).count()) for n in catalog.collections("p_")], "name string, n long")


@query("SELECT cast(c_custkey AS VARCHAR) AS key, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE c_name END AS value FROM customer")
def a21_key_values(spark, sf):
    path = f"{shared_dir(spark)}/values-{uuid.uuid4().hex}"
    c = table(spark, sf, "customer")
    files.key_values(c, F.col("c_custkey"), F.col("c_name"), path)
    files.key_values(c.where("c_custkey % 2 = 0"), F.col("c_custkey"), F.col("c_mktsegment"), path)
    return files.last_values(spark, path)


@query("SELECT doc_id FROM documents WHERE (lang = 'en' OR (lang IN ('fr', 'de') AND n_chars > 1000)) AND NOT (source = 'src1' OR contains(lower(text), 'auge'))")
def b6_nested_filter(spark, sf):
    either = S.should(S.build_filter(lang="en"), S.must(S.build_filter(lang=["fr", "de"]), F.col("n_chars") > 1000))
    return table(spark, sf, "documents").where(S.must(either, S.must_not(S.build_filter(source="src1"), F.contains(F.lower("text"), F.lit("auge"))))).select("doc_id")


@query(f"WITH {MEM} SELECT id FROM m WHERE id % 3 = 1 AND (id % 7 = 0 OR confidence >= 0.4)")
def b13_b15_project_and_confidence(spark, sf):
    m = memories(spark, sf).withColumn("project", F.concat(F.lit("p"), F.when(F.col("id") % 3 == 1, "").otherwise("1")))
    m = m.withColumn("confidence", F.when(F.col("id") % 7 != 0, F.col("confidence")))
    return S.sure_enough(S.in_project(m, "p"), 0.4).select("id")


@query("""SELECT o_orderkey AS id, array_to_string(list_filter([CASE WHEN o_orderpriority NOT IN ('1-URGENT', '2-HIGH') THEN 'priority' END, CASE WHEN o_totalprice < 1000 OR o_totalprice > 200000 THEN 'price' END, CASE WHEN o_orderstatus = 'F' AND length(o_orderpriority) > 8 THEN 'length' END], lambda x: x IS NOT NULL), ',') AS faults FROM orders""")
def b17_validation(spark, sf):
    rules = {
        "priority": (F.lit(True), F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")),
        "price": (F.lit(True), F.col("o_totalprice").between(1000, 200_000)),
        "length": (F.col("o_orderstatus") == "F", F.length("o_orderpriority") <= 8),
    }
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.array_join(S.faults(rules), ",").alias("faults"))


@query(f"""WITH h AS (SELECT vec_id AS id, 'q' || (vec_id % 97) AS query, embedding, label AS n_results FROM embeddings WHERE label > 0), l AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY query ORDER BY id DESC) = 1)
SELECT id, query, n_results, round({COS.format(q=SEED.format(i=8))}, 6) AS score FROM l e WHERE {COS.format(q=SEED.format(i=8))} >= 0.05 ORDER BY score DESC, id LIMIT 5""")
def c15_similar_queries(spark, sf):
    wording = F.concat(F.when(F.col("id") % 2 == 0, " Q").otherwise("q"), F.col("id") % 97)
    h = points(spark, sf).select("id", wording.alias("query"), "vector", F.col("label").alias("n_results"), F.col("id").alias("at"))
    return S.similar_queries(h, vector_of(spark, sf, 8), 5, 0.05).select("id", F.lower(F.trim("query")).alias("query"), "n_results", F.round("score", 6).alias("score"))


@query("SELECT event_id, json_extract_string(props, '$.k') || CASE WHEN event_id % 2 = 0 THEN '!' ELSE '' END AS k, event_type AS kind, event_id % 2 = 0 AS has_extra, CASE WHEN event_id % 2 = 0 THEN 3 ELSE 2 END AS n FROM events")
def i21_maps(spark, sf):
    e = table(spark, sf, "events")
    own = F.map_concat(F.from_json("props", "map<string,string>"), F.create_map(F.lit("kind"), "event_type"))
    k = F.element_at(own, F.lit("k"))
    patch = F.when(F.col("event_id") % 2 == 0, F.create_map(F.lit("k"), F.concat(k, F.lit("!")), F.lit("extra"), F.lit("x"))).otherwise(F.create_map().cast("map<string,string>"))
    m = e.select("event_id", T.with_entries(own, patch).alias("m"))
    return m.select("event_id", F.try_element_at("m", F.lit("k")).alias("k"), F.try_element_at("m", F.lit("kind")).alias("kind"), F.map_contains_key("m", "extra").alias("has_extra"), F.size("m").alias("n"))


@query(f"WITH k AS (SELECT conv_id, turn, list_filter(regexp_split_to_array(lower(text), '[^A-Za-z0-9_]+'), lambda w: length(w) > 2 AND NOT list_contains({STOP}, w)) AS w FROM conversations) SELECT conv_id, turn, array_to_string(list_filter(w, lambda x, i: list_position(w, x) = i)[1:8], ' ') AS question FROM k")
def p4_reformulated(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", models.reformulated(F.col("text")).alias("question"))
