"""Queries of section 2.10 and the graph joins of 2.4."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.operators import graph as G
from tidewell.operators import search as S
from tidewell.plans.registry import query
from tidewell.session import table

KIND = "CASE l_returnflag WHEN 'A' THEN 'supersedes' WHEN 'N' THEN 'caused_by' ELSE 'relates_to' END"


def edges(spark, sf) -> DataFrame:
    """Suppliers and the parts of their lines as a graph."""
    li = table(spark, sf, "lineitem")
    kind = F.when(F.col("l_returnflag") == "A", "supersedes").when(F.col("l_returnflag") == "N", "caused_by").otherwise("relates_to")
    return li.select((F.col("l_suppkey") + 1_000_000).alias("src"), F.col("l_partkey").alias("dst"), kind.alias("type")).distinct()


EDGES = f"e AS (SELECT DISTINCT l_suppkey + 1000000 AS src, l_partkey AS dst, {KIND} AS type FROM lineitem), u AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e)"


def nodes(spark, ids: list[int]) -> DataFrame:
    return spark.createDataFrame([(i,) for i in ids], "node long")


@query(f"WITH {EDGES} SELECT src AS file, dst, type, CASE WHEN src = 1000001 THEN 'dependencies' ELSE 'dependents' END AS role FROM e WHERE src = 1000001 OR dst = 1")
def g1_dependents(spark, sf):
    e = edges(spark, sf).where("src = 1000001 or dst = 1")
    return e.select(F.col("src").alias("file"), "dst", "type", F.when(F.col("src") == 1_000_001, "dependencies").otherwise("dependents").alias("role"))


@query(f"""WITH RECURSIVE {EDGES}, r(node, hop) AS (SELECT 1000001, 0 UNION SELECT u.dst, hop + 1 FROM r JOIN u ON u.src = r.node WHERE hop < 3)
SELECT cast(node AS BIGINT) AS node, cast(min(hop) AS INTEGER) AS hop FROM r GROUP BY node""")
def g2_expand(spark, sf):
    return G.expand(edges(spark, sf), nodes(spark, [1_000_001]), 3)


@query(f"""WITH {EDGES}, d AS (SELECT src, dst FROM e), l1 AS (SELECT src FROM d WHERE dst = 1), f1 AS (SELECT DISTINCT src FROM l1 WHERE src <> 1), l2 AS (SELECT d.src FROM d JOIN f1 ON d.dst = f1.src), f2 AS (SELECT DISTINCT src FROM l2 WHERE src <> 1 AND src NOT IN (SELECT src FROM f1))
SELECT (SELECT count(*) FROM f1) + (SELECT count(*) FROM f2) AS files, cast(CASE WHEN (SELECT count(*) FROM f1) = 0 THEN 1 WHEN (SELECT count(*) FROM f2) = 0 THEN 2 ELSE 3 END AS INTEGER) AS depth, (SELECT count(*) FROM l1) + (SELECT count(*) FROM l2) AS edge_count""")
def g3_blast_radius(spark, sf):
    return G.blast_radius(edges(spark, sf).select("src", "dst"), nodes(spark, [1]))


@query(f"WITH {EDGES} SELECT src, dst, type, CASE WHEN src = 1000002 THEN 'out' ELSE 'in' END AS side FROM e WHERE (src = 1000002 OR dst = 1000002) AND type IN ('supersedes', 'caused_by')")
def g4_g5_subgraph(spark, sf):
    return G.subgraph(edges(spark, sf), 1_000_002, ["supersedes", "caused_by"])


@query(f"""WITH {EDGES}, w AS (SELECT src, dst, max(CASE type WHEN 'supersedes' THEN 0.9 WHEN 'caused_by' THEN 0.8 ELSE 0.3 END::DOUBLE) AS w FROM (SELECT src, dst, type FROM e UNION ALL SELECT dst, src, type FROM e) GROUP BY ALL),
s AS (SELECT * FROM (VALUES (1000001, 1.0::DOUBLE), (1000003, 0.9::DOUBLE)) t(node, a)), h1 AS (SELECT dst AS node, max(a * w * 0.7) AS a FROM s JOIN w ON src = node GROUP BY dst HAVING max(a * w * 0.7) >= 0.3),
b1 AS (SELECT node, max(a) AS a FROM (SELECT * FROM s UNION ALL SELECT * FROM h1) GROUP BY node), f1 AS (SELECT h1.* FROM h1 LEFT JOIN s USING (node) WHERE h1.a > coalesce(s.a, 0)),
h2 AS (SELECT dst AS node, max(a * w * 0.7) AS a FROM f1 JOIN w ON src = node GROUP BY dst HAVING max(a * w * 0.7) >= 0.3)
SELECT cast(node AS BIGINT) AS node, round(max(a), 6) AS activation FROM (SELECT * FROM b1 UNION ALL SELECT * FROM h2) GROUP BY node""")
def g6_spreading_activation(spark, sf):
    e = edges(spark, sf)
    links = e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "type"))
    seeds = spark.createDataFrame([(1_000_001, 1.0), (1_000_003, 0.9)], "node long, activation double")
    return G.activate(links, seeds).select("node", F.round("activation", 6).alias("activation"))


@query("""WITH h AS (SELECT p_partkey AS id, p_size / 60.0::DOUBLE AS score FROM part ORDER BY score DESC, id LIMIT 10), a AS (SELECT s_suppkey AS id, 0.6::DOUBLE AS score FROM supplier WHERE s_suppkey < 6 AND s_suppkey NOT IN (SELECT id FROM h))
SELECT id, round(score, 6) AS score FROM (SELECT * FROM h UNION ALL SELECT * FROM a) ORDER BY score DESC, id LIMIT 12""")
def g7_activation_merge(spark, sf):
    hits = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), (F.col("p_size") / 60).alias("score")).orderBy(F.desc("score"), "id").limit(10)
    active = table(spark, sf, "supplier").where("s_suppkey < 6").select(F.col("s_suppkey").alias("node"), F.lit(0.6).alias("activation"), F.lit(1).alias("hop"))
    return G.merge_activated(hits, active, 12).withColumn("score", F.round("score", 6))


@query(f"""WITH {EDGES}, b AS (SELECT DISTINCT src FROM e WHERE dst IN (1, 2)) SELECT count(*) AS affected, count(*) > 20 AS blocked FROM b""")
def g8_blast_gate(spark, sf):
    e = edges(spark, sf).select((-F.col("src")).alias("src"), "dst")  # under zero: a part's key over a million is no supplier
    hit = G.blast_radius(e, nodes(spark, [1, 2]))  # parts have no dependents beyond their suppliers
    return hit.select(F.col("files").alias("affected"), (F.col("files") > 20).alias("blocked"))


@query("""WITH RECURSIVE e AS (SELECT o_custkey AS a, o_custkey + 3 AS b FROM orders), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r(x, y) AS (SELECT a, a FROM u UNION SELECT r.x, u.b FROM r JOIN u ON u.a = r.y) SELECT x AS node, min(y) AS component FROM r GROUP BY x""")
def g9_components(spark, sf):
    e = table(spark, sf, "orders").select(F.col("o_custkey").alias("src"), (F.col("o_custkey") + 3).alias("dst"))
    return G.components(e)


@query()
def g10_greedy_clusters(spark, sf):
    p = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")
    return G.greedy_groups(S.nearest_of_all(p, 10, 0.3, same="label"), p)


@query("""WITH d AS (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem) SELECT x.l_suppkey AS a, y.l_suppkey AS b, count(*) AS n FROM d x JOIN d y USING (l_orderkey) WHERE x.l_suppkey < y.l_suppkey GROUP BY ALL HAVING count(*) >= 3""")
def g11_d14_co_recall(spark, sf):
    return G.co_recall(table(spark, sf, "lineitem"), "l_orderkey", "l_suppkey", 3)


def made_edges(spark, sf, new: bool) -> DataFrame:
    """The first three lines of each order as edges that are known, the others as incoming ones."""
    li = table(spark, sf, "lineitem").where("l_linenumber > 3" if new else "l_linenumber <= 3")
    rank = F.when(F.col("l_linenumber") % 2 == 0, "lsp" if new else "heuristic").otherwise("tree-sitter")
    return li.select(
        F.col("l_suppkey").alias("from_symbol"), F.col("l_returnflag").alias("edge_type"), F.concat(F.lit("f"), F.col("l_partkey") % 10).alias("to_file"), F.col("l_partkey").alias("to_symbol"),
        rank.alias("confidence"), F.concat(F.lit("d"), "l_orderkey").alias("descriptor"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("at"),
    )


MADE = """l AS (SELECT l_suppkey AS from_symbol, l_returnflag AS edge_type, 'f' || (l_partkey % 10) AS to_file, l_partkey AS to_symbol, l_linenumber AS no, 'd' || l_orderkey AS descriptor, l_orderkey * 10 + l_linenumber AS ord FROM lineitem),
o AS (SELECT * EXCLUDE (no), CASE WHEN no % 2 = 0 THEN 'heuristic' ELSE 'tree-sitter' END AS confidence FROM l WHERE no <= 3), n AS (SELECT * EXCLUDE (no), CASE WHEN no % 2 = 0 THEN 'lsp' ELSE 'tree-sitter' END AS confidence FROM l WHERE no > 3)"""
RANK = "coalesce(list_position(['heuristic', 'tree-sitter', 'scip', 'lsp'], {0}), 0)"


@query(f"""WITH {MADE}, x AS (SELECT from_symbol, edge_type, to_symbol, confidence, ord, {RANK.format("confidence")} AS r, 0 AS fresh FROM o UNION ALL SELECT from_symbol, edge_type, to_symbol, confidence, ord, {RANK.format("confidence")}, 1 FROM n)
SELECT from_symbol, edge_type, to_symbol, confidence FROM x QUALIFY row_number() OVER (PARTITION BY from_symbol, edge_type, to_symbol ORDER BY r DESC, fresh DESC, ord) = 1""")
def d8_d9_edge_overlay(spark, sf):
    merged = G.overlay(made_edges(spark, sf, False), made_edges(spark, sf, True), ["from_symbol", "edge_type", "to_symbol"], "at")
    return merged.select("from_symbol", "edge_type", "to_symbol", "confidence")


@query(f"""WITH {MADE}, b AS (SELECT from_symbol, edge_type, arg_max(struct_pack(f := to_file, s := to_symbol, c := confidence, d := descriptor), ord) AS i FROM n GROUP BY ALL),
j AS (SELECT o.*, i, i IS NOT NULL AND {RANK.format("i.c")} > {RANK.format("confidence")} AS raised FROM o LEFT JOIN b USING (from_symbol, edge_type))
SELECT from_symbol, edge_type, CASE WHEN raised THEN i.f ELSE to_file END AS to_file, CASE WHEN raised THEN i.s ELSE to_symbol END AS to_symbol, CASE WHEN raised THEN i.c ELSE confidence END AS confidence, CASE WHEN raised THEN i.d ELSE descriptor END AS descriptor FROM j
UNION ALL SELECT from_symbol, edge_type, to_file, to_symbol, confidence, descriptor FROM n WHERE NOT EXISTS (SELECT 1 FROM j WHERE raised AND j.from_symbol = n.from_symbol AND j.edge_type = n.edge_type)""")
def d7_edge_merge(spark, sf):
    return G.merge_edges(made_edges(spark, sf, False).drop("at"), made_edges(spark, sf, True), "at")


@query(f"""WITH {EDGES}, h AS (SELECT 1000001 AS file UNION ALL SELECT 2), n AS (SELECT DISTINCT u.dst AS file FROM u JOIN h ON u.src = h.file WHERE u.dst NOT IN (SELECT file FROM h)),
c AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_partkey AS file, l_quantity / 50 AS score FROM lineitem), r AS (SELECT c.*, row_number() OVER (PARTITION BY file ORDER BY score DESC, id) AS r FROM c JOIN n USING (file) WHERE score > 0.5)
SELECT file, id, round(score, 6) AS score FROM r WHERE r <= 2 ORDER BY score DESC, id LIMIT 10""")
def d3_d4_neighbour_chunks(spark, sf):
    hits = nodes(spark, [1_000_001, 2]).withColumnRenamed("node", "file")
    chunks = table(spark, sf, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_partkey").alias("file"), (F.col("l_quantity") / 50).alias("score"))
    return G.best_chunks(hits, edges(spark, sf), chunks, 2, 0.5, 10).withColumn("score", F.round("score", 6))
