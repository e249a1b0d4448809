"""Queries of intervals, enclosing ranges, an external index's edges and calls."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewell.operators import ranges as R
from tidewell.plans.registry import query
from tidewell.session import table


def _day(c):
    return F.datediff(F.col(c), F.lit("1992-01-01").cast("date")).cast("long")


@query("""WITH o AS (SELECT o_orderkey, o_custkey, date_diff('day', DATE '1992-01-01', o_orderdate::DATE) AS a, a + o_orderkey % 90 AS b FROM orders),
l AS (SELECT l_orderkey, l_linenumber, o_custkey, date_diff('day', DATE '1992-01-01', l_shipdate::DATE) AS c, c + 1 + l_linenumber * l_quantity::BIGINT % 40 AS d FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT o_custkey, o_orderkey, count(*) AS n, sum(l_orderkey * 10 + l_linenumber)::BIGINT AS lines FROM o JOIN l USING (o_custkey) WHERE a <= d AND c <= b GROUP BY 1, 2""")
def d22_overlap_join(spark, sf):
    """Each order's span of days with the spans of shipments of the same customer, which overlap it."""
    orders = table(spark, sf, "orders")
    o = orders.select("o_custkey", "o_orderkey", _day("o_orderdate").alias("a")).withColumn("b", F.col("a") + F.col("o_orderkey") % 90)
    ships = table(spark, sf, "lineitem").join(orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    ships = ships.select("o_custkey", "l_orderkey", "l_linenumber", _day("l_shipdate").alias("c"), (F.col("l_linenumber") * F.col("l_quantity").cast("long") % 40 + 1).alias("more"))
    ships = ships.withColumn("d", F.col("c") + F.col("more")).drop("more")
    pairs = R.overlap_join(o, ships, ["o_custkey"], ("a", "b"), ("c", "d"))
    return pairs.groupBy("o_custkey", "o_orderkey").agg(F.count("*").alias("n"), F.sum(F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("long").alias("lines"))


#: Nested ranges from orders: each customer is a file, an order a block of 64 lines, with blocks inside by the bits of its number.
RANGES_SQL = """o AS (SELECT 'f' || o_custkey AS file, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS i, o_orderkey AS k FROM orders),
r AS (SELECT file, i * 64 AS low, i * 64 + 50 AS high, 'A' || k AS name FROM o UNION ALL SELECT file, i * 64 + 2 + k % 5, i * 64 + 40, 'B' || k FROM o WHERE k % 2 = 0 UNION ALL SELECT file, i * 64 + 10, i * 64 + 10 + k % 20, 'C' || k FROM o WHERE k % 3 = 0
UNION ALL SELECT file, i * 64 + 45, i * 64 + 48, 'D' || k FROM o WHERE k % 7 < 3)"""


def _ranges(spark, sf):
    o = table(spark, sf, "orders").select(F.concat(F.lit("f"), "o_custkey").alias("file"), F.col("o_orderkey").alias("k"), ((F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1) * 64).alias("at"))
    k, at = F.col("k"), F.col("at")
    block = lambda low, high, name, when=None: F.when(F.lit(True) if when is None else when, F.struct(low.cast("long").alias("low"), high.cast("long").alias("high"), F.concat(F.lit(name), k).alias("name")))
    blocks = F.array_compact(F.array(block(at, at + 50, "A"), block(at + 2 + k % 5, at + 40, "B", k % 2 == 0), block(at + 10, at + 10 + k % 20, "C", k % 3 == 0), block(at + 45, at + 48, "D", k % 7 < 3)))
    return o, o.select("file", F.inline(blocks))


@query(f"""WITH {RANGES_SQL}, p AS (SELECT file, i * 64 + (k * 7 + j * 13) % 60 AS at, k || ':' || j AS point FROM o, range(5) t(j))
SELECT p.file, p.at, p.point, r.name FROM p LEFT JOIN r ON r.file = p.file AND p.at BETWEEN r.low AND r.high QUALIFY row_number() OVER (PARTITION BY p.file, p.point ORDER BY r.low DESC, r.high, r.name DESC) = 1""")
def k11_enclosing_ranges(spark, sf):
    """The innermost block around five places of each order."""
    o, ranges = _ranges(spark, sf)
    points = o.select("file", "k", "at", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("j")).select("file", (F.col("at") + (F.col("k") * 7 + F.col("j") * 13) % 60).alias("at"), F.concat("k", F.lit(":"), "j").alias("point"))
    return R.enclosing(ranges, points)


OCCURRENCES_SQL = """o AS (SELECT 'src/f' || l_suppkey || '.ts' AS file, l_orderkey * 10 + l_linenumber AS seq, 'scip npm p' || (l_partkey % 7) || ' m' || (l_partkey % 50) || '/' || ['Shop' || (l_partkey % 300) || '#', 'Shop' || (l_partkey % 300) || '#pay().', 'total' || (l_partkey % 300) || '.', 'open' || (l_partkey % 300) || '()'][l_linenumber % 4 + 1] AS symbol,
l_orderkey AS line, CASE WHEN l_orderkey % 6 = 0 THEN 1 WHEN l_orderkey % 6 = 1 THEN 9 ELSE 8 END AS roles FROM lineitem)"""
NAME_SQL = "rtrim(regexp_split_to_array({0}, '[\\s/]+')[-1], '.#()')"


def _occurrences(spark, sf):
    part, i = F.col("l_partkey"), F.col("l_linenumber")
    shop = F.concat(F.lit("Shop"), part % 300)
    ends = F.array(F.concat(shop, F.lit("#")), F.concat(shop, F.lit("#pay().")), F.concat(F.lit("total"), part % 300, F.lit(".")), F.concat(F.lit("open"), part % 300, F.lit("()")))
    symbol = F.concat(F.lit("scip npm p"), part % 7, F.lit(" m"), part % 50, F.lit("/"), F.get(ends, (i % 4).cast("int")))
    roles = F.when(F.col("l_orderkey") % 6 == 0, 1).when(F.col("l_orderkey") % 6 == 1, 9).otherwise(8)
    return table(spark, sf, "lineitem").select(F.concat(F.lit("src/f"), "l_suppkey", F.lit(".ts")).alias("file"), (F.col("l_orderkey") * 10 + i).alias("seq"), symbol.alias("symbol"), F.col("l_orderkey").alias("line"), roles.alias("roles"))


@query(f"""WITH {OCCURRENCES_SQL}, d AS (SELECT symbol, file AS to_file FROM o WHERE roles & 1 = 1 QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY file, seq) = 1)
SELECT DISTINCT file AS from_file, {NAME_SQL.format('symbol')} AS from_symbol, to_file, {NAME_SQL.format('symbol')} AS to_symbol, 'imports' AS edge_type, symbol FROM o JOIN d USING (symbol) WHERE roles & 1 = 0 AND file <> to_file""")
def k11_import_edges(spark, sf):
    occurrences = _occurrences(spark, sf)
    return R.import_edges(occurrences, R.definitions(occurrences))


@query(f"""WITH {OCCURRENCES_SQL}, d AS (SELECT symbol, file FROM o WHERE roles & 1 = 1 QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY file, seq) = 1),
r AS (SELECT CASE WHEN seq % 5 > 0 THEN file END AS file, symbol, CASE WHEN line % 4 = 0 THEN 'scip npm q x/Base' || (line % 20) || '#' ELSE replace(symbol, 'Shop', 'Shop1') END AS target, line % 3 = 0 AS implements, line % 2 = 0 AS type_of FROM o),
e AS (SELECT coalesce(a.file, r.file) AS from_file, {NAME_SQL.format('r.symbol')} AS from_symbol, coalesce(b.file, r.target) AS to_file, {NAME_SQL.format('r.target')} AS to_symbol, CASE WHEN implements THEN 'implements' WHEN type_of THEN 'extends' END AS edge_type, r.symbol FROM r LEFT JOIN d a ON r.symbol = a.symbol LEFT JOIN d b ON r.target = b.symbol)
SELECT from_file, from_symbol, to_file, to_symbol, edge_type, symbol FROM e WHERE edge_type IS NOT NULL AND from_file IS NOT NULL""")
def k11_inheritance_edges(spark, sf):
    o = _occurrences(spark, sf)
    target = F.when(F.col("line") % 4 == 0, F.concat(F.lit("scip npm q x/Base"), F.col("line") % 20, F.lit("#"))).otherwise(F.replace("symbol", F.lit("Shop"), F.lit("Shop1")))
    relations = o.select(F.when(F.col("seq") % 5 > 0, F.col("file")).alias("file"), "symbol", target.alias("target"), (F.col("line") % 3 == 0).alias("implements"), (F.col("line") % 2 == 0).alias("type_of"))
    return R.inheritance_edges(relations, R.definitions(o))


@query(f"""WITH {RANGES_SQL}, c AS (SELECT file, i * 64 + (k * 11 + j * 17) % 62 AS at, ['A', 'B', 'C', 'D', 'X'][(k + j) % 5 + 1] || CASE WHEN j % 2 = 0 THEN k ELSE (k // 3) * 3 END AS callee FROM o, range(4) t(j)),
m AS (SELECT DISTINCT file, 'B' || ((k // 3) * 3) AS name, 'f' || (k % 40) AS source_file FROM o),
s AS (SELECT DISTINCT c.file AS from_file, coalesce((SELECT max_by(r.name, r.low) FROM r WHERE r.file = c.file AND c.at BETWEEN r.low AND r.high), '<module>') AS from_symbol, callee AS to_symbol FROM c),
g AS (SELECT name, min(file) AS f FROM r GROUP BY 1), n AS (SELECT m.file, m.name, min(m.source_file) AS f FROM m JOIN r ON m.source_file = r.file AND m.name = r.name GROUP BY 1, 2)
SELECT * FROM (SELECT from_file, from_symbol, CASE WHEN EXISTS (SELECT 1 FROM r WHERE r.file = from_file AND r.name = to_symbol) THEN from_file ELSE coalesce(n.f, g.f) END AS to_file, to_symbol
FROM s LEFT JOIN n ON n.file = from_file AND n.name = to_symbol LEFT JOIN g ON g.name = to_symbol) WHERE to_file IS NOT NULL""")
def k10_call_edges(spark, sf):
    """Four calls of each order, by blocks of its file, of files that it imports from, and of any file."""
    o, declared = _ranges(spark, sf)
    k, j = F.col("k"), F.col("j")
    near = F.floor(k / 3) * 3
    word = F.get(F.array(*[F.lit(x) for x in "ABCDX"]), ((k + j) % 5).cast("int"))
    calls = o.select("file", "k", "at", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("j")).select("file", (F.col("at") + (k * 11 + j * 17) % 62).alias("at"), F.concat(word, F.when(j % 2 == 0, k).otherwise(near)).alias("callee"))
    imports = o.select("file", F.concat(F.lit("B"), near).alias("name"), F.concat(F.lit("f"), k % 40).alias("source_file")).distinct()
    return R.call_edges(declared, calls, imports)


@query(f"""WITH {OCCURRENCES_SQL} SELECT file, row_number() OVER (PARTITION BY file ORDER BY seq, symbol) - 1 AS seq, symbol, line, roles, CASE WHEN line % 5 = 0 THEN 'Base' || (line % 9) || '#' END AS target FROM o""")
def a19_index_files(spark, sf):
    """Index files in binary, seven of them, written from rows and read again, with each fifth line's relationship."""
    import uuid

    from tidewell.session import shared_dir
    from tidewell.sources import index_files as I  # noqa: E741

    place = F.row_number().over(Window.partitionBy("file").orderBy("seq", "symbol")) - 1
    o = _occurrences(spark, sf).withColumn("seq", place.cast("long"))
    of = F.array_sort(F.collect_list(F.struct("seq", "symbol", "line", "roles")))  # a supplier's file
    base = F.concat(F.lit("Base"), F.col("line") % 9, F.lit("#"))
    related = F.collect_list(F.when(F.col("line") % 5 == 0, F.struct(F.concat("symbol", F.lit("@"), "seq").alias("symbol"), base.alias("target"), (F.col("line") % 3 == 0).alias("implements"), F.lit(True).alias("type_of"))))
    documents = o.groupBy("file").agg(of.alias("occurrences"), related.alias("relations")).withColumn("index", F.concat(F.lit("part"), F.pmod(F.xxhash64("file"), F.lit(7))))
    root = f"{shared_dir(spark)}/index-{uuid.uuid4().hex}"
    I.write_index(documents, root)
    rows = I.read_index(spark, root)
    relations = rows.where("kind = 'relation'").select("file", F.substring_index("symbol", "@", -1).cast("long").alias("seq"), "target")
    return rows.where("kind = 'occurrence'").select("file", "seq", "symbol", "line", "roles").join(relations, ["file", "seq"], "left")
