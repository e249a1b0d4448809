"""Queries of code cut at its declarations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell.operators import declarations as D
from tidewell.plans.registry import query
from tidewell.session import dealt, table

#: A file's text by k, in SQL that both engines read: a class of up to five methods, of which some are long, braces in strings and comments, and at times an interface.
CLASSES = """concat(repeat(concat('// note {', chr(10)), cast(k % 5 as int)), 'import { x } from "lib/m', k % 7, '"', chr(10), 'export class Shop', k, ' {', chr(10), '  n', k, ' = 1;', chr(10),
{methods}, '}', chr(10), CASE WHEN k % 2 = 0 THEN concat('interface I', k, ' { a: 1 }', chr(10)) ELSE '' END)"""
METHODS = ", ".join(f"CASE WHEN k % 6 > {j} THEN concat('  m{j}(a) {{', chr(10), repeat(concat('    if (a) {{ b(\"}}\") }}', chr(10)), cast(k % 4 * 40 as int)), '  }}', chr(10)) ELSE '' END" for j in range(5))


@query("""WITH f AS (SELECT o_orderkey AS k, o_orderkey % 5 AS h, o_orderkey % 6 AS n, o_orderkey % 4 * 40 AS r FROM orders),
g AS (SELECT *, length('export class Shop' || k || ' {') + length('  n' || k || ' = 1;') + 4 + n * (14 + r * 22) AS size, h + 4 + n * (r + 2) AS ends, array_to_string(list_transform(range(0, n), lambda j: ',m' || j), '') AS names FROM f),
c AS (SELECT k, 0 AS chunk, CASE WHEN size > 3000 AND n > 1 THEN 'class-summary' ELSE 'class' END AS kind, 'Shop' || k || names AS symbols, h + 2 AS start_line, ends AS end_line, CASE WHEN size > 3000 AND n > 1 THEN NULL ELSE size END AS n_chars, n > 1 AND size > 3000 AS cut FROM g)
SELECT k, chunk, kind, symbols, start_line, end_line, n_chars FROM c
UNION ALL SELECT k, j + 1, 'method', 'Shop' || k || '.m' || j, h + 4 + j * (r + 2), h + 5 + j * (r + 2) + r, 14 + r * 22 FROM g, range(5) t(j) WHERE size > 3000 AND n > 1 AND j < n
UNION ALL SELECT k, CASE WHEN size > 3000 AND n > 1 THEN n + 1 ELSE 1 END, 'interface', 'I' || k, ends + 1, ends + 1, length('I' || k) + 20 FROM g WHERE k % 2 = 0""")
def k8_declarations(spark, sf):
    keys = dealt(table(spark, sf, "orders").select(F.col("o_orderkey").alias("k")), "k")  # few bytes of a key become a file
    files = keys.select(F.col("k").cast("string").alias("path"), F.expr(CLASSES.replace("{methods}", METHODS)).alias("content"))
    chunks = D.declarations(files)
    n = F.when(F.col("kind") != "class-summary", F.length("content"))
    return chunks.select(F.col("path").cast("long").alias("k"), F.col("chunk").cast("long").alias("chunk"), "kind", F.array_join("symbols", ",").alias("symbols"), F.col("start_line").cast("long").alias("start_line"), F.col("end_line").cast("long").alias("end_line"), n.cast("long").alias("n_chars"))
