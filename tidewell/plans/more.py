"""Further queries: governance moves, links, symbol lookup, contract parsing."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell.functions import scoring
from tidewell.functions import text as T
from tidewell.operators import chunking as K
from tidewell.operators import evaluate as Q
from tidewell.operators import governance as V
from tidewell.operators import search as S
from tidewell.plans.memory import MEM, memories, now
from tidewell.plans.registry import query
from tidewell.plans.search import COS, SEED, points, vector_of
from tidewell.session import table
from tidewell.sources import files as files_


@query("SELECT t.id, t.term, coalesce(n.w, t.w) AS weight FROM (SELECT l_orderkey AS id, 't' || l_linenumber AS term, max(l_quantity) AS w FROM lineitem GROUP BY ALL) t LEFT JOIN (SELECT l_orderkey AS id, 't' || l_linenumber AS term, 0.5::DOUBLE AS w FROM lineitem WHERE l_orderkey < 50 GROUP BY ALL) n USING (id, term)")
def a6_upsert_sparse(spark, sf):
    from tidewell.operators.memory import upsert

    rows = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("id"), F.concat(F.lit("t"), "l_linenumber").alias("term")).agg(F.max("l_quantity").alias("weight"))
    keyed = rows.withColumn("key", F.struct("id", "term"))
    return upsert(keyed, keyed.where("id < 50").withColumn("weight", F.lit(0.5)), "key").select("id", "term", "weight")


@query(f"""WITH a AS (SELECT vec_id AS id, row_number() OVER (ORDER BY {COS.format(q=SEED.format(i=2))} DESC, vec_id) AS r FROM embeddings e QUALIFY r <= 20), k AS (SELECT vec_id AS id, row_number() OVER (ORDER BY label DESC, vec_id) AS r FROM embeddings QUALIFY r <= 20)
SELECT id, round(sum(1.0::DOUBLE / (60 + r)), 6) AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM k) GROUP BY id ORDER BY sum(1.0::DOUBLE / (60 + r)) DESC, id LIMIT 10""")
def c11_c12_hybrid(spark, sf):
    p = points(spark, sf)
    sparse = p.select("id", F.col("label").alias("score")).orderBy(F.desc("score"), "id").limit(20)
    return S.fuse([S.search(p, vector_of(spark, sf, 2), 20).select("id", "score"), sparse], 10).withColumn("score", F.round("score", 6))


@query(f"""SELECT vec_id AS id, label = 4 AS exact, round(CASE WHEN vec_id = 17 THEN 2.0 ELSE {COS.format(q=SEED.format(i=17))} END, 6)::DOUBLE AS score FROM embeddings e WHERE label % 2 = 0 AND (vec_id = 17 OR {COS.format(q=SEED.format(i=17))} >= 0.1) ORDER BY score DESC, id LIMIT 10""")
def c16_d12_find_symbol(spark, sf):
    s = points(spark, sf).withColumn("name", F.concat(F.lit("s"), "id")).withColumn("kind", F.when(F.col("label") % 2 == 0, "even").otherwise("odd"))
    hits = V.find_symbol(s, "s17", vector_of(spark, sf, 17), "even", 0.1)
    return hits.select("id", (F.col("label") == 4).alias("exact"), F.round("score", 6).alias("score"))


@query("""WITH h AS (SELECT DISTINCT l_suppkey AS f FROM lineitem WHERE l_orderkey < 40 ORDER BY f LIMIT 10), e AS (SELECT DISTINCT l_suppkey AS f, l_partkey AS d FROM lineitem),
r AS (SELECT f, d FROM e JOIN h USING (f) QUALIFY row_number() OVER (PARTITION BY f ORDER BY d) <= 5) SELECT f AS file, array_to_string(list(d ORDER BY d), ',') AS connected FROM r GROUP BY f""")
def d5_connections(spark, sf):
    li = table(spark, sf, "lineitem")
    hits = li.where("l_orderkey < 40").select(F.col("l_suppkey").alias("file")).distinct().withColumn("rank", F.lit(1))
    c = V.connections(hits, li.select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst")))
    return c.select("file", F.array_join("connected", ",").alias("connected"))


@query("SELECT DISTINCT o_orderkey AS id, 0.5::DOUBLE AS score FROM orders WHERE o_custkey <= 5 AND o_orderpriority = '1-URGENT' AND o_orderkey % 3 > 0")
def d6_memory_links(spark, sf):
    o = table(spark, sf, "orders")
    edges = o.select(F.col("o_orderkey").alias("from_id"), F.col("o_custkey").alias("to_file"), F.when(F.col("o_orderpriority") == "1-URGENT", "memory_references").otherwise("imports").alias("edge_type"))
    files = table(spark, sf, "customer").where("c_custkey <= 5").select(F.col("c_custkey").alias("file"))
    return V.memory_links(files, edges, o.where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("id")))


@query("""WITH t AS (SELECT vec_id // 25 AS session, vec_id AS turn, embedding::DOUBLE[] AS v, 10 + vec_id % 50 AS n FROM embeddings)
SELECT a.session, a.turn AS a, b.turn AS b, round(list_cosine_similarity(a.v, b.v), 6) AS score FROM t a JOIN t b ON a.session = b.session AND a.turn < b.turn WHERE greatest(a.n, b.n) <= 4 * least(a.n, b.n) AND list_cosine_similarity(a.v, b.v) >= 0.3""")
def d15_similar_turns(spark, sf):
    t = points(spark, sf).select(F.floor(F.col("id") / 25).alias("session"), F.col("id").alias("turn"), "vector", (10 + F.col("id") % 50).alias("n_chars"))
    return V.similar_turns(t, 0.3).withColumn("score", F.round("score", 6))


@query("""SELECT l_orderkey AS query_id, array_to_string(list_sort(list(DISTINCT l_partkey)), ',') AS expected, o_orderstatus AS text FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_linenumber - 2 > 0 GROUP BY ALL""")
def d18_qrels(spark, sf):
    qrels = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("query_id"), F.col("l_partkey").alias("corpus_id"), (F.col("l_linenumber") - 2).alias("score"))
    queries = table(spark, sf, "orders").select(F.col("o_orderkey").alias("query_id"), F.col("o_orderstatus").alias("text"))
    return V.relevant(qrels, queries).withColumn("expected", F.array_join("expected", ","))


@query("""SELECT o_orderkey AS id, p_name AS signature FROM orders JOIN (SELECT l_orderkey, arg_min(l_partkey, (l_linenumber, l_partkey)) AS p FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey JOIN part ON p_partkey = p""")
def d20_top_signature(spark, sf):
    first = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.min(F.struct("l_linenumber", "l_partkey"))["l_partkey"].alias("p"))
    return table(spark, sf, "orders").join(first, F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, sf, "part"), F.col("p_partkey") == F.col("p")).select(F.col("o_orderkey").alias("id"), F.col("p_name").alias("signature"))


@query("SELECT DISTINCT least(l_suppkey, l_partkey) AS a, greatest(l_suppkey, l_partkey) AS b FROM lineitem")
def d21_link_union(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.select(F.least("l_suppkey", "l_partkey").alias("a"), F.greatest("l_suppkey", "l_partkey").alias("b")).dropDuplicates()


@query("""WITH r AS (SELECT l_orderkey AS id, any_value(l_returnflag) AS f, max(l_quantity) / 50 AS recall FROM lineitem GROUP BY 1) SELECT o_orderstatus AS category, count(*) AS n, round(avg(recall), 6)::DOUBLE AS recall FROM r JOIN orders ON id = o_orderkey GROUP BY 1""")
def e24_metric_summary(spark, sf):
    r = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg((F.max("l_quantity") / 50).alias("recall"))
    rows = r.join(table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("category")), "id")
    return Q.summary(rows, "category").withColumn("recall", F.round("recall", 6))


@query(f"""WITH a AS (SELECT vec_id AS id, row_number() OVER (ORDER BY {COS.format(q=SEED.format(i=3))} DESC, vec_id) AS r FROM embeddings e QUALIFY r <= 20), b AS (SELECT vec_id AS id, row_number() OVER (ORDER BY {COS.format(q=SEED.format(i=4))} DESC, vec_id) AS r FROM embeddings e QUALIFY r <= 20),
c AS (SELECT vec_id AS id, row_number() OVER (ORDER BY {COS.format(q=SEED.format(i=5))} DESC, vec_id) AS r FROM embeddings e QUALIFY r <= 20)
SELECT id, round(sum(1.0::DOUBLE / (60 + r)), 6) AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c) GROUP BY id ORDER BY sum(1.0::DOUBLE / (60 + r)) DESC, id LIMIT 10""")
def f2_multi_query(spark, sf):
    return V.multi_query(points(spark, sf), [vector_of(spark, sf, i) for i in (3, 4, 5)], 10).withColumn("score", F.round("score", 6))


@query(f"SELECT vec_id AS id, round(label / 10.0 + CASE WHEN vec_id % 2 = 0 THEN 0.3 * greatest(0, {COS.format(q=SEED.format(i=1))}) ELSE 0 END, 6)::DOUBLE AS score FROM embeddings e")
def f7_trigger_boost(spark, sf):
    trigger = F.when(F.col("id") % 2 == 0, F.col("vector")).otherwise(F.slice("vector", 1, 8))
    return points(spark, sf).select("id", F.round(V.trigger_boost(F.col("label") / 10, trigger, vector_of(spark, sf, 1)), 6).alias("score"))


@query("SELECT event_id, round(0.4 * (event_id % 10) / 10 + 0.3 * (user_id % 5) / 5 + 0.2 * least(1, user_id / 10) + 0.1 * CASE WHEN event_type = 'error' THEN 1.0 WHEN value > 100 THEN 0.7 WHEN value > 50 THEN 0.5 ELSE 0.3 END, 6)::DOUBLE AS score FROM events")
def f14_working_score(spark, sf):
    e = table(spark, sf, "events")
    emotion = scoring.emotion(F.col("event_type") != "error", F.col("value") * 100)
    return e.select("event_id", F.round(scoring.working_score(F.col("event_id") % 10 / 10, F.col("user_id") % 5 / 5, F.col("user_id"), emotion), 6).alias("score"))


@query("""WITH d AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN '#' ELSE '//' END AS c FROM documents)
SELECT doc_id, c || ' File: d/' || doc_id || ' [docs]' || CASE doc_id % 3 WHEN 0 THEN chr(10) || c || ' Layer: api | Service: Store' || doc_id WHEN 1 THEN chr(10) || c || ' Service: Store' || doc_id ELSE '' END
|| CASE WHEN doc_id % 7 > 0 THEN chr(10) || c || ' Defines: ' || array_to_string(list_transform(range(0, least(doc_id % 7, 5)), lambda i: 's' || i), ', ') ELSE '' END || CASE WHEN doc_id % 2 = 0 THEN chr(10) || c || ' Imports: lib/x' ELSE '' END AS header FROM d""")
def i11_anchor_header(spark, sf):
    i = F.col("doc_id")
    language = F.get(F.array(*[F.lit(x) for x in ("markdown", "typescript", "yaml", "go")]), (i % 4).cast("int"))
    symbols = F.when(i % 7 > 0, F.transform(F.sequence(F.lit(0), (i % 7 - 1).cast("int")), lambda x: F.concat(F.lit("s"), x)))
    header = K.anchor_header(F.concat(F.lit("d/"), i), language, F.lit("docs"), F.when(i % 3 == 0, "api"), F.when(i % 3 < 2, F.concat(F.lit("Store"), i)).otherwise(""), symbols, F.when(i % 2 == 0, F.array(F.lit("lib/x"))))
    return table(spark, sf, "documents").select("doc_id", header.alias("header"))


@query("SELECT doc_id, 'We use ' || source || '.' AS decision FROM documents")
def i22_decision_section(spark, sf):
    text = F.concat(F.lit("# Record\ncontext\n## Decision\nWe use "), "source", F.lit(".\n## Result\nfine"))
    return table(spark, sf, "documents").select("doc_id", T.decision_section(text).alias("decision"))


@query("SELECT doc_id, 'Title ' || doc_id AS heading, length('Title ' || doc_id || chr(10) || '=====' || chr(10) || translate(text, chr(10), ' '))::BIGINT AS n FROM documents UNION ALL SELECT doc_id, 'Second', length('Second' || chr(10) || '---------' || chr(10) || lang || ' ' || source)::BIGINT FROM documents")
def k3_rst_sections(spark, sf):
    """Each text as the first of two sections."""
    content = F.concat(F.lit("Title "), "doc_id", F.lit("\n=====\n"), F.translate("text", "\n", " "), F.lit("\nSecond\n---------\n"), "lang", F.lit(" "), "source")
    f = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("path"), content.alias("content"))
    return K.rst(f).select(F.col("path").cast("long").alias("doc_id"), F.substring_index("content", "\n", 1).alias("heading"), F.length("content").cast("long").alias("n"))


@query("SELECT c_custkey AS id, 'name' AS key, 1 AS start_line FROM customer UNION ALL SELECT c_custkey, 'market-segment', 2 FROM customer UNION ALL SELECT c_custkey, 'k' || c_custkey, 4 FROM customer")
def k5_yaml_keys(spark, sf):
    content = F.concat(F.lit("name: "), "c_name", F.lit("\nmarket-segment:\n  of: "), "c_mktsegment", F.lit("\nk"), "c_custkey", F.lit(": 3"))
    f = table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("path"), content.alias("content"))
    return K.yaml_blocks(f).select(F.col("path").cast("long").alias("id"), "key", "start_line")


@query("SELECT c_custkey AS id, 'NAME=' || c_name || chr(10) || 'X=1' AS content FROM customer UNION ALL SELECT c_custkey, 'SEGMENT=' || c_mktsegment FROM customer")
def k5_env_blocks(spark, sf):
    content = F.concat(F.lit("NAME="), "c_name", F.lit("\nX=1\n \nSEGMENT="), "c_mktsegment", F.lit("\n\n"))
    f = table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("path"), content.alias("content"))
    return K.env_blocks(f).select(F.col("path").cast("long").alias("id"), "content")


@query("SELECT p_partkey AS id, 'message' AS kind, 'Part' || p_partkey AS name, 2 AS start_line FROM part UNION ALL SELECT p_partkey, 'enum', 'Size', 5 FROM part UNION ALL SELECT p_partkey, 'service', 'Brand' || p_size, 8 FROM part")
def k6_contract_blocks(spark, sf):
    content = F.concat(F.lit('syntax = "p";\nmessage Part'), "p_partkey", F.lit(" {\n  int32 a = 1;\n}\nenum Size {\n  A = 0;\n}\nservice Brand"), "p_size", F.lit(" {\n}"))
    f = table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("path"), content.alias("content"))
    return K.contract_blocks(f).select(F.col("path").cast("long").alias("id"), "kind", "name", "start_line")


@query("SELECT p_partkey AS id, '/parts/' || p_partkey AS route, 'get,post' AS methods FROM part UNION ALL SELECT p_partkey, '/brands', 'delete' FROM part")
def k6_openapi_paths(spark, sf):
    content = F.concat(F.lit("openapi: 3.0.0\npaths:\n  /parts/"), "p_partkey", F.lit(":\n    get:\n      summary: one\n    post:\n      summary: two\n  /brands:\n    delete:\n      summary: get it\ncomponents:\n  /not:\n    get: 1"))
    f = table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("path"), content.alias("content"))
    return K.openapi_paths(f).select(F.col("path").cast("long").alias("id"), "route", F.array_join("methods", ",").alias("methods"))


@query("SELECT doc_id AS memory_id, 'created' AS op, sha256(text) AS content_hash FROM documents")
def n1_remember(spark, sf):
    m = memories(spark, sf).select("id", "content")
    log = spark.createDataFrame([], "memory_id long, op string, content_hash string, at timestamp")
    return V.remember(m.limit(0), log, m, now())[1].select("memory_id", "op", "content_hash")


@query(f"WITH {MEM} SELECT outcome, source, count(*) AS n FROM (SELECT source, CASE WHEN id % 5 = 0 THEN 'promoted' ELSE 'rejected' END AS outcome FROM m WHERE source <> 'manual' AND id % 5 IN (0, 1)) GROUP BY ALL UNION ALL SELECT 'left', source, count(*) FROM m WHERE source <> 'manual' AND id % 5 NOT IN (0, 1) GROUP BY ALL")
def n3_review(spark, sf):
    m = memories(spark, sf)
    waiting = m.where("source <> 'manual'")
    verdicts = waiting.where("id % 5 in (0, 1)").select("id", F.when(F.col("id") % 5 == 0, "promote").otherwise("reject").alias("verdict"))
    left, _, outcomes = V.review(waiting, m.limit(0), verdicts, now())
    done = outcomes.groupBy("outcome", "source").agg(F.count("*").alias("n"))
    return done.unionByName(left.groupBy("source").agg(F.count("*").alias("n")).withColumn("outcome", F.lit("left")))


@query(f"WITH {MEM} SELECT id, CASE WHEN id % 25 < 3 THEN 'merged:' || (id // 25) ELSE superseded_by END AS superseded_by FROM m")
def n8_compaction(spark, sf):
    m = memories(spark, sf)
    clusters = m.where("id % 25 < 3").select("id", F.floor(F.col("id") / 25).alias("cluster"))
    return V.compact(m, clusters)[1].select("id", "superseded_by")


@query("""SELECT doc_id AS id, 'new' || chr(10) || 'line' || chr(10) || 'end' AS content, 'path:z/' || CASE WHEN doc_id % 2 = 0 THEN 'b' ELSE 'b/c' END AS tag FROM documents WHERE doc_id % 3 = 0 AND doc_id % 2 = 0
UNION ALL SELECT doc_id, 'old' || chr(10) || 'end', 'path:z/b/c' FROM documents WHERE doc_id % 3 = 0 AND doc_id % 2 = 1""")
def n17_path_commands(spark, sf):
    d = table(spark, sf, "documents")
    path = F.when(F.col("doc_id") % 3 > 0, "path:y").when(F.col("doc_id") % 2 == 0, "path:a/b").otherwise("path:a/b/c")
    rows = d.select(F.col("doc_id").alias("id"), F.lit("old\nend").alias("content"), F.array(path).alias("tags"))
    rows = V.insert_line(V.replace_text(rows, "a/b", "old", "new"), "a/b", 1, "line")
    rows = V.delete_path(V.rename_path(rows, "a", "z"), "y")
    return V.view_path(rows, "/z").select("id", "content", F.get("tags", F.lit(0)).alias("tag"))


@query("SELECT user_id, string_agg(event_type || ' ' || event_id, chr(10) ORDER BY ts, event_id) AS summary FROM (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 50) GROUP BY user_id")
def p6_event_summary(spark, sf):
    return V.event_summary(table(spark, sf, "events"), "user_id", ["ts", "event_id"], F.concat_ws(" ", "event_type", "event_id"))


@query("SELECT CASE doc_id % 3 WHEN 0 THEN 'd' || doc_id || '.yaml' WHEN 1 THEN 'd' || doc_id || '.md' ELSE 'd' || doc_id || '.txt' END AS path, CASE doc_id % 3 WHEN 0 THEN 2 WHEN 1 THEN 3 ELSE 1 END AS n FROM documents")
def p7_parsers(spark, sf):
    """Each document as a file of one of three kinds."""
    p = V.Parsers()
    p.register(r"\.ya?ml$", K.yaml_blocks)
    p.register(r"\.md$", lambda f: K.markdown(f, 0))
    p.register(".*", K.size_chunks)
    k, i = F.col("doc_id") % 3, F.col("doc_id")
    path = F.concat(F.lit("d"), i, F.when(k == 0, ".yaml").when(k == 1, ".md").otherwise(".txt"))
    content = F.when(k == 0, F.concat(F.lit("a: 1\nlang: "), "lang")).when(k == 1, F.concat(F.lit("# One\n"), F.translate("text", "\n#", "  "), F.lit("\n## Two\n\n# Three"))).otherwise(F.concat(F.lit("plain "), "lang"))
    f = table(spark, sf, "documents").select(path.alias("path"), content.alias("content"))
    return p.parse(f).groupBy("path").agg(F.count("*").cast("int").alias("n"))
