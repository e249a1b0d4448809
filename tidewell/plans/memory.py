"""Queries of section 2.11, the memory parts of 2.6 and the table operations of 2.1 and 2.4."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.functions import scoring
from tidewell.operators import memory as M
from tidewell.operators.search import token_overlap
from tidewell.plans.registry import query
from tidewell.session import table


def now():
    return F.expr("TIMESTAMP '2024-01-31 00:00:00'")


def memories(spark, sf) -> DataFrame:
    """The documents table as memories."""
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    i = F.col("doc_id")
    return d.select(
        i.alias("id"), F.col("text").alias("content"), F.when(i % 4 == 0, "note").when(i % 4 == 1, "decision").otherwise("insight").alias("type"),
        F.when(i % 3 == 0, "manual").otherwise("auto_conversation").alias("source"), ((i % 100) / 100).alias("confidence"), (F.col("quality") == 1).alias("validated"),
        (now() - F.make_dt_interval((i % 400).cast("int"))).alias("created_at"), F.when(i % 17 == 0, (i + 1).cast("string")).alias("superseded_by"),
        F.when(i % 10 == 0, "all").when(i % 10 == 1, "repo").alias("pin"), F.array(F.col("lang"), F.col("source")).alias("tags"), F.when(i % 6 == 0, F.concat(F.lit("t"), i)).alias("trigger"),
    )


MEM = """m AS (SELECT doc_id AS id, text AS content, CASE WHEN doc_id % 4 = 0 THEN 'note' WHEN doc_id % 4 = 1 THEN 'decision' ELSE 'insight' END AS type,
CASE WHEN doc_id % 3 = 0 THEN 'manual' ELSE 'auto_conversation' END AS source, (doc_id % 100) / 100.0::DOUBLE AS confidence, quality = 1 AS validated, (doc_id % 400) AS days,
CASE WHEN doc_id % 17 = 0 THEN cast(doc_id + 1 AS VARCHAR) END AS superseded_by, CASE WHEN doc_id % 10 = 0 THEN 'all' WHEN doc_id % 10 = 1 THEN 'repo' END AS pin,
[lang, d.source] AS tags, CASE WHEN doc_id % 6 = 0 THEN 't' || doc_id END AS trigger FROM documents d LEFT JOIN labels USING (doc_id))"""


@query("SELECT p_partkey AS id, CASE WHEN p_partkey % 5 = 0 THEN 'new' ELSE p_brand END AS brand FROM part UNION ALL SELECT 10000000 + s_suppkey, 'new' FROM supplier WHERE s_suppkey < 4")
def a5_upsert(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("brand"))
    new = p.where("id % 5 = 0").select("id", F.lit("new").alias("brand"), F.lit(2).alias("seq"))
    older = new.withColumn("brand", F.lit("old")).withColumn("seq", F.lit(1))
    more = table(spark, sf, "supplier").where("s_suppkey < 4").select((F.col("s_suppkey") + 10_000_000).alias("id"), F.lit("new").alias("brand"), F.lit(1).alias("seq"))
    return M.upsert(p, new.unionByName(older).unionByName(more))


@query("SELECT p_partkey AS id FROM part WHERE p_partkey % 2 = 1 AND NOT coalesce(p_size > 25, false)")
def a7_a8_delete(spark, sf):
    p = table(spark, sf, "part")
    gone = p.where("p_partkey % 2 = 0").select("p_partkey")
    return p.join(gone, "p_partkey", "left_anti").where(~F.coalesce(F.col("p_size") > 25, F.lit(False))).select(F.col("p_partkey").alias("id"))


@query("SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN 'patched' ELSE p_brand END AS brand, p_size AS size FROM part")
def a10_set_payload(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("brand"), F.col("p_size").alias("size"))
    return M.set_payload(p, p.where("id % 3 = 0").select("id", F.lit("patched").alias("brand"), F.lit(None).cast("int").alias("size")))


@query("SELECT vec_id AS id, label FROM embeddings WHERE vec_id IN (1, 5, 7)")
def a11_retrieve(spark, sf):
    ids = spark.createDataFrame([(1,), (5,), (7,), (10**9,)], "id long")
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "label").join(F.broadcast(ids), "id", "left_semi")


@query("SELECT vec_id AS id, label FROM embeddings WHERE label = 3 AND vec_id > 20 ORDER BY vec_id LIMIT 8")
def a12_scroll(spark, sf):
    return table(spark, sf, "embeddings").where("label = 3 and vec_id > 20").orderBy("vec_id").limit(8).select(F.col("vec_id").alias("id"), "label")


@query("""SELECT coalesce(o.path, n.path) AS path, CASE WHEN o.path IS NULL THEN 'added' WHEN n.path IS NULL THEN 'removed' WHEN o.h = n.h THEN 'unchanged' ELSE 'changed' END AS status
FROM (SELECT url AS path, md5(html) AS h FROM pages WHERE page_id % 5 > 0) o FULL JOIN (SELECT url AS path, md5(CASE WHEN page_id % 7 = 0 THEN 'x' ELSE html END) AS h FROM pages WHERE page_id % 4 > 0) n ON o.path = n.path""")
def d10_hash_diff(spark, sf):
    p = table(spark, sf, "pages")
    old = p.where("page_id % 5 > 0").select(F.col("url").alias("path"), F.md5("html").alias("hash"))
    new = p.where("page_id % 4 > 0").select(F.col("url").alias("path"), F.md5(F.when(F.col("page_id") % 7 == 0, "x").otherwise(F.col("html"))).alias("hash"))
    return M.hash_diff(old, new)


@query("SELECT o_orderkey AS id, o_custkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def d11_skip_known(spark, sf):
    known = table(spark, sf, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("id"))
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), "o_custkey").join(known, "id", "left_anti")


@query("SELECT c_custkey AS id, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def d13_semi(spark, sf):
    ended = table(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("id"))
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), "c_name").join(ended, "id", "left_semi")


@query("""SELECT id, cast(min(r) AS INTEGER) AS source_rank FROM (SELECT s_suppkey AS id, 0 AS r FROM supplier UNION ALL SELECT p_partkey, 1 FROM part UNION ALL SELECT c_custkey, 2 FROM customer) GROUP BY id""")
def d16_first_hit(spark, sf):
    of = lambda t, c: table(spark, sf, t).select(F.col(c).alias("id"))
    return M.first_hit([of("supplier", "s_suppkey"), of("part", "p_partkey"), of("customer", "c_custkey")])


@query("""SELECT o.o_orderkey AS id, coalesce(CASE WHEN o.o_orderkey % 6 = 0 THEN 'X' END, s.o_orderstatus) AS status, s.o_totalprice AS price FROM orders o JOIN orders s USING (o_orderkey) WHERE o.o_orderkey % 2 = 0""")
def d17_rollback(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"))
    live = o.select("id", F.lit("L").alias("status"), F.lit(0.0).alias("price"))
    return M.rollback(live, o.where("id % 2 = 0"), o.where("id % 6 = 0").select("id", F.lit("X").alias("status")))


@query(f"""WITH {MEM} SELECT id, round(confidence * exp(-days / (7 * (1 + 0.5 * (id % 3)))), 6) AS score FROM m WHERE superseded_by IS NULL AND exp(-days / (7 * (1 + 0.5 * (id % 3)))) >= 0.1 ORDER BY confidence * exp(-days / (7 * (1 + 0.5 * (id % 3)))) DESC, id LIMIT 20""")
def f11_long_term_recall(spark, sf):
    m = memories(spark, sf).withColumns({"score": F.col("confidence"), "last_accessed": F.col("created_at"), "stability": F.lit(7.0), "access_count": F.col("id") % 3})
    return M.long_term_recall(m, now(), 20).select("id", F.round("score", 6).alias("score"))


@query(f"""WITH {MEM}, a AS (SELECT id, row_number() OVER (ORDER BY confidence DESC, id) AS r FROM m WHERE type = 'note' QUALIFY r <= 30), b AS (SELECT id, row_number() OVER (ORDER BY days, id) AS r FROM m WHERE source = 'manual' QUALIFY r <= 30),
f AS (SELECT id, sum(1.0::DOUBLE / (60 + r)) AS s FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY id ORDER BY s DESC, id LIMIT 30)
SELECT id, round(s * CASE WHEN days > 30 AND NOT coalesce(validated, false) THEN 1 - least(0.5, (floor(days / 30) - 1) * 0.1) ELSE 1 END * 0.7 + exp(-days / 30) * 0.3, 6) AS score FROM f JOIN m USING (id) WHERE superseded_by IS NULL
ORDER BY s * CASE WHEN days > 30 AND NOT coalesce(validated, false) THEN 1 - least(0.5, (floor(days / 30) - 1) * 0.1) ELSE 1 END * 0.7 + exp(-days / 30) * 0.3 DESC, id LIMIT 10""")
def f12_multi_strategy_recall(spark, sf):
    m = memories(spark, sf)
    a = m.where("type = 'note'").select("id", F.col("confidence").alias("score")).orderBy(F.desc("score"), "id").limit(30)
    b = m.where("source = 'manual'").select("id", (-scoring.days_before(now(), F.col("created_at"))).alias("score")).orderBy(F.desc("score"), "id").limit(30)
    facts = m.select("id", "created_at", F.coalesce("validated", F.lit(False)).alias("exempt"), "superseded_by")
    return M.recall([a, b], facts, now()).withColumn("score", F.round("score", 6))


@query(f"WITH {MEM} SELECT id, CAST(days AS BIGINT) AS days FROM m WHERE days BETWEEN 31 AND 61 ORDER BY days, id LIMIT 20")
def f13_temporal_list(spark, sf):
    rows = M.temporal_list(memories(spark, sf), "between", "2023-12-01 00:00:00", "2023-12-31 23:59:59", 10)
    return rows.select("id", scoring.days_before(now(), F.col("created_at")).cast("long").alias("days"))


@query(f"""WITH {MEM}, s AS (SELECT 'pinned' AS section, 0 AS p, id, confidence AS score FROM m WHERE pin IS NOT NULL UNION ALL SELECT 'decisions', 1, id, confidence FROM m WHERE type = 'decision' UNION ALL SELECT 'recent', 2, id, confidence FROM m WHERE days <= 7),
f AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY id ORDER BY p) = 1), r AS (SELECT *, row_number() OVER (PARTITION BY section ORDER BY score DESC, id) AS place FROM f)
SELECT section, id, cast(place AS INTEGER) AS place, cast(row_number() OVER (ORDER BY p, place) AS INTEGER) AS line FROM r WHERE place <= CASE section WHEN 'pinned' THEN 15 ELSE 10 END""")
def f17_digest(spark, sf):
    m = memories(spark, sf).withColumn("days", scoring.days_before(now(), F.col("created_at")))
    part = lambda s, c: m.where(c).select(F.lit(s).alias("section"), "id", F.col("confidence").alias("score"))
    rows = part("pinned", "pin is not null").unionByName(part("decisions", "type = 'decision'")).unionByName(part("recent", "days <= 7"))
    return M.digest(rows, now(), {"pinned": 15, "decisions": 10, "recent": 10}).select("section", "id", "place", "line")


@query("SELECT event_id, user_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 5")
def f18_n16_tail(spark, sf):
    return M.tail(table(spark, sf, "events"), ["user_id"], ["ts", "event_id"], 5).select("event_id", "user_id")


@query(f"WITH {MEM} SELECT id, CASE WHEN source NOT LIKE 'auto\\_%' ESCAPE '\\' THEN 'durable' WHEN confidence < 0.5 THEN 'skip' ELSE 'quarantine' END AS route FROM m")
def n2_route(spark, sf):
    return M.route(memories(spark, sf), F.lit(0.5)).select("id", "route")


@query(f"WITH {MEM} SELECT id FROM m WHERE days > 200 AND type = 'note'")
def n4_n5_forget(spark, sf):
    return M.expired(memories(spark, sf), now(), 200).where("type = 'note'").select("id")


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 = 0 THEN 'done' ELSE o_orderstatus END AS status, CASE WHEN o_orderkey % 4 = 0 THEN 'open@1,done@2' ELSE 'open@1' END AS history FROM orders""")
def n6_todo_status(spark, sf):
    o = table(spark, sf, "orders")
    rows = o.select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.array(F.struct(F.lit("open").alias("status"), F.lit(1).alias("at"))).alias("history"))
    changes = o.where("o_orderkey % 4 = 0").select(F.col("o_orderkey").alias("id"), F.lit("done").alias("status"), F.lit(2).alias("at"))
    out = M.set_status(rows, changes)
    return out.select("id", "status", F.array_join(F.transform("history", lambda h: F.concat_ws("@", h["status"], h["at"])), ",").alias("history"))


@query(f"""WITH {MEM}, c AS (SELECT *, id % 40 AS cluster, id // 2 % 3 AS v FROM m)
SELECT cluster, string_agg(id, ',' ORDER BY id) AS merged_from, min(days) AS days, coalesce(bool_or(validated), false) AS validated, max(confidence) AS confidence, CASE WHEN bool_or(coalesce(pin = 'all', false)) THEN 'all' WHEN bool_or(coalesce(pin = 'repo', false)) THEN 'repo' END AS pin,
CASE WHEN bool_or(source = 'manual') THEN 'manual' ELSE 'auto_conversation' END AS source, arg_max(trigger, -days * 100000 + id) FILTER (trigger IS NOT NULL) AS trigger, (SELECT count(DISTINCT t) FROM (SELECT unnest(tags) AS t FROM c x WHERE x.cluster = c.cluster)) AS n_tags FROM c GROUP BY cluster""")
def n7_merge_clusters(spark, sf):
    out = M.merge_clusters(memories(spark, sf).withColumn("cluster", F.col("id") % 40))
    return out.select("cluster", F.array_join("merged_from", ",").alias("merged_from"), scoring.days_before(now(), F.col("created_at")).cast("long").alias("days"), F.coalesce("validated", F.lit(False)).alias("validated"), "confidence", "pin", "source", "trigger", F.size("tags").cast("long").alias("n_tags"))


@query("""WITH v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e, lead(embedding::DOUBLE[], 1, embedding::DOUBLE[]) OVER (ORDER BY vec_id) AS w FROM embeddings),
q AS (SELECT id + 1000000 AS id, list_transform(range(1, len(e) + 1), lambda i: e[i] + (id % 10) * 0.11 * w[i]) AS e, id % 3 AS type, id % 2 = 0 AS negated FROM v),
p AS (SELECT q.id, v.id AS target_id, list_cosine_similarity(q.e, v.e) AS score, type = v.id % 2 AS same, negated FROM q, v QUALIFY row_number() OVER (PARTITION BY q.id ORDER BY list_cosine_similarity(q.e, v.e) DESC, v.id) <= 5)
SELECT id, target_id, round(score, 6) AS score, CASE WHEN score > 0.85 AND same THEN 'supersedes' WHEN score > 0.8 AND negated AND same THEN 'contradicts' ELSE 'relates_to' END AS relation FROM p WHERE score > 0.75""")
def n10_relations(spark, sf):
    """A new memory beside each vector, moved towards the next one by steps, and how it relates to the five nearest."""
    from pyspark.sql import Window

    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("vector"))
    after = F.lead("vector").over(Window.orderBy("id"))  # the query's own making of its data
    moved = F.zip_with("vector", F.coalesce(after, "vector"), lambda x, y: x + (F.col("id") % 10) * 0.11 * y)
    new = e.select((F.col("id") + 1_000_000).alias("id"), moved.alias("vector"), (F.col("id") % 3).alias("type"), F.when(F.col("id") % 2 == 0, "use this instead").otherwise("use this").alias("content"))
    found = M.relations(new, e.withColumn("type", F.col("id") % 2))
    return found.withColumn("score", F.round("score", 6))


@query("""WITH l AS (SELECT user_id AS memory_id, event_id AS seq, CASE event_type WHEN 'error' THEN 'deleted' WHEN 'signup' THEN 'created' ELSE 'modified' END AS op, sha256(props) AS content FROM events)
SELECT memory_id, max(seq) AS seq, arg_max(op, seq) AS op, arg_max(content, seq) AS content, count(*) AS n_versions FROM l GROUP BY memory_id HAVING arg_max(op, seq) <> 'deleted'""")
def n11_versions(spark, sf):
    e = table(spark, sf, "events")
    t = F.col("event_type")
    log = e.select(F.col("user_id").alias("memory_id"), F.col("event_id").alias("seq"), F.when(t == "error", "deleted").when(t == "signup", "created").otherwise("modified").alias("op"), F.sha2("props", 256).alias("content"))
    return M.versions_of(log)


@query(f"""WITH {MEM}, r AS (SELECT id, CASE WHEN superseded_by <> '' THEN 'superseded' WHEN days > 30 AND source = 'auto_conversation' AND NOT coalesce(validated, false) THEN 'unvalidated'
WHEN source = 'auto_conversation' AND NOT coalesce(validated, false) AND confidence < 0.4 THEN 'low_confidence' WHEN days > 90 AND type = 'note' THEN 'old_note' END AS rule FROM m) SELECT * FROM r WHERE rule IS NOT NULL""")
def n12_stale(spark, sf):
    return M.stale(memories(spark, sf), now()).select("id", "rule")


@query("""SELECT user_id AS id, count(*) FILTER (event_type = 'view') AS access_count, round(7 * power(1.5, count(*) FILTER (event_type = 'view')), 4)::DOUBLE AS stability FROM events GROUP BY 1""")
def n13_strengthen(spark, sf):
    e = table(spark, sf, "events")
    hits = e.where("event_type = 'view'").groupBy(F.col("user_id").alias("id")).agg(F.count("*").alias("n"))
    rows = e.select(F.col("user_id").alias("id"), F.lit(0).cast("long").alias("access_count"), F.lit(7.0).alias("stability")).distinct()
    return M.strengthen(rows, hits).withColumn("stability", F.round("stability", 4))


@query(f"""WITH {MEM}, t AS (SELECT id, CASE id % 9 WHEN 0 THEN 'todo' WHEN 1 THEN 'procedure' WHEN 2 THEN 'context' WHEN 3 THEN 'odd' ELSE type END AS type FROM m)
SELECT CASE WHEN type IN ('note', 'todo', 'context') THEN 'episodic' ELSE 'semantic' END AS target, CASE WHEN type IN ('decision', 'insight', 'procedure') THEN type END AS subtype, type, count(*) AS n FROM t WHERE type <> 'odd' AND id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1) GROUP BY ALL""")
def n14_migrate(spark, sf):
    known = table(spark, sf, "labels").where("toxic = 1").select(F.col("doc_id").alias("id"))
    k = F.col("id") % 9
    rows = memories(spark, sf).withColumn("type", F.when(k == 0, "todo").when(k == 1, "procedure").when(k == 2, "context").when(k == 3, "odd").otherwise(F.col("type")))
    return M.migrated(rows, known).groupBy("target", "subtype", "type").agg(F.count("*").alias("n"))


@query("SELECT event_id AS seq, event_type AS op, sha256(props) AS content_hash, CASE WHEN event_id % 5 <> 0 THEN props END AS content, event_id % 5 = 0 AS redacted FROM events")
def n11_redact(spark, sf):
    log = table(spark, sf, "events").select(F.col("user_id").alias("memory_id"), F.col("event_id").alias("seq"), F.col("event_type").alias("op"), F.sha2("props", 256).alias("content_hash"), F.col("props").alias("content"))
    gone = log.where("seq % 5 = 0").select("memory_id", "seq")
    return M.redact(M.redact(log, gone), gone).drop("memory_id")


@query(f"""WITH {MEM} SELECT id, round(exp(-days / 30.0::DOUBLE), 6) AS retention FROM m WHERE id % 3 = 0 AND exp(-days / 30.0::DOUBLE) < 0.1""")
def n12_fading(spark, sf):
    m = memories(spark, sf).withColumns({"stability": F.lit(30.0), "access_count": F.when(F.col("id") % 3 > 0, F.col("id") % 3)})
    return M.fading(m, now()).select("id", F.round("retention", 6).alias("retention"))


@query(f"WITH {MEM} SELECT id FROM m WHERE superseded_by IS NULL OR id % 2 = 0")
def b10_standing(spark, sf):
    """Half of the pointers are made empty strings, which point at nothing."""
    m = memories(spark, sf).withColumn("superseded_by", F.when((F.col("id") % 2 == 0) & F.col("superseded_by").isNotNull(), "").otherwise(F.col("superseded_by")))
    return M.standing(m).select("id")


@query(f"""WITH {MEM}, a AS (SELECT id, row_number() OVER (ORDER BY confidence DESC, id) AS r FROM m WHERE type = 'note' QUALIFY r <= 30), b AS (SELECT id, row_number() OVER (ORDER BY days, id) AS r FROM m WHERE source = 'manual' QUALIFY r <= 30),
f AS (SELECT id, sum(1.0::DOUBLE / (60 + r)) AS s FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY id ORDER BY s DESC, id LIMIT 30),
t AS (SELECT *, list_distinct(list_filter(regexp_split_to_array(lower(substr(content, 1, 800)), '\\s+'), lambda w: w <> '')) AS w FROM f JOIN m USING (id)),
j AS (SELECT *, len(list_intersect(w, ['of', 'the', 'und'])) / (len(w) + 3 - len(list_intersect(w, ['of', 'the', 'und'])))::DOUBLE * 0.6 + s * 0.4 AS reranked FROM t ORDER BY reranked DESC, id LIMIT 20),
g AS (SELECT id, (reranked + CASE WHEN trigger IS NOT NULL THEN 0.3 ELSE 0 END) * CASE WHEN days > 30 AND NOT coalesce(validated, false) THEN 1 - least(0.5, (floor(days / 30) - 1) * 0.1) ELSE 1 END * 0.7 + exp(-days / 30) * 0.3 AS score FROM j WHERE superseded_by IS NULL)
SELECT id, round(score, 6) AS score FROM g ORDER BY g.score DESC, id LIMIT 10""")
def f12_recall_reranked(spark, sf):
    """The whole chain: fusion, rerank, triggers (of which each that is there counts in full), superseded rows, aging, recency."""
    m = memories(spark, sf)
    a = m.where("type = 'note'").select("id", F.col("confidence").alias("score")).orderBy(F.desc("score"), "id").limit(30)
    b = m.where("source = 'manual'").select("id", (-scoring.days_before(now(), F.col("created_at"))).alias("score")).orderBy(F.desc("score"), "id").limit(30)
    facts = m.select("id", "created_at", F.coalesce("validated", F.lit(False)).alias("exempt"), "superseded_by", "content", "trigger")
    raised = lambda score, trigger: score + F.when(trigger.isNotNull(), 0.3).otherwise(0.0)
    return M.recall([a, b], facts, now(), scorer=token_overlap("of the und"), trigger=raised).withColumn("score", F.round("score", 6))


@query(f"WITH {MEM} SELECT id, confidence FROM m WHERE source LIKE 'auto%' AND validated IS NULL ORDER BY confidence DESC, id LIMIT 25")
def n15_review_list(spark, sf):
    rows = memories(spark, sf).where(F.startswith("source", F.lit("auto_")) & F.col("validated").isNull())
    return rows.select("id", "confidence").orderBy(F.desc("confidence"), "id").limit(25)


@query(f"""WITH {MEM}, d AS (SELECT id, confidence AS score FROM m WHERE type = 'note' ORDER BY score DESC, id LIMIT 10), l AS (SELECT id, confidence * 0.9 AS score FROM m WHERE id % 2 = 0 ORDER BY score DESC, id LIMIT 10)
SELECT id, round(score, 6) AS score FROM (SELECT * FROM d UNION ALL SELECT * FROM l WHERE id NOT IN (SELECT id FROM d)) ORDER BY score DESC, id LIMIT 12""")
def d2_durable_long_term(spark, sf):
    m = memories(spark, sf)
    d = m.where("type = 'note'").select("id", F.col("confidence").alias("score")).orderBy(F.desc("score"), "id").limit(10)
    lt = m.where("id % 2 = 0").select("id", (F.col("confidence") * 0.9).alias("score")).orderBy(F.desc("score"), "id").limit(10)
    return M.durable_and_long_term(d, lt, 12).withColumn("score", F.round("score", 6))
