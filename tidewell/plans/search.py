"""Queries of sections 2.2, 2.3, 2.4 and 2.6: filters, search, fusion."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.functions import scoring, text, vectors
from tidewell.operators import graph as G
from tidewell.operators import indexes as X
from tidewell.operators import search as S
from tidewell.plans.registry import query
from tidewell.session import shared_dir, table, written

COS = "list_cosine_similarity(e.embedding::DOUBLE[], {q}::DOUBLE[])"
SEED = "(SELECT embedding FROM embeddings WHERE vec_id = {i})"


def points(spark, sf) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


def vector_of(spark, sf, i: int) -> list[float]:
    row = table(spark, sf, "embeddings").where(F.col("vec_id") == i).select("embedding").first()
    return list(row[0]) if row else [0.0] * 64


def rounded(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in cols or ("score",)})


@query(f"""SELECT vec_id AS id, label, round({COS.format(q=SEED.format(i=0))}, 6) AS score FROM embeddings e
WHERE label = (SELECT label FROM embeddings WHERE vec_id = 0) AND {COS.format(q=SEED.format(i=0))} >= 0.0 ORDER BY score DESC, id LIMIT 10""")
def c1_search(spark, sf):
    p = points(spark, sf)
    label = p.where("id = 0").select("label").first()[0]
    return rounded(S.search(p, vector_of(spark, sf, 0), 10, F.col("label") == label, 0.0).select("id", "label", "score"))


@query("""SELECT q.vec_id AS query_id, x.id, x.score, x.rank FROM embeddings q, LATERAL (
  SELECT e.vec_id AS id, round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS score,
  cast(row_number() OVER (ORDER BY list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) DESC, e.vec_id) AS INTEGER) AS rank
  FROM embeddings e WHERE e.vec_id <> q.vec_id QUALIFY rank <= 10) x WHERE q.vec_id % 100 = 0""")
def c2_batch_search(spark, sf):
    p = points(spark, sf)
    return rounded(S.batch_search(p, p.where("id % 100 = 0"), 10))


@query(f"""WITH s AS (SELECT vec_id AS id, label, {COS.format(q=SEED.format(i=1))} AS sc FROM embeddings e),
r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY sc DESC, id) AS n FROM s),
g AS (SELECT label FROM r WHERE n = 1 ORDER BY sc DESC, id LIMIT 4)
SELECT id, label, round(sc, 6) AS score, cast(n AS INTEGER) AS in_group FROM r WHERE n <= 3 AND label IN (SELECT label FROM g)""")
def c3_search_groups(spark, sf):
    scored = points(spark, sf).withColumn("score", vectors.cosine_to(F.col("vector"), vector_of(spark, sf, 1)))
    return rounded(S.search_groups(scored.drop("vector"), "label", 4, 3))


@query(f"""WITH s AS (SELECT vec_id AS id, CASE WHEN label % 3 = 0 THEN 'unknown' ELSE cast(label AS VARCHAR) END AS grp, {COS.format(q=SEED.format(i=2))} AS sc FROM embeddings e),
t AS (SELECT * FROM s ORDER BY sc DESC, id LIMIT 15), r AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY sc DESC, id) AS n FROM t),
g AS (SELECT grp FROM r WHERE n = 1 ORDER BY sc DESC, id LIMIT 5)
SELECT id, grp, round(sc, 6) AS score, cast(n AS INTEGER) AS in_group FROM r WHERE n <= 3 AND grp IN (SELECT grp FROM g)""")
def c4_group_fallback(spark, sf):
    grp = F.when(F.col("label") % 3 != 0, F.col("label").cast("string"))
    scored = points(spark, sf).withColumn("score", vectors.cosine_to(F.col("vector"), vector_of(spark, sf, 2))).select("id", grp.alias("grp"), "score")
    return rounded(S.group_results(scored, "grp", 5, 3))


@query("""WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings),
c AS (SELECT list_transform(range(1, 65), lambda i: 2 * (a.x[i] + b.x[i]) / 2 - n.x[i]) AS q FROM v a, v b, v n WHERE a.vec_id = 3 AND b.vec_id = 4 AND n.vec_id = 5)
SELECT vec_id AS id, round(list_cosine_similarity(x, q), 6) AS score FROM v, c WHERE vec_id NOT IN (3, 4, 5) ORDER BY list_cosine_similarity(x, q) DESC, id LIMIT 10""")
def c5_recommend(spark, sf):
    return rounded(S.recommend(points(spark, sf), [3, 4], [5], 10).select("id", "score"))


@query("""WITH p AS (SELECT a.vec_id AS query_id, b.vec_id AS id, list_cosine_similarity(b.embedding::DOUBLE[], a.embedding::DOUBLE[]) AS sc FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id IN (0, 1, 2))
SELECT query_id, id, round(sc, 6) AS score, cast(row_number() OVER (PARTITION BY query_id ORDER BY sc DESC, id) AS INTEGER) AS rank FROM p WHERE sc >= 0.3 QUALIFY rank <= 10""")
def c6_find_clusters(spark, sf):
    return rounded(S.near_each(points(spark, sf), [0, 1, 2], 0.3, 10))


@query("""WITH p AS (SELECT a.vec_id AS a, b.vec_id AS b, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS sc FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY sc DESC, b) AS n FROM p WHERE sc >= 0.3)
SELECT a AS query_id, count(*) AS n_near, min(b) AS first_near, round(max(sc), 6) AS best FROM r WHERE n <= 5 GROUP BY a""")
def c7_duplicate_candidates(spark, sf):
    p = points(spark, sf)
    near = S.batch_search(p, p.where("id % 100 = 0"), 5, 0.3)
    return near.groupBy("query_id").agg(F.count("*").alias("n_near"), F.min("id").alias("first_near"), F.round(F.max("score"), 6).alias("best"))


@query()
def c7_duplicate_groups(spark, sf):
    """(seed, member) over all points; c7_duplicate_candidates has the counts of some seeds, which SQL can say."""
    p = points(spark, sf)
    return G.greedy_groups(S.nearest_of_all(p, 5, 0.3), p)


WORDS_SQL = "list_filter(regexp_split_to_array(lower(text), '[^A-Za-z0-9_]+'), lambda w: length(w) > 2)"


@query(f"""WITH t AS (SELECT doc_id AS id, unnest({WORDS_SQL}) AS term FROM documents), f AS (SELECT id, term, count(*) AS tf FROM t GROUP BY ALL)
SELECT id, sum(tf * CASE term WHEN 'the' THEN 0.5 WHEN 'and' THEN 1.5 ELSE 2.0 END)::DOUBLE AS score FROM f WHERE term IN ('the', 'and', 'with') GROUP BY id ORDER BY score DESC, id LIMIT 10""")
def c9_sparse_search(spark, sf):
    """Inner products over stored postings, in blocks of 64 documents."""
    rows = postings_of(spark, sf)
    return X.search_postings(rows, {"the": 0.5, "and": 1.5, "with": 2.0}, lambda weight, length: weight.cast("double"), 10)


def postings_of(spark, sf, block: int = 64) -> DataFrame:
    at = f"{shared_dir(spark)}/postings-{uuid.uuid4().hex}"
    X.write_postings(table(spark, sf, "documents"), at, "doc_id", "text", block=block)
    return spark.read.parquet(f"{at}/postings")


@query(f"""WITH d AS (SELECT doc_id AS id, {WORDS_SQL} AS w FROM documents), s AS (SELECT id, len(w) AS n, unnest(['from', 'this', 'with']) AS t, w FROM d),
f AS (SELECT id, n, t, len(list_filter(w, lambda x: x = t)) AS tf FROM s), a AS (SELECT count(*) AS docs, avg(len(w)) AS mean FROM d),
i AS (SELECT t, ln(1 + ((SELECT docs FROM a) - count(*) FILTER (tf > 0) + 0.5) / (count(*) FILTER (tf > 0) + 0.5)) AS idf FROM f GROUP BY t)
SELECT id, round(sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / mean))), 6) AS score FROM f JOIN i USING (t), a GROUP BY id HAVING sum(tf) > 0 ORDER BY sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / mean))) DESC, id LIMIT 10""")
def c10_bm25(spark, sf):
    """Postings of all texts, stored, and a search of them."""
    at = f"{shared_dir(spark)}/postings-{uuid.uuid4().hex}"
    X.write_postings(table(spark, sf, "documents"), at, "doc_id", "text")
    return rounded(X.bm25_search(spark, at, ["from", "with", "this"], 10))


@query(f"""WITH a AS (SELECT doc_id AS id, {WORDS_SQL} AS w, len(w) AS n FROM documents), q AS (SELECT unnest(['the', 'und', 'para', 'nowhere9']) AS t), m AS (SELECT count(*) AS docs, avg(n) AS mean FROM a),
f AS (SELECT id, n, t, len(list_filter(w, lambda x: x = t)) AS tf FROM a, q), i AS (SELECT t, ln(1 + ((SELECT docs FROM m) - count(*) FILTER (tf > 0) + 0.5) / (count(*) FILTER (tf > 0) + 0.5)) AS idf FROM f GROUP BY t HAVING count(*) FILTER (tf > 0) > 0)
SELECT id, round(sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / mean))), 6) AS score FROM f JOIN i USING (t), m GROUP BY id HAVING sum(tf) > 0 ORDER BY sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / mean))) DESC, id LIMIT 5""")
def c10_bm25_blocks(spark, sf):
    """The same over small blocks, most of which the bounds pass over; a word that no text has adds nothing."""
    at = f"{shared_dir(spark)}/postings-{uuid.uuid4().hex}"
    X.write_postings(table(spark, sf, "documents"), at, "doc_id", "text", block=2)
    return rounded(X.bm25_search(spark, at, ["the", "und", "para", "nowhere9"], 5))


@query(f"""WITH a AS (SELECT vec_id AS id, row_number() OVER (ORDER BY {COS.format(q=SEED.format(i=0))} DESC, vec_id) AS r FROM embeddings e QUALIFY r <= 20),
b AS (SELECT vec_id AS id, row_number() OVER (ORDER BY {COS.format(q=SEED.format(i=7))} DESC, vec_id) AS r FROM embeddings e QUALIFY r <= 20),
u AS (SELECT * FROM a UNION ALL SELECT * FROM b) SELECT id, round(sum(1.0::DOUBLE / (60 + r)), 6) AS score FROM u GROUP BY id ORDER BY sum(1.0::DOUBLE / (60 + r)) DESC, id LIMIT 10""")
def f1_rank_fusion(spark, sf):
    p = points(spark, sf)
    return rounded(S.fuse([S.search(p, vector_of(spark, sf, i), 20) for i in (0, 7)], 10))


@query("""SELECT doc_id AS id, (contains(lower(text), 'the')::INT + contains(lower(text), 'auge')::INT + contains(lower(text), 'elle')::INT) / 3.0::DOUBLE AS score
FROM documents WHERE contains(lower(text), 'the') OR contains(lower(text), 'auge') OR contains(lower(text), 'elle') ORDER BY score DESC, id LIMIT 20""")
def c13_keyword_search(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    return S.keyword_search(docs, F.col("text"), ["the", "auge", "elle"], 20).select("id", "score")


@query(f"""SELECT vec_id AS id, round({COS.format(q=SEED.format(i=9))}, 6) AS score FROM embeddings e WHERE vec_id <> 9 AND {COS.format(q=SEED.format(i=9))} >= 0.2 ORDER BY score DESC, id LIMIT 10""")
def c14_similar_above(spark, sf):
    return rounded(S.search(points(spark, sf), vector_of(spark, sf, 9), 10, F.col("id") != 9, 0.2).select("id", "score"))


@query()
def c17_projection(spark, sf):
    return rounded(S.project_2d(points(spark, sf)), "x", "y")


@query("""SELECT vec_id AS id, len(embedding) >= 16 AS fits, substr(md5(array_to_string(list_transform(embedding[1:32], lambda x: cast(cast(floor(x::DOUBLE * 1000 + 0.5) AS BIGINT) AS VARCHAR)), ',')), 1, 16) AS bucket,
round(sqrt(list_sum(list_transform(embedding[1:16], lambda x: x::DOUBLE * x::DOUBLE))), 6) AS head_norm FROM embeddings""")
def c18_truncate_and_bucket(spark, sf):
    p = points(spark, sf)
    return p.select("id", vectors.truncated(F.col("vector"), 16).isNotNull().alias("fits"), vectors.bucket_hash(F.col("vector")).alias("bucket"), F.round(vectors.norm(vectors.truncated(F.col("vector"), 16)), 6).alias("head_norm"))


@query("""SELECT vec_id AS id, len(embedding) = 64 AS valid FROM embeddings""")
def b11_vector_validity(spark, sf):
    return points(spark, sf).select("id", (F.size("vector") == 64).alias("valid"))


@query("""SELECT doc_id, lang, source, substr(text, 1, 40) AS head FROM documents WHERE lang = 'en' AND source IN ('src1', 'src2') AND n_chars BETWEEN 500 AND 3000 AND NOT contains(lower(text), 'auge')""")
def b1_filter_tree(spark, sf):
    cond = S.build_filter(lang="en", source=["src1", "src2"]) & F.col("n_chars").between(500, 3000) & ~F.contains(F.lower("text"), F.lit("auge"))
    return table(spark, sf, "documents").where(cond).select("doc_id", "lang", "source", F.substring("text", 1, 40).alias("head"))


@query("""SELECT event_id, user_id, list_has_any([event_type, 'x'], ['click', 'error']) AS tagged FROM events WHERE list_has_any([event_type, 'x'], ['click', 'error']) AND value IS NOT NULL""")
def b2_array_match(spark, sf):
    tags = F.array(F.col("event_type"), F.lit("x"))
    hit = F.arrays_overlap(tags, F.array(F.lit("click"), F.lit("error")))
    return table(spark, sf, "events").where(hit & F.col("value").isNotNull()).select("event_id", "user_id", hit.alias("tagged"))


@query(r"""SELECT doc_id, trim(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')[1]) AS preview,
CASE WHEN length(trim(regexp_replace(text, '\s+', ' ', 'g'))) > 80 THEN rtrim(substr(trim(regexp_replace(text, '\s+', ' ', 'g')), 1, 79)) || '…' ELSE trim(regexp_replace(text, '\s+', ' ', 'g')) END AS snippet FROM documents""")
def b16_preview_snippet(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.preview(F.col("text")).alias("preview"), text.snippet(F.col("text"), 80).alias("snippet"))


@query(f"""WITH s AS (SELECT vec_id AS id, {COS.format(q=SEED.format(i=0))} AS s FROM embeddings e ORDER BY s DESC, id LIMIT 30), k AS (SELECT vec_id AS id, label / 10.0::DOUBLE AS q FROM embeddings WHERE label > 5),
m AS (SELECT coalesce(s.id, k.id) AS id, coalesce(s, q * 0.5) * 0.7 + coalesce(q, 0) * 0.3 AS sc FROM s FULL JOIN k ON s.id = k.id) SELECT id, round(sc, 6) AS score FROM m""")
def d1_semantic_keyword_join(spark, sf):
    p = points(spark, sf)
    keyword = p.where("label > 5").select("id", (F.col("label") / 10).alias("score"))
    return rounded(S.merge_semantic_keyword(S.search(p, vector_of(spark, sf, 0), 30), keyword))


@query(f"""WITH s AS (SELECT vec_id AS id, CASE WHEN label % 4 > 0 THEN label END AS file, {COS.format(q=SEED.format(i=0))} * CASE WHEN label % 2 = 0 THEN 1.15 ELSE 1 END AS sc FROM embeddings e)
SELECT id, file, round(sc, 6) AS score FROM s QUALIFY row_number() OVER (PARTITION BY coalesce(cast(file AS VARCHAR), 'id' || id) ORDER BY sc DESC, id) = 1""")
def f5_f6_boost_and_dedup(spark, sf):
    kind = F.when(F.col("label") % 2 == 0, "code").otherwise("docs")
    s = points(spark, sf).withColumn("score", scoring.boosted(vectors.cosine_to(F.col("vector"), vector_of(spark, sf, 0)), kind)).select("id", F.when(F.col("label") % 4 > 0, F.col("label")).alias("file"), "score")
    return rounded(S.best_of(s, F.col("file")))


@query("""WITH h AS (SELECT doc_id AS id, text, 1.0::DOUBLE / (1 + doc_id) AS s FROM documents ORDER BY s DESC, id LIMIT 30),
t AS (SELECT id, s, list_distinct(list_filter(regexp_split_to_array(lower(substr(text, 1, 800)), '\\s+'), lambda w: w <> '')) AS w FROM h),
j AS (SELECT id, len(list_intersect(w, ['of', 'the', 'und'])) / (len(w) + 3 - len(list_intersect(w, ['of', 'the', 'und'])))::DOUBLE * 0.6 + s * 0.4 AS sc FROM t) SELECT id, round(sc, 6) AS score FROM j ORDER BY sc DESC, id LIMIT 10""".replace("\\\\", "\\"))
def f3_rerank(spark, sf):
    hits = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text", (1 / (1 + F.col("doc_id"))).alias("score")).orderBy(F.desc("score"), "id").limit(30)
    return rounded(S.rerank(hits, F.col("text"), S.token_overlap("of the und"), 10).select("id", "score"))


@query("""WITH d AS (SELECT doc_id AS id, 1.0::DOUBLE / (1 + doc_id % 50) AS s, (doc_id % 400) AS days, doc_id % 5 = 0 AS exempt, doc_id % 7 AS acc, 7 + doc_id % 180 AS stab FROM documents)
SELECT id, round(s * CASE WHEN days > 30 AND NOT exempt THEN 1 - least(0.5, (floor(days / 30) - 1) * 0.1) ELSE 1 END, 6) AS aged, round(s * 0.7 + exp(-days / 30) * 0.3, 6) AS recent,
round(exp(-days / (stab * (1 + 0.5 * acc))), 6) AS retention, round(0.9 * exp(-0.1 * days), 6) AS cached, round(s * 0.7 + (1.0 - s) * (1 - 0.7), 6) AS weighted FROM d""")
def f8_to_f16_scores(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), (1 / (1 + F.col("doc_id") % 50)).alias("s"), (F.col("doc_id") % 400).alias("days"), (F.col("doc_id") % 5 == 0).alias("x"), (F.col("doc_id") % 7).alias("acc"), (7 + F.col("doc_id") % 180).alias("stab"))
    c = F.col
    out = d.select("id", (c("s") * scoring.aging(c("days"), c("x"))).alias("aged"), scoring.recency_blend(c("s"), c("days")).alias("recent"), scoring.retention(c("days"), c("stab"), c("acc")).alias("retention"), scoring.cached_confidence(F.lit(0.9), c("days")).alias("cached"), scoring.weighted(c("s"), 1 - c("s")).alias("weighted"))
    return rounded(out, "aged", "recent", "retention", "cached", "weighted")


@query()
def a14_quantized(spark, sf):
    q = S.quantized(points(spark, sf))
    return q.select("id", F.size("bytes").alias("dims"), F.aggregate("bytes", F.lit(0), lambda s, x: s + x).alias("total"), F.round("scale", 9).alias("scale"))


@query(f"""SELECT vec_id AS id, round({COS.format(q=SEED.format(i=3))}, 6) AS score FROM embeddings e ORDER BY {COS.format(q=SEED.format(i=3))} DESC, vec_id LIMIT 10""")
def a14_quantised_search(spark, sf):
    """The ten nearest of all vectors, by bytes first."""
    p = points(spark, sf)
    return rounded(X.quantised_search(X.quantise(p), p, vector_of(spark, sf, 3), 10))


@query("""SELECT vec_id AS query_id, true AS found_twin, true AS enough FROM embeddings""")
def c2_cell_search(spark, sf):
    """All points as queries of the cells: each finds its twin, which stands a million higher, first; and all together find nine of ten of their exact neighbours or more."""
    p = points(spark, sf)
    twins = written(p.unionByName(p.withColumn("id", F.col("id") + 10**6)), "twins")
    near = written(X.cell_search(twins, p, 11), "cell-near")
    enough = F.lit(X.recall_of(near, S.batch_search(twins, p, 11)) >= 0.9)
    own = near.where((F.col("rank") == 1) & (F.col("id") == F.col("query_id") + 10**6))
    return p.select(F.col("id").alias("query_id")).join(own.select("query_id", F.lit(True).alias("found_twin")), "query_id", "left").withColumn("enough", enough)
