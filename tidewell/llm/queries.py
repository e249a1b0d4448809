"""The queries of this package's operators and, where SQL can say the same, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm import bpe, divergence, langid, mixing, neardup, pack, parsing, quality, resample, rules, secretscan, tokenbin, tokencount
from tidewell.session import table


def op1_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secretscan.scan(table(spark, sf_dir, "documents"))
    n = len(secretscan.BASE)
    base = F.filter("found", lambda s: s["order"] < n)
    count = lambda k: F.size(F.filter("found", lambda s: s["order"] == k)).cast("long")
    return found.select(
        F.col("doc_id").cast("long"),
        *[count(k).alias(f"n_{r.kind}") for k, r in enumerate(secretscan.BASE)],
        F.sha2(secretscan.joined_spans(base), 256).alias("base_sha256"),
        secretscan.joined_spans(F.col("found")).alias("spans"),
    )


def op2_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsing.fingerprint_edits(table(spark, sf_dir, "documents"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language_id(table(spark, sf_dir, "documents"))


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.drawn(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack.best_fit_packing(table(spark, sf_dir, "documents"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.quality_rules(table(spark, sf_dir, "documents"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.token_counts(table(spark, sf_dir, "documents"), tokencount.fresh_cache(spark))


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op10_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tokenbin.token_rows(table(spark, sf_dir, "documents"))
    return rows.select("sequence_id", "n_tokens", "n_segments", "ids", F.crc32("ids").alias("ids_crc32"), "cu_seqlens", "position_resets", "doc_ids", "starts")


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.source_divergence(table(spark, sf_dir, "documents"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return scored.select("doc_id", "n_features", "weight", "score", "rank")


def op13_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.decoded(bpe.encoded(table(spark, sf_dir, "documents")))
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))


def _spans_sql(order: int, rule: secretscan.Rule) -> str:
    """SQL for one kind's spans as a list of structs, by the lengths between and of the matches."""
    regex = rule.regex.replace("'", "''")
    return f"""
      SELECT rid, list_filter(list_transform(range(1, len(hits) + 1), lambda i: struct_pack(
               s := list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0),
               o := {order},
               e := list_sum(list_transform(gaps[1:i], lambda x: length(x))) + list_sum(list_transform(hits[1:i], lambda x: length(x))),
               n := length(vals[i]))), lambda y: y.n >= {rule.least}) AS found
      FROM (SELECT rid, string_split_regex(t, '{regex}') AS gaps, regexp_extract_all(t, '{regex}', 0) AS hits,
                   regexp_extract_all(t, '{regex}', {rule.group}) AS vals FROM d)"""


def op1_sql() -> str:
    kinds = "[" + ", ".join(f"'{r.kind}'" for r in secretscan.RULES) + "]"
    parts = "\n      UNION ALL ".join(_spans_sql(k, r) for k, r in enumerate(secretscan.RULES))
    said = f"list_transform(list_sort({{0}}), lambda x: {kinds}[x.o + 1] || ':' || cast(x.s AS BIGINT) || ':' || cast(x.e AS BIGINT))"
    n = len(secretscan.BASE)
    counts = ", ".join(f"cast(len(list_filter(found, lambda x: x.o = {k})) AS BIGINT) AS n_{r.kind}" for k, r in enumerate(secretscan.BASE))
    return f"""
    WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
    each AS ({parts}),
    whole AS (SELECT rid, flatten(list(found)) AS found FROM each GROUP BY rid)
    SELECT cast(doc_id AS BIGINT) AS doc_id, {counts},
           sha256(coalesce(array_to_string({said.format(f'list_filter(found, lambda x: x.o < {n})')}, ','), '')) AS base_sha256,
           coalesce(array_to_string({said.format('found')}, ','), '') AS spans
    FROM whole JOIN d USING (rid)"""


def op9_sql() -> str:
    """The same by brute force: all pairs that share a shingle, and their least reachable ids."""
    return """
    WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
    s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
            ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM d),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2),
    e AS (SELECT a, b FROM p JOIN n na ON a = na.doc_id JOIN n nb ON b = nb.doc_id WHERE 100 * shared >= 75 * (na.n + nb.n - shared)),
    r(x, y) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.x, e.b FROM r JOIN e ON r.y = e.a),
    c AS (SELECT x, min(y) AS component_id FROM r GROUP BY x)
    SELECT cast(d.doc_id AS BIGINT) AS doc_id, cast(coalesce(n.n, 0) AS BIGINT) AS n_shingles, cast(c.component_id AS BIGINT) AS component_id, c.component_id = d.doc_id AS kept
    FROM d LEFT JOIN n ON d.doc_id = n.doc_id JOIN c ON c.x = d.doc_id"""


def op11_sql() -> str:
    """The same without histograms and postings: every kept term priced for every pair of a language's sources."""
    share = "1 + (1000000000::HUGEINT * ({0} + 2)) // ({1} + 2 * v)"
    price = "(({0} - {1}) * ({0} - {1})) // ({0} + {1})"
    return f"""
    WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                      regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
    s AS (SELECT rid, lang, source, unnest(w) AS term FROM d),
    k AS (SELECT lang, term, count(*) AS total FROM s GROUP BY 1, 2 HAVING count(DISTINCT rid) >= 10),
    l AS (SELECT lang, count(*) AS v, sum(total) AS lang_n FROM k GROUP BY 1),
    c AS (SELECT lang, source, term, count(*) AS n FROM s SEMI JOIN k USING (lang, term) GROUP BY 1, 2, 3),
    g AS (SELECT DISTINCT lang, source FROM d),
    n AS (SELECT g.lang, g.source, coalesce(sum(c.n), 0) AS all_n FROM g LEFT JOIN c USING (lang, source) GROUP BY 1, 2),
    p AS (SELECT n.lang, n.source, k.term, coalesce(c.n, 0) AS n, {share.format("coalesce(c.n, 0)", "all_n")} AS p, {share.format("total", "lang_n")} AS q
          FROM n JOIN k USING (lang) JOIN l USING (lang) LEFT JOIN c ON c.lang = n.lang AND c.source = n.source AND c.term = k.term),
    o AS (SELECT a.lang, a.source, b.source AS item FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source),
    f AS (SELECT a.lang, a.source, b.source AS item, sum({price.format("a.p", "b.p")}) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
    r AS (SELECT lang, source, 'pair' AS part, item, coalesce(value, 0) AS value FROM o LEFT JOIN f USING (lang, source, item)
          UNION ALL SELECT lang, source, 'term', term, {price.format("p", "q")} FROM p WHERE n > 0 AND p > q),
    x AS (SELECT lang, source, part, item, cast(value AS BIGINT) AS value, cast(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM r)
    SELECT * FROM x WHERE part = 'pair' OR rank <= 10"""


def op12_sql() -> str:
    """The same word by word, with crc32 made from its polynomial for each distinct word."""
    words = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return f"""
    WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {words} AS w FROM documents),
    x AS (SELECT rid, unnest(w) AS word FROM d),
    y AS (SELECT unnest({words}) AS word FROM benchmark),
    h AS (SELECT word, xor(list_reduce(list_transform(range(1, length(hex(word)) // 2 + 1), lambda i: ('0x' || substr(hex(word), 2 * i - 1, 2))::BIGINT),
                 lambda a, b: list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, xor(a, b)), 4294967295), 4294967295) % 10000 AS bucket
          FROM (SELECT word FROM x UNION SELECT word FROM y)),
    s AS (SELECT bucket, count(*) AS s FROM x JOIN h USING (word) GROUP BY 1),
    t AS (SELECT bucket, count(*) AS t FROM y JOIN h USING (word) GROUP BY 1),
    n AS (SELECT (SELECT count(*) FROM x)::DOUBLE AS all_s, (SELECT count(*) FROM y)::DOUBLE AS all_t),
    g AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0)::DOUBLE + 1) * (all_s + 10000) / ((s::DOUBLE + 1) * (all_t + 10000))))::BIGINT AS gain FROM s LEFT JOIN t USING (bucket), n),
    m AS (SELECT rid, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight FROM x JOIN h USING (word) JOIN g USING (bucket) GROUP BY 1),
    w AS (SELECT doc_id, len(w)::BIGINT AS n_features, coalesce(weight, 0) AS weight,
                 coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5) / 4294967296)))::BIGINT AS score
          FROM d LEFT JOIN m USING (rid)),
    o AS (SELECT *, CASE WHEN n_features >= 20 THEN row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS LAST, n_features, weight) END AS place FROM w)
    SELECT doc_id, n_features, weight, score, CASE WHEN place <= 10 * (SELECT count(*) FROM w WHERE n_features >= 20) // 100 THEN place END AS rank FROM o"""


QUERIES = {
    f.__name__: f
    for f in (
        op1_secret_scans, op2_document_fingerprints, op3_quality_classifier, op4_language_id, op5_source_mixing, op6_best_fit_packing, op7_quality_rules, op8_token_counts,
        op9_minhash_near_dedup, op10_token_binary, op11_source_divergence, op12_importance_resampling, op13_bpe_codec,
    )
}
ORACLE = {"op1_secret_scans": op1_sql(), "op9_minhash_near_dedup": op9_sql(), "op11_source_divergence": op11_sql(), "op12_importance_resampling": op12_sql()}
