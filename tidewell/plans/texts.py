"""Queries of sections 2.1 (sources), 2.8 (functions), 2.9 (parsing) and 2.13 (models)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.functions import models, scoring
from tidewell.functions import text as T
from tidewell.operators import chunking as K
from tidewell.plans.registry import query
from tidewell.session import shared_dir, table
from tidewell.sources import files as S

STOP = "['" + "','".join(T.STOPWORDS) + "']"


def as_files(spark, sf) -> DataFrame:
    return table(spark, sf, "documents").select(F.concat(F.lit("d/"), "doc_id", F.lit(".md")).alias("path"), F.regexp_replace("text", r"\. ", "\n# ").alias("content"))


@query(f"SELECT doc_id, array_to_string(list_filter(regexp_split_to_array(lower(text), '[^A-Za-z0-9_]+'), lambda w: length(w) > 2 AND NOT list_contains({STOP}, w))[1:20], ' ') AS keywords FROM documents")
def i1_keywords(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.array_join(F.slice(T.keywords(F.col("text")), 1, 20), " ").alias("keywords"))


@query(r"SELECT doc_id, len(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda w: length(w) > 2)) AS n_words, cast(ceil(length(trim(regexp_replace(text, '\s+', ' ', 'g'))) / 4.0) AS BIGINT) AS tokens FROM documents")
def i2_i15_words_and_tokens(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.size(T.long_words(F.col("text"))).cast("long").alias("n_words"), T.token_estimate(F.col("text")).alias("tokens"))


@query("""WITH q AS (SELECT o_orderkey AS id, o_orderkey % 7 AS k, o_orderdate AS d FROM orders) SELECT id, CASE k WHEN 0 THEN 'first' WHEN 1 THEN 'last' WHEN 2 THEN 'current' WHEN 5 THEN 'before' WHEN 6 THEN 'none' ELSE 'between' END AS op,
CASE k WHEN 0 THEN 'asc' WHEN 1 THEN 'desc' WHEN 2 THEN 'desc' END AS "order", CASE k WHEN 3 THEN strftime(d, '%Y-01-01T00:00:00.000Z') WHEN 4 THEN strftime(d, '%Y-%m-01T00:00:00.000Z') WHEN 5 THEN strftime(d, '%Y-%m-01T00:00:00.000Z') END AS date_from,
CASE k WHEN 3 THEN strftime(d, '%Y-12-31T23:59:59.999Z') WHEN 4 THEN strftime(last_day(d), '%Y-%m-%dT23:59:59.999Z') END AS date_to FROM q""")
def i3_temporal(spark, sf):
    """Questions made from the orders' dates, of each kind in turn."""
    d, k = F.col("o_orderdate"), F.col("o_orderkey") % 7
    q = F.when(k == 0, "what was the first order").when(k == 1, "the latest one").when(k == 2, "what do we do now").when(k == 3, F.concat(F.lit("orders in "), F.date_format(d, "yyyy")))
    q = q.when(k == 4, F.concat(F.date_format(d, "MMMM yyyy"), F.lit(" plans"))).when(k == 5, F.concat(F.lit("Before "), F.date_format(d, "yyyy-MM"))).otherwise("nothing")
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), T.temporal(q).alias("t")).select("id", "t.*")


@query(r"SELECT doc_id, md5(trim(regexp_replace(lower(text), '\s+', ' ', 'g'))) AS normal, sha256(text) AS sha, md5(substr(trim(lower(text)), 1, 100) || '|' || array_to_string(list_sort([lang, source]), ',')) AS fingerprint FROM documents")
def i4_i13_i14_hashes(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", F.md5(T.normalised(F.col("text"))).alias("normal"), F.sha2("text", 256).alias("sha"), T.fingerprint(F.col("text"), F.array("lang", "source")).alias("fingerprint"))


SAID = "CASE turn % 6 WHEN 0 THEN 'No,  ' || text WHEN 1 THEN text || ' Please REMEMBER ' || chr(10) || ' this.' WHEN 2 THEN 'Actually, ' || text WHEN 3 THEN text || ' запамʼятай' WHEN 4 THEN '  That’s wrong. ' || text ELSE text END"
PLAIN = f"trim(regexp_replace(lower(translate({SAID}, '’ʼ‘`', repeat(chr(39), 4))), '\\s+', ' ', 'g'))"
HOLDS = " OR ".join(f"""contains(s, '{p.replace("'", "''")}') OR contains(replace(s, chr(39), ''), '{p.replace("'", "")}')""" for p in T.SAVE_PHRASES)
BEGINS = " OR ".join(f"""starts_with(s, '{p.replace("'", "''")}')""" for p in T.CORRECTION_PREFIXES)


@query(f"SELECT conv_id, turn, {BEGINS} AS corrects, {HOLDS} AS saves FROM (SELECT conv_id, turn, {PLAIN} AS s FROM conversations)")
def i5_phrases(spark, sf):
    """Turns of the conversations, most of them with a phrase put in."""
    k, text = F.col("turn") % 6, F.col("text")
    said = F.when(k == 0, F.concat(F.lit("No,  "), text)).when(k == 1, F.concat(text, F.lit(" Please REMEMBER \n this."))).when(k == 2, F.concat(F.lit("Actually, "), text))
    said = said.when(k == 3, F.concat(text, F.lit(" запамʼятай"))).when(k == 4, F.concat(F.lit("  That’s wrong. "), text)).otherwise(text)
    return table(spark, sf, "conversations").select("conv_id", "turn", T.corrects(said).alias("corrects"), T.saves(said).alias("saves"))


CODE_LINE = "html || ' import { Store as S, q' || page_id || ' } from ''lib/x.json''; @Injectable class Page' || page_id || 'View uses src/api/page' || page_id || '.tsx'"
IN_ORDER = "list_filter({0}, lambda x, i: list_position({0}, x) = i)"


def _with_code(spark, sf) -> DataFrame:
    i = F.col("page_id")
    code = F.concat("html", F.lit(" import { Store as S, q"), i, F.lit(" } from 'lib/x.json'; @Injectable class Page"), i, F.lit("View uses src/api/page"), i, F.lit(".tsx"))
    return table(spark, sf, "pages").select("page_id", code.alias("t"))


@query(rf"""WITH p AS (SELECT page_id, {CODE_LINE} AS t FROM pages),
f AS (SELECT page_id, regexp_extract_all(t, '{T.FILE_NAME}', 0) AS files, list_concat(list_filter(regexp_extract_all(t, '{T.DECLARED}', 1), lambda x: length(x) > 1), ['Store', 'q' || page_id]) AS functions,
list_concat(list_filter(regexp_extract_all(t, '@(\w+)', 1), lambda x: length(x) > 2 AND substr(x, 1, 1) = upper(substr(x, 1, 1))), regexp_extract_all(t, '{T.PASCAL}', 1)) AS concepts FROM p)
SELECT page_id, array_to_string({IN_ORDER.format("files")}, ',') AS files, array_to_string({IN_ORDER.format("functions")}[1:30], ',') AS functions, array_to_string({IN_ORDER.format("concepts")}[1:15], ',') AS concepts FROM f""")
def i7_entities(spark, sf):
    e = T.entities(F.col("t"))
    return _with_code(spark, sf).select("page_id", *[F.array_join(c, ",").alias(k) for k, c in e.items()])


@query(rf"""WITH p AS (SELECT page_id, {CODE_LINE} AS t, list_filter(['d/x', 'plain', 'n.md'], lambda x: contains(x, '/') OR contains(x, '.')) AS own FROM pages),
f AS (SELECT page_id, own, {IN_ORDER.format(f"regexp_extract_all(t, '{T.ANCHOR_FILE}', 0)")} AS named, regexp_extract_all(t, '{T.PASCAL}', 1)[1:5] AS names FROM p)
SELECT page_id, array_to_string(list_concat(list_concat(list_transform(own, lambda x: 'file:' || x), list_transform(list_filter(named, lambda x: NOT list_contains(own, x)), lambda x: 'file:' || x)), list_transform(names, lambda x: 'symbol:' || x))[1:20], ',') AS anchors FROM f""")
def i8_anchors(spark, sf):
    a = T.anchors(F.col("t"), F.array(F.lit("d/x"), F.lit("plain"), F.lit("n.md")))
    return _with_code(spark, sf).select("page_id", F.array_join(F.transform(a, lambda x: F.concat_ws(":", x["type"], F.coalesce(x["name"], x["path"]))), ",").alias("anchors"))


DIRS = ("src/routes", "Services", "lib", "app/models", "middleware", "x/__tests__", "parsers", "types", "config", "other")
NAMES = ("F.ts", "F.py", "F.md", "F.proto", "F.yaml", "F.go", ".env", "F", "F.vue", "Dockerfile", "Dockerfile.dev", "F.html", "F.css", "F.sh", "F.SQL", ".ts", "F.x.TSX")
PATH = f"{list(DIRS)}[cast(doc_id % {len(DIRS)} AS INTEGER) + 1] || '/' || doc_id || '/' || {list(NAMES)}[cast(doc_id % {len(NAMES)} AS INTEGER) + 1]"


@query(f"""WITH p AS (SELECT doc_id, {PATH} AS path FROM documents) SELECT path,
['typescript', 'python', 'markdown', 'unknown', 'yaml', 'go', 'unknown', 'unknown', 'vue', 'dockerfile', 'dockerfile', 'unknown', 'unknown', 'unknown', 'sql', 'unknown', 'typescript'][cast(doc_id % 17 AS INTEGER) + 1] AS language,
['code', 'code', 'docs', 'contract', 'config', 'code', 'config', 'code', 'code', 'code', 'code', 'code', 'code', 'code', 'code', 'code', 'code'][cast(doc_id % 17 AS INTEGER) + 1] AS kind,
['api', 'service', 'util', 'model', 'middleware', 'test', 'parser', 'types', 'config', 'other'][cast(doc_id % 10 AS INTEGER) + 1] AS layer, CASE WHEN doc_id % 3 = 0 THEN 'userstore' WHEN doc_id % 3 = 1 THEN 'Page' END AS service FROM p""")
def i9_i10_classify_paths(spark, sf):
    i = F.col("doc_id")
    pick = lambda xs: F.get(F.array(*[F.lit(x) for x in xs]), (i % len(xs)).cast("int"))
    path = F.concat(pick(DIRS), F.lit("/"), i, F.lit("/"), pick(NAMES))
    symbols = F.when(i % 3 == 0, F.array(F.lit("Page"), F.lit("userstore"))).when(i % 3 == 1, F.array(F.lit("page"), F.lit("Page")))
    p = table(spark, sf, "documents").select(path.alias("path"), symbols.alias("symbols"))
    return p.select("path", T.language_of(F.col("path")).alias("language"), K.kind_of(F.col("path")).alias("kind"), T.layer_of(F.col("path")).alias("layer"), T.service_of(F.col("symbols")).alias("service"))


TREE = "list_value('src', 'docs', 'node_modules/src', 'x/src/lib')[cast(doc_id % 4 AS INTEGER) + 1] || '/f' || (doc_id % 100) || list_value('.md', '.mdx', '.ts')[cast(doc_id % 3 AS INTEGER) + 1]"


@query(rf"""WITH f AS (SELECT {TREE} AS path, count(*) AS n FROM documents GROUP BY 1)
SELECT * FROM f WHERE regexp_matches('/' || path, '/src/.*[^/]*\.md|/docs/[^/]*7\.') AND NOT regexp_matches('/' || path, '/node_modules/.*|f1[^/]*\.mdx')""")
def i12_a16_globs(spark, sf):
    """A tree of files, one for each path, written by Spark and walked again with patterns, which are searched for anywhere in a path."""
    import uuid

    i = F.col("doc_id")
    pick = lambda *xs: F.get(F.array(*[F.lit(x) for x in xs]), (i % len(xs)).cast("int"))
    path = F.concat(pick("src", "docs", "node_modules/src", "x/src/lib"), F.lit("/f"), i % 100, pick(".md", ".mdx", ".ts"))
    files = table(spark, sf, "documents").groupBy(path.alias("path")).agg(F.count("*").cast("string").alias("value"))
    root = f"{shared_dir(spark)}/tree-{uuid.uuid4().hex}"
    parts = F.split("path", "/")
    folder = lambda k: F.when(F.size(parts) > k + 1, F.get(parts, F.lit(k))).otherwise("-").alias(f"d{k}")
    files.select("value", folder(0), folder(1), folder(2), F.element_at(parts, -1).alias("file")).write.partitionBy("d0", "d1", "d2", "file").text(root)  # d0=src/d1=-/d2=-/file=f1.md/part-…
    walked = S.file_tree(spark, root, ["=src/**/file=*.md", "d0=docs/**/file=*7."], ["=node_modules/**", "=f1*.mdx"])
    whole = F.regexp_replace(F.regexp_replace(F.substring_index("path", "/", 4), "/?(d[0-2]|file)=", "/"), "/-(?=/)", "")
    return walked.select(F.substring(whole, 2, 1000).alias("path"), F.trim(F.translate("content", "\n", "")).cast("long").alias("n"))


@query("SELECT c_custkey AS id, list_reduce(list_transform(range(1, length(c_name) + 1), lambda i: ascii(substr(c_name, i, 1))::BIGINT), lambda h, b: (xor(h, b) * 16777619) & 4294967295, 2166136261::BIGINT) AS h FROM customer")
def i13_fnv(spark, sf):
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), T.fnv1a32(F.col("c_name")).alias("h"))


@query("""WITH p AS (SELECT o_orderkey AS id, 'src/x' || o_orderkey || '.ts' AS a, CASE o_orderkey % 4 WHEN 0 THEN 'x' || o_orderkey || '.ts' WHEN 1 THEN o_orderkey || '.ts' WHEN 2 THEN 'lib/src/x' || o_orderkey || '.ts' ELSE 'src/x' || o_orderkey || '.ts' END AS b FROM orders)
SELECT id, a = b OR ends_with(a, '/' || b) OR ends_with(b, '/' || a) AS matches FROM p""")
def i16_path_suffix(spark, sf):
    i = F.col("o_orderkey")
    k, name = i % 4, F.concat("o_orderkey", F.lit(".ts"))
    b = F.when(k == 0, F.concat(F.lit("x"), name)).when(k == 1, name).when(k == 2, F.concat(F.lit("lib/src/x"), name)).otherwise(F.concat(F.lit("src/x"), name))
    return table(spark, sf, "orders").select(i.alias("id"), T.path_matches(F.concat(F.lit("src/x"), name), b).alias("matches"))


@query("""SELECT event_id, cast(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events""")
def i17_json_salvage(spark, sf):
    e = table(spark, sf, "events")
    answer = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("Sure:\n```json\n"), "props", F.lit("\n```"))).otherwise(F.concat(F.lit("here "), "props", F.lit(" done")))
    return e.select("event_id", F.try_variant_get(T.json_object(answer), "$.k", "bigint").alias("k"))


@query("""SELECT event_id, cast(dayofweek(ts) AS INTEGER) AS dow, cast(hour(ts) AS INTEGER) AS hour, cast(floor(epoch_ms(TIMESTAMP '2024-01-31' - ts) / 86400000) AS BIGINT) AS days FROM (SELECT *, 1 FROM events)""".replace("epoch_ms(TIMESTAMP '2024-01-31' - ts)", "(epoch_ms(TIMESTAMP '2024-01-31') - epoch_ms(ts))"))
def i18_dates(spark, sf):
    e = table(spark, sf, "events")
    return e.select("event_id", (F.dayofweek("ts") - 1).alias("dow"), F.hour("ts").alias("hour"), F.floor(scoring.days_before(F.expr("TIMESTAMP '2024-01-31 00:00:00'"), F.col("ts"))).alias("days"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_quantity > 40 THEN 1.0 WHEN l_quantity > 30 THEN 0.7 WHEN l_quantity > 20 THEN 0.5 ELSE 0.3 END::DOUBLE AS emotion,
round((l_quantity * 3 + l_linenumber * 15 + l_quantity * 3 * 1.25 + l_linenumber * 3 * 0.1) / 1000000 * CASE WHEN l_returnflag = 'R' THEN 0.5 ELSE 1 END, 9)::DOUBLE AS cost FROM lineitem""")
def i23_i24_cost_and_emotion(spark, sf):
    li = table(spark, sf, "lineitem")
    q, n = F.col("l_quantity"), F.col("l_linenumber")
    cost = scoring.cost(q, n, q, n, F.lit(3.0), F.lit(15.0), F.col("l_returnflag") == "R")
    ms = F.when(q > 30, 10_001).when(q > 20, 5_001).otherwise(0)
    return li.select("l_orderkey", "l_linenumber", "l_partkey", scoring.emotion(q <= 40, ms).alias("emotion"), F.round(cost, 9).alias("cost"))


TOOL = "CASE turn % 5 WHEN 0 THEN 'get_patterns' WHEN 1 THEN 'get_adrs' ELSE 'search' END"
KIND = """CASE WHEN tool = 'get_patterns' OR contains({0}, 'pattern') THEN 'pattern' WHEN tool = 'get_adrs' OR contains({0}, 'decision') THEN 'pattern' WHEN contains({0}, 'import') OR contains({0}, 'require') OR contains({0}, 'dependency') THEN 'dependency'
WHEN contains({0}, 'error') OR contains({0}, 'bug') OR contains({0}, 'issue') OR contains({0}, 'todo') THEN 'issue' ELSE 'finding' END"""


def _turns(spark, sf) -> DataFrame:
    """Turns with a tool, and with words that rules look for in some."""
    k, text = F.col("turn") % 9, F.col("text")
    said = F.when(k == 2, F.concat(text, F.lit(" a Pattern"))).when(k == 3, F.concat(text, F.lit(" please FIX the bug"))).when(k == 4, F.concat(F.lit("Explain "), text)).when(k == 5, F.concat(F.lit("review the import of "), text)).when(k == 6, F.concat(F.lit("implement "), text)).otherwise(text)
    tool = F.when(F.col("turn") % 5 == 0, "get_patterns").when(F.col("turn") % 5 == 1, "get_adrs").otherwise("search")
    return table(spark, sf, "conversations").select("conv_id", "turn", said.alias("t"), tool.alias("tool"))


TURNS = f"""t AS (SELECT conv_id, turn, {TOOL} AS tool, lower(CASE turn % 9 WHEN 2 THEN text || ' a Pattern' WHEN 3 THEN text || ' please FIX the bug' WHEN 4 THEN 'Explain ' || text WHEN 5 THEN 'review the import of ' || text WHEN 6 THEN 'implement ' || text ELSE text END) AS t FROM conversations)"""


@query(f"WITH {TURNS} SELECT conv_id, turn, {KIND.format('t')} AS kind FROM t")
def i25_fact_type(spark, sf):
    return _turns(spark, sf).select("conv_id", "turn", T.fact_type(F.col("t"), F.col("tool")).alias("kind"))


@query(rf"""WITH t AS (SELECT conv_id, turn, {TOOL} AS tool, substr(regexp_replace(text, '^\s+|\s+$', '', 'g'), 1, 300) AS a, text FROM conversations), f AS (SELECT conv_id, turn, tool, 'src/f' || turn || '.ts' AS file, a, 0.9::DOUBLE AS c FROM t UNION ALL SELECT conv_id, turn, tool, 'lib/g.py', substr(regexp_replace(substr('todo ' || text, 1, 500), '^\s+|\s+$', '', 'g'), 1, 300), 1.0::DOUBLE FROM t)
SELECT conv_id, turn, file || ': ' || a AS content, {KIND.format("lower(a)")} AS type, c AS confidence FROM f WHERE a <> '' UNION ALL SELECT conv_id, turn, 'Dependency: import a from "m' || turn || '"', 'dependency', 0.8 FROM t""")
def i26_observed_facts(spark, sf):
    """Answers that name two files, with a turn's text below each, and an import before them."""
    t = table(spark, sf, "conversations")
    tool = F.when(F.col("turn") % 5 == 0, "get_patterns").when(F.col("turn") % 5 == 1, "get_adrs").otherwise("search")
    answer = F.concat(F.lit('import a from "m'), "turn", F.lit('"\n[1] src/f'), "turn", F.lit(".ts (score: 0.90)\n"), "text", F.lit("\n[2] lib/g.py (score: 1.7)todo "), "text")
    facts = t.select("conv_id", "turn", F.inline(T.observed_facts(answer, tool)))
    return facts.select("conv_id", "turn", "content", "type", "confidence")


FIX, BUILD, LEARN, CHECK = (T_ for T_ in (models.ROUTES[0][0], models.ROUTES[2][0], models.LATER_ROUTES[0][0], models.LATER_ROUTES[1][0]))


@query(rf"""WITH {TURNS}, r AS (SELECT conv_id, turn, list_concat(list_concat(['code_search'], CASE WHEN regexp_matches(t, '{FIX}') THEN ['memory', 'graph'] ELSE [] END), list_concat(CASE WHEN regexp_matches(t, '{models.ROUTES[1][0]}') OR regexp_matches(t, '{BUILD}') OR regexp_matches(t, '{CHECK}') OR turn % 4 = 1 THEN ['patterns', 'adrs'] ELSE [] END,
list_concat(CASE WHEN turn % 2 = 0 THEN ['graph'] ELSE [] END, list_concat(CASE WHEN regexp_matches(t, '{LEARN}') THEN ['docs', 'memory'] ELSE [] END, CASE WHEN turn % 4 = 3 THEN ['patterns', 'adrs', 'memory'] ELSE [] END)))) AS r FROM t) SELECT conv_id, turn, array_to_string(list_sort(list_distinct(r)), ',') AS routes FROM r""")
def i28_routes(spark, sf):
    turn = F.col("turn")
    intent = F.when(turn % 4 == 1, "review").when(turn % 4 == 3, "architecture")
    files = F.when(turn % 2 == 0, F.array(F.lit("a.ts")))
    return _turns(spark, sf).select("conv_id", "turn", F.array_join(F.array_sort(models.routes(F.col("t"), files, intent)), ",").alias("routes"))


# --- chunks ---------------------------------------------------------------------------------------


@query()
def k1_size_chunks(spark, sf):
    return K.size_chunks(as_files(spark, sf))


@query(r"""WITH f AS (SELECT 'd/' || doc_id || '.md' AS path, regexp_replace(CASE doc_id % 5 WHEN 0 THEN chr(10) || text || '  ' || chr(10) WHEN 1 THEN '# ' || chr(10) || text WHEN 2 THEN ' a ' || chr(10) || '## b' ELSE text END, '\. ', chr(10) || '# ', 'g') AS content FROM documents),
g AS (SELECT path, content, string_split(content, chr(10)) AS l FROM f),
s AS (SELECT path, l, list_filter(list_transform(range(1, len(l) + 1), lambda i: CASE WHEN i = 1 OR regexp_matches(l[i], '^#{1,6}\s+.+') THEN i ELSE 0 END), lambda n: n > 0) AS s FROM g),
c AS (SELECT path, unnest(range(0, len(s))) AS chunk, l, s FROM s), e AS (SELECT path, chunk, l, s[chunk + 1] AS a, coalesce(s[chunk + 2] - 1, len(l)) AS b FROM c),
k AS (SELECT path, cast(chunk AS INTEGER) AS chunk, cast(a AS INTEGER) AS start_line, cast(b AS INTEGER) AS end_line, trim(array_to_string(l[a:b], chr(10)), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS content,
      CASE WHEN regexp_matches(l[a], '^#{1,6}\s+.+') THEN trim(regexp_replace(l[a], '^#{1,6}\s+', ''), ' ' || chr(9) || chr(13)) ELSE '' END AS heading FROM e),
w AS (SELECT * FROM k WHERE length(content) >= 10)
SELECT * FROM w UNION ALL SELECT path, 0, 1, cast(len(l) AS INTEGER), content, '' FROM g WHERE path NOT IN (SELECT path FROM w)""")
def k2_markdown_sections(spark, sf):
    i, text = F.col("doc_id") % 5, F.col("text")
    content = F.when(i == 0, F.concat(F.lit("\n"), text, F.lit("  \n"))).when(i == 1, F.concat(F.lit("# \n"), text)).when(i == 2, " a \n## b").otherwise(text)
    files = table(spark, sf, "documents").select(F.concat(F.lit("d/"), "doc_id", F.lit(".md")).alias("path"), F.regexp_replace(content, r"\. ", "\n# ").alias("content"))
    return K.markdown(files)


@query("SELECT 'e/' || event_id AS path, 'k' AS key, json_extract_string(props, '$.k') AS content FROM events")
def k4_json_keys(spark, sf):
    e = table(spark, sf, "events")
    return K.json_keys(e.select(F.concat(F.lit("e/"), "event_id").alias("path"), F.col("props").alias("content")))


#: A source file's text by k, in SQL that both engines read: parts in several languages, of varying number, order and length; some files declare nothing.
CODE = """concat('import { a } from ''lib/a', k, '''', chr(10), repeat(concat('// note', chr(10)), cast(k % 7 as int)),
CASE WHEN k % 5 = 4 THEN repeat(concat('just a line of text number ', k, chr(10)), cast(3 + k % 40 as int)) ELSE concat(
CASE WHEN k % 3 = 0 THEN concat('from os.path import join', chr(10), 'class Shop', k, '(Base', k % 11, '):', chr(10), '    def sell', k, '(self):', chr(10), repeat(concat('        x = 1', chr(10)), cast(k % 9 as int))) ELSE '' END,
repeat(concat('export const pay', k, ' = async (x) => {', chr(10), '  return require(''./m', k % 13, ''')', chr(10), '}', chr(10)), cast(k % 4 as int)),
CASE WHEN k % 2 = 0 THEN concat('  pub fn run', k % 17, '() {', chr(10), repeat(chr(10), cast(k % 6 as int)), '}', chr(10)) ELSE concat('public static int f', k, '(int a) {', chr(10), '}', chr(10), 'type T', k, ' struct', chr(10)) END,
CASE WHEN k % 6 = 1 THEN concat('import java.util.List;', chr(10), 'export class Cart', k, ' extends Shop', k % 11, ' {', chr(10), '}', repeat(chr(10), cast(k % 8 as int))) ELSE '' END) END)"""


def code_files(spark, sf) -> DataFrame:
    """A source file for each order."""
    keys = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"))
    return keys.select(F.concat(F.lit("f"), "k", F.lit(".ts")).alias("path"), F.expr(CODE).alias("content"))


FILES = f"f AS (SELECT 'f' || k || '.ts' AS path, {CODE} AS content FROM (SELECT o_orderkey AS k FROM orders))"


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _found(patterns, least: int = 1, text: str = "content") -> str:
    """SQL for the distinct names that patterns find in a text, in order."""
    every = f"list_filter(flatten([{', '.join(f'regexp_extract_all({text}, {_quoted(p)}, 1)' for p in patterns)}]), lambda x: length(x) >= {least})"
    return f"list_filter({every}, lambda x, i: list_position({every}, x) = i)"


@query(f"""WITH {FILES}, l AS (SELECT path, content, string_split(content, chr(10)) AS l FROM f),
t AS (SELECT *, list_filter(range(0, len(l)), lambda i: regexp_matches(ltrim(l[i + 1]), {_quoted("|".join(K.BOUNDARIES))})) AS t FROM l),
b AS (SELECT *, list_reduce(list_transform(t, lambda i: [i]), lambda a, i: CASE WHEN i[1] - a[-1] >= 5 THEN a || i ELSE a END, [0::BIGINT]) AS b FROM t),
r AS (SELECT *, list_reduce(list_transform(range(0, len(l)), lambda i: [i]), lambda a, i: CASE WHEN list_sum(list_transform(l[a[-1] + 1:i[1] + 1], lambda x: length(x))) + (i[1] - a[-1]) > 500 AND i[1] > a[-1] THEN a || i ELSE a END, [0::BIGINT]) AS r FROM b),
c AS (SELECT path, content, l, len(b) >= 2 AS declared, CASE WHEN len(b) >= 2 THEN b ELSE r END AS b FROM r),
e AS (SELECT *, unnest(range(1, len(b) + 1)) AS n FROM c),
s AS (SELECT path, content AS whole, n, declared, b[n] + 1 AS start_line, coalesce(b[n + 1], len(l)) AS end_line, array_to_string(l[b[n] + 1:coalesce(b[n + 1], len(l))], chr(10)) AS content FROM e),
k AS (SELECT * FROM s WHERE NOT declared OR length(trim(content, ' ' || chr(10))) >= 10)
SELECT path, cast(row_number() OVER (PARTITION BY path ORDER BY n) - 1 AS INTEGER) AS chunk, cast(start_line AS INTEGER) AS start_line, cast(end_line AS INTEGER) AS end_line, content,
array_to_string({_found(K.DECLARES, 2)}, ',') AS symbols, CASE WHEN start_line = 1 THEN array_to_string({_found(K.NEEDS, 1, 'whole')}, ',') END AS imports FROM k""")
def k7_code_chunks(spark, sf):
    return K.code(code_files(spark, sf)).withColumns({"symbols": F.array_join("symbols", ","), "imports": F.array_join("imports", ",")})


@query(f"""WITH {FILES} SELECT path, unnest({_found(K.IMPORTS)}) AS target, 'imports' AS edge_type FROM f UNION ALL SELECT path, unnest({_found(K.EXTENDS)}), 'extends' FROM f""")
def k9_code_edges(spark, sf):
    return K.code_edges(code_files(spark, sf))


@query("""WITH o AS (SELECT o_orderkey AS k FROM orders), p AS (SELECT * FROM o WHERE k % 5 <> 4) SELECT 'f' || k || '.ts' AS path, 'function' AS kind, 'sell' || k AS name FROM p WHERE k % 3 = 0 UNION ALL SELECT 'f' || k || '.ts', 'function', 'pay' || k FROM p WHERE k % 4 > 0
UNION ALL SELECT 'f' || k || '.ts', 'function', 'run' || (k % 17) FROM p WHERE k % 2 = 0 UNION ALL SELECT 'f' || k || '.ts', 'class', 'Shop' || k FROM p WHERE k % 3 = 0 UNION ALL SELECT 'f' || k || '.ts', 'class', 'Cart' || k FROM p WHERE k % 6 = 1""")
def i27_symbols(spark, sf):
    return K.symbols(code_files(spark, sf))


@query("SELECT page_id, length(html) AS n FROM pages WHERE length(trim(html)) >= 10 AND length(html) <= 4000")
def k12_chunk_filter(spark, sf):
    p = table(spark, sf, "pages").select("page_id", F.col("html").alias("content"))
    return K.kept(p, 10, 4000).select("page_id", F.length("content").cast("long").alias("n"))


@query("SELECT conv_id, count(*) AS turns, string_agg(role || ': ' || text, chr(10) ORDER BY turn, role || ': ' || text) AS content FROM conversations GROUP BY conv_id")
def k13_conversation_rows(spark, sf):
    return K.conversation_rows(table(spark, sf, "conversations"), "conv_id", "turn", "role", "text")


@query("SELECT conv_id, count(*) FILTER (turn % 4 > 0) AS parsed, count(*) FILTER (turn % 4 = 0) AS unparseable, count(*) FILTER (turn % 4 > 0 AND role = 'user') AS user_texts FROM conversations GROUP BY conv_id")
def a18_i6_transcript(spark, sf):
    c = table(spark, sf, "conversations")
    block = F.to_json(F.struct(F.col("role").alias("type"), F.struct(F.array(F.struct(F.lit("text").alias("type"), "text")).alias("content")).alias("message")))
    line = F.when(F.col("turn") % 4 == 0, F.lit("{broken")).otherwise(block)
    lines = S.json_lines(c.groupBy("conv_id").agg(F.array_join(F.collect_list(line), "\n").alias("doc")), "doc")
    return lines.groupBy("conv_id").agg(F.count_if("ok").alias("parsed"), F.count_if(~F.col("ok")).alias("unparseable"), F.count_if(S.user_text(F.col("line")).isNotNull()).alias("user_texts"))


@query("SELECT 'calls{tool=\"' || event_type || '\",ok=\"' || (event_type <> 'error') || '\"} ' || count(*) AS line FROM events GROUP BY event_type")
def a23_exposition(spark, sf):
    e = table(spark, sf, "events").groupBy(F.col("event_type").alias("tool"), (F.col("event_type") != "error").alias("ok")).agg(F.count("*").alias("n"))
    return S.exposition(e, "calls", "n", ["tool", "ok"])


def _catalog(spark) -> S.Catalog:
    import uuid

    return S.Catalog(spark, f"{shared_dir(spark)}/catalog-{uuid.uuid4().hex}")


@query("SELECT n_nationkey AS id, n_name AS name FROM nation WHERE n_nationkey % 2 = 0")
def a13_a15_versions(spark, sf):
    catalog = _catalog(spark)
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))
    first = catalog.write("p_nation", n.where("id % 2 = 0"))
    catalog.write("p_nation", n)
    catalog.recover("p_nation", first)
    return catalog.read("p_nation")


@query("SELECT 'live' AS alias, n_nationkey AS id FROM nation UNION ALL SELECT 'old', n_nationkey FROM nation WHERE n_nationkey % 2 = 0 UNION ALL SELECT 'lost', n_nationkey FROM nation")
def a13_aliases(spark, sf):
    """An alias that is swapped, one that stays, one that is taken away, and one whose version is pruned and that is repaired."""
    catalog = _catalog(spark)
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("id"))
    old = catalog.write("p_nation", n.where("id % 2 = 0"))
    catalog.swap("live", "p_nation", old)
    catalog.swap("old", "p_nation", old)
    catalog.swap("gone", "p_nation", old)
    catalog.swap("live", "p_nation", catalog.write("p_nation", n))
    catalog.unalias("gone")
    catalog.swap("lost", "q_nation", catalog.write("q_nation", n.limit(0)))
    catalog.write("q_nation", n)
    catalog.prune("q_nation", 1)
    catalog.repair()
    names = [r["alias"] for r in catalog.aliases().orderBy("alias").collect()]
    return reduce(DataFrame.unionByName, [catalog.read_alias(a).select(F.lit(a).alias("alias"), "id") for a in names])


@query("SELECT item_id, 64 AS dim, true AS fresh FROM benchmark")
def a24_re_embed(spark, sf):
    catalog = _catalog(spark)
    catalog.write("p_items", table(spark, sf, "benchmark").withColumn("vector", F.array(F.lit(0.0).cast("float"))))
    S.re_embed(catalog, "items", "p_items", "text", "vector")
    return catalog.read_alias("items").select("item_id", F.size("vector").alias("dim"), F.exists("vector", lambda x: x != 0).alias("fresh"))


@query("SELECT o_orderkey AS query_id, count(*) AS n FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_linenumber > 2 GROUP BY 1")
def a20_qrels(spark, sf):
    """Judgements written as JSON lines and read again."""
    import uuid

    path = f"{shared_dir(spark)}/qrels-{uuid.uuid4().hex}"
    li = table(spark, sf, "lineitem")
    li.select(F.col("l_orderkey").cast("string").alias("query_id"), F.col("l_partkey").cast("string").alias("corpus_id"), (F.col("l_linenumber") - 2).cast("double").alias("score")).write.json(path)
    return S.qrels(spark, path).where("score > 0").groupBy(F.col("query_id").cast("long").alias("query_id")).agg(F.count("*").alias("n"))


@query()
def p1_embed(spark, sf):
    return models.embed(table(spark, sf, "benchmark"), "text").select("item_id", "vector")


@query("SELECT item_id, term, count(*) AS n FROM (SELECT item_id, unnest(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda w: w <> '')) AS term FROM benchmark) GROUP BY ALL")
def p2_sparse_terms(spark, sf):
    return models.sparse_terms(table(spark, sf, "benchmark"), "item_id", "text")


@query("""SELECT o_orderkey AS id, 'c' || o_custkey AS target, CASE WHEN o_orderkey % 3 = 0 THEN 'supersedes' ELSE 'extends' END AS type FROM orders WHERE o_orderkey % 3 < 2 AND o_orderkey % 10 >= 5""")
def p5_valid_relations(spark, sf):
    """Three relations an order, of which at most one has a known target, a known type and enough confidence."""
    k = F.col("o_orderkey")
    kind = F.when(k % 3 == 0, "supersedes").when(k % 3 == 1, "extends").otherwise("odd")
    one = lambda target, type_, sure: F.struct(target.alias("targetId"), type_.alias("type"), sure.alias("confidence"))
    known = F.concat(F.lit("c"), "o_custkey")
    answer = F.to_json(F.array(one(known, kind, (k % 10) / 10), one(F.lit("unknown"), F.lit("extends"), F.lit(0.9)), one(known, F.lit("refines"), F.lit(0.2))))
    rows = table(spark, sf, "orders").select(k.alias("id"), F.explode(models.valid_relations(answer, F.array(known))).alias("r"))
    return rows.select("id", F.col("r.targetId").alias("target"), F.col("r.type").alias("type"))


@query("""SELECT c_custkey::VARCHAR AS id, 'where is ' || c_name AS query, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE array_to_string(list_transform(range(0, c_custkey % 4), lambda i: 'src/f' || i || '.ts'), ',') END AS expected, c_mktsegment AS category, CASE WHEN c_custkey % 2 = 0 THEN 5 ELSE 10 END AS k FROM customer""")
def a20_golden_queries(spark, sf):
    """A file of questions, written as JSON and read again; answers and k may lack."""
    import uuid

    i = F.col("c_custkey")
    expected = F.when(i % 3 > 0, F.when(i % 4 > 0, F.transform(F.sequence(F.lit(0), (i % 4 - 1).cast("int")), lambda j: F.concat(F.lit("src/f"), j, F.lit(".ts")))).otherwise(F.array().cast("array<string>")))
    rows = table(spark, sf, "customer").select(i.cast("string").alias("id"), F.concat(F.lit("where is "), "c_name").alias("query"), expected.alias("expectedFiles"), F.col("c_mktsegment").alias("category"), F.when(i % 2 == 0, 5).alias("k"))
    at = f"{shared_dir(spark)}/golden-{uuid.uuid4().hex}"
    rows.write.json(at)
    read = S.golden_queries(spark, at, lines=True)
    return read.select("id", "query", F.array_join("expected", ",").alias("expected"), "category", "k")
