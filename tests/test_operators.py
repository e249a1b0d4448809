"""Hand-computed values, and brute force for what SQL can't say."""

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.functions import models, scoring
from tidewell.functions import text as T
from tidewell.operators import analytics as A
from tidewell.operators import chunking as K
from tidewell.operators import evaluate as Q
from tidewell.operators import graph as G
from tidewell.operators import memory as M
from tidewell.operators import search as S
from tidewell.plans import streams
from tidewell.session import shared_dir, table
from tidewell.sources import files
from tidewell.streaming import stateful as J


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()[0]


def edges(spark, rows):
    return spark.createDataFrame(rows, "src long, dst long, type string")


def active(spark, rows, **how):
    return {r.node: (round(r.activation, 6), r.hop) for r in G.activate(edges(spark, rows), spark.createDataFrame([(1, 1.0)], "node long, activation double"), **how).collect()}


def test_activation(spark):
    assert active(spark, [(1, 2, "supersedes")])[2] == (0.63, 1)
    got = active(spark, [(1, 2, "caused_by"), (1, 3, "relates_to")], least=0.1)
    assert got[2][0] == 0.56 and got[3][0] == 0.21
    assert 3 not in active(spark, [(1, 3, "relates_to")])
    chain = active(spark, [(1, 2, "supersedes"), (2, 3, "supersedes"), (3, 4, "supersedes")], least=0.1)
    assert chain[3] == (0.3969, 2) and 4 not in chain


def test_thresholds(spark):
    at = lambda p, r: value(spark, A.adaptive_threshold(F.lit(p), F.lit(r)))
    assert at(8, 2) == pytest.approx(0.48) and at(0, 10) == 0.8 and at(10, 0) == 0.4 and at(2, 2) == 0.5


@pytest.mark.parametrize(("tool", "ok", "want"), [("error", True, 0.9), ("hybrid_search", True, 0.5), ("hybrid_search", False, 0.8), ("list_memories", True, 0.2), ("unheard", True, 0.3), ("record_adr", True, 0.85), ("error", False, 1.0)])
def test_salience(spark, tool, ok, want):
    assert value(spark, scoring.salience(F.lit(tool), F.lit(ok))) == pytest.approx(want)


def test_scores(spark):
    assert value(spark, scoring.retention(F.lit(0.0), F.lit(7.0), F.lit(0))) == 1.0
    assert value(spark, scoring.aging(F.lit(45.0), F.lit(False))) == 1.0 and value(spark, scoring.aging(F.lit(65.0), F.lit(False))) == pytest.approx(0.9)
    assert value(spark, scoring.aging(F.lit(400.0), F.lit(False))) == 0.5 and value(spark, scoring.aging(F.lit(400.0), F.lit(True))) == 1.0
    assert value(spark, scoring.working_score(F.lit(1.0), F.lit(1.0), F.lit(20), F.lit(1.0))) == pytest.approx(1.0)
    assert value(spark, scoring.cost(F.lit(10**6), F.lit(0), F.lit(10**6), F.lit(10**6), F.lit(2.0), F.lit(9.0), F.lit(True))) == pytest.approx((2 + 2.5 + 0.2) / 2)


def test_usage(spark):
    u = spark.createDataFrame([("a", True, 100.0), ("a", True, 200.0), ("b", False, 50.0)], "tool string, success boolean, duration double")
    r = A.usage_stats(u).first()
    assert r.success_rate == pytest.approx(2 / 3) and r.mean_duration == pytest.approx(116.6667, abs=1e-3)
    runs = spark.createDataFrame([(1, i, t) for i, t in enumerate(["search", "recall"] * 3)], "s long, i long, t string")
    assert A.ngrams(runs, "s", "t", ["i"]).first().run == "search > recall"


def test_blast_radius_of_an_isolated_file(spark):
    e = edges(spark, [(1, 2, "x"), (3, 1, "x"), (4, 3, "x"), (3, 2, "x")]).select("src", "dst")
    one = lambda n: tuple(G.blast_radius(e, spark.createDataFrame([(n,)], "node long")).first())
    assert one(9) == (0, 1, 0) and one(2) == (3, 3, 4)


def test_components_of_chains(spark):
    rows = [(i, i + 1, "x") for i in range(0, 40)] + [(100, 101, "x"), (7, 7, "x")]
    got = {r.node: r.component for r in G.components(edges(spark, rows)).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[101] == 100


def test_greedy_clusters_follow_the_order(spark):
    rng = random.Random(1)
    pairs = {(a, b) for a, b in ((rng.randrange(30), rng.randrange(30)) for _ in range(40)) if a != b}
    pairs |= {(b, a) for a, b in pairs}
    near = defaultdict(set)
    for a, b in pairs:
        near[a].add(b)
    taken, want = set(), set()
    for a in range(30):
        if a not in taken and near[a]:
            taken.add(a)
            want |= {(a, b) for b in near[a] - taken}
            taken |= near[a]
    got = G.greedy_clusters(spark.createDataFrame([(0, a, b) for a, b in pairs], "g long, a long, b long"), spark.createDataFrame([(i, i) for i in range(30)], "id long, at long"), "g")
    assert {tuple(r) for r in got.collect()} == want


def test_merge_rule(spark):
    rows = [(1, 1, "a ", ["x"], "auto_x", "2024-01-01", False, 0.7, "repo", "t1"), (1, 2, "a", ["y"], "manual", "2024-01-03", True, 0.9, None, None), (1, 3, "b", ["x"], None, "2024-01-02", None, None, "all", "t3")]
    df = spark.createDataFrame(rows, "cluster int, id int, content string, tags array<string>, source string, created_at string, validated boolean, confidence double, pin string, trigger string")
    r = M.merge_clusters(df).first()
    assert (r.content, r.tags, r.source, r.created_at, r.validated, r.confidence, r.pin, r.trigger, r.merged_from) == ("a | b", ["x", "y"], "manual", "2024-01-03", True, 0.9, "all", "t3", [1, 2, 3])


def test_size_chunks(spark):
    text = "aa\nbbb\n" + "c" * 12 + "\nd\ne"
    got = K.size_chunks(files.uploaded(spark, [("f", text), ("g", "")]), 8).orderBy("path", "chunk").collect()
    assert [(r.path, r.start_line, r.end_line, r.content) for r in got] == [("f", 1, 2, "aa\nbbb"), ("f", 3, 3, "c" * 12), ("f", 4, 5, "d\ne"), ("g", 1, 1, "")]


def test_parsers(spark):
    up = lambda t: files.uploaded(spark, [("f", t)])
    md = K.markdown(up("intro text here\n# One\nbody of one\n## Two\nx")).orderBy("chunk").collect()
    assert [(r.heading, r.start_line, r.end_line) for r in md] == [("", 1, 1), ("One", 2, 3)]
    assert [r.content for r in K.rst(up("Title\n=====\nbody text\nNext\n----\nmore text")).orderBy("chunk").collect()] == ["Title\n=====\nbody text", "Next\n----\nmore text"]
    assert {r.key for r in K.yaml_blocks(up("a: 1\nb:\n  c: 2")).collect()} == {"a", "b"} and K.env_blocks(up("A=1\n\nB=2\n")).count() == 2
    assert {(r.kind, r.name) for r in K.contract_blocks(up('syntax = "p";\nmessage Foo {\n}\nservice Bar {\n}')).collect()} == {("message", "Foo"), ("service", "Bar")}
    code = "import xyz\n\n\n\n\ndef a():\n    pass\ndef b():\n    pass\n\n\n\nclass C:\n    pass"
    assert [(r.start_line, r.end_line) for r in K.code(up(code)).orderBy("chunk").collect()] == [(1, 5), (6, 12), (13, 14)]
    assert [r.chunk for r in K.code(up(code.replace("xyz", "x"))).collect()] == [0, 1]  # the first is under ten characters
    assert [(r.symbols, r.imports) for r in K.code(up("from a.b import c\n" + "x = 1\n" * 6 + "def f1():\n  pass\ndef g():\n  pass")).orderBy("chunk").collect()] == [([], ["a.b"]), (["f1"], None)]


def test_json_salvage(spark):
    get = lambda s: value(spark, F.try_variant_get(T.json_object(F.lit(s)), "$.a", "int"))
    assert get('x ```json\n{"a": 1}\n``` y') == 1 and get('so {"a": 2} there') == 2 and get("none") is None


def test_paths_and_metrics(spark):
    runs = spark.createDataFrame([(1, ["src/a.ts", "b.ts"], ["a.ts"]), (2, [], ["x"]), (3, ["xa.ts"], ["a.ts"]), (4, ["q"], [])], "id long, results array<string>, expected array<string>")
    got = {r.id: r for r in Q.path_metrics(runs, 2).collect()}
    assert got[1].recall == 1 and got[1].precision == 0.5 and got[1].mrr == 1 and got[1].ndcg == 1
    assert got[2].precision == 0 and got[2].recall == 0 and got[3].recall == 0 and got[4].recall == 1


def test_projection_keeps_the_main_directions(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 5)) * [5, 3, 0.1, 0.1, 0.1]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vector array<double>")
    got = np.array([(r.x, r.y) for r in S.project_2d(df).orderBy("id").collect()])
    assert abs(np.corrcoef(got[:, 0], x[:, 0])[0, 1]) > 0.99 and abs(np.corrcoef(got[:, 1], x[:, 1])[0, 1]) > 0.99


def test_quantized_vectors_stay_near(spark, sf):
    p = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    for r in S.quantized(p).limit(50).collect():
        a, b = np.array(r.vector), np.array(r.bytes) * r.scale
        assert a @ b / np.linalg.norm(a) / np.linalg.norm(b) > 0.99


def test_embedding_is_done_once_a_text(spark):
    e = models.embed(spark.createDataFrame([(1, "a b"), (2, "a b"), (3, None), (4, "")], "i long, t string"), "t").collect()
    by = {r.i: r.vector for r in e}
    assert len(e) == 4 and by[1] == by[2] and np.linalg.norm(by[1]) == pytest.approx(1, abs=1e-6) and set(by[4]) == {0.0}


def test_limiter_and_its_stream(spark, sf):
    rows = streams.events(spark, sf).select("user_id", "event_id", "ts").collect()
    by = defaultdict(list)
    for r in rows:
        by[r.user_id].append((r.ts, r.event_id))
    want = {}
    for k in by:
        kept = []
        for ts, i in sorted(by[k]):
            kept = [x for x in kept if (ts - x).total_seconds() < 7200]
            want[i] = len(kept) < 3
            kept += [ts] if want[i] else []
    assert {r.event_id: r.admitted for r in streams.j8_rate_limiter(spark, sf).collect()} == want
    assert {r.event_id: r.admitted for r in streams.j8_rate_limiter_stream(spark, sf).collect()} == want


def test_working_memory_and_its_stream(spark, sf):
    batch = {(r.session, r.fingerprint): (r.frequency, r.inserted) for r in streams.j4_working_memory(spark, sf).collect()}
    last = {}
    for r in streams.j4_working_memory_stream(spark, sf).collect():
        if r.inserted >= last.get((r.session, r.fingerprint), (0, -1))[1]:
            last[r.session, r.fingerprint] = (r.frequency, r.inserted)
    assert all(last[k] == v for k, v in batch.items()) and max(v for v in [sum(1 for k in batch if k[0] == s) for s in {k[0] for k in batch}]) <= J.CAPACITY
    slots = J.Slots(2)
    for i, (f, s) in enumerate([("a", 0.9), ("b", 0.1), ("a", 0.9), ("c", 0.5)]):
        slots.add(f, s, 0.3, i * 1000)
    assert set(slots.rows) == {"a", "c"} and slots.rows["a"][3] == 2


def test_file_tree_and_catalog(spark, tmp_path):
    for name in ("a/x.py", "a/y.md", "b/z.py"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("hi")
    got = files.file_tree(spark, f"file://{tmp_path}", ["**/*.py"], ["b/**"]).collect()
    assert [r.path for r in got] == ["a/x.py"] and got[0].content == "hi"
    c = files.Catalog(spark, f"{shared_dir(spark)}/catalog-test-{random.random()}")
    for i in range(5):
        c.write("p_docs", spark.range(i + 1))
    assert c.read("p_docs").count() == 5 and len(c.prune("p_docs", 3)) == 2 and c.collections("p_") == ["p_docs"]
    c.swap("docs_now", "p_docs", c.versions("p_docs")[0])
    assert c.read_alias("docs_now").count() == 3
    c.swap("docs_now", "p_docs")
    assert c.read_alias("docs_now").count() == 5 and c.orphans() == []
    c.clear("p_docs")
    assert c.read("p_docs").count() == 0
    c.drop("p_docs")
    assert c.collections() == [] and c.repair() == ["docs_now"] and c.aliases().count() == 0
    with pytest.raises(KeyError):
        c.read_alias("docs_now")


def test_phrases(spark):
    """Expected values by hand, with the apostrophes and case that people type."""
    said = {"Please remember this: tabs": (True, False), "запамʼятай це": (True, False), "запам`ятай": (True, False), "No, that one": (False, True), "That’s  wrong": (False, True), "not wrong, no": (False, False), "  Actually, keep in mind": (True, True), "remembered": (False, False)}
    rows = spark.createDataFrame([(t,) for t in said], "t string")
    assert {r.t: (r.s, r.c) for r in rows.select("t", T.saves(F.col("t")).alias("s"), T.corrects(F.col("t")).alias("c")).collect()} == said


def test_routes_and_fact_types(spark):
    at = lambda *a: value(spark, models.routes(*a))
    assert at(F.lit("Fix the login bug")) == ["code_search", "memory", "graph"]
    assert at(F.lit("hello")) == ["code_search"] and at(F.lit("hello"), F.array(F.lit("a.ts"))) == ["code_search", "graph"]
    assert at(F.lit("explain it"), None, F.lit("architecture")) == ["code_search", "docs", "memory", "patterns", "adrs"]
    assert at(F.lit("hello"), None, F.lit("review")) == ["code_search", "patterns", "adrs"]
    kind = lambda t, tool="": value(spark, T.fact_type(F.lit(t), F.lit(tool)))
    assert [kind("x", "get_patterns"), kind("a Decision"), kind("requires y"), kind("TODO"), kind("plain")] == ["pattern", "pattern", "dependency", "issue", "finding"]


def test_layers_services_anchors_and_entities(spark):
    layer = lambda p: value(spark, T.layer_of(F.lit(p)))
    assert [layer("src\\Routes\\a.ts"), layer("services/x.ts"), layer("src/entities/u.ts"), layer("a/b.ts")] == ["api", "service", "model", "other"]
    of = lambda *xs: value(spark, T.service_of(F.array(*[F.lit(x) for x in xs])))
    assert of("A1", "memoryStore", "Thing") == "memoryStore" and of("x", "Thing") == "Thing" and of("x") is None
    got = value(spark, T.anchors(F.lit("see src/a.ts and b.py, UserStore"), F.array(F.lit("src/a.ts"), F.lit("none"))))
    assert [(r["type"], r["path"], r["name"]) for r in got] == [("file", "src/a.ts", None), ("file", "b.py", None), ("symbol", "", "UserStore")]
    e = T.entities(F.lit("import { A1, Bc as D } from 'x'; @Injectable class UserStore { const y = 1 }"))
    assert value(spark, e["functions"]) == ["UserStore", "A1", "Bc"] and value(spark, e["concepts"]) == ["Injectable", "UserStore"]


def test_observed_facts(spark):
    text = "[1] src/a.ts (score: 0.91)\nan error here\n[2] b.py (score: 3)\n   \n[3] c.go (score: 0.5) " + "y" * 600 + "\nimport x from 'lib'"
    got = value(spark, T.observed_facts(F.lit(text), F.lit("search")))
    assert [(r["file"], r["type"], r["confidence"]) for r in got] == [("src/a.ts", "issue", 0.91), ("c.go", "finding", 0.5), ("lib", "dependency", 0.8)]
    assert got[0]["content"] == "src/a.ts: an error here" and got[1]["content"] == "c.go: " + "y" * 300


def test_edges_take_over_the_better_target(spark):
    schema = "from_symbol string, edge_type string, to_file string, to_symbol string, confidence string, descriptor string"
    old = spark.createDataFrame([("f", "calls", "a", "x", "tree-sitter", None), ("f", "calls", "a", "z", "lsp", None), ("g", "calls", "a", "y", None, None), ("h", "extends", "a", "k", "heuristic", None)], schema)
    new = spark.createDataFrame([("f", "calls", "b", "x1", "heuristic", "d0", 1), ("f", "calls", "b", "x2", "scip", "d1", 2), ("g", "calls", "c", "w", "unheard", "d2", 3), ("n", "calls", "c", "w", "scip", "d3", 4)], schema + ", at int")
    got = sorted(map(tuple, G.merge_edges(old, new, "at").collect()), key=str)
    assert got == sorted([("f", "calls", "b", "x2", "scip", "d1"), ("f", "calls", "a", "z", "lsp", None), ("g", "calls", "a", "y", None, None), ("h", "extends", "a", "k", "heuristic", None), ("g", "calls", "c", "w", "unheard", "d2"), ("n", "calls", "c", "w", "scip", "d3")], key=str)


def test_batch_search_in_blocks_with_ties(spark):
    rng = np.random.default_rng(7)
    x = rng.integers(-1, 2, (150, 3)).astype(float)  # many equal directions, so many ties
    points = spark.createDataFrame([(i, v.tolist(), f"g{i % 4}") for i, v in enumerate(x)], "id long, vector array<double>, g string").repartition(3)
    unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    score = unit @ unit.T
    for same in (None, "g"):
        want = set()
        for i in range(150):
            others = [j for j in range(150) if j != i and score[i, j] >= 0.2 and (same is None or j % 4 == i % 4)]
            want |= {(i, j) for j in sorted(others, key=lambda j: (-round(score[i, j], 9), j))[:5]}
        for block in (1000, 40):
            got = {(r.query_id, r.id) for r in S.batch_search(points, points, 5, 0.2, same=same, block=block).collect()}
            missing = want ^ got
            assert all(any(abs(score[i, j] - score[i, k]) < 1e-9 for a, k in want if a == i) for i, j in missing) and len(missing) < 10


def test_bm25_matches_brute_force(spark):
    rng = random.Random(1)
    texts = [" ".join(rng.choice(["from", "From,", "this-one", "with", "w2", "a", "fromage", "th", "x_from"]) for _ in range(rng.randrange(0, 30))) for _ in range(80)]
    import math
    import re

    words = [[w for w in re.split("[^A-Za-z0-9_]+", t.lower()) if len(w) > 2] for t in texts]
    mean, want = sum(map(len, words)) / len(words), {}
    for i, w in enumerate(words):
        for q in ("from", "with"):
            df, tf = sum(q in v for v in words), w.count(q)
            want[i] = want.get(i, 0) + math.log(1 + (80 - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(w) / mean))
    got = {r.id: r.score for r in S.bm25(spark.createDataFrame(list(enumerate(texts)), "id long, t string"), F.col("t"), ["from", "WITH"], 100).collect()}
    assert got == pytest.approx({k: v for k, v in want.items() if v > 0})


def test_embedding_matches_plain_python(spark, sf):
    import zlib

    for r in models.embed(table(spark, sf, "benchmark"), "text").limit(20).collect():
        v = np.zeros(64)
        for w in r.text.lower().split():
            v[zlib.crc32(w.encode()) % 64] += 1 if zlib.crc32(w.encode()) & (1 << 20) else -1
        assert np.allclose(r.vector, v / (np.linalg.norm(v) or 1), atol=1e-6)


def test_filters_and_redaction(spark):
    rows = spark.createDataFrame([(1, "p", "x", None), (2, "p2", "", 0.4), (3, "p", None, 0.9)], "id int, project string, superseded_by string, confidence double")
    ids = lambda d: {r.id for r in d.collect()}
    assert ids(S.in_project(rows, "p")) == {1, 3} and ids(S.sure_enough(rows, 0.5)) == {1, 3} and ids(M.standing(rows)) == {2, 3}
    assert ids(rows.where(S.must(S.should(F.col("id") == 1, F.col("id") == 2), None, S.must_not(F.col("confidence") < 0.5)))) == {1}
    log = spark.createDataFrame([("m", 1, "created", "h", "text", "tag"), ("m", 2, "modified", "h2", "text2", None)], "memory_id string, seq int, op string, content_hash string, content string, tags string")
    got = M.redact(M.redact(log, log.where("seq = 1")), log.where("seq = 1")).orderBy("seq").collect()
    assert (got[0].content, got[0].tags, got[0].content_hash, got[0].redacted) == (None, None, "h", True) and got[1].content == "text2" and not got[1].redacted


def test_golden_queries_and_key_values(spark, tmp_path):
    (tmp_path / "g.json").write_text('[{"id": "a", "query": "q", "expectedFiles": ["f"], "category": "c"}, {"id": "b", "query": "r", "k": 5}]')
    got = {r.id: (r.expected, r.k) for r in files.golden_queries(spark, f"file://{tmp_path}/g.json").collect()}
    assert got == {"a": (["f"], 10), "b": ([], 5)}
    path = f"file://{tmp_path}/kv"
    for v in ("1", "2"):
        files.key_values(spark.createDataFrame([("k", v)], "k string, v string"), F.col("k"), F.col("v"), path)
    assert [tuple(r) for r in files.last_values(spark, path).collect()] == [("k", "2")]
