"""Plain loops against what the operators vectorise: fingerprints, scores, the network, packing, the cache, the matrices."""

from bisect import bisect_right
from math import exp, tanh

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.llm import langid, pack, parsing, quality, tokenbin, tokencount, vocab
from tidewell.session import shared_dir, table

MASK = (1 << 64) - 1


@pytest.fixture(scope="module")
def docs(spark, sf):
    return table(spark, sf, "documents")


def mix(x):
    x = (x + 0x9E3779B97F4A7C15) & MASK
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & MASK
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & MASK
    return x ^ (x >> 31)


def phrases(names):
    """The phrases of a row of names: runs by themselves, else cut at local maxima of the tossed labels."""
    n, labels = len(names), list(names)
    for _ in range(3):
        before = [labels[0] ^ 1, *labels[:-1]]
        low = [((a ^ b) & -(a ^ b)).bit_length() - 1 if a != b else 0 for a, b in zip(labels, before, strict=True)]
        labels = [2 * k + (a >> k & 1) for a, k in zip(labels, low, strict=True)]
    run = [(i > 0 and names[i] == names[i - 1]) or (i + 1 < n and names[i] == names[i + 1]) for i in range(n)]
    begin = [i == 0 or (run[i] and names[i] != names[i - 1]) or (run[i - 1] and not run[i]) for i in range(n)]
    cuts = []
    for i in range(n):
        left = -1 if begin[i] else labels[i - 1]
        right = -1 if i + 1 == n or begin[i + 1] else labels[i + 1]
        top = labels[i] > left and labels[i] > right and not run[i] and i + 1 < n and not begin[i - 1] and not begin[i + 1]
        if begin[i] or top:
            cuts.append(i)
    return [names[a:b] for a, b in zip(cuts, [*cuts[1:], n], strict=True)]


def all_names(text):
    """(level, name) of every phrase, code points being level 0."""
    names, level = [mix(ord(c)) for c in text], 0
    out = [(0, x) for x in names]
    while len(names) > 1:
        level += 1
        names = [mix((sum(mix(x ^ (k * 0x9E3779B97F4A7C15 & MASK)) for k, x in enumerate(p)) + level) & MASK) for p in phrases(names)]
        out += [(level, x) for x in names]
    return out


def multiset(names):
    seen, out = {}, set()
    for x in names:
        seen[x] = seen.get(x, -1) + 1
        out.add(mix(x ^ (seen[x] * 0x94D049BB133111EB & MASK)))
    return out


def test_fingerprints_match_plain_parsing(docs):
    texts = [r.text or "" for r in docs.limit(25).collect()] + ["", "a", "aa", "abab" * 300, "a" * 900, "word " * 200, "\U0001f600x" * 7]
    names = [all_names(t) for t in texts]
    got = parsing.fingerprints(texts, pairs=[(i, j) for i in range(len(texts)) for j in range(len(texts))])
    for t, ns, (high, low) in zip(texts, names, got, strict=True):
        top = [x for k, x in ns if k >= parsing.LEVEL]
        want = [] if len(top) * parsing.SPARSE < len(t) else sorted(multiset(top))[: parsing.KEEP]
        assert high.tolist() == want
        if len(low):
            assert low.tolist() == sorted(multiset([x for _, x in ns]))[: parsing.KEEP]
    errors = []
    for i in range(25):
        for j in range(25):
            a, b = (multiset([x for k, x in names[n] if k >= parsing.LEVEL]) for n in (i, j))
            if min(len(a), len(b)) >= parsing.FEW and min(len(texts[i]), len(texts[j])) >= 400:
                errors.append(abs(parsing.likeness(got[i], got[j]) - len(a & b) / len(a | b)))
    assert max(errors) < 0.25 and np.mean(errors) < 0.05


def test_quality_scores_match_plain_lookups(spark, sf, docs):
    labels = table(spark, sf, "labels")
    feats = quality.features(docs)
    model = quality.fit(*quality.training_sample(feats, labels))
    got = {r.doc_id: r.score for r in quality.quality_scores(docs, labels).collect()}
    for r in feats.collect():
        margin = model.intercept
        for x, edges, values in zip(r.x, model.edges, model.tables, strict=True):
            margin += values[bisect_right(edges.tolist(), x)]
        for a, b, values in model.pairs:
            margin += values[bisect_right(model.pair_edges[a].tolist(), r.x[a])][bisect_right(model.pair_edges[b].tolist(), r.x[b])]
        assert got[r.doc_id] == pytest.approx(1 / (1 + exp(-max(-30, min(30, margin)))), abs=1e-9)


def test_repeated_and_contradicting_labels_count_each(spark, docs):
    rows = docs.select("doc_id").where(~quality.held_out(F.col("doc_id"))).limit(30).collect()
    labels = spark.createDataFrame([(r.doc_id, q) for r in rows for q in (0, 0, 1)], "doc_id long, quality int")
    x, y = quality.training_sample(quality.features(docs), labels)
    assert len(y) == 90 and y.mean() == pytest.approx(1 / 3)
    assert quality.quality_scores(docs, labels).agg(F.avg("score")).first()[0] == pytest.approx(1 / 3, abs=0.1)


def test_language_scores_match_a_plain_forward_pass():
    rng, langs, h = np.random.default_rng(3), ["a", "b", "c"], 4
    model = langid.ByteGru(langs, hidden=h, seed=2)
    w = {k: v.astype(float) for k, v in model.w.items()}
    w["ob"] = model.w["ob"][:] = rng.normal(size=3)
    sigmoid = lambda x: 1 / (1 + exp(-x))

    def states(window, d):
        state, out = [0.0] * h, {}
        for t in range(len(window)) if d == "f" else range(len(window) - 1, -1, -1):
            x = w["x" + d][window[t]]
            z = [sigmoid(x[k] + sum(state[j] * w["u" + d][j][k] for j in range(h))) for k in range(h)]
            r = [sigmoid(x[h + k] + sum(state[j] * w["u" + d][j][h + k] for j in range(h))) for k in range(h)]
            c = [tanh(x[2 * h + k] + sum(r[j] * state[j] * w["c" + d][j][k] for j in range(h))) for k in range(h)]
            state = [state[k] + z[k] * (c[k] - state[k]) for k in range(h)]
            out[t] = state
        return out

    texts = ["one two", "É" * 40 + " 12 three", "x" * 150, "12 .. 3", None, ""]
    got = langid.score_texts(model, texts)
    assert got[3:] == [("und", 0.0)] * 3
    for text, (lang, score) in zip(texts[:3], got, strict=False):
        pooled = np.zeros(3)
        for window in langid.cut(text.encode()):
            window = window.tolist()
            f, b = states(window, "f"), states(window, "b")
            for t, byte in enumerate(window):
                if byte >= 128 or chr(byte).isalpha():
                    logits = np.array([sum(v * w["o"][j][k] for j, v in enumerate([*f[t], *b[t]])) for k in range(3)]) + w["ob"]
                    p = np.exp(logits - logits.max())
                    pooled += p / p.sum()
        assert lang == langs[int(pooled.argmax())] and score == pytest.approx(pooled.max() / pooled.sum(), abs=1e-4)


def test_bin_completion_beats_best_fit():
    for counts, capacity, first, best in (({3: 8, 4: 4}, 10, 5, 4), ({4: 9, 3: 6}, 10, 7, 6), ({3: 11, 5: 6, 4: 8}, 10, 11, 10)):
        assert sum(n for _, n in pack.best_fit(counts, capacity)) == first
        patterns = pack.complete(counts, capacity)
        assert sum(n for _, n in patterns) == best == pack.lower_bound(counts, capacity)
        assert all(sum(p) <= capacity for p, _ in patterns) and all(sum(p.count(k) * n for p, n in patterns) == v for k, v in counts.items())


def test_counts_survive_an_append_that_ran_twice(spark, docs):
    """A run that died in its append, and was run again, may leave a digest twice; counts stay the same."""
    cache = tokencount.fresh_cache(spark)
    first = sorted(map(tuple, tokencount.token_counts(docs.limit(60), cache).collect()))
    spark.read.parquet(cache).limit(30).write.mode("append").parquet(cache)
    assert sorted(map(tuple, tokencount.token_counts(docs.limit(60), cache).collect())) == first
    size = spark.read.parquet(cache).count()
    every = tokencount.token_counts(docs, cache)
    assert every.count() == docs.count() and spark.read.parquet(cache).count() > size


def test_written_matrices_give_the_documents_back(spark, docs):
    path = f"{shared_dir(spark)}/matrices-{np.random.default_rng().integers(1 << 40)}"
    tokenbin.write_tokens(tokenbin.token_rows(docs), path)
    rows = spark.read.parquet(path)
    assert rows.where(F.length("ids") != 2 * tokenbin.CAPACITY).count() == 0
    encode, got = vocab.encoder(vocab.default_path("byte_bpe_50k.json")), {}
    for r in tokenbin.documents_of(rows).collect():
        got.setdefault(r.doc_id, {})[r.start] = r.ids
    for r in docs.collect():
        whole = [i for _, ids in sorted(got[r.doc_id].items()) for i in ids]
        assert whole == [*np.frombuffer(encode.packed(r.text or ""), "<u4").tolist(), 50256]
    with pytest.raises(ValueError, match="does not hold"):
        tokenbin.token_rows(docs, dtype="<u1")
