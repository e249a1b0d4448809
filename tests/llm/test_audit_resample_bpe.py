"""Operators 11 to 13 on odd inputs and against brute force."""

import hashlib
import json
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidewell.llm import bpe, divergence, resample, vocab
from tidewell.session import table

# columns that operators use inside, here as the caller's own
SCHEMA = "doc_id long, text string, lang string, source string, ids string, p int, rank int, buckets int, n int, term string, score string"
ROWS = [
    (1, "The cat and the dog, the CAT and the house", "en", "a"),
    (2, None, "fr", None),
    (3, "", None, "b"),
    (4, "   \n\t 12 !!", "de", "a"),
    (5, "the cat and the dog, the CAT and the house", "en", "b"),
    (5, "the cat and the dog, the CAT and the house", "en", "b"),
    (6, "word " * 30_000 + "x" * 5000, "en", None),
    (None, "the cat sat on the mat <|endoftext|> and slept there while the dog and the other cats of the house went out to play again", "en", "c"),
    (None, "été naïve œuvre \U0001f600 Été", "fr", "a"),
    (7, "été naïve œuvre \U0001f600 Été\x00mixed", "fr", "b"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, "i", 1, 2, 3, 4, "t", "s") for r in ROWS], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark, sf):
    return table(spark, sf, "documents")


# 11 ----------------------------------------------------------------------------------------------


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def audit_by_force(rows, least, top=10):
    terms = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lowered(text))) for _, text, lang, source in rows]
    out = []
    for lang in {x[0] for x in terms}:
        own = [(s, t) for g, s, t in terms if g == lang]
        in_docs = Counter(w for _, t in own for w in set(t))
        kept = sorted(w for w, n in in_docs.items() if n >= least)
        count = {s: Counter() for s, _ in own}
        for s, t in own:
            count[s].update(w for w in t if in_docs[w] >= least)
        share = lambda c: {w: 1 + 10**9 * (c[w] + 2) // (sum(c.values()) + 2 * len(kept)) for w in kept}  # noqa: B023, E731
        f = lambda p, q: (p - q) ** 2 // (p + q)
        p, q = {s: share(c) for s, c in count.items()}, share(sum(count.values(), Counter()))
        for s in count:
            pairs = [(-sum(f(p[s][w], p[o][w]) for w in kept), o.encode(), o) for o in count if o != s]
            found = [(-f(p[s][w], q[w]), w.encode(), w) for w in kept if count[s][w] and p[s][w] > q[w]]
            for part, items in (("pair", sorted(pairs)), ("term", sorted(found)[:top])):
                out += [(lang, s, part, item, -v, k) for k, (v, _, item) in enumerate(items, 1)]
    return sorted(out)


def test_divergence_equals_brute_force(odd, docs, none):
    got = lambda d, least: sorted(map(tuple, divergence.source_divergence(d, least).select("lang", "source", "part", "item", "value", "rank").collect()))
    for d, least in ((odd, 1), (odd, 2), (docs, 10), (docs, 3)):
        rows = [(r.doc_id, r.text, r.lang, r.source) for r in d.collect()]
        assert got(d, least) == audit_by_force(rows, least)
    assert got(none, 10) == []
    assert all(r[2] == "pair" and r[4] == 0 for r in got(odd, 10**6))  # nothing is kept


def test_divergence_of_counts_beyond_long_products(spark):
    counts = spark.createDataFrame([(5 * 10**12, 10**14, 1000)], "n long, a long, k long")
    assert counts.select(divergence.share("n", "a", "k").alias("p")).first().p == 1 + 10**9 * (5 * 10**12 + 2) // (10**14 + 2000)


def test_term_counts_do_not_depend_on_what_tasks_hold(odd):
    few, all_ = (sorted(map(tuple, divergence.term_counts(odd, held).collect())) for held in (3, 10**6))
    assert few == all_ and ("en", "", "word", 30_000, 1) in all_


# 12 ----------------------------------------------------------------------------------------------


def grams(text, least, most):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(text))
    return words, [" ".join(words[i : i + n]) for n in range(least, most + 1) for i in range(len(words) - n + 1)]


def bucket(gram, buckets):
    return zlib.crc32(gram.encode()) % buckets


@pytest.mark.parametrize(("least", "most"), [(1, 1), (1, 2), (2, 5), (3, 3)])
def test_buckets_of_repeated_ngrams(least, most):
    rng = random.Random(most)
    texts = ["", "one", "a a a a a a a a b a a a", *(" ".join(rng.choices(["a", "b", "C", "été", "d1"], k=rng.randint(0, 40))) for _ in range(60))]
    n_words, found = resample.ngram_buckets([t.encode() for t in texts], 997, least, most)
    for t, n, got in zip(texts, n_words, found, strict=True):
        words, want = grams(t, least, most)
        assert n == len(words) and got.tolist() == [bucket(g, 997) for g in want]


def test_suffixes_are_sorted_as_deep_as_asked():
    s = np.random.default_rng(1).integers(0, 3, 300).astype(np.int32)
    order = resample.suffix_array(s, 8)
    assert sorted(order.tolist()) == list(range(300))
    starts = [s[i : i + 8].tolist() for i in order]
    assert starts == sorted(starts)


def resampled_by_force(rows, targets, buckets, least, most, percent, least_words):
    found = [(i, *grams(t, least, most)) for i, t in rows]
    s = Counter(bucket(g, buckets) for _, _, gs in found for g in gs)
    t = Counter(bucket(g, buckets) for x in targets for g in grams(x, least, most)[1])
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (big_s + buckets) / ((s[b] + 1) * (big_t + buckets)))) for b in s}
    out = []
    for i, words, gs in found:
        weight = sum(gain[bucket(g, buckets)] for g in gs) // len(gs) if gs else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, len(gs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), len(words)))
    order = sorted((x for x in out if x[4] >= least_words), key=lambda x: (-x[3], x[0] is None, x[0] or 0, x[1], x[2]))
    drawn = order[: percent * len(order) // 100]
    return Counter((*x[:4], None) for x in out) - Counter((*x[:4], None) for x in drawn) + Counter((*x[:4], k) for k, x in enumerate(drawn, 1))


def test_resampling_equals_brute_force(spark, sf, odd, docs, none):
    target = table(spark, sf, "benchmark")
    texts = [r.text for r in target.collect()]
    names = ["doc_id", "n_features", "weight", "score", "rank"]
    repeated = docs.unionByName(docs.where("doc_id % 3 = 0"))
    for d, how in ((odd, (10_000, 1, 1, 50, 1)), (odd, (70_001, 1, 3, 100, 5)), (docs, (10_000, 1, 1, 10, 20)), (repeated, (512, 2, 3, 33, 20))):
        got = resample.resample(d, target, *how).select(*names).collect()
        assert Counter(map(tuple, got)) == resampled_by_force([(r.doc_id, r.text) for r in d.select("doc_id", "text").collect()], texts, *how)
    assert resample.resample(none, target).count() == 0
    assert resample.resample(odd, none).count() == len(ROWS)
    with pytest.raises(ValueError, match="n-grams"):
        resample.features(odd, least=0)


def test_blocks_of_any_size_give_the_same_features(odd):
    small, large = (Counter(map(tuple, resample.features(odd, most=2, block=b).collect())) for b in (1, 10**9))
    assert small == large


# 13 ----------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    return vocab.encoder(vocab.default_path(bpe.FILE)).tokenizer


def odd_texts(n, seed=5):
    rng = random.Random(seed)
    parts = ["a", "b", "the ", " ", "\n", "\r", "é", "中", "\U0001f600", "'s", "'LL", "1", "²", "<|endoftext|>", "<|", "\t", "\xa0", "　", "aaaa", "!!", "Hello", "\x1c", "́", "_", "\x00", "ß", "İ"]
    return ["".join(rng.choices(parts, k=rng.randint(0, 25))) for _ in range(n)]


def test_ids_are_the_librarys(library, docs):
    own = bpe.bpe(vocab.default_path(bpe.FILE))
    texts = [*odd_texts(5000), "a" * 20_000, "ab" * 5000 + "<|endoftext|>", *(r.text or "" for r in docs.select("text").collect())]
    for at in (1, 300):  # alone, and in batches
        for k in range(0, len(texts), at):
            for text, ids in zip(texts[k : k + at], own.packed(texts[k : k + at]), strict=True):
                ids = np.frombuffer(ids, "<u4").tolist()
                assert ids == library.encode(text, add_special_tokens=False).ids
                assert own.text(ids) == text


def test_any_ids_decode_as_in_the_library(library):
    own, rng = bpe.bpe(vocab.default_path(bpe.FILE)), random.Random(2)
    for _ in range(5000):
        ids = [rng.randrange(50_300) for _ in range(rng.randint(0, 9))]
        assert own.text(ids) == library.decode(ids, skip_special_tokens=False)


def test_merges_follow_rank_and_place():
    rng = random.Random(9)
    for _ in range(300):
        ranks, made = {}, []
        for k in range(12):
            ranks.setdefault(rng.randrange(4 + k) << 32 | rng.randrange(4 + k), len(made))
            made = made + [4 + len(made)] * (len(ranks) - len(made))
        symbols = [rng.randrange(4) for _ in range(rng.randint(0, 40))]
        want = list(symbols)
        while True:
            pairs = [(ranks[a << 32 | b], i) for i, (a, b) in enumerate(zip(want, want[1:], strict=False)) if a << 32 | b in ranks]
            if not pairs:
                break
            rank, i = min(pairs)
            want[i : i + 2] = [made[rank]]
        assert bpe.merged(symbols, ranks, made) == want
        if symbols and ranks:
            row = np.array([symbols + [-1] * (64 - len(symbols))], np.int64)
            keys = sorted(ranks)
            got = bpe.merged_many(np.repeat(row, 3, axis=0), np.full(3, len(symbols)), np.array(keys, np.int64), np.array([ranks[k] for k in keys], np.int64), np.array(made, np.int64))
            assert all(r[r >= 0].tolist() == want for r in got)


def test_odd_rows_are_coded_and_read_back(spark, odd, none):
    coded = bpe.decoded(bpe.encoded(odd)).collect()
    assert Counter((r.doc_id, r.text) for r in coded) == Counter((i, t or "") for i, t, *_ in ROWS)
    assert bpe.decoded(bpe.encoded(none)).count() == 0
    rows = spark.createDataFrame([([464, None, 50256, 10**6], "kept", 1), (None, None, 2), ([], "x", 3)], "ids array<int>, text string, batch int")
    got = {r.batch: (r.text, r.read) for r in bpe.decoded(rows, text="read").collect()}
    assert got == {1: ("kept", "The<|endoftext|>"), 2: (None, ""), 3: ("x", "")}


def test_pre_tokens_that_are_met_often_are_merged_once(library, monkeypatch):
    monkeypatch.setattr(bpe, "MEMO", 60)
    own, rng, learned = bpe.Bpe(vocab.default_path(bpe.FILE)), random.Random(4), Counter()
    learn = own.learn
    monkeypatch.setattr(own, "learn", lambda pieces: learned.update(pieces) or learn(pieces))
    for _ in range(200):
        text = "the same words and " + " ".join("".join(rng.choices("abcdefghij", k=9)) for _ in range(8))
        assert np.frombuffer(own.packed([text])[0], "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
        assert len(own.memo) <= 60
    assert learned.total() > 1000 and {p: learned[p] for p in ("the", " same", " words", " and")} == {"the": 1, " same": 1, " words": 1, " and": 1}
    assert len(own.last) <= 60


def test_rows_of_ids_decode_side_by_side(library):
    own, rng = bpe.bpe(vocab.default_path(bpe.FILE)), random.Random(6)
    whole = [library.encode(t, add_special_tokens=False).ids for t in odd_texts(200)]
    torn = [[rng.randrange(50_257) for _ in range(rng.randint(0, 9))] for _ in range(200)]  # bytes that are no UTF-8 beside others that are
    for rows in (whole, torn, [], [[]], [None, [], None]):
        want = [library.decode(r or [], skip_special_tokens=False) for r in rows]
        odd = [r and [10**6, None, -1, *r] for r in rows]  # ids that stand for nothing
        for kind in (pa.int32(), pa.int64()):
            assert own.texts(pa.array(rows, pa.list_(kind))).to_pylist() == own.texts(pa.array(odd, pa.list_(kind))).to_pylist() == want
            assert own.texts(pa.array(odd, pa.list_(kind)).slice(3, 50)).to_pylist() == want[3:53]


def test_other_files_are_refused_or_encoded_whole(tmp_path):
    with pytest.raises(ValueError, match="byte-level"):
        bpe.Bpe(vocab.default_path("word_bpe_49k.json"))
    with open(vocab.default_path(bpe.FILE), encoding="utf-8") as f:
        spec = json.load(f)
    spec["pre_tokenizer"]["add_prefix_space"] = True
    path = str(tmp_path / "prefixed.json")
    with open(path, "w", encoding="utf-8") as f:
        json.dump(spec, f)
    with pytest.raises(ValueError, match="byte-level"):
        bpe.Bpe(path)
    encoder = vocab.Encoder(path)
    assert vocab.known_splitter(path) is None and vocab.known_splitter(vocab.default_path("word_bpe_49k.json")) == "words"
    for text in odd_texts(300):
        assert np.frombuffer(encoder.packed(text), "<u4").tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids


def test_queries_give_their_columns(spark, sf):
    from tidewell.llm import queries

    by = defaultdict(list)
    for name in ("op11_source_divergence", "op12_importance_resampling", "op13_bpe_codec"):
        df = queries.QUERIES[name](spark, sf)
        by[name] = [f"{c} {t}" for c, t in df.dtypes]
        assert df.agg(F.count("*")).first()[0] > 0
    assert by["op11_source_divergence"] == ["lang string", "source string", "part string", "item string", "value bigint", "rank int"]
    assert by["op12_importance_resampling"] == [f"{c} bigint" for c in ("doc_id", "n_features", "weight", "score", "rank")]
    assert by["op13_bpe_codec"] == ["doc_id bigint", "n_tokens bigint", "ids_sha256 string", "decoded_sha256 string"]
