"""Operator 12, target-distribution importance resampling: n-grams from suffix arrays of word ids.

In each task a block of texts becomes one array of word ids, with a 0 after each text. Its suffixes are sorted by
their first ``most`` words (prefix doubling), and the common prefixes of neighbours (LCP) say where suffixes that share n
words stand together: such a run is one repeated n-gram, which is hashed once, and its bucket goes
back to all its places. A row's buckets are stored; from them come the buckets' counts over all
texts, and then each row's weight.

A bucket's gain is the rounded log ratio of its smoothed shares in the target texts and in all texts; a row's
weight is the mean gain of its n-grams, rounded down; weights plus Gumbel noise from the ids' hashes are scores, and the rows
of highest score are drawn without return. Ranks need no row gathered: scores are whole thousandths of a logarithm, so
they are counted, the counts summed, and only rows of one score are ordered together. Only the
buckets' gains (``buckets`` numbers, whatever the data) go by way of the driver.

Defined results: a null or empty text, or one without words, has no n-gram and weight 0. Rows without an id draw the noise
of the empty id, and stand behind others of their score; rows that repeat, or share an id, are scored each, and
equal scores and ids stand in the order of n_features. Very long texts make a block of their own. An empty
table gives no rows; empty targets give every bucket t = 0. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.session import stored, written

BUCKETS, LEAST, MOST = 10_000, 1, 1
SEED, PERCENT, LEAST_WORDS = 2024, 10, 20
#: Bytes of text that are sorted together; bounds a task's memory.
BLOCK = 4_000_000
#: Scores are counted in cells of this width first.
CELL = 256
#: Rows of 16 bytes up to which a side is broadcast.
BROADCAST_ROWS = 200_000
#: Bytes of words stay, A-Z as a-z; all others become spaces.
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


class _Ids(dict):
    """A number from 1 for each word, in the order of coming."""

    def __missing__(self, word: bytes) -> int:
        self[word] = value = len(self) + 1
        return value


def word_ids(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """(sequence, n_words, words): word ids of all texts, 0 behind each text; words of each text; the words by id, from 1."""
    ids = _Ids()
    parts = []
    for t in texts:
        words = t.translate(_WORDS).split()
        parts += [np.fromiter(map(ids.__getitem__, words), np.int32, len(words)), np.zeros(1, np.int32)]
    n_words = np.array([len(p) for p in parts[::2]], np.int64)
    return np.concatenate(parts) if parts else np.zeros(0, np.int32), n_words, [b"", *ids]


def suffix_array(s: np.ndarray, depth: int) -> np.ndarray:
    """Places of s in the order of the words that follow from there, as far as depth words tell."""
    rank, known = s.astype(np.int64), 1
    while known < depth:
        beyond = np.zeros_like(rank)
        beyond[: max(0, len(s) - known)] = rank[known:] + 1
        _, rank = np.unique(rank * (rank.max(initial=0) + 2) + beyond, return_inverse=True)
        known *= 2
    return np.argsort(rank, kind="stable")


def ngram_buckets(texts: list[bytes], buckets: int = BUCKETS, least: int = LEAST, most: int = MOST) -> tuple[np.ndarray, list[np.ndarray]]:
    """(n_words, buckets of each text's n-grams, from least to most words, each length in order of place)."""
    s, n_words, words = word_ids(texts)
    ends = np.cumsum(n_words + 1) - 1
    left = np.repeat(ends, n_words + 1) - np.arange(len(s))  # words from here to the text's end
    order = suffix_array(s, most)
    common = np.zeros(len(s), np.int64)  # LCP of a suffix and the one before it, up to most
    alike = np.ones(max(0, len(s) - 1), bool)
    for k in range(most):
        inside = np.minimum(order + k, max(0, len(s) - 1))
        alike = alike & (s[inside[1:]] == s[inside[:-1]]) & (left[order[1:]] > k) & (left[order[:-1]] > k)
        common[1:] += alike
    at_place, found = np.zeros(len(s), np.int64), []
    for n in range(least, most + 1):
        enough = left[order] >= n
        places = order[enough]
        head = common[enough] < n
        first = places[head]
        if n == 1:
            hashed = [zlib.crc32(words[i]) % buckets for i in s[first].tolist()]
        else:
            hashed = [zlib.crc32(b" ".join([words[i] for i in gram])) % buckets for gram in s[first[:, None] + np.arange(n)].tolist()]
        at_place[places] = np.array(hashed, np.int64)[np.cumsum(head) - 1]
        found.append([at_place[e - w : e - w + max(0, w - n + 1)].copy() for e, w in zip(ends.tolist(), n_words.tolist(), strict=True)])
    return n_words, [np.concatenate(x) for x in zip(*found, strict=True)]


def _dtype(buckets: int) -> str:
    return "<u2" if buckets <= 1 << 16 else "<u4"


def features(docs: DataFrame, buckets: int = BUCKETS, least: int = LEAST, most: int = MOST, block: int = BLOCK) -> DataFrame:
    """doc_id, n_words, n_features and buckets (little-endian numbers) of every row of docs (doc_id, text)."""
    if not 1 <= least <= most or buckets < 1:
        raise ValueError("n-grams have 1 <= least <= most words and at least one bucket")

    def rows_of(ids: list, texts: list[bytes]) -> pa.RecordBatch:
        n_words, found = ngram_buckets(texts, buckets, least, most)
        columns = [pa.array(ids, pa.int64()), pa.array(n_words, pa.int64()), pa.array([len(f) for f in found], pa.int64()), pa.array([f.astype(_dtype(buckets)).tobytes() for f in found], pa.binary())]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_features", "buckets"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, held = [], [], 0
        for batch in batches:
            for i, t in zip(batch.column(0), batch.column(1), strict=True):
                text = t.as_py() or b""
                ids.append(i.as_py())
                texts.append(text)
                held += len(text)
                if held >= block:
                    yield rows_of(ids, texts)
                    ids, texts, held = [], [], 0
        if ids:
            yield rows_of(ids, texts)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").cast("binary")).mapInArrow(run, "doc_id long, n_words long, n_features long, buckets binary")


def bucket_counts(found: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """bucket and n, for buckets that occur; each task sends its sums only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(buckets, np.int64)
        for batch in batches:
            for row in batch.column(0):
                sums += np.bincount(np.frombuffer(row.as_buffer(), _dtype(buckets)), minlength=buckets)
        some = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(sums[some])], ["bucket", "n"])

    return found.select("buckets").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(s: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of each bucket's smoothed shares, rounded down; s and t: its counts in all texts and in the targets."""
    ratio = ((t + 1.0) * float(s.sum() + len(s))) / ((s + 1.0) * float(t.sum() + len(t)))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def gathered(counts: DataFrame, buckets: int) -> np.ndarray:
    """bucket_counts() as an array: a row a bucket at most."""
    out = np.zeros(buckets, np.int64)
    for r in counts.collect():
        out[r["bucket"]] = r["n"]
    return out


def weighted(found: DataFrame, gains: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features and weight (mean gain, rounded down; 0 without features) of every row of features()."""
    buckets = len(gains)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            means = [int(gains[np.frombuffer(row.as_buffer(), _dtype(buckets))].sum()) // (n or 1) for row, n in zip(batch.column(3), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(means, pa.int64())], ["doc_id", "n_words", "n_features", "weight"])

    return found.select("doc_id", "n_words", "n_features", "buckets").mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def noise(seed: int) -> Column:
    """Thousandths of Gumbel noise from the id's hash, rounded down."""
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    share = (F.conv(F.substring(hashed, 1, 8), 16, 10).cast("double") + 0.5) / 4294967296
    return F.floor(-1000 * F.log(-F.log(share))).cast("long")


def draw(scored: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """scored (doc_id, n_words, n_features, weight, score) with rank: from 1 for the drawn rows, null for others."""
    scored, seen = stored(scored, "resample-scores", candidates=F.count_if(F.col("n_words") >= least_words))
    wanted = percent * seen["candidates"] // 100
    counts = scored.where(F.col("n_words") >= least_words).groupBy("score").agg(F.count("*").alias("n"))
    counts, kinds = stored(counts.withColumn("cell", F.floor(F.col("score") / CELL)), "resample-counts")  # whole thousandths of logs: some 10**5 rows at most
    cells = counts.groupBy("cell").agg(F.sum("n").alias("m"))
    cells = cells.select("cell", (F.sum("m").over(Window.orderBy(F.desc("cell"))) - F.col("m")).alias("above"))  # a row for CELL thousandths
    inside = Window.partitionBy("cell").orderBy(F.desc("score"))
    before = counts.join(F.broadcast(cells), "cell").select(F.col("score").alias("s"), (F.col("above") + F.sum("n").over(inside) - F.col("n")).alias("before"))
    before = F.broadcast(before) if kinds["rows"] <= BROADCAST_ROWS else before
    placed = scored.join(before, (F.col("score") == F.col("s")) & (F.col("n_words") >= least_words), "left").drop("s")
    some = F.coalesce(F.col("before") < wanted, F.lit(False))
    rank = F.col("before") + F.row_number().over(Window.partitionBy("score").orderBy(F.col("doc_id").asc_nulls_last(), "n_features", "weight"))
    top = placed.where(some).withColumn("rank", F.when(rank <= wanted, rank).cast("long"))
    return top.unionByName(placed.where(~some).withColumn("rank", F.lit(None).cast("long"))).drop("before")


def resample(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, least: int = LEAST, most: int = MOST, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank of every row of docs; target: the texts to resemble (text)."""
    found = written(features(docs, buckets, least, most), "resample-features")
    wanted = features(target.select(F.lit(None).cast("long").alias("doc_id"), "text"), buckets, least, most)
    gains = bucket_gains(gathered(bucket_counts(found, buckets), buckets), gathered(bucket_counts(wanted, buckets), buckets))
    return draw(weighted(found, gains).withColumn("score", F.col("weight") + noise(seed)), percent, least_words)
