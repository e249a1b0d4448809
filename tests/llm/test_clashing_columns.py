"""Operators 8 and 10 among columns that are named like their own, and the pipeline as a whole on odd rows."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidewell.llm import tokenbin, tokencount, vocab
from tidewell.session import written

OWN = ("digest", "version", "n_tokens", "n_bytes", "ids", "sequence_id", "cu_seqlens", "starts", "doc_ids", "over_limit", "told", "sure", "found", "row", "shard", "copies", "slice", "rank", "block", "key", "piece")
ROWS = [(1, "the cat sat"), (2, None), (3, ""), (None, "no id"), (1, "the cat sat"), (4, "word " * 20_000)]


@pytest.fixture(scope="module")
def odd(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string")
    return df.select("*", *[F.lit("x").alias(c) for c in OWN]).repartition(3)


def test_token_counts(spark, odd):
    encoder = vocab.encoder(vocab.default_path("byte_bpe_50k.json"))
    got = Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in tokencount.token_counts(odd, tokencount.fresh_cache(spark)).collect())
    assert got == Counter((i, len((t or "").encode()), encoder.count(t or "")) for i, t in ROWS)
    assert tokencount.token_counts(odd.limit(0), tokencount.fresh_cache(spark)).count() == 0


def test_token_rows(odd):
    encoder = vocab.encoder(vocab.default_path("byte_bpe_50k.json"))
    n = sum(r.n_tokens for r in tokenbin.token_rows(odd).collect())
    assert n == sum(encoder.count(t or "") + 1 for _, t in ROWS)


def test_pipeline_on_odd_rows(spark, sf):
    """All stages one after another: documents that no stage rejects reach the sequences, whatever stands beside them."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    odd = spark.createDataFrame([(10**6, None, "en", None), (10**6 + 1, "", None, "src1"), (None, "12 !! 34", "fr", "src2"), (10**6 + 2, "the house and the garden of the people were in the town " * 400, "en", None)], "doc_id long, text string, lang string, source string")
    rows = docs.unionByName(odd.withColumn("n_chars", F.length("text").cast("long"))).withColumns({c: F.lit("x") for c in OWN})
    for name, stage in corpus_pipeline.STAGES:
        out = written(stage(spark, rows, sf), f"odd-{name}")
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == rows.columns
            rows = out
    ids = {r.doc_id for r in rows.select("doc_id").collect()}
    assert not ids & {10**6, 10**6 + 1, None}
    pieces = out.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("upto")).collect()
    assert pieces and all(r.n == r.upto <= 2048 for r in pieces)
    assert {r.doc_id for r in out.select("doc_id").collect()} == ids
