"""Operator 8, token counts: a cache of counts by content and tokenizer-version digests.

Each text is normalised (null becomes empty; nothing else, as counts depend on every character)
and digested with sha256. Digests are joined with the stored (digest, version, n_tokens) rows; each
distinct digest that misses is encoded once, and its count is appended to the cache.

Defined results: null text counts as the empty text (0 bytes, 0 tokens). Equal texts share one
cache row. Rows that repeat, or share an id, each keep their row. A cache folder that does not
exist yet is an empty cache. Very long texts are encoded whole; an empty table gives no rows and adds
nothing. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm import vocab
from tidewell.session import shared_dir, written

CACHE = "digest binary, version string, n_tokens long"
LIMIT = 512


def digests(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long"), F.octet_length(text).cast("long").alias("n_bytes"), F.unhex(F.sha2(text, 256)).alias("digest"), text.alias("text"))


def read_cache(spark: SparkSession, path: str, version: str) -> DataFrame:
    """The stored counts of one tokenizer version; none if nothing was stored yet."""
    try:
        stored = spark.read.schema(CACHE).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], CACHE)
    return stored.where(F.col("version") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def token_counts(docs: DataFrame, cache: str, tokenizer: str | None = None, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every row of docs; misses are appended to cache.

    The distinct misses are found by an aggregation on the digest, which first drops copies
    inside each task, so a text that fills a third of the table moves once for each task.
    """
    spark, path = docs.sparkSession, tokenizer or vocab.default_path("byte_bpe_50k.json")
    version, keyed = vocab.file_digest(path), digests(docs)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = vocab.encoder(path).count
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                n = [count(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.binary()), pa.array([version] * len(n)), pa.array(n, pa.int64())], ["digest", "version", "n_tokens"])

    misses = keyed.select("digest", "text").join(read_cache(spark, cache, version), "digest", "left_anti").dropDuplicates(["digest"])
    misses.mapInArrow(encode, CACHE).write.mode("append").parquet(cache)
    known = written(read_cache(spark, cache, version), "token-counts-known")  # a plain scan, so that Spark can split a digest's many rows in the join
    counted = keyed.drop("text").join(known, "digest", "left")
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def fresh_cache(spark: SparkSession) -> str:
    """A cache folder of its own below the shared folder."""
    return f"{shared_dir(spark)}/token-counts-{uuid.uuid4().hex}"
