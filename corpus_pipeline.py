"""A training-data pipeline: documents by way of five of the operators to packed sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
read again as the next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewell.llm import langid, mixing, neardup, pack, secretscan
from tidewell.session import table, written


def known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the network can tell; the rest go: null, empty and letterless texts, and those
    that score so low that such predictions are wrong more often than right. Texts are read whole, repeated rows
    are judged each, an empty table stays empty, and other columns may have any names."""
    return langid.known_language(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least id, of each group of near duplicates; of rows that share an id one stays.
    Null and empty texts are duplicates of nothing; rows without an id all stay; texts are compared whole; an empty
    table stays empty, and other columns may have any names."""
    return neardup.keep_first(docs)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by a mark and n_chars following. Null and empty texts, and all texts without
    secrets, stay as they are; texts are searched whole; repeated rows and rows without an id are searched each; an
    empty table stays empty, and other columns may have any names."""
    return secretscan.redact(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, in shuffled shards. Null and empty texts have size 0 and are taken like
    others of their block; null is a source; repeated rows are taken each, in an order that ids and texts settle; an empty table stays empty,
    and other columns may have any names."""
    return mixing.mixed_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their sequence and place in it. A null or empty text is one piece with the closing id
    alone; long texts are cut without loss; repeated rows are packed each; an empty table gives no rows."""
    return pack.best_fit_packing(docs)


STAGES = [
    ("language_id", known_languages),
    ("near_dedup", near_dedup),
    ("secret_scan", without_secrets),
    ("source_mixing", mixed),
    ("best_fit_packing", packed),
]

#: SQL can't express the network of the first stage; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
