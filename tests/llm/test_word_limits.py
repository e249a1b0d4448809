"""Operator 7's word limit comes from the corpus and can be reached."""

import pytest
from pyspark.sql import functions as F

from tidewell.llm import rules
from tidewell.session import table


@pytest.fixture(scope="module")
def docs_with_lists(spark):
    """English documents, and some of them again with their common words taken out."""
    docs = table(spark, "/root/testdata/sf0.01", "documents").where("lang = 'en'").select("doc_id", "text", "lang")
    words = docs.select(F.explode(F.split("text", rules.SPACE)).alias("w")).where("w rlike '^[A-Za-z]+$'").groupBy("w").count().orderBy(F.desc("count"), "w").limit(2 * rules.COMMON)
    common = [r.w for r in words.collect()]  # more than the operator's, so that no change of rank leaves one in
    assert {"the", "and", "of"} < set(common)
    bare = docs.where("doc_id % 20 = 0").select((F.col("doc_id") + 10**6).alias("doc_id"), F.regexp_replace("text", rf"(?i)(?<![^\s])({'|'.join(common)})(?![^\s])", F.concat(F.lit("rhen"), "doc_id")).alias("text"), "lang")
    return docs.unionByName(bare)


def test_text_without_common_words_goes(spark, docs_with_lists):
    got = rules.quality_rules(docs_with_lists).where("not base_failed").toPandas()
    lists = got[got.doc_id >= 10**6]
    assert len(lists) > 10 and not lists.kept.any()
    assert lists.class_distance.lt(rules.MOST_CLASSES).mean() > 0.9  # their characters are those of prose
    assert got.kept[got.doc_id < 10**6].mean() > 0.85
