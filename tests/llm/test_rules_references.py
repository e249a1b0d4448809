"""Operator 7's common words and references: of documents, not of words; verdicts that repeat."""

import random

import pytest
from pyspark.sql import functions as F

from tidewell.llm import rules
from tidewell.session import table


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text", "lang")


def verdicts(df):
    return {r.doc_id: r.kept for r in rules.quality_rules(df).select("doc_id", "kept").collect()}


def test_one_long_text_moves_no_verdict_but_its_own(spark, docs):
    rng = random.Random(4)
    made_up = ["".join(rng.choices("bcdfglmnprst", k=6)) for _ in range(3)]
    text = " ".join(rng.choice(made_up) if rng.random() < 0.3 else "".join(rng.choices("abcdefghij", k=7)) for _ in range(60_000))
    before, after = verdicts(docs), verdicts(docs.unionByName(spark.createDataFrame([(10**9, text, "en")], docs.schema)))
    assert not after.pop(10**9) and before == after


def test_verdicts_repeat_in_other_partitions_and_among_other_columns(docs):
    dealt = docs.repartition(7, F.rand(3))
    for c in ("hashes", "common", "bits", "hf", "words", "n", "by_word", "kind", "tick", "band"):
        dealt = dealt.withColumn(c, F.lit("x"))
    assert verdicts(docs) == verdicts(dealt)


def test_words_are_runs_of_letters(spark):
    texts = ["The cat, (the) DOG; 12 -- don't... 'the'", None, "", "|", "a|b The.", "l'été ÉTÉ"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    got = [r[0] for r in df.select(rules.folded_words(rules.text_of(df))).collect()]
    assert got == [["the", "cat", "the", "dog", "don", "t", "the"], [], [], [], ["a", "b", "the"], ["l", "été", "été"]]
    top = rules.common_words(df.withColumn("lang", F.lit("en"))).first()
    assert top.words == sorted(["the", "cat", "dog", "don", "t", "a", "b", "l", "été"]) and rules.common_words(df.limit(0).withColumn("lang", F.lit("en"))).count() == 0
