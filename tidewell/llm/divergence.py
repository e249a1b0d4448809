"""Operator 11, source divergence audit: inclusion-exclusion over the supports of term counts.

The divergence of two sources of a language is a sum over all terms that the language keeps, but most terms are absent
from most sources, and an absent term's smoothed share is one constant of its source. So the sum is
taken in parts: terms of one side alone are priced from that side's histogram of counts, against
the other's constant; terms of both sides, which were then priced twice, are put right by
joining the postings (term, source) of their term; and terms of neither side are a number times a
constant. Tasks count terms by (language, source) before anything is moved; counts move once.

Defined results: null text, lang and source are the empty text, language and source. A group without terms is
priced like others (all terms absent); a language that keeps no term gives its pairs the value 0 and no term rows. Rows that
repeat, or share an id, count each; ids are not read. Very long texts are counted whole. An empty table gives no rows.
Ties of value stand in the order of the item's UTF-8. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.session import stored, written

LEAST_DOCUMENTS, TOP = 10, 10
SCALE = 1_000_000_000
#: Terms that a task holds before it hands its counts on.
HELD = 400_000
#: Rows of about 100 bytes up to which groups are broadcast.
BROADCAST_ROWS = 50_000
#: Bytes of terms stay, A-Z as a-z; all others become spaces.
_TERMS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
COUNTS = "lang string, source string, term string, n long, docs long"


def side(df: DataFrame, rows: int) -> DataFrame:
    """A side of a join whose rows were counted: broadcast if few, else left to the planner."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def named(docs: DataFrame) -> list[Column]:
    return [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]


def term_counts(docs: DataFrame, held: int = HELD) -> DataFrame:
    """lang, source, term, n (occurrences) and docs (rows with the term), dealt by (lang, term)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict = defaultdict(lambda: (Counter(), Counter()))

        def rows() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, docs) in found.items():
                terms = pa.array(list(n), pa.binary()).cast(pa.string())
                same = lambda x: pa.array([x] * len(n), pa.string())  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([same(lang), same(source), terms, pa.array(n.values(), pa.int64()), pa.array([docs[t] for t in n], pa.int64())], ["lang", "source", "term", "n", "docs"])

        new = 0
        for batch in batches:
            for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                terms = text.as_py().translate(_TERMS).split()
                n, docs = found[lang, source]
                new -= len(n)
                n.update(terms)
                docs.update(set(terms))
                new += len(n)
                if new > held:
                    yield from rows()
                    found.clear()
                    new = 0
        yield from rows()

    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    parts = docs.select(*named(docs), text.alias("text")).mapInArrow(count, COUNTS)
    return parts.repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def kept_terms(docs: DataFrame, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """lang, source, term, n, of terms in at least ``least`` rows of their language; with total (n over the language) and head (a term's first source)."""
    term = Window.partitionBy("lang", "term")
    counted = term_counts(docs).withColumns({"in_docs": F.sum("docs").over(term), "total": F.sum("n").over(term), "head": F.min("source").over(term) == F.col("source")})
    return counted.where(F.col("in_docs") >= least).select("lang", "source", "term", "n", "total", "head")


def share(n: str, all_: str, kinds: str) -> Column:
    """Smoothed share of n counts of all_, over so many kinds of terms, in units of 1/SCALE; exact for counts of any size."""
    whole = lambda x: f"cast({x} as decimal(20,0))"
    return F.expr(f"if({kinds} > 0, 1 + {SCALE} * {whole(f'{n} + 2')} div {whole(f'greatest({all_} + 2 * {kinds}, 1)')}, 1)")


def price(p: str, q: str) -> str:
    """SQL of a term's part of the divergence of two shares: (p - q) ** 2 / (p + q), rounded down; shares are up to SCALE, so squares fit."""
    return f"(({p} - {q}) * ({p} - {q}) div ({p} + {q}))"


def groups_of(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """A row for each (lang, source) of docs: all (its counts), terms (kept terms that it has), kinds and lang_all (its language's), absent (share of a term that it lacks)."""
    own = kept.groupBy("lang", "source").agg(F.sum("n").alias("all"), F.count("*").alias("terms"))
    langs = kept.groupBy("lang").agg(F.sum("n").alias("lang_all"), F.count_if("head").alias("kinds"))
    groups = docs.select(*named(docs)).distinct().join(own, ["lang", "source"], "left").join(langs, "lang", "left")
    return groups.na.fill(0, ["all", "terms", "lang_all", "kinds"]).withColumn("absent", share("0", "`all`", "kinds"))


def pair_values(priced: DataFrame, groups: DataFrame, n_groups: int) -> DataFrame:
    """lang, low, high and value of every pair of a language's sources. priced: kept terms with p and absent of their group."""
    mine = groups.select("lang", F.col("source").alias("a"), F.col("absent").alias("za"), F.col("terms").alias("na"), "kinds")
    other = groups.select("lang", F.col("source").alias("b"), F.col("absent").alias("zb"), F.col("terms").alias("nb"))
    pairs, n = stored(mine.join(side(other, n_groups), "lang").where("a <> b"), "audit-pairs")  # the result has as many rows
    key = [F.col("lang"), F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high")]
    histogram = priced.groupBy("lang", F.col("source").alias("a"), "p").agg(F.count("*").alias("k"))
    one_side = histogram.join(side(pairs, n["rows"]), ["lang", "a"]).select(*key, F.expr(f"k * {price('p', 'zb')}").alias("value"))
    neither = pairs.where("a < b").select(*key, F.expr(f"(kinds - na - nb) * {price('za', 'zb')}").alias("value"))
    left = priced.select("lang", "term", F.col("source").alias("a"), F.col("p").alias("pa"), F.col("absent").alias("za"))
    right = priced.select("lang", "term", F.col("source").alias("b"), F.col("p").alias("pb"), F.col("absent").alias("zb"))
    corrected = f"{price('pa', 'pb')} - {price('pa', 'zb')} - {price('za', 'pb')} + {price('za', 'zb')}"
    both = left.join(right, ["lang", "term"]).where("a < b").select(*key, F.expr(corrected).alias("value"))
    return one_side.unionByName(neither).unionByName(both).groupBy("lang", "low", "high").agg(F.sum("value").alias("value"))


def source_divergence(docs: DataFrame, least: int = LEAST_DOCUMENTS, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value and rank: each source's divergence from the others of its language (``pair``),
    and the ``top`` kept terms of most value that it has more of than its language (``term``). docs: text, lang, source."""
    kept = written(kept_terms(docs, least), "audit-terms")
    groups, n = stored(groups_of(docs, kept), "audit-groups")
    known = side(groups, n["rows"])
    priced = kept.join(known, ["lang", "source"]).withColumns({"p": share("n", "`all`", "kinds"), "q": share("total", "lang_all", "kinds")})
    values = pair_values(priced, groups, n["rows"])
    turned = values.select("lang", F.explode(F.array(F.struct(F.col("low").alias("source"), F.col("high").alias("item")), F.struct(F.col("high").alias("source"), F.col("low").alias("item")))).alias("x"), "value")
    pairs = turned.select("lang", "x.source", F.lit("pair").alias("part"), "x.item", "value")
    terms = priced.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr(price("p", "q")).alias("value"))
    place = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")).alias("rank")
    return pairs.select("*", place).unionByName(terms.select("*", place).where(F.col("rank") <= top))
