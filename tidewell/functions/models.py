"""Model hooks (P1-P7): what a model would do, with deterministic stand-ins that need none.

A caller passes another embedder or scorer; an embedder is a function from a pandas Series of texts to a
list of vectors, and runs in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.functions.text import keywords


def hashed_words(dim: int = 64) -> Callable[[pd.Series], list]:
    """P1's stand-in: words hashed with signs into a vector of length 1."""
    import zlib

    def run(texts: pd.Series) -> list:
        out = []
        for t in texts:
            v = np.zeros(dim, np.float32)
            for w in (t or "").lower().split():
                h = zlib.crc32(w.encode())
                v[h % dim] += 1 if h & (1 << 20) else -1
            n = float(np.linalg.norm(v))
            out.append((v / n if n else v).tolist())
        return out

    return run


def embed(df: DataFrame, text: str, out: str = "vector", embedder: Callable | None = None) -> DataFrame:
    """Vectors of texts; each distinct text is embedded once."""
    make = embedder or hashed_words()

    @F.pandas_udf("array<float>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(make(texts))

    distinct = df.select(F.col(text).alias("__t")).distinct().withColumn(out, run("__t"))
    return df.join(distinct, F.col(text).eqNullSafe(F.col("__t")), "left").drop("__t")


def sparse_counts(text: Column, dim: int = 1 << 18) -> Column:
    """A map from hashed terms to counts, without Python."""
    words = F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")
    hashed = F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(dim)).cast("int"))
    return F.map_from_entries(F.transform(F.array_distinct(hashed), lambda h: F.struct(h, F.size(hashed) - F.size(F.array_remove(hashed, h)))))


def sparse_terms(df: DataFrame, id_: str, text: str) -> DataFrame:
    """(id, term, n) of the words between white space, in lower case; sparse_counts() has them hashed."""
    words = F.explode(F.split(F.lower(F.col(text)), r"\s+"))
    return df.select(id_, words.alias("term")).where("term <> ''").groupBy(id_, "term").agg(F.count("*").alias("n"))


def merged_text(texts: Column) -> Column:
    """P4's stand-in for a merge: distinct trimmed texts, joined."""
    return F.array_join(F.array_distinct(F.transform(texts, lambda x: F.trim(x))), " | ")


def reformulated(question: Column, most: int = 8) -> Column:
    """P4's stand-in for a reformulation: the question's first keywords, each once."""
    return F.array_join(F.slice(F.array_distinct(keywords(question)), 1, most), " ")


#: Relation types that a classifier may answer.
RELATIONS = ("supersedes", "relates_to", "contradicts", "extends", "caused_by", "follow_up", "refines", "alternative_to")


def valid_relations(answer: Column, known: Column, least: float = 0.5) -> Column:
    """P5: relations of a parsed answer with a known id, a known type and enough confidence."""
    rows = F.from_json(answer, "array<struct<targetId:string,type:string,confidence:double,reason:string>>")
    return F.filter(rows, lambda r: F.array_contains(known, r["targetId"]) & r["type"].isin(*RELATIONS) & (r["confidence"] >= least))


#: Words of a task and the lookups that they call for, in order; the code is always searched.
ROUTES = (
    (r"fix|bug|debug|error|broken|issue|wrong|fail", ("memory", "graph")),
    (r"refactor|restructur|architect|design|pattern|approach", ("patterns", "adrs")),
    (r"add|implement|create|build|feature|new", ("patterns", "adrs")),
)
LATER_ROUTES = (
    (r"understand|explain|how does|what is|document", ("docs", "memory")),
    (r"review|check|validate|verify", ("patterns", "adrs")),
)


def routes(task: Column, files: Column | None = None, intent: Column | None = None) -> Column:
    """The lookups for a task by its words, its files (an array) and its intent, distinct and in order."""
    low = F.lower(task)
    intent = F.lit("") if intent is None else F.coalesce(intent, F.lit(""))
    when = lambda test, names: F.when(test, F.array(*[F.lit(n) for n in names])).otherwise(F.array().cast("array<string>"))
    parts = [F.array(F.lit("code_search"))] + [when(F.rlike(low, F.lit(words)), names) for words, names in ROUTES]
    if files is not None:
        parts.append(when(F.coalesce(F.size(files), F.lit(0)) > 0, ("graph",)))
    for words, names in LATER_ROUTES:
        parts.append(when(F.rlike(low, F.lit(words)) | ((intent == "review") & F.lit("review" in words)), names))
    parts.append(when(intent == "architecture", ("patterns", "adrs", "memory")))
    return F.array_distinct(F.concat(*parts))
