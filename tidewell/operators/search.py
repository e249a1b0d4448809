"""Vector, sparse, keyword and hybrid search."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions import vectors
from tidewell.session import stored, written

#: Queries of one block of a batch search; their vectors are sent to every task.
QUERY_BLOCK = 8192


def must(*parts: Column | None) -> Column | None:
    """All of the parts; parts that ask nothing (None) are left out."""
    given = [p for p in parts if p is not None]
    return reduce(lambda a, b: a & b, given) if given else None


def should(*parts: Column | None) -> Column | None:
    """Any of the parts."""
    given = [p for p in parts if p is not None]
    return reduce(lambda a, b: a | b, given) if given else None


def must_not(*parts: Column | None) -> Column | None:
    """None of the parts; a part that is null of a row does not hold for it."""
    any_ = should(*parts)
    return None if any_ is None else ~F.coalesce(any_, F.lit(False))


def build_filter(**fields: str | list | None) -> Column | None:
    """All given fields equal (or in a list); None where nothing is asked."""
    return must(*[F.col(k).isin(v) if isinstance(v, list) else F.col(k) == v for k, v in fields.items() if v is not None])


def in_project(df: DataFrame, project: str, column: str = "project") -> DataFrame:
    """The rows of one project; names that begin alike are other projects."""
    return df.where(F.col(column) == project)


def sure_enough(df: DataFrame, least: float, column: str = "confidence") -> DataFrame:
    """Rows of at least that confidence; a row without one counts as sure."""
    return df.where(F.coalesce(F.col(column), F.lit(1.0)) >= least)


def faults(rules: dict[str, tuple[Column, Column]]) -> Column:
    """An array of the names of the rules that a row breaks; a rule is (whether it is asked of the row, whether it holds).

    A value that is null breaks what is asked of it.
    """
    return F.array_compact(F.array(*[F.when(asked & ~F.coalesce(holds, F.lit(False)), F.lit(name)) for name, (asked, holds) in rules.items()]))


def search(points: DataFrame, vector: list[float], k: int = 10, where: Column | None = None, least: float | None = None, id_: str = "id", vec: str = "vector") -> DataFrame:
    """The k rows of largest cosine, ties by id; filters and the threshold go before the top-k."""
    rows = points if where is None else points.where(where)
    scored = rows.withColumn("score", vectors.cosine_to(F.col(vec), vector))
    if least is not None:
        scored = scored.where(F.col("score") >= least)
    return scored.orderBy(F.desc("score"), id_).limit(k)


def batch_search(points: DataFrame, queries: DataFrame, k: int = 10, least: float = -1.0, id_: str = "id", vec: str = "vector", keep_self: bool = False, same: str | None = None, block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, id, score, rank): the k nearest points of every query; with same, of those of its
    value in that column (a query without one searches all).

    Queries go in blocks of about ``block``, whatever their number: a block is what the driver and a task hold at a time. Its
    matrix goes to every task and meets the points in parts; a task keeps k rows a query, so what is
    shuffled grows with tasks and queries and not with their product with points.
    """
    blocks = max(1, -(-queries.count() // block))
    if blocks == 1:
        return _block_search(points, queries, k, least, id_, vec, keep_self, same)
    part = F.pmod(F.xxhash64(id_), F.lit(blocks))
    return reduce(DataFrame.unionByName, [written(_block_search(points, queries.where(part == i), k, least, id_, vec, keep_self, same), "nearest") for i in range(blocks)])


def _block_search(points: DataFrame, queries: DataFrame, k: int, least: float, id_: str, vec: str, keep_self: bool, same: str | None) -> DataFrame:
    kind = F.col(same).cast("string") if same else F.lit(None).cast("string")
    rows = queries.select(F.col(id_), F.col(vec), kind).orderBy(id_).collect()
    schema = "query_id long, id long, score double"
    if not rows:
        return points.sparkSession.createDataFrame([], schema + ", rank int")
    ids, q = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.float64)
    q /= np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300)
    codes = {x: i for i, x in enumerate(sorted({r[2] for r in rows if r[2] is not None}))}
    asked = np.array([codes.get(r[2], -1) for r in rows])

    def best(query: np.ndarray, point: np.ndarray, score: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The first k of each query by score, then id."""
        order = np.lexsort((point, -score, query))
        query, point, score = query[order], point[order], score[order]
        first = np.searchsorted(query, query, side="left")
        top = np.arange(len(query)) - first < k
        return query[top], point[top], score[top]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        least_of = np.full(len(ids), least)  # a score under it is not among a query's first k
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                p = part.column(0).to_numpy()
                x = part.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(p), -1)
                x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
                own = np.array([codes.get(c, -1) for c in part.column(2).to_pylist()]) if codes else None
                found = [held]
                for low in range(0, len(ids), 1024):
                    rows_ = slice(low, low + 1024)
                    s = q[rows_] @ x.T
                    if not keep_self:
                        s[ids[rows_, None] == p[None, :]] = -np.inf
                    if codes:
                        s[(asked[rows_, None] >= 0) & (asked[rows_, None] != own[None, :])] = -np.inf
                    bound = least_of[rows_]
                    if s.shape[1] > k:
                        bound = np.maximum(bound, np.partition(s, -k, axis=1)[:, -k])
                    i, j = np.nonzero((s >= bound[:, None]) & np.isfinite(s))
                    found.append((i + low, p[j], s[i, j]))
                held = best(*(np.concatenate(c) for c in zip(*found, strict=True)))
                query, n = np.unique(held[0], return_counts=True)
                full = query[n == k]
                least_of[full] = held[2][np.searchsorted(held[0], full, side="right") - 1]
        yield pa.RecordBatch.from_arrays([pa.array(ids[held[0]]), pa.array(held[1]), pa.array(held[2])], ["query_id", "id", "score"])

    near = points.select(F.col(id_).alias("id"), F.col(vec), kind).mapInArrow(run, schema)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k)


def nearest_of_all(points: DataFrame, k: int = 10, least: float = -1.0, id_: str = "id", vec: str = "vector", same: str | None = None, block: int = QUERY_BLOCK) -> DataFrame:
    """batch_search() with every point as a query, stored."""
    return written(batch_search(points, points, k, least, id_, vec, same=same, block=block), "nearest-of-all")


def search_groups(scored: DataFrame, group: str, groups: int = 5, size: int = 3, id_: str = "id") -> DataFrame:
    """The best groups by their best score, each with its best rows."""
    inside = Window.partitionBy(group).orderBy(F.desc("score"), id_)
    rows = scored.withColumn("in_group", F.row_number().over(inside)).where(F.col("in_group") <= size)
    best = rows.where("in_group = 1").orderBy(F.desc("score"), id_).limit(groups).select(group)
    return rows.join(F.broadcast(best), group)  # `groups` rows


def group_results(hits: DataFrame, group: str, groups: int = 5, size: int = 3, id_: str = "id") -> DataFrame:
    """C4: groups made from the first groups*size hits; rows without a group are 'unknown'."""
    top = hits.orderBy(F.desc("score"), id_).limit(groups * size)
    return search_groups(top.withColumn(group, F.coalesce(F.nullif(F.col(group).cast("string"), F.lit("")), F.lit("unknown"))), group, groups, size, id_)


def recommend(points: DataFrame, positive: list, negative: list, k: int = 10, where: Column | None = None, id_: str = "id", vec: str = "vector") -> DataFrame:
    """Near the mean of the positives, moved away from the mean of the negatives; seeds are left out."""
    rows = points.where(F.col(id_).isin(positive + negative)).select(id_, vec).collect()
    of = {r[0]: np.array(r[1], float) for r in rows}
    centre = np.mean([of[i] for i in positive if i in of], axis=0)
    if negative:
        centre = centre + centre - np.mean([of[i] for i in negative if i in of], axis=0)
    rest = ~F.col(id_).isin(positive + negative)
    return search(points, list(centre), k, rest if where is None else rest & where, None, id_, vec)


def sparse_search(postings: DataFrame, query: dict[str, float], k: int = 10) -> DataFrame:
    """(id, score) by the inner product over shared terms; postings: id, term, weight."""
    weights = F.create_map(*[F.lit(x) for t, w in query.items() for x in (t, float(w))])
    hits = postings.where(F.col("term").isin(list(query)))
    return hits.groupBy("id").agg(F.sum(F.col("weight") * weights[F.col("term")]).alias("score")).orderBy(F.desc("score"), "id").limit(k)


def term_counts(docs: DataFrame, words: Column, id_: str = "id") -> DataFrame:
    """(id, term, tf) of an array of words."""
    return docs.select(F.col(id_).alias("id"), F.explode(words).alias("term")).groupBy("id", "term").agg(F.count("*").alias("tf"))


def bm25(docs: DataFrame, text: Column, query: list[str], k: int = 10, id_: str = "id", k1: float = 1.2, b: float = 0.75, least: int = 3) -> DataFrame:
    """BM25 of a query's words; words are runs of at least so many letters, digits and underscores, in lower case.

    One pass over the texts stores each one's length and the query words' counts, and sums them up.
    """
    query, low = sorted({q.lower() for q in query}), F.lower(F.coalesce(text, F.lit("")))
    counts = [F.regexp_count(low, F.lit(rf"(?<![a-z0-9_A-Z]){re.escape(t)}(?![a-z0-9_A-Z])")).alias(f"tf{i}") for i, t in enumerate(query)]
    rows = docs.select(F.col(id_).alias("id"), F.regexp_count(low, F.lit(f"[A-Za-z0-9_]{{{least},}}")).alias("n"), *counts)
    rows, seen = stored(rows, "bm25", mean=F.avg("n"), **{f"df{i}": F.count_if(F.col(f"tf{i}") > 0) for i in range(len(query))})
    score, any_ = F.lit(0.0), F.lit(False)
    for i in range(len(query)):
        df, tf = seen[f"df{i}"], F.col(f"tf{i}")
        idf = float(np.log(1 + (seen["rows"] - df + 0.5) / (df + 0.5)))
        score = score + F.lit(idf) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("n") / F.lit(seen["mean"] or 1.0)))
        any_ = any_ | (tf > 0)
    return rows.where(any_).select("id", score.alias("score")).orderBy(F.desc("score"), "id").limit(k)


def keyword_search(docs: DataFrame, text: Column, words: list[str], k: int = 10, id_: str = "id") -> DataFrame:
    """The share of the words that a text contains, over all rows."""
    low = F.lower(text)
    hits = reduce(lambda a, b: a + b, [F.contains(low, F.lit(w.lower())).cast("int") for w in words])
    return docs.withColumn("score", hits / len(words)).where(F.col("score") > 0).orderBy(F.desc("score"), id_).limit(k)


def similar_queries(history: DataFrame, vector: list[float], k: int = 5, least: float = 0.8) -> DataFrame:
    """Past questions near a new one that had results, each wording once, as it was asked last; history: id, query, vector, n_results, at."""
    asked = history.where((F.col("n_results") > 0) & (F.trim("query") != ""))
    last = asked.groupBy(F.lower(F.trim("query")).alias("wording")).agg(F.max_by(F.struct("id", "query", "vector", "n_results"), F.struct("at", "id")).alias("q"))
    return search(last.select("q.*"), vector, k, None, least).drop("vector")


# --- fusion ---------------------------------------------------------------------------------------


def fuse(lists: list[DataFrame], k: int = 10, constant: int = 60, id_: str = "id") -> DataFrame:
    """F1: reciprocal ranks 1/(constant + rank) summed over ranked lists (id, score); each list is a top-k already."""
    ranked = [d.select(F.col(id_).alias("id"), F.row_number().over(Window.orderBy(F.desc("score"), id_)).alias("rank")) for d in lists]
    every = reduce(DataFrame.unionByName, ranked)
    return every.groupBy("id").agg(F.sum(1.0 / (constant + F.col("rank"))).alias("score")).orderBy(F.desc("score"), "id").limit(k)


def merge_semantic_keyword(semantic: DataFrame, keyword: DataFrame, w: float = 0.7) -> DataFrame:
    """Full outer by id: the weighted sum of both scores; a row that only the keywords found has half its score for the semantic one."""
    s, q = semantic.select("id", F.col("score").alias("s")), keyword.select("id", F.col("score").alias("q"))
    both = s.join(q, "id", "full_outer")
    score = F.coalesce(F.col("s"), F.col("q") * 0.5) * w + F.coalesce("q", F.lit(0.0)) * (1 - w)
    return both.select("id", score.alias("score"))


def best_of(rows: DataFrame, key: Column, id_: str = "id") -> DataFrame:
    """the best row of each key; rows whose key is null all stay."""
    rank = F.row_number().over(Window.partitionBy(F.coalesce(key.cast("string"), F.concat(F.lit("\0"), F.col(id_).cast("string")))).orderBy(F.desc("score"), id_))
    return rows.withColumn("__rank", rank).where("__rank = 1").drop("__rank")


def token_overlap(query: str):
    """P3's stand-in: a scorer of texts, the Jaccard index of word sets, as JVM expressions."""
    words = F.array(*[F.lit(w) for w in sorted(set(query.lower().split()))])

    def score(text: Column) -> Column:
        own = F.array_distinct(F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != ""))
        return F.size(F.array_intersect(own, words)) / F.greatest(F.size(F.array_union(own, words)), F.lit(1))

    return score


def rerank(hits: DataFrame, text: Column, scorer, k: int, blend: float = 0.6, cut: int = 800, id_: str = "id") -> DataFrame:
    """blend of a scorer on the first characters of each hit and its score; under three hits pass through."""
    n = F.count("*").over(Window.partitionBy())  # hits are a top-k
    new = F.when(n < 3, F.col("score")).otherwise(scorer(F.substring(text, 1, cut)) * blend + F.col("score") * (1 - blend))
    return hits.withColumn("score", new).orderBy(F.desc("score"), id_).limit(k)


def near_each(points: DataFrame, seeds: list, least: float = 0.8, k: int = 10, id_: str = "id", vec: str = "vector") -> DataFrame:
    """Neighbours of each seed over a threshold."""
    return batch_search(points, points.where(F.col(id_).isin(seeds)), k, least, id_, vec)


def project_2d(points: DataFrame, id_: str = "id", vec: str = "vector") -> DataFrame:
    """C17: the two main components; each component's sign makes its largest weight positive."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = points.select(F.col(id_), array_to_vector(F.transform(vec, lambda x: x.cast("double"))).alias("v"))
    model = PCA(k=2, inputCol="v", outputCol="p").fit(rows)
    pc = model.pc.toArray()
    signs = [1.0 if pc[abs(pc[:, j]).argmax(), j] > 0 else -1.0 for j in range(2)]
    out = vector_to_array("p")
    return model.transform(rows).select(id_, (out[0] * signs[0]).alias("x"), (out[1] * signs[1]).alias("y"))


def quantized(points: DataFrame, vec: str = "vector", quantile: float = 0.99) -> DataFrame:
    """Vectors as bytes, clipped at a quantile of absolute values, with the scale."""
    top = points.select(F.explode(F.transform(vec, lambda x: F.abs(x.cast("double")))).alias("x")).agg(F.percentile_approx("x", quantile, 10_000)).first()[0] or 1.0
    scale = top / 127
    return points.withColumn("bytes", F.transform(vec, lambda x: F.round(F.greatest(F.lit(-127.0), F.least(F.lit(127.0), x.cast("double") / scale))).cast("tinyint"))).withColumn("scale", F.lit(scale))
