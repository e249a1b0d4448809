"""Review moves, compaction, path-addressed memories, links between memories and files, parser registry
(N1, N3, N8, N17, D5, D6, D12, D15, D18, D20, F2, F7, C15, C16, P6, P7)."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions import vectors
from tidewell.operators import memory as M
from tidewell.operators import search as S


def remember(table: DataFrame, log: DataFrame, rows: DataFrame, at: Column) -> tuple[DataFrame, DataFrame]:
    """Rows appended to the memories, and a created version with a content hash for each to the log."""
    made = rows.select(F.col("id").alias("memory_id"), F.lit("created").alias("op"), F.sha2("content", 256).alias("content_hash"), at.alias("at"))
    return table.unionByName(rows, allowMissingColumns=True), log.unionByName(made, allowMissingColumns=True)


def review(quarantine: DataFrame, durable: DataFrame, verdicts: DataFrame, at: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(quarantine, durable, outcomes): promoted rows move and are validated, rejected ones go; verdicts: id, verdict."""
    v = verdicts.select("id", "verdict")
    judged = quarantine.join(v, "id")
    moved = judged.where("verdict = 'promote'").drop("verdict").withColumn("validated", F.lit(True))
    outcomes = judged.select("id", "source", F.when(F.col("verdict") == "promote", "promoted").otherwise("rejected").alias("outcome"), at.alias("at"))
    return quarantine.join(v, "id", "left_anti"), durable.unionByName(moved, allowMissingColumns=True), outcomes


def compact(rows: DataFrame, clusters: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(merged, superseded): one memory a cluster, and its members with a pointer to it; clusters: cluster, id."""
    members = rows.join(clusters, "id")
    merged = M.merge_clusters(members)
    marked = members.select("id", F.concat(F.lit("merged:"), F.col("cluster").cast("string")).alias("superseded_by"))
    return merged, M.set_payload(rows, marked)


# --- N17: memories addressed by a path tag -----------------------------------------------------------


def path_tag(path: str) -> str:
    return "path:" + path.strip("/")


def view_path(rows: DataFrame, path: str) -> DataFrame:
    """Rows at or below a path; rows: id, content, tags."""
    tag = path_tag(path)
    return rows.where(F.exists("tags", lambda t: (t == tag) | F.startswith(t, F.lit(tag + "/"))))


def replace_text(rows: DataFrame, path: str, old: str, new: str) -> DataFrame:
    """The first occurrence of a text at a path gives way to another."""
    here = F.array_contains("tags", path_tag(path))
    at = F.locate(old, "content")
    changed = F.concat(F.substring(F.col("content"), F.lit(1), at - 1), F.lit(new), F.substring(F.col("content"), at + len(old), F.length("content")))
    return rows.withColumn("content", F.when(here & (at > 0), changed).otherwise(F.col("content")))


def insert_line(rows: DataFrame, path: str, after: int, line: str) -> DataFrame:
    lines = F.split("content", "\n")
    made = F.array_join(F.concat(F.slice(lines, 1, after), F.array(F.lit(line)), F.slice(lines, after + 1, F.greatest(F.size(lines), F.lit(1)))), "\n")
    return rows.withColumn("content", F.when(F.array_contains("tags", path_tag(path)), made).otherwise(F.col("content")))


def rename_path(rows: DataFrame, old: str, new: str) -> DataFrame:
    """A path and all below it."""
    a, b = path_tag(old), path_tag(new)
    tag = lambda t: F.when(t == a, F.lit(b)).when(F.startswith(t, F.lit(a + "/")), F.concat(F.lit(b), F.substring(t, F.lit(len(a) + 1), F.length(t)))).otherwise(t)
    return rows.withColumn("tags", F.transform("tags", tag))


def delete_path(rows: DataFrame, path: str) -> DataFrame:
    tag = path_tag(path)
    return rows.where(~F.exists("tags", lambda t: (t == tag) | F.startswith(t, F.lit(tag + "/"))))


# --- links and lookups ---------------------------------------------------------------------------------


def connections(hits: DataFrame, edges: DataFrame, files: int = 10, each: int = 5) -> DataFrame:
    """For the first files of the hits up to `each` neighbours; hits: file, rank; edges: src, dst."""
    top = hits.orderBy("rank", "file").limit(files).select(F.col("file").alias("src"))
    r = F.row_number().over(Window.partitionBy("src").orderBy("dst"))
    near = edges.select("src", "dst").distinct().join(F.broadcast(top), "src").withColumn("r", r).where(F.col("r") <= each)
    return near.groupBy(F.col("src").alias("file")).agg(F.array_sort(F.collect_list("dst")).alias("connected"))


def memory_links(files: DataFrame, edges: DataFrame, known: DataFrame, score: float = 0.5, k: int = 20) -> DataFrame:
    """Memories that refer to the first files and aren't known yet, with one score."""
    rows = edges.where("edge_type = 'memory_references'").join(files.limit(k).select(F.col("file").alias("to_file")), "to_file")
    return rows.select(F.col("from_id").alias("id")).distinct().join(known.select("id"), "id", "left_anti").withColumn("score", F.lit(score))


def similar_turns(turns: DataFrame, least: float = 0.86, longest: float = 4.0) -> DataFrame:
    """Pairs of turns of one session over a cosine, i < j, neither text many times longer than the other.

    turns: session, turn, vector, n_chars. A session bounds the pairs; the length ratio is tested before the vectors.
    """
    a = turns.select("session", F.col("turn").alias("a"), F.col("vector").alias("va"), F.col("n_chars").alias("na"))
    b = turns.select("session", F.col("turn").alias("b"), F.col("vector").alias("vb"), F.col("n_chars").alias("nb"))
    pairs = a.join(b, "session").where((F.col("a") < F.col("b")) & (F.greatest("na", "nb") <= longest * F.least("na", "nb")))
    return pairs.withColumn("score", vectors.cosine(F.col("va"), F.col("vb"))).where(F.col("score") >= least).select("session", "a", "b", "score")


def trigger_boost(score: Column, trigger: Column, query: list[float], weight: float = 0.3) -> Column:
    """a share of the cosine with a memory's trigger, where it has one of the query's size."""
    near = F.greatest(F.lit(0.0), vectors.cosine_to(trigger, query))
    return score + F.when(F.size(trigger) == len(query), weight * near).otherwise(0.0)


def multi_query(points: DataFrame, queries: list[list[float]], k: int = 10, **how) -> DataFrame:
    """one fused list for several wordings of a question."""
    return S.fuse([S.search(points, q, 2 * k, **how) for q in queries], k)


def find_symbol(symbols: DataFrame, name: str, query: list[float], kind: str | None = None, least: float = 0.5, k: int = 10) -> DataFrame:
    """Symbols of that very name first, then those near the query; symbols: id, name, kind, vector."""
    rows = symbols if kind is None else symbols.where(F.col("kind") == kind)
    scored = rows.withColumn("score", F.when(F.col("name") == name, 2.0).otherwise(vectors.cosine_to(F.col("vector"), query)))
    return scored.where(F.col("score") >= least).orderBy(F.desc("score"), "id").limit(k)


def relevant(qrels: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, text, expected): each query's positively judged ids."""
    rows = qrels.where("score > 0").groupBy("query_id").agg(F.array_sort(F.collect_set("corpus_id")).alias("expected"))
    return rows.join(queries, "query_id")


def event_summary(events: DataFrame, session: str, order: list[str], line: Column, last: int = 50) -> DataFrame:
    """Each session's last events as lines of text."""
    rows = M.tail(events.withColumn("__line", line), [session], order, last)
    return rows.groupBy(session).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, "__line"))), lambda x: x["__line"]), "\n").alias("summary"))


class Parsers:
    """Chunkers by path pattern; the first that fits a file parses it."""

    def __init__(self) -> None:
        self.known: list[tuple[str, Callable[[DataFrame], DataFrame]]] = []

    def register(self, pattern: str, parse: Callable[[DataFrame], DataFrame]) -> None:
        self.known.append((pattern, parse))

    def parse(self, files: DataFrame) -> DataFrame:
        """(path, content) of all chunks: one scan of the files for each parser, with its share of them."""
        parts, before = [], F.lit(False)
        for pattern, parse in self.known:
            fits = F.rlike("path", F.lit(pattern))
            parts.append(parse(files.where(fits & ~before)).select("path", "content"))
            before = before | fits
        return reduce(DataFrame.unionByName, parts)
