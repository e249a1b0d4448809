"""Graph traversal over edge tables.

Edges are rows of (src, dst) and whatever else; traversals take the columns' names. Each hop is a
join of the frontier with the edges; the frontier is written between hops, so plans stay short and
a lost executor costs one hop.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.session import written

#: Edge types by how much activation they carry; others 0.3.
EDGE_WEIGHTS = {"supersedes": 0.9, "caused_by": 0.8, "follow_up": 0.7, "refines": 0.7, "extends": 0.7, "contradicts": 0.6, "alternative_to": 0.5, "relates_to": 0.3}
#: Confidence of an edge's origin, highest last; others are below all.
RANKS = ("heuristic", "tree-sitter", "scip", "lsp")


def both_ways(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    a = edges.select(F.col(src).alias("src"), F.col(dst).alias("dst"))
    return a.unionByName(a.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def expand(edges: DataFrame, seeds: DataFrame, hops: int, directed: bool = False) -> DataFrame:
    """(node, hop) of all nodes within hops of the seeds, seeds at hop 0; edges: src, dst."""
    links = written(edges.select("src", "dst").distinct() if directed else both_ways(edges), "links")
    seen = written(seeds.select("node").distinct().withColumn("hop", F.lit(0)), "expand")
    for hop in range(1, hops + 1):
        new = seen.where(F.col("hop") == hop - 1).join(links, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct()
        new = written(new.join(seen.select("node"), "node", "left_anti").withColumn("hop", F.lit(hop)), "expand")
        if not new.take(1):
            break
        seen = seen.unionByName(new)
    return seen


def blast_radius(edges: DataFrame, start: DataFrame, depth: int = 3) -> DataFrame:
    """One row: files that depend on the start, levels tried, edges touched (each time they are)."""
    edges = written(edges.select("src", "dst"), "links")
    seen = written(start.select("node").distinct(), "blast")
    frontier, files, touched, levels = seen, 0, 0, 0
    for _ in range(depth):
        levels += 1
        hit = edges.join(frontier, F.col("dst") == F.col("node")).select("src")
        n = hit.groupBy("src").agg(F.count("*").alias("n"))
        n = written(n, "blast")
        touched += n.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        frontier = written(n.select(F.col("src").alias("node")).join(seen, "node", "left_anti"), "blast")
        new = frontier.count()
        files += new
        if not new:
            break
        seen = seen.unionByName(frontier)
    return edges.sparkSession.createDataFrame([(files, levels, touched)], "files long, depth int, edge_count long")


def weight_of(kind: Column) -> Column:
    table = F.create_map(*[F.lit(x) for k, v in EDGE_WEIGHTS.items() for x in (k, v)])
    return F.coalesce(F.try_element_at(table, kind), F.lit(0.3))


def activate(edges: DataFrame, seeds: DataFrame, hops: int = 2, decay: float = 0.7, least: float = 0.3) -> DataFrame:
    """(node, activation, hop): the strongest activation that walks of at most hops bring.

    seeds: node, activation. An edge passes on activation * weight * decay; what falls under least
    is dropped. The hop is that of the strongest walk, the shortest of equal ones.
    """
    weighted = written(edges.groupBy("src", "dst").agg(F.max(weight_of(F.col("type"))).alias("w")), "links")
    best = written(seeds.groupBy("node").agg(F.max("activation").alias("activation")).withColumn("hop", F.lit(0)), "active")
    frontier = best
    for hop in range(1, hops + 1):
        reached = frontier.join(weighted, F.col("node") == F.col("src")).groupBy("dst").agg(F.max(F.col("activation") * F.col("w") * decay).alias("new")).where(F.col("new") >= least)
        merged = written(best.join(reached, F.col("node") == F.col("dst"), "full_outer").select(F.coalesce("node", "dst").alias("node"), "activation", "hop", "new"), "active")
        better = F.col("new") > F.coalesce("activation", F.lit(0.0))
        best = merged.select("node", F.when(better, F.col("new")).otherwise(F.col("activation")).alias("activation"), F.when(better, F.lit(hop)).otherwise(F.col("hop")).alias("hop"))
        frontier = merged.where(better).select("node", F.col("new").alias("activation"))
    return best


def merge_activated(hits: DataFrame, active: DataFrame, k: int) -> DataFrame:
    """Hits and the activated nodes beyond them, again the best k; hits: id, score."""
    extra = active.where("hop > 0").select(F.col("node").alias("id"), F.col("activation").alias("score")).join(hits.select("id"), "id", "left_anti")
    return hits.select("id", "score").unionByName(extra).orderBy(F.desc("score"), "id").limit(k)


def subgraph(edges: DataFrame, start, kinds: list[str] | None = None) -> DataFrame:
    """The edges that touch a node, in a column that says which end it is."""
    rows = edges if kinds is None else edges.where(F.col("type").isin(kinds))
    return rows.where((F.col("src") == start) | (F.col("dst") == start)).withColumn("side", F.when(F.col("src") == start, "out").otherwise("in"))


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the least node that each reaches over edges in both directions."""
    links = written(both_ways(edges), "links")
    labels = written(links.groupBy(F.col("src").alias("node")).agg(F.least(F.min("dst"), F.col("src")).alias("component")), "labels")
    while True:
        far = links.join(labels.withColumnsRenamed({"node": "dst", "component": "far"}), "dst").groupBy("src").agg(F.min("far").alias("far"))
        spread = labels.join(far, F.col("node") == F.col("src"), "left").select("node", "component", F.least("component", "far").alias("next"))
        jump = spread.join(labels.select(F.col("node").alias("at"), F.col("component").alias("to")), F.col("next") == F.col("at"), "left")
        after = written(jump.select("node", F.least("next", "to").alias("component"), (F.least("next", "to") < F.col("component")).alias("changed")), "labels")
        labels = after.select("node", "component")
        if not after.where("changed").take(1):
            return labels


def latest_of_cluster(rows: DataFrame, edges: DataFrame, id_: str, order: str) -> DataFrame:
    """Of each cluster of linked rows the latest, and of the unlinked each; with the cluster's size."""
    of = components(edges)
    placed = rows.join(of, rows[id_] == of["node"], "left").withColumn("cluster", F.coalesce("component", F.col(id_)))
    return placed.groupBy("cluster").agg(F.max_by(id_, F.struct(order, id_)).alias("latest"), F.count("*").alias("n"))


def greedy_clusters(pairs: DataFrame, order: DataFrame, group: str) -> DataFrame:
    """(seed, member): in order, each unclaimed row claims its unclaimed neighbours.

    pairs: group, a, b (both ways); order: group, id, at. Rows without pairs need no state, so a
    group's task holds only its pairs: the order-bound part runs in one pass for each group.
    """

    def claim(pdf):
        import pandas as pd

        near: dict = {}
        at: dict = {}
        for a, b, t in zip(pdf["a"], pdf["b"], pdf["at"], strict=True):
            near.setdefault(a, []).append(b)
            at[a] = t
        taken, out = set(), []
        for a in sorted(near, key=lambda x: (at[x], x)):
            if a in taken:
                continue
            taken.add(a)
            members = [b for b in sorted(set(near[a])) if b not in taken]
            if members:
                taken.update(members)
                out += [(a, b) for b in members]
        return pd.DataFrame(out, columns=["seed", "member"])

    placed = pairs.join(order.select(F.col("id").alias("a"), "at"), "a")
    return placed.groupBy(group).applyInPandas(claim, "seed long, member long")


def greedy_groups(near: DataFrame, points: DataFrame, id_: str = "id") -> DataFrame:
    """greedy_clusters() of (query_id, id) in the order of ids, a pass for each component: no claim reaches another."""
    pairs = near.select(F.col("query_id").alias("a"), F.col("id").alias("b"))
    of = components(pairs.select(F.col("a").alias("src"), F.col("b").alias("dst")))
    placed = pairs.join(of.select(F.col("node").alias("a"), F.col("component").alias("group")), "a")
    return greedy_clusters(placed, points.select(F.col(id_).alias("id"), F.col(id_).alias("at")), "group")


def co_recall(events: DataFrame, event: str, item: str, least: int = 3) -> DataFrame:
    """(a, b, n) of items that occur in the same event at least so often, a < b."""
    rows = events.select(event, item).distinct()
    a, b = rows.select(event, F.col(item).alias("a")), rows.select(event, F.col(item).alias("b"))
    return a.join(b, event).where("a < b").groupBy("a", "b").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def rank_of(confidence: Column) -> Column:
    return F.coalesce(F.array_position(F.array(*[F.lit(r) for r in RANKS]), confidence), F.lit(0))


def merge_edges(old: DataFrame, new: DataFrame, order: str) -> DataFrame:
    """Old edges of a file raised to what comes in, and the incoming ones whose key raised none.

    Keys are (from_symbol, edge_type). Of incoming edges with one key the last by ``order`` counts for
    raising: an old edge of lower confidence takes over its target, confidence and descriptor. An incoming edge
    whose key raises nothing stands beside the old ones. Nothing is made distinct.
    """
    taken = [c for c in old.columns if c not in ("from_symbol", "edge_type")]
    best = new.groupBy("from_symbol", "edge_type").agg(F.max_by(F.struct(*taken), order).alias("__in"))
    raised = F.coalesce(rank_of(F.col("__in.confidence")) > rank_of(F.col("confidence")), F.lit(False))
    joined = old.join(best, ["from_symbol", "edge_type"], "left").withColumn("__raised", raised)
    kept = joined.select(*[F.when(F.col("__raised"), F.col("__in")[c]).otherwise(F.col(c)).alias(c) if c in taken else F.col(c) for c in old.columns])
    used = joined.where("__raised").select("from_symbol", "edge_type").distinct()
    return kept.unionByName(new.join(used, ["from_symbol", "edge_type"], "left_anti").select(*old.columns))


def overlay(old: DataFrame, new: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """One edge for each key, of the highest confidence; of equals the incoming one, then the first by ``order``."""
    rows = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    best = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(rank_of(F.col("confidence"))), F.desc("__new"), *order))
    return rows.withColumn("__r", best).where("__r = 1").drop("__r", "__new")


def best_chunks(hits: DataFrame, edges: DataFrame, chunks: DataFrame, per_file: int = 1, least: float = 0.5, k: int = 3) -> DataFrame:
    """The best chunks of the files next to the hits' files; hits: file; chunks: id, file, score."""
    near = both_ways(edges).join(hits.select(F.col("file").alias("src")).distinct(), "src").select(F.col("dst").alias("file")).distinct()
    near = near.join(hits.select("file"), "file", "left_anti")
    rows = chunks.join(near, "file").where(F.col("score") > least)
    best = F.row_number().over(Window.partitionBy("file").orderBy(F.desc("score"), "id"))
    return rows.withColumn("r", best).where(F.col("r") <= per_file).drop("r").orderBy(F.desc("score"), "id").limit(k)
