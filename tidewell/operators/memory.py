"""Memories: recall, governance and versions (F7-F18, N1-N17, D2, D10-D17). Times come in as an explicit now."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions import scoring
from tidewell.functions.models import merged_text
from tidewell.operators.search import batch_search, rerank


def upsert(table: DataFrame, rows: DataFrame, key: str = "id") -> DataFrame:
    """A5: the incoming row of each key, else the stored; of incoming doubles the last by ``seq`` where there is one."""
    if "seq" in rows.columns:
        rows = rows.withColumn("__r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("seq")))).where("__r = 1").drop("__r", "seq")
    return table.join(rows.select(key), key, "left_anti").unionByName(rows, allowMissingColumns=True)


def set_payload(table: DataFrame, patch: DataFrame, key: str = "id") -> DataFrame:
    """A10: the patch's columns where it has a row and a value, the stored elsewhere."""
    fields = [c for c in patch.columns if c != key]
    named = patch.select(key, *[F.col(c).alias("__" + c) for c in fields])
    out = table.join(named, key, "left")
    return out.select(*[F.coalesce("__" + c, c).alias(c) if c in fields else F.col(c) for c in table.columns])


def hash_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, status) of files by their hashes; old, new: path, hash."""
    both = old.withColumnRenamed("hash", "old").join(new.withColumnRenamed("hash", "new"), "path", "full_outer")
    status = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") == F.col("new"), "unchanged").otherwise("changed")
    return both.select("path", status.alias("status"))


def first_hit(lists: list[DataFrame], key: str = "id") -> DataFrame:
    """Each key's row from the first list that has it, with the list's number."""
    every = reduce(DataFrame.unionByName, [d.withColumn("source_rank", F.lit(i)) for i, d in enumerate(lists)])
    return every.withColumn("__r", F.row_number().over(Window.partitionBy(key).orderBy("source_rank"))).where("__r = 1").drop("__r")


def durable_and_long_term(durable: DataFrame, long_term: DataFrame, k: int) -> DataFrame:
    """Long-term rows whose id isn't among the durable ones join them; again the best k."""
    return durable.unionByName(long_term.join(durable.select("id"), "id", "left_anti")).orderBy(F.desc("score"), "id").limit(k)


def standing(rows: DataFrame) -> DataFrame:
    """Rows that nothing supersedes; an empty pointer is none."""
    return rows.where(F.coalesce(F.col("superseded_by").cast("string"), F.lit("")) == "")


def long_term_recall(rows: DataFrame, now: Column, k: int, least: float = 0.1) -> DataFrame:
    """the best by score times retention; superseded and forgotten rows are left out."""
    kept = standing(rows).withColumn("retention", scoring.retention(scoring.days_before(now, F.col("last_accessed")), F.col("stability"), F.col("access_count")))
    return kept.where(F.col("retention") >= least).withColumn("score", F.col("score") * F.col("retention")).orderBy(F.desc("score"), "id").limit(k)


def temporal_list(rows: DataFrame, op: str, low: str | None, high: str | None, k: int) -> DataFrame:
    """rows by a temporal constraint, in its order of time."""
    at = F.col("created_at")
    if op == "before":
        rows = rows.where(at < F.lit(low).cast("timestamp"))
    elif op == "after":
        rows = rows.where(at >= F.lit(low).cast("timestamp"))
    elif op == "between":
        rows = rows.where(at.between(F.lit(low).cast("timestamp"), F.lit(high).cast("timestamp")))
    return rows.orderBy(at.asc() if op == "first" else at.desc(), "id").limit(2 * k)


def recall(lists: list[DataFrame], facts: DataFrame, now: Column, k: int = 10, boost: float = 0.3, scorer: Callable | None = None, trigger: Callable | None = None) -> DataFrame:
    """several ranked lists (id, score) fused, then reranked, raised by triggers, rid of superseded rows, aged and blended with recency; facts: id, created_at, exempt, superseded_by.

    Empty lists don't count; with one list its scores stay. The first 3 * k of the fused rows go on. scorer: a function of facts' ``content`` for F3's rerank, which keeps
    2 * k; trigger: one of (score, facts' ``trigger``) for F7's boost. Without them these steps are left out.
    """
    full = [d for d in lists if d.take(1)]
    if not full:
        return facts.select("id", F.lit(0.0).alias("score")).limit(0)
    if len(full) == 1:
        fused = full[0].select("id", "score")
    else:
        ranked = [d.select("id", (1.0 / (60 + F.row_number().over(Window.orderBy(F.desc("score"), "id")))).alias("score")) for d in full]  # each a top-k
        fused = reduce(DataFrame.unionByName, ranked).groupBy("id").agg(F.sum("score").alias("score"))
    rows = fused.orderBy(F.desc("score"), "id").limit(3 * k).join(facts, "id")
    if scorer:
        rows = rerank(rows, F.col("content"), scorer, 2 * k)
    if trigger:
        rows = rows.withColumn("score", trigger(F.col("score"), F.col("trigger")))
    days = scoring.days_before(now, F.col("created_at"))
    aged = F.col("score") * scoring.aging(days, F.col("exempt"))
    rows = standing(rows).withColumn("score", scoring.recency_blend(aged, days, boost))
    return rows.select("id", "score").orderBy(F.desc("score"), "id").limit(k)


def digest(rows: DataFrame, now: Column, limits: dict[str, int], lines: int = 200) -> DataFrame:
    """sections in order of priority, each row in its first section only, cut to the section's limit and the lines' cap.

    rows: section, id, score. The result has section, place in it, and line.
    """
    rank = F.create_map(*[F.lit(x) for i, s in enumerate(limits) for x in (s, i)])
    most = F.create_map(*[F.lit(x) for s, n in limits.items() for x in (s, n)])
    first = F.row_number().over(Window.partitionBy("id").orderBy(rank[F.col("section")]))
    rows = rows.where(F.col("section").isin(*limits)).withColumn("__f", first).where("__f = 1").drop("__f")
    rows = rows.withColumn("place", F.row_number().over(Window.partitionBy("section").orderBy(F.desc("score"), "id"))).where(F.col("place") <= most[F.col("section")])
    return rows.withColumn("line", F.row_number().over(Window.orderBy(rank[F.col("section")], "place"))).where(F.col("line") <= lines)  # as many rows as the limits allow


def tail(rows: DataFrame, keys: list[str], at: list[str], n: int) -> DataFrame:
    """The newest n of each key."""
    w = Window.partitionBy(*keys).orderBy(*[F.desc(a) for a in at])
    return rows.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= n).drop("__r")


def route(rows: DataFrame, threshold: Column) -> DataFrame:
    """Where an incoming memory goes: other than automatic ones are durable, those under the threshold are skipped."""
    auto = F.startswith("source", F.lit("auto_"))
    return rows.withColumn("route", F.when(~F.coalesce(auto, F.lit(False)), "durable").when(F.col("confidence") < threshold, "skip").otherwise("quarantine"))


def expired(rows: DataFrame, now: Column, days: float, at: str = "created_at") -> DataFrame:
    """Rows older than so many days."""
    return rows.where(scoring.days_before(now, F.col(at)) > days)


def merge_clusters(rows: DataFrame, cluster: str = "cluster", merger: Callable[[Column], Column] = merged_text) -> DataFrame:
    """One memory for each cluster: its texts in order of ids as ``merger`` makes one of them, newest time, any validation, highest confidence,
    strongest pin, all tags, a manual source first, relations without doubles, the newest trigger."""
    pins = F.create_map(F.lit("all"), F.lit(2), F.lit("repo"), F.lit(1))
    pin = F.coalesce(F.try_element_at(pins, F.col("pin")), F.lit(0))
    ordered = F.array_sort(F.collect_list(F.struct("id", "content", "tags", "source")))
    out = rows.groupBy(cluster).agg(
        ordered.alias("m"), F.max("created_at").alias("created_at"), F.bool_or("validated").alias("validated"), F.max("confidence").alias("confidence"),
        F.max_by(F.when(pin > 0, F.col("pin")), pin).alias("pin"), F.max_by("trigger", F.when(F.col("trigger").isNotNull(), F.struct("created_at", "id"))).alias("trigger"),
        F.count("*").alias("n"),
    )
    sources = F.filter(F.transform("m", lambda x: x["source"]), lambda x: x.isNotNull())
    return out.select(
        cluster, merger(F.transform("m", lambda x: x["content"])).alias("content"), F.array_distinct(F.flatten(F.transform("m", lambda x: x["tags"]))).alias("tags"),
        F.when(F.array_contains(sources, "manual"), "manual").otherwise(F.get(sources, F.lit(0))).alias("source"), "created_at", "validated", "confidence", "pin", "trigger", "n",
        F.transform("m", lambda x: x["id"]).alias("merged_from"),
    )


def relation(score: Column, same_type: Column, text: Column) -> Column:
    """How a new memory relates to a stored one, by thresholds; null under the last."""
    low = F.lower(text)
    negated = F.contains(low, F.lit("not ")) | F.contains(low, F.lit("instead")) | F.contains(low, F.lit("wrong"))
    return F.when((score > 0.85) & same_type, "supersedes").when((score > 0.8) & negated & same_type, "contradicts").when(score > 0.75, "relates_to")


def relations(new: DataFrame, known: DataFrame, k: int = 5, least: float = 0.75) -> DataFrame:
    """(id, target_id, score, relation) of new memories to the k nearest known ones of at least that cosine; both: id, vector, type, new also content.

    All new memories are searched together. A known memory of the same id is itself, and left out.
    """
    near = batch_search(known, new, k, least)
    mine = new.select(F.col("id").alias("query_id"), F.col("type").alias("__new"), "content")
    theirs = known.select("id", F.col("type").alias("__known"))
    rows = near.join(mine, "query_id").join(theirs, "id").withColumn("relation", relation(F.col("score"), F.col("__new") == F.col("__known"), F.col("content")))
    return rows.where("relation is not null").select(F.col("query_id").alias("id"), F.col("id").alias("target_id"), "score", "relation")


def versions_of(log: DataFrame) -> DataFrame:
    """The latest version of each memory; deleted ones have none. log: memory_id, seq, op, content."""
    last = log.groupBy("memory_id").agg(F.max_by(F.struct("op", "content"), "seq").alias("v"), F.count("*").alias("n_versions"), F.max("seq").alias("seq"))
    return last.where("v.op <> 'deleted'").select("memory_id", "seq", F.col("v.op").alias("op"), F.col("v.content").alias("content"), "n_versions")


def redact(log: DataFrame, gone: DataFrame) -> DataFrame:
    """Versions that are taken back lose what they hold, and keep their place, operation and hash; gone: memory_id, seq.

    Columns of the log besides memory_id, seq, op, content_hash, actor and at are cleared, and ``redacted`` is set. Redacting again changes nothing.
    """
    stays = ("memory_id", "seq", "op", "content_hash", "actor", "at", "redacted")
    out = log.join(gone.select("memory_id", "seq", F.lit(True).alias("__gone")), ["memory_id", "seq"], "left").withColumn("__gone", F.col("__gone").isNotNull())
    kept = [F.col(c) if c in stays else F.when(~F.col("__gone"), F.col(c)).alias(c) for c in log.columns if c != "redacted"]
    was = F.coalesce("redacted", F.lit(False)) if "redacted" in log.columns else F.lit(False)
    return out.select(*kept, (was | F.col("__gone")).alias("redacted"))


def rollback(live: DataFrame, snapshot: DataFrame, overrides: DataFrame, key: str = "id") -> DataFrame:
    """Fields from the overrides, else the snapshot, else the live row; of keys with a snapshot."""
    fields = [c for c in live.columns if c != key]
    named = lambda d, p: d.select(key, *[F.col(c).alias(p + c) for c in d.columns if c != key])
    rows = named(snapshot, "s_").join(named(live, "l_"), key, "left").join(named(overrides, "o_"), key, "left")
    pick = lambda c: F.coalesce(*[F.col(p + c) for p in ("o_", "s_", "l_") if p + c in rows.columns])
    return rows.select(key, *[pick(c).alias(c) for c in fields])


#: Fixed value: confidence under which an automatic memory is stale.
LOW_CONFIDENCE = 0.4


def stale(rows: DataFrame, now: Column) -> DataFrame:
    """The first rule that a memory meets: superseded; old and automatic; of low confidence; an old note."""
    days = scoring.days_before(now, F.col("created_at"))
    auto = (F.col("source") == "auto_conversation") & ~F.coalesce("validated", F.lit(False))
    rule = F.when(F.coalesce("superseded_by", F.lit("")) != "", "superseded").when((days > 30) & auto, "unvalidated").when(auto & (F.col("confidence") < LOW_CONFIDENCE), "low_confidence").when((days > 90) & (F.col("type") == "note"), "old_note")
    return rows.withColumn("rule", rule).where(F.col("rule").isNotNull())


def fading(rows: DataFrame, now: Column, least: float = 0.1) -> DataFrame:
    """N12, second part: long-term memories that were never read and of which less than a tenth is retained; rows: created_at, stability, access_count."""
    access, stability = F.coalesce("access_count", F.lit(0)), F.coalesce("stability", F.lit(7.0))
    kept = scoring.retention(scoring.days_before(now, F.col("created_at")), stability, access)
    return rows.withColumn("retention", kept).where(F.col("created_at").isNotNull() & (access == 0) & (F.col("retention") < least))


#: Where memories of a type move to, and the subtype of semantic ones.
LONG_TERM = {"conversation": "episodic", "context": "episodic", "note": "episodic", "decision": "semantic", "insight": "semantic", "procedure": "semantic", "todo": "episodic"}
SUBTYPES = ("decision", "insight", "procedure")


def migrated(rows: DataFrame, known: DataFrame) -> DataFrame:
    """Memories that are not in the long-term store yet, with ``target`` and ``subtype``; types without a target stay behind."""
    targets = F.create_map(*[F.lit(x) for k, v in LONG_TERM.items() for x in (k, v)])
    out = rows.join(known.select("id"), "id", "left_anti").withColumn("target", F.try_element_at(targets, F.col("type")))
    return out.where(F.col("target").isNotNull()).withColumn("subtype", F.when(F.col("type").isin(*SUBTYPES), F.col("type")))


def strengthen(rows: DataFrame, hits: DataFrame) -> DataFrame:
    """Each recall adds an access and stretches stability by half; hits: id, n."""
    out = rows.join(hits, "id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return out.withColumn("access_count", F.col("access_count") + F.col("n")).withColumn("stability", F.col("stability") * F.pow(F.lit(1.5), F.col("n"))).drop("n")


def set_status(rows: DataFrame, changes: DataFrame) -> DataFrame:
    """A new status by exact id, appended to the history; changes: id, status, at."""
    c = changes.select("id", F.col("status").alias("__s"), F.col("at").alias("__at"))
    entry = F.array(F.struct(F.col("__s").alias("status"), F.col("__at").alias("at")))
    out = rows.join(c, "id", "left")
    return out.withColumn("history", F.when(F.col("__s").isNotNull(), F.concat("history", entry)).otherwise(F.col("history"))).withColumn("status", F.coalesce("__s", "status")).drop("__s", "__at")
