"""Operator 5, mixing sources to target weights: a multivariate-hypergeometric splitting tree.

Each source's documents are dealt into blocks by a hash of their ids (``BLOCKS``, or more where a block would have over
``BLOCK_ROWS`` of all rows), and its blocks put into a hashed order. The source's target fixes how many blocks the mix takes (whole passes over the
source, then a part of one; the block at the end is cut at a document). The splitting tree then
halves the set of output shards again and again: each half gets its share of all blocks, and how
many of each source among them is a multivariate-hypergeometric draw, so the counts add up
exactly. A leaf's shard takes the next blocks of each source's order, disjoint from all others,
and is shuffled by itself.

Nothing here goes through the driver but figures of partitions and of rounds: sources are ranked and
filled in tables, and tasks draw the tree's parts, ``PART`` shards each, from nodes' own
seeds. Sources are split together in groups of ``GROUP``, so a task's memory is bounded too.

Defined results: a document's size is its number of words; null or empty texts have size 0 and
are taken like others where their block is. Null is a source, last in the order of weights. Rows
that share an id are dealt together; where one block is cut they come by a hash of
the text, and rows of one id, source and text are taken together. Rows without an id are dealt by their text. Very long texts
are counted whole and taken whole. Draws depend on ids, texts, sources and the
seed only. An empty table gives no rows. Other columns may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell.session import stored, written

WEIGHTS = (5, 2, 1)
SHARE, MOST = 1.5, 2
#: Blocks of a source at least, and rows that a block has on average at most.
BLOCKS, BLOCK_ROWS = 4096, 1000
#: Words of the mix for each output shard.
SHARD_WORDS = 4_000_000
#: Shards of one part of the tree, and sources that one tree splits.
PART, GROUP = 64, 10_000
#: Rows of under 64 bytes up to which a side is broadcast.
BROADCAST_ROWS = 200_000


def keyed(docs: DataFrame, seed: int = 0, *more) -> DataFrame:
    """doc_id, source, version (a hash of the text), dealt (a hash by which rows are put into blocks) and key (their place there)."""
    version = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))
    by = F.when(F.col("doc_id").isNull(), version).otherwise(F.col("doc_id").cast("long"))
    return docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), version.alias("version"), F.xxhash64(F.lit(seed), by).alias("dealt"), F.xxhash64(F.lit(seed + 1), by).alias("key"), *more)


def in_blocks(rows: DataFrame, blocks: int) -> DataFrame:
    return rows.withColumn("block", F.pmod(F.col("dealt"), F.lit(blocks)).cast("int")).drop("dealt")


def sizes(docs: DataFrame, seed: int = 0) -> tuple[DataFrame, int]:
    """(doc_id, source, version, key, size in words and block of every row, stored; number of a source's blocks)."""
    words = F.regexp_count(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    sized, n = stored(keyed(docs, seed, words.alias("size")), "mix-sizes")
    blocks = max(BLOCKS, 1 << max(0, n["rows"] // BLOCK_ROWS).bit_length())
    return in_blocks(sized, blocks), blocks


def side(df: DataFrame, rows: int) -> DataFrame:
    """A side of a join whose rows were counted: broadcast if few, else left to the planner."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def ranked(sources: DataFrame) -> DataFrame:
    """sources (a row each) with ``at``, its place by code point from 0, null last: ordered in ranges, whose counts alone are gathered."""
    n = max(1, int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    order = F.col("source").asc_nulls_last()
    placed = written(sources.repartitionByRange(n, order).withColumn("part", F.spark_partition_id()), "mix-ranges")
    counts = sorted(placed.groupBy("part").count().collect())  # a row a partition
    before = {p: sum(c for q, c in counts if q < p) for p, _ in counts}
    inside = F.row_number().over(Window.partitionBy("part").orderBy(order)) - 1
    start = F.element_at(F.create_map(*[F.lit(x) for p, b in before.items() for x in (p, b)]), F.col("part")) if before else F.lit(0)
    return placed.withColumn("at", (inside + start).cast("long")).drop("part")


def water_fill(sources: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """sources (at, total) with ``target``: in proportion to the weights, share of all totals together, none above most times its own.

    Sources over their bound are full, and the rest is shared again; each round is one aggregation, until none is above.
    """
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("at") % len(weights) + 1).cast("int"))
    level, n_full = 0.0, -1
    while True:
        full = level * weight >= most * F.col("total")
        rows = sources.agg(F.sum("total").alias("all"), F.sum(F.when(full, F.col("total"))).alias("full"), F.sum(F.when(~full, weight)).alias("open"), F.count_if(full).alias("n")).first()
        if rows["n"] == n_full or not rows["open"]:
            level = level if rows["open"] else float("inf")
            break
        n_full, level = rows["n"], (share * rows["all"] - most * (rows["full"] or 0)) / rows["open"]
    bound = (most * F.col("total")).cast("double")
    return sources.withColumn("target", F.least(F.lit(level) * weight, bound))


def hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """How many of n draws without return from good + bad are good, for numbers of any size.

    Inversion over the places within 12 standard deviations of the mode, by the ratios of neighbours.
    """
    low, high = max(0, n - bad), min(n, good)
    if low == high:
        return low
    total = good + bad
    mode = min(max((n + 1) * (good + 1) // (total + 2), low), high)
    spread = 12 * (1 + int((n * good / total * (bad / total) * ((total - n) / max(total - 1, 1))) ** 0.5))
    low, high = max(low, mode - spread), min(high, mode + spread)
    k = np.arange(low, high, dtype=np.float64)
    steps = np.log(good - k) + np.log(n - k) - np.log(k + 1) - np.log(bad - n + k + 1)
    weights = np.concatenate([[0.0], np.cumsum(steps)])
    chances = np.cumsum(np.exp(weights - weights.max()))
    return low + int(np.searchsorted(chances, rng.random() * chances[-1], side="right"))


def drawn_counts(rng: np.random.Generator, has: np.ndarray, n: int) -> np.ndarray:
    """A multivariate-hypergeometric draw of n from the counts has: by halves of the kinds, each a hypergeometric draw."""
    if len(has) == 1:
        return np.array([n], np.int64)
    middle = len(has) // 2
    left = hypergeometric(rng, int(has[:middle].sum()), int(has[middle:].sum()), n)
    return np.concatenate([drawn_counts(rng, has[:middle], left), drawn_counts(rng, has[middle:], n - left)])


def split_tree(quotas: np.ndarray, shards: int, seed: int = 0, first: int = 0, last: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(starts, counts) of each source's blocks for the shards first..last (shards, sources); over all shards counts add up to quotas exactly.

    A node's generator is made from the node, so any part of the tree is drawn again alone, with the same result.
    """
    last = shards if last is None else last
    counts = np.zeros((last - first, len(quotas)), np.int64)
    starts = np.zeros_like(counts)

    def split(low: int, high: int, start: np.ndarray, has: np.ndarray) -> None:
        if high <= first or low >= last:
            return
        if high - low == 1:
            starts[low - first], counts[low - first] = start, has
            return
        middle = (low + high) // 2
        n = int(has.sum()) * (middle - low) // (high - low)
        left = drawn_counts(np.random.default_rng([seed, low, high]), has, n) if len(has) else has
        split(low, middle, start, left)
        split(middle, high, start + left, has - left)

    split(0, shards, np.zeros(len(quotas), np.int64), np.asarray(quotas, np.int64))
    return starts, counts


def plan(sized: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = 0) -> DataFrame:
    """How often each block is taken: source, at (the source's place), block, rank (place in the source's order), passes (whole
    times it is taken), rest (words of it that are taken once more; null: none, -1: all), upto (in the source's one block that is cut, the
    last key and version that are taken once more), source_size, target."""
    blocks = written(sized.groupBy("source", "block").agg(F.sum("size").alias("words")), "mix-blocks")
    totals = ranked(blocks.groupBy("source").agg(F.sum("words").alias("total")))
    sources, n = stored(water_fill(written(totals, "mix-totals"), weights, share, most), "mix-sources")
    passes = F.when(F.col("total") > 0, F.floor(F.col("target") / F.col("total"))).otherwise(0).cast("int")
    sources = sources.select(F.col("source").alias("s"), "at", F.col("total").cast("long").alias("source_size"), "target", passes.alias("passes"))
    sources = sources.withColumn("more", F.round(F.col("target") - F.col("passes") * F.col("source_size")).cast("long"))
    order = Window.partitionBy("at").orderBy(F.xxhash64(F.lit(seed + 2), "source", "block"), "block")
    placed = blocks.join(side(sources, n["rows"]), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    placed = placed.withColumn("rank", F.row_number().over(order) - 1).withColumn("upto", F.sum("words").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    rest = F.when(F.col("upto") <= F.col("more"), F.lit(-1)).when(F.col("upto") - F.col("words") < F.col("more"), F.col("more") - (F.col("upto") - F.col("words")))
    placed = written(placed.withColumn("rest", rest.cast("long")).drop("upto", "words", "more", "total"), "mix-places")
    cut, n = stored(placed.where("rest >= 0").select(F.col("source").alias("s"), F.col("block").alias("b"), "rest"), "mix-cut")  # a row a source
    rows = sized.join(side(cut, n["rows"]), F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b")))
    rows = rows.groupBy("s", "b", "rest", "key", "version").agg(F.sum("size").alias("size"))
    before = F.sum("size").over(Window.partitionBy("s", "b").orderBy("key", "version")) - F.col("size")
    taken = rows.withColumn("before", before).where(F.col("before") + F.col("size") / 2 <= F.col("rest"))
    ends = taken.groupBy("s", "b").agg(F.max(F.struct("key", "version")).alias("upto"))
    placed = placed.join(side(ends, n["rows"]), F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b")), "left")
    return placed.select("source", "at", "block", "rank", "passes", "rest", "upto", "source_size", "target")


def take(rows: DataFrame, blocks: DataFrame) -> DataFrame:
    """Rows with their block's columns and copies, the times a row is taken.

    In the block that is cut, rows in hashed order are taken while their middle lies before
    the rest's end, so a source ends within half a document (or half of the rows equal to it) of its target.
    """
    named = blocks.withColumnsRenamed({"source": "s", "block": "b"})
    joined = rows.join(side(named, blocks.count()), F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b"))).drop("s", "b")
    more = F.coalesce((F.col("rest") < 0) | (F.struct("key", "version") <= F.col("upto")), F.lit(False))
    return joined.withColumn("copies", F.col("passes") + more.cast("int")).drop("upto")


def mix(docs: DataFrame, seed: int = 0, **how) -> DataFrame:
    """doc_id, source, size, source_size, target and copies of every row of docs."""
    sized, _ = sizes(docs, seed)
    blocks = written(plan(sized, seed=seed, **how), "mix-plan")
    return take(sized, blocks).select("doc_id", "source", "size", "source_size", "target", "copies")


def shard_table(blocks: DataFrame, shards: int, seed: int = 0) -> DataFrame:
    """at, shard, low, high, in_source (the source's blocks): which draws of each source go to which shard.

    A source's draws are numbered: pass by pass, in each pass by the order of its blocks. The tree is drawn
    in parts, each by a task for a group of sources.
    """
    drawn = F.col("passes") + F.when(F.col("rest").isNotNull(), 1).otherwise(0)
    quotas = blocks.groupBy("at").agg(F.sum(drawn).alias("n"), F.count("*").alias("in_source"))
    groups = quotas.groupBy((F.col("at") / GROUP).cast("long").alias("group")).agg(F.array_sort(F.collect_list(F.struct("at", "n", "in_source"))).alias("q"))  # GROUP sources at most
    parts = groups.select("group", "q.at", "q.n", "q.in_source", F.explode(F.sequence(F.lit(0), F.lit(shards - 1), F.lit(PART))).alias("first"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for group, at, n, in_source, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                starts, counts = split_tree(np.array(n, np.int64), shards, seed + 7919 * group, first, min(first + PART, shards))
                shard, source = np.nonzero(counts)
                low = starts[shard, source]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in ((np.array(at)[source], pa.int64()), (shard + first, pa.int32()), (low, pa.int64()), (low + counts[shard, source], pa.int64()), (np.array(in_source)[source], pa.int64()))], ["at", "shard", "low", "high", "in_source"])

    return parts.repartition("group", "first").mapInArrow(run, "at long, shard int, low long, high long, in_source long")


def deal(docs: DataFrame, blocks: DataFrame, in_source: int, shards: int | None, seed: int) -> tuple[DataFrame, int]:
    """(rows, shards): a row for each time a row of docs is taken: doc_id, source, version, docs' columns as ``row``, shard, and place (its shuffled order there)."""
    if shards is None:
        words = blocks.groupBy("at").agg(F.first("target").alias("t")).agg(F.sum("t")).first()[0] or 0
        shards = 1 << max(0, int(words / SHARD_WORDS)).bit_length()
    ranges = shard_table(blocks, shards, seed)
    turns = ranges.select("at", "in_source", "shard", F.explode(F.sequence("low", F.col("high") - 1)).alias("draw"))
    # a row for each draw of a block: what a source's order says of (rank, pass), by equality
    turns = turns.select("at", "shard", (F.col("draw") % F.col("in_source")).cast("int").alias("rank"), F.floor(F.col("draw") / F.col("in_source")).cast("int").alias("pass"))
    by_block = turns.groupBy("at", "rank").agg(F.map_from_entries(F.collect_list(F.struct("pass", "shard"))).alias("shards"))  # passes are bounded by MOST
    rows = in_blocks(keyed(docs, seed, F.struct(*docs.columns).alias("row")), in_source)
    taken = take(rows, written(blocks.join(by_block, ["at", "rank"]), "mix-turns")).where("copies > 0")
    taken = taken.withColumn("pass", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    shard = F.element_at("shards", F.col("pass")).alias("shard")
    return taken.select("doc_id", "source", "version", "row", shard, F.xxhash64(F.lit(seed + 3), "doc_id", "pass", "version").alias("place")), shards


def shuffled(rows: DataFrame, shards: int) -> DataFrame:
    """Rows of deal(): each partition is a shard, in its shuffled order."""
    return rows.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "place", "doc_id", "version")


def draws(docs: DataFrame, shards: int | None = None, seed: int = 0, **how) -> tuple[DataFrame, int]:
    """(rows, shards): a row for each time a row of docs is taken: docs' columns as ``row``, shard, and place (its shuffled order there)."""
    sized, in_source = sizes(docs, seed)
    blocks = written(plan(sized, seed=seed, **how), "mix-plan")
    rows, shards = deal(docs, blocks, in_source, shards, seed)
    return rows.select("row", "shard", "place"), shards


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """docs as the mix takes them: each output partition is a shard, in its shuffled order."""
    rows, shards = draws(docs, **how)
    return shuffled(rows, shards).select("row.*")


def drawn(docs: DataFrame, shards: int | None = None, seed: int = 0, **how) -> DataFrame:
    """doc_id, source, size, source_size, target and copies of every row of docs, counted in the mix itself.

    The mix is made whole, documents in shuffled shards, and stored; a row's copies are the draws found
    there. Rows of one id, source and text are one another's equals here, and share their draws out.
    """
    sized, in_source = sizes(docs, seed)
    blocks = written(plan(sized, seed=seed, **how), "mix-plan")
    rows, shards = deal(docs, blocks, in_source, shards, seed)
    mixed = written(shuffled(rows, shards), "mix-shards", compression="zstd")
    key = ["doc_id", "source", "version"]
    both = sized.select(*key, "size", F.lit(1).alias("n"), F.lit(0).alias("d")).unionByName(mixed.select(*key, F.lit(0).cast("long").alias("size"), F.lit(0).alias("n"), F.lit(1).alias("d")))
    counted = both.groupBy(*key).agg(F.max("size").alias("size"), F.sum("n").alias("n"), F.sum("d").alias("d"))
    each = counted.select(*key, "size", "n", "d", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("i"))
    copies = (F.floor(F.col("d") / F.col("n")) + (F.col("i") < F.col("d") % F.col("n")).cast("int")).cast("int")
    sources = blocks.select(F.col("source").alias("s"), "source_size", "target").distinct()
    return each.select(*key, "size", copies.alias("copies")).join(sources, F.col("source").eqNullSafe(F.col("s"))).select("doc_id", "source", "size", "source_size", "target", "copies")
