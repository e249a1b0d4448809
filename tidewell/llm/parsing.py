"""Operator 2, document fingerprints: locally consistent parsing by deterministic coin tossing.

A text's code points get names. On each level the row of names is cut into phrases, and each
phrase gets a name made from the names in it, until one name is left. Runs of one name become a
phrase of their own. In the rest, coin tossing turns each name into a small label from it and
its left neighbour alone (twice the place of their lowest different bit, plus that bit), a few
times over, and a phrase begins at each local maximum of the labels. A cut so depends on a few
names around it and not on its distance from the text's start: equal substrings share all names
but those near their ends, at any offset.

A fingerprint keeps the least ``KEEP`` hashed names of the phrases of the levels from ``LEVEL``
on, each with how often it came before, and the likeness of two is the estimate of the Jaccard
index of the names' multisets. A text with ``FEW`` of these or less than one in ``SPARSE`` code points
(short texts; runs and short periods of any length, which are a phrase or two there) is compared
by the names of all levels instead, code points included.

Defined results: null text is the empty text; two empty texts are alike (1.0), an empty and a
non-empty one are not (0.0). Documents follow by (doc_id, hash of the text), null ids first, so
repeated ids have a defined order; the last is followed by the first; a single document follows
itself. Very long texts are parsed whole; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEEP, LEVEL = 64, 3
#: Names of the high levels under which a text goes by all levels; code points for each name at most.
FEW, SPARSE = 8, 200
#: Rows of a slice of the id order, on average at most.
SLICE_ROWS = 100_000
SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_M1, _M2, _M3 = (np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0x9E3779B97F4A7C15))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers in which every bit depends on every bit."""
    x = x + _M3
    x ^= x >> np.uint64(30)
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


def tossed(names: np.ndarray, first: np.ndarray, rounds: int = 3) -> np.ndarray:
    """Small labels by deterministic coin tossing; neighbours that differ get labels that differ."""
    labels = names
    starts = np.flatnonzero(first)
    for _ in range(rounds):
        before = np.empty_like(labels)
        before[1:] = labels[:-1]
        before[starts] = labels[starts] ^ np.uint64(1)  # a text's first name has no neighbour
        differ = labels ^ before
        low = differ & (~differ + np.uint64(1))
        place = np.log2(np.where(low == 0, np.uint64(1), low).astype(np.float64)).astype(np.uint64)
        labels = np.uint64(2) * place + ((labels >> place) & np.uint64(1))
    return labels


def cuts(names: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where phrases begin in texts laid end to end; first: where a text begins."""
    n = len(names)
    equal = np.zeros(n, bool)
    equal[1:] = (names[1:] == names[:-1]) & ~first[1:]
    run = equal.copy()
    run[:-1] |= equal[1:]  # part of a run of one name
    begin = first.copy()
    begin |= run & ~equal  # a run begins
    begin[1:] |= run[:-1] & ~run[1:]  # and what follows it
    labels = tossed(names, first).astype(np.int8)
    left = np.empty(n, np.int8)
    right = np.empty(n, np.int8)
    left[0], left[1:] = -1, labels[:-1]
    right[-1], right[:-1] = -1, labels[1:]
    left[begin] = -1
    right[:-1][begin[1:]] = -1
    top = (labels > left) & (labels > right) & ~run
    # a maximum beside another beginning would leave a phrase of one name
    top[1:] &= ~begin[:-1]
    top[:-1] &= ~begin[1:]
    top[-1] = False
    return begin | top


def levels(names: np.ndarray, owner: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(level, names, owners) of the phrases of many texts at once; a text is done when it is one name."""
    level = 0
    while True:
        level += 1
        first = np.ones(len(owner), bool)
        np.not_equal(owner[1:], owner[:-1], out=first[1:])
        alone = first.copy()
        alone[:-1] &= first[1:]
        if alone.any():
            names, owner, first = names[~alone], owner[~alone], first[~alone]
        if not len(names):
            return
        at = np.flatnonzero(cuts(names, first))
        # a phrase's name: a sum over its names, each mixed with its place in the phrase
        place = np.arange(len(names), dtype=np.uint64) - np.repeat(at, np.diff(np.append(at, len(names)))).astype(np.uint64)
        names = mix(np.add.reduceat(mix(names ^ (place * _M3)), at) + np.uint64(level))
        owner = owner[at]
        yield level, names, owner


def fingerprints(texts: list[str], keep: int = KEEP, level: int = LEVEL, pairs: Iterable[tuple[int, int]] = ()) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each text its sketches: the least names of the high levels, and of all levels.

    The second is empty unless the text is short or has few high names, or one it is paired with
    (places in texts) has few, so that likeness() can compare the two.
    """
    lengths = np.array([len(t) for t in texts])
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    owner = np.repeat(np.arange(len(texts)), lengths)
    names = mix(points.astype(np.uint64))
    high, every = [], [(names, owner)] if len(names) else []
    for k, n, o in levels(names, owner):
        every.append((n, o))
        if k >= level:
            high.append((n, o))

    def least(parts: list) -> list[np.ndarray]:
        if not parts:
            return [np.zeros(0, np.uint64)] * len(texts)
        n, o = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        order = np.lexsort((n, o))
        n, o = n[order], o[order]
        new = np.ones(len(n), bool)
        new[1:] = (n[1:] != n[:-1]) | (o[1:] != o[:-1])
        starts = np.flatnonzero(new)
        again = np.arange(len(n)) - np.repeat(starts, np.diff(np.append(starts, len(n))))
        n = mix(n ^ (again.astype(np.uint64) * _M2))  # a name's second occurrence is another element
        n = n[np.lexsort((n, o))]
        ends = np.searchsorted(o, np.arange(len(texts) + 1))
        return [n[ends[i] : min(ends[i] + keep, ends[i + 1])] for i in range(len(texts))]

    none = np.zeros(0, np.uint64)
    named = np.zeros(len(texts), np.int64)
    for _, o in high:
        named += np.bincount(o, minlength=len(texts))
    sparse = named * SPARSE < lengths
    high_sketches = [none if sparse[i] else h for i, h in enumerate(least(high))]
    few = np.array([len(h) < FEW for h in high_sketches], bool)
    wanted = few | (lengths < 400)
    for i, j in pairs:
        if few[i] or few[j]:
            wanted[i] = wanted[j] = True
    low: dict[int, np.ndarray] = {}
    if wanted.any():
        sketches = least([(n[wanted[o]], o[wanted[o]]) for n, o in every])
        low = {int(i): sketches[i] for i in np.flatnonzero(wanted)}
    return [(high_sketches[i], low.get(i, none)) for i in range(len(texts))]


def text_of(sketch: tuple[np.ndarray, np.ndarray], length: int = 0) -> str:
    """high.low, each 16 hexadecimal digits a name; low only where it is the text's own and not for its pair's sake."""
    own = sketch if length < 400 or len(sketch[0]) < FEW else (sketch[0], sketch[1][:0])
    return ".".join(part.astype(">u8").tobytes().hex() for part in own)


def _jaccard(a: np.ndarray, b: np.ndarray, keep: int) -> float:
    if not len(a) and not len(b):
        return 1.0
    union = np.union1d(a, b)[:keep]
    return float(np.isin(union, np.intersect1d(a, b, assume_unique=True)).mean())


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], keep: int = KEEP) -> float:
    """Estimated Jaccard index: over the high levels, or over all where a text has few phrases there."""
    if min(len(a[0]), len(b[0])) < FEW and len(a[1]) and len(b[1]):
        return _jaccard(a[1], b[1], keep)
    return _jaccard(a[0], b[0], keep) if len(a[0]) or len(b[0]) or len(a[1]) == len(b[1]) == 0 else 0.0


def edited(text: str, after: str) -> str:
    """text with its last quarter replaced by as much of the beginning of after, or all of it."""
    n = len(text) // 4
    return text[: len(text) - n] + after[:n]


def bucket(c: Column, edges: list[int]) -> Column:
    """How many of the ascending edges are at most c; null: 0. Searched in two steps of about the root of their number."""
    if not edges:
        return F.lit(0)
    step = max(1, math.isqrt(len(edges)))
    parts = [edges[i : i + step] for i in range(0, len(edges), step)]
    upto = lambda xs: F.size(F.filter(xs, lambda x: x <= c))
    coarse = F.greatest(upto(F.lit([p[0] for p in parts])) - 1, F.lit(0))
    return F.when(c.isNull(), F.lit(0)).otherwise(coarse * step + upto(F.get(F.lit(parts), coarse)))


def slice_of(id_: Column, version: Column, edges: list[int], split: dict[int, int]) -> Column:
    """The slice of a row by its id and, for ids that are ``split`` (into how many slices), by the hash of its text.

    A slice begins at each edge; an id that is split is an edge, and has slices of equal ranges of the hash, of which the
    last goes on to the next edge.
    """
    at, more = bucket(id_, edges), F.lit(0)
    for e, n in split.items():  # each holds one slice's share of all rows or more, so there are no more than slices
        share = F.floor((F.shiftright(version, 32) + (1 << 31)) * n / (1 << 32)).cast("int")
        more = more + F.when(id_ > e, n - 1).when(id_ == e, share).otherwise(0)
    return (at + more).cast("int")


def in_order(docs: DataFrame, slices: int) -> DataFrame:
    """Ids and texts in slices of the order by id and hash of the text: slice, own, doc_id, text.

    Slices are cut at quantiles of the ids; an id that fills several is cut by the hashes. A slice's first rows also stand at the end of the slice
    before (own = false), the first slice's at the end of the last, so every row's follower is in
    its slice. Only ids (and the hashes, where an id is cut) are read for the plan, which has a row a slice; texts move once.
    """
    least = -(1 << 63)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    ids = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(least)).alias("id"), text.alias("text"))
    at = ids.agg(F.percentile_approx("id", [i / slices for i in range(1, slices)], F.lit(max(10_000, 4 * slices)))).first()[0] if slices > 1 else []
    often = Counter(at or [])
    edges, split = sorted(often), {e: n for e, n in sorted(often.items()) if n > 1}
    version = F.xxhash64("text") if split else F.lit(0).cast("long")
    placed = ids.withColumn("version", version).select("id", "version", slice_of(F.col("id"), F.col("version"), edges, split).alias("slice"))
    firsts = placed.groupBy("slice").agg(F.min(F.struct("id", "version")).alias("first")).orderBy("slice").collect()
    low = {r["slice"]: r["first"] for r in firsts}
    order = [r["slice"] for r in firsts]
    prior = {k: order[i - 1] for i, k in enumerate(order)}
    places = max(order, default=0) + 1
    low_id, low_version = (F.lit([(low[k][c] if k in low else 0) for k in range(places)]) for c in ("id", "version"))
    before = F.lit([prior.get(k, 0) for k in range(places)])
    own = F.struct(F.col("s").alias("slice"), F.lit(True).alias("own"))
    lent = F.struct(F.get(before, F.col("s")).cast("int").alias("slice"), F.lit(False).alias("own"))
    rows = docs.select(F.col("doc_id").cast("long"), text.alias("text")).withColumns({"id": F.coalesce("doc_id", F.lit(least)), "version": version})
    rows = rows.withColumn("s", slice_of(F.col("id"), F.col("version"), edges, split))
    first = (F.col("id") == F.get(low_id, F.col("s"))) & (F.col("version") == F.get(low_version, F.col("s")))
    return rows.select("doc_id", "text", F.inline(F.when(first, F.array(own, lent)).otherwise(F.array(own))))


def fingerprint_edits(docs: DataFrame, keep: int = KEEP, level: int = LEVEL, chars: int = 1_000_000) -> DataFrame:
    """Fingerprints of every row's text and edited text, and their likeness; see SCHEMA.

    A task walks its slice in order and holds about ``chars`` characters of texts at a time.
    """
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    slices = max(1, least, -(-docs.count() // SLICE_ROWS))
    placed = in_order(docs, slices).repartitionById(slices, F.col("slice")).sortWithinPartitions(F.desc("own"), F.asc_nulls_first("doc_id"), F.xxhash64("text"))

    def rows_of(held: list[tuple[int, str]], after: str) -> pa.RecordBatch:
        texts = [t for _, t in held] + [after]
        changed = [edited(t, texts[i + 1]) for i, (_, t) in enumerate(held)]
        n = len(held)
        pairs = [(i, j) for i in range(n) for j in (i + 1, n + 1 + i)]
        sketches = fingerprints(texts + changed, keep, level, pairs)
        columns = [
            pa.array([d for d, _ in held], pa.int64()),
            pa.array([len(t) for _, t in held], pa.int64()),
            pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in changed]),
            pa.array([text_of(s, len(t)) for s, t in zip(sketches[:n], texts[:n], strict=True)]),
            pa.array([text_of(s, len(t)) for s, t in zip(sketches[n + 1 :], changed, strict=True)]),
            pa.array([likeness(sketches[i], sketches[n + 1 + i], keep) for i in range(n)], pa.float64()),
            pa.array([likeness(sketches[i], sketches[i + 1], keep) for i in range(n)], pa.float64()),
        ]
        return pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in SCHEMA.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, str]] = []
        total, after = 0, None
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                for own, doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                    if not own:
                        after = text if after is None else after
                        continue
                    if total > chars:
                        yield rows_of(held, text)
                        held, total = [], 0
                    held.append((doc, text))
                    total += len(text)
        if held:
            yield rows_of(held, held[-1][1] if after is None else after)

    return placed.select("own", "doc_id", "text").mapInArrow(run, SCHEMA)
