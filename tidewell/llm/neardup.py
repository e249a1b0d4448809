"""Operator 9, MinHash near-dedup: a chosen-path set similarity join.

Each text's set of word shingles gets ``COORDS`` minwise tokens. Texts with equal sets are one *class*.
Independent trees branch the classes: a tree's roots are the values of one minwise token. A node of
``SMALL`` classes at most is compared whole, by a byte of each token. A larger one first sets
aside those close to two pivots, where there are more than ``SMALL`` of these; the rest goes on to nodes of
``PATHS`` sets of ``STEP`` tokens each that a hash of the node chooses. What is still large on the
last level is set aside too.

A node with many candidate pairs hands on a spanning forest of its likeliest ones and its members, not
all pairs; so do groups set aside. Pairs are confirmed on the full sets: each class's likeliest
first, then what still lies between components. A group whose members are then in several components
is settled exactly: all members outside its main component meet all others in
blocks that hold the full sets, and a block gives only links that join components.

Recall of a pair at 0.75: 3/4 to share a tree's root. Each branching keeps a set of tokens with
0.75**4 = 0.32, so 1.6 of the 5 paths go on: a path of any number of branchings is left with 0.73 at least, and
all ten trees miss with (1 - 0.75 * 0.73)**10 = 4e-4; without branching, with 1e-6. The byte sketch
drops a pair with about 1e-5. A member of a group set aside that lies beyond ``BORDER`` of the pivot
goes on branching with the rest.

Defined results: a text without words has an empty set, is linked with nothing and is its own
component, even beside other rows of its id; null text is the empty text. Rows that share an id
are one document to components, whatever their texts. A row without an id has no component (null) and is kept; it links nothing.
Very long texts are compared by all their shingles. An empty table gives no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.llm import shingles, vocab
from tidewell.llm.names import unused
from tidewell.session import stored, written

COORDS, TREES, SMALL, DEPTH = 64, 10, 4096, 6
#: Sets of tokens that a large node branches by, and tokens in each.
PATHS, STEP = 5, 4
PERCENT = 75
#: Equal sketch bytes, of COORDS, from which a pair is kept: over 4 standard deviations below 0.75.
EQUAL = 33
#: Equal bytes from which a class is close to a pivot (0.8), and under which nothing linked with a close one is:
#: 0.55 by the triangle inequality, less for the sketch's error on both sides.
CLOSE, BORDER = 52, 20
#: Candidate pairs of a node that are handed on one by one: this many, or four a class if that is more.
FEW_PAIRS = 276
#: Rows of ids up to which a side is broadcast (16 bytes each, 3 MB).
BROADCAST_ROWS = 200_000
#: Links that one task joins (16 bytes each).
LINKS = 1_000_000
#: Classes and bytes of text of one block of a group.
BLOCK, BLOCK_BYTES = 2048, 8_000_000
_RNG = np.random.default_rng(97)
_A = _RNG.integers(0, 1 << 31, COORDS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_B = _RNG.integers(0, 1 << 32, COORDS, dtype=np.uint32)
SIGNATURE = "doc_id long, version long, n_shingles long, digest binary, roots array<int>, mini binary"
COMPARED = "a long, b long, equal int, node long, mini binary"


def encoded(texts: list[str | None]) -> list[bytes]:
    return [(t or "").encode("utf-8", "surrogatepass") for t in texts]


def runs(lengths: list[int], most: int = 300_000) -> Iterator[tuple[int, int]]:
    """Cuts texts of these lengths so that each part holds about ``most`` characters at most, or one text."""
    low, held = 0, 0
    for i, n in enumerate(lengths):
        if held and held + n > most:
            yield low, i
            low, held = i, 0
        held += n + 1
    if low < len(lengths):
        yield low, len(lengths)


def sets_of(texts: list[str]) -> list[np.ndarray]:
    """shingle_sets(), part by part: its arrays, dozens of bytes a character, do not grow with the texts given at once."""
    return [s for low, high in runs([len(t) for t in texts]) for s in shingles.shingle_sets(encoded(texts[low:high]))]


def tokens(sets: list[np.ndarray]) -> np.ndarray:
    """Minwise tokens (sets, COORDS); the sets are not empty."""
    flat = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    at = np.cumsum([0] + [len(s) for s in sets[:-1]])
    out = np.empty((len(sets), COORDS), np.uint32)
    for k in range(COORDS):
        out[:, k] = np.minimum.reduceat(flat * _A[k] + _B[k], at)
    out *= np.uint32(0x9E3779B1)  # the least of many are small numbers; their low bytes shall differ
    return out ^ (out >> np.uint32(15))


def version() -> Column:
    return F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("version")


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, version (a hash of the text), n_shingles, digest of the set, the trees' root tokens and a byte of each token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab.forget()
        for batch in batches:
            for low, high in runs(pc.fill_null(pc.utf8_length(batch.column(2)), 0).to_pylist()):
                part = batch.slice(low, high - low)
                sets = shingles.shingle_sets(encoded(part.column(2).to_pylist()))
                full = [i for i, s in enumerate(sets) if len(s)]
                roots, mini = [None] * len(sets), [None] * len(sets)
                if full:
                    t = tokens([sets[i] for i in full])
                    low_bytes = (t & np.uint32(255)).astype(np.uint8)
                    for row, i in enumerate(full):
                        roots[i], mini[i] = t[row, :TREES].view(np.int32), low_bytes[row].tobytes()
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array([shingles.digest(s) for s in sets], pa.binary()), pa.array(roots, pa.list_(pa.int32())), pa.array(mini, pa.binary())], [f.split()[0] for f in SIGNATURE.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), version(), F.col("text").cast("string")).mapInArrow(run, SIGNATURE)


# --- nodes ------------------------------------------------------------------------------------------


def _bytes(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, COORDS)


def equal_bytes(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many bytes of the sketches x (n, COORDS) and y (m, COORDS) are equal: (n, m), bytes."""
    if len(x) * len(y) <= 2500:
        return (x[:, None, :] == y[None, :, :]).sum(axis=2, dtype=np.uint8)
    out, columns = np.zeros((len(x), len(y)), np.uint8), np.ascontiguousarray(y.T)
    for at in range(0, len(x), 128):
        part, rows = out[at : at + 128], x[at : at + 128]
        for k in range(COORDS):
            part += rows[:, k, None] == columns[k]
    return out


def spanning(same: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Ends of a maximum spanning forest of the pairs with at least ``least`` equal bytes (Prim)."""
    n = len(same)
    best, via, out = np.zeros(n, np.int16), np.zeros(n, np.int64), np.zeros(n, bool)
    ends: list[tuple[int, int]] = []
    for _ in range(n):
        i = int(np.where(out, -1, best).argmax())
        if best[i] >= least:
            ends.append((int(via[i]), i))
        out[i] = True
        nearer = same[i] > best
        best[nearer], via[nearer] = same[i][nearer], i
    found = np.array(ends, np.int64).reshape(-1, 2)
    return found[:, 0], found[:, 1]


def compare_nodes(rows: DataFrame) -> DataFrame:
    """Pairs (a, b, equal) of nodes that fit one task; of a node with many, a forest and the members (a, node, mini)."""

    def whole(node: int, ids: np.ndarray, x: np.ndarray, out: list[list]) -> None:
        same = equal_bytes(x, x)
        near = same >= EQUAL
        np.fill_diagonal(near, False)
        n = int(np.count_nonzero(near)) // 2
        if not n:
            return
        if n <= max(FEW_PAIRS, 4 * len(ids)):
            i, j = np.nonzero(np.triu(near))
        else:
            paired = np.flatnonzero(near.any(axis=1))
            i, j = spanning(same, EQUAL)
            for c, v in zip(out, (ids[paired], [None] * len(paired), [None] * len(paired), [node] * len(paired), [x[k].tobytes() for k in paired]), strict=True):
                c.extend(v)
        for c, v in zip(out, (np.minimum(ids[i], ids[j]), np.maximum(ids[i], ids[j]), same[i, j], [None] * len(i), [None] * len(i)), strict=True):
            c.extend(v)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab.forget()
        held: tuple[int, list, list] | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            out: list[list] = [[] for _ in range(5)]
            node, ids, x = batch.column(0).to_numpy(), batch.column(1).to_numpy(), _bytes(batch.column(2))
            cuts = [0, *(np.flatnonzero(np.diff(node)) + 1).tolist(), len(node)]
            if held and held[0] == node[0]:
                held[1].append(ids[: cuts[1]])
                held[2].append(x[: cuts[1]])
                cuts = cuts[1:]
            if held and len(cuts) > 1:
                whole(held[0], np.concatenate(held[1]), np.concatenate(held[2]), out)
                held = None
            for low, high in zip(cuts[:-2], cuts[1:-1], strict=True):
                if high - low > 1:
                    whole(int(node[low]), ids[low:high], x[low:high], out)
            if len(cuts) > 1:
                held = (int(node[cuts[-2]]), [ids[cuts[-2] :]], [x[cuts[-2] :]])
            yield batch_of(out)
        if held and sum(map(len, held[1])) > 1:
            out = [[] for _ in range(5)]
            whole(held[0], np.concatenate(held[1]), np.concatenate(held[2]), out)
            yield batch_of(out)

    def batch_of(out: list[list]) -> pa.RecordBatch:
        types = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], [f.split()[0] for f in COMPARED.split(", ")])

    return rows.select("node", "cid", "mini").repartition("node").sortWithinPartitions("node").mapInArrow(run, COMPARED)


def compare_pivots(members: DataFrame) -> DataFrame:
    """members with same1 and same2, the sketch bytes equal to each pivot's; columns node, cid, mini, p1, m1, p2, m2."""
    schema = "node long, cid long, mini binary, p1 long, same1 int, p2 long, same2 int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _bytes(batch.column(2))
                same = [pa.array((x == _bytes(batch.column(k))).sum(axis=1).astype(np.int32)) for k in (4, 6)]
                yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(4)), same[0], batch.column(5), same[1]], [f.split()[0] for f in schema.split(", ")])

    return members.select("node", "cid", "mini", "p1", "m1", "p2", "m2").mapInArrow(run, schema)


def branch(members: DataFrame) -> DataFrame:
    """The next level: each node's chosen sets of tokens lead its classes to new nodes."""

    def path(t: int) -> list:
        place = lambda j: F.pmod(F.xxhash64("node", F.lit(STEP * t + j)), F.lit(COORDS)).cast("int") + 1
        return F.xxhash64("node", F.lit(t), *[F.substring(F.col("mini"), place(j), F.lit(1)) for j in range(STEP)])

    return members.select(F.explode(F.array(*[path(t) for t in range(PATHS)])).alias("next"), "cid", "mini").select(F.col("next").alias("node"), "cid", "mini")


def side(df: DataFrame, rows: int) -> DataFrame:
    """A side of a join whose rows were counted: broadcast if few, else left to the planner."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def chosen_paths(classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pairs, dense): candidate pairs (a, b, equal) of classes, and (node, cid, mini) of groups of which a forest alone is among the pairs."""
    roots = F.transform("roots", lambda v, i: F.struct(F.xxhash64(i, v).alias("node")))
    rows = classes.select("cid", "mini", F.inline(roots)).select("node", "cid", "mini")
    found, dense = [], []
    for level in range(DEPTH):
        # a large node takes SMALL rows, so these are few beside the rows
        nodes = rows.groupBy("node").agg(F.count("*").alias("n"), F.min(F.struct(F.xxhash64("mini", F.lit(1)).alias("h"), "cid", "mini")).alias("p"), F.min(F.struct(F.xxhash64("mini", F.lit(2)).alias("h"), "cid", "mini")).alias("q")).where(F.col("n") > SMALL)
        nodes = nodes.select("node", F.col("p.cid").alias("p1"), F.col("p.mini").alias("m1"), F.col("q.cid").alias("p2"), F.col("q.mini").alias("m2"))
        nodes, seen = stored(nodes, f"nodes-{level}")
        small = rows.join(side(nodes.select("node"), seen["rows"]), "node", "left_anti") if seen["rows"] else rows
        compared = written(compare_nodes(small), f"compared-{level}")
        found.append(compared.where("node is null").select("a", "b", "equal"))
        dense.append(compared.where("node is not null").select("node", F.col("a").alias("cid"), "mini"))
        if not seen["rows"]:
            break
        # rows of a few hundred bytes: a tenth of the ids' bound
        big = written(compare_pivots(rows.join(side(nodes, 10 * seen["rows"]), "node")), f"large-{level}")
        stars = reduce(DataFrame.unionByName, [big.where((F.col(f"same{k}") >= EQUAL) & (F.col(f"p{k}") != F.col("cid"))).select("cid", F.col(f"p{k}").alias("p"), F.col(f"same{k}").alias("equal")) for k in (1, 2)])
        found.append(stars.select(F.least("cid", "p").alias("a"), F.greatest("cid", "p").alias("b"), "equal"))
        close = [F.col(f"same{k}") >= CLOSE for k in (1, 2)]
        groups, n = stored(big.groupBy("node").agg(*[(F.count_if(c) > SMALL).alias(f"g{k}") for k, c in enumerate(close, 1)]).where("g1 or g2"), f"groups-{level}")
        rest = big
        if n["rows"]:
            marked = big.join(side(groups, n["rows"]), "node", "left").withColumns({g: F.coalesce(g, F.lit(False)) for g in ("g1", "g2")})
            for k in (1, 2):
                dense.append(marked.where(F.col(f"g{k}") & (F.col(f"same{k}") >= BORDER)).select(F.xxhash64("node", F.lit(k)).alias("node"), "cid", "mini"))
            rest = marked.where(~((F.col("g1") & close[0]) | (F.col("g2") & close[1])))
        if level == DEPTH - 1:
            dense.append(rest.select("node", "cid", "mini"))
        else:
            rows = written(branch(rest), f"paths-{level}")
    pairs = reduce(DataFrame.unionByName, found).groupBy("a", "b").agg(F.max("equal").alias("equal"))
    return pairs, reduce(DataFrame.unionByName, dense)


# --- confirmation and components --------------------------------------------------------------------


def confirm(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets are at the threshold; texts: cid, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab.forget()
        recent: dict[int, np.ndarray] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                new: dict[int, str] = {}
                for ids, column in ((part.column(0), part.column(2)), (part.column(1), part.column(3))):
                    for i, t in zip(ids.to_pylist(), column.to_pylist(), strict=True):
                        if i not in recent:
                            new[i] = t
                if len(recent) > 512:
                    recent = {i: recent[i] for c in (0, 1) for i in part.column(c).to_pylist() if i in recent}
                recent |= dict(zip(new, sets_of(list(new.values())), strict=True))
                a, b = part.column(0).to_pylist(), part.column(1).to_pylist()
                good = [k for k in range(len(a)) if shingles.linked(recent[a[k]], recent[b[k]], PERCENT)]
                yield pa.RecordBatch.from_arrays([pa.array([a[k] for k in good], pa.int64()), pa.array([b[k] for k in good], pa.int64())], ["a", "b"])

    of = lambda c: texts.select(F.col("cid").alias(c), F.col("text").alias("text_" + c))
    both = pairs.select("a", "b").join(of("a"), "a").join(of("b"), "b").select("a", "b", "text_a", "text_b")
    return both.mapInArrow(run, "a long, b long")


class Union:
    """Disjoint sets of numbers; the least of a set stands for it."""

    def __init__(self) -> None:
        self.above: dict[int, int] = {}

    def of(self, x: int) -> int:
        above, root = self.above, x
        while (up := above.get(root, root)) != root:
            root = up
        while (up := above.get(x, x)) != root:
            above[x], x = root, up
        return root

    def join(self, a: int, b: int) -> bool:
        """False if they were in one set already."""
        a, b = self.of(a), self.of(b)
        if a != b:
            self.above[max(a, b)] = min(a, b)
        return a != b


def joined_here(links: DataFrame) -> DataFrame:
    """(cid, label): the components of the links that each task holds; the ends' least number is the label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, seen = Union(), set()
        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sets.join(a, b)
                seen.update((a, b))
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.int64()), pa.array([sets.of(x) for x in seen], pa.int64())], ["cid", "label"])

    return links.select("a", "b").mapInArrow(run, "cid long, label long")


def components(links: DataFrame, n_links: int) -> tuple[DataFrame, int]:
    """((cid, label), rows) of the ends of links: the least number that each reaches.

    Tasks of about LINKS links each join what they hold. Between several tasks' results labels
    spread along what is left and jump to their own labels, so long chains shorten by half and
    more in each round; ends when nothing changes.
    """
    tasks = -(-n_links // LINKS) or 1
    labels, n = stored(joined_here(links.coalesce(tasks)), "labels")
    if tasks == 1:
        return labels, n["rows"]
    links = labels.where("cid != label").select(F.col("label").alias("x"), F.col("cid").alias("y"))
    both = written(links.unionByName(links.select(F.col("y").alias("x"), F.col("x").alias("y"))), "links")
    labels, n = stored(both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("label")).withColumnRenamed("x", "cid"), "labels")
    while True:
        of = side(labels, n["rows"])
        seen = both.join(of.withColumnsRenamed({"cid": "y", "label": "far"}), "y").groupBy("x").agg(F.min("far").alias("far"))
        spread = seen.join(of.withColumnRenamed("cid", "x"), "x").select("x", "label", F.least("label", "far").alias("next"))
        jump = spread.join(of.select(F.col("cid").alias("at"), F.col("label").alias("to")), F.col("next") == F.col("at"))
        label = F.least("next", "to")
        labels, n = stored(jump.select(F.col("x").alias("cid"), label.alias("label"), (label < F.col("label")).alias("changed")), "labels", changed=F.count_if("changed"))
        labels = labels.select("cid", "label")
        if not n["changed"]:
            return labels, n["rows"]


def across(pairs: DataFrame, labels: DataFrame, n: int) -> DataFrame:
    """Pairs whose ends are in different components."""
    of = lambda c: side(labels.select(F.col("cid").alias(c), F.col("label").alias("l" + c)), n)
    known = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left")
    return known.where(F.coalesce("la", "a") != F.coalesce("lb", "b")).select(*pairs.columns)


def settled(dense: DataFrame, labels: DataFrame, n_labels: int, texts: DataFrame) -> DataFrame | None:
    """Links (a, b) that join components inside dense groups: every member outside a group's main
    component meets all others. Both sides are dealt into blocks of about BLOCK classes and
    BLOCK_BYTES of text, and each pair of blocks is one run of rows, which a task compares on the
    full sets; sketches only leave out what is far from the threshold. None: all groups are whole.
    """
    known = dense.join(side(labels, n_labels), "cid", "left").withColumn("label", F.coalesce("label", "cid"))
    known = written(known.join(texts.select("cid", "bytes"), "cid"), "dense")
    by_label = known.groupBy("node", "label").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))
    blocks = lambda n, size: F.ceil(F.greatest(n / BLOCK, size / BLOCK_BYTES)).cast("int")
    main = by_label.groupBy("node").agg(F.max_by("label", F.struct("n", "label")).alias("main"), F.count("*").alias("parts"), F.sum("n").alias("n"), F.sum("bytes").alias("size"), F.max("n").alias("most"), F.max_by("bytes", F.struct("n", "label")).alias("inside")).where("parts > 1")
    main = main.select("node", "main", blocks(F.col("n"), F.col("size")).alias("every"), blocks(F.col("n") - F.col("most"), F.greatest(F.col("size") - F.col("inside"), F.lit(1))).alias("others"))
    main, n_main = stored(main, "dense-groups")
    if not n_main["rows"]:
        return None
    rows = known.join(side(main, n_main["rows"]), "node").withColumn("outside", F.col("label") != F.col("main"))
    deal = lambda n, seed: F.pmod(F.xxhash64("cid", F.lit(seed)), n).cast("int")
    every = rows.select("node", "cid", "mini", "label", F.lit(False).alias("query"), deal(F.col("every"), 1).alias("i"), F.explode(F.sequence(F.lit(0), F.col("others") - 1)).alias("j"))
    asked = rows.where("outside").select("node", "cid", "mini", "label", F.lit(True).alias("query"), F.explode(F.sequence(F.lit(0), F.col("every") - 1)).alias("i"), deal(F.col("others"), 2).alias("j"))
    placed = every.unionByName(asked).join(texts.select("cid", "text"), "cid").select(F.xxhash64("node", "i", "j").alias("block"), "query", "cid", "label", "mini", "text")

    def compare(held: list[tuple]) -> list[tuple[int, int]]:
        """Links between the block's queries and its members that join components; held: query, cid, label, mini, text."""
        once = {h[1]: h for h in held}  # a query is a member as well, and may be in this block twice
        rows, sets, out = list(once.values()), Union(), []
        place = {c: k for k, c in enumerate(once)}
        ids, x = np.array([r[1] for r in rows]), np.frombuffer(b"".join(r[3] for r in rows), np.uint8).reshape(-1, COORDS)
        full = sets_of([r[4] for r in rows])
        members = np.array(sorted({place[h[1]] for h in held if not h[0]}), np.int64)
        labels = np.array([r[2] for r in rows])
        asked = sorted({place[h[1]] for h in held if h[0]})
        if not len(members) or not asked:
            return out
        near = equal_bytes(x[asked], x[members])
        for q, same in zip(asked, near, strict=True):
            order = members[np.argsort(-same.astype(np.int16), kind="stable")][: int((same >= EQUAL).sum())]
            for at in range(0, len(order), 64):
                part = [int(m) for m in order[at : at + 64] if sets.of(int(labels[m])) != sets.of(int(labels[q]))]
                if not part:
                    continue
                lengths = np.array([len(full[m]) for m in part])
                flat = np.concatenate([full[m] for m in part])
                at_ = np.minimum(np.searchsorted(full[q], flat), len(full[q]) - 1)
                both = np.add.reduceat((full[q][at_] == flat).astype(np.int64), np.cumsum(np.append(0, lengths[:-1])))
                for k in np.flatnonzero(100 * both >= PERCENT * (lengths + len(full[q]) - both)):
                    if sets.join(int(labels[q]), int(labels[part[k]])):
                        out.append((int(ids[q]), int(ids[part[k]])))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab.forget()
        block, held = None, []

        def found() -> pa.RecordBatch:
            links = compare(held)
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], ["a", "b"])

        for batch in batches:
            for own, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if own != block and held:
                    yield found()
                    held = []
                block = own
                held.append(tuple(row))
        if held:
            yield found()

    return placed.repartition("block").sortWithinPartitions("block").mapInArrow(run, "a long, b long")


def link(pairs: DataFrame, dense: DataFrame, texts: DataFrame, given: DataFrame | None) -> tuple[DataFrame, int]:
    """Confirm pairs in rounds, and give the components' labels and their rows; given: links that need no trial.

    First each class is tried with the likeliest on either side of it, then all pairs that lie between
    components, then dense groups that are not whole. Pairs inside one component need no trial.
    """
    labels, n = pairs.select(F.col("a").alias("cid"), F.col("b").alias("label")).limit(0), 0
    if given is not None:
        given, n_given = stored(given, "same-id")
        labels, n = components(given, n_given["rows"])
    for round_ in range(3):
        if round_ == 0:
            near = lambda k, to: pairs.groupBy(F.col(k).alias("k")).agg(F.max_by(to, F.struct("equal", -F.col(to))).alias("to"))
            tried = near("b", "a").select(F.col("to").alias("a"), F.col("k").alias("b")).union(near("a", "b").select(F.col("k").alias("a"), F.col("to").alias("b"))).distinct()
        elif round_ == 1:
            tried = across(pairs.select("a", "b").join(side(tried, n_tried["rows"]), ["a", "b"], "left_anti"), labels, n)
        good = settled(dense, labels, n, texts) if round_ == 2 else None
        if round_ < 2:
            tried, n_tried = stored(tried, "tried")
            good = confirm(tried, texts) if n_tried["rows"] else None
        if good is not None:
            good, n_good = stored(good, "confirmed")
            if n_good["rows"]:
                labels, n = components(labels.select(F.col("label").alias("a"), F.col("cid").alias("b")).unionByName(good), n + n_good["rows"])
    return labels, n


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of docs."""
    signed = written(signatures(docs), "signatures")
    sets = signed.where("n_shingles > 0 and doc_id is not null")
    grouped = sets.groupBy("digest").agg(F.min(F.struct("doc_id", "version")).alias("least"), F.max(F.struct("mini", "roots")).alias("s"))
    # ids of classes are free of documents' ids, of which one may have several texts
    classes = written(grouped.select(F.monotonically_increasing_id().alias("cid"), F.col("least.doc_id").alias("least"), F.col("least.version").alias("version"), "digest", "s.mini", "s.roots"), "classes")
    pairs, dense = chosen_paths(classes)
    pairs = written(pairs, "pairs")
    several = sets.groupBy("doc_id").agg(F.min("digest").alias("one"), F.max("digest").alias("other")).where("one != other").select("doc_id")
    several, n_several = stored(several, "ids-of-several-texts")
    given = None
    if n_several["rows"]:
        of = sets.join(side(several, n_several["rows"]), "doc_id").select("doc_id", "digest").distinct().join(classes.select("digest", "cid"), "digest")
        first = of.groupBy("doc_id").agg(F.min("cid").alias("a"))
        given = of.join(first, "doc_id").select("a", F.col("cid").alias("b")).where("a != b")
    ends = pairs.select(F.explode(F.array("a", "b")).alias("cid")).unionByName(dense.select("cid")).distinct()
    ids, n_ids = stored(classes.select("cid", "least", "version").join(ends, "cid"), "paired")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("least"), version(), text.alias("text"), F.octet_length(text).cast("long").alias("bytes"))
    texts, n_texts = stored(rows.join(side(ids, n_ids["rows"]), ["least", "version"]).select("cid", "text", "bytes"), "texts")
    if n_texts["rows"] > n_ids["rows"]:  # rows that repeat
        texts = written(texts.dropDuplicates(["cid"]), "texts-once")
    labels, n = link(pairs, dense, texts, given)
    known = classes.select("cid", "digest", "least").join(side(labels, n), "cid", "left")
    least = known.where("label is not null").groupBy("label").agg(F.min("least").alias("component"))
    of_class = known.join(side(least, n), "label", "left").select("digest", F.coalesce("component", "least").alias("component"))
    out = signed.select("doc_id", "n_shingles", "digest").join(of_class, "digest", "left")
    own = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("component")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", own.alias("component_id"), F.coalesce(F.col("doc_id") == own, F.lit(True)).alias("kept"))


def keep_first(docs: DataFrame) -> DataFrame:
    """docs without the rows whose component has a document of a lesser id.

    Of rows that share an id the first by all their columns, as JSON, stays. Rows without an id all stay.
    A null or empty text is linked with nothing, so its row stays. Other columns may have any names.
    """
    judged = near_duplicates(docs)
    key = unused(docs, "key")
    gone, n = stored(judged.where("not kept").select(F.col("doc_id").alias(key)).distinct(), "dropped")
    keyed = docs.withColumn(key, F.col("doc_id").cast("long"))
    left = keyed.join(side(gone, n["rows"]), key, "left_anti")
    again, n = stored(keyed.where(F.col(key).isNotNull()).groupBy(key).count().where("count > 1").select(key), "repeated")
    if n["rows"]:
        place = unused(docs, "place")
        order = Window.partitionBy(key).orderBy(F.to_json(F.struct(*docs.columns)))
        once = left.join(side(again, n["rows"]), key, "left_semi").withColumn(place, F.row_number().over(order)).where(F.col(place) == 1)
        left = left.join(side(again, n["rows"]), key, "left_anti").unionByName(once.drop(place))
    return left.select(*docs.columns)
