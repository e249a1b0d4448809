"""Operator 6, best-fit packing: bin completion by branch and bound over a length histogram.

Every document is tokenised, closed with one id and cut into pieces of at most ``capacity``
ids. How pieces fit together depends on their lengths alone, and there are at most ``capacity``
different lengths, so the search runs on the histogram of lengths, whose size does not grow with
the corpus: a *pattern* is a set of lengths that fill one sequence, used some number of times.
Pieces are then dealt to the patterns' places by their rank among those of equal length.

The search takes the longest remaining piece, enumerates undominated fillings around it, least
waste first, uses the chosen one as often as the counts allow, and goes on; it backs up when the
waste so far shows that the incumbent cannot be beaten. Best-fit-decreasing gives the first
incumbent; the search ends at the lower bound or after ``NODES`` steps with the best found.

Defined results: a null or empty text is one piece that holds only the closing id. Rows that
repeat or share an id are packed each. Very long texts are tokenised whole, and only then cut. An empty table gives no rows.
Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell.llm import vocab
from tidewell.session import written

CAPACITY = 2048
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = PIECES + ", sequence_id long, offset long"
NODES = 3_000
#: Undominated fillings that are kept for each step of the search.
WIDTH = 3


def pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, close: int = 0) -> DataFrame:
    """A row for each piece of each document."""
    path = tokenizer or vocab.default_path("word_bpe_49k.json")
    end = int(close).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed = vocab.encoder(path).packed
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                rows = []
                for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    ids = packed(text or "") + end
                    for k, b in enumerate(range(0, len(ids), 4 * capacity)):
                        one = ids[b : b + 4 * capacity]
                        rows.append((doc, k, b // 4, len(one) // 4, zlib.crc32(one)))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, PIECES)


# --- the search ------------------------------------------------------------------------------


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """No packing has fewer sequences: by total size, and by pieces that can't share one."""
    best = -(-sum(k * v for k, v in counts.items()) // capacity)
    lengths = sorted(counts)
    for small in [0, *(k for k in lengths if k <= capacity // 2)]:
        # pieces over capacity - small are alone among those of at least small; medium ones can't pair with those
        alone = sum(v for k, v in counts.items() if k > capacity - small)
        half = [(k, v) for k, v in counts.items() if capacity // 2 < k <= capacity - small]
        rest = sum(k * v for k, v in counts.items() if small <= k <= capacity // 2)
        free = sum((capacity - k) * v for k, v in half)
        best = max(best, alone + sum(v for _, v in half) + max(0, -(-(rest - free) // capacity)))
    return best


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit-decreasing over the histogram: patterns with how often each is used.

    Open sequences of equal content are one entry; a length's pieces go to the fullest that fit.
    """
    opened: dict[int, dict[tuple[int, ...], int]] = {}
    rooms: list[int] = []
    done: dict[tuple[int, ...], int] = {}

    def put(room: int, pattern: tuple[int, ...], n: int) -> None:
        if room == 0:
            done[pattern] = done.get(pattern, 0) + n
            return
        if room not in opened:
            opened[room] = {}
            rooms.insert(bisect_left(rooms, room), room)
        opened[room][pattern] = opened[room].get(pattern, 0) + n

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            i = bisect_left(rooms, length)
            if i == len(rooms):
                each = capacity // length
                if left >= each:
                    put(capacity - each * length, (length,) * each, left // each)
                if left % each:
                    put(capacity - left % each * length, (length,) * (left % each), 1)
                break
            room = rooms[i]
            pattern, n = opened[room].popitem()
            each = min(room // length, left)
            used = min(n, left // each)
            if n > used:
                opened[room][pattern] = n - used
            elif not opened[room]:
                del opened[room], rooms[i]
            put(room - each * length, pattern + (length,) * each, used)
            left -= used * each
    for room in opened.values():
        for pattern, n in room.items():
            done[pattern] = done.get(pattern, 0) + n
    return list(done.items())


def fillings(lengths: list[int], counts: dict[int, int], room: int, width: int = WIDTH, steps: int = 600) -> list[tuple[int, ...]]:
    """Undominated sets of remaining lengths (ascending list) for the room, least waste first.

    A filling is dominated if a further piece fits beside it, or if one of its pieces could give
    way to a longer one that is left and still fits: the longer one is never easier to place later.
    """
    found: dict[tuple[int, ...], int] = {}
    budget = [steps]

    def left(k: int, chosen: list[int]) -> int:
        return counts.get(k, 0) - chosen.count(k)

    def maximal(chosen: list[int], waste: int) -> bool:
        if waste == 0:
            return True
        smallest = next((k for k in lengths if left(k, chosen) > 0), None)
        if smallest is not None and smallest <= waste:
            return False
        for k in set(chosen):
            i = bisect_left(lengths, k + 1)
            while i < len(lengths) and lengths[i] <= k + waste:
                if left(lengths[i], chosen) > 0:
                    return False
                i += 1
        return True

    def grow(chosen: list[int], rest: int, top: int) -> bool:
        """True once enough fillings without waste are known."""
        if budget[0] <= 0:
            return True
        budget[0] -= 1
        if rest and rest <= top and left(rest, chosen) > 0:
            found[tuple(chosen + [rest])] = 0
            if sum(w == 0 for w in found.values()) >= width:
                return True
        i = bisect_left(lengths, min(rest, top) + 1) - 1
        grew = False
        while i >= 0:
            k = lengths[i]
            if k != rest and left(k, chosen) > 0:
                grew = True
                if grow(chosen + [k], rest - k, k):
                    return True
            i -= 1
        if not grew and (rest == 0 or maximal(chosen, rest)):
            found.setdefault(tuple(chosen), rest)
        return False

    grow([], room, room)
    if not found:
        chosen, rest = [], room  # the budget ended first: best fit
        while (i := bisect_left(lengths, rest + 1) - 1) >= 0:
            while i >= 0 and left(lengths[i], chosen) <= 0:
                i -= 1
            if i < 0:
                break
            chosen.append(lengths[i])
            rest -= lengths[i]
        found[tuple(chosen)] = rest
    return sorted(found, key=lambda p: (found[p], len(p), [-k for k in p]))[:width]


def complete(counts: dict[int, int], capacity: int = CAPACITY, nodes: int = NODES) -> list[tuple[tuple[int, ...], int]]:
    """Patterns and how often each is used, so that all counts are used up in few sequences."""
    counts = {int(k): int(v) for k, v in counts.items() if v > 0}
    best = best_fit(counts, capacity)
    fewest, bound, total = sum(n for _, n in best), lower_bound(counts, capacity), sum(k * v for k, v in counts.items())
    if fewest == bound or not counts:
        return best
    remaining, lengths = dict(counts), sorted(counts)
    trail: list[list] = []  # [options yet to try, pattern, times, waste before]
    waste, used = 0, 0

    def options() -> list[tuple[int, ...]]:
        top = lengths[-1]
        remaining[top] -= 1
        found = fillings(lengths, remaining, capacity - top)
        remaining[top] += 1
        return [(top, *p) for p in found][::-1]

    def apply(pattern: tuple[int, ...]) -> int:
        need = {k: pattern.count(k) for k in set(pattern)}
        times = min(remaining[k] // n for k, n in need.items())
        for k, n in need.items():
            remaining[k] -= times * n
            if not remaining[k]:
                lengths.pop(bisect_left(lengths, k))
        return times

    def undo(pattern: tuple[int, ...], times: int) -> None:
        for k in set(pattern):
            if not remaining[k]:
                lengths.insert(bisect_left(lengths, k), k)
            remaining[k] += times * pattern.count(k)

    todo = options()
    while nodes > 0:
        nodes -= 1
        if todo:
            pattern = todo.pop()
            times = apply(pattern)
            gone = times * (capacity - sum(pattern))
            trail.append([todo, pattern, times, gone])
            waste, used = waste + gone, used + times
            if not lengths and used < fewest:
                fewest, best = used, [(p, t) for _, p, t, _ in trail]
                if fewest == bound:
                    break
            # sequences that the rest needs at least, if none of it were wasted
            if lengths and -(-(total + waste) // capacity) < fewest:
                todo = options()
                continue
            todo = []
        if not trail:
            break
        if not todo:
            todo, pattern, times, gone = trail.pop()
            undo(pattern, times)
            waste, used = waste - gone, used - times
    return best


def places(patterns: list[tuple[tuple[int, ...], int]], capacity: int) -> dict[str, np.ndarray]:
    """Ranks of each length from ``low`` on go to sequences from ``first`` on, at ``offset``; sorted by key."""
    taken: dict[int, int] = {}
    rows, first = [], 0
    for pattern, times in patterns:
        at = 0
        for k in pattern:
            low = taken.get(k, 0)
            rows.append((k, low, first, at))
            taken[k], at = low + times, at + k
        first += times
    rows.sort()
    columns = np.array(rows, np.int64).reshape(-1, 4)
    return {"key": columns[:, 0] << 48 | columns[:, 1], "low": columns[:, 1], "first": columns[:, 2], "offset": columns[:, 3]}


def pack(cut: DataFrame, capacity: int = CAPACITY, nodes: int = NODES) -> DataFrame:
    """sequence_id and offset for rows with a length; cut: a stored table, which is read twice.

    A piece's rank among those of its length comes from two steps, so that a length that very
    many pieces share is counted in many tasks: ranks inside (length, slice), and the number of
    pieces in the slices before.
    """
    spark = cut.sparkSession
    slices = max(16, int(spark.conf.get("spark.sql.shuffle.partitions")))
    counts = {r[0]: r[1] for r in cut.groupBy("length").count().collect()}  # at most `capacity` rows
    plan = places(complete(counts, capacity, nodes), capacity)
    sliced = cut.withColumn("slice", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(slices)).cast("int"))
    before = sliced.groupBy("length", "slice").agg(F.count("*").alias("n"))
    before = before.select("length", "slice", (F.sum("n").over(Window.partitionBy("length").orderBy("slice")) - F.col("n")).alias("before"))
    inside = F.row_number().over(Window.partitionBy("length", "slice").orderBy("doc_id", "piece", "ids_crc32"))
    ranked = sliced.withColumn("rank", inside).join(before, ["length", "slice"]).withColumn("rank", F.col("rank") + F.col("before") - 1)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            at = np.searchsorted(plan["key"], length << 48 | rank, side="right") - 1
            sequence = plan["first"][at] + rank - plan["low"][at]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(5)), pa.array(sequence), pa.array(plan["offset"][at])], [f.split()[0] for f in PACKED.split(", ")])

    return ranked.select(*[f.split()[0] for f in PIECES.split(", ")], "rank").mapInArrow(deal, PACKED)


def best_fit_packing(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, close: int = 0, nodes: int = NODES) -> DataFrame:
    """A row for each piece of docs' texts with its sequence and place there."""
    return pack(written(pieces(docs, tokenizer, capacity, close), "pieces"), capacity, nodes)
