"""Operator 10, token ids in binary: best-fit-decreasing packing with a segment-tree search.

Each partition's documents are tokenised, closed with one id, cut into pieces of at most
``capacity`` ids (no id is lost) and packed, a block of at most ``BLOCK`` ids at a time, into
rows of ids: longest piece first, each into the fullest row that has room. A segment tree over
the rooms 1..capacity finds that row. Nothing is shuffled, and a lost task is run again alone.

A row holds ``ids`` (capacity unsigned little-endian numbers, the rest filled up), ``cu_seqlens``
(cumulative lengths of its segments, from 0), ``position_resets`` (the place of each segment's
first id, where positions start from its ``starts`` again), ``doc_ids`` and ``starts``.

Defined results: a null or empty text is one segment with the closing id alone; repeated rows
are packed each; a null id is kept; an empty table gives no rows. A dtype that can't hold every id of
the vocabulary is refused. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm import vocab

CAPACITY = 2048
#: Ids that are packed together; bounds a task's memory.
BLOCK = 2_000_000
SCHEMA = "sequence_id long, n_tokens int, n_segments int, ids binary, cu_seqlens array<int>, position_resets array<int>, doc_ids array<long>, starts array<long>"


class Rooms:
    """Segment tree over rooms 0..capacity; each inner node says whether a row below has that much room."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.any = bytearray(2 * self.size)
        self.rows: list[list[int]] = [[] for _ in range(capacity + 1)]

    def add(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        i = room + self.size
        while i and not self.any[i]:
            self.any[i] = 1
            i >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """(room, row) of a row with the least room of at least need; it leaves the tree."""
        i = need + self.size
        if not self.any[i]:
            while i > 1 and (i & 1 or not self.any[i + 1]):  # up until there is something on the right
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.size:
                i = 2 * i if self.any[2 * i] else 2 * i + 1
        room = i - self.size
        row = self.rows[room].pop()
        if not self.rows[room]:
            self.any[i] = 0
            i >>= 1
            while i and not (self.any[2 * i] or self.any[2 * i + 1]):
                self.any[i] = 0
                i >>= 1
        return room, row


def best_fit_decreasing(lengths: list[int], capacity: int) -> list[list[int]]:
    """Rows of indexes into lengths; ties keep the order given."""
    tree, rows = Rooms(capacity), []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        found = tree.take(lengths[i])
        room, row = found if found else (capacity, len(rows))
        if found:
            rows[row].append(i)
        else:
            rows.append([i])
        tree.add(room - lengths[i], row)
    return rows


def token_rows(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, close: int = 50256, fill: int = 0, dtype: str = "<u2", block: int = BLOCK) -> DataFrame:
    """Packed rows of docs' token ids; dtype must hold every id of the vocabulary."""
    path = tokenizer or vocab.default_path("byte_bpe_50k.json")
    most = max(vocab.encoder(path).tokenizer.get_vocab_size(with_added_tokens=True) - 1, close, fill)
    if most > np.iinfo(dtype).max:
        raise ValueError(f"{dtype} does not hold the id {most}")

    def rows_of(held: list[tuple], first: int) -> pa.RecordBatch:
        columns: list[list] = [[] for _ in range(8)]
        for k, row in enumerate(best_fit_decreasing([len(h[2]) for h in held], capacity)):
            matrix, ends = np.full(capacity, fill, dtype), [0]
            for i in row:
                ids = held[i][2]
                matrix[ends[-1] : ends[-1] + len(ids)] = ids
                ends.append(ends[-1] + len(ids))
            for c, v in zip(columns, (first + k, ends[-1], len(row), matrix.tobytes(), ends, ends[:-1], [held[i][0] for i in row], [held[i][1] for i in row]), strict=True):
                c.append(v)
        types = (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], [f.split()[0] for f in SCHEMA.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed = vocab.encoder(path).packed
        first, held, total = TaskContext.get().partitionId() << 40, [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    ids = np.append(np.frombuffer(packed(text or ""), "<u4"), close).astype(dtype)
                    held += [(doc, b, ids[b : b + capacity]) for b in range(0, len(ids), capacity)]
                    total += len(ids)
                    if total >= block:
                        yield (out := rows_of(held, first))
                        first, held, total = first + out.num_rows, [], 0
        if held:
            yield rows_of(held, first)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SCHEMA)


def write_tokens(rows: DataFrame, path: str) -> None:
    """Store packed rows as Parquet: the id matrices are in ``ids``, one row of the matrix each."""
    rows.write.mode("errorifexists").parquet(path)


def documents_of(rows: DataFrame, dtype: str = "<u2") -> DataFrame:
    """The way back: a row for each segment, with doc_id, start and its ids (array<long>)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], []]
            for raw, ends, docs, starts in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                ids = np.frombuffer(raw, dtype)
                for k, (doc, start) in enumerate(zip(docs, starts, strict=True)):
                    for c, v in zip(out, (doc, start, ids[ends[k] : ends[k + 1]].astype(np.int64)), strict=True):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.list_(pa.int64())), strict=True)], ["doc_id", "start", "ids"])

    return rows.select("ids", "cu_seqlens", "doc_ids", "starts").mapInArrow(run, "doc_id long, start long, ids array<long>")
