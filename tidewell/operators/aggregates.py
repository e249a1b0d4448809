"""Aggregates of one's own, in two phases and a tree: tasks fold rows into states, states are merged in groups, a key's states never all in one task.

An ``Aggregate`` says how states are made, grown by a batch of rows, merged and read. States travel as bytes.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from typing import Any, Protocol

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType, IntegerType, StructField, StructType

#: Keys whose states a task holds before it hands them on.
HELD = 50_000


class Aggregate(Protocol):
    """States must be small and picklable; merge() must not depend on the order but for rounding."""

    fields: list[str]

    def zero(self) -> Any: ...
    def grow(self, state: Any, values: np.ndarray) -> Any: ...
    def merge(self, a: Any, b: Any) -> Any: ...
    def read(self, state: Any) -> list[float | None]: ...


class Covariance:
    """Moments of d columns in one pass (count, means, sums of products about the means), from which come each pair's covariance, slope and correlation.

    Rows with a null in any column are left out. Without rows all are null; slope and correlation are null where a variance is 0.
    """

    def __init__(self, names: list[str]):
        self.pairs = [(i, j) for i in range(len(names)) for j in range(i)]
        self.d = len(names)
        self.fields = ["n"] + [f"{kind}_{names[i]}_{names[j]}" for i, j in self.pairs for kind in ("covar_pop", "regr_slope", "corr")]

    def zero(self):
        return 0, np.zeros(self.d), np.zeros((self.d, self.d))

    def grow(self, state, values: np.ndarray):
        values = values[~np.isnan(values).any(axis=1)]
        if not len(values):
            return state
        mean = values.mean(axis=0)
        off = values - mean
        return self.merge(state, (len(values), mean, off.T @ off))

    def merge(self, a, b):
        (n, x, s), (m, y, t) = a, b
        if not n or not m:
            return b if m else a
        gap = y - x
        return n + m, x + gap * (m / (n + m)), s + t + np.outer(gap, gap) * (n * m / (n + m))

    def read(self, state) -> list[float | None]:
        n, _, s = state
        out: list[float | None] = [float(n)]
        for i, j in self.pairs:  # the slope of the later column over the earlier one
            flat, both = s[j, j] <= 0, s[i, i] * s[j, j] <= 0
            out += [None] * 3 if not n else [s[i, j] / n, None if flat else s[i, j] / s[j, j], None if both else s[i, j] / (s[i, i] * s[j, j]) ** 0.5]
        return out


def aggregate(df: DataFrame, keys: list[str], columns: list[str], how: Aggregate, fan: int = 32) -> DataFrame:
    """keys and how's fields, for each group of rows: a task folds its rows of a key into one state, and ``fan`` tasks a key merge those before the last."""
    named = df.select(*keys, *[F.col(c).cast("double").alias(f"__v{i}") for i, c in enumerate(columns)])
    own = [named.schema[k] for k in keys]
    partial = StructType([*own, StructField("__part", IntegerType()), StructField("__state", BinaryType())])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, Any] = {}
        part = TaskContext.get().partitionId() % fan

        def states() -> pa.RecordBatch:
            columns_ = [pa.array([k[i] for k in held], batch.schema.field(i).type) for i in range(len(keys))]
            return pa.RecordBatch.from_arrays([*columns_, pa.array([part] * len(held), pa.int32()), pa.array([pickle.dumps(s) for s in held.values()], pa.binary())], partial.names)

        for batch in batches:
            of = list(zip(*(batch.column(i).to_pylist() for i in range(len(keys))), strict=True)) if keys else [()] * batch.num_rows
            values = np.column_stack([batch.column(len(keys) + i).to_numpy(zero_copy_only=False).astype(float) for i in range(len(columns))])
            places: dict[tuple, list[int]] = {}
            for i, k in enumerate(of):
                places.setdefault(k, []).append(i)
            for k, at in places.items():
                held[k] = how.grow(held.get(k) or how.zero(), values[at])
            if len(held) > HELD:
                yield states()
                held.clear()
        if held:
            yield states()

    def merged(states: list[bytes]) -> Any:
        out = how.zero()
        for s in states:
            out = how.merge(out, pickle.loads(s))
        return out

    def in_part(key: tuple, table: pa.Table) -> pa.Table:
        state = pickle.dumps(merged(table.column("__state").to_pylist()))
        return pa.table([*[pa.array([k.as_py()], table.schema.field(n).type) for k, n in zip(key, names, strict=True)], pa.array([state], pa.binary())], names=[*names, "__state"])

    def last(key: tuple, table: pa.Table) -> pa.Table:
        found = how.read(merged(table.column("__state").to_pylist()))
        return pa.table([*[pa.array([k.as_py()], table.schema.field(n).type) for k, n in zip(key, keys, strict=True)], *[pa.array([x], pa.float64()) for x in found]], names=[*keys, *how.fields])

    names = [*keys, "__part"]
    some = named.mapInArrow(fold, partial).groupBy(*names).applyInArrow(in_part, partial)
    return some.groupBy(*keys).applyInArrow(last, StructType([*own, *[StructField(f, DoubleType()) for f in how.fields]]))
