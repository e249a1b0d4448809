"""Intervals and positions: overlap joins (D22), innermost enclosing ranges and edges of an external index (K11), calls."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- overlap join ---------------------------------------------------------------------------------


def length_class(low: Column, high: Column) -> Column:
    """The least k with high - low < 2 ** k, for a closed interval."""
    return F.when(high <= low, 0).otherwise(F.length(F.bin(high - low))).cast("int")


def in_bins(rows: DataFrame, low: str, high: str, classes: list[int], own: str) -> DataFrame:
    """rows once for each class k that is the greater of theirs and one of ``classes``, and each bin of 2 ** k numbers that they touch: two at most."""
    k = F.explode(F.array_distinct(F.transform(F.array(*[F.lit(c) for c in classes]), lambda c: F.greatest(c, F.col(own))))).alias("__k")
    cut = rows.select("*", k)
    shift = lambda c: F.call_function("shiftright", F.col(c), F.col("__k"))
    return cut.select("*", F.explode(F.sequence(shift(low), shift(high))).alias("__bin"))


def overlap_join(left: DataFrame, right: DataFrame, on: list[str], left_span: tuple[str, str], right_span: tuple[str, str]) -> DataFrame:
    """Pairs of rows equal in ``on`` whose closed intervals of whole numbers overlap; column names must differ but for ``on``.

    Intervals are put into bins as long as the longer one's length class, so each lies in two bins at most, and a pair is met in the bin
    of the later start alone: an equi-join without a nested loop, whatever the lengths. Only the classes that occur (64 at most) go by the
    driver. Intervals with a null or reversed bound overlap nothing.
    """
    (a, b), (c, d) = left_span, right_span
    left = left.where(F.col(a) <= F.col(b)).withColumn("__cl", length_class(F.col(a), F.col(b)))
    right = right.where(F.col(c) <= F.col(d)).withColumn("__cr", length_class(F.col(c), F.col(d)))
    classes = [[r[0] for r in df.select(k).distinct().collect()] for df, k in ((left, "__cl"), (right, "__cr"))]
    x, y = in_bins(left, a, b, classes[1], "__cl"), in_bins(right, c, d, classes[0], "__cr")
    pairs = x.join(y, [*on, "__k", "__bin"]).where((F.col("__k") == F.greatest("__cl", "__cr")) & (F.col(a) <= F.col(d)) & (F.col(c) <= F.col(b)))
    first = F.call_function("shiftright", F.greatest(F.col(a), F.col(c)), F.col("__k"))
    return pairs.where(F.col("__bin") == first).drop("__k", "__bin", "__cl", "__cr")


# --- innermost enclosing range ----------------------------------------------------------------------


def enclosing(ranges: DataFrame, points: DataFrame, file: str = "file") -> DataFrame:
    """Points (file, at, point) with ``name``, the innermost of the file's ranges (file, low, high, name) that holds the position; null: none.

    Ranges are nested or apart, as blocks of code are; bounds count as inside, and of equal ranges the last by name is the innermost. A file's ranges and points stand in one sorted partition, and one
    sweep over it keeps the ranges that are open on a stack, so memory goes with the depth of nesting and not with the file.
    """
    none = lambda kind: F.lit(None).cast(kind)
    opened = ranges.select(F.col(file).alias("file"), F.col("low").cast("long").alias("at"), F.lit(0).alias("turn"), (-F.col("high").cast("long")).alias("reach"), "name", none("string").alias("point"))
    asked = points.select(F.col(file).alias("file"), F.col("at").cast("long").alias("at"), F.lit(1).alias("turn"), F.lit(0).cast("long").alias("reach"), none("string").alias("name"), F.col("point").cast("string").alias("point"))
    placed = opened.unionByName(asked).repartition("file").sortWithinPartitions("file", "at", "turn", "reach", "name")

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, stack = None, []
        for batch in batches:
            out: list[tuple] = []
            for file_, at, turn, reach, name, point in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if file_ != current:
                    current, stack = file_, []
                while stack and stack[-1][0] < at:
                    stack.pop()
                if turn == 0:
                    stack.append((-reach, name))
                else:
                    out.append((file_, at, point, stack[-1][1] if stack else None))
            columns = list(zip(*out, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.string(), pa.string()), strict=True)], ["file", "at", "point", "name"])

    return placed.mapInArrow(sweep, "file string, at long, point string, name string").withColumnRenamed("file", file)


# --- an external index's edges -----------------------------------------------------------------------


def local_name(symbol: Column) -> Column:
    """What stands behind the last slash or space of a symbol, without the suffix; the whole symbol if that is nothing."""
    last = F.element_at(F.split(F.trim(symbol), r"[\s/]+", -1), -1)
    return F.coalesce(F.nullif(F.regexp_replace(last, r"[.#()]+$", ""), F.lit("")), symbol)


def kind_of_symbol(symbol: Column) -> Column:
    """A coarse kind by the suffix of a descriptor."""
    return F.when(F.endswith(symbol, F.lit("#")), "class").when(F.endswith(symbol, F.lit(".")), "field").when(F.endswith(symbol, F.lit(")")), "function").when(F.endswith(symbol, F.lit("/")), "namespace").otherwise("unknown")


def definitions(occurrences: DataFrame) -> DataFrame:
    """Symbol, file, line and kind of each symbol's first definition; occurrences: file, seq (order of files and places), symbol, line, roles (bit 1: definition)."""
    own = occurrences.where((F.col("roles").bitwiseAND(1) != 0) & (F.col("symbol") != ""))
    first = own.groupBy("symbol").agg(F.min_by(F.struct("file", "line"), F.struct("file", "seq")).alias("d"))
    return first.select("symbol", F.col("d.file").alias("file"), F.coalesce("d.line", F.lit(0)).alias("line"), kind_of_symbol(F.col("symbol")).alias("kind"))


EDGE = ["from_file", "from_symbol", "to_file", "to_symbol", "edge_type", "symbol"]


def import_edges(occurrences: DataFrame, defined: DataFrame) -> DataFrame:
    """An edge for each symbol that a file uses and another file defines."""
    used = occurrences.where((F.col("roles").bitwiseAND(1) == 0) & (F.col("symbol") != "")).select("file", "symbol").distinct()
    to = defined.select("symbol", F.col("file").alias("to_file"))
    name = local_name(F.col("symbol"))
    return used.join(to, "symbol").where("file <> to_file").select(F.col("file").alias("from_file"), name.alias("from_symbol"), "to_file", name.alias("to_symbol"), F.lit("imports").alias("edge_type"), "symbol")


def inheritance_edges(relations: DataFrame, defined: DataFrame) -> DataFrame:
    """Implements and extends; relations: file (null: external), symbol, target, implements, type_of. Files are those of definitions, else the row's own, else the target's symbol stands for one."""
    mine = defined.select("symbol", F.col("file").alias("__f"))
    theirs = defined.select(F.col("symbol").alias("target"), F.col("file").alias("__t"))
    kind = F.when(F.col("implements"), "implements").when(F.col("type_of"), "extends")
    rows = relations.where(kind.isNotNull() & (F.col("symbol") != "") & (F.col("target") != "")).join(mine, "symbol", "left").join(theirs, "target", "left")
    out = rows.select(F.coalesce("__f", "file").alias("from_file"), local_name(F.col("symbol")).alias("from_symbol"), F.coalesce("__t", "target").alias("to_file"), local_name(F.col("target")).alias("to_symbol"), kind.alias("edge_type"), "symbol")
    return out.where("from_file is not null")


# --- calls -------------------------------------------------------------------------------------------


def call_edges(declared: DataFrame, calls: DataFrame, imports: DataFrame) -> DataFrame:
    """(from_file, from_symbol, to_file, to_symbol) of calls, by two joins.

    declared: file, low, high, name (the lines of a declaration); calls: file, at (line), callee; imports: file, name, source_file. A call is
    made by the innermost declaration around it (``<module>`` outside all). Its callee is one that the file declares, else one that it imports from a file which declares it, else the
    declaration of that name in the first file by name that has one, else nothing, and there is no edge. Equal edges are one.
    """
    named = enclosing(declared, calls.withColumn("point", F.col("callee")))
    sites = named.select(F.col("file").alias("from_file"), F.coalesce("name", F.lit("<module>")).alias("from_symbol"), F.col("point").alias("to_symbol")).distinct()
    own = declared.select(F.col("file").alias("from_file"), F.col("name").alias("to_symbol"), F.col("file").alias("local")).distinct()
    taken = imports.select(F.col("file").alias("from_file"), F.col("name").alias("to_symbol"), F.col("source_file").alias("f")).join(declared.select(F.col("file").alias("f"), F.col("name").alias("to_symbol")).distinct(), ["f", "to_symbol"])
    taken = taken.groupBy("from_file", "to_symbol").agg(F.min("f").alias("imported"))
    anywhere = declared.groupBy(F.col("name").alias("to_symbol")).agg(F.min("file").alias("global"))
    found = sites.join(own, ["from_file", "to_symbol"], "left").join(taken, ["from_file", "to_symbol"], "left").join(anywhere, "to_symbol", "left")
    return found.select("from_file", "from_symbol", F.coalesce("local", "imported", "global").alias("to_file"), "to_symbol").where("to_file is not null")
