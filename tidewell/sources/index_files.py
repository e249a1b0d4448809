"""Files of a code index in protobuf's wire format, read to rows and written from them, a task for each share of the files.

Messages and their field numbers are those of the public index format: Index (documents 2, external symbols 3), Document (path 1, occurrences 2, symbols 3), Occurrence (range 1,
symbol 2, roles 3), SymbolInformation (symbol 1, relationships 4), Relationship (symbol 1, implementation 3, type definition 4). Other fields are passed over by their wire type.
"""

from __future__ import annotations

import io
import re
import tempfile
from collections.abc import Iterator
from itertools import groupby
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Field numbers.
DOCUMENTS, EXTERNAL = 2, 3
PATH, OCCURRENCES, SYMBOLS = 1, 2, 3
RANGE, SYMBOL, ROLES = 1, 2, 3
NAME, RELATIONSHIPS = 1, 4
TARGET, IMPLEMENTATION, TYPE_DEFINITION = 1, 3, 4
#: Rows of a batch that is read, and documents of one that is written.
BATCH_ROWS, BATCH_DOCUMENTS = 10_000, 128
ROWS = "index string, kind string, file string, seq long, symbol string, line long, roles int, target string, implements boolean, type_of boolean"


def varint(data: memoryview, at: int) -> tuple[int, int]:
    """(number, place after it)."""
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 127) << shift
        if byte < 128:
            return value, at
        shift += 7


def fields(data: memoryview) -> Iterator[tuple[int, int | memoryview]]:
    """(field number, value) of a message: numbers, or the bytes of what has a length."""
    at = 0
    while at < len(data):
        tag, at = varint(data, at)
        kind = tag & 7
        if kind == 0:
            value, at = varint(data, at)
        elif kind == 2:
            size, at = varint(data, at)
            if at + size > len(data):
                raise ValueError("the message is cut off")
            value, at = data[at : at + size], at + size
        elif kind in (1, 5):
            size = 8 if kind == 1 else 4
            value, at = data[at : at + size], at + size
        else:
            raise ValueError(f"wire type {kind}")
        yield tag >> 3, value


def _text(value: memoryview) -> str:
    return bytes(value).decode("utf-8", "replace")


def _relations(data: memoryview) -> Iterator[tuple[str, str, bool, bool]]:
    """(symbol, target, implements, type_of) of a symbol's relationships."""
    name, found = "", []
    for number, value in fields(data):
        if number == NAME:
            name = _text(value)
        elif number == RELATIONSHIPS:
            of = dict(fields(value))
            found.append((_text(of.get(TARGET, memoryview(b""))), bool(of.get(IMPLEMENTATION, 0)), bool(of.get(TYPE_DEFINITION, 0))))
    return ((name, *r) for r in found)


def document_rows(index: str, number: int, value: memoryview) -> list[tuple]:
    """One top-level message's occurrences and relationships, as rows of ROWS; external symbols have no file."""
    if number == EXTERNAL:
        return [(index, "relation", None, None, s, None, None, t, i, d) for s, t, i, d in _relations(value)]
    out: list[tuple] = []
    inside = list(fields(value))
    path = next((_text(v) for n, v in inside if n == PATH), "")
    seq = 0
    for n, v in inside:
        if n == OCCURRENCES:
            symbol, line, roles = "", 0, 0
            for k, x in fields(v):
                if k == SYMBOL:
                    symbol = _text(x)
                elif k == ROLES:
                    roles = x
                elif k == RANGE and not isinstance(x, int) and len(x):
                    line = varint(x, 0)[0]
            out.append((index, "occurrence", path, seq, symbol, line, roles, None, None, None))
            seq += 1
        elif n == SYMBOLS:
            out += [(index, "relation", path, None, s, None, None, t, i, d) for s, t, i, d in _relations(v)]
    return out


def messages(source: BinaryIO) -> Iterator[tuple[int, memoryview]]:
    """(field number, bytes) of a file's documents and external symbols, each read when it is asked for; what else the file has is passed over."""

    def taken(n: int) -> bytes:
        data = source.read(n)
        if len(data) < n:
            raise ValueError("the message is cut off")
        return data

    def number(data: bytes) -> int:
        while data[-1] > 127:
            data += taken(1)
        return varint(memoryview(data), 0)[0]

    while head := source.read(1):
        tag = number(head)
        kind = tag & 7
        if kind == 0:
            number(taken(1))
        elif kind in (1, 5):
            taken(8 if kind == 1 else 4)
        elif kind != 2:
            raise ValueError(f"wire type {kind}")
        elif tag >> 3 in (DOCUMENTS, EXTERNAL):
            yield tag >> 3, memoryview(taken(number(taken(1))))
        else:
            left = number(taken(1))
            while left:
                left -= len(taken(min(left, 1 << 20)))


def _opened(path: str) -> BinaryIO:
    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(re.sub("^file:/(?!/)", "file:///", path))
    return store.open_input_stream(at, buffer_size=1 << 20)


def read_index(spark: SparkSession, root: str) -> DataFrame:
    """All index files below root as ROWS: kind is ``occurrence`` (file, seq, symbol, line, roles) or ``relation`` (file, symbol, target, implements, type_of).

    A task reads a share of the files, a document at a time; its rows wait in a temporary file of its own until the file is known to be whole. A file that is cut off, or no such message, is one row
    of kind ``broken``. Files of a store that Arrow can't open come through Spark's reader, each whole.
    """
    types = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.string(), pa.bool_(), pa.bool_())
    names = [f.split()[0] for f in ROWS.split(", ")]
    schema = pa.schema(list(zip(names, types, strict=True)))

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [[]] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], schema=schema)

    def parsed(path: str, source: BinaryIO, kept: BinaryIO) -> None:
        rows: list[tuple] = []
        with pa.ipc.new_stream(kept, schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            for number, value in messages(source):
                rows += document_rows(path, number, value)
                if len(rows) >= BATCH_ROWS:
                    for at in range(0, len(rows), BATCH_ROWS):
                        out.write_batch(batch_of(rows[at : at + BATCH_ROWS]))
                    rows = []
            out.write_batch(batch_of(rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n, path in enumerate(batch.column(0).to_pylist()):
                with _opened(path) if batch.num_columns == 1 else io.BytesIO(batch.column(1)[n].as_py()) as source, tempfile.TemporaryFile() as kept:
                    try:
                        parsed(path, source, kept)
                    except (ValueError, IndexError, TypeError, AttributeError):
                        yield batch_of([(path, "broken", *[None] * 8)])
                        continue
                    kept.seek(0)
                    with pa.ipc.open_stream(kept) as rows:
                        yield from rows

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.scip").load(root)
    return files.select("path", *([] if _reachable(root) else ["content"])).mapInArrow(run, ROWS)


def _reachable(root: str) -> bool:
    """Whether Arrow opens what is below root."""
    from pyarrow import fs

    try:
        return bool(fs.FileSystem.from_uri(re.sub("^file:/(?!/)", "file:///", root)))
    except (ValueError, OSError, NotImplementedError):
        return False


def _number(value: int) -> bytes:
    out = bytearray()
    while value > 127:
        out.append(value & 127 | 128)
        value >>= 7
    return bytes([*out, value])


def _field(number: int, value: int | str | bytes) -> bytes:
    if isinstance(value, int):
        return _number(number << 3) + _number(value)
    raw = value.encode() if isinstance(value, str) else value
    return _number(number << 3 | 2) + _number(len(raw)) + raw


def document_bytes(path: str, occurrences: list, relations: list) -> bytes:
    """A document; occurrences: (symbol, line, roles), relations: (symbol, target, implements, type_of)."""
    out = [_field(PATH, path)]
    out += [_field(OCCURRENCES, _field(RANGE, _number(line) + _number(0) + _number(1)) + _field(SYMBOL, symbol) + _field(ROLES, roles)) for symbol, line, roles in occurrences]
    out += [_field(SYMBOLS, _field(NAME, s) + _field(RELATIONSHIPS, _field(TARGET, t) + _field(IMPLEMENTATION, int(i)) + _field(TYPE_DEFINITION, int(d)))) for s, t, i, d in relations]
    return b"".join(out)


def write_index(documents: DataFrame, root: str) -> int:
    """Write documents (index, file, occurrences array<struct<symbol,line,roles>>, relations array<struct<symbol,target,implements,type_of>>) as ``<root>/<index>.scip``, and say how many files.

    Documents are written one after another in the order of their files, so a task holds few of them, however many an index has. A file that a lost task has begun is written anew.
    """
    from pyarrow import fs

    store, base = fs.FileSystem.from_uri(root)
    store.create_dir(base, recursive=True)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in range(0, batch.num_rows, 16):
                part = batch.slice(n, 16)
                bodies = [
                    _field(DOCUMENTS, document_bytes(row["file"], [(o["symbol"], o["line"], o["roles"]) for o in row["occurrences"] or []], [(r["symbol"], r["target"], r["implements"], r["type_of"]) for r in row["relations"] or []]))
                    for row in part.to_pylist()
                ]
                yield pa.RecordBatch.from_arrays([part.column("index"), part.column("file"), pa.array(bodies, pa.binary())], ["index", "file", "body"])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, below = fs.FileSystem.from_uri(root)
        rows = ((i, body) for batch in batches for i, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True))
        for index, own in groupby(rows, lambda row: row[0]):
            with at.open_output_stream(f"{below}/{index}.scip") as f:
                for _, body in own:
                    f.write(body.as_buffer())
            yield pa.RecordBatch.from_arrays([pa.array([f"{index}.scip"])], ["name"])

    few = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = documents.sparkSession.conf.get(few)
    documents.sparkSession.conf.set(few, str(BATCH_DOCUMENTS))
    try:
        encoded = documents.select(F.col("index").cast("string").alias("index"), "file", "occurrences", "relations").mapInArrow(encode, "index string, file string, body binary")
        return encoded.repartition("index").sortWithinPartitions("index", "file").select("index", "body").mapInArrow(write, "name string").agg(F.count("*")).first()[0]
    finally:
        documents.sparkSession.conf.set(few, before)
