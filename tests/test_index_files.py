"""Index files in binary, against bytes made by hand."""

import io

import pytest
from pyspark.sql import functions as F

from tidewell.sources import index_files as I  # noqa: E741


def test_numbers_and_fields():
    for n in (0, 1, 127, 128, 300, 2**31, 2**63 - 1):
        raw = I._number(n)
        assert I.varint(memoryview(raw), 0) == (n, len(raw))
    data = bytes([0x08, 0x96, 0x01]) + bytes([0x12, 0x02]) + b"hi" + bytes([0x1D, 1, 2, 3, 4]) + bytes([0x21, *range(8)])
    assert [(k, v if isinstance(v, int) else bytes(v)) for k, v in I.fields(memoryview(data))] == [(1, 150), (2, b"hi"), (3, bytes([1, 2, 3, 4])), (4, bytes(range(8)))]
    with pytest.raises(ValueError, match="cut off"):
        list(I.fields(memoryview(bytes([0x12, 0x09]) + b"hi")))


def test_files_are_read_to_rows(spark, tmp_path):
    one = I._field(1, b"metadata") + I._field(I.DOCUMENTS, I._field(4, "typescript") + I.document_bytes("src/a.ts", [("m/A#", 300, 1), ("m/b().", 0, 8)], [("m/A#", "m/B#", True, False)]))
    external = I._field(I.EXTERNAL, I._field(I.NAME, "ext#") + I._field(I.RELATIONSHIPS, I._field(I.TARGET, "m/A#") + I._field(I.TYPE_DEFINITION, 1)))
    (tmp_path / "one.scip").write_bytes(one + external)
    (tmp_path / "none.scip").write_bytes(b"")
    (tmp_path / "bad.scip").write_bytes(bytes([0x12, 0x7F]) + b"abc")
    (tmp_path / "other.txt").write_bytes(b"no index")
    rows = {(r.kind, r.file, r.seq, r.symbol, r.line, r.roles, r.target, r.implements, r.type_of) for r in I.read_index(spark, f"file://{tmp_path}").collect()}
    assert rows == {
        ("occurrence", "src/a.ts", 0, "m/A#", 300, 1, None, None, None), ("occurrence", "src/a.ts", 1, "m/b().", 0, 8, None, None, None),
        ("relation", "src/a.ts", None, "m/A#", None, None, "m/B#", True, False), ("relation", None, None, "ext#", None, None, "m/A#", False, True), ("broken", None, None, None, None, None, None, None, None),
    }


def document(n: int) -> bytes:
    return I._field(I.DOCUMENTS, I.document_bytes(f"src/{n}.ts", [("m/A#", line, 1) for line in range(40)], [("m/A#", "m/B#", True, False)]))


def test_documents_are_read_one_at_a_time():
    class Source(io.BytesIO):
        most = 0

        def read(self, n=-1):
            assert n > 0  # never the rest of the file
            self.most = max(self.most, n)
            return super().read(n)

    data = b"".join(document(n) for n in range(500)) + I._field(9, b"x" * (3 << 20)) + I._field(8, 300) + I._field(I.EXTERNAL, I._field(I.NAME, "ext#"))
    source = Source(data)
    found = list(I.messages(source))
    assert [n for n, _ in found] == [I.DOCUMENTS] * 500 + [I.EXTERNAL] and source.most <= 1 << 20
    assert sum(len(I.document_rows("i", *m)) for m in found) == 500 * 41


def test_large_files_are_read_in_batches_and_broken_ones_give_no_rows(spark, tmp_path):
    whole = b"".join(document(n) for n in range(400))
    (tmp_path / "whole.scip").write_bytes(whole)
    (tmp_path / "cut.scip").write_bytes(whole[:-1])
    got = {(r["index"].rsplit("/", 1)[1], r["kind"]): r["n"] for r in I.read_index(spark, f"file://{tmp_path}").groupBy("index", "kind").agg(F.count("*").alias("n")).collect()}
    assert got == {("whole.scip", "occurrence"): 16000, ("whole.scip", "relation"): 400, ("cut.scip", "broken"): 1}
    assert not I._reachable("viewfs://store/in")


def test_an_index_of_many_documents_is_written_in_their_order(spark, tmp_path):
    made = spark.range(700).select(F.format_string("part%d", F.col("id") % 2).alias("index"), F.format_string("f%03d", "id").alias("file"))
    made = made.withColumn("occurrences", F.array(F.struct(F.lit("s").alias("symbol"), F.lit(5).alias("line"), F.lit(1).alias("roles")))).withColumn("relations", F.expr("CAST(NULL AS array<struct<symbol:string,target:string,implements:boolean,type_of:boolean>>)"))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert I.write_index(made, f"file://{tmp_path}/out") == 2 and spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before
    with (tmp_path / "out/part1.scip").open("rb") as f:
        assert [I.document_rows("i", *m)[0][2] for m in I.messages(f)] == [f"f{n:03}" for n in range(1, 700, 2)]
