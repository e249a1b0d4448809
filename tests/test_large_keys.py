"""Queries over tables whose keys are as large as those of a copy of sixty parts."""

import duckdb
import pytest

from tidewell.plans import catalogue


@pytest.fixture
def lines(spark, tmp_path):
    """Supplier 5 has the number 1000005, which is also a part's."""
    rows = [(1, 5, 1, "A"), (2, 5, 2, "N"), (3, 6, 2, "R"), (4, 7, 1_000_005, "A"), (5, 8, 1_000_007, "A"), (6, 9, 1_000_008, "N")]
    spark.createDataFrame(rows, "l_orderkey long, l_suppkey long, l_partkey long, l_returnflag string").write.parquet(f"{tmp_path}/lineitem.parquet")
    return str(tmp_path)


def test_a_part_is_no_supplier_of_its_number(spark, lines):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{lines}/lineitem.parquet/*.parquet'")
    want = con.execute(catalogue.oracle_sql()["g8_blast_gate"]).fetchall()
    assert [tuple(r) for r in catalogue.queries()["g8_blast_gate"](spark, lines).select("affected", "blocked").collect()] == want == [(2, False)]
