"""Overlap joins and enclosing ranges against brute force."""

import random

import pytest

from tidewell.operators import ranges as R


def test_overlap_join_equals_all_pairs(spark):
    rng = random.Random(5)
    span = lambda: (lambda low: (low, low + rng.choice([0, 0, 1, 3, 60, 5000, -2])))(rng.randint(-300, 300))
    left = [(rng.choice("ab"), i, *span()) for i in range(150)] + [("a", 900, None, 5), ("a", 901, 3, None), (None, 902, 0, 9)]
    right = [(rng.choice("abc"), i, *span()) for i in range(150)] + [("a", 900, None, None), (None, 901, 0, 9)]
    x = spark.createDataFrame(left, "k string, i long, a long, b long")
    y = spark.createDataFrame(right, "k string, j long, c long, d long")
    joined = R.overlap_join(x, y, ["k"], ("a", "b"), ("c", "d"))
    got = [(r.i, r.j) for r in joined.collect()]
    want = [(i, j) for k, i, a, b in left for m, j, c, d in right if k and k == m and None not in (a, b, c, d) and a <= b and c <= d and a <= d and c <= b]
    assert len(got) == len(set(got)) and set(got) == set(want) and want
    assert "NestedLoop" not in joined._jdf.queryExecution().toString() and "Cartesian" not in joined._jdf.queryExecution().toString()
    assert R.overlap_join(x.limit(0), y, ["k"], ("a", "b"), ("c", "d")).count() == 0


def nested(rng, low, high, depth, out, names):
    """Random blocks inside low..high, nested or apart."""
    at = low
    while at < high and depth < 6:
        start = at + rng.randint(0, 5)
        end = start + rng.randint(0, max(0, (high - start) // 2))
        if end > high:
            return
        out.append((start, end, f"n{next(names):04d}"))
        if rng.random() < 0.7:
            nested(rng, start + 1, end - 1, depth + 1, out, names)
        at = end + 1


@pytest.mark.parametrize("seed", [1, 2])
def test_innermost_range(spark, seed):
    rng, names, files = random.Random(seed), iter(range(10**4)), {}
    for f in "xyz":
        nested(rng, 0, 200, 0, files.setdefault(f, []), names)
    points = [(f, rng.randint(0, 210), str(i)) for i, f in enumerate(rng.choices("xyzw", k=400))]
    ranges = spark.createDataFrame([(f, *r) for f, rows in files.items() for r in rows], "file string, low long, high long, name string")
    got = {r.point: r.name for r in R.enclosing(ranges, spark.createDataFrame(points, "file string, at long, point string")).collect()}
    for f, at, point in points:
        around = [(low, -high, name) for low, high, name in files.get(f, []) if low <= at <= high]
        assert got[point] == (max(around)[2] if around else None)
    assert R.enclosing(ranges.limit(0), ranges.limit(0).selectExpr("file", "low as at", "name as point")).count() == 0


def test_names_and_kinds_of_symbols(spark):
    rows = spark.createDataFrame([("scip npm p m/Shop#",), ("scip npm p m/Shop#pay().",), ("p m/`x.ts`/",), ("local 3",)], "s string")
    assert [r[0] for r in rows.select(R.local_name(rows.s)).collect()] == ["Shop", "Shop#pay", "p m/`x.ts`/", "3"]
    assert [r[0] for r in rows.select(R.kind_of_symbol(rows.s)).collect()] == ["class", "field", "namespace", "unknown"]
