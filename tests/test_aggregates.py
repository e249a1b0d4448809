"""Aggregates of one's own against numpy."""

import numpy as np
import pytest

from tidewell.operators.aggregates import Covariance, aggregate


def test_moments_by_key(spark):
    rng = np.random.default_rng(3)
    rows = [(k, i % 7, float(x), float(y)) for i, (k, x, y) in enumerate(zip(rng.choice(["a", "b"], 500, p=[0.9, 0.1]).tolist(), rng.normal(1e6, 3, 500), rng.normal(0, 2, 500), strict=True))]
    rows += [(None, 1, 2.0, 3.0), (None, 1, 4.0, 3.0), ("c", 0, None, 1.0)]
    df = spark.createDataFrame(rows, "k string, j int, x double, y double").repartition(5)
    got = {r.k: r for r in aggregate(df, ["k"], ["x", "y"], Covariance(["x", "y"]), fan=2).collect()}
    for k in ("a", "b"):
        x, y = np.array([r[2:] for r in rows if r[0] == k]).T
        assert got[k].n == len(x) and got[k].covar_pop_y_x == pytest.approx(np.cov(x, y, bias=True)[0, 1], rel=1e-6) and got[k].corr_y_x == pytest.approx(np.corrcoef(x, y)[0, 1], rel=1e-6)
    assert got[None].n == 2 and got[None].regr_slope_y_x == 0 and got[None].corr_y_x is None
    assert got["c"].n == 0 and got["c"].covar_pop_y_x is None
    assert aggregate(df.limit(0), ["k"], ["x", "y"], Covariance(["x", "y"])).count() == 0
    assert aggregate(df, [], ["x", "y"], Covariance(["x", "y"])).first().n == 502
