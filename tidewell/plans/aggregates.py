"""Queries of aggregates of one's own."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell.operators.aggregates import Covariance, aggregate
from tidewell.plans.registry import query
from tidewell.session import table


@query("""SELECT l_returnflag, count(*)::DOUBLE AS n, round(covar_pop(l_quantity::DOUBLE, l_discount::DOUBLE), 6) AS covar, round(regr_slope(l_extendedprice::DOUBLE, l_quantity::DOUBLE) / 1000, 6) AS slope, round(corr(l_extendedprice::DOUBLE, l_quantity::DOUBLE), 6) AS corr FROM lineitem GROUP BY 1""")
def p9_covariance(spark, sf):
    """One-pass moments of three columns by return flag."""
    lines = table(spark, sf, "lineitem")
    out = aggregate(lines, ["l_returnflag"], ["l_discount", "l_quantity", "l_extendedprice"], Covariance(["discount", "quantity", "price"]))
    return out.select("l_returnflag", "n", F.round("covar_pop_quantity_discount", 6).alias("covar"), F.round(F.col("regr_slope_price_quantity") / 1000, 6).alias("slope"), F.round("corr_price_quantity", 6).alias("corr"))
