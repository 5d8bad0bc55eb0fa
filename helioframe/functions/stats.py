"""Aggregate expressions with defined results on degenerate groups."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import col, finite


def corr(x, y, over=None) -> Column:
    """Pearson correlation of the complete pairs; NULL when either side is constant.

    The built-in ``corr`` raises a division error on constant input under ANSI mode.
    """
    x, y = col(x), col(y)
    both = x.isNotNull() & y.isNotNull()
    xx, yy = F.when(both, x), F.when(both, y)
    parts = [F.covar_pop(xx, yy), F.stddev_pop(xx), F.stddev_pop(yy)]
    if over is not None:
        parts = [p.over(over) for p in parts]
    cov, sx, sy = parts
    return F.when((sx > 0) & (sy > 0), cov / (sx * sy))


def slope(y, x, over=None) -> Column:
    """Least-squares slope of y on x; NULL without spread in x."""
    e = F.regr_slope(col(y), col(x).cast("double"))
    return e if over is None else e.over(over)


def deviation(values: Column) -> Column:
    """Population deviation of an array of doubles, by updates in its order: the last bit does not depend on how rows were dealt."""
    zero = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("sq"))

    def step(s, x):
        n, off = s["n"] + 1.0, x - s["mean"]
        mean = s["mean"] + off / n
        return F.struct(n.alias("n"), mean.alias("mean"), (s["sq"] + off * (x - mean)).alias("sq"))

    return F.aggregate(values, zero, step, lambda s: F.sqrt(s["sq"] / F.greatest(s["n"], F.lit(1.0))))


def shape(expr: Column) -> Column:
    """Skewness / kurtosis of constant groups is 0 at feature output."""
    return F.coalesce(finite(expr), F.lit(0.0))


def mean_or_zero(expr: Column) -> Column:
    return F.coalesce(F.avg(expr), F.lit(0.0))
