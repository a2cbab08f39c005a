"""Forecast accuracy as aggregate expressions over (actual, forecast) columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from larder.functions.calendar import as_col


def non_zero(x: Column) -> Column:
    """The value, or NULL when it is zero: a safe denominator."""
    return F.when(x != 0, x)


def smape(actual, forecast) -> Column:
    """Mean symmetric absolute percentage error; a day with both values zero counts as no error."""
    y, f = as_col(actual), as_col(forecast)
    scale = F.abs(y) + F.abs(f)
    return F.avg(F.when(scale == 0, F.lit(0.0)).otherwise(2.0 * F.abs(f - y) / scale)) * 100.0


def wape(actual, forecast) -> Column:
    """Absolute error as a share of demand; NULL when there was no demand."""
    y, f = as_col(actual), as_col(forecast)
    return 100.0 * F.sum(F.abs(f - y)) / non_zero(F.sum(F.abs(y)))


def mase(actual, forecast, scale) -> Column:
    """Mean absolute error over the in-sample seasonal error ``scale`` (one value per group)."""
    y, f = as_col(actual), as_col(forecast)
    return F.avg(F.abs(f - y)) / non_zero(F.max(as_col(scale)))


def bias(actual, forecast) -> Column:
    return F.avg(as_col(forecast) - as_col(actual))


def coverage(actual, lower, upper) -> Column:
    """Share of actuals inside the interval."""
    return F.avg(as_col(actual).between(as_col(lower), as_col(upper)).cast("double"))


def zero_share(units) -> Column:
    """Share of zero-demand days; zero for an empty group."""
    return F.coalesce(F.avg((as_col(units) == 0).cast("double")), F.lit(0.0))


def spread(x) -> Column:
    """Sample standard deviation, zero with fewer than two values."""
    return F.coalesce(F.stddev_samp(as_col(x)), F.lit(0.0))
