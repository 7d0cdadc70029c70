"""Windows and safe arithmetic that all bar operators share.

Bars are rows of (symbol, ts, ...). All trailing windows run over one symbol in order of ts, so that
one shuffle by symbol serves every operator of a query. Missing values are NULL, never NaN, and a
window of n rows gives NULL until it holds n values.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

def series() -> WindowSpec:
    """The rows of a symbol in order of time."""
    return Window.partitionBy("symbol").orderBy("ts")


def c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def trailing(n: int, skip: int = 0) -> WindowSpec:
    """The n rows that end `skip` rows before this one."""
    return series().rowsBetween(-(n - 1) - skip, -skip)


def so_far() -> WindowSpec:
    return series().rowsBetween(Window.unboundedPreceding, 0)


def full(value: Column, x: Column | str, n: int, skip: int = 0) -> Column:
    """The value where the window holds n values of x, else NULL."""
    return F.when(F.count(c(x)).over(trailing(n, skip)) == n, value)


def mean(x, n: int, skip: int = 0) -> Column:
    return full(F.avg(c(x)).over(trailing(n, skip)), x, n, skip)


def total(x, n: int) -> Column:
    return full(F.sum(c(x)).over(trailing(n)), x, n)


def highest(x, n: int, skip: int = 0) -> Column:
    return full(F.max(c(x)).over(trailing(n, skip)), x, n, skip)


def lowest(x, n: int, skip: int = 0) -> Column:
    return full(F.min(c(x)).over(trailing(n, skip)), x, n, skip)


def deviation(x, n: int) -> Column:
    """Population standard deviation."""
    return full(F.stddev_pop(c(x)).over(trailing(n)), x, n)


def quantile(x, n: int, q: float) -> Column:
    """Linear interpolation between values."""
    return full(F.percentile(c(x), F.lit(q)).over(trailing(n)), x, n)


def prev(x, k: int = 1) -> Column:
    return F.lag(c(x), k).over(series())


def div(a, b, fill: float | None = None) -> Column:
    """a / b; `fill` where that is undefined, window warm-up included."""
    got = F.try_divide(c(a).cast("double"), c(b).cast("double"))
    return got if fill is None else F.coalesce(got, F.lit(float(fill)))


def change(x, k: int = 1) -> Column:
    return div(x, prev(x, k)) - 1


def yes(condition: Column) -> Column:
    """A condition that is false where it is unknown."""
    return F.coalesce(condition, F.lit(False))


def cross_above(a, b) -> Column:
    a, b = c(a), c(b)
    return yes((prev(a) <= prev(b)) & (a > b))


def cross_below(a, b) -> Column:
    a, b = c(a), c(b)
    return yes((prev(a) >= prev(b)) & (a < b))


def in_a_row(condition: Column, n: int) -> Column:
    """True where the condition has held for n rows."""
    return yes(F.sum(yes(condition).cast("int")).over(trailing(n)) == n)


def no_nan(x) -> Column:
    x = c(x).cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def all_of(*conditions: Column) -> Column:
    return reduce(lambda a, b: a & b, [yes(x) for x in conditions])


def rounded(df: DataFrame, digits: int = 8) -> DataFrame:
    """Doubles rounded for results that are compared between engines; -0.0 becomes 0.0."""
    return df.select(*[(F.round(F.col(f"`{n}`"), digits) + F.lit(0.0)).alias(n) if t == "double" else F.col(f"`{n}`") for n, t in df.dtypes])
