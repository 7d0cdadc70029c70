"""Selection over a cross-section with one row per symbol: augment, filter, rank, take the top.

Steps are methods that return a new `Universe`; each is one narrow transformation, or a join to a
table with one row per key, so that no step multiplies rows.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


class Universe:
    def __init__(self, df: DataFrame) -> None:
        self.df = df

    def _new(self, df: DataFrame) -> Universe:
        return Universe(df)

    def where(self, condition: Column) -> Universe:
        """Rows for which the condition is known to hold."""
        return self._new(self.df.filter(F.coalesce(condition, F.lit(False))))

    def between(self, column: str, low: float | None = None, high: float | None = None, absolute: bool = False) -> Universe:
        """Bounds on a column (or its absolute value); unknown values go."""
        v = F.abs(F.col(column)) if absolute else F.col(column)
        got = v.isNotNull()
        if low is not None:
            got &= v >= low
        if high is not None:
            got &= v <= high
        return self.where(got)

    def only(self, symbols: Iterable[str]) -> Universe:
        return self.where(F.col("symbol").isin(*symbols))

    def exclude(self, symbols: Iterable[str]) -> Universe:
        return self.where(~F.col("symbol").isin(*symbols))

    def suffix(self, endings: Iterable[str], exclude: bool = False) -> Universe:
        hit = F.lit(False)
        for e in endings:
            hit |= F.col("symbol").endswith(e)
        return self.where(~hit if exclude else hit)

    def has_any(self, column: str, wanted: Iterable[str], exclude: bool = False) -> Universe:
        """Membership in a column of arrays."""
        hit = F.coalesce(F.arrays_overlap(F.col(column), F.array(*[F.lit(w) for w in wanted])), F.lit(False))
        return self.where(~hit if exclude else hit)

    def augment(self, other: DataFrame, columns: list[str], key: str = "symbol", newest: str | None = None) -> Universe:
        """Columns of another table by key, of the newest row of a key; every row stays once."""
        order = F.col(newest) if newest else F.struct(*columns)
        one = other.groupBy(key).agg(F.max_by(F.struct(*columns), order).alias("_v")).select(key, "_v.*")
        return self._new(self.df.join(one, key, "left"))

    def with_column(self, name: str, value: Column) -> Universe:
        return self._new(self.df.withColumn(name, value))

    def top(self, column: str, n: int, ascending: bool = False) -> Universe:
        """The n best rows, ties by symbol; unknown values last."""
        order = F.col(column).asc_nulls_last() if ascending else F.col(column).desc_nulls_last()
        return self._new(self.df.orderBy(order, "symbol").limit(n))

    def best_per(self, group: str, column: str) -> Universe:
        place = F.row_number().over(Window.partitionBy(group).orderBy(F.col(column).desc_nulls_last(), "symbol"))
        return self._new(self.df.withColumn("_k", place).filter("_k = 1").drop("_k"))

    def ranked(self, column: str, tie: str) -> Universe:
        """Number the (few) rows left from 1 by falling column, then falling tie."""
        return self._new(self.df.withColumn("rank", F.row_number().over(Window.orderBy(F.col(column).desc_nulls_last(), F.col(tie).desc_nulls_last(), "symbol"))))


def bull_ratio(bull: str = "n_bull", bear: str = "n_bear") -> Column:
    return F.try_divide(F.col(bull), F.col(bull) + F.col(bear))


def spread_bps(bid: str, ask: str) -> Column:
    return 1e4 * F.try_divide(F.col(ask) - F.col(bid), (F.col(ask) + F.col(bid)) / 2)


def annual_rate(rate: Column, hours: Column) -> Column:
    return rate * F.try_divide(F.lit(8760.0), hours)


# Sizing as columns


def risk_size(equity: Column, entry: Column, stop: Column, risk: float = 0.01) -> Column:
    return F.coalesce(F.try_divide(equity * risk, F.abs(entry - stop)), F.lit(0.0))


def kelly(win_rate: Column, win: Column, loss: Column, fraction: float = 0.5) -> Column:
    b = F.try_divide(win, loss)
    value = (win_rate - F.try_divide(1 - win_rate, b)) * fraction
    return F.when(win <= 0, 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(value, F.lit(0.0)))))


def whole_steps(quantity: Column, step: Column) -> Column:
    return F.floor(F.try_divide(quantity, step)) * step


def stop_price(entry: Column, long: Column, percent: float) -> Column:
    return F.when(long, entry * (1 - percent / 100)).otherwise(entry * (1 + percent / 100))


def reward_ratio(entry: Column, stop: Column, target: Column) -> Column:
    return F.try_divide(F.abs(target - entry), F.abs(entry - stop))


def grid_levels(center: Column, percent: float, n: int) -> Column:
    """Array of n + 1 prices evenly spaced over center +- percent."""
    low, step = center * (1 - percent / 100), center * (2 * percent / 100) / n
    return F.transform(F.sequence(F.lit(0), F.lit(n)), lambda k: low + step * k)


# Scores and verdicts as columns


def weighted_score(rules: dict[str, tuple[Column, float]]) -> Column:
    parts = [F.when(F.coalesce(c, F.lit(False)), F.lit(float(w))).otherwise(0.0) for c, w in rules.values()]
    return sum(parts[1:], parts[0])


def vote(signals: list[Column]) -> Column:
    """(positive - negative) / number, rounded to two places."""
    v = [F.coalesce(s, F.lit(0.0)) for s in signals]
    parts = [F.signum(x) for x in v]
    return F.round(sum(parts[1:], parts[0]) / len(v), 2)


def verdict(score: Column, strong: float = 8.0, candidate: float = 5.0, watch: float = 2.0, skip: float = -2.0) -> Column:
    return F.when(score >= strong, "STRONG_CANDIDATE").when(score >= candidate, "CANDIDATE").when(score >= watch, "WATCHLIST").when(score >= skip, "SKIP").otherwise("AVOID")


def rescaled(score: Column, low: float, high: float, to_low: float = 0.0, to_high: float = 100.0) -> Column:
    return F.least(F.lit(to_high), F.greatest(F.lit(to_low), to_low + (score - low) / (high - low) * (to_high - to_low)))
