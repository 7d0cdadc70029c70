"""Named conditions and states of indicators, regimes and positioning, as columns over any indicator.

A condition is false and a state has its default where a value is unknown.
"""

from __future__ import annotations

import operator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.functions.windows import all_of, c, cross_above, div, full, highest, in_a_row, lowest, prev, so_far, trailing, yes

#: Comparison and level of each named condition. Fixed values.
LEVELS = {
    "rsi_overbought": (">=", 70.0),
    "rsi_oversold": ("<=", 30.0),
    "stochrsi_overbought": (">=", 80.0),
    "stochrsi_oversold": ("<=", 20.0),
    "adx_trending": (">=", 25.0),
    "adx_ranging": ("<", 20.0),
    "aroon_up_strong": (">=", 70.0),
    "aroon_down_strong": (">=", 70.0),
    "macd_above_zero": (">", 0.0),
    "macd_below_zero": ("<", 0.0),
}
_COMPARE = {">=": operator.ge, "<=": operator.le, ">": operator.gt, "<": operator.lt}


def reaches(name: str, x: Column | str, level: float | None = None) -> Column:
    """A condition of LEVELS over an indicator, at its own level or another one."""
    sign, usual = LEVELS[name]
    return yes(_COMPARE[sign](c(x), usual if level is None else level))


def between(x, low: float, high: float) -> Column:
    return yes(c(x).between(low, high))


def rises_through(x, level: float) -> Column:
    return cross_above(x, F.lit(level))


def leads(a, b, by: float | None = None) -> Column:
    """a > b, or a is ahead by at least so much."""
    return yes(c(a) > c(b) if by is None else c(a) - c(b) >= by)


def flips(level, x, up: bool) -> Column:
    """A stop line changes sides: from above to below the price (up) or back."""
    level, x = c(level), c(x)
    return yes((prev(level) > prev(x)) & (level < x)) if up else yes((prev(level) < prev(x)) & (level > x))


def near(x, middle, most: float) -> Column:
    """Within a share of `most` of a mean."""
    return yes(div(F.abs(c(x) - c(middle)), c(middle)) <= most)


def strong_bar(up: bool, least_percent: float = 0.0) -> Column:
    move = (c("close") - c("open")) if up else (c("open") - c("close"))
    return yes((move > 0) & (100 * div(move, "open") >= least_percent))


def above_for(x, level, bars: int = 1) -> Column:
    return in_a_row(c(x) > (F.lit(level) if isinstance(level, int | float) else c(level)), bars)


def aligned(*votes: Column | str) -> Column:
    """All votes say yes; a vote is Boolean or 0 / 1, and a direction such as -1 is refused."""

    def said(vote: Column) -> Column:
        v = vote.cast("double")
        stray = F.raise_error(F.lit("a vote must be yes or no, not a direction"))
        return F.when(v.isNull() | (v == 0), F.lit(False)).when(v == 1, F.lit(True)).otherwise(stray.cast("boolean"))

    return all_of(*[said(c(v)) for v in votes])


def run_length(df: DataFrame, condition: Column, out: str = "run") -> DataFrame:
    """For how many rows a condition has held without a break, 0 where it does not hold."""
    holds = yes(condition)
    broken = df.withColumn("_breaks", F.sum((~holds).cast("int")).over(so_far()))
    island = Window.partitionBy("symbol", "_breaks").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    return broken.withColumn(out, F.when(holds, F.sum(holds.cast("long")).over(island)).otherwise(0)).drop("_breaks")


# Regimes


def first_of(default: str, *cases: tuple[str, Column]) -> Column:
    """The name of the first case that holds."""
    out = F.lit(default)
    for name, condition in reversed(cases):
        out = F.when(yes(condition), name).otherwise(out)
    return out


def strength_regime(x, trend: float = 25.0, quiet: float = 20.0) -> Column:
    return first_of("transition", ("range", c(x) < quiet), ("trend", c(x) >= trend))


def rolling_level(x, n: int, q: float, least: int | None = None) -> Column:
    """Quantile of the last n values, once there are `least` of them."""
    over = trailing(n)
    return F.when(F.count(c(x)).over(over) >= (n if least is None else least), F.percentile(c(x), F.lit(q)).over(over))


def below_own_level(x, n: int = 200, q: float = 0.8) -> Column:
    return yes(c(x) < rolling_level(x, n, q, max(20, n // 2)))


def above_own_level(x, n: int = 200, q: float = 0.4) -> Column:
    return yes(c(x) > rolling_level(x, n, q, max(20, n // 2)))


def share_below(x, of, most: float = 0.012) -> Column:
    return yes(div(x, of) < most)


def share_above(x, of, least: float = 0.003) -> Column:
    return yes(div(x, of) > least)


def slopes(x, up: bool, lookback: int = 5) -> Column:
    return yes(c(x) > prev(x, lookback)) if up else yes(c(x) < prev(x, lookback))


# Positioning


def crowding(ratio, long: float = 2.5, short: float = 0.5) -> Column:
    return first_of("neutral", ("crowded_short", c(ratio) <= short), ("crowded_long", c(ratio) >= long))


def taker_state(buy, sell, level: float = 1.5) -> Column:
    ratio = div(buy, sell, 1.0)
    return first_of("balanced", ("aggressive_sell", ratio <= 1.0 / level), ("aggressive_buy", ratio >= level))


def flow_divergence(x, flow, n: int = 20) -> Column:
    """The price is at its extreme of n bars and the flow is not at its own."""
    bearish = (c(x) == highest(x, n)) & (c(flow) < highest(flow, n))
    bullish = (c(x) == lowest(x, n)) & (c(flow) > lowest(flow, n))
    return first_of("none", ("bearish", bearish), ("bullish", bullish))


def basis_bps(spot, future) -> Column:
    return 1e4 * div(c(future) - c(spot), spot, 0.0)


def funding_state(rate, high_bps: float = 5.0, low_bps: float = -5.0) -> Column:
    """From the plain ratio; a rate beyond 1 can't be one and is refused."""
    bps = F.when(F.abs(c(rate)) > 1, F.raise_error(F.lit("a funding rate must be the plain ratio")).cast("double")).otherwise(c(rate) * 1e4)
    return first_of("neutral", ("bearish_squeeze", bps <= low_bps), ("bullish_squeeze", bps >= high_bps))


def recent(x, n: int) -> Column:
    """Sum of what is known of the last n rows."""
    return F.sum(c(x)).over(trailing(n))


def lopsided(a, b, n: int = 12) -> Column:
    return div(recent(a, n) - recent(b, n), recent(a, n) + recent(b, n), 0.0)


def piles_up(x, level: float, n: int = 12) -> Column:
    return yes(recent(x, n) >= level)


def large_print(x, n: int = 96, q: float = 0.95) -> Column:
    return yes(c(x) >= full(F.percentile(c(x), F.lit(q)).over(trailing(n)), x, n))
