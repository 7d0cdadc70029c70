"""Candlestick patterns and conditions as Boolean columns; unknown counts as false."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemill.functions.windows import c, div, highest, in_a_row, lowest, prev, trailing, yes

O, H, L, C, V = "open", "high", "low", "close", "volume"


def body() -> Column:
    return F.abs(c(C) - c(O))


def span() -> Column:
    return c(H) - c(L)


def upper() -> Column:
    return c(H) - F.greatest(O, C)


def lower() -> Column:
    return F.least(O, C) - c(L)


def share(x: Column) -> Column:
    return div(x, span(), 0.0)


def rising() -> Column:
    return yes(c(C) > c(O))


def falling() -> Column:
    return yes(c(C) < c(O))


def doji(most: float = 0.1) -> Column:
    return yes(share(body()) <= most)


def marubozu(least: float = 0.95) -> Column:
    return yes(share(body()) >= least)


def spinning_top(most: float = 0.3) -> Column:
    return yes((share(body()) <= most) & (share(upper()) >= 0.2) & (share(lower()) >= 0.2))


def hammer(long: float = 2.0, short: float = 0.3) -> Column:
    return yes((lower() >= long * body()) & (upper() <= short * body()) & (body() > 1e-12))


def inverted_hammer(long: float = 2.0, short: float = 0.3) -> Column:
    return yes((upper() >= long * body()) & (lower() <= short * body()) & (body() > 1e-12))


def shooting_star() -> Column:
    return inverted_hammer() & falling()


def hanging_man() -> Column:
    return hammer() & falling()


def engulfing(bullish: bool) -> Column:
    if bullish:
        return yes((prev(C) < prev(O)) & (c(C) > c(O)) & (c(O) <= prev(C)) & (c(C) >= prev(O)))
    return yes((prev(C) > prev(O)) & (c(C) < c(O)) & (c(O) >= prev(C)) & (c(C) <= prev(O)))


def harami(bullish: bool) -> Column:
    if bullish:
        return yes((prev(C) < prev(O)) & (c(C) > c(O)) & (c(O) >= prev(C)) & (c(C) <= prev(O)))
    return yes((prev(C) > prev(O)) & (c(C) < c(O)) & (c(O) <= prev(C)) & (c(C) >= prev(O)))


def piercing_line() -> Column:
    middle = (prev(O) + prev(C)) / 2
    return yes((prev(C) < prev(O)) & (c(C) > c(O)) & (c(O) < prev(C)) & (c(C) > middle) & (c(C) < prev(O)))


def dark_cloud_cover() -> Column:
    middle = (prev(O) + prev(C)) / 2
    return yes((prev(C) > prev(O)) & (c(C) < c(O)) & (c(O) > prev(C)) & (c(C) < middle) & (c(C) > prev(O)))


def tweezer(x: str, tolerance: float = 0.001) -> Column:
    return yes(F.abs(c(x) - prev(x)) <= tolerance * (c(x) + prev(x)) / 2)


def star(morning: bool, big: float = 0.6) -> Column:
    """A big bar, a small one, and a big one back over the middle of the first; needs a column `_body_share`."""
    b = lambda k: prev("_body_share", k)
    middle = (prev(O, 2) + prev(C, 2)) / 2
    first, last = (prev(C, 2) < prev(O, 2), c(C) > c(O)) if morning else (prev(C, 2) > prev(O, 2), c(C) < c(O))
    beyond = c(C) > middle if morning else c(C) < middle
    return yes(first & (b(2) >= big) & (b(1) <= 0.3) & last & (c("_body_share") >= big) & beyond)


def three_in_a_row(up: bool, big: float = 0.6) -> Column:
    """Three big bars one way with closes going on; needs a column `_body_share`."""
    way = (lambda k: prev(C, k) > prev(O, k)) if up else (lambda k: prev(C, k) < prev(O, k))
    now = c(C) > c(O) if up else c(C) < c(O)
    closes = (c(C) > prev(C)) & (prev(C) > prev(C, 2)) if up else (c(C) < prev(C)) & (prev(C) < prev(C, 2))
    return yes(now & way(1) & way(2) & (c("_body_share") >= big) & (prev("_body_share", 1) >= big) & (prev("_body_share", 2) >= big) & closes)


def gap(up: bool, percent: float = 0.5) -> Column:
    move = 100 * div(c(O) - prev(C), prev(C))
    return yes((move if up else -move) >= percent)


def bounce(ma, long: bool = True) -> Column:
    ma = c(ma)
    return yes((c(L) <= ma) & (c(C) > ma)) if long else yes((c(H) >= ma) & (c(C) < ma))


def breakout(up: bool, n: int = 20) -> Column:
    return yes(c(C) > highest(H, n, 1)) if up else yes(c(C) < lowest(L, n, 1))


def consolidation(n: int = 20, most: float = 0.03) -> Column:
    high, low = highest(H, n), lowest(L, n)
    return yes(div(high - low, (high + low) / 2) <= most)


def volume_at_least(ref, times: float = 1.5) -> Column:
    return yes(c(V) >= times * c(ref))


def volume_below(ref, rows: int = 3, times: float = 1.0) -> Column:
    return in_a_row(c(V) < times * c(ref), rows)


def divergence(price, other, n: int = 20, bullish: bool = True) -> Column:
    pick = lowest if bullish else highest
    beyond = c(other) > pick(other, n) if bullish else c(other) < pick(other, n)
    return yes((c(price) == pick(price, n)) & beyond)


def new_extreme(x: str, n: int, high: bool, above: bool) -> Column:
    """The extreme of the last n rows, above or below that of n rows ago."""
    at = c(x) == (highest(x, n) if high else lowest(x, n))
    return yes(at & (c(x) > prev(x, n) if above else c(x) < prev(x, n)))


def sweep(high: bool, n: int = 20) -> Column:
    """Beyond the extreme of the n rows before, but closed within."""
    level = highest(H, n, 1) if high else lowest(L, n, 1)
    return yes((c(H) > level) & (c(C) <= level)) if high else yes((c(L) < level) & (c(C) >= level))


def hour_between(start: int, end: int, shift_hours: int = 8) -> Column:
    """Hour of day in [start, end), over midnight too, in a zone that many hours from UTC."""
    hour = F.pmod(F.floor(F.unix_timestamp("ts") / 3600) + shift_hours, F.lit(24))
    return (hour >= start) & (hour < end) if start <= end else (hour >= start) | (hour < end)


def away_from_hours(hours: tuple[int, ...] = (0, 8, 16), minutes: int = 15) -> Column:
    """More than so many minutes from each of the hours of the day, around the clock."""
    minute = F.pmod(F.floor(F.unix_timestamp("ts") / 60), F.lit(1440))
    gaps = [F.least(F.abs(minute - 60 * h), 1440 - F.abs(minute - 60 * h)) for h in hours]
    return (F.least(*gaps) if len(gaps) > 1 else gaps[0]) > minutes


def retest(n: int = 20, rows: int = 5) -> Column:
    """Back at the level of a breakout of the last rows; needs a column `_level` (the level at breakouts)."""
    level = F.last("_level", True).over(trailing(rows + 1))
    return yes((c(L) <= level * 1.005) & (c(C) >= level))
