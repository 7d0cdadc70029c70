"""Sizes, stops and limits of positions as columns; `long` is true for a long and false for a short position."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemill.functions.windows import c, div, trailing


def _held(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(value, F.lit(high)))


def volatility_size(equity, atr, price, risk: float = 0.01, distance: float = 2.0) -> Column:
    """Notional that loses a share `risk` of the equity over `distance` mean ranges."""
    return F.when(c(atr) > 0, div(c(equity) * risk, c(atr) * distance) * c(price)).otherwise(0.0)


def added_size(first, adds, ratio: float = 0.5, most: int = 2) -> Column:
    """Notional of a further entry; 0 before the first and after the last one."""
    return F.when(c(adds).between(1, most), c(first) * ratio).otherwise(0.0)


def inverse_size(balance, atr_percent, risk_percent: float = 2.0, least: float = 1.0, most: float = 5.0) -> Column:
    """(notional, leverage, risk): leverage falls with volatility, to one place."""
    leverage = F.when(c(atr_percent) > 0, _held(F.round(F.try_divide(c(balance) * risk_percent / c(atr_percent), c(balance)), 1), least, most)).otherwise(least)
    notional = F.when(c(atr_percent) > 0, F.round(c(balance) * leverage, 2)).otherwise(0.0)
    return F.struct(notional.alias("notional"), leverage.alias("leverage"), F.round(notional * c(atr_percent) / 100, 2).alias("risk"))


def adaptive_stop(change_week=None, days_listed=None, usual: float = 5.0, wild: float = 12.0, new: float = 8.0, wild_over: float = 50.0, new_days: int = 30) -> Column:
    """Percent of a stop: wider for what has been listed lately, then for what moves a lot."""
    out = F.lit(usual)
    if change_week is not None:
        out = F.when(F.abs(c(change_week)) > wild_over, wild).otherwise(out)
    return out if days_listed is None else F.when(c(days_listed) < new_days, new).otherwise(out)


def capped_leverage(leverage, days_listed, atr_percent, most: float = 5.0, least: float = 1.0, new_most: float = 2.0, wild_most: float = 3.0, new_days: int = 30, wild_over: float = 8.0) -> Column:
    cap = F.least(
        F.lit(most), F.when(c(days_listed) < new_days, new_most).otherwise(most), F.when(c(atr_percent) > wild_over, wild_most).otherwise(most)
    )
    return F.greatest(F.lit(least), F.least(c(leverage), cap))


def stop_at(entry, long, distance) -> Column:
    """A stop a distance away from the entry, against the position."""
    return F.round(F.when(c(long), c(entry) - c(distance)).otherwise(c(entry) + c(distance)), 8)


def ratcheted(stop: Column, long, before: Column) -> Column:
    """A stop that never gives way; 0 or NULL before the first one."""
    tighter = F.when(c(long), F.greatest(stop, before)).otherwise(F.least(stop, before))
    return F.round(F.when(before > 0, tighter).otherwise(stop), 8)


def trailing_stop(price, long, percent: float, before: Column) -> Column:
    return ratcheted(c(price) * F.when(c(long), 1 - percent / 100).otherwise(1 + percent / 100), long, before)


def bars_stop(long, n: int, before: Column) -> Column:
    """The low (high) of the last n bars; the stop before it while there are fewer."""
    low, high = F.min("low").over(trailing(n)), F.max("high").over(trailing(n))
    return F.when(F.count("low").over(trailing(n)) < n, before).otherwise(ratcheted(F.when(c(long), low).otherwise(high), long, before))


def liquidation(entry, mark, long, leverage, alert: float = 80.0, maintenance: float = 0.0) -> Column:
    """(price, used, danger): where the margin is used up, and how much of the way there has gone."""
    way = F.when(c(long), 1.0).otherwise(-1.0)
    price = c(entry) * (1 - way / c(leverage)) / (1 - way * maintenance)
    reach, left = way * (c(entry) - price) / c(entry) * 100, way * (c(mark) - price) / c(entry) * 100
    used = F.when(reach > 0, (reach - left) / reach * 100).otherwise(100.0)
    known = (c(leverage) > 0) & (c(entry) > 0)
    return F.struct(F.when(known, F.round(price, 8)).alias("price"), F.when(known, F.round(used, 1)).alias("used"), F.coalesce(known & (used >= alert), F.lit(False)).alias("danger"))


def exposure(held, proposed, balance, most_percent: float = 300.0) -> Column:
    """(percent, allowed) of all notional against the balance; none is allowed without a balance."""
    percent = F.when(c(balance) > 0, (c(held) + c(proposed)) / c(balance) * 100)
    return F.struct(F.round(percent, 1).alias("percent"), F.coalesce(percent <= most_percent, F.lit(False)).alias("allowed"))


def daily_loss(profit, balance, most_percent: float = 10.0, most: float | None = None) -> Column:
    """(percent, breached) of an open loss."""
    loss = F.greatest(-c(profit), F.lit(0.0))
    percent = F.when(c(balance) > 0, loss / c(balance) * 100).otherwise(0.0)
    breached = percent >= most_percent
    if most is not None:
        breached = breached | (loss >= most)
    return F.struct(F.round(percent, 2).alias("percent"), F.coalesce(breached & (c(profit) < 0), F.lit(False)).alias("breached"))


def off_price(estimated, live, most_percent: float = 2.0) -> Column:
    """(percent, allowed): how far a price has moved from the estimate; allowed without an estimate."""
    percent = F.when(c(estimated) > 0, F.abs(c(live) - c(estimated)) / c(estimated) * 100).otherwise(0.0)
    return F.struct(F.round(percent, 2).alias("percent"), (percent <= most_percent).alias("allowed"))


def halted(checks: dict[str, Column]) -> Column:
    """(halt, failed): names of the checks that have failed; unknown counts as passed."""
    failed = F.filter(F.array(*[F.when(F.coalesce(v, F.lit(False)), F.lit(k)) for k, v in checks.items()]), lambda x: x.isNotNull())
    return F.struct((F.size(failed) > 0).alias("halt"), failed.alias("failed"))


def take_profits(entry, long, percents: list[float]) -> Column:
    """Prices at which parts of a position are closed."""
    return F.array(*[F.round(c(entry) * F.when(c(long), 1 + p / 100).otherwise(1 - p / 100), 8) for p in percents])
