"""Indicators that recur from row to row: one grouped pass for each symbol computes all of a query.

A symbol's bars are bounded (ticks are aggregated first); ticks themselves are numbered by hour or
walked in batches. Means weighted exponentially start at the first value, lose weight over gaps, and
are NULL until they have seen n values.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, LongType, StructField, StructType

from tidemill.sources.bars import bucket

KERNELS: dict[str, tuple[list[str], Callable]] = {}


def kernel(*outputs: str):
    def keep(f):
        KERNELS[f.__name__] = (list(outputs), f)
        return f

    return keep


def ema(x: pd.Series, n: int) -> pd.Series:
    return x.ewm(span=n, adjust=False, min_periods=n).mean()


def wilder(x: pd.Series, n: int) -> pd.Series:
    return x.ewm(alpha=1 / n, adjust=False, min_periods=n).mean()


def _range(b: pd.DataFrame) -> pd.Series:
    before = b["close"].shift()
    return pd.concat([b["high"] - b["low"], (b["high"] - before).abs(), (b["low"] - before).abs()], axis=1).max(axis=1)


@kernel("ema")
def exponential(b, n=20):
    return (ema(b["close"], n),)


@kernel("rma")
def wilder_mean(b, n=14):
    return (wilder(b["close"], n),)


def rsi_of(x: pd.Series, n: int) -> pd.Series:
    d = x.diff()
    up, down = wilder(d.clip(lower=0), n), wilder((-d).clip(lower=0), n)
    return pd.Series(np.where(up.isna(), np.nan, np.where(down == 0, np.where(up > 0, 100.0, 0.0), 100 - 100 / (1 + up / down.where(down != 0)))), b_index(x))


def b_index(x: pd.Series) -> pd.Index:
    return x.index


@kernel("rsi")
def rsi(b, n=14):
    return (rsi_of(b["close"], n),)


@kernel("macd", "macd_signal", "macd_hist")
def macd(b, fast=12, slow=26, signal=9):
    line = ema(b["close"], fast) - ema(b["close"], slow)
    s = ema(line, signal)
    return line, s, line - s


@kernel("atr", "atr_ratio")
def atr(b, n=14):
    a = wilder(_range(b), n)
    return a, (100 * a / b["close"].where(b["close"] != 0)).fillna(0.0)


@kernel("adx", "plus_di", "minus_di")
def adx(b, n=14):
    """Undefined quotients count as 0 while windows warm up, so that the mean of DX starts on zeros."""
    up, down = b["high"].diff(), -b["low"].diff()
    plus, minus = up.where((up > down) & (up > 0), 0.0), down.where((down > up) & (down > 0), 0.0)
    a = wilder(_range(b), n)
    quotient = lambda x, y: (x / y.where(y != 0)).fillna(0.0)
    p, m = 100 * quotient(wilder(plus, n), a), 100 * quotient(wilder(minus, n), a)
    return wilder(100 * quotient((p - m).abs(), p + m), n), p, m


@kernel("dema", "tema", "trix")
def chained(b, n=10):
    one = ema(b["close"], n)
    two = ema(one, n)
    three = ema(two, n)
    before = three.shift()
    return 2 * one - two, 3 * one - 3 * two + three, 1e4 * ((three - before) / before.where(before != 0)).fillna(0.0)


@kernel("kc_upper", "kc_middle", "kc_lower")
def keltner(b, n=20, atr_n=10, times=2.0):
    m, a = ema(b["close"], n), wilder(_range(b), atr_n)
    return m + times * a, m, m - times * a


@kernel("stochrsi_k", "stochrsi_d")
def stochastic_rsi(b, n=14, k=3, d=3):
    r = rsi_of(b["close"], n)
    low, high = r.rolling(n).min(), r.rolling(n).max()
    fast = (100 * ((r - low) / (high - low).where(high != low)).fillna(0.5)).rolling(k).mean()
    return fast, fast.rolling(d).mean()


@kernel("ha_open", "ha_high", "ha_low", "ha_close")
def heikin_ashi(b):
    close = (b["open"] + b["high"] + b["low"] + b["close"]) / 4
    start = np.empty(len(b))
    for k, c in enumerate(close.to_numpy()):
        start[k] = (b["open"].iloc[0] + b["close"].iloc[0]) / 2 if k == 0 else (start[k - 1] + before) / 2
        before = c
    start = pd.Series(start, b.index)
    return start, pd.concat([b["high"], start, close], axis=1).max(axis=1), pd.concat([b["low"], start, close], axis=1).min(axis=1), close


@kernel("supertrend", "supertrend_dir")
def supertrend(b, n=10, times=3.0):
    """Bands ratchet towards the price; the direction turns when a close leaves the band of the bar before."""
    a = wilder(_range(b), n).to_numpy()
    mid, close = ((b["high"] + b["low"]) / 2).to_numpy(), b["close"].to_numpy()
    upper, lower = mid + times * a, mid - times * a
    line, way = np.full(len(b), np.nan), np.full(len(b), np.nan)
    for k in range(len(b)):
        if np.isnan(a[k]):
            continue
        if k and not np.isnan(way[k - 1]):
            upper[k] = upper[k] if upper[k] < upper[k - 1] or close[k - 1] > upper[k - 1] else upper[k - 1]
            lower[k] = lower[k] if lower[k] > lower[k - 1] or close[k - 1] < lower[k - 1] else lower[k - 1]
            way[k] = 1.0 if close[k] > upper[k - 1] else -1.0 if close[k] < lower[k - 1] else way[k - 1]
        else:
            way[k] = 1.0
        line[k] = lower[k] if way[k] > 0 else upper[k]
    return pd.Series(line, b.index), pd.Series(way, b.index)


@kernel("psar")
def parabolic_sar(b, start=0.02, step=0.02, most=0.2):
    high, low, close = (b[c].to_numpy() for c in ("high", "low", "close"))
    out = np.full(len(b), np.nan)
    if len(b) < 2:
        return (pd.Series(out, b.index),)
    rising = close[1] >= close[0]
    sar, extreme, pace = (low[0], high[0], start) if rising else (high[0], low[0], start)
    out[0] = sar
    for k in range(1, len(b)):
        sar += pace * (extreme - sar)
        if rising:
            sar = min(sar, low[k - 1], low[max(0, k - 2)])
            if low[k] < sar:
                rising, sar, extreme, pace = False, extreme, low[k], start
            elif high[k] > extreme:
                extreme, pace = high[k], min(most, pace + step)
        else:
            sar = max(sar, high[k - 1], high[max(0, k - 2)])
            if high[k] > sar:
                rising, sar, extreme, pace = True, extreme, high[k], start
            elif low[k] < extreme:
                extreme, pace = low[k], min(most, pace + step)
        out[k] = sar
    return (pd.Series(out, b.index),)


def recur(df: DataFrame, wanted: dict[str, dict]) -> DataFrame:
    """Add the outputs of the wanted kernels (name -> settings); one shuffle by symbol for all."""
    added = [o for name in wanted for o in KERNELS[name][0]]
    schema = StructType([*df.schema.fields, *[StructField(o, DoubleType()) for o in added]])

    def run(bars: pd.DataFrame) -> pd.DataFrame:
        bars = bars.sort_values("ts", kind="stable").reset_index(drop=True)
        out = {}
        for name, settings in wanted.items():
            outputs, f = KERNELS[name]
            out |= dict(zip(outputs, f(bars, **settings), strict=True))
        return bars.assign(**{k: v.replace([np.inf, -np.inf], np.nan) for k, v in out.items()})

    return df.groupBy("symbol").applyInPandas(run, schema)


def _ordered(name: str) -> list:
    return [F.col(name).asc_nulls_last(), F.col("seq").asc_nulls_last()]


def _bars_of(numbered: DataFrame) -> DataFrame:
    """One row for each (symbol, bar) of numbered ticks that has come to its end; prices that are unknown are passed over."""
    price = F.col("price").cast("double")
    price = F.when(~F.isnan(price), price)
    at = F.when(price.isNotNull(), F.struct(F.col("ts").isNull(), "ts", F.col("seq").isNull(), "seq"))  # unknown times and orders come last
    got = numbered.groupBy("symbol", "bar").agg(
        F.min_by(price, at).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, at).alias("close"),
        F.sum(F.col("quantity").cast("double")).alias("volume"), F.max("_last").alias("_ended"),
    )
    return got.filter("_ended").drop("_ended")


def tick_bars(ticks: DataFrame, size: float) -> DataFrame:
    """threshold_bars where every tick has quantity 1: a bar is so many ticks, so a tick's number gives its bar.

    Ticks are numbered inside (symbol, hour) and start from the number of those in earlier hours, so
    that no task sorts a whole symbol.
    """
    each = max(1, math.ceil(size))
    rows = ticks.select("symbol", "ts", "seq", "price", "quantity", bucket(F.col("ts"), "1h").alias("_hour"))
    before = Window.partitionBy("symbol").orderBy(F.col("_hour").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    hours = rows.groupBy("symbol", "_hour").agg(F.count("*").alias("_n")).withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    hours = hours.select(F.col("symbol").alias("_s"), F.col("_hour").alias("_h"), "_start")
    rows = rows.withColumn("_k", F.row_number().over(Window.partitionBy("symbol", "_hour").orderBy(*_ordered("ts"))))
    rows = rows.join(hours, F.col("symbol").eqNullSafe(F.col("_s")) & F.col("_hour").eqNullSafe(F.col("_h"))).withColumn("_k", F.col("_start") + F.col("_k") - 1)
    return _bars_of(rows.withColumns({"bar": F.floor(F.col("_k") / each).cast("long"), "_last": F.col("_k") % each == each - 1}))


def threshold_bars(ticks: DataFrame, size: float, by: str = "quantity") -> DataFrame:
    """Bars that close when the running sum of a column reaches `size`; what is unfinished is left out.

    Where a bar starts depends on all bars before it, so each symbol is walked in order by one task;
    the walk holds a batch of sorted ticks and the open sum, never a symbol whole. An unknown value
    adds nothing. Where every tick counts 1, tick_bars gives the same and splits symbols.
    """
    rows = ticks.select("symbol", "ts", "seq", "price", "quantity", F.coalesce(F.nanvl(F.col(by).cast("double"), F.lit(0.0)), F.lit(0.0)).alias("_by"))
    schema = StructType([*[f for f in rows.schema.fields if f.name != "_by"], StructField("bar", LongType()), StructField("_last", BooleanType())])

    def run(batches):
        symbol, held, done = None, 0.0, 0
        for t in batches:
            number, last = np.empty(t.num_rows, np.int64), np.zeros(t.num_rows, bool)
            for k, (s, v) in enumerate(zip(t["symbol"].to_pylist(), t["_by"].to_pylist(), strict=True)):
                if s != symbol:
                    symbol, held, done = s, 0.0, 0
                number[k] = done
                held += v
                if held >= size:
                    last[k], done, held = True, done + 1, 0.0
            yield pa.RecordBatch.from_arrays([*t.columns[:-1], pa.array(number), pa.array(last)], names=schema.names)

    return _bars_of(rows.repartition("symbol").sortWithinPartitions("symbol", *_ordered("ts")).mapInArrow(run, schema))
