"""Technical indicators that plain windows express; each adds columns to a table of bars.

A window function can't stand inside another, so that operators of two steps add a column first.
All steps share the window over (symbol, ts): Spark sorts once.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.functions.windows import series, c, change, deviation, div, full, highest, lowest, mean, prev, quantile, so_far, total, trailing

sma = mean


def weighted_mean(x, n: int) -> Column:
    """Linear weights, the newest row n, the oldest 1."""
    terms = [(n - k) * F.lag(c(x), k).over(series()) for k in range(n)]
    return sum(terms[1:], terms[0]) / (n * (n + 1) / 2)


def zscore(x, n: int) -> Column:
    return div(c(x) - mean(x, n), deviation(x, n), 0.0)


def bollinger(df: DataFrame, n: int = 20, width: float = 2.0, x: str = "close") -> DataFrame:
    m, s = mean(x, n), deviation(x, n)
    return df.withColumns({"bb_upper": m + width * s, "bb_middle": m, "bb_lower": m - width * s})


def bollinger_shape(df: DataFrame, n: int = 20, width: float = 2.0, lookback: int = 20, threshold: float = 4.0, x: str = "close") -> DataFrame:
    """Band width in percent, place in the band, and whether the band is narrow."""
    df = bollinger(df, n, width, x).withColumn("bb_width", 100 * div(F.col("bb_upper") - F.col("bb_lower"), "bb_middle", 0.0))
    return df.withColumns({
        "bb_percent": div(c(x) - F.col("bb_lower"), F.col("bb_upper") - F.col("bb_lower"), 0.5),
        "bb_narrow": (F.col("bb_width") <= threshold) | (div("bb_width", mean("bb_width", lookback), 1.0) < 0.5),
    })


def donchian(df: DataFrame, n: int = 20) -> DataFrame:
    u, low = highest("high", n), lowest("low", n)
    return df.withColumns({"dc_upper": u, "dc_lower": low, "dc_middle": (u + low) / 2})


def stochastic(df: DataFrame, k: int = 14, d: int = 3, smooth: int = 3) -> DataFrame:
    low, high = lowest("low", k), highest("high", k)
    df = df.withColumn("_raw", 100 * div(c("close") - low, high - low, 0.5)).withColumn("stoch_k", mean("_raw", smooth))
    return df.withColumn("stoch_d", mean("stoch_k", d)).drop("_raw")


def typical() -> Column:
    return (c("high") + c("low") + c("close")) / 3


def running_vwap() -> Column:
    return div(F.sum(typical() * c("volume")).over(so_far()), F.sum("volume").over(so_far()), 0.0)


def on_balance_volume(df: DataFrame) -> DataFrame:
    df = df.withColumn("_flow", F.coalesce(F.signum(c("close") - prev("close")), F.lit(0.0)) * c("volume"))
    return df.withColumn("obv", F.sum("_flow").over(so_far())).drop("_flow")


def price_volume_trend(df: DataFrame) -> DataFrame:
    df = df.withColumn("_flow", F.coalesce(change("close"), F.lit(0.0)) * c("volume"))
    return df.withColumn("pvt", F.sum("_flow").over(so_far())).drop("_flow")


def true_range() -> Column:
    """greatest() leaves NULL out, so that the first bar has high - low."""
    return F.greatest(c("high") - c("low"), F.abs(c("high") - prev("close")), F.abs(c("low") - prev("close")))


def range_gain(n: int) -> Column:
    low = lowest("low", n)
    return F.when(low > 0, 100 * div(highest("high", n) - low, low))


def ichimoku(df: DataFrame, short: int = 9, middle: int = 26, long: int = 52, shift: int = 26) -> DataFrame:
    mid = lambda n: (highest("high", n) + lowest("low", n)) / 2
    df = df.withColumns({"tenkan": mid(short), "kijun": mid(middle), "_b": mid(long)})
    return df.withColumns({
        "senkou_a": prev((F.col("tenkan") + F.col("kijun")) / 2, shift), "senkou_b": prev("_b", shift),
        "chikou": F.lead("close", shift).over(series()),  # looks ahead, by definition
    }).drop("_b")


def volume_weighted_mean(n: int = 20) -> Column:
    return div(total(c("close") * c("volume"), n), total("volume", n))


def hull_mean(df: DataFrame, n: int = 16, x: str = "close") -> DataFrame:
    df = df.withColumn("_hull", 2 * weighted_mean(x, max(1, n // 2)) - weighted_mean(x, n))
    return df.withColumn("hma", weighted_mean("_hull", max(1, round(math.sqrt(n))))).drop("_hull")


def money_flow(df: DataFrame, n: int = 14) -> DataFrame:
    df = df.withColumn("_tp", typical()).withColumn("_up", F.signum(F.col("_tp") - prev("_tp")))
    flow = F.col("_tp") * c("volume")
    df = df.withColumns({"_pos": F.when(F.col("_up") > 0, flow).otherwise(0.0), "_neg": F.when(F.col("_up") < 0, flow).otherwise(0.0)})
    pos, neg = total("_pos", n), total("_neg", n)
    value = F.when((neg == 0) & (pos == 0), None).when(neg == 0, 100.0).otherwise(100 - 100 / (1 + div(pos, neg)))
    return df.withColumn("mfi", value).drop("_tp", "_up", "_pos", "_neg")


def commodity_channel(df: DataFrame, n: int = 20) -> DataFrame:
    """The mean deviation is taken about the window's own mean, over the window as an array."""
    df = df.withColumn("_tp", typical()).withColumns({"_m": mean("_tp", n), "_w": F.collect_list("_tp").over(trailing(n))})
    spread = F.aggregate("_w", F.lit(0.0), lambda a, x: a + F.abs(x - F.col("_m"))) / n
    return df.withColumn("cci", div(F.col("_tp") - F.col("_m"), 0.015 * spread)).drop("_tp", "_m", "_w")


def williams(n: int = 14) -> Column:
    high, low = highest("high", n), lowest("low", n)
    return -100 * div(high - c("close"), high - low)


def chaikin_flow(df: DataFrame, n: int = 20) -> DataFrame:
    df = df.withColumn("_flow", div((c("close") - c("low")) - (c("high") - c("close")), c("high") - c("low"), 0.0) * c("volume"))
    return df.withColumn("cmf", div(total("_flow", n), total("volume", n), 0.0)).drop("_flow")


def aroon(df: DataFrame, n: int = 14) -> DataFrame:
    """Rows since the latest extreme of the last n + 1 rows."""
    df = df.withColumns({"_h": F.reverse(F.collect_list("high").over(trailing(n + 1))), "_l": F.reverse(F.collect_list("low").over(trailing(n + 1)))})
    since = lambda a, pick: F.array_position(a, pick(a)) - 1
    value = lambda a, pick: F.when(F.size(a) == n + 1, 100.0 * (n - since(F.col(a), pick)) / n)
    df = df.withColumns({"aroon_up": value("_h", F.array_max), "aroon_down": value("_l", F.array_min)}).drop("_h", "_l")
    return df.withColumn("aroon_osc", F.col("aroon_up") - F.col("aroon_down"))


def awesome() -> Column:
    mid = (c("high") + c("low")) / 2
    return mean(mid, 5) - mean(mid, 34)


def pivot_points(df: DataFrame) -> DataFrame:
    """Floor pivots of the bar before."""
    h, low, cl = prev("high"), prev("low"), prev("close")
    pp = (h + low + cl) / 3
    return df.withColumns({
        "pp": pp, "r1": 2 * pp - low, "s1": 2 * pp - h, "r2": pp + (h - low), "s2": pp - (h - low), "r3": h + 2 * (pp - low), "s3": low - 2 * (h - pp),
    })


def slope_label(df: DataFrame, x: str, lookback: int = 5, flat_bps: float = 5.0) -> Column:
    """up, down or flat by the change in basis points; down while there is none to tell."""
    bps = change(x, lookback) * 1e4
    return F.when(c(x).isNull(), None).when(F.abs(bps) <= flat_bps, "flat").when(bps > 0, "up").otherwise("down")


def stack_label(*means) -> Column:
    """bullish if the means fall from the first on, bearish if they rise, else mixed."""
    pairs = list(zip(means, means[1:], strict=False))
    down, up = F.lit(True), F.lit(True)
    for a, b in pairs:
        down, up = down & (c(a) > c(b)), up & (c(a) < c(b))
    return F.when(F.coalesce(down, F.lit(False)), "bullish").when(F.coalesce(up, F.lit(False)), "bearish").otherwise("mixed")


def surge(n: int = 20) -> Column:
    return div("volume", full(F.avg("volume").over(trailing(n, 1)), "volume", n, 1), 1.0)


def volume_trend(short: int = 5, long: int = 20) -> Column:
    """ACCUMULATING, DISTRIBUTING, DRYING_UP or NEUTRAL by volume and the share of rising bars."""
    ratio = div(mean("volume", short), mean("volume", long), 1.0)
    green = F.when(c("close") > c("open"), c("volume")).otherwise(0.0)
    share = div(total(green, short), total("volume", short), 0.5)
    return (
        F.when(ratio < 0.7, "DRYING_UP").when((ratio > 1.2) & (share < 0.4), "DISTRIBUTING").when((ratio > 1.2) & (share > 0.6), "ACCUMULATING").otherwise("NEUTRAL")
    )


def trend_strength(n: int = 10) -> Column:
    green = (c("close") > c("open")).cast("double")
    body = 100 * div(F.abs(c("close") - c("open")), c("high") - c("low"), 0.0)
    return 0.6 * mean(green, n) + 0.4 * F.least(mean(body, n) / 80, F.lit(1.0))


__all__ = ["sma", "weighted_mean", "zscore", "quantile"]
