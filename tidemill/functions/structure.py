"""Market structure from pivots: a pivot counts only once the bars after it have confirmed it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.functions.windows import prev, series, so_far, yes


def pivots(df: DataFrame, n: int = 5) -> DataFrame:
    """pivot_high and pivot_low: extremes of the n bars on both sides (they look ahead, by definition)."""
    before, after = series().rowsBetween(-n, -1), series().rowsBetween(1, n)
    high = (F.col("high") > F.max("high").over(before)) & (F.col("high") >= F.max("high").over(after))
    low = (F.col("low") < F.min("low").over(before)) & (F.col("low") <= F.min("low").over(after))
    return df.withColumns({"pivot_high": yes(high), "pivot_low": yes(low)})


def levels(df: DataFrame, n: int = 5) -> DataFrame:
    """level_high and level_low: the last pivots that are n bars old or older."""
    df = pivots(df, n).withColumns({"_ph": F.when(F.col("pivot_high"), F.col("high")), "_pl": F.when(F.col("pivot_low"), F.col("low"))})
    df = df.withColumns({"_ph": prev("_ph", n), "_pl": prev("_pl", n)})
    return df.withColumns({"level_high": F.last("_ph", True).over(so_far()), "level_low": F.last("_pl", True).over(so_far())}).drop("_ph", "_pl")


def sweep_side() -> Column:
    """bull: below the low level but closed above it; bear: beyond the high level but closed below; bull goes first."""
    bull = yes((F.col("low") < F.col("level_low")) & (F.col("close") > F.col("level_low")))
    bear = yes((F.col("high") > F.col("level_high")) & (F.col("close") < F.col("level_high")))
    return F.when(bull, "bull").when(bear, "bear").otherwise("none")


def zone(band: float = 0.001) -> Column:
    """premium above the middle of the levels, discount below, equilibrium within the band, none while unknown."""
    mid = (F.col("level_high") + F.col("level_low")) / 2
    return F.when(mid.isNull(), "none").when(F.col("close") > mid * (1 + band), "premium").when(F.col("close") < mid * (1 - band), "discount").otherwise("equilibrium")


def equal_levels(df: DataFrame, tolerance: float = 0.1, most: int = 20, n: int = 5) -> DataFrame:
    """Levels that the last `most` confirmed pivots share with the newest, within so many percent of it, however old they are.

    n_equal_highs and n_equal_lows count the newest too. eqh_level, eqh_count, eql_level and eql_count
    are mean and size of the cluster, NULL and 0 where the newest is alone. All stay until the next pivot.
    """
    df = pivots(df, n).withColumns({"_ph": F.when(F.col("pivot_high"), F.col("high")), "_pl": F.when(F.col("pivot_low"), F.col("low"))})
    df = df.withColumns({"_ph": prev("_ph", n), "_pl": prev("_pl", n)})
    for p, name, short in (("_ph", "n_equal_highs", "eqh"), ("_pl", "n_equal_lows", "eql")):
        among = Window.partitionBy("symbol", F.col(p).isNotNull()).orderBy("ts").rowsBetween(-(most - 1), 0)  # bars with a pivot by themselves
        df = df.withColumn("_near", F.collect_list(p).over(among))
        near = F.filter("_near", lambda x: F.abs(x - F.col(p)) <= F.col(p) * (tolerance / 100))  # noqa: B023
        df = df.withColumn("_near", F.last(F.when(F.col(p).isNotNull(), near), True).over(so_far()))
        size = F.coalesce(F.size("_near"), F.lit(0))
        level = F.aggregate("_near", F.lit(0.0), lambda a, x: a + x) / F.size("_near")
        df = df.withColumns({name: F.when(F.col("_near").isNotNull(), size).otherwise(0), f"{short}_level": F.when(size > 1, level), f"{short}_count": F.when(size > 1, size).otherwise(0)})
    return df.drop("_ph", "_pl", "_near")


def trend_breaks(df: DataFrame, n: int = 5) -> DataFrame:
    """Breaks of levels: `up` and `down` where a close first passes a level; a change of side is a turn, else it goes on."""
    df = levels(df, n)
    side = F.when(F.col("close") > F.col("level_high"), "up").when(F.col("close") < F.col("level_low"), "down")
    df = df.withColumn("_side", side).withColumn("_state", F.last("_side", True).over(so_far()))
    before = prev("_state")
    broke = F.col("_side").isNotNull() & F.coalesce(prev("_side") != F.col("_side"), F.lit(True))
    return df.withColumn("structure", F.when(broke & yes(before != F.col("_side")), "turn").when(broke & yes(before == F.col("_side")), "continue").otherwise("none")).drop("_side", "_state")
