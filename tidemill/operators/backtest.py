"""Backtests and their statistics over bars with signals.

Positions follow from signals row by row, so that everything is windows: a signal of one bar is traded
at the next bar's open. Exits that depend on the entry (stops, targets, trailing stops, longest stay) are
first passages: see `passage.trades`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemill.functions.windows import series, so_far


def hold(df: DataFrame, enter: str, leave: str) -> DataFrame:
    """Position 1 from the bar after an entry signal to the bar of the exit signal, else 0."""
    mark = F.when(F.col(enter), 1.0).when(F.col(leave), 0.0)
    return df.withColumn("_state", F.coalesce(F.last(mark, True).over(so_far()), F.lit(0.0))).withColumn("position", F.coalesce(F.lag("_state").over(series()), F.lit(0.0))).drop("_state")


def returns(df: DataFrame, fee_bps: float = 10.0) -> DataFrame:
    """Return of every bar from open to next open, less fees on what the position changes."""
    step = F.try_divide(F.lead("open").over(series()), F.col("open")) - 1
    traded = F.abs(F.col("position") - F.coalesce(F.lag("position").over(series()), F.lit(0.0)))
    net = F.col("position") * F.coalesce(step, F.lit(0.0)) - traded * fee_bps / 1e4
    return df.withColumns({"traded": traded, "net": net})


def equity(df: DataFrame) -> DataFrame:
    """Growth of 1 and the fall from its highest point so far."""
    df = df.withColumn("equity", F.exp(F.sum(F.log1p("net")).over(so_far())))
    return df.withColumn("drawdown", F.col("equity") / F.greatest(F.lit(1.0), F.max("equity").over(so_far())) - 1)


def summary(df: DataFrame, bars_per_year: float) -> DataFrame:
    """Total return, greatest fall, Sharpe ratio of simple returns and number of trades of each symbol."""
    return df.groupBy("symbol").agg(
        (F.max_by("equity", "ts") - 1).alias("total_return"), F.min("drawdown").alias("max_drawdown"),
        (F.try_divide(F.avg("net"), F.nullif(F.stddev_samp("net"), F.lit(0.0))) * F.sqrt(F.lit(bars_per_year))).alias("sharpe"),
        F.sum("traded").alias("traded"), F.count("*").alias("bars"),
    )


def sweep(df: DataFrame, grid: list[tuple[int, int]]) -> DataFrame:
    """Summaries of moving-average crosses for every (fast, slow): the grid is a small constant table, windows do the rest."""
    from tidemill.functions.windows import cross_above, cross_below, mean

    parts = []
    for fast, slow in grid:
        one = df.withColumns({"_f": mean("close", fast), "_s": mean("close", slow)})
        one = one.withColumns({"enter": cross_above("_f", "_s"), "leave": cross_below("_f", "_s")})
        parts.append(summary(equity(returns(hold(one, "enter", "leave"))), 8760.0).withColumns({"fast": F.lit(fast), "slow": F.lit(slow)}))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def leaderboard(df: DataFrame) -> DataFrame:
    """Parameter sets of each symbol by falling Sharpe ratio."""
    place = F.row_number().over(Window.partitionBy("symbol").orderBy(F.col("sharpe").desc_nulls_last(), "fast", "slow"))
    return df.withColumn("place", place)
