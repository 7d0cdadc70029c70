"""Point-in-time joins over (symbol, ts): as-of, counts in a span, latest and last rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _hour(both: DataFrame, ts: str) -> Column:
    """A number that grows with ts and changes every hour."""
    if dict(both.dtypes)[ts] == "timestamp_ntz":
        return F.unix_date(F.col(ts).cast("date")) * 24 + F.hour(ts)
    return F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / 3_600_000_000)


def asof_left(left: DataFrame, right: DataFrame, columns: list[str], tolerance_seconds: float | None = None, by: str = "symbol", ts: str = "ts") -> DataFrame:
    """Every left row with the latest right row at or before it (a right row at the same instant counts).

    One union and a running window inside each hour; the last right row of earlier hours comes from
    an aggregation by hour. Linear, spillable, no range join, and one key is shared out by hours.
    Right rows of one instant are taken in the order of their values.
    """
    values = F.struct(F.col(ts).alias("_at"), *columns)
    both = left.withColumns({"_left": F.lit(1), "_value": F.lit(None).cast(right.select(values.alias("v")).schema["v"].dataType)}).unionByName(
        right.select(by, ts, F.lit(0).alias("_left"), values.alias("_value")), allowMissingColumns=True
    )
    both = both.withColumn("_hour", _hour(both, ts))
    hours = both.groupBy(by, "_hour").agg(F.max("_value").alias("_end"))
    earlier = Window.partitionBy(by).orderBy("_hour").rowsBetween(Window.unboundedPreceding, -1)
    hours = hours.select(F.col(by).alias("_by"), F.col("_hour").alias("_of"), F.last("_end", True).over(earlier).alias("_start"))
    before = Window.partitionBy(by, "_hour").orderBy(ts, "_left", "_value").rowsBetween(Window.unboundedPreceding, 0)
    got = both.withColumn("_value", F.last("_value", True).over(before)).filter("_left = 1")
    got = got.join(hours, F.col(by).eqNullSafe(F.col("_by")) & F.col("_hour").eqNullSafe(F.col("_of"))).withColumn("_value", F.coalesce("_value", "_start"))
    got = got.drop("_left", "_hour", "_by", "_of", "_start")
    fresh = F.lit(True) if tolerance_seconds is None else F.col(ts).cast("timestamp").cast("double") - F.col("_value._at").cast("timestamp").cast("double") <= tolerance_seconds
    return got.withColumns({c: F.when(fresh, F.col(f"_value.{c}")) for c in columns}).drop("_value")


def count_in_span(left: DataFrame, events: DataFrame, seconds: int, out: str = "n_events", by: str = "symbol", ts: str = "ts") -> DataFrame:
    """Every left row with the number of events in (ts - seconds, ts].

    Time is cut into pieces as long as the span; an event counts in its own piece and the next, so
    that every piece is counted by itself.
    """
    step = seconds * 1_000_000
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    both = left.withColumn("_event", F.lit(0)).unionByName(events.select(by, ts, F.lit(1).alias("_event")), allowMissingColumns=True).withColumn("_us", micros)
    piece = F.col("_us") - F.pmod(F.col("_us"), F.lit(step))
    both = both.withColumn("_piece", F.explode(F.when((F.col("_event") == 1) & piece.isNotNull(), F.array(piece, piece + step)).otherwise(F.array(piece))))
    span = Window.partitionBy(by, "_piece").orderBy("_us").rangeBetween(-step + 1, 0)
    return both.withColumn(out, F.sum("_event").over(span)).filter("_event = 0").drop("_event", "_us", "_piece")


def latest(rows: DataFrame, by: str = "symbol", ts: str = "ts", tie: str | None = None) -> DataFrame:
    """The last row of every key; a partial aggregation, no sort."""
    order = F.struct(ts, tie) if tie else F.col(ts)
    return rows.groupBy(by).agg(F.max_by(F.struct(*rows.columns), order).alias("_r")).select("_r.*")


def tail(rows: DataFrame, n: int, by: str = "symbol", ts: str = "ts") -> DataFrame:
    place = F.row_number().over(Window.partitionBy(by).orderBy(F.col(ts).desc()))
    return rows.withColumn("_k", place).filter(F.col("_k") <= n).drop("_k")


def keep_most_complete(old: DataFrame, new: DataFrame, keys: list[str], measure: str) -> DataFrame:
    """Union of two captures; of each key the row with the greater measure, the new one on a tie."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    return both.groupBy(*keys).agg(F.max_by(F.struct(*old.columns), F.struct(measure, "_new")).alias("_r")).select("_r.*")


def forced_orders(events: DataFrame, seconds: int) -> DataFrame:
    """Sums by side over fixed windows: SELL closes longs, BUY closes shorts; imbalance in [-1, 1].

    `events` has symbol, ts, side and notional; the window ends at its last millisecond.
    """
    bucket = F.timestamp_seconds(F.floor(F.unix_timestamp("ts") / seconds) * seconds)
    long, short = F.col("side") == "SELL", F.col("side") == "BUY"
    sums = events.groupBy("symbol", bucket.alias("ts")).agg(
        F.count_if(long).alias("long_count"), F.count_if(short).alias("short_count"),
        F.sum(F.when(long, F.col("notional")).otherwise(0.0)).alias("long_usd"), F.sum(F.when(short, F.col("notional")).otherwise(0.0)).alias("short_usd"),
    )
    total = F.col("long_usd") + F.col("short_usd")
    return sums.withColumns({"total_usd": total, "net_usd": F.col("long_usd") - F.col("short_usd"), "imbalance": F.coalesce(F.try_divide(F.col("long_usd") - F.col("short_usd"), total), F.lit(0.0))})
