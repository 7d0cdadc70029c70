"""Ticks, bars and panels as long tables of (symbol, ts, open, high, low, close, volume, ...)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.functions.windows import no_nan

#: Length of each bar size in seconds; a month counts 30 days. Fixed values.
SECONDS = {"1m": 60, "5m": 300, "15m": 900, "30m": 1800, "1h": 3600, "4h": 14400, "1d": 86400, "1w": 604800, "1M": 2592000}


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as ticks: symbol, ts, price, quantity and an order within one instant."""
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(
        F.col("event_type").alias("symbol"), "ts", no_nan("value").alias("price"), F.lit(1.0).alias("quantity"), F.col("event_id").alias("seq")
    )


def bucket(ts: Column, size: str) -> Column:
    """Start of the bar that an instant falls into, counted from the epoch."""
    step = SECONDS[size]
    return F.timestamp_seconds(F.floor(F.unix_timestamp(ts) / step) * step)


def resample_ticks(rows: DataFrame, size: str) -> DataFrame:
    """Bars of a fixed length from ticks; one partial and one final aggregation."""
    order = F.struct("ts", "seq")
    return (
        rows.filter("price is not null").withColumn("_bar", bucket(F.col("ts"), size)).groupBy("symbol", "_bar")
        .agg(
            F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"),
            F.sum("quantity").alias("volume"), F.sum(F.col("price") * F.col("quantity")).alias("quote_volume"), F.count("*").alias("trades"),
        )
        .withColumnRenamed("_bar", "ts")
    )


def resample_bars(rows: DataFrame, size: str, expected: int | None = None) -> DataFrame:
    """Longer bars from shorter ones; with `expected`, only those that hold as many."""
    got = (
        rows.withColumn("_bar", bucket(F.col("ts"), size)).groupBy("symbol", "_bar")
        .agg(
            F.min_by("open", "ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "ts").alias("close"),
            F.sum("volume").alias("volume"), F.sum("trades").alias("trades"), F.count("*").alias("parts"),
        )
        .withColumnRenamed("_bar", "ts")
    )
    return got.filter(F.col("parts") == expected) if expected else got


def bars(spark: SparkSession, sf_dir: str, size: str = "1h") -> DataFrame:
    return resample_ticks(ticks(spark, sf_dir), size)


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly bars of about 100 symbols: suppliers' sales by ship date."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        F.concat(F.lit("S"), F.col("l_suppkey")).alias("symbol"), F.col("l_shipdate").cast("timestamp").alias("ts"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), F.col("l_quantity").cast("double").alias("quantity"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("seq"),
    )
    return resample_ticks(rows, "1w")


def clean(df: DataFrame) -> DataFrame:
    """NaN and infinite numbers become NULL; column names are trimmed and lower case."""
    return df.select(*[(no_nan(F.col(f"`{n}`")) if t in ("double", "float") else F.col(f"`{n}`")).alias(n.strip().lower()) for n, t in df.dtypes])


def available(df: DataFrame, decision_ts: Column, column: str = "available_time") -> DataFrame:
    """Only rows that could be known at the decision."""
    return df.filter(F.col(column) <= decision_ts)


#: Bars by hour in SQL, for results to be held against.
BARS_SQL = """bars AS (SELECT event_type AS symbol, to_timestamp(floor(epoch(ts) / 3600) * 3600)::TIMESTAMP AS ts,
  arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low, arg_max(value, (ts, event_id)) AS close,
  CAST(count(*) AS DOUBLE) AS volume, sum(value) AS quote_volume, count(*) AS trades FROM events WHERE value IS NOT NULL GROUP BY 1, 2)"""
