"""Structured Streaming twins of the batch operators: bars, forced orders, and a paper session.

Late rows are dropped beyond the watermark; a window is emitted once, when the watermark has passed
its end. Paper sessions keep only a symbol's last closes and position in the state store.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

EVENT_SCHEMA = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"


def event_stream(spark: SparkSession, folder: str, files_per_trigger: int = 1) -> DataFrame:
    """Event files of a folder as a stream."""
    return spark.readStream.schema(EVENT_SCHEMA).option("maxFilesPerTrigger", files_per_trigger).option("pathGlobFilter", "*.parquet").parquet(folder)


def stream_bars(events: DataFrame, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    order = F.struct("ts", "event_id")
    return (
        events.filter("value is not null").withWatermark("ts", late).groupBy(F.window("ts", size).alias("w"), F.col("event_type").alias("symbol"))
        .agg(F.min_by("value", order).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", order).alias("close"), F.count("*").alias("trades"))
        .select("symbol", F.col("w.start").alias("ts"), "open", "high", "low", "close", "trades")
    )


def complete_bars(events: DataFrame, size: str, expected: int, late: str = "10 minutes") -> DataFrame:
    """Only windows that hold as many rows as they should."""
    return stream_bars(events, size, late).filter(F.col("trades") >= expected)


def stream_forced_orders(events: DataFrame, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    long, short = F.col("event_type") == "error", F.col("event_type") == "purchase"
    got = events.withWatermark("ts", late).groupBy(F.window("ts", size).alias("w")).agg(
        F.coalesce(F.sum(F.when(long, F.col("value"))), F.lit(0.0)).alias("long_usd"), F.coalesce(F.sum(F.when(short, F.col("value"))), F.lit(0.0)).alias("short_usd")
    )
    imbalance = F.coalesce(F.try_divide(F.col("long_usd") - F.col("short_usd"), F.col("long_usd") + F.col("short_usd")), F.lit(0.0))
    return got.select(F.col("w.start").alias("ts"), "long_usd", "short_usd", imbalance.alias("imbalance"))


def once(rows: DataFrame, key: str, late: str = "1 hour") -> DataFrame:
    """Rows whose key has not been seen within the watermark."""
    return rows.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def paper_session(bars: DataFrame, fast: int = 5, slow: int = 20) -> DataFrame:
    """Fills of a moving-average cross, symbol by symbol: a signal is filled at the next bar's open."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        closes, position, pending = state.get if state.exists else ("", 0, 0)
        held = [float(x) for x in closes.split(",") if x]
        out = []
        rows = pd.concat(list(batches), ignore_index=True).sort_values("ts", kind="stable")
        for b in rows.itertuples():
            if pending and pending != position:
                out.append((key[0], b.ts, "buy" if pending > 0 else "sell", float(b.open)))
                position = max(pending, 0)
            pending = 0
            before = held[-slow:]
            held = (held + [float(b.close)])[-(slow + 1) :]
            if len(before) == slow and len(held) > slow:
                gap = lambda c: sum(c[-fast:]) / fast - sum(c[-slow:]) / slow
                was, now = gap(before), gap(held)
                pending = 1 if was <= 0 < now else -1 if was >= 0 > now and position else 0
        state.update((",".join(map(repr, held)), int(position), int(pending)))
        yield pd.DataFrame(out, columns=["symbol", "ts", "side", "price"])

    return bars.groupBy("symbol").applyInPandasWithState(
        run, "symbol string, ts timestamp, side string, price double", "closes string, position int, pending int", "append", GroupStateTimeout.NoTimeout
    )


def drain(stream: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run a stream over all that is there and return what it has emitted (for tests and small results)."""
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)
