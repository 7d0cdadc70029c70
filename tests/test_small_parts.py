"""Small columns and tables that no query shows."""

import pytest
from pyspark.sql import functions as F

from tidemill.operators import backtest, selection
from tidemill.sources import bars
from tidemill.streaming import windows


def test_columns(spark):
    row = spark.sql("SELECT 3 AS n_bull, 1 AS n_bear, 99.0D AS bid, 101.0D AS ask").select(
        selection.bull_ratio().alias("a"), selection.spread_bps("bid", "ask").alias("b"),
        selection.annual_rate(F.lit(0.001), F.lit(8.0)).alias("c"), selection.grid_levels(F.lit(100.0), 10.0, 4).alias("d"),
    )
    r = row.first()
    assert (r.a, r.b, r.c) == (0.75, 200.0, pytest.approx(1.095)) and r.d == [90.0, 95.0, 100.0, 105.0, 110.0]


def test_leaderboard_and_available(spark):
    df = spark.createDataFrame([("A", 5, 20, 1.0), ("A", 3, 20, 2.0), ("A", 2, 9, None), ("B", 5, 20, None)], "symbol string, fast int, slow int, sharpe double")
    assert {(r.symbol, r.fast): r.place for r in backtest.leaderboard(df).collect()} == {("A", 3): 1, ("A", 5): 2, ("A", 2): 3, ("B", 5): 1}
    known = spark.sql("SELECT timestamp_seconds(id * 10) AS available_time FROM range(5)")
    assert bars.available(known, F.timestamp_seconds(F.lit(20))).count() == 3


def test_streams_of_whole_bars_and_forced_orders(spark, small_dir, tmp_path):
    events = spark.read.parquet(f"{small_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.write.parquet(str(tmp_path / "in"))

    def ran(name, plan):
        windows_of = plan(windows.event_stream(spark, str(tmp_path / "in")))
        done = windows_of.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        done.awaitTermination(120)
        return spark.table(name).collect()

    bars_of = ran("whole", lambda s: windows.complete_bars(s, "1 day", 3))
    assert bars_of and all(r.trades >= 3 for r in bars_of)
    forced = ran("forced", lambda s: windows.stream_forced_orders(s, "1 day"))
    assert forced and all(-1 <= r.imbalance <= 1 and r.long_usd >= 0 for r in forced)


def test_universe_adds_in_the_order_of_the_table(spark, tmp_path):
    """Means on a bound don't hang on how rows were dealt to files and tasks: as SQL gives on one thread."""
    import random

    import duckdb
    import pandas as pd

    from tidemill.plans import relational_queries as R

    rng, lines = random.Random(4), []
    for part in range(300):
        half = [rng.randint(0, 10) for _ in range(8)]
        lines += [(part, d / 100, 1000.0 + d) for d in half + [10 - d for d in half]]  # 5 % on the mean
    rng.shuffle(lines)
    (tmp_path / "lineitem.parquet").mkdir()
    rows = pd.DataFrame(lines, columns=["l_partkey", "l_discount", "l_extendedprice"])
    for k in range(5):  # the larger files come last
        rows.iloc[k * k * 192 : (k + 1) ** 2 * 192].to_parquet(tmp_path / "lineitem.parquet" / f"part-{k}.parquet")
    pd.DataFrame([(k, "b", "t", 1500.5, 30) for k in range(300)], columns=["p_partkey", "p_brand", "p_type", "p_retailprice", "p_size"]).to_parquet(tmp_path / "part.parquet")
    con = duckdb.connect()
    con.execute("SET threads=1")
    for name, path in (("part", "part.parquet"), ("lineitem", "lineitem.parquet/*.parquet")):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{tmp_path}/{path}')")
    for name in ("universe_scores", "universe_select"):
        got, want = R.QUERIES[name](spark, str(tmp_path)).toPandas(), con.execute(R.SQL[name]).df()
        assert got.sort_values("symbol").to_dict("list") == want.sort_values("symbol")[list(got.columns)].to_dict("list")
        assert name == "universe_select" or got["score"].nunique() == 2
