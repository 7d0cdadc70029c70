"""Operators that SQL does not cover, against plain loops; and streams against their batch twins."""

import math
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemill.functions import windows as W
from tidemill.operators import asof, backtest, factors, recurrences
from tidemill.plans import relational_queries
from tidemill.sources.bars import clean, resample_ticks, ticks


@pytest.fixture(scope="module")
def bars(spark):
    rows = [("A" if k % 2 else "B", pd.Timestamp("2024-01-01") + pd.Timedelta(hours=k), 10 + math.sin(k), 11 + math.sin(k), 9 + math.sin(k), 10 + math.sin(k + 1), 1.0 + k % 5) for k in range(120)]
    return spark.createDataFrame(pd.DataFrame(rows, columns=["symbol", "ts", "open", "high", "low", "close", "volume"])).cache()


def test_exponential_mean_with_gaps():
    x = pd.Series([None, 1.0, None, 3.0, 4.0, None, None, 2.0])
    got, y, w = recurrences.ema(x, 2).tolist(), None, 1.0
    alpha, seen, want = 2 / 3, 0, []
    for v in x:
        if pd.isna(v):
            if y is not None:
                w *= 1 - alpha
        elif y is None:
            y, w, seen = v, 1 - alpha, 1
        else:
            y, w, seen = (w * y + alpha * v) / (w + alpha), 1 - alpha, seen + 1
        want.append(y if seen >= 2 else None)
    assert [None if pd.isna(a) else round(a, 12) for a in got] == [None if b is None else round(b, 12) for b in want]


def test_recurrences_keep_rows_and_ranges(bars):
    got = recurrences.recur(bars, {"rsi": {}, "supertrend": {}, "parabolic_sar": {}, "adx": {}}).toPandas()
    assert len(got) == 120
    assert got["rsi"].dropna().between(0, 100).all() and got["adx"].dropna().between(0, 100).all()
    assert set(got["supertrend_dir"].dropna()) <= {1.0, -1.0}


def test_rsi_of_one_way_series():
    assert recurrences.rsi_of(pd.Series(range(30), dtype=float), 14).iloc[-1] == 100
    assert recurrences.rsi_of(pd.Series([5.0] * 30), 14).iloc[-1] == 0


def test_asof_ties_nulls_and_empty(spark):
    left = spark.createDataFrame([("A", 1), ("A", 5), ("B", 5), (None, 5)], "symbol string, ts long")
    right = spark.createDataFrame([("A", 5, 1.0), ("A", 5, 2.0), ("A", 2, None)], "symbol string, ts long, v double")
    got = {(r.symbol, r.ts): r.v for r in asof.asof_left(left, right, ["v"]).collect()}
    assert got == {("A", 1): None, ("A", 5): 2.0, ("B", 5): None, (None, 5): None}
    assert asof.asof_left(left, right.limit(0), ["v"]).filter("v is not null").isEmpty()


@pytest.mark.parametrize("kind", ["long", "timestamp", "timestamp_ntz"])
def test_asof_and_counts_share_a_key_out_by_time(spark, kind):
    random.seed(9)
    some = lambda n, most: [(random.choice(["A", "A", None]), random.choice([None, *[random.randint(0, most) for _ in range(20)]]), k) for k in range(n)]
    left, right = some(300, 90000), some(40, 90000) + [("A", 7200, 900), ("A", 3599, 901)]
    left += [("A", t, 1000 + t) for t in (7199, 7200, 7201, 10799, 10800, 3600)]
    frame = lambda rows: spark.createDataFrame(rows, "symbol string, ts long, v long").withColumn("ts", F.col("ts") if kind == "long" else F.timestamp_seconds("ts").cast(kind))
    at = lambda t: -1 if t is None else t

    def latest(s, t):
        return max(((at(u), v) for r, u, v in right if r == s and at(u) <= at(t)), default=(None, None))[1]

    joined = asof.asof_left(frame(left).withColumnRenamed("v", "k"), frame(right), ["v"])
    assert {r.k: r.v for r in joined.collect()} == {k: latest(s, t) for s, t, k in left} and joined.columns == ["symbol", "ts", "k", "v"]
    counted = asof.count_in_span(frame(left), frame(right), 3600)
    want = {k: sum(r == s and ((t is None and u is None) or (None not in (t, u) and t - 3600 < u <= t)) for r, u, _ in right) for s, t, k in left}
    assert {r.v: r.n_events for r in counted.collect()} == want and counted.count() == len(left)
    for df, piece in ((joined, "_hour"), (counted, "_piece")):
        assert "hashpartitioning(symbol" in (plan := df._jdf.queryExecution().executedPlan().toString()) and f", {piece}#" in plan


def test_factor_nodes_are_shared_and_ranks_average_ties(spark):
    df = spark.createDataFrame([(s, t, float(v)) for t in range(3) for s, v in zip("abcd", (1, 2, 2, None or 5), strict=True)], "symbol string, ts long, x double")
    got = factors.add_factors(df, {"r": factors.rank(factors.column("x")), "r2": factors.rank(factors.column("x")) * 2}).filter("ts = 0").orderBy("symbol").collect()
    assert [r.r for r in got] == [0.25, 0.625, 0.625, 1.0]
    assert [r.r2 for r in got] == [0.5, 1.25, 1.25, 2.0]


def test_power_and_choice_of_unknown_values(spark):
    df = spark.createDataFrame([("a", 1, -8.0, None), ("b", 1, 4.0, 1.0)], "symbol string, ts long, x double, y double")
    x, y = factors.column("x"), factors.column("y")
    got = factors.add_factors(df, {"p": factors.signedpower(x, 0.5), "c": factors.where(y < 2, x, 0.0), "m": factors.larger(x, y)}).orderBy("symbol").collect()
    assert [(r.p, r.c, r.m) for r in got] == [(None, None, None), (2.0, 4.0, 4.0)]


def test_clean_and_gates(spark, bars):
    odd = spark.createDataFrame([(float("nan"), 1.0), (float("inf"), None)], ["A ", "b"])
    assert [tuple(r) for r in clean(odd).collect()] == [(None, 1.0), (None, None)] and clean(odd).columns == ["a", "b"]
    assert bars.withColumn("m", W.mean("close", 20)).filter("m is null").count() == 38


def test_threshold_bars_leave_out_the_unfinished(spark):
    t = spark.createDataFrame([("A", k, k, float(k), 1.0) for k in range(7)], "symbol string, ts long, seq long, price double, quantity double")
    got = recurrences.threshold_bars(t, 3.0).orderBy("bar").collect()
    assert [(r.open, r.high, r.low, r.close, r.volume) for r in got] == [(0, 2, 0, 2, 3), (3, 5, 3, 5, 3)]


def walked_bars(rows, size):
    """Bars of (symbol, ts, seq, price, quantity) by a plain walk."""
    out = []
    for symbol in {r[0] for r in rows}:
        held, bar, number = 0.0, [], 0
        for r in sorted((r for r in rows if r[0] == symbol), key=lambda r: r[1:3]):
            bar.append(r)
            held += r[4]
            if held >= size:
                p = [r[3] for r in bar if r[3] is not None] or [None]
                out.append((symbol, number, p[0], max(p), min(p), p[-1], sum(r[4] for r in bar)))
                held, bar, number = 0.0, [], number + 1
    return sorted(out, key=str)


def test_bars_of_ticks_equal_a_walk_and_load_no_symbol_whole(spark, small_dir):
    random.seed(4)
    for each in (lambda: 1.0, lambda: random.choice([0.25, 1.0, 2.5])):
        rows = [(random.choice(["A", "A", "B", None]), pd.Timestamp("2024-01-01").to_pydatetime() + pd.Timedelta(minutes=random.randint(0, 900)).to_pytimedelta(), k, random.choice([None, float(random.randint(1, 99))]), each()) for k in range(500)]
        df = spark.createDataFrame(random.sample(rows, 500), "symbol string, ts timestamp, seq long, price double, quantity double")
        makers = [recurrences.threshold_bars] + [recurrences.tick_bars] * all(r[4] == 1 for r in rows)
        for size in (7.0, 2.5, 600.0):
            for make in makers:
                assert sorted((tuple(r) for r in make(df, size).collect()), key=str) == walked_bars(rows, size)
                assert "InPandas" not in make(df, size)._jdf.queryExecution().toString()
    got = relational_queries.volume_bars(spark, small_dir)
    assert "Python" not in got._jdf.queryExecution().toString() and "InPandas" not in got._jdf.queryExecution().toString()
    rows = [tuple(r) for r in ticks(spark, small_dir).select("symbol", "ts", "seq", "price", "quantity").collect()]
    want = [(s, k, *[None if x is None else round(x, 6) for x in v]) for s, k, *v in walked_bars(rows, 25.0)]
    assert [tuple(r) for r in got.orderBy("symbol", "bar").collect()] == sorted(want)


def test_equal_levels_keep_old_pivots(spark):
    """Pivots with trends of up to 500 bars between them, against a plain walk."""
    from tidemill.functions import structure

    random.seed(8)
    turns = [2, 30, 9, 500, 40, 450, 12, 13, 12, 13, 90] + [random.randint(6, 14) for _ in range(60)]
    rows, at, way = [], 1000.0, 1
    for n in turns:
        for _ in range(n):
            at += way * 400 / max(n, 40)
            rows.append((at + 1, at - 1))
        way = -way
    df = spark.createDataFrame([("A", k, h, low) for k, (h, low) in enumerate(rows)], "symbol string, ts long, high double, low double")
    got = structure.equal_levels(df, 2.0, most=8).orderBy("ts").select("n_equal_highs", "eqh_level", "eqh_count", "n_equal_lows", "eql_level", "eql_count").collect()
    seen, cluster = ([], []), [[], []]
    for k in range(len(rows)):
        c = k - 5
        for side, sign in ((0, 1), (1, -1)):
            x = [sign * r[side] for r in rows]
            if c >= 1 and x[c] > max(x[max(0, c - 5) : c]) and x[c] >= max(x[c + 1 : c + 6]):
                seen[side].append(rows[c][side])
                cluster[side] = [p for p in seen[side][-8:] if abs(p - rows[c][side]) / rows[c][side] <= 0.02]
        for near, (n, level, count) in zip(cluster, (got[k][:3], got[k][3:]), strict=True):
            assert n == len(near) and count == (len(near) if len(near) > 1 else 0)
            assert level is None if len(near) < 2 else math.isclose(level, sum(near) / len(near))
    assert len(seen[0]) > 30 and got[700].n_equal_highs > 0


def test_stream_of_bars_equals_the_batch(spark, small_dir, tmp_path):
    from tidemill.streaming.windows import drain, event_stream, stream_bars

    folder = tmp_path / "events"
    spark.read.parquet(f"{small_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")).orderBy("ts").coalesce(1).write.parquet(str(folder))
    got = drain(stream_bars(event_stream(spark, str(folder))), "bars_out", str(tmp_path / "cp"))
    batch = resample_ticks(ticks(spark, small_dir), "1h").select("symbol", F.col("ts").cast("timestamp").alias("ts"), "open", "high", "low", "close", "trades")
    assert not got.isEmpty()
    assert got.exceptAll(batch).isEmpty()  # what the watermark has closed; the last hours are still open


def test_paper_session_fills_at_the_next_open(spark, bars, tmp_path):
    from tidemill.streaming.windows import drain, paper_session

    folder = tmp_path / "bars"
    bars.coalesce(1).write.parquet(str(folder))
    stream = spark.readStream.schema(bars.schema).parquet(str(folder))
    got = drain(paper_session(stream, 3, 6), "fills", str(tmp_path / "cp2")).toPandas()
    assert not got.empty
    sides = got.sort_values("ts").groupby("symbol")["side"].apply(list)
    assert all(s == ["buy", "sell"] * (len(s) // 2) + ["buy"] * (len(s) % 2) for s in sides)
