"""Queries of joins, aggregations, selection, backtests and news, with SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemill.functions import windows as W
from tidemill.operators import asof, backtest, news, recurrences
from tidemill.operators import selection as S
from tidemill.plans.bar_queries import g, hourly, lag, over, r
from tidemill.sources.bars import BARS_SQL, ticks

QUERIES: dict = {}
SQL: dict = {}
SERIES_SQL = "PARTITION BY symbol ORDER BY ts"


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


READINGS = "v AS (SELECT ts, max(value) AS reading FROM events WHERE event_type = 'view' AND value IS NOT NULL GROUP BY ts)"


def readings(spark, sf_dir):
    rows = table(spark, sf_dir, "events").filter("event_type = 'view' and value is not null")
    return rows.groupBy("ts").agg(F.max("value").alias("reading")).withColumn("one", F.lit(1))


@query("asof_join", f"""WITH {READINGS}, b AS (SELECT event_id, ts, value FROM events WHERE event_type = 'purchase')
SELECT b.event_id, b.ts, {r('b.value', 'value')}, {r('v.reading', 'reading')} FROM b ASOF LEFT JOIN v ON b.ts >= v.ts""")
def asof_join(spark, sf_dir):
    left = table(spark, sf_dir, "events").filter("event_type = 'purchase'").select("event_id", "ts", "value", F.lit(1).alias("one"))
    return W.rounded(asof.asof_left(left, readings(spark, sf_dir), ["reading"], by="one").select("event_id", "ts", "value", "reading"), 6)


@query("asof_join_fresh", f"""WITH {READINGS}, b AS (SELECT event_id, ts FROM events WHERE event_type = 'purchase'),
j AS (SELECT b.event_id, b.ts, v.ts AS since, v.reading FROM b ASOF LEFT JOIN v ON b.ts >= v.ts)
SELECT event_id, ts, {r('CASE WHEN epoch(ts) - epoch(since) <= 600 THEN reading END', 'reading')} FROM j""")
def asof_join_fresh(spark, sf_dir):
    left = table(spark, sf_dir, "events").filter("event_type = 'purchase'").select("event_id", "ts", F.lit(1).alias("one"))
    return W.rounded(asof.asof_left(left, readings(spark, sf_dir), ["reading"], 600.0, by="one").select("event_id", "ts", "reading"), 6)


@query("count_in_span", """SELECT l.event_id, l.ts, (SELECT count(*) FROM events e WHERE e.event_type = 'error' AND e.ts <= l.ts AND e.ts > l.ts - INTERVAL 1 HOUR) AS n_events
FROM events l WHERE l.event_type = 'purchase'""")
def count_in_span(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("one", F.lit(1))
    left = events.filter("event_type = 'purchase'").select("event_id", "ts", "one")
    return asof.count_in_span(left, events.filter("event_type = 'error'"), 3600, by="one").select("event_id", "ts", "n_events")


@query("latest_per_key", "SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, max(ts) AS ts FROM events GROUP BY user_id")
def latest_per_key(spark, sf_dir):
    return asof.latest(table(spark, sf_dir, "events").select("user_id", "event_id", "ts"), "user_id", "ts", "event_id")


@query("tail_per_key", f"""WITH {BARS_SQL}, k AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS k FROM bars)
SELECT symbol, ts, {r('close', 'close')} FROM k WHERE k <= 5""")
def tail_per_key(spark, sf_dir):
    return W.rounded(asof.tail(hourly(spark, sf_dir), 5).select("symbol", "ts", "close"), 6)


@query("forced_orders", f"""WITH w AS (SELECT 'ALL' AS symbol, to_timestamp(floor(epoch(ts) / 14400) * 14400)::TIMESTAMP AS ts, count(*) FILTER (WHERE event_type = 'error') AS long_count,
  count(*) FILTER (WHERE event_type = 'purchase') AS short_count, sum(CASE WHEN event_type = 'error' THEN value ELSE 0 END) AS l, sum(CASE WHEN event_type = 'purchase' THEN value ELSE 0 END) AS s
  FROM events WHERE event_type IN ('error', 'purchase') GROUP BY 1, 2)
SELECT symbol, ts, long_count, short_count, {r('l', 'long_usd')}, {r('s', 'short_usd')}, {r('l + s', 'total_usd')}, {r('l - s', 'net_usd')}, {r('coalesce((l - s) / nullif(l + s, 0), 0)', 'imbalance')} FROM w""")
def forced_orders(spark, sf_dir):
    rows = table(spark, sf_dir, "events").filter(F.col("event_type").isin("error", "purchase")).select(
        F.lit("ALL").alias("symbol"), "ts", F.when(F.col("event_type") == "error", "SELL").otherwise("BUY").alias("side"), F.col("value").alias("notional"))
    return W.rounded(asof.forced_orders(rows, 14400), 6)


@query("merge_captures", """WITH a AS (SELECT user_id, event_type, count(*) AS n, 0 AS v FROM events WHERE event_id % 3 <> 0 GROUP BY ALL),
b AS (SELECT user_id, event_type, count(*) AS n, 1 AS v FROM events WHERE event_id % 3 <> 1 GROUP BY ALL), u AS (SELECT * FROM a UNION ALL SELECT * FROM b)
SELECT user_id, event_type, max(n) AS n, arg_max(v, (n, v)) AS capture FROM u GROUP BY user_id, event_type""")
def merge_captures(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    part = lambda drop, v: events.filter(F.col("event_id") % 3 != drop).groupBy("user_id", "event_type").agg(F.count("*").alias("n")).withColumn("capture", F.lit(v))
    return asof.keep_most_complete(part(0, 0), part(1, 1), ["user_id", "event_type"], "n")


UNIVERSE = """u AS (SELECT 'P' || p_partkey || CASE WHEN p_partkey % 4 = 0 THEN 'USDC' ELSE 'USDT' END AS symbol, p_brand AS base, p_type AS kind, p_retailprice AS price, p_size AS size FROM part),
t AS (SELECT l_partkey, sum(l_extendedprice) AS turnover, avg(l_discount) AS rate FROM lineitem GROUP BY l_partkey),
j AS (SELECT u.*, t.turnover, 1e4 * t.rate AS bps FROM u LEFT JOIN t ON u.symbol = 'P' || t.l_partkey || CASE WHEN t.l_partkey % 4 = 0 THEN 'USDC' ELSE 'USDT' END)"""


def universe(spark, sf_dir):
    name = lambda key: F.concat(F.lit("P"), F.col(key), F.when(F.col(key) % 4 == 0, "USDC").otherwise("USDT"))
    parts = table(spark, sf_dir, "part").select(name("p_partkey").alias("symbol"), F.col("p_brand").alias("base"), F.col("p_type").alias("kind"), F.col("p_retailprice").alias("price"), F.col("p_size").alias("size"))
    # sums of doubles hang on the order of the terms, and means of 5 % lie on a bound: terms are added in the order of the table's rows
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", "l_extendedprice", "l_discount", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    so_far = Window.partitionBy("l_partkey").orderBy("_file", "_row").rowsBetween(Window.unboundedPreceding, 0)
    sums = {"_k": F.count("*"), "turnover": F.sum("l_extendedprice"), "_total": F.sum("l_discount"), "_n": F.count("l_discount")}
    grown = lines.select("l_partkey", *[f.over(so_far).alias(k) for k, f in sums.items()])
    sold = grown.groupBy("l_partkey").agg(F.max_by(F.struct("turnover", "_total", "_n"), "_k").alias("v"))
    sold = sold.select(name("l_partkey").alias("symbol"), "v.turnover", (1e4 * F.try_divide("v._total", "v._n")).alias("bps"))
    return S.Universe(parts).augment(sold, ["turnover", "bps"])


@query("universe_select", f"""WITH {UNIVERSE}, f AS (SELECT * FROM j WHERE symbol LIKE '%USDT' AND turnover IS NOT NULL AND turnover >= 100000 AND bps BETWEEN 100 AND 900 AND size <= 40),
d AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY turnover DESC NULLS LAST, symbol) AS k FROM f),
o AS (SELECT * FROM d WHERE k = 1 ORDER BY turnover DESC, symbol LIMIT 15)
SELECT symbol, base, {r('turnover', 'turnover')}, {r('bps', 'bps')}, row_number() OVER (ORDER BY turnover DESC, price DESC, symbol) AS rank FROM o""")
def universe_select(spark, sf_dir):
    got = universe(spark, sf_dir).suffix(["USDT"]).between("turnover", 100000).between("bps", 100, 900).between("size", None, 40).best_per("base", "turnover").top("turnover", 15).ranked("turnover", "price")
    return W.rounded(got.df.select("symbol", "base", "turnover", "bps", F.col("rank").cast("long").alias("rank")), 6)


@query("universe_scores", f"""WITH {UNIVERSE}, s AS (SELECT *, CASE WHEN coalesce(bps >= 500, false) THEN 3.0 ELSE 0 END + CASE WHEN coalesce(turnover >= 200000, false) THEN 5.0 ELSE 0 END + CASE WHEN size > 25 THEN 1.5 ELSE 0 END AS score FROM j)
SELECT symbol, {r('score', 'score')}, CASE WHEN score >= 8 THEN 'STRONG_CANDIDATE' WHEN score >= 5 THEN 'CANDIDATE' WHEN score >= 2 THEN 'WATCHLIST' WHEN score >= -2 THEN 'SKIP' ELSE 'AVOID' END AS verdict,
  {r('least(100, greatest(0, score / 10 * 100))', 'scaled')}, {r("round((sign(coalesce(bps, 0) - 500) + sign(size - 25) + sign(price - 1500)) / 3, 2)", 'vote')} FROM s""")
def universe_scores(spark, sf_dir):
    df = universe(spark, sf_dir).df.withColumn("score", S.weighted_score({"rate": (F.col("bps") >= 500, 3.0), "turnover": (F.col("turnover") >= 200000, 5.0), "size": (F.col("size") > 25, 1.5)}))
    signals = [F.coalesce("bps", F.lit(0.0)) - 500, F.col("size") - 25.0, F.col("price") - 1500]
    return W.rounded(df.select("symbol", "score", S.verdict(F.col("score")).alias("verdict"), S.rescaled(F.col("score"), 0.0, 10.0).alias("scaled"), S.vote(signals).alias("vote")), 6)


@query("position_sizes", f"""WITH {UNIVERSE}
SELECT symbol, {r('coalesce(10000 * 0.01 / nullif(abs(price - price * 0.95), 0), 0)', 'risk')}, {r('floor(1000 / price / 0.01) * 0.01', 'steps')}, {r('price * (1 - 5 / 100.0)', 'stop')},
  {r('abs(price * 1.1 - price) / nullif(abs(price - price * 0.95), 0)', 'reward')}, {r('greatest(0, least(1, (0.55 - (1 - 0.55) / (size / 20.0)) * 0.5))', 'kelly')} FROM j""")
def position_sizes(spark, sf_dir):
    price = F.col("price")
    return W.rounded(universe(spark, sf_dir).df.select(
        "symbol", S.risk_size(F.lit(10000.0), price, price * 0.95).alias("risk"), S.whole_steps(1000 / price, F.lit(0.01)).alias("steps"), S.stop_price(price, F.lit(True), 5.0).alias("stop"),
        S.reward_ratio(price, price * 0.95, price * 1.1).alias("reward"), S.kelly(F.lit(0.55), F.col("size").cast("double"), F.lit(20.0)).alias("kelly")), 6)


CROSS = f"""{BARS_SQL}, m AS (SELECT *, {g('avg(close)', 'close', 5)} AS f, {g('avg(close)', 'close', 20)} AS s FROM bars),
x AS (SELECT *, coalesce(lag(f) OVER w <= lag(s) OVER w AND f > s, false) AS enter, coalesce(lag(f) OVER w >= lag(s) OVER w AND f < s, false) AS leave FROM m WINDOW w AS ({SERIES_SQL})),
h AS (SELECT *, coalesce(last_value(CASE WHEN enter THEN 1.0 WHEN leave THEN 0.0 END IGNORE NULLS) OVER ({SERIES_SQL} ROWS UNBOUNDED PRECEDING), 0) AS state FROM x),
p AS (SELECT *, coalesce({lag('state')}, 0) AS position FROM h),
n AS (SELECT *, abs(position - coalesce({lag('position')}, 0)) AS traded FROM p),
q AS (SELECT *, position * coalesce(lead(open) OVER ({SERIES_SQL}) / nullif(open, 0) - 1, 0) - traded * 0.001 AS net FROM n)"""


def crossed(spark, sf_dir):
    df = hourly(spark, sf_dir).withColumns({"f": W.mean("close", 5), "s": W.mean("close", 20)})
    df = df.withColumns({"enter": W.cross_above("f", "s"), "leave": W.cross_below("f", "s")})
    return backtest.returns(backtest.hold(df, "enter", "leave"))


@query("backtest_positions", f"WITH {CROSS} SELECT symbol, ts, {r('position', 'position')}, {r('traded', 'traded')}, {r('net', 'net')} FROM q")
def backtest_positions(spark, sf_dir):
    return W.rounded(crossed(spark, sf_dir).select("symbol", "ts", "position", "traded", "net"), 6)


@query("backtest_summary", f"""WITH {CROSS}, c AS (SELECT symbol, count(*) AS bars, sum(traded) AS traded, avg(net) / nullif(stddev_samp(net), 0) * sqrt(8760) AS sharpe FROM q GROUP BY symbol)
SELECT symbol, bars, {r('traded', 'traded')}, {r('sharpe', 'sharpe')} FROM c""")
def backtest_summary(spark, sf_dir):
    got = crossed(spark, sf_dir).groupBy("symbol").agg(
        F.count("*").alias("bars"), F.sum("traded").alias("traded"), (F.try_divide(F.avg("net"), F.stddev_samp("net")) * F.sqrt(F.lit(8760.0))).alias("sharpe")
    )
    return W.rounded(got, 6)


def ewm_sql(x: str, alpha: float, n: int, name: str) -> str:
    """An exponential mean from the first value on, as a running sum of values over powers of its decay."""
    a, d = repr(alpha), repr(1 - alpha)
    k = f"(row_number() OVER ({SERIES_SQL}) - 1)"
    return f"CASE WHEN {k} + 1 >= {n} THEN power({d}, {k}) * sum(CASE WHEN k0 = 0 THEN {x} ELSE {a} * {x} * power({d}, -k0) END) OVER ({SERIES_SQL} ROWS UNBOUNDED PRECEDING) END AS {name}"


@query("recurrent_means", f"""WITH {BARS_SQL}, k AS (SELECT *, row_number() OVER ({SERIES_SQL}) - 1 AS k0, greatest(high - low, abs(high - {lag('close')}), abs(low - {lag('close')})) AS tr FROM bars),
e AS (SELECT *, {ewm_sql('close', 2 / 21, 20, 'ema')}, {ewm_sql('close', 1 / 14, 14, 'rma')}, {ewm_sql('tr', 1 / 14, 14, 'atr')} FROM k)
SELECT symbol, ts, {r('ema', 'ema')}, {r('rma', 'rma')}, {r('atr', 'atr')} FROM e""")
def recurrent_means(spark, sf_dir):
    df = recurrences.recur(hourly(spark, sf_dir), {"exponential": {}, "wilder_mean": {}, "atr": {}})
    return W.rounded(df.select("symbol", "ts", "ema", "rma", "atr"), 6)


_WILDER, _EMA = (lambda before, x, n: f"{before} + ({x} - {before}) / {n}.0"), (lambda before, x, n: f"{before} + ({x} - {before}) * 2 / {n + 1}.0")

#: All that recurs, row by row: each step of the recursion sees the state of the bar before.
RECURRENT = f"""b AS (SELECT symbol, ts, open, high, low, close, row_number() OVER w - 1 AS k, lead(close) OVER w AS next_close, lag(close) OVER w AS c1, lag(high) OVER w AS h1, lag(low) OVER w AS l1,
    coalesce(lag(high, 2) OVER w, lag(high) OVER w) AS h2, coalesce(lag(low, 2) OVER w, lag(low) OVER w) AS l2, greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) AS tr,
    CASE WHEN high - lag(high) OVER w > lag(low) OVER w - low AND high > lag(high) OVER w THEN high - lag(high) OVER w ELSE 0 END AS dp,
    CASE WHEN lag(low) OVER w - low > high - lag(high) OVER w AND low < lag(low) OVER w THEN lag(low) OVER w - low ELSE 0 END AS dm FROM bars WINDOW w AS ({SERIES_SQL})),
s AS (SELECT symbol, k, close AS e12, close AS e26, NULL::DOUBLE AS sig, NULL::DOUBLE AS up, NULL::DOUBLE AS down, tr AS a14, dp AS p14, dm AS m14, 0.0::DOUBLE AS plus, 0.0::DOUBLE AS minus, 0.0::DOUBLE AS dx,
    close AS e1, NULL::DOUBLE AS e2, NULL::DOUBLE AS e3, close AS e20, tr AS a10, (open + close) / 2 AS ha, (open + high + low + close) / 4 AS hc,
    NULL::DOUBLE AS su, NULL::DOUBLE AS sl, NULL::DOUBLE AS way, next_close >= close AS rising, CASE WHEN next_close >= close THEN low WHEN next_close < close THEN high END AS sar,
    CASE WHEN next_close >= close THEN high ELSE low END AS extreme, 0.02::DOUBLE AS pace FROM b WHERE k = 0
  UNION ALL
  SELECT symbol, k, e12, e26, sig, up, down, a14, p14, m14, plus, minus, dx + (CASE WHEN plus + minus <> 0 THEN 100 * abs(plus - minus) / (plus + minus) ELSE 0 END - dx) / 14.0, e1, e2, e3, e20, a10, ha, hc,
    su, sl, CASE WHEN k < 9 THEN NULL WHEN way IS NULL THEN 1.0 WHEN close > su0 THEN 1.0 WHEN close < sl0 THEN -1.0 ELSE way END,
    CASE WHEN rising THEN NOT low < sar ELSE high > sar END, CASE WHEN rising AND low < sar OR NOT rising AND high > sar THEN extreme ELSE sar END,
    CASE WHEN rising AND low < sar THEN low WHEN NOT rising AND high > sar THEN high WHEN rising THEN greatest(extreme, high) ELSE least(extreme, low) END,
    CASE WHEN rising AND low < sar OR NOT rising AND high > sar THEN 0.02 WHEN rising AND high > extreme OR NOT rising AND low < extreme THEN least(0.2, pace + 0.02) ELSE pace END
  FROM (SELECT *, CASE WHEN k >= 9 THEN CASE WHEN su0 IS NULL OR mid + 3 * a10 < su0 OR c1 > su0 THEN mid + 3 * a10 ELSE su0 END END AS su, CASE WHEN k >= 9 THEN CASE WHEN sl0 IS NULL OR mid - 3 * a10 > sl0 OR c1 < sl0 THEN mid - 3 * a10 ELSE sl0 END END AS sl,
      CASE WHEN k >= 13 AND a14 <> 0 THEN 100 * p14 / a14 ELSE 0 END AS plus, CASE WHEN k >= 13 AND a14 <> 0 THEN 100 * m14 / a14 ELSE 0 END AS minus,
      CASE WHEN rising THEN least(sar0, l1, l2) ELSE greatest(sar0, h1, h2) END AS sar, CASE WHEN k = 9 THEN e1 WHEN k > 9 THEN {_EMA('e2_0', 'e1', 10)} END AS e2,
      CASE WHEN k = 18 THEN {_EMA('e2_0', 'e1', 10)} WHEN k > 18 THEN {_EMA('e3_0', f"({_EMA('e2_0', 'e1', 10)})", 10)} END AS e3, CASE WHEN k = 25 THEN e12 - e26 WHEN k > 25 THEN {_EMA('sig0', '(e12 - e26)', 9)} END AS sig
    FROM (SELECT b.symbol, b.k, b.high, b.low, b.close, c1, h1, l1, h2, l2, (b.high + b.low) / 2 AS mid, {_EMA('e12', 'b.close', 12)} AS e12, {_EMA('e26', 'b.close', 26)} AS e26, sig AS sig0,
        CASE WHEN up IS NULL THEN greatest(b.close - c1, 0) ELSE {_WILDER('up', 'greatest(b.close - c1, 0)', 14)} END AS up, CASE WHEN down IS NULL THEN greatest(c1 - b.close, 0) ELSE {_WILDER('down', 'greatest(c1 - b.close, 0)', 14)} END AS down,
        {_WILDER('a14', 'b.tr', 14)} AS a14, {_WILDER('p14', 'b.dp', 14)} AS p14, {_WILDER('m14', 'b.dm', 14)} AS m14, dx, {_EMA('e1', 'b.close', 10)} AS e1, e2 AS e2_0, e3 AS e3_0, {_EMA('e20', 'b.close', 20)} AS e20, {_WILDER('a10', 'b.tr', 10)} AS a10,
        (ha + hc) / 2 AS ha, (b.open + b.high + b.low + b.close) / 4 AS hc, su AS su0, sl AS sl0, way, rising, sar + pace * (extreme - sar) AS sar0, extreme, pace FROM s JOIN b ON b.symbol = s.symbol AND b.k = s.k + 1))),
o AS (SELECT b.*, s.* EXCLUDE (symbol, k), CASE WHEN b.k >= 14 THEN CASE WHEN down = 0 THEN CASE WHEN up > 0 THEN 100.0 ELSE 0.0 END ELSE 100 - 100 / (1 + up / down) END END AS rsi FROM b JOIN s ON s.symbol = b.symbol AND s.k = b.k),
f AS (SELECT *, 100 * coalesce((rsi - {g('min(rsi)', 'rsi', 14)}) / nullif({g('max(rsi)', 'rsi', 14)} - {g('min(rsi)', 'rsi', 14)}, 0), 0.5) AS fast FROM o), h AS (SELECT *, {g('avg(fast)', 'fast', 3)} AS sk FROM f)"""


@query("recurrent_indicators", f"""WITH RECURSIVE {BARS_SQL}, {RECURRENT}
SELECT symbol, ts, {', '.join(r(x, name, 5) for name, x in {
    'ema': 'CASE WHEN k >= 19 THEN e20 END', 'rsi': 'rsi', 'macd': 'CASE WHEN k >= 25 THEN e12 - e26 END', 'macd_signal': 'CASE WHEN k >= 33 THEN sig END', 'macd_hist': 'CASE WHEN k >= 33 THEN e12 - e26 - sig END',
    'adx': 'CASE WHEN k >= 13 THEN dx END', 'plus_di': 'plus', 'minus_di': 'minus', 'dema': 'CASE WHEN k >= 18 THEN 2 * e1 - e2 END', 'tema': 'CASE WHEN k >= 27 THEN 3 * e1 - 3 * e2 + e3 END',
    'trix': f"CASE WHEN k >= 28 THEN 1e4 * coalesce((e3 - {lag('e3')}) / nullif({lag('e3')}, 0), 0) ELSE 0 END", 'kc_upper': 'CASE WHEN k >= 19 THEN e20 + 2 * a10 END', 'kc_middle': 'CASE WHEN k >= 19 THEN e20 END', 'kc_lower': 'CASE WHEN k >= 19 THEN e20 - 2 * a10 END',
    'stochrsi_k': 'sk', 'stochrsi_d': g('avg(sk)', 'sk', 3), 'ha_open': 'ha', 'ha_high': 'greatest(high, ha, hc)', 'ha_low': 'least(low, ha, hc)', 'ha_close': 'hc',
    'supertrend': 'CASE WHEN way > 0 THEN sl WHEN way < 0 THEN su END', 'supertrend_dir': 'way', 'psar': 'sar'}.items())} FROM h""")
def recurrent_indicators(spark, sf_dir):
    """All that recurs, in one grouped pass."""
    wanted = {k: {} for k in recurrences.KERNELS if k not in ("wilder_mean", "atr")}
    df = recurrences.recur(hourly(spark, sf_dir), wanted)
    return W.rounded(df.select("symbol", "ts", *[o for k in wanted for o in recurrences.KERNELS[k][0]]), 5)


@query("volume_bars", f"""WITH k AS (SELECT event_type AS symbol, ts, event_id AS seq, CASE WHEN isfinite(value) THEN value END AS price, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS k FROM events)
SELECT symbol, k // 25 AS bar, {r('arg_min(price, k) FILTER (WHERE price IS NOT NULL)', 'open')}, {r('max(price)', 'high')}, {r('min(price)', 'low')}, {r('arg_max(price, k) FILTER (WHERE price IS NOT NULL)', 'close')},
  25::DOUBLE AS volume FROM k GROUP BY ALL HAVING count(*) = 25""")
def volume_bars(spark, sf_dir):
    return W.rounded(recurrences.tick_bars(ticks(spark, sf_dir), 25.0), 6)  # ticks have quantity 1


@query("derivative_states", f"""WITH {BARS_SQL}, d AS (SELECT *, {lag('close', 20)} AS c20, {lag('volume', 20)} AS v20, sum(CASE WHEN close > open THEN volume ELSE 0 END) {over(12)} AS b, sum(CASE WHEN close < open THEN volume ELSE 0 END) {over(12)} AS s FROM bars)
SELECT symbol, ts, CASE WHEN close > c20 AND volume > v20 THEN 'bullish_buildup' WHEN close < c20 AND volume > v20 THEN 'bearish_buildup' WHEN close < c20 AND volume < v20 THEN 'long_squeeze' WHEN close > c20 AND volume < v20 THEN 'short_squeeze' ELSE 'none' END AS state,
  {r('coalesce((b - s) / nullif(b + s, 0), 0)', 'imbalance')}, {r('b - s', 'inflow')}, {r(f'sum(CASE WHEN close > open THEN volume WHEN close < open THEN -volume ELSE 0 END) OVER ({SERIES_SQL})', 'cvd')} FROM d""")
def derivative_states(spark, sf_dir):
    df = hourly(spark, sf_dir)
    up, down = F.when(F.col("close") > F.col("open"), F.col("volume")).otherwise(0.0), F.when(F.col("close") < F.col("open"), F.col("volume")).otherwise(0.0)
    dc, dv = F.signum(F.col("close") - W.prev("close", 20)), F.signum(F.col("volume") - W.prev("volume", 20))
    state = F.when((dc > 0) & (dv > 0), "bullish_buildup").when((dc < 0) & (dv > 0), "bearish_buildup").when((dc < 0) & (dv < 0), "long_squeeze").when((dc > 0) & (dv < 0), "short_squeeze").otherwise("none")
    b, s = F.sum(up).over(W.trailing(12)), F.sum(down).over(W.trailing(12))
    df = df.withColumns({"state": state, "imbalance": W.div(b - s, b + s, 0.0), "inflow": b - s, "cvd": F.sum(up - down).over(W.so_far())})
    return W.rounded(df.select("symbol", "ts", "state", "imbalance", "inflow", "cvd"), 6)


@query("regimes", f"""WITH {BARS_SQL}, a AS (SELECT *, close / nullif({lag('close')}, 0) - 1 AS ret, {g('avg(close)', 'close', 5)} AS m5, {g('avg(close)', 'close', 20)} AS m20,
  {g('max(high)', 'high', 20)} AS xh, {g('min(low)', 'low', 20)} AS xl FROM bars), b AS (SELECT *, {g('stddev_pop(ret)', 'ret', 20)} AS vol FROM a)
SELECT symbol, ts, CASE WHEN close > m5 AND m5 > m20 THEN 'uptrend' WHEN close < m5 AND m5 < m20 THEN 'downtrend' ELSE 'sideways' END AS trend,
  CASE WHEN coalesce((xh - xl) / nullif((xh + xl) / 2, 0) <= 1.5, false) THEN 'range' ELSE 'trend' END AS range_state,
  coalesce(vol > CASE WHEN count(vol) {over(100)} >= 50 THEN quantile_cont(vol, 0.8) {over(100)} END, false) AS volatile, coalesce(m20 > {lag('m20', 5)}, false) AS rising FROM b""")
def regimes(spark, sf_dir):
    df = hourly(spark, sf_dir).withColumns({"ret": W.change("close"), "m5": W.mean("close", 5), "m20": W.mean("close", 20)}).withColumn("vol", W.deviation("ret", 20))
    high, low = W.highest("high", 20), W.lowest("low", 20)
    w = W.trailing(100)
    limit = F.when(F.count("vol").over(w) >= 50, F.percentile("vol", F.lit(0.8)).over(w))
    up, down = (F.col("close") > F.col("m5")) & (F.col("m5") > F.col("m20")), (F.col("close") < F.col("m5")) & (F.col("m5") < F.col("m20"))
    return df.select(
        "symbol", "ts", F.when(up, "uptrend").when(down, "downtrend").otherwise("sideways").alias("trend"), F.when(W.yes(W.div(high - low, (high + low) / 2) <= 1.5), "range").otherwise("trend").alias("range_state"),
        W.yes(F.col("vol") > limit).alias("volatile"), W.yes(F.col("m20") > W.prev("m20", 5)).alias("rising"))


@query("market_structure", f"""WITH {BARS_SQL}, a AS (SELECT *, coalesce(high > max(high) OVER ({SERIES_SQL} ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AND high >= max(high) OVER ({SERIES_SQL} ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING), false) AS ph,
  coalesce(low < min(low) OVER ({SERIES_SQL} ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AND low <= min(low) OVER ({SERIES_SQL} ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING), false) AS pl, {lag('high', 2)} AS h2, {lag('low', 2)} AS l2 FROM bars)
SELECT symbol, ts, ph AS pivot_high, pl AS pivot_low, CASE WHEN low > h2 THEN 'up' WHEN high < l2 THEN 'down' END AS gap, {r('CASE WHEN low > h2 THEN low - h2 WHEN high < l2 THEN l2 - high END', 'gap_size')} FROM a""")
def market_structure(spark, sf_dir):
    df = hourly(spark, sf_dir)
    before, after = W.series().rowsBetween(-5, -1), W.series().rowsBetween(1, 5)
    h2, l2 = W.prev("high", 2), W.prev("low", 2)
    df = df.withColumns({
        "pivot_high": W.yes((F.col("high") > F.max("high").over(before)) & (F.col("high") >= F.max("high").over(after))),
        "pivot_low": W.yes((F.col("low") < F.min("low").over(before)) & (F.col("low") <= F.min("low").over(after))),
        "gap": F.when(F.col("low") > h2, "up").when(F.col("high") < l2, "down"), "gap_size": F.when(F.col("low") > h2, F.col("low") - h2).when(F.col("high") < l2, l2 - F.col("high")),
    })
    return W.rounded(df.select("symbol", "ts", "pivot_high", "pivot_low", "gap", "gap_size"), 6)


@query("user_activity", """SELECT user_id, count(*) FILTER (WHERE age < 3600) AS n_1h, count(*) FILTER (WHERE age < 86400) AS n_24h, count(*) FILTER (WHERE age < 604800) AS n_7d
FROM (SELECT user_id, epoch(TIMESTAMP '2024-01-31 00:00:00') - epoch(ts) AS age FROM events) WHERE true GROUP BY user_id""")
def user_activity(spark, sf_dir):
    now = F.lit("2024-01-31 00:00:00").cast("timestamp")
    return news.windowed_counts(table(spark, sf_dir, "events"), now, {"1h": 3600, "24h": 86400, "7d": 604800}, "user_id", "ts")


@query("news_labels", r"""WITH t AS (SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM benchmark),
c AS (SELECT item_id, len(w) AS n_words, len(list_filter(w, lambda x: x IN ('the', 'of'))) AS g, len(list_filter(w, lambda x: x IN ('and', 'to'))) AS b FROM t)
SELECT item_id, n_words, CASE WHEN g > 0 THEN 'the' WHEN b > 0 THEN 'and' ELSE 'other' END AS topic, round(coalesce((g - b) / nullif(g + b, 0), 0), 6) + 0.0 AS tendency FROM c""")
def news_labels(spark, sf_dir):
    text = F.col("text")
    return W.rounded(table(spark, sf_dir, "benchmark").select(
        "item_id", F.size(news.tokens(text)).cast("long").alias("n_words"), news.label(text, {"the": ["the", "of"], "and": ["and", "to"]}).alias("topic"), news.tendency(text, ["the", "of"], ["and", "to"]).alias("tendency")), 6)


@query("pivot_counts", """SELECT user_id, count(*) FILTER (WHERE event_type = 'click') AS click, count(*) FILTER (WHERE event_type = 'view') AS view, count(*) FILTER (WHERE event_type = 'error') AS error FROM events GROUP BY user_id""")
def pivot_counts(spark, sf_dir):
    got = table(spark, sf_dir, "events").groupBy("user_id").pivot("event_type", ["click", "view", "error"]).count()
    return got.na.fill(0)


@query("semi_anti", """SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000) AS big FROM customer
WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')""")
def semi_anti(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "c_custkey")
    left = table(spark, sf_dir, "customer").select("c_custkey").join(orders.filter("o_orderstatus = 'P'").select("c_custkey"), "c_custkey", "left_anti")
    big = orders.filter("o_totalprice > 300000").select("c_custkey").distinct().withColumn("big", F.lit(True))
    return left.join(big, "c_custkey", "left").select("c_custkey", F.coalesce("big", F.lit(False)).alias("big"))


STRUCTURE = f"""{BARS_SQL}, pv AS (SELECT *, coalesce(high > max(high) OVER b AND high >= max(high) OVER a, false) AS ph, coalesce(low < min(low) OVER b AND low <= min(low) OVER a, false) AS pl FROM bars
  WINDOW b AS ({SERIES_SQL} ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), a AS ({SERIES_SQL} ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING)),
lg AS (SELECT *, {lag('CASE WHEN ph THEN high END', 5)} AS h5, {lag('CASE WHEN pl THEN low END', 5)} AS l5 FROM pv),
lv AS (SELECT *, last_value(h5 IGNORE NULLS) OVER ({SERIES_SQL} ROWS UNBOUNDED PRECEDING) AS lh, last_value(l5 IGNORE NULLS) OVER ({SERIES_SQL} ROWS UNBOUNDED PRECEDING) AS ll FROM lg),
sd AS (SELECT *, CASE WHEN close > lh THEN 'up' WHEN close < ll THEN 'down' END AS side FROM lv),
st AS (SELECT *, last_value(side IGNORE NULLS) OVER ({SERIES_SQL} ROWS UNBOUNDED PRECEDING) AS state FROM sd)"""


@query("market_zones", f"""WITH {STRUCTURE}, w AS (SELECT *, {lag('side')} AS s1, {lag('state')} AS t1 FROM st)
SELECT symbol, ts, {r('lh', 'level_high')}, {r('ll', 'level_low')},
  CASE WHEN coalesce(low < ll AND close > ll, false) THEN 'bull' WHEN coalesce(high > lh AND close < lh, false) THEN 'bear' ELSE 'none' END AS sweep,
  CASE WHEN lh + ll IS NULL THEN 'none' WHEN close > (lh + ll) / 2 * 1.001 THEN 'premium' WHEN close < (lh + ll) / 2 * (1 - 0.001) THEN 'discount' ELSE 'equilibrium' END AS zone,
  CASE WHEN side IS NOT NULL AND coalesce(s1 <> side, true) AND coalesce(t1 <> side, false) THEN 'turn' WHEN side IS NOT NULL AND coalesce(s1 <> side, true) AND coalesce(t1 = side, false) THEN 'continue' ELSE 'none' END AS structure FROM w""")
def market_zones(spark, sf_dir):
    from tidemill.functions import structure as M

    df = M.trend_breaks(hourly(spark, sf_dir))
    return W.rounded(df.select("symbol", "ts", "level_high", "level_low", M.sweep_side().alias("sweep"), M.zone().alias("zone"), "structure"), 6)


@query("equal_highs", f"""WITH {STRUCTURE}, c AS (SELECT *, list_reverse(list(h5) FILTER (WHERE h5 IS NOT NULL) {over(400)})[1:20] AS seen FROM lg)
SELECT symbol, ts, CASE WHEN len(seen) > 0 THEN len(list_filter(seen, lambda x: abs(x - seen[1]) <= seen[1] * (2.0 / 100))) ELSE 0 END AS n_equal_highs FROM c""")
def equal_highs(spark, sf_dir):
    from tidemill.functions import structure as M

    return M.equal_levels(hourly(spark, sf_dir), 2.0).select("symbol", "ts", F.col("n_equal_highs").cast("long").alias("n_equal_highs"))


def _cluster_sql(side: str, pivot: str) -> str:
    """Clusters at the bars that confirm a pivot: the pivots of the last 20 near to the newest."""
    return f"""{side}s AS (SELECT symbol, ts, {pivot} AS newest, list({pivot}) OVER ({SERIES_SQL} ROWS 19 PRECEDING) AS seen FROM lg WHERE {pivot} IS NOT NULL),
{side} AS (SELECT symbol, ts, list_filter(seen, lambda x: abs(x - newest) <= newest * (2.0 / 100)) AS near FROM {side}s)"""


@query("equal_levels", f"""WITH {STRUCTURE}, {_cluster_sql('eqh', 'h5')}, {_cluster_sql('eql', 'l5')}
SELECT lg.symbol, lg.ts, {r('CASE WHEN len(eqh.near) > 1 THEN list_avg(eqh.near) END', 'eqh_level')}, CASE WHEN len(eqh.near) > 1 THEN len(eqh.near) ELSE 0 END AS eqh_count,
  {r('CASE WHEN len(eql.near) > 1 THEN list_avg(eql.near) END', 'eql_level')}, CASE WHEN len(eql.near) > 1 THEN len(eql.near) ELSE 0 END AS eql_count
FROM lg ASOF LEFT JOIN eqh ON lg.symbol = eqh.symbol AND lg.ts >= eqh.ts ASOF LEFT JOIN eql ON lg.symbol = eql.symbol AND lg.ts >= eql.ts""")
def equal_levels(spark, sf_dir):
    from tidemill.functions import structure as M

    return W.rounded(M.equal_levels(hourly(spark, sf_dir), 2.0).select("symbol", "ts", "eqh_level", F.col("eqh_count").cast("long").alias("eqh_count"), "eql_level", F.col("eql_count").cast("long").alias("eql_count")), 6)
