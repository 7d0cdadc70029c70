"""Queries over hourly bars of events, with SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemill.functions import indicators as I
from tidemill.functions import patterns as P
from tidemill.functions import windows as W
from tidemill.sources.bars import BARS_SQL, bars

QUERIES: dict = {}
SQL: dict = {}


def query(name: str, sql: str):
    def keep(f):
        QUERIES[name] = f
        SQL[name] = sql
        return f

    return keep


def hourly(spark, sf_dir):
    return bars(spark, sf_dir, "1h")


def result(df, *columns, digits=6):
    return W.rounded(df.select("symbol", "ts", *columns), digits)


S = "PARTITION BY symbol ORDER BY ts"


def over(n: int, skip: int = 0) -> str:
    return f"OVER ({S} ROWS BETWEEN {n - 1 + skip} PRECEDING AND {skip} PRECEDING)" if skip else f"OVER ({S} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def g(agg: str, x: str, n: int, skip: int = 0) -> str:
    """Count-gated aggregate over a trailing window."""
    return f"(CASE WHEN count({x}) {over(n, skip)} = {n} THEN {agg} {over(n, skip)} END)"


def lag(x: str, k: int = 1) -> str:
    return f"lag({x}, {k}) OVER ({S})"


def r(x: str, name: str, digits: int = 6) -> str:
    return f"round({x}, {digits}) + 0.0 AS {name}"


@query("golden_cross", f"""WITH {BARS_SQL},
m AS (SELECT *, {g('avg(close)', 'close', 5)} AS fast, {g('avg(close)', 'close', 20)} AS slow FROM bars),
x AS (SELECT *, lag(fast) OVER w <= lag(slow) OVER w AND fast > slow AS up FROM m WINDOW w AS ({S}))
SELECT symbol, ts, {r('close', 'close')}, {r('fast', 'fast')}, {r('slow', 'slow')} FROM x WHERE up""")
def golden_cross(spark, sf_dir):
    df = hourly(spark, sf_dir).withColumns({"fast": I.sma("close", 5), "slow": I.sma("close", 20)})
    return result(df.withColumn("_up", W.cross_above("fast", "slow")).filter("_up"), "close", "fast", "slow")


@query("bars_hourly", f"""WITH {BARS_SQL} SELECT symbol, ts, {r('open', 'open')}, {r('high', 'high')}, {r('low', 'low')}, {r('close', 'close')}, volume, {r('quote_volume', 'quote_volume')}, trades FROM bars""")
def bars_hourly(spark, sf_dir):
    return result(hourly(spark, sf_dir), "open", "high", "low", "close", "volume", "quote_volume", "trades")


@query("bars_resampled", f"""WITH {BARS_SQL},
d AS (SELECT symbol, to_timestamp(floor(epoch(ts) / 14400) * 14400)::TIMESTAMP AS ts, arg_min(open, ts) AS open, max(high) AS high, min(low) AS low,
  arg_max(close, ts) AS close, sum(volume) AS volume, CAST(sum(trades) AS BIGINT) AS trades, count(*) AS parts FROM bars GROUP BY 1, 2)
SELECT symbol, ts, {r('open', 'open')}, {r('high', 'high')}, {r('low', 'low')}, {r('close', 'close')}, volume, trades FROM d WHERE parts = 4""")
def bars_resampled(spark, sf_dir):
    from tidemill.sources.bars import resample_bars

    return result(resample_bars(hourly(spark, sf_dir), "4h", 4), "open", "high", "low", "close", "volume", "trades")


@query("ind_averages", f"""WITH {BARS_SQL}, t AS (SELECT *, (high + low + close) / 3 AS tp FROM bars),
w8 AS (SELECT *, ({' + '.join(f'{8 - k} * {lag("close", k)}' for k in range(8))}) / 36 AS wma8, ({' + '.join(f'{16 - k} * {lag("close", k)}' for k in range(16))}) / 136 AS wma16 FROM t),
h AS (SELECT *, 2 * wma8 - wma16 AS hull FROM w8)
SELECT symbol, ts, {r(g('avg(close)', 'close', 20), 'sma', 8)}, {r('wma8', 'wma', 8)}, {r(f'({" + ".join(f"{4 - k} * {lag("hull", k)}" for k in range(4))}) / 10', 'hma', 8)},
  {r(g('sum(close * volume)', 'close', 20) + ' / nullif(' + g('sum(volume)', 'volume', 20) + ', 0)', 'vwma', 8)},
  {r(f'coalesce(sum(tp * volume) OVER ({S}) / nullif(sum(volume) OVER ({S}), 0), 0)', 'vwap', 8)},
  {r(g('avg((high + low) / 2)', 'high', 5) + ' - ' + g('avg((high + low) / 2)', 'high', 34), 'ao', 8)} FROM h""")
def ind_averages(spark, sf_dir):
    df = I.hull_mean(hourly(spark, sf_dir).withColumns({"sma": I.sma("close", 20), "wma": I.weighted_mean("close", 8)}), 16)
    return result(df.withColumns({"vwma": I.volume_weighted_mean(20), "vwap": I.running_vwap(), "ao": I.awesome()}), "sma", "wma", "hma", "vwma", "vwap", "ao", digits=8)


@query("ind_bands", f"""WITH {BARS_SQL},
b AS (SELECT *, {g('avg(close)', 'close', 20)} AS m, {g('stddev_pop(close)', 'close', 20)} AS s FROM bars),
w AS (SELECT *, m + 2 * s AS u, m - 2 * s AS l, 100 * coalesce(4 * s / nullif(m, 0), 0) AS bw FROM b)
SELECT symbol, ts, {r('u', 'bb_upper')}, {r('m', 'bb_middle')}, {r('l', 'bb_lower')}, {r('bw', 'bb_width')}, {r('coalesce((close - l) / nullif(u - l, 0), 0.5)', 'bb_percent')},
  bw <= 4 OR coalesce(bw / nullif({g('avg(bw)', 'bw', 20)}, 0), 1.0) < 0.5 AS bb_narrow,
  {r(g('max(high)', 'high', 20), 'dc_upper')}, {r(g('min(low)', 'low', 20), 'dc_lower')}, {r('coalesce((close - m) / nullif(s, 0), 0)', 'zscore')},
  {r(g('quantile_cont(close, 0.8)', 'close', 20), 'q80')} FROM w""")
def ind_bands(spark, sf_dir):
    df = I.donchian(I.bollinger_shape(hourly(spark, sf_dir)), 20).withColumns({"zscore": I.zscore("close", 20), "q80": W.quantile("close", 20, 0.8)})
    return result(df, "bb_upper", "bb_middle", "bb_lower", "bb_width", "bb_percent", "bb_narrow", "dc_upper", "dc_lower", "zscore", "q80")


@query("ind_oscillators", f"""WITH {BARS_SQL},
a AS (SELECT *, (high + low + close) / 3 AS tp, {g('min(low)', 'low', 14)} AS lo, {g('max(high)', 'high', 14)} AS hi FROM bars),
b AS (SELECT *, 100 * coalesce((close - lo) / nullif(hi - lo, 0), 0.5) AS raw, sign(tp - {lag('tp')}) AS dir, {g('avg(tp)', 'tp', 20)} AS m, list(tp) {over(20)} AS ws FROM a),
c AS (SELECT *, {g('avg(raw)', 'raw', 3)} AS k, CASE WHEN dir > 0 THEN tp * volume ELSE 0 END AS pos, CASE WHEN dir < 0 THEN tp * volume ELSE 0 END AS neg,
  list_sum(list_transform(ws, lambda x: abs(x - m))) / 20 AS mad FROM b),
d AS (SELECT *, {g('sum(pos)', 'pos', 14)} AS p, {g('sum(neg)', 'neg', 14)} AS n FROM c)
SELECT symbol, ts, {r('k', 'stoch_k')}, {r(g('avg(k)', 'k', 3), 'stoch_d')}, {r('-100 * (hi - close) / nullif(hi - lo, 0)', 'williams')},
  {r('(tp - m) / nullif(0.015 * mad, 0)', 'cci')},
  {r('CASE WHEN n = 0 AND p = 0 THEN NULL WHEN n = 0 THEN 100 ELSE 100 - 100 / (1 + p / n) END', 'mfi')} FROM d""")
def ind_oscillators(spark, sf_dir):
    df = I.commodity_channel(I.money_flow(I.stochastic(hourly(spark, sf_dir)))).withColumn("williams", I.williams())
    return result(df, "stoch_k", "stoch_d", "williams", "cci", "mfi")


@query("ind_volume", f"""WITH {BARS_SQL},
a AS (SELECT *, coalesce(sign(close - {lag('close')}), 0) * volume AS f, coalesce(close / nullif({lag('close')}, 0) - 1, 0) * volume AS p,
  coalesce(((close - low) - (high - close)) / nullif(high - low, 0), 0) * volume AS m, CASE WHEN close > open THEN volume ELSE 0.0 END AS green FROM bars),
b AS (SELECT *, coalesce({g('avg(volume)', 'volume', 5)} / nullif({g('avg(volume)', 'volume', 20)}, 0), 1.0) AS ratio,
  coalesce({g('sum(green)', 'green', 5)} / nullif({g('sum(volume)', 'volume', 5)}, 0), 0.5) AS share FROM a)
SELECT symbol, ts, {r(f'sum(f) OVER ({S})', 'obv', 4)}, {r(f'sum(p) OVER ({S})', 'pvt', 4)}, {r('coalesce(' + g('sum(m)', 'm', 20) + ' / nullif(' + g('sum(volume)', 'volume', 20) + ', 0), 0)', 'cmf', 4)},
  {r('coalesce((volume - ' + g('avg(volume)', 'volume', 20) + ') / nullif(' + g('stddev_pop(volume)', 'volume', 20) + ', 0), 0)', 'volume_z', 4)},
  {r('coalesce(volume / nullif(' + g('avg(volume)', 'volume', 20, 1) + ', 0), 1)', 'surge', 4)},
  CASE WHEN ratio < 0.7 THEN 'DRYING_UP' WHEN ratio > 1.2 AND share < 0.4 THEN 'DISTRIBUTING' WHEN ratio > 1.2 AND share > 0.6 THEN 'ACCUMULATING' ELSE 'NEUTRAL' END AS volume_trend FROM b""")
def ind_volume(spark, sf_dir):
    df = I.chaikin_flow(I.price_volume_trend(I.on_balance_volume(hourly(spark, sf_dir))))
    df = df.withColumns({"volume_z": I.zscore("volume", 20), "surge": I.surge(), "volume_trend": I.volume_trend()})
    return result(df, "obv", "pvt", "cmf", "volume_z", "surge", "volume_trend", digits=4)


@query("ind_trend", f"""WITH {BARS_SQL},
a AS (SELECT *, greatest(high - low, abs(high - {lag('close')}), abs(low - {lag('close')})) AS tr, list(high) {over(15)} AS hs, list(low) {over(15)} AS ls,
  {g('min(low)', 'low', 90)} AS l90, {g('max(high)', 'high', 90)} AS h90, {g('avg(close)', 'close', 5)} AS m5, {g('avg(close)', 'close', 10)} AS m10, {g('avg(close)', 'close', 20)} AS m20,
  CAST(close > open AS INTEGER) AS green, 100 * coalesce(abs(close - open) / nullif(high - low, 0), 0) AS body FROM bars),
b AS (SELECT *, CASE WHEN len(hs) = 15 THEN 100.0 * (14 - (list_position(list_reverse(hs), list_max(hs)) - 1)) / 14 END AS up,
  CASE WHEN len(ls) = 15 THEN 100.0 * (14 - (list_position(list_reverse(ls), list_min(ls)) - 1)) / 14 END AS down, (m10 / nullif({lag('m10', 5)}, 0) - 1) * 10000 AS bps FROM a)
SELECT symbol, ts, {r('tr', 'true_range')}, {r('up', 'aroon_up')}, {r('down', 'aroon_down')}, {r('up - down', 'aroon_osc')},
  {r('CASE WHEN l90 > 0 THEN 100 * (h90 - l90) / l90 END', 'range_gain')}, CASE WHEN m10 IS NULL THEN NULL WHEN abs(bps) <= 5 THEN 'flat' WHEN bps > 0 THEN 'up' ELSE 'down' END AS slope,
  CASE WHEN m5 > m10 AND m10 > m20 THEN 'bullish' WHEN m5 < m10 AND m10 < m20 THEN 'bearish' ELSE 'mixed' END AS stack,
  {r('0.6 * ' + g('avg(green)', 'green', 10) + ' + 0.4 * least(' + g('avg(body)', 'body', 10) + ' / 80, 1.0)', 'strength')},
  {r(f'close / nullif({lag("close", 3)}, 0) - 1', 'change_3')} FROM b""")
def ind_trend(spark, sf_dir):
    df = I.aroon(hourly(spark, sf_dir)).withColumns({"true_range": I.true_range(), "range_gain": I.range_gain(90), **{f"m{n}": I.sma("close", n) for n in (5, 10, 20)}})
    df = df.withColumns({"slope": I.slope_label(df, "m10"), "stack": I.stack_label("m5", "m10", "m20"), "strength": I.trend_strength(), "change_3": W.change("close", 3)})
    return result(df, "true_range", "aroon_up", "aroon_down", "aroon_osc", "range_gain", "slope", "stack", "strength", "change_3")


@query("ind_levels", f"""WITH {BARS_SQL},
a AS (SELECT *, ({g('max(high)', 'high', 9)} + {g('min(low)', 'low', 9)}) / 2 AS te, ({g('max(high)', 'high', 26)} + {g('min(low)', 'low', 26)}) / 2 AS ki,
  ({g('max(high)', 'high', 52)} + {g('min(low)', 'low', 52)}) / 2 AS b, {lag('high')} AS h, {lag('low')} AS l, {lag('close')} AS c FROM bars),
p AS (SELECT *, (h + l + c) / 3 AS pp FROM a)
SELECT symbol, ts, {r('te', 'tenkan')}, {r('ki', 'kijun')}, {r(lag('(te + ki) / 2', 26), 'senkou_a')}, {r(lag('b', 26), 'senkou_b')},
  {r(f'lead(close, 26) OVER ({S})', 'chikou')}, {r('pp', 'pp')}, {r('2 * pp - l', 'r1')}, {r('2 * pp - h', 's1')}, {r('pp + (h - l)', 'r2')}, {r('pp - (h - l)', 's2')},
  {r('h + 2 * (pp - l)', 'r3')}, {r('l - 2 * (h - pp)', 's3')} FROM p""")
def ind_levels(spark, sf_dir):
    df = I.pivot_points(I.ichimoku(hourly(spark, sf_dir)))
    return result(df, "tenkan", "kijun", "senkou_a", "senkou_b", "chikou", "pp", "r1", "s1", "r2", "s2", "r3", "s3")


def _flags(names: dict[str, str]) -> str:
    return ", ".join(f"coalesce({sql}, false) AS {name}" for name, sql in names.items())


_BODY, _SPAN = "abs(close - open)", "nullif(high - low, 0)"
_CANDLES = {
    "doji": "bs <= 0.1", "marubozu": "bs >= 0.95", "spinning_top": "bs <= 0.3 AND us >= 0.2 AND ls >= 0.2",
    "hammer": "lower >= 2 * body AND upper <= 0.3 * body AND body > 1e-12", "inverted_hammer": "upper >= 2 * body AND lower <= 0.3 * body AND body > 1e-12",
    "shooting_star": "upper >= 2 * body AND lower <= 0.3 * body AND body > 1e-12 AND close < open", "hanging_man": "lower >= 2 * body AND upper <= 0.3 * body AND body > 1e-12 AND close < open",
    "bullish_engulfing": "c1 < o1 AND close > open AND open <= c1 AND close >= o1", "bearish_engulfing": "c1 > o1 AND close < open AND open >= c1 AND close <= o1",
    "bullish_harami": "c1 < o1 AND close > open AND open >= c1 AND close <= o1", "bearish_harami": "c1 > o1 AND close < open AND open <= c1 AND close >= o1",
    "piercing_line": "c1 < o1 AND close > open AND open < c1 AND close > (o1 + c1) / 2 AND close < o1", "dark_cloud": "c1 > o1 AND close < open AND open > c1 AND close < (o1 + c1) / 2 AND close > o1",
    "tweezer_top": "abs(high - h1) <= 0.001 * (high + h1) / 2", "tweezer_bottom": "abs(low - l1) <= 0.001 * (low + l1) / 2",
    "morning_star": "c2 < o2 AND bs2 >= 0.6 AND bs1 <= 0.3 AND close > open AND bs >= 0.6 AND close > (o2 + c2) / 2", "evening_star": "c2 > o2 AND bs2 >= 0.6 AND bs1 <= 0.3 AND close < open AND bs >= 0.6 AND close < (o2 + c2) / 2",
    "three_soldiers": "close > open AND c1 > o1 AND c2 > o2 AND bs >= 0.6 AND bs1 >= 0.6 AND bs2 >= 0.6 AND close > c1 AND c1 > c2", "three_crows": "close < open AND c1 < o1 AND c2 < o2 AND bs >= 0.6 AND bs1 >= 0.6 AND bs2 >= 0.6 AND close < c1 AND c1 < c2",
    "gap_up": "100 * (open - c1) / nullif(c1, 0) >= 0.5", "gap_down": "-(100 * (open - c1) / nullif(c1, 0)) >= 0.5",
}


@query("candle_patterns", f"""WITH {BARS_SQL},
a AS (SELECT *, {_BODY} AS body, high - greatest(open, close) AS upper, least(open, close) - low AS lower, coalesce({_BODY} / {_SPAN}, 0) AS bs,
  coalesce((high - greatest(open, close)) / {_SPAN}, 0) AS us, coalesce((least(open, close) - low) / {_SPAN}, 0) AS ls FROM bars),
b AS (SELECT *, lag(open) OVER w AS o1, lag(close) OVER w AS c1, lag(high) OVER w AS h1, lag(low) OVER w AS l1, lag(open, 2) OVER w AS o2, lag(close, 2) OVER w AS c2, lag(bs) OVER w AS bs1, lag(bs, 2) OVER w AS bs2 FROM a WINDOW w AS ({S}))
SELECT symbol, ts, {_flags(_CANDLES)} FROM b""")
def candle_patterns(spark, sf_dir):
    df = hourly(spark, sf_dir).withColumn("_body_share", P.share(P.body()))
    found = {
        "doji": P.doji(), "marubozu": P.marubozu(), "spinning_top": P.spinning_top(), "hammer": P.hammer(), "inverted_hammer": P.inverted_hammer(), "shooting_star": P.shooting_star(), "hanging_man": P.hanging_man(),
        "bullish_engulfing": P.engulfing(True), "bearish_engulfing": P.engulfing(False), "bullish_harami": P.harami(True), "bearish_harami": P.harami(False), "piercing_line": P.piercing_line(), "dark_cloud": P.dark_cloud_cover(),
        "tweezer_top": P.tweezer("high"), "tweezer_bottom": P.tweezer("low"), "morning_star": P.star(True), "evening_star": P.star(False), "three_soldiers": P.three_in_a_row(True), "three_crows": P.three_in_a_row(False),
        "gap_up": P.gap(True), "gap_down": P.gap(False),
    }
    return result(df.withColumns(found), *found)


_CONDITIONS = {
    "cross_up": "lag(m5) OVER w <= lag(m20) OVER w AND m5 > m20", "cross_down": "lag(m5) OVER w >= lag(m20) OVER w AND m5 < m20", "bounce_long": "low <= m20 AND close > m20", "bounce_short": "high >= m20 AND close < m20",
    "break_up": "close > ph", "break_down": "close < pl", "flat": "(xh - xl) / nullif((xh + xl) / 2, 0) <= 0.5", "volume_high": "volume >= 1.5 * v20", "volume_low": f"sum(CAST(coalesce(volume < v20, false) AS INTEGER)) {over(3)} = 3",
    "above_3": f"sum(CAST(coalesce(close > m20, false) AS INTEGER)) {over(3)} = 3", "higher_high": f"high = {g('max(high)', 'high', 10)} AND high > {lag('high', 10)}", "lower_low": f"low = {g('min(low)', 'low', 10)} AND low < {lag('low', 10)}",
    "higher_low": f"low = {g('min(low)', 'low', 10)} AND low > {lag('low', 10)}", "lower_high": f"high = {g('max(high)', 'high', 10)} AND high < {lag('high', 10)}", "sweep_high": "high > ph AND close <= ph", "sweep_low": "low < pl AND close >= pl",
    "diverge_up": f"close = {g('min(close)', 'close', 20)} AND m5 > {g('min(m5)', 'm5', 20)}", "diverge_down": f"close = {g('max(close)', 'close', 20)} AND m5 < {g('max(m5)', 'm5', 20)}",
    "in_hours": "((CAST(floor(epoch(ts) / 3600) AS BIGINT) + 8) % 24 >= 22 OR (CAST(floor(epoch(ts) / 3600) AS BIGINT) + 8) % 24 < 4)",
    "away": "least(abs(mi - 0), 1440 - abs(mi - 0), abs(mi - 480), 1440 - abs(mi - 480), abs(mi - 960), 1440 - abs(mi - 960)) > 15", "retested": "low <= lvl * 1.005 AND close >= lvl",
}


@query("conditions", f"""WITH {BARS_SQL},
a AS (SELECT *, {g('avg(close)', 'close', 5)} AS m5, {g('avg(close)', 'close', 20)} AS m20, {g('avg(volume)', 'volume', 20)} AS v20, {g('max(high)', 'high', 20, 1)} AS ph, {g('min(low)', 'low', 20, 1)} AS pl,
  {g('max(high)', 'high', 20)} AS xh, {g('min(low)', 'low', 20)} AS xl, CAST(floor(epoch(ts) / 60) AS BIGINT) % 1440 AS mi FROM bars),
b AS (SELECT *, last_value(CASE WHEN close > ph THEN ph END IGNORE NULLS) {over(6)} AS lvl FROM a)
SELECT symbol, ts, {_flags(_CONDITIONS)} FROM b WINDOW w AS ({S})""")
def conditions(spark, sf_dir):
    df = hourly(spark, sf_dir).withColumns({"m5": I.sma("close", 5), "m20": I.sma("close", 20), "v20": I.sma("volume", 20), "_ph": W.highest("high", 20, 1)})
    df = df.withColumn("_level", F.when(F.col("close") > F.col("_ph"), F.col("_ph")))
    found = {
        "cross_up": W.cross_above("m5", "m20"), "cross_down": W.cross_below("m5", "m20"), "bounce_long": P.bounce("m20"), "bounce_short": P.bounce("m20", False), "break_up": P.breakout(True), "break_down": P.breakout(False),
        "flat": P.consolidation(20, 0.5), "volume_high": P.volume_at_least("v20"), "volume_low": P.volume_below("v20"), "above_3": W.in_a_row(F.col("close") > F.col("m20"), 3),
        "higher_high": P.new_extreme("high", 10, True, True), "lower_low": P.new_extreme("low", 10, False, False), "higher_low": P.new_extreme("low", 10, False, True), "lower_high": P.new_extreme("high", 10, True, False),
        "sweep_high": P.sweep(True), "sweep_low": P.sweep(False), "diverge_up": P.divergence("close", "m5", 20, True), "diverge_down": P.divergence("close", "m5", 20, False),
        "in_hours": P.hour_between(22, 4), "away": P.away_from_hours(), "retested": P.retest(),
    }
    return result(df.withColumns(found), *found)
