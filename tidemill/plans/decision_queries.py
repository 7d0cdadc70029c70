"""Queries of conditions, verdicts, limits and evaluation, with SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemill.functions import indicators as I
from tidemill.functions import states as T
from tidemill.functions import windows as W
from tidemill.operators import asof, combine, evaluation, risk
from tidemill.operators import selection as S
from tidemill.plans.bar_queries import g, hourly, lag, over, r
from tidemill.plans.bar_queries import S as SERIES
from tidemill.plans.panel_queries import PANEL
from tidemill.sources.bars import BARS_SQL, panel, resample_bars

QUERIES: dict = {}
SQL: dict = {}


def query(name: str, sql: str):
    def keep(f):
        QUERIES[name] = f
        SQL[name] = sql
        return f

    return keep


def flags(names: dict[str, str]) -> str:
    return ", ".join(f"coalesce({sql}, false) AS {name}" for name, sql in names.items())


def case(default: str, **cases: str) -> str:
    return "CASE " + " ".join(f"WHEN {condition} THEN '{name}'" for name, condition in cases.items()) + f" ELSE '{default}' END"


_OSCILLATORS = {
    **{name: f"x {sign} {level}" for name, (sign, level) in T.LEVELS.items() if not name.startswith(("aroon", "macd"))},
    "aroon_up_strong": "up >= 70", "aroon_down_strong": "down >= 70", "macd_above_zero": "m > 0", "macd_below_zero": "m < 0",
    "rsi_in_range": "x BETWEEN 40 AND 60", "stochrsi_cross_above": f"{lag('x')} <= 20 AND x > 20 AND {lag('1')} = 1", "direction_long": "up > down", "aroon_ahead": "up - down >= 20",
    "line_flip_up": f"{lag('s20')} > {lag('close')} AND s20 < close", "line_flip_down": f"{lag('s20')} < {lag('close')} AND s20 > close", "deviation_within": "abs(close - s20) / nullif(s20, 0) <= 0.05",
    "bullish_bar": "close > open AND (close - open) / nullif(open, 0) * 100 >= 1", "bearish_bar": "close < open AND (open - close) / nullif(open, 0) * 100 >= 1",
    "above_for_2": f"sum(CAST(coalesce(close > 50, false) AS INTEGER)) {over(2)} = 2", "aligned": "coalesce(close > s20, false) AND coalesce(m > 0, false) AND coalesce(close > open, false)",
}


@query("oscillator_conditions", f"""WITH {BARS_SQL},
a AS (SELECT *, {g('avg(close)', 'close', 5)} - {g('avg(close)', 'close', 20)} AS m, {g('avg(close)', 'close', 20)} AS s20, {g('min(low)', 'low', 14)} AS lo, {g('max(high)', 'high', 14)} AS hi,
  list(high) {over(15)} AS hs, list(low) {over(15)} AS ls FROM bars),
b AS (SELECT *, -100 * (hi - close) / nullif(hi - lo, 0) + 100 AS x, CASE WHEN len(hs) = 15 THEN 100.0 * (14 - (list_position(list_reverse(hs), list_max(hs)) - 1)) / 14 END AS up,
  CASE WHEN len(ls) = 15 THEN 100.0 * (14 - (list_position(list_reverse(ls), list_min(ls)) - 1)) / 14 END AS down FROM a)
SELECT symbol, ts, {flags(_OSCILLATORS)} FROM b""")
def oscillator_conditions(spark, sf_dir):
    df = I.aroon(hourly(spark, sf_dir)).withColumns({"m": I.sma("close", 5) - I.sma("close", 20), "s20": I.sma("close", 20), "x": I.williams() + 100})
    of = lambda name: "aroon_up" if "_up" in name else "aroon_down" if "_down" in name else "m" if name.startswith("macd") else "x"
    found = {name: T.reaches(name, of(name)) for name in T.LEVELS} | {
        "rsi_in_range": T.between("x", 40, 60), "stochrsi_cross_above": T.rises_through("x", 20.0), "direction_long": T.leads("aroon_up", "aroon_down"), "aroon_ahead": T.leads("aroon_up", "aroon_down", 20.0),
        "line_flip_up": T.flips("s20", "close", True), "line_flip_down": T.flips("s20", "close", False), "deviation_within": T.near("close", "s20", 0.05),
        "bullish_bar": T.strong_bar(True, 1.0), "bearish_bar": T.strong_bar(False, 1.0), "above_for_2": T.above_for("close", 50.0, 2),
        "aligned": T.aligned(F.col("close") > F.col("s20"), (F.col("m") > 0).cast("int"), F.col("close") > F.col("open")),
    }
    return df.withColumns(found).select("symbol", "ts", *found)


_REGIMES = {
    "strength": case("transition", range="x < 20", trend="x >= 25"), "calm": f"coalesce(w < CASE WHEN count(w) {over(60)} >= 30 THEN quantile_cont(w, 0.8) {over(60)} END, false)",
    "lively": f"coalesce(w > CASE WHEN count(w) {over(60)} >= 30 THEN quantile_cont(w, 0.4) {over(60)} END, false)", "narrow": "coalesce(w / nullif(close, 0) < 0.5, false)", "wide": "coalesce(w / nullif(close, 0) > 0.5, false)",
    "rising": f"coalesce(s20 > {lag('s20', 5)}, false)", "falling": f"coalesce(s20 < {lag('s20', 5)}, false)", "crowd": case("neutral", crowded_short="ratio <= 0.5", crowded_long="ratio >= 2.5"),
    "takers": case("balanced", aggressive_sell="coalesce(buy / nullif(sell, 0), 1.0) <= 1 / 1.5", aggressive_buy="coalesce(buy / nullif(sell, 0), 1.0) >= 1.5"),
    "flow": case("none", bearish=f"close = {g('max(close)', 'close', 20)} AND cvd < {g('max(cvd)', 'cvd', 20)}", bullish=f"close = {g('min(close)', 'close', 20)} AND cvd > {g('min(cvd)', 'cvd', 20)}"),
    "basis": "round(1e4 * coalesce((close - open) / nullif(open, 0), 0), 6) + 0.0", "funding": case("neutral", bearish_squeeze="w / 1e5 * 1e4 <= 2", bullish_squeeze="w / 1e5 * 1e4 >= 5"),
    "imbalance": f"round(coalesce((sum(buy) {over(12)} - sum(sell) {over(12)}) / nullif(sum(buy) {over(12)} + sum(sell) {over(12)}, 0), 0), 6) + 0.0", "pile": f"coalesce(sum(buy) {over(12)} >= 20, false)",
    "large": f"coalesce(volume >= {g('quantile_cont(volume, 0.95)', 'volume', 48)}, false)",
}


@query("market_states", f"""WITH {BARS_SQL},
a AS (SELECT *, high - low AS w, {g('avg(close)', 'close', 20)} AS s20, -100 * ({g('max(high)', 'high', 14)} - close) / nullif({g('max(high)', 'high', 14)} - {g('min(low)', 'low', 14)}, 0) + 100 AS x,
  CASE WHEN close > open THEN volume ELSE 0 END AS buy, CASE WHEN close < open THEN volume ELSE 0 END AS sell, high / nullif(low, 0) AS ratio FROM bars),
b AS (SELECT *, sum(buy - sell) OVER ({SERIES}) AS cvd FROM a)
SELECT symbol, ts, {', '.join(f'{sql} AS {name}' for name, sql in _REGIMES.items())} FROM b""")
def market_states(spark, sf_dir):
    o, c, v = F.col("open"), F.col("close"), F.col("volume")
    df = hourly(spark, sf_dir).withColumns({
        "w": F.col("high") - F.col("low"), "s20": I.sma("close", 20), "x": I.williams() + 100, "buy": F.when(c > o, v).otherwise(0.0), "sell": F.when(c < o, v).otherwise(0.0), "ratio": W.div("high", "low"),
    })
    df = df.withColumn("cvd", F.sum(F.col("buy") - F.col("sell")).over(W.so_far())).withColumn("rate", F.col("w") / 1e5)
    found = {
        "strength": T.strength_regime("x"), "calm": T.below_own_level("w", 60), "lively": T.above_own_level("w", 60), "narrow": T.share_below("w", "close", 0.5), "wide": T.share_above("w", "close", 0.5),
        "rising": T.slopes("s20", True), "falling": T.slopes("s20", False), "crowd": T.crowding("ratio"), "takers": T.taker_state("buy", "sell"), "flow": T.flow_divergence("close", "cvd"),
        "basis": T.basis_bps("open", "close"), "funding": T.funding_state("rate", 5.0, 2.0), "imbalance": T.lopsided("buy", "sell"), "pile": T.piles_up("buy", 20.0), "large": T.large_print("volume", 48),
    }
    return W.rounded(df.withColumns(found).select("symbol", "ts", *found), 6)


@query("run_lengths", f"""WITH {BARS_SQL}, a AS (SELECT *, close > open AS up, sum(CASE WHEN close > open THEN 0 ELSE 1 END) OVER ({SERIES}) AS b FROM bars)
SELECT symbol, ts, CASE WHEN up THEN CAST(sum(CAST(up AS INTEGER)) OVER (PARTITION BY symbol, b ORDER BY ts) AS BIGINT) ELSE 0 END AS run FROM a""")
def run_lengths(spark, sf_dir):
    return T.run_length(hourly(spark, sf_dir), F.col("close") > F.col("open")).select("symbol", "ts", "run")


@query("multi_timeframe", f"""WITH {BARS_SQL},
d AS (SELECT symbol, to_timestamp(floor(epoch(ts) / 14400) * 14400)::TIMESTAMP AS ts, arg_max(close, ts) AS close FROM bars GROUP BY 1, 2),
h AS (SELECT symbol, ts + INTERVAL 4 HOUR AS ts, {g('avg(close)', 'close', 5)} AS slow FROM d)
SELECT bars.symbol, bars.ts, {r('bars.close', 'close')}, {r('h.slow', 'slow')}, coalesce(bars.close > h.slow, false) AS above FROM bars ASOF LEFT JOIN h ON bars.symbol = h.symbol AND bars.ts >= h.ts""")
def multi_timeframe(spark, sf_dir):
    """Hourly bars beside the mean of four-hour bars that were complete by then."""
    df = hourly(spark, sf_dir)
    slow = resample_bars(df, "4h").withColumn("slow", I.sma("close", 5)).select("symbol", (F.col("ts") + F.expr("INTERVAL 4 HOURS")).alias("ts"), "slow")
    got = asof.asof_left(df.select("symbol", "ts", "close"), slow, ["slow"])
    return W.rounded(got.select("symbol", "ts", "close", "slow", W.yes(F.col("close") > F.col("slow")).alias("above")), 6)


@query("aligned_bars", f"""WITH {BARS_SQL}, a AS (SELECT * FROM bars WHERE CAST(epoch(ts) / 3600 AS BIGINT) % 3 <> 0), b AS (SELECT * FROM bars WHERE CAST(epoch(ts) / 3600 AS BIGINT) % 3 <> 1)
SELECT symbol, ts, field, {r('value', 'value')} FROM (SELECT coalesce(a.symbol, b.symbol) AS symbol, coalesce(a.ts, b.ts) AS ts, a.close AS first, b.high AS second FROM a FULL JOIN b ON a.symbol = b.symbol AND a.ts = b.ts)
UNPIVOT INCLUDE NULLS (value FOR field IN (first, second))""")
def aligned_bars(spark, sf_dir):
    """Two series on the union of their instants, then one row per value."""
    df = hourly(spark, sf_dir).withColumn("_h", F.floor(F.unix_timestamp("ts") / 3600) % 3)
    a, b = df.filter("_h <> 0").select("symbol", "ts", F.col("close").alias("first")), df.filter("_h <> 1").select("symbol", "ts", F.col("high").alias("second"))
    return W.rounded(a.join(b, ["symbol", "ts"], "full").unpivot(["symbol", "ts"], ["first", "second"], "field", "value"), 6)


PARTS = """u AS (SELECT p_partkey AS id, p_retailprice AS price, p_size AS size, p_partkey % 7 AS k, p_partkey % 3 = 0 AS long FROM part)"""
_SIGNED = {"a": ("size - 25", "size / 50.0", "size / 10.0"), "b": ("price - 1200", "price / 2000.0", "price / 333.0"), "c": ("k - 3", "k / 6.0", "k * 1.5")}


def _contribution(name: str, weight: str) -> str:
    d, _, v = _SIGNED[name]
    return f"(CASE WHEN {d} > 0 THEN {v} WHEN {d} < 0 THEN -abs({v}) ELSE 0 END) * {weight}"


def _votes(test: str) -> str:
    return " + ".join(f"CAST(({d}) {test} AND {s} >= 0.3 AS INTEGER)" for d, s, _ in _SIGNED.values())


_STRONG = " + ".join(f"CAST({s} >= 0.3 AS INTEGER)" for _, s, _ in _SIGNED.values())
_DIRECTION = "CASE WHEN up >= down AND up >= flat THEN 'BULLISH' WHEN down >= flat THEN 'BEARISH' ELSE 'NEUTRAL' END"


@query("signal_verdicts", f"""WITH {PARTS},
s AS (SELECT *, round({' + '.join(_contribution(n, v[1]) for n, v in _SIGNED.items())}, 2) AS added, round({_contribution('a', '2.0')} + {_contribution('b', '1.0')} + {_contribution('c', '0.5')}, 2) AS weighted,
  round(({_contribution('a', '1.0')} + {_contribution('b', '1.0')}) * 0.7 + {_contribution('c', '1.0')} * 0.3, 2) AS tiered, {_votes('> 0')} AS up, {_votes('< 0')} AS down, {_STRONG} AS strong FROM u)
SELECT id, {r('added', 'added', 2)}, {r('weighted', 'weighted', 2)}, {r('tiered', 'tiered', 2)}, {r('coalesce(round((up - down) / nullif(strong, 0), 2), 0)', 'majority', 2)},
  CASE WHEN up >= 2 THEN CAST(up AS DOUBLE) WHEN down >= 1 THEN -CAST(down AS DOUBLE) ELSE 0.0 END AS sequence, CASE WHEN added >= 6 THEN 3.0 WHEN added >= 3 THEN 1.5 ELSE 0.0 END AS step,
  CASE WHEN added >= 6 THEN 'HIGH' WHEN added >= 3 THEN 'MIDDLE' ELSE 'BELOW_ALL' END AS label,
  CASE WHEN weighted >= 5 AND NOT (price <= 1500 AND k IN (1, 2, 3)) THEN 'WATCHLIST' WHEN weighted >= 8 THEN 'STRONG_CANDIDATE' WHEN weighted >= 5 THEN 'CANDIDATE' WHEN weighted >= 2 THEN 'WATCHLIST' WHEN weighted >= 0 THEN 'SKIP' ELSE 'AVOID' END AS verdict,
  CAST(added > 0 AS INTEGER) + CAST(weighted > 0 AS INTEGER) + CAST(tiered > 0 AS INTEGER) >= 2 OR CAST(added < 0 AS INTEGER) + CAST(weighted < 0 AS INTEGER) + CAST(tiered < 0 AS INTEGER) >= 2 OR
  CAST(added = 0 AS INTEGER) + CAST(weighted = 0 AS INTEGER) + CAST(tiered = 0 AS INTEGER) >= 2 AS agreed,
  CAST(size > 25 AND price < 1200 OR size < 25 AND price > 1200 AS INTEGER) AS conflicts FROM s""")
def signal_verdicts(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("price"), F.col("p_size").alias("size"), (F.col("p_partkey") % 7).alias("k"))
    size, price, k = F.col("size"), F.col("price"), F.col("k")
    a = combine.signal("a", combine.side(size - 25), size / 50.0, size / 10.0)
    b = combine.signal("b", combine.side(price - 1200), price / 2000.0, price / 333.0)
    third = combine.signal("c", combine.side(k - 3), k / 6.0, k * 1.5)
    df = df.withColumns({"all": F.array(a, b, third), "one": F.array(a), "two": F.array(b), "pair": F.array(a, b), "last": F.array(third)})
    df = df.withColumns({"added": combine.added(F.col("all")), "weighted": combine.weighted(F.col("all"), {"a": 2.0, "c": 0.5}), "tiered": combine.tiered([(F.col("pair"), 0.7), (F.col("last"), 0.3)])})
    steps = combine.stepped(F.col("added"), [(6.0, 3.0, "HIGH"), (3.0, 1.5, "MIDDLE")])
    return W.rounded(df.select(
        "id", "added", "weighted", "tiered", combine.majority(F.col("all"), 0.3).alias("majority"), combine.in_sequence(F.col("all"), 2, 1).alias("sequence"), steps["score"].alias("step"), steps["label"].alias("label"),
        combine.capped(F.col("weighted"), [price <= 1500, k.isin(1, 2, 3)]).alias("verdict"), combine.agreement([F.col("added"), F.col("weighted"), F.col("tiered")])["agreed"].alias("agreed"),
        combine.conflicts(F.col("one"), F.col("two")).alias("conflicts")), 2)


_LIQUIDATION = "(CASE WHEN long THEN price * (1 - 1.0 / lev) / (1 - 0.005) ELSE price * (1 + 1.0 / lev) / (1 + 0.005) END)"
_REACH, _LEFT = f"((CASE WHEN long THEN 1 ELSE -1 END) * (price - {_LIQUIDATION}) / price * 100)", f"((CASE WHEN long THEN 1 ELSE -1 END) * (mark - {_LIQUIDATION}) / price * 100)"


@query("risk_limits", f"""WITH {PARTS}, p AS (SELECT *, 1 + k AS lev, price * (1 + (size - 25) / 500.0) AS mark, size / 2.0 AS atr, CAST(size AS DOUBLE) / 4 AS vol FROM u),
q AS (SELECT *, CASE WHEN vol > 0 THEN greatest(1.0, least(round(1000 * 2.0 / vol / 1000, 1), 5.0)) ELSE 1.0 END AS inv, {_REACH} AS reach, {_LEFT} AS rest, greatest(-(mark - price), 0) AS loss FROM p)
SELECT id, {r('CASE WHEN atr > 0 THEN 10000 * 0.01 / (atr * 2) * price ELSE 0 END', 'sized', 8)}, {r('CASE WHEN k BETWEEN 1 AND 2 THEN price * 0.5 ELSE 0 END', 'added', 8)}, {r('inv', 'leverage', 8)}, {r('round(1000 * inv, 2)', 'notional', 2)},
  CASE WHEN size < 10 THEN 8.0 WHEN abs(price - 1400) > 300 THEN 12.0 ELSE 5.0 END AS stop_percent, greatest(1.0, least(CAST(lev AS DOUBLE), CASE WHEN size < 10 THEN 2.0 WHEN vol > 8 THEN 3.0 ELSE 5.0 END)) AS cap,
  {r('CASE WHEN long THEN price - atr * 2 ELSE price + atr * 2 END', 'stop', 8)}, {r('CASE WHEN long THEN greatest(mark * 0.95, price * 0.9) ELSE least(mark * 1.05, price * 1.1) END', 'trailed', 8)},
  {r(_LIQUIDATION, 'liquidated', 8)}, CASE WHEN reach > 0 THEN (reach - rest) / reach * 100 ELSE 100.0 END >= 20 AS danger, (price + 100 * size) / 1000 * 100 <= 300 AS exposed_ok,
  loss / 1000 * 100 >= 2 AND mark < price AS lost, abs(mark - price) / price * 100 <= 2 AS near_price,
  NOT ((price + 100 * size) / 1000 * 100 <= 300) OR (loss / 1000 * 100 >= 2 AND mark < price) AS halted, {r('CASE WHEN long THEN price * 1.04 ELSE price * 0.96 END', 'second_target', 8)} FROM q""")
def risk_limits(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("price"), F.col("p_size").alias("size"), (F.col("p_partkey") % 7).alias("k"), (F.col("p_partkey") % 3 == 0).alias("long"))
    price, size = F.col("price"), F.col("size")
    df = df.withColumns({"lev": 1 + F.col("k"), "mark": price * (1 + (size - 25) / 500.0), "atr": size / 2.0, "vol": size.cast("double") / 4, "balance": F.lit(1000.0)})
    inverse, used = risk.inverse_size("balance", "vol"), risk.liquidation("price", "mark", "long", "lev", 20.0, 0.005)
    allowed, lost = risk.exposure("price", 100 * size, "balance")["allowed"], risk.daily_loss(F.col("mark") - price, "balance", 2.0)["breached"]
    return W.rounded(df.select(
        "id", risk.volatility_size(F.lit(10000.0), "atr", "price").alias("sized"), risk.added_size("price", "k").alias("added"), inverse["leverage"].alias("leverage"), inverse["notional"].alias("notional"),
        risk.adaptive_stop(price - 1400, size, wild_over=300.0, new_days=10).alias("stop_percent"), risk.capped_leverage(F.col("lev").cast("double"), size, "vol", new_days=10).alias("cap"),
        risk.stop_at("price", "long", F.col("atr") * 2).alias("stop"), risk.trailing_stop("mark", "long", 5.0, price * F.when(F.col("long"), 0.9).otherwise(1.1)).alias("trailed"),
        used["price"].alias("liquidated"), used["danger"].alias("danger"), allowed.alias("exposed_ok"), lost.alias("lost"), risk.off_price("price", "mark")["allowed"].alias("near_price"),
        risk.halted({"exposure": ~allowed, "loss": lost})["halt"].alias("halted"), F.get(risk.take_profits("price", "long", [2.0, 4.0]), 1).alias("second_target")), 8)


@query("robust_panel", f"""WITH {PANEL}, a AS (SELECT *, median(ret) OVER (PARTITION BY ts) AS m FROM panel), b AS (SELECT *, median(abs(ret - m)) OVER (PARTITION BY ts) AS d FROM a)
SELECT symbol, ts, {r('CASE WHEN ret IS NOT NULL THEN greatest(m - 3 * d, least(ret, m + 3 * d)) END', 'ret', 8)} FROM b""")
def robust_panel(spark, sf_dir):
    df = panel(spark, sf_dir).withColumn("ret", W.change("close"))
    return W.rounded(evaluation.clipped_by_deviation(df, "ret").select("symbol", "ts", "ret"), 8)


@query("pooled_relation", f"""WITH {PANEL}, f AS (SELECT ret AS x, lead(ret) OVER ({SERIES}) AS y, ts FROM panel),
m AS (SELECT ts, avg(x) AS x, avg(y) AS y, avg(x * x) AS xx, avg(y * y) AS yy, avg(x * y) AS xy, count(*) AS n FROM f WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY ts),
t AS (SELECT avg(x) AS x, avg(y) AS y, avg(xx) AS xx, avg(yy) AS yy, avg(xy) AS xy, count(*) AS n_instants, CAST(sum(n) AS BIGINT) AS n_pairs FROM m)
SELECT {r('(xy - x * y) / sqrt((xx - x * x) * (yy - y * y))', 'corr')}, {r('(xy - x * y) / (xx - x * x)', 'slope')}, n_instants, n_pairs FROM t""")
def pooled_relation(spark, sf_dir):
    df = panel(spark, sf_dir).withColumn("x", W.change("close"))
    return W.rounded(evaluation.pooled_relation(df.withColumn("y", F.lead("x").over(W.series())), "x", "y"), 6)


def ledger(spark, sf_dir):
    """Returns of each symbol of the panel as those of a trial."""
    df = panel(spark, sf_dir).withColumn("ret", W.change("close"))
    return df.select(F.col("symbol").alias("trial"), "ts", "ret")


LEDGER = f"{PANEL}, l AS (SELECT symbol AS trial, ts, ret FROM panel)"


def sharpe(n: str, s: str, q: str) -> str:
    return f"(CASE WHEN {n} >= 30 AND ({q}) - ({s}) * ({s}) / {n} > 0 THEN ({s}) / {n} / sqrt((({q}) - ({s}) * ({s}) / {n}) / ({n} - 1)) * sqrt(365) END)"


@query("bootstrap_interval", f"""WITH {LEDGER}, d AS (SELECT ts, avg(ret) AS x FROM l GROUP BY ts), k AS (SELECT row_number() OVER (ORDER BY ts) - 1 AS k, x FROM d), c AS (SELECT count(*) AS n FROM k),
s AS (SELECT d.range AS draw, b.range * 8 + t.range AS place, (d.range * 7919 + b.range * 104729) % (c.n - 8 + 1) + t.range AS k FROM c, range(100) d, range(CAST(ceil(c.n / 8.0) AS BIGINT)) b, range(8) t WHERE b.range * 8 + t.range < c.n),
m AS (SELECT draw, avg(x) AS m FROM s JOIN k USING (k) GROUP BY draw)
SELECT {r('(SELECT avg(x) FROM k)', 'mean')}, (SELECT count(x) FROM k) AS n, {r('quantile_cont(m, 0.025)', 'low')}, {r('quantile_cont(m, 0.975)', 'high')}, count(m) AS draws FROM m""")
def bootstrap_interval(spark, sf_dir):
    days = ledger(spark, sf_dir).groupBy("ts").agg(F.avg("ret").alias("x"))
    return W.rounded(evaluation.bootstrap_mean(days, "x", 100, 8, lambda d, b, m: (d * 7919 + b * 104729) % m), 6)


@query("trial_scores", f"""WITH {LEDGER}, e AS (SELECT *, exp(sum(ln(1 + ret)) OVER (PARTITION BY trial ORDER BY ts)) AS e FROM l WHERE ret IS NOT NULL),
f AS (SELECT *, e / max(e) OVER (PARTITION BY trial ORDER BY ts) - 1 AS fall FROM e),
t AS (SELECT trial, count(*) AS n, sum(ret) AS s, sum(ret * ret) AS q, exp(sum(ln(1 + ret))) AS total, min(fall) AS deepest FROM f GROUP BY trial)
SELECT trial, n, {r(sharpe('n', 's', 'q'), 'sharpe')}, {r('deepest', 'deepest')} FROM t""")
def trial_scores(spark, sf_dir):
    return W.rounded(evaluation.trial_scores(ledger(spark, sf_dir)).select("trial", "n", "sharpe", "deepest"), 6)


_LUCK = evaluation.best_of_luck(20, 0.05)


@query("deflated_scores", f"""WITH {LEDGER}, a AS (SELECT trial, ret, avg(ret) OVER (PARTITION BY trial) AS m FROM l WHERE ret IS NOT NULL),
b AS (SELECT trial, count(*) AS n, any_value(m) AS m, stddev_samp(ret) AS s, avg(power(ret - m, 3)) / power(avg(power(ret - m, 2)), 1.5) AS skew, avg(power(ret - m, 4)) / power(avg(power(ret - m, 2)), 2) AS tails FROM a GROUP BY trial),
c AS (SELECT *, CASE WHEN n >= 30 AND s > 0 THEN m / s END AS x FROM b), d AS (SELECT *, 1 - skew * x + (tails - 1) / 4 * x * x AS base FROM c)
SELECT trial, {r('x * sqrt(365)', 'sharpe')}, {r(f'CASE WHEN base > 0 THEN (x - {_LUCK!r}) * sqrt(n - 1) / sqrt(base) END', 'z')} FROM (SELECT DISTINCT symbol AS trial FROM panel) LEFT JOIN d USING (trial)""")
def deflated_scores(spark, sf_dir):
    return W.rounded(evaluation.deflated(ledger(spark, sf_dir), 20, 0.05).select("trial", "sharpe", "z"), 6)


_IN, _OUT = ("(split >> block) & 1 = 1", "(split >> block) & 1 = 0")
_PART = lambda x, test: f"sum(CASE WHEN {test} THEN {x} END)"


@query("overfitting", f"""WITH {LEDGER}, i AS (SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS k, count(*) OVER () AS n FROM (SELECT DISTINCT ts FROM l)),
d AS (SELECT ts, CASE WHEN k < (n % 8) * (n // 8 + 1) THEN k // (n // 8 + 1) ELSE (k - (n % 8) * (n // 8 + 1)) // (n // 8) + n % 8 END AS block FROM i),
s AS (SELECT trial, block, count(*) AS n, sum(ret) AS s, sum(ret * ret) AS q FROM l JOIN d USING (ts) WHERE ret IS NOT NULL GROUP BY ALL),
m AS (SELECT split, trial, {sharpe(_PART('n', _IN), _PART('s', _IN), _PART('q', _IN))} AS own, {sharpe(_PART('n', _OUT), _PART('s', _OUT), _PART('q', _OUT))} AS other
  FROM s, (SELECT range AS split FROM range(256) WHERE bit_count(range) = 4) GROUP BY ALL),
p AS (SELECT split, arg_max(trial, own) AS trial FROM m WHERE own IS NOT NULL GROUP BY split),
c AS (SELECT split, trial, other AS mine FROM p JOIN m USING (split, trial) WHERE other IS NOT NULL),
k AS (SELECT c.split, count(*) AS n, count(*) FILTER (WHERE other < mine) AS less, count(*) FILTER (WHERE other = mine) AS same FROM c JOIN m ON m.split = c.split AND m.other IS NOT NULL GROUP BY c.split),
w AS (SELECT (less + (same + 1) / 2) / (n + 1) AS share FROM k WHERE n >= 2)
SELECT {r('avg(CAST(share <= 0.5 AS INTEGER))', 'pbo')}, count(*) AS n_splits, {r('median(share)', 'median_share')} FROM w""")
def overfitting(spark, sf_dir):
    return W.rounded(evaluation.overfitting(ledger(spark, sf_dir), 8), 6)


POINTS = "points AS (SELECT symbol AS trial, CAST(substr(symbol, 2) AS BIGINT) // 10 AS a, CAST(substr(symbol, 2) AS BIGINT) % 10 AS b FROM (SELECT DISTINCT symbol FROM panel))"
#: From scores (win, trial, score) to `plateau` (win, trial, score, mean, spread, neighbours).
PLATEAU = """sized AS (SELECT p.trial, p.a, p.b, count(*) AS size FROM points p JOIN points o ON abs(p.a - o.a) + abs(p.b - o.b) <= 1 GROUP BY ALL),
plateau AS (SELECT s.win, p.trial, any_value(o.score) AS score, avg(s.score) AS mean, stddev_pop(s.score) AS spread, count(*) AS neighbours
  FROM scores s JOIN points q USING (trial) JOIN sized p ON abs(p.a - q.a) + abs(p.b - q.b) <= 1 LEFT JOIN scores o ON o.win = s.win AND o.trial = p.trial
  WHERE s.score IS NOT NULL GROUP BY s.win, p.trial, p.size HAVING count(*) >= greatest(1, ceil(0.5 * p.size)))"""


def lattice(df):
    """Trials named S<k> as points (k // 10, k % 10) of a lattice of two parameters."""
    k = F.substring("trial", 2, 20).cast("int")
    return df.select("trial").distinct().select("trial", F.array(F.floor(k / 10).cast("int"), k % 10).alias("place"))


@query("plateau", f"""WITH {LEDGER}, scores AS (SELECT 0 AS win, trial, {sharpe('count(ret)', 'sum(ret)', 'sum(ret * ret)')} AS score FROM l GROUP BY trial), {POINTS}, {PLATEAU}
SELECT trial, {r('score', 'score')}, {r('mean', 'mean')}, {r('spread', 'spread')}, neighbours FROM plateau""")
def plateau(spark, sf_dir):
    rows = ledger(spark, sf_dir)
    scores = evaluation.trial_scores(rows).select("trial", F.col("sharpe").alias("score"))
    return W.rounded(evaluation.smoothed(scores, lattice(rows), 2), 6)


def walk_sql(top: int, scores: str = "scores", by: str = "score") -> str:
    """From scores of windows to the rows of a walk that holds the best `top`."""
    return f"""picks AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY win ORDER BY {by} DESC, trial) AS place FROM {scores} WHERE {by} IS NOT NULL) WHERE place <= {top}),
book AS (SELECT win, ts, avg(ret) AS ret FROM r JOIN picks USING (win, trial) WHERE p >= 114 GROUP BY win, ts),
first AS (SELECT win, arg_min(trial, place) AS trial, count(*) AS n_picked, arg_min(score, place) AS own_score FROM picks GROUP BY win)
SELECT CAST(win AS INTEGER) AS "window", any_value(trial) AS trial, any_value(n_picked) AS n_picked, {r('any_value(own_score)', 'own_score')}, count(*) AS n, {r('avg(ret)', 'mean')},
  {r('sum(ret)', 'total')}, {r(sharpe('count(*)', 'sum(ret)', 'sum(ret * ret)'), 'score')} FROM book JOIN first USING (win) GROUP BY win"""


WALK = f"""{LEDGER}, i AS (SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS k, count(*) OVER () AS n FROM (SELECT DISTINCT ts FROM l)),
w AS (SELECT unnest(range((SELECT any_value(n) - 153 FROM i) // 39 + 1)) AS win),
r AS (SELECT trial, ts, ret, win, k - win * 39 AS p FROM l JOIN i USING (ts) JOIN w ON k - win * 39 BETWEEN 0 AND 152 WHERE ret IS NOT NULL),
scores AS (SELECT win, trial, {sharpe('count(*)', 'sum(ret)', 'sum(ret * ret)')} AS score FROM r WHERE p < 104 GROUP BY ALL)"""


@query("walk_forward", f"WITH {WALK}, {walk_sql(1)}")
def walk_forward(spark, sf_dir):
    return W.rounded(evaluation.walked_forward(ledger(spark, sf_dir), 104, 39), 6)


@query("walk_forward_plateau", f"WITH {WALK}, {POINTS}, {PLATEAU}, {walk_sql(5, 'plateau', 'mean')}")
def walk_forward_plateau(spark, sf_dir):
    rows = ledger(spark, sf_dir)
    return W.rounded(evaluation.walked_forward(rows, 104, 39, top=5, points=lattice(rows), axes=2), 6)


@query("effective_trials", f"""WITH {LEDGER}, n AS (SELECT count(DISTINCT ts) AS n FROM l), k AS (SELECT * FROM l WHERE ret IS NOT NULL),
m AS (SELECT trial, sum(ret) AS s, sqrt(greatest(0, sum(ret * ret) - sum(ret) * sum(ret) / any_value(n))) AS d FROM k, n GROUP BY trial),
g AS (SELECT a.trial AS a, b.trial AS b, sum(a.ret * b.ret) AS dot FROM k a JOIN k b USING (ts) GROUP BY ALL),
c AS (SELECT x.trial AS a, y.trial AS b, CASE WHEN x.d * y.d > 1e-14 THEN (coalesce(dot, 0) - x.s * y.s / n) / (x.d * y.d) ELSE 0 END AS c
  FROM n, m x CROSS JOIN m y LEFT JOIN g ON g.a = x.trial AND g.b = y.trial)
SELECT (SELECT count(*) FROM m) AS n_trials, {r('power((SELECT count(*) FROM m WHERE d > 1e-14), 2) / sum(c * c)', 'effective')} FROM c""")
def effective_trials(spark, sf_dir):
    return W.rounded(evaluation.effective_trials(ledger(spark, sf_dir)), 6)


@query("overfitting_plateau", f"""WITH {LEDGER}, i AS (SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS k, count(*) OVER () AS n FROM (SELECT DISTINCT ts FROM l)),
d AS (SELECT ts, CASE WHEN k < (n % 8) * (n // 8 + 1) THEN k // (n // 8 + 1) ELSE (k - (n % 8) * (n // 8 + 1)) // (n // 8) + n % 8 END AS block FROM i),
s AS (SELECT trial, block, count(*) AS n, sum(ret) AS s, sum(ret * ret) AS q FROM l JOIN d USING (ts) WHERE ret IS NOT NULL GROUP BY ALL),
m AS (SELECT split, trial, {sharpe(_PART('n', _IN), _PART('s', _IN), _PART('q', _IN))} AS own, {sharpe(_PART('n', _OUT), _PART('s', _OUT), _PART('q', _OUT))} AS other
  FROM s, (SELECT range AS split FROM range(256) WHERE bit_count(range) = 4) GROUP BY ALL),
scores AS (SELECT split AS win, trial, own AS score FROM m), {POINTS}, {PLATEAU},
p AS (SELECT win AS split, trial FROM plateau QUALIFY row_number() OVER (PARTITION BY win ORDER BY mean DESC, trial) = 1),
c AS (SELECT split, trial, other AS mine FROM p JOIN m USING (split, trial) WHERE other IS NOT NULL),
k AS (SELECT c.split, count(*) AS n, count(*) FILTER (WHERE other < mine) AS less, count(*) FILTER (WHERE other = mine) AS same FROM c JOIN m ON m.split = c.split AND m.other IS NOT NULL GROUP BY c.split),
w AS (SELECT (less + (same + 1) / 2) / (n + 1) AS share FROM k WHERE n >= 2)
SELECT {r('avg(CAST(share <= 0.5 AS INTEGER))', 'pbo')}, count(*) AS n_splits, {r('median(share)', 'median_share')} FROM w""")
def overfitting_plateau(spark, sf_dir):
    rows = ledger(spark, sf_dir)
    return W.rounded(evaluation.overfitting(rows, 8, lattice(rows), 2), 6)


#: Weeks of which each fifth is left out, and how draws pick the first of the weeks of a block (length 8).
KEPT = "CAST(floor(epoch(ts) / 604800) AS BIGINT) % 5 <> 2"
GRID = f"""g AS (SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS k FROM (SELECT unnest(generate_series((SELECT min(ts) FROM m), (SELECT max(ts) FROM m), INTERVAL 7 DAY)) AS ts)), c AS (SELECT count(*) AS n FROM g),
s AS (SELECT d.range AS draw, (d.range * 7919 + b.range * 104729) % (c.n - 8 + 1) + t.range AS k FROM c, range(100) d, range(CAST(ceil(c.n / 8.0) AS BIGINT)) b, range(8) t WHERE b.range * 8 + t.range < c.n)"""


def kept_weeks(df):
    return df.filter(F.pmod(F.floor(F.unix_micros("ts") / 604_800_000_000), F.lit(5)) != 2)


def first_of_block(d, b, m):
    return (d * 7919 + b * 104729) % m


@query("pooled_interval", f"""WITH {PANEL}, f AS (SELECT ret AS x, lead(ret) OVER ({SERIES}) AS y, ts FROM panel),
m AS (SELECT ts, avg(x) AS x, avg(y) AS y, avg(x * x) AS xx, avg(y * y) AS yy, avg(x * y) AS xy, count(x) AS n FROM
  (SELECT ts, CASE WHEN y IS NOT NULL THEN x END AS x, CASE WHEN x IS NOT NULL THEN y END AS y FROM f WHERE {KEPT}) GROUP BY ts), {GRID},
t AS (SELECT avg(x) AS x, avg(y) AS y, avg(xx) AS xx, avg(yy) AS yy, avg(xy) AS xy, count(*) AS n_instants, CAST(sum(n) AS BIGINT) AS n_pairs FROM m WHERE n > 0),
b AS (SELECT draw, avg(x) AS x, avg(y) AS y, avg(xx) AS xx, avg(yy) AS yy, avg(xy) AS xy FROM s JOIN g USING (k) LEFT JOIN m USING (ts) GROUP BY draw),
e AS (SELECT (xy - x * y) / sqrt((xx - x * x) * (yy - y * y)) AS c, (xy - x * y) / (xx - x * x) AS s FROM b)
SELECT {r('(xy - x * y) / sqrt((xx - x * x) * (yy - y * y))', 'corr')}, {r('(xy - x * y) / (xx - x * x)', 'slope')}, n_instants, n_pairs,
  {r('(SELECT quantile_cont(c, 0.025) FROM e)', 'corr_low')}, {r('(SELECT quantile_cont(c, 0.975) FROM e)', 'corr_high')}, {r('(SELECT quantile_cont(s, 0.025) FROM e)', 'slope_low')}, {r('(SELECT quantile_cont(s, 0.975) FROM e)', 'slope_high')} FROM t""")
def pooled_interval(spark, sf_dir):
    df = panel(spark, sf_dir).withColumn("x", W.change("close"))
    df = kept_weeks(df.withColumn("y", F.lead("x").over(W.series())))
    return W.rounded(evaluation.pooled_interval(df, "x", "y", 100, 8, first_of_block, step=604800), 6)


@query("bootstrap_grid", f"""WITH {LEDGER}, m AS (SELECT ts, avg(ret) AS x FROM l WHERE {KEPT} GROUP BY ts), {GRID},
b AS (SELECT draw, avg(x) AS x FROM s JOIN g USING (k) LEFT JOIN m USING (ts) GROUP BY draw)
SELECT {r('(SELECT avg(x) FROM m)', 'mean')}, (SELECT count(x) FROM m) AS n, {r('quantile_cont(x, 0.025)', 'low')}, {r('quantile_cont(x, 0.975)', 'high')}, count(x) AS draws FROM b""")
def bootstrap_grid(spark, sf_dir):
    weeks = kept_weeks(ledger(spark, sf_dir)).groupBy("ts").agg(F.avg("ret").alias("x"))
    return W.rounded(evaluation.bootstrap_mean(weeks, "x", 100, 8, first_of_block, step=604800), 6)
