"""Queries over a weekly panel of about 100 symbols, with SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemill.functions import windows as W
from tidemill.operators import factors as A
from tidemill.sources.bars import panel

QUERIES: dict = {}
SQL: dict = {}

PANEL = """p0 AS (SELECT 'S' || l_suppkey AS symbol, to_timestamp(floor(epoch(l_shipdate) / 604800) * 604800)::TIMESTAMP AS ts, l_extendedprice / l_quantity AS price, CAST(l_quantity AS DOUBLE) AS q,
  l_shipdate AS t, l_orderkey * 8 + l_linenumber AS seq FROM lineitem),
p1 AS (SELECT symbol, ts, arg_min(price, (t, seq)) AS open, max(price) AS high, min(price) AS low, arg_max(price, (t, seq)) AS close, sum(q) AS volume, sum(price * q) AS quote, count(*) AS trades
  FROM p0 WHERE price IS NOT NULL GROUP BY 1, 2),
panel AS (SELECT *, quote / nullif(volume, 0) AS vwap, close / nullif(lag(close) OVER (PARTITION BY symbol ORDER BY ts), 0) - 1 AS ret FROM p1)"""
S = "PARTITION BY symbol ORDER BY ts"


def over(n: int) -> str:
    return f"OVER ({S} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def g(agg: str, x: str, n: int) -> str:
    return f"(CASE WHEN count({x}) {over(n)} = {n} THEN {agg} {over(n)} END)"


def rank(x: str) -> str:
    return f"(CASE WHEN ({x}) IS NOT NULL THEN (rank() OVER (PARTITION BY ts ORDER BY ({x}) NULLS LAST) + (count({x}) OVER (PARTITION BY ts, ({x})) - 1) / 2) / count({x}) OVER (PARTITION BY ts) END)"


def corr(x: str, y: str, n: int) -> str:
    both = f"({x} IS NOT NULL AND {y} IS NOT NULL)"
    s = f"(stddev_pop({x}) {over(n)} * stddev_pop({y}) {over(n)})"
    return f"(CASE WHEN count(CASE WHEN {both} THEN 1 END) {over(n)} = {n} AND {s} > 1e-14 THEN greatest(-1, least(1, covar_pop({x}, {y}) {over(n)} / {s})) END)"


def r(x: str, name: str, digits: int = 6) -> str:
    return f"round({x}, {digits}) + 0.0 AS {name}"


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


@query("panel_weekly", f"WITH {PANEL} SELECT symbol, ts, {r('open', 'open', 8)}, {r('high', 'high', 8)}, {r('low', 'low', 8)}, {r('close', 'close', 8)}, volume, trades FROM panel")
def panel_weekly(spark, sf_dir):
    return W.rounded(panel(spark, sf_dir).select("symbol", "ts", "open", "high", "low", "close", "volume", "trades"), 8)


def alpha_query(spark, sf_dir, numbers):
    got = A.alphas(panel(spark, sf_dir), numbers)
    return W.rounded(got.select("symbol", "ts", *[f"a{n:03d}" for n in numbers]), 8)


@query("alphas_windows", f"""WITH {PANEL},
a AS (SELECT *, close - lag(close, 1) OVER w AS d1, volume - lag(volume, 1) OVER w AS dv, {g('avg(high)', 'high', 20)} AS mh, high - lag(high, 2) OVER w AS dh,
  (close - low - (high - close)) / nullif(close - low, 0) AS x53 FROM panel WINDOW w AS ({S}))
SELECT symbol, ts, {r('-1 * ' + corr('open', 'volume', 10), 'a006', 8)},
  {r(f"CASE WHEN {g('min(d1)', 'd1', 5)} IS NULL THEN NULL WHEN 0 < {g('min(d1)', 'd1', 5)} THEN d1 WHEN {g('max(d1)', 'd1', 5)} < 0 THEN d1 ELSE -1 * d1 END", 'a009', 8)},
  {r('sign(dv) * (-1 * d1)', 'a012', 8)}, {r('CASE WHEN mh IS NULL THEN NULL WHEN mh < high THEN -1 * dh ELSE 0 END', 'a023', 8)},
  {r('power(high * low, 0.5) - vwap', 'a041', 8)}, {r(f'-1 * (x53 - lag(x53, 9) OVER ({S}))', 'a053', 8)}, {r('(close - open) / (high - low + 0.001)', 'a101', 8)} FROM a""")
def alphas_windows(spark, sf_dir):
    return W.rounded(alpha_query(spark, sf_dir, [6, 9, 12, 23, 41, 53, 101]), 8)


@query("alphas_ranked", f"""WITH {PANEL},
a AS (SELECT *, {rank('open')} AS ro, {rank('volume')} AS rv, {rank('low')} AS rl, {rank('close')} AS rc, {rank('high')} AS rh, close - lag(close, 3) OVER w AS d3, open - lag(high, 1) OVER w AS oh, open - lag(close, 1) OVER w AS oc, open - lag(low, 1) OVER w AS ol,
  {g('stddev_samp(high)', 'high', 10)} AS sh, list(close) {over(10)} AS cl FROM panel WINDOW w AS ({S})),
b AS (SELECT *, CASE WHEN count(rc) {over(5)} = 5 AND count(rv) {over(5)} = 5 THEN covar_samp(rc, rv) {over(5)} END AS cv, list(rl) {over(9)} AS ll,
  CASE WHEN len(cl) = 10 THEN (len(list_filter(cl, lambda z: z < close)) + (len(list_filter(cl, lambda z: z = close)) + 1) / 2) / 10 END AS tr FROM a)
SELECT symbol, ts, {r('-1 * ' + corr('ro', 'rv', 10), 'a003', 8)},
  {r("-1 * CASE WHEN len(ll) = 9 THEN (len(list_filter(ll, lambda z: z < rl)) + (len(list_filter(ll, lambda z: z = rl)) + 1) / 2) / 9 END", 'a004', 8)},
  {r('-1 * ' + rank('cv'), 'a013', 8)}, {r('-1 * ' + rank('oh') + ' * ' + rank('oc') + ' * ' + rank('ol'), 'a020', 8)}, {r(rank('-1 * (1 - open / close)'), 'a033', 8)},
  {r('-1 * ' + rank('tr') + ' * ' + rank('close / open'), 'a038', 8)}, {r('-1 * ' + rank('sh') + ' * ' + corr('high', 'volume', 10), 'a040', 8)}, {r(rank('vwap - close') + ' / ' + rank('vwap + close'), 'a042', 8)} FROM b""")
def alphas_ranked(spark, sf_dir):
    return alpha_query(spark, sf_dir, [3, 4, 13, 20, 33, 38, 40, 42])


@query("alphas_deep")
def alphas_deep(spark, sf_dir):
    """Formulas that go to and fro between symbols and instants; the operators are tested one by one."""
    return alpha_query(spark, sf_dir, [2, 11, 15, 27, 31, 50, 56])


@query("factor_preparation", f"""WITH {PANEL},
q AS (SELECT ts, quantile_cont(close, 0.05) AS lo, quantile_cont(close, 0.95) AS hi, avg(close) AS m, stddev_samp(close) AS s, sum(abs(close)) AS a FROM panel GROUP BY ts)
SELECT symbol, ts, {r('least(greatest(close, lo), hi)', 'winsorised', 8)}, {r('(close - m) / nullif(s, 0)', 'standardised', 8)}, {r(rank('close'), 'pct_rank', 8)}, {r('close / nullif(a, 0)', 'scaled', 8)}, {r('close - m', 'neutral', 8)}
FROM panel JOIN q USING (ts)""")
def factor_preparation(spark, sf_dir):
    df = A.add_factors(panel(spark, sf_dir), {"scaled": A.scale(A.column("close")), "neutral": A.indneutralize(A.column("close"))})
    df = df.withColumns({"winsorised": A.winsorised("close", 0.05, 0.95), "standardised": A.standardised("close"), "pct_rank": A.pct_rank("close")})
    return W.rounded(df.select("symbol", "ts", "winsorised", "standardised", "pct_rank", "scaled", "neutral"), 8)


IC = f"""{PANEL}, f AS (SELECT symbol, ts, -ret AS factor, lead(close, 2) OVER (PARTITION BY symbol ORDER BY ts) / nullif(lead(close, 1) OVER (PARTITION BY symbol ORDER BY ts), 0) - 1 AS target FROM panel),
k AS (SELECT ts, {rank('factor')} AS a, {rank('target')} AS b FROM f WHERE factor IS NOT NULL AND target IS NOT NULL),
ic AS (SELECT ts, count(*) AS n, CASE WHEN stddev_pop(a) * stddev_pop(b) > 1e-12 THEN covar_pop(a, b) / (stddev_pop(a) * stddev_pop(b)) END AS ic FROM k GROUP BY ts HAVING count(*) >= 5)"""


def reversal_ic(spark, sf_dir):
    df = A.forward_return(panel(spark, sf_dir)).withColumn("factor", -W.change("close"))
    return A.rank_ic(df, "factor")


@query("rank_ic", f"WITH {IC} SELECT ts, n, {r('ic', 'ic')} FROM ic")
def rank_ic(spark, sf_dir):
    return W.rounded(reversal_ic(spark, sf_dir), 6)


@query("rank_ic_hac", f"""WITH {IC}, d AS (SELECT ts, ic, ic - avg(ic) OVER () AS d FROM ic WHERE ic IS NOT NULL),
l AS (SELECT *, d * lag(d, 1) OVER (ORDER BY ts) AS l1, d * lag(d, 2) OVER (ORDER BY ts) AS l2, d * lag(d, 3) OVER (ORDER BY ts) AS l3, d * lag(d, 4) OVER (ORDER BY ts) AS l4 FROM d),
v AS (SELECT count(*) AS n, avg(ic) AS mean, (sum(d * d) + 1.6 * coalesce(sum(l1), 0) + 1.2 * coalesce(sum(l2), 0) + 0.8 * coalesce(sum(l3), 0) + 0.4 * coalesce(sum(l4), 0)) / count(*) AS v FROM l)
SELECT n, {r('mean', 'mean')}, {r('CASE WHEN v > 0 THEN mean / sqrt(v / n) END', 't')} FROM v""")
def rank_ic_hac(spark, sf_dir):
    return W.rounded(A.hac_mean(reversal_ic(spark, sf_dir)), 6)


@query("factor_quantiles", f"""WITH {IC}, b AS (SELECT *, least(4, CAST(floor({rank('factor')} * 5 - 1e-9) AS INTEGER)) AS bucket FROM f WHERE factor IS NOT NULL AND target IS NOT NULL)
SELECT bucket, count(*) AS n, {r('avg(target)', 'mean_return', 5)} FROM b GROUP BY bucket""")
def factor_quantiles(spark, sf_dir):
    df = A.forward_return(panel(spark, sf_dir)).withColumn("factor", -W.change("close")).filter("factor is not null and target is not null")
    bucket = F.least(F.lit(4), F.floor(A.pct_rank("factor") * 5 - 1e-9)).cast("int")
    return W.rounded(df.withColumn("bucket", bucket).groupBy("bucket").agg(F.count("*").alias("n"), F.avg("target").alias("mean_return")), 5)


@query("turnover", f"""WITH {IC}, w AS (SELECT symbol, ts, ({rank('factor')} - 0.5) AS w FROM f WHERE factor IS NOT NULL),
s AS (SELECT symbol, ts, w / nullif(sum(abs(w)) OVER (PARTITION BY ts), 0) AS w FROM w),
d AS (SELECT ts, abs(w - coalesce(lag(w) OVER (PARTITION BY symbol ORDER BY ts), 0)) AS d, abs(w) AS g FROM s)
SELECT ts, {r('sum(d)', 'turnover')}, {r('sum(g)', 'gross')} FROM d GROUP BY ts""")
def turnover(spark, sf_dir):
    df = panel(spark, sf_dir).withColumn("factor", -W.change("close")).filter("factor is not null").withColumn("w", A.pct_rank("factor") - 0.5)
    df = df.withColumn("w", F.try_divide("w", F.nullif(F.sum(F.abs("w")).over(A.instant()), F.lit(0.0))))
    df = df.withColumn("_d", F.abs(F.col("w") - F.coalesce(W.prev("w"), F.lit(0.0))))
    return W.rounded(df.groupBy("ts").agg(F.sum("_d").alias("turnover"), F.sum(F.abs("w")).alias("gross")), 6)


@query("alphas_decayed")
def alphas_decayed(spark, sf_dir):
    """Formulas with decay, nested ranks in time and powers; the operators are tested one by one."""
    return alpha_query(spark, sf_dir, [57, 66, 77, 84, 86, 92, 94])


@query("factor_residual", f"""WITH {PANEL}, m AS (SELECT ts, avg(close) AS my, avg(volume) AS mx, covar_pop(close, volume) AS c, var_pop(volume) AS v FROM panel GROUP BY ts)
SELECT symbol, ts, {r('close - my - CASE WHEN v > 1e-14 THEN c / v ELSE 0 END * (volume - mx)', 'residual', 5)} FROM panel JOIN m USING (ts)""")
def factor_residual(spark, sf_dir):
    return W.rounded(panel(spark, sf_dir).select("symbol", "ts", A.residual("close", "volume").alias("residual")), 5)


def _ic_sql(h: int) -> str:
    target = f"lead(close, {1 + h}) OVER ({S}) / nullif(lead(close, 1) OVER ({S}), 0) - 1"
    return f"""f{h} AS (SELECT symbol, ts, -ret AS factor, {target} AS target FROM panel), k{h} AS (SELECT ts, {rank('factor')} AS a, {rank('target')} AS b FROM f{h} WHERE factor IS NOT NULL AND target IS NOT NULL),
i{h} AS (SELECT CASE WHEN stddev_pop(a) * stddev_pop(b) > 1e-12 THEN covar_pop(a, b) / (stddev_pop(a) * stddev_pop(b)) END AS ic FROM k{h} GROUP BY ts HAVING count(*) >= 5)"""


@query("ic_decay", f"WITH {PANEL}, {', '.join(_ic_sql(h) for h in (1, 2, 4))} " + " UNION ALL ".join(f"SELECT {h} AS horizon, count(ic) AS n, {r('avg(ic)', 'mean_ic')} FROM i{h}" for h in (1, 2, 4)))
def ic_decay(spark, sf_dir):
    return W.rounded(A.ic_decay(panel(spark, sf_dir).withColumn("factor", -W.change("close")), "factor", (1, 2, 4)), 6)


LONG_SHORT = f"""{IC}, p AS (SELECT ts, target, {rank('factor')} AS pr FROM f WHERE factor IS NOT NULL AND target IS NOT NULL),
ls AS (SELECT ts, avg(CASE WHEN pr > 1 - 0.2 THEN target END) - avg(CASE WHEN pr <= 0.2 THEN target END) AS ret FROM p GROUP BY ts)"""


@query("long_short", f"WITH {LONG_SHORT} SELECT ts, {r('ret', 'ret', 5)} FROM ls WHERE ret IS NOT NULL")
def long_short(spark, sf_dir):
    df = A.forward_return(panel(spark, sf_dir)).withColumn("factor", -W.change("close"))
    return W.rounded(A.long_short(df, "factor"), 5)


@query("long_short_yearly", f"""WITH {LONG_SHORT} SELECT CAST(year(ts) AS INTEGER) AS year, count(ret) AS n, {r('avg(ret)', 'mean', 5)}, {r('stddev_samp(ret)', 'sd', 5)}, {r('avg(CAST(ret > 0 AS INTEGER))', 'hit', 5)}
FROM ls WHERE ret IS NOT NULL GROUP BY 1""")
def long_short_yearly(spark, sf_dir):
    df = A.forward_return(panel(spark, sf_dir)).withColumn("factor", -W.change("close"))
    return W.rounded(A.yearly(A.long_short(df, "factor")), 5)
