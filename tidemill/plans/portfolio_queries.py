"""Queries of weights, coefficients and neutralisation over the weekly panel, with SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemill.functions import windows as W
from tidemill.operators import factors as A
from tidemill.operators import portfolio as P
from tidemill.plans.panel_queries import PANEL, S, r, rank
from tidemill.sources.bars import panel

QUERIES: dict = {}
SQL: dict = {}


def query(name: str, sql: str):
    def keep(f):
        QUERIES[name] = f
        SQL[name] = sql
        return f

    return keep


def weekly(spark, sf_dir):
    """The panel with the return of each week."""
    return panel(spark, sf_dir).withColumn("ret", W.change("close"))


def z(x: str) -> str:
    return f"({x} - avg({x}) OVER t) / nullif(stddev_samp({x}) OVER t, 0)"


def capped(source: str, v: str, cap: float, gross: float = 1.0, least: int = 5) -> str:
    """CTEs that end in `weights` (symbol, ts, weight): neutral weights of column v of a table."""
    half, most = gross / 2, cap * gross
    return f"""c0 AS (SELECT symbol, ts, {v} - avg({v}) OVER (PARTITION BY ts) AS v, count({v}) OVER (PARTITION BY ts) AS n FROM {source}),
c1 AS (SELECT *, CASE WHEN abs(v) > 1e-12 THEN abs(v) END AS m, sign(v) AS side FROM c0),
c2 AS (SELECT *, row_number() OVER d - 1 AS ahead, sum(m) OVER (d ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS behind FROM c1
    WINDOW d AS (PARTITION BY ts, side ORDER BY m DESC NULLS LAST)),
c3 AS (SELECT *, coalesce(({half} - ahead * {most}) * m >= {most} * behind, false) AS held FROM c2),
c4 AS (SELECT *, CASE WHEN m IS NULL THEN NULL WHEN held THEN {most}
    ELSE m * ({half} - {most} * count(*) FILTER (WHERE held) OVER s) / sum(m) FILTER (WHERE NOT held) OVER s END AS w FROM c3 WINDOW s AS (PARTITION BY ts, side)),
c5 AS (SELECT *, coalesce(sum(w) FILTER (WHERE side = 1) OVER t, 0) AS longs, coalesce(sum(w) FILTER (WHERE side = -1) OVER t, 0) AS shorts,
    sum(w) OVER (PARTITION BY ts, side) AS own FROM c4 WINDOW t AS (PARTITION BY ts)),
weights AS (SELECT symbol, ts, CASE WHEN n >= {least} THEN coalesce(side * w * least(1, least(longs, shorts) / own), 0) ELSE 0 END AS weight FROM c5)"""


INSTANTS = "instants AS (SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS k FROM (SELECT DISTINCT ts FROM panel))"
SCORED = f"""x0 AS (SELECT *, -ret AS score, ln(close / lag(close) OVER ({S})) AS lr FROM panel),
x1 AS (SELECT *, {rank('score')} AS share, CASE WHEN count(lr) OVER w >= 5 THEN stddev_samp(lr) OVER w END AS vol FROM x0
    WINDOW w AS ({S} ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)),
x2 AS (SELECT *, {z('share')} / greatest(vol, 1e-4) AS raw FROM x1 WINDOW t AS (PARTITION BY ts)),
x3 AS (SELECT *, CASE WHEN vol IS NOT NULL THEN raw END AS v FROM x2)"""
WEIGHTS = f"WITH {PANEL}, {SCORED}, {capped('x3', 'v', 0.02)}, {INSTANTS}, chosen AS (SELECT * FROM weights JOIN instants USING (ts) WHERE k % 3 = 0)"


def chosen(spark, sf_dir):
    scored = weekly(spark, sf_dir).withColumn("score", -F.col("ret"))
    return P.target_weights(scored, "score", "risk_scaled", vol_window=10, cap=0.02)


@query("target_weights", f"{WEIGHTS} SELECT symbol, ts, {r('weight', 'weight')} FROM chosen")
def target_weights(spark, sf_dir):
    return W.rounded(chosen(spark, sf_dir), 6)


@query("book_turnover", f"""{WEIGHTS}, o AS (SELECT symbol, k / 3 AS k, weight FROM chosen),
m AS (SELECT coalesce(a.k, b.k + 1) AS k, coalesce(a.weight, 0) AS w, coalesce(b.weight, 0) AS b FROM o a FULL JOIN o b ON a.symbol = b.symbol AND a.k = b.k + 1)
SELECT ts, {r('sum(abs(w))', 'gross')}, {r('sum(w)', 'net')}, count(*) FILTER (WHERE w <> 0) AS names, {r('sum(abs(w - b)) / 2', 'turnover')}
FROM m JOIN instants i ON i.k = m.k * 3 GROUP BY ts""")
def book_turnover(spark, sf_dir):
    return W.rounded(P.turnover(chosen(spark, sf_dir)), 6)


PICKS = f"""x0 AS (SELECT *, {rank('ret')} AS share FROM panel),
x1 AS (SELECT *, CASE WHEN share >= 0.8 THEN 1.0 WHEN share <= 0.2 THEN -1.0 WHEN share IS NOT NULL THEN 0.0 END AS pick FROM x0)"""


@query("quantile_weights", f"WITH {PANEL}, {PICKS}, {capped('x1', 'pick', 1e6)} SELECT symbol, ts, {r('weight', 'weight')} FROM weights")
def quantile_weights(spark, sf_dir):
    return W.rounded(P.quantile_weights(weekly(spark, sf_dir), "ret", 0.2).select("symbol", "ts", "weight"), 6)


def two_factors(spark, sf_dir):
    df = weekly(spark, sf_dir).withColumn("reversal", -F.col("ret")).withColumn("size", F.ln("quote_volume"))
    return A.forward_return(df, 1)


FACTORS = f"""f0 AS (SELECT *, -ret AS reversal, ln(quote) AS size, lead(close, 2) OVER ({S}) / nullif(lead(close, 1) OVER ({S}), 0) - 1 AS target FROM panel),
f1 AS (SELECT *, CASE WHEN target IS NOT NULL THEN reversal END AS ra, CASE WHEN reversal IS NOT NULL THEN target END AS rb,
    CASE WHEN target IS NOT NULL THEN size END AS sa, CASE WHEN size IS NOT NULL THEN target END AS sb FROM f0),
f2 AS (SELECT *, {rank('ra')} AS pra, {rank('rb')} AS prb, {rank('sa')} AS psa, {rank('sb')} AS psb FROM f1),
ics AS (SELECT ts, CASE WHEN count(pra) >= 5 AND stddev_pop(pra) * stddev_pop(prb) > 1e-12 THEN covar_pop(pra, prb) / (stddev_pop(pra) * stddev_pop(prb)) END AS a,
    CASE WHEN count(psa) >= 5 AND stddev_pop(psa) * stddev_pop(psb) > 1e-12 THEN covar_pop(psa, psb) / (stddev_pop(psa) * stddev_pop(psb)) END AS b FROM f2 GROUP BY ts),
ic AS (SELECT avg(a) AS a, avg(b) AS b FROM ics),
z0 AS (SELECT ts, target AS y, {z('reversal')} AS a, {z('size')} AS b FROM f0 WINDOW t AS (PARTITION BY ts)),
z1 AS (SELECT *, count(*) OVER (PARTITION BY ts) AS n FROM z0 WHERE a IS NOT NULL AND b IS NOT NULL AND y IS NOT NULL),
gram AS (SELECT sum(a * a) + 1 AS aa, sum(a * b) AS ab, sum(b * b) + 1 AS bb, sum(a * y) AS y1, sum(b * y) AS y2 FROM z1 WHERE n >= 5),
ridge AS (SELECT (y1 * bb - y2 * ab) / (aa * bb - ab * ab) AS a, (y2 * aa - y1 * ab) / (aa * bb - ab * ab) AS b FROM gram),
found AS (SELECT 'ic' AS method, a, b FROM ic UNION ALL SELECT 'equal', CASE WHEN a >= 0 THEN 1 ELSE -1 END, CASE WHEN b >= 0 THEN 1 ELSE -1 END FROM ic UNION ALL SELECT 'ridge', a, b FROM ridge),
scaled AS (SELECT method, a / (abs(a) + abs(b)) AS a, b / (abs(a) + abs(b)) AS b FROM found),
shrunk AS (SELECT method, 0.75 * a + 0.25 * CASE WHEN a >= 0 THEN 0.5 ELSE -0.5 END AS a, 0.75 * b + 0.25 * CASE WHEN b >= 0 THEN 0.5 ELSE -0.5 END AS b FROM scaled)"""


@query("betas", f"""WITH {PANEL}, {FACTORS} SELECT method, 'reversal' AS factor, {r('a', 'beta', 5)} FROM shrunk
UNION ALL SELECT method, 'size', {r('b', 'beta', 5)} FROM shrunk""")
def betas(spark, sf_dir):
    df = two_factors(spark, sf_dir)
    rows = [(m, k, v) for m in ("ic", "equal", "ridge") for k, v in P.fit_betas(df, ["reversal", "size"], "target", m, 0.25).items()]
    return W.rounded(spark.createDataFrame(rows, "method string, factor string, beta double"), 5)


@query("forecast", f"""WITH {PANEL}, {FACTORS},
h0 AS (SELECT *, {rank('reversal')} AS pa, {rank('size')} AS pb FROM f0), h1 AS (SELECT *, {z('pa')} AS za, {z('pb')} AS zb FROM h0 WINDOW t AS (PARTITION BY ts))
SELECT symbol, ts, {r('(coalesce(za * s.a, 0) + coalesce(zb * s.b, 0)) / nullif(CASE WHEN za IS NOT NULL THEN abs(s.a) ELSE 0 END + CASE WHEN zb IS NOT NULL THEN abs(s.b) ELSE 0 END, 0)', 'forecast', 4)}
FROM h1 CROSS JOIN shrunk s WHERE s.method = 'ridge'""")
def forecast(spark, sf_dir):
    df = two_factors(spark, sf_dir)
    fitted = P.fit_betas(df, ["reversal", "size"], "target", "ridge", 0.25)
    return W.rounded(P.forecast(df, fitted).select("symbol", "ts", "forecast"), 4)


@query("neutralised", f"""WITH {PANEL}, a AS (SELECT symbol, ts, ret, ln(quote) AS u, CAST(trades AS DOUBLE) AS v FROM panel),
b AS (SELECT *, count(*) OVER t AS n, ret - avg(ret) OVER t AS y, u - avg(u) OVER t AS p, v - avg(v) OVER t AS q FROM a WHERE ret IS NOT NULL AND u IS NOT NULL WINDOW t AS (PARTITION BY ts)),
c AS (SELECT *, sum(p * p) OVER t AS pp, sum(p * q) OVER t AS pq, sum(q * q) OVER t AS qq, sum(p * y) OVER t AS py, sum(q * y) OVER t AS qy FROM b WINDOW t AS (PARTITION BY ts)),
d AS (SELECT *, pp > 0 AS one, qq - CASE WHEN pp > 0 THEN pq * pq / pp ELSE 0 END > 1e-10 * qq AS two FROM c),
e AS (SELECT *, CASE WHEN one AND two THEN (py * qq - qy * pq) / (pp * qq - pq * pq) WHEN one THEN py / pp ELSE 0 END AS f,
    CASE WHEN one AND two THEN (qy * pp - py * pq) / (pp * qq - pq * pq) WHEN two THEN qy / qq ELSE 0 END AS g FROM d)
SELECT a.symbol, a.ts, {r('CASE WHEN n >= 5 AND n > 3 THEN y - f * p - g * q END', 'residual')} FROM a LEFT JOIN e USING (symbol, ts)""")
def neutralised(spark, sf_dir):
    df = weekly(spark, sf_dir).withColumns({"u": F.ln("quote_volume"), "v": F.col("trades").cast("double")})
    return W.rounded(P.neutralised(df, "ret", ["u", "v"]).select("symbol", "ts", "residual"), 6)
