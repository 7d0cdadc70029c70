"""Queries of masks, interval joins, look-ahead probes and the choice of unlike factors, with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemill.functions import windows as W
from tidemill.operators import factors as A
from tidemill.operators import intervals, portfolio, probe, unlike
from tidemill.plans.panel_queries import PANEL, S, over, r, rank
from tidemill.plans.portfolio_queries import weekly

QUERIES: dict = {}
SQL: dict = {}


def query(name: str, sql: str):
    def keep(f):
        QUERIES[name] = f
        SQL[name] = sql
        return f

    return keep


def event_spans(spark, sf_dir):
    """Events as points of users, clicks as intervals of as many minutes as their value; the first click of each user stays open for years."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "ts", "event_type", "value")
    clicks = events.filter("event_type = 'click' and value is not null").withColumn("long", F.col("event_id") % 50 == 1)
    minutes = F.when(F.col("long"), 60 * 24 * 2000).otherwise(F.floor("value"))
    return events, clicks.select("user_id", F.col("event_id").alias("click_id"), F.col("ts").cast("timestamp").alias("start"), F.timestamp_micros(intervals.micros(F.col("ts")) + minutes.cast("bigint") * 60_000_000).alias("end"))


SPANS = """i AS (SELECT user_id, event_id AS click_id, ts AS start, ts + to_minutes(CASE WHEN event_id % 50 = 1 THEN 60 * 24 * 2000 ELSE CAST(floor(value) AS BIGINT) END) AS "end"
  FROM events WHERE event_type = 'click' AND value IS NOT NULL)"""


@query("inside_intervals", f"""WITH {SPANS} SELECT event_id, EXISTS (SELECT 1 FROM i WHERE i.user_id = e.user_id AND i.start <= e.ts AND e.ts < i."end") AS inside,
  EXISTS (SELECT 1 FROM i WHERE i.user_id = e.user_id AND i.start <= e.ts AND e.ts + INTERVAL 10 MINUTE <= i."end") AS inside_bar FROM events e""")
def inside_intervals(spark, sf_dir):
    points, spans = event_spans(spark, sf_dir)
    found = intervals.inside(points.select("event_id", "user_id", "ts"), spans, "user_id")
    return intervals.inside(found, spans, "user_id", bar=600, out="inside_bar").select("event_id", "inside", "inside_bar")


@query("interval_pairs", f"""WITH {SPANS} SELECT event_id, click_id FROM events e JOIN i ON i.user_id = e.user_id AND i.start <= e.ts AND e.ts < i."end" """)
def interval_pairs(spark, sf_dir):
    points, spans = event_spans(spark, sf_dir)
    return intervals.interval_join(points.select("event_id", "user_id", "ts"), spans, "user_id", piece=600).select("event_id", "click_id")


LIVES = f"""WITH {PANEL}, k AS (SELECT *, CAST(substr(symbol, 2) AS BIGINT) AS k FROM panel),
s AS (SELECT symbol, min(ts) + to_days(CAST(any_value(k) % 5 * 7 * 20 AS INTEGER)) AS on_, CASE WHEN any_value(k) % 3 > 0 THEN max(ts) - to_days(CAST(any_value(k) % 7 * 40 + 3 AS INTEGER)) END AS off_ FROM k GROUP BY symbol)"""


def lives(bars):
    k = F.substring("symbol", 2, 20).cast("int")
    by = bars.groupBy("symbol").agg(F.min("ts").alias("a"), F.max("ts").alias("b")).withColumn("k", k)
    move = lambda c, days: F.timestamp_micros(F.unix_micros(c) + days.cast("bigint") * 86_400_000_000)
    return by.select("symbol", move(F.col("a"), F.col("k") % 5 * 140).alias("start"), F.when(F.col("k") % 3 > 0, move(F.col("b"), -(F.col("k") % 7 * 40 + 3))).alias("end"))


@query("lifecycle", f"""{LIVES} SELECT p.symbol, p.ts, p.ts >= on_ AND (off_ IS NULL OR p.ts + INTERVAL 7 DAY <= off_) AS live_bar,
  p.ts >= on_ AND (off_ IS NULL OR p.ts < off_) AS live_open FROM panel p JOIN s USING (symbol)""")
def lifecycle(spark, sf_dir):
    bars = weekly(spark, sf_dir).select("symbol", "ts")
    return intervals.lifecycle(bars, lives(bars), 7 * 86400.0)


@query("cells", f"""{LIVES}, e AS (SELECT 'S' || l_suppkey AS symbol, to_timestamp(floor(epoch(l_shipdate) / 604800) * 604800)::TIMESTAMP AS ts,
  CASE WHEN l_linenumber <> 7 THEN l_extendedprice END AS x FROM lineitem WHERE l_quantity > 48),
c AS (SELECT symbol, ts, sum(x) AS s, count(*) FILTER (WHERE x IS NULL) AS unknown FROM e GROUP BY ALL)
SELECT p.symbol, p.ts, {r('CASE WHEN p.ts >= on_ AND (off_ IS NULL OR p.ts < off_) AND coalesce(unknown, 0) = 0 THEN coalesce(c.s, 0) END', 'total', 4)}
FROM panel p JOIN s USING (symbol) LEFT JOIN c ON c.symbol = p.symbol AND c.ts = p.ts""")
def cells(spark, sf_dir):
    bars = weekly(spark, sf_dir).select("symbol", "ts")
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet").filter("l_quantity > 48")
    events = items.select(F.concat(F.lit("S"), "l_suppkey").alias("symbol"), F.col("l_shipdate").cast("timestamp").alias("ts"), F.when(F.col("l_linenumber") != 7, F.col("l_extendedprice").cast("double")).alias("x"))
    return W.rounded(intervals.cells(bars, events, lives(bars), "x", 604800), 4)


PROBED = ("mean", "ahead", "centred", "ranked")


def probed(df):
    """Two plans that use what was known, and two that don't."""
    df = df.withColumns({"mean": W.mean("close", 5), "ahead": F.lead("close").over(W.series()), "centred": F.avg("close").over(W.series().rowsBetween(-1, 1))})
    return df.withColumn("ranked", A.pct_rank("close"))


@query("prefix_invariance", f"""WITH {PANEL}, n AS (SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS k, count(*) OVER () AS n FROM (SELECT DISTINCT ts FROM panel)),
cuts AS (SELECT ts AS until FROM n WHERE k IN (SELECT floor(greatest(2, n // 4) + (n - 2 - greatest(2, n // 4)) * i / 8) FROM range(9) t(i))),
b AS (SELECT c.until, p.symbol, p.ts, p.close FROM panel p JOIN cuts c ON p.ts <= c.until UNION ALL SELECT NULL, symbol, ts, close FROM panel),
v AS (SELECT until, symbol, ts, CASE WHEN count(close) OVER (w ROWS 4 PRECEDING) = 5 THEN avg(close) OVER (w ROWS 4 PRECEDING) END AS mean, lead(close) OVER w AS ahead,
  avg(close) OVER (w ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS centred,
  (rank() OVER (PARTITION BY until, ts ORDER BY close) + (count(*) OVER (PARTITION BY until, ts, close) - 1) / 2) / count(*) OVER (PARTITION BY until, ts) AS ranked
  FROM b WINDOW w AS (PARTITION BY until, symbol ORDER BY ts)),
u AS (UNPIVOT (SELECT until, symbol, ts, coalesce(mean, -1e300) AS mean, coalesce(ahead, -1e300) AS ahead, coalesce(centred, -1e300) AS centred, coalesce(ranked, -1e300) AS ranked FROM v)
  ON mean, ahead, centred, ranked INTO NAME "column" VALUE x),
m AS (SELECT a."column", b.until, a.x > -1e300 AS known, abs(a.x - b.x) > 1e-9 * greatest(1, abs(a.x)) AS differs
  FROM u a JOIN u b ON a.until IS NULL AND b.until IS NOT NULL AND a.symbol = b.symbol AND a.ts = b.ts AND a."column" = b."column")
SELECT "column", count(*) FILTER (WHERE known) AS compared, count(*) FILTER (WHERE differs) AS differing, min(until) FILTER (WHERE differs) AS first_cut, count(*) FILTER (WHERE differs) = 0 AS same
FROM m GROUP BY 1""")
def prefix_invariance(spark, sf_dir):
    return probe.prefix_invariance(weekly(spark, sf_dir).select("symbol", "ts", "close"), probed, PROBED, across=True)


CHOICE = ("reversal", "momentum", "size", "count", "volume", "price")
_VALUES = f"""f AS (SELECT *, -ret AS reversal, close / nullif(lag(close, 4) OVER ({S}), 0) - 1 AS momentum, ln(quote) AS size, CAST(trades AS DOUBLE) AS "count", volume AS vol, avg(close) {over(4)} AS price,
  lead(close, 2) OVER ({S}) / nullif(lead(close, 1) OVER ({S}), 0) - 1 AS target FROM panel)"""
_COLUMNS = {"reversal": "reversal", "momentum": "momentum", "size": "size", "count": '"count"', "volume": "vol", "price": "price"}


def _corr_sql(x: str, y: str) -> str:
    return f"CASE WHEN stddev_pop({x}) FILTER (WHERE {y} IS NOT NULL) * stddev_pop({y}) FILTER (WHERE {x} IS NOT NULL) > 1e-12 THEN covar_pop({x}, {y}) / (stddev_pop({x}) FILTER (WHERE {y} IS NOT NULL) * stddev_pop({y}) FILTER (WHERE {x} IS NOT NULL)) END"


_PAIRS = [(i, j) for i in range(len(CHOICE)) for j in range(i + 1, len(CHOICE))]


@query("unlike_factors", f"""WITH RECURSIVE {PANEL}, {_VALUES},
k AS (SELECT ts, {', '.join(f'{rank(_COLUMNS[x])} AS r{i}' for i, x in enumerate(CHOICE))} FROM f),
c AS (SELECT ts, {', '.join(f'{_corr_sql(f"r{i}", f"r{j}")} AS c{i}_{j}' for i, j in _PAIRS)} FROM k GROUP BY ts),
m AS (SELECT {', '.join(f'avg(c{i}_{j}) AS c{i}_{j}' for i, j in _PAIRS)} FROM c),
pairs AS ({' UNION ALL '.join(f"SELECT '{CHOICE[a]}' AS a, '{CHOICE[b]}' AS b, c{min(a, b)}_{max(a, b)} AS corr FROM m" for i, j in _PAIRS for a, b in ((i, j), (j, i)))}),
q AS ({' UNION ALL '.join(f"SELECT '{x}' AS factor, {i} AS i, CASE WHEN {_COLUMNS[x]} IS NOT NULL AND target IS NOT NULL THEN {_COLUMNS[x]} END AS u, CASE WHEN {_COLUMNS[x]} IS NOT NULL THEN target END AS t, ts FROM f" for i, x in enumerate(CHOICE))}),
p AS (SELECT factor, i, ts, CASE WHEN u IS NOT NULL THEN rank() OVER (PARTITION BY factor, ts ORDER BY u NULLS LAST) + (count(u) OVER (PARTITION BY factor, ts, u) - 1) / 2 END AS u,
  CASE WHEN t IS NOT NULL AND u IS NOT NULL THEN rank() OVER (PARTITION BY factor, ts ORDER BY t NULLS LAST) + (count(t) OVER (PARTITION BY factor, ts, t) - 1) / 2 END AS t FROM q),
ic AS (SELECT factor, i, ts, CASE WHEN count(u) >= 5 AND stddev_pop(u) * stddev_pop(t) > 0 THEN covar_pop(u, t) / (stddev_pop(u) * stddev_pop(t)) END AS ic FROM p GROUP BY ALL),
s AS (SELECT factor, row_number() OVER (ORDER BY coalesce(abs(avg(ic)), 0) DESC, any_value(i)) AS place FROM ic GROUP BY factor),
g AS (SELECT 0::BIGINT AS place, []::VARCHAR[] AS kept
  UNION ALL
  SELECT s.place, CASE WHEN EXISTS (SELECT 1 FROM pairs WHERE a = s.factor AND list_contains(g.kept, b) AND abs(corr) > 0.5) THEN g.kept ELSE list_append(g.kept, s.factor) END FROM g JOIN s ON s.place = g.place + 1),
e AS (SELECT kept FROM g ORDER BY place DESC LIMIT 1),
w AS (SELECT s.factor, arg_min(o.factor, o.place) AS clash, arg_min(pairs.corr, o.place) AS corr FROM s JOIN pairs ON pairs.a = s.factor AND abs(pairs.corr) > 0.5 JOIN s o ON o.factor = pairs.b AND o.place < s.place
  JOIN e ON list_contains(e.kept, o.factor) GROUP BY s.factor)
SELECT s.factor, list_contains(e.kept, s.factor) AS kept, w.clash, {r('w.corr', 'corr', 4)} FROM s CROSS JOIN e LEFT JOIN w USING (factor)""")
def unlike_factors(spark, sf_dir):
    df = weekly(spark, sf_dir).withColumns({
        "reversal": -F.col("ret"), "momentum": W.change("close", 4), "size": F.ln("quote_volume"), "count": F.col("trades").cast("double"),
        "price": F.avg("close").over(W.trailing(4)),
    })
    df = A.forward_return(df, 1)
    strength = portfolio.mean_ic(df, CHOICE, "target")
    found = unlike.choose_unlike(unlike.rank_correlations(df, CHOICE), {x: strength[x] for x in CHOICE}, 0.5)
    return W.rounded(found, 4)
