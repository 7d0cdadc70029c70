"""Queries of trades, swings and order blocks over hourly bars, with SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemill.functions import windows as W
from tidemill.operators import passage
from tidemill.plans.bar_queries import hourly, lag, r
from tidemill.plans.relational_queries import CROSS, SERIES_SQL, STRUCTURE, crossed
from tidemill.sources.bars import BARS_SQL

QUERIES: dict = {}
SQL: dict = {}


def query(name: str, sql: str):
    def keep(f):
        QUERIES[name] = f
        SQL[name] = sql
        return f

    return keep


NUMBERED = f"row_number() OVER ({SERIES_SQL}) - 1 AS k"


def trades_sql(reasons: str, price: str, longest: str = "") -> str:
    """Successive trades: every signal's exit by a join with all later bars, then the chain from the first signal."""
    return f"""WITH RECURSIVE {CROSS},
bar AS (SELECT symbol, ts, open, high, low, close, enter, leave, {NUMBERED}, count(*) OVER (PARTITION BY symbol) - 1 AS last FROM x),
entry AS (SELECT symbol, k + 1 AS k FROM bar WHERE enter AND k < last),
held AS (SELECT e.symbol, e.k, p.ts AS entry_ts, p.open AS entry, j.k AS j, j.ts AS exit_ts, j.open AS o, j.high AS h, j.low AS l, j.close AS c, j.last,
    CASE WHEN j.k > e.k THEN coalesce(v.leave, false) ELSE false END AS leave, max(j.high) OVER w AS top, min(j.low) OVER w AS bottom
  FROM entry e JOIN bar p ON p.symbol = e.symbol AND p.k = e.k JOIN bar j ON j.symbol = e.symbol AND j.k >= e.k {longest}
  LEFT JOIN bar v ON v.symbol = j.symbol AND v.k = j.k - 1
  WINDOW w AS (PARTITION BY e.symbol, e.k ORDER BY j.k)),
judged AS (SELECT *, {reasons} AS reason FROM held),
ended AS (SELECT * FROM judged WHERE reason IS NOT NULL QUALIFY row_number() OVER (PARTITION BY symbol, k ORDER BY j) = 1),
linked AS (SELECT *, (SELECT min(e.k) FROM entry e WHERE e.symbol = f.symbol AND e.k > f.j) AS next FROM ended f),
taken AS (SELECT symbol, min(k) AS k FROM entry GROUP BY symbol
  UNION ALL SELECT l.symbol, l.next FROM taken t JOIN linked l ON l.symbol = t.symbol AND l.k = t.k WHERE l.next IS NOT NULL)
SELECT l.symbol, entry_ts, exit_ts, {r('entry', 'entry')}, {r(price, 'exit')}, reason FROM linked l JOIN taken t ON t.symbol = l.symbol AND t.k = l.k"""


@query("backtest_trades", trades_sql(
    "CASE WHEN leave THEN 'signal' WHEN j - k >= 24 THEN 'time' WHEN l <= entry * (1 - 0.05) THEN 'stop' WHEN h >= entry * (1 + 0.1) THEN 'target' WHEN j = last THEN 'end' END",
    "CASE reason WHEN 'stop' THEN least(o, entry * (1 - 0.05)) WHEN 'target' THEN greatest(o, entry * (1 + 0.1)) WHEN 'end' THEN c ELSE o END",
    "AND j.k <= e.k + 24",
))
def backtest_trades(spark, sf_dir):
    return W.rounded(passage.trades(crossed(spark, sf_dir)), 6)


@query("trades_trailing", trades_sql(
    "CASE WHEN leave THEN 'signal' WHEN l <= top * (1 - 0.4) THEN 'trailing' WHEN j = last THEN 'end' END",
    "CASE reason WHEN 'trailing' THEN least(o, top * (1 - 0.4)) WHEN 'end' THEN c ELSE o END",
))
def trades_trailing(spark, sf_dir):
    return W.rounded(passage.trades(crossed(spark, sf_dir), None, None, None, 0.4), 6)


@query("trades_short", trades_sql(
    """CASE WHEN leave THEN 'signal' WHEN h >= entry * (1 + 0.8) THEN 'stop' WHEN h >= bottom * (1 + 1.5) THEN 'trailing' WHEN l <= entry * (1 - 0.6) THEN 'target'
      WHEN j = last THEN 'end' END""",
    "CASE reason WHEN 'stop' THEN greatest(o, entry * (1 + 0.8)) WHEN 'trailing' THEN greatest(o, bottom * (1 + 1.5)) WHEN 'target' THEN least(o, entry * (1 - 0.6)) WHEN 'end' THEN c ELSE o END",
))
def trades_short(spark, sf_dir):
    return W.rounded(passage.trades(crossed(spark, sf_dir), 0.8, 0.6, None, 1.5, short=True), 6)


@query("zigzag", f"""WITH RECURSIVE {BARS_SQL}, b AS (SELECT symbol, ts, close AS x, {NUMBERED} FROM bars),
w AS (SELECT symbol, k, 0 AS dir, k AS pk, x AS px FROM b WHERE k = 0
  UNION ALL
  SELECT b.symbol, b.k,
    CASE WHEN w.dir >= 0 AND b.x <= w.px * (1 - 0.3) THEN -1 WHEN w.dir <= 0 AND b.x >= w.px * (1 + 0.3) THEN 1 ELSE w.dir END,
    CASE WHEN w.dir >= 0 AND b.x <= w.px * (1 - 0.3) OR w.dir <= 0 AND b.x >= w.px * (1 + 0.3) OR w.dir = 1 AND b.x > w.px OR w.dir = -1 AND b.x < w.px THEN b.k ELSE w.pk END,
    CASE WHEN w.dir >= 0 AND b.x <= w.px * (1 - 0.3) OR w.dir <= 0 AND b.x >= w.px * (1 + 0.3) OR w.dir = 1 AND b.x > w.px OR w.dir = -1 AND b.x < w.px THEN b.x ELSE w.px END
  FROM w JOIN b ON b.symbol = w.symbol AND b.k = w.k + 1),
n AS (SELECT *, lead(pk) OVER (PARTITION BY symbol ORDER BY k) AS next, lead(dir) OVER (PARTITION BY symbol ORDER BY k) AS turn FROM w),
p AS (SELECT symbol, pk AS k, CASE WHEN next IS NULL THEN 'open' WHEN dir = 1 THEN 'high' ELSE 'low' END AS kind FROM n WHERE dir <> 0 AND (next IS NULL OR next <> pk AND turn <> dir)
  UNION ALL SELECT symbol, 0, 'first' FROM b WHERE k = 0)
SELECT b.symbol, b.ts, {r('CASE WHEN p.kind IS NOT NULL THEN x END', 'pivot')}, p.kind FROM b LEFT JOIN p ON p.symbol = b.symbol AND p.k = b.k""")
def zigzag(spark, sf_dir):
    return W.rounded(passage.zigzag(hourly(spark, sf_dir), "close", 30.0), 6)


def _blocks_sql(name: str, source: str, beyond: str, against: str, level: str, reach: str) -> str:
    """CTEs from levels to blocks of one direction."""
    return f"""{name}l AS (SELECT symbol, k AS start, {level} AS level, coalesce(lead(k) OVER (PARTITION BY symbol ORDER BY k), 1e15) AS until FROM kb WHERE {level} IS NOT NULL),
{name}b AS (SELECT l.symbol, l.start, min(j.k) AS k FROM {name}l l JOIN {source} j ON j.symbol = l.symbol AND j.k >= l.start AND j.k < l.until AND j.close {beyond} l.level GROUP BY l.symbol, l.start),
{name}o AS (SELECT b.symbol, b.k, max(j.k) AS block FROM {name}b b JOIN kb j ON j.symbol = b.symbol AND j.k > b.start AND j.k < b.k AND {against} GROUP BY b.symbol, b.k),
{name} AS (SELECT '{name}' AS direction, o.symbol, s.ts, q.ts AS block_ts, q.high AS top, q.low AS bottom,
    (SELECT min(t.ts) FROM kb t WHERE t.symbol = o.symbol AND t.k > o.k AND {reach}) AS touched_ts
  FROM {name}o o JOIN kb s ON s.symbol = o.symbol AND s.k = o.k JOIN kb q ON q.symbol = o.symbol AND q.k = o.block)"""


@query("order_blocks", f"""WITH {STRUCTURE}, kb AS (SELECT *, {NUMBERED} FROM lg),
{_blocks_sql('up', 'kb', '>', 'j.close < j.open', 'h5', 't.low <= q.high')},
fb AS (SELECT kb.* FROM kb ANTI JOIN upb ON upb.symbol = kb.symbol AND upb.k = kb.k),
{_blocks_sql('down', 'fb', '<', 'j.close > j.open', 'l5', 't.high >= q.low')}
SELECT symbol, ts, direction, block_ts, {r('top', 'top')}, {r('bottom', 'bottom')}, touched_ts FROM (SELECT * FROM up UNION ALL SELECT * FROM down)""")
def order_blocks(spark, sf_dir):
    return W.rounded(passage.order_blocks(hourly(spark, sf_dir)), 6)


@query("exit_rules", f"""WITH {CROSS} SELECT symbol, ts, coalesce(close < min(low) OVER p10 AND count(low) OVER p10 = 10, false) AS swing_long, coalesce(close > max(high) OVER p10 AND count(high) OVER p10 = 10, false) AS swing_short,
  coalesce((open - {lag('close')}) / nullif({lag('close')}, 0), 0) <= -0.3 AS gap_long, coalesce((open - {lag('close')}) / nullif({lag('close')}, 0), 0) >= 0.3 AS gap_short,
  coalesce(close < f, false) AS through_long, coalesce(close > f, false) AS through_short, coalesce({lag('f')} >= {lag('s')} AND f < s, false) AS cross_long, coalesce({lag('f')} <= {lag('s')} AND f > s, false) AS cross_short
FROM x WINDOW p10 AS ({SERIES_SQL} ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)""")
def exit_rules(spark, sf_dir):
    rules = {"swing": (passage.swing_broken, (10,)), "gap": (passage.gap_against, (0.3,)), "through": (passage.closed_through, ("f",)), "cross": (passage.crossed_against, ("f", "s"))}
    columns = {f"{name}_{'short' if short else 'long'}": f(*args, short) for name, (f, args) in rules.items() for short in (False, True)}
    return crossed(spark, sf_dir).select("symbol", "ts", *[v.alias(k) for k, v in columns.items()])


STAGES = ((0.2, 0.5), (0.8, 0.3), (5.0, 0.2))


@query("staged_exits", f"""WITH {CROSS}, bar AS (SELECT symbol, ts, open, high, low, close, enter, {NUMBERED} FROM x),
e AS (SELECT b.symbol, b.k, b.ts, b.open AS entry FROM bar b JOIN bar p ON p.symbol = b.symbol AND p.k = b.k - 1 AND p.enter),
t AS (SELECT * FROM (VALUES {', '.join(f'({i}, {gain}, {share})' for i, (gain, share) in enumerate(STAGES, 1))}) t(stage, gain, share)),
a AS (SELECT e.symbol, e.k, e.entry, (SELECT min(j.k) FROM bar j WHERE j.symbol = e.symbol AND j.k >= e.k AND j.high >= e.entry * 1.5) AS armed FROM e)
SELECT e.symbol, e.ts, stage, {r('e.entry * (1 + gain)', 'price')}, share, (SELECT min(j.ts) FROM bar j WHERE j.symbol = e.symbol AND j.k >= e.k AND j.close >= e.entry * (1 + gain)) AS exit_ts,
  (SELECT min(j.ts) FROM bar j JOIN a ON a.symbol = e.symbol AND a.k = e.k WHERE j.symbol = e.symbol AND j.k >= a.armed AND j.close <= e.entry * 1.1) AS breakeven_ts
FROM e CROSS JOIN t""")
def staged_exits(spark, sf_dir):
    bars = passage.cut(passage.numbered(crossed(spark, sf_dir)))
    entries = bars.filter("enter").select("symbol", (F.col("k") + 1).alias("k")).join(bars.select("symbol", "k", F.col("open").alias("entry")), ["symbol", "k"])
    times = bars.select("symbol", "k", "ts")
    staged = passage.partial_exits(bars, entries, list(STAGES))
    back = passage.breakeven_exits(bars, entries, 0.5, 0.1, out="back_k").select("symbol", "k", "back_k")
    at = lambda name, to: times.select("symbol", F.col("k").alias(name), F.col("ts").alias(to))
    found = staged.join(back, ["symbol", "k"]).join(times, ["symbol", "k"]).join(at("exit_k", "exit_ts"), ["symbol", "exit_k"], "left").join(at("back_k", "breakeven_ts"), ["symbol", "back_k"], "left")
    return W.rounded(found.select("symbol", "ts", "stage", "price", "share", "exit_ts", "breakeven_ts"), 6)
