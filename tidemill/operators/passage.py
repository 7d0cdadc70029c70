"""First passages: the first bar beyond a level, for any number of starts at once, and what follows from them.

A series of a symbol is a tree of minima: bars in groups of `FAN`, groups in groups of as many, up to one
root. A start climbs until a group holds a bar low enough, and goes down to it; each step is a join by
equality with one row for each group, so that no start reads bar after bar and no symbol is walked. Chains
of events (trades that begin after the one before has ended, swings that turn into each other) are pointers
from event to event; those that the chain reaches are found by doubling the pointers.

All tables have (symbol, k): k counts the bars of a symbol from 0.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.functions.windows import cross_above, cross_below, div, highest, lowest, prev, series, yes
from tidemill.sources.shared import cut

FAN = 64


def numbered(df: DataFrame) -> DataFrame:
    """Bars with their number k in the order of time."""
    return df.withColumn("k", (F.row_number().over(series()) - 1).cast("bigint"))


def next_where(condition: Column, value: Column) -> Column:
    """The value at the first row from this one on where the condition holds (a window that runs backwards)."""
    return F.last(F.when(condition, value), True).over(Window.partitionBy("symbol").orderBy(F.desc("k")).rowsBetween(Window.unboundedPreceding, 0))


def _levels(bars: DataFrame, value: Column, fan: int) -> list[DataFrame]:
    """Tables (symbol, g, values): the values of each group in order; those of the next table are the least of these."""
    now, out = bars.select("symbol", "k", value.cast("double").alias("v")), []
    while True:
        grouped = now.groupBy("symbol", F.floor(F.col("k") / fan).alias("g")).agg(F.transform(F.sort_array(F.collect_list(F.struct("k", F.coalesce("v", F.lit(float("inf"))).alias("v")))), lambda x: x["v"]).alias("values"))
        grouped = cut(grouped)
        out.append(grouped)
        if grouped.agg(F.coalesce(F.max("g"), F.lit(0))).first()[0] == 0:
            return out
        now = grouped.select("symbol", F.col("g").alias("k"), F.array_min("values").alias("v"))


def first_passage(starts: DataFrame, bars: DataFrame, value: Column, out: str, level: str = "level", start: str = "start", above: bool = False, strict: bool = False, fan: int = FAN) -> DataFrame:
    """Add `out` to starts (symbol, id, start, level): the first k >= start at which the value is at or below its level.

    `above`: at or above it; `strict`: beyond it. NULL where no bar is, or where start or level are unknown. `id`
    tells the starts of a symbol apart; a value that is NULL passes no level.
    """
    sign = -1 if above else 1
    tables = _levels(bars, value * sign, fan)
    asked = cut(starts.filter(F.col(start).isNotNull() & F.col(level).isNotNull()).select("symbol", "id", F.col(start).cast("bigint").alias("at"), (F.col(level) * sign).alias("_level")))

    def hit(rows: DataFrame, table: DataFrame, first: Column) -> DataFrame:
        """The first place from `first` on in the group g that is low enough, as a node."""
        found = F.filter(F.sequence(first, F.greatest(first, F.size("values") - 1)), lambda i: F.get("values", i) < F.col("_level") if strict else F.get("values", i) <= F.col("_level"))
        return rows.join(table, ["symbol", "g"], "left").withColumn("node", F.col("g") * fan + F.get(F.when(F.col("values").isNotNull(), found), 0)).drop("values")

    found, pending = [], asked
    for k, table in enumerate(tables):
        met = cut(hit(pending.withColumn("g", F.floor(F.col("at") / fan)), table, (F.col("at") % fan).cast("int")))
        found.append(met.filter("node is not null").select("symbol", "id", "_level", "node"))
        pending = met.filter("node is null").select("symbol", "id", (F.col("g") + 1).alias("at"), "_level")
        if k + 1 == len(tables):
            break
    down = found[-1]
    for k in reversed(range(len(tables) - 1)):
        below = hit(down.withColumnRenamed("node", "g"), tables[k], F.lit(0))
        down = found[k].unionByName(below.select("symbol", "id", "_level", "node"))
    return starts.join(down.select("symbol", "id", F.col("node").alias(out)), ["symbol", "id"], "left")


def trailing_passage(bars: DataFrame, peak: Column, level: Column, value: Column, out: str, above: bool = False) -> DataFrame:
    """Add `out` to bars: the first k from each bar on at which the value falls to a level that trails the best peak since.

    Some bar since the start has set the peak whose level is passed; so the first passage from a start is the
    least of the first passages from all later bars, each with its own level, and one window that runs backwards finds it.
    Where `level` rises with `peak`, that is the level of the running best. `above` is for shorts.
    """
    starts = bars.select("symbol", F.col("k").alias("id"), F.col("k").alias("start"), F.when(peak.isNotNull(), level).alias("level"))
    own = first_passage(starts, bars, value, "_own", above=above).select("symbol", F.col("id").alias("k"), "_own")
    least = F.min("_own").over(Window.partitionBy("symbol").orderBy(F.desc("k")).rowsBetween(Window.unboundedPreceding, 0))
    return bars.join(own, ["symbol", "k"], "left").withColumn(out, least).drop("_own")


def reached(pointers: DataFrame, roots: DataFrame) -> DataFrame:
    """(symbol, k) that a chain reaches: pointers (symbol, k, next) lead on, roots (symbol, k) begin.

    Each round joins the pointers with themselves, so that they reach twice as far, and the rows reached so far
    with the pointers; rounds are logarithmic in the longest chain.
    """
    jump = cut(pointers.filter("next is not null").select("symbol", "k", "next"))
    seen = cut(roots.select("symbol", "k").distinct())
    while not jump.isEmpty():
        ahead = seen.join(jump, ["symbol", "k"]).select("symbol", F.col("next").alias("k"))
        seen = cut(seen.union(ahead).distinct())
        jump = cut(jump.join(jump.select("symbol", F.col("k").alias("next"), F.col("next").alias("_far")), ["symbol", "next"]).select("symbol", "k", F.col("_far").alias("next")))
    return seen


def exits(bars: DataFrame, entries: DataFrame, stop: float | None = None, target: float | None = None, longest: int | None = None, trailing: float | None = None, leave: Column | None = None, short: bool = False) -> DataFrame:
    """(symbol, k, entry, exit_k, exit, reason) for entries (symbol, k) at the open of their bar, each by itself.

    Reasons in order: signal (`leave` held on the bar before; at the open), time (at the open, `longest` bars later), stop, trailing
    and target (at their level, or at the open if that is beyond it), end (the last close). A trailing stop follows the best
    price up to and with the bar.
    """
    up = -1.0 if short else 1.0
    worse, better = ("high", "low") if short else ("low", "high")
    bars = cut(bars.select("symbol", "k", "open", "high", "low", "close", (F.coalesce(leave, F.lit(False)) if leave is not None else F.lit(False)).alias("_leave")))
    bars = bars.withColumns({"_last": F.max("k").over(Window.partitionBy("symbol")), "_signal": next_where(F.col("_leave"), F.col("k") + 1)})
    level = lambda share: F.col(better) * (1 - up * share)
    if trailing is not None:
        bars = trailing_passage(bars, F.col(better), level(trailing), F.col(worse), "_trailing", above=short)
    bars = cut(bars)
    found = entries.select("symbol", "k").join(bars, ["symbol", "k"]).select("symbol", "k", F.col("k").alias("id"), F.col("k").alias("start"), F.col("open").alias("entry"), "_last", "_signal", *(["_trailing"] if trailing is not None else []))
    for name, share, side, above in (("stop", stop, worse, short), ("target", target, better, not short)):
        if share is not None:
            found = found.withColumn("level", F.col("entry") * (1 - up * share) if name == "stop" else F.col("entry") * (1 + up * share))
            found = first_passage(found, bars, F.col(side), f"_{name}", above=above)
    at = {"signal": F.when(F.col("_signal") <= F.col("_last"), F.col("_signal")), "time": F.when(F.col("k") + longest <= F.col("_last"), F.col("k") + longest) if longest is not None else None}
    at |= {"stop": F.col("_stop") if stop is not None else None, "trailing": F.col("_trailing") if trailing is not None else None, "target": F.col("_target") if target is not None else None, "end": F.col("_last")}
    ranked = F.array(*[F.struct(v.alias("k"), F.lit(i).alias("i"), F.lit(name).alias("reason")) for i, (name, v) in enumerate(at.items()) if v is not None])
    best = F.array_min(F.filter(ranked, lambda x: x["k"].isNotNull()))
    found = found.withColumn("_best", best).select("symbol", "k", "entry", F.col("_best.k").alias("exit_k"), F.col("_best.reason").alias("reason"))
    peaks = None
    there = bars.select("symbol", F.col("k").alias("exit_k"), F.col("open").alias("_o"), F.col("close").alias("_c"))
    found = found.join(there, ["symbol", "exit_k"])
    if trailing is not None:
        peaks = _peaks(found.filter("reason = 'trailing'"), bars, better, short)
        found = found.join(peaks, ["symbol", "k"], "left")
    beyond = lambda x, worst: F.least("_o", x) if worst != short else F.greatest("_o", x)
    prices = {
        "stop": beyond(F.col("entry") * (1 - up * (stop or 0)), True), "target": beyond(F.col("entry") * (1 + up * (target or 0)), False),
        "trailing": beyond(F.col("_peak") * (1 - up * (trailing or 0)), True) if trailing is not None else F.lit(None), "end": F.col("_c"),
    }
    price = reduce(lambda c, kv: c.when(F.col("reason") == kv[0], kv[1]), prices.items(), F.when(F.col("reason").isin("signal", "time"), F.col("_o")))
    return found.withColumn("exit", price).select("symbol", "k", "entry", "exit_k", "exit", "reason")


def breakeven_exits(bars: DataFrame, entries: DataFrame, trigger: float, lock: float = 0.0, short: bool = False, out: str = "exit_k") -> DataFrame:
    """Add to entries (symbol, k, entry) the first bar that closes back at `lock` of gain once the price has gained `trigger`.

    Both are first passages: the trigger's by the best price from the entry bar on, the exit's by the close from the trigger's bar on.
    """
    up = -1.0 if short else 1.0
    asked = entries.withColumns({"id": F.col("k"), "start": F.col("k"), "level": F.col("entry") * (1 + up * trigger)})
    armed = first_passage(asked, bars, F.col("low" if short else "high"), "_armed", above=not short)
    back = armed.withColumns({"start": F.col("_armed"), "level": F.col("entry") * (1 + up * lock)})
    return first_passage(back, bars, F.col("close"), out, above=short).drop("id", "start", "level", "_armed")


def partial_exits(bars: DataFrame, entries: DataFrame, targets: list[tuple[float, float]], short: bool = False) -> DataFrame:
    """(symbol, k, stage, price, share, exit_k): for entries (symbol, k, entry) the first close at each level of gain, with the share that leaves there."""
    up = -1.0 if short else 1.0
    stages = F.explode(F.array(*[F.struct(F.lit(i).alias("stage"), F.lit(float(g)).alias("gain"), F.lit(float(s)).alias("share")) for i, (g, s) in enumerate(targets, 1)]))
    asked = entries.select("symbol", "k", "entry", stages.alias("t")).select("symbol", "k", "t.stage", "t.share", (F.col("entry") * (1 + up * F.col("t.gain"))).alias("level"))
    asked = asked.withColumns({"id": F.col("k") * len(targets) + F.col("stage") - 1, "start": F.col("k")})
    found = first_passage(asked, bars, F.col("close"), "exit_k", above=not short)
    return found.select("symbol", "k", "stage", F.col("level").alias("price"), "share", "exit_k")


def swing_broken(n: int = 10, short: bool = False) -> Column:
    """The close leaves the range of the n bars before, against the position."""
    if short:
        return yes(F.col("close") > highest("high", n, 1))
    return yes(F.col("close") < lowest("low", n, 1))


def gap_against(share: float = 0.01, short: bool = False) -> Column:
    """The open stands at least so far from the last close, against the position."""
    gap = F.coalesce(div(F.col("open") - prev("close"), prev("close")), F.lit(0.0))
    return yes(gap >= share if short else gap <= -share)


def closed_through(x: Column | str, short: bool = False) -> Column:
    """The close lies beyond a line (a mean that trails the price), against the position."""
    line = F.col(x) if isinstance(x, str) else x
    return yes(F.col("close") > line if short else F.col("close") < line)


def crossed_against(fast: str, slow: str, short: bool = False) -> Column:
    """Two lines (means, or an oscillator and its signal) cross against the position."""
    return cross_above(fast, slow) if short else cross_below(fast, slow)


def _peaks(ended: DataFrame, bars: DataFrame, better: str, short: bool, fan: int = FAN) -> DataFrame:
    """(symbol, k, _peak): the best price from k to exit_k, from groups of bars: whole groups between, the ends by bars."""
    best = F.min if short else F.max
    sized = bars.withColumn("g", F.floor(F.col("k") / fan))
    groups = sized.groupBy("symbol", "g").agg(best(better).alias("v"))
    first, last = F.floor(F.col("k") / fan), F.floor(F.col("exit_k") / fan)
    spans = ended.select("symbol", "k", "exit_k", first.alias("_a"), last.alias("_b"))
    whole = spans.filter(F.col("_b") - F.col("_a") > 1).withColumn("g", F.explode(F.sequence(F.col("_a") + 1, F.col("_b") - 1)))
    inner = whole.join(groups, ["symbol", "g"]).select("symbol", "k", "v")
    ends = spans.withColumn("g", F.explode(F.array_distinct(F.array("_a", "_b")))).join(sized.select("symbol", "g", F.col("k").alias("_k"), F.col(better).alias("v")), ["symbol", "g"])
    outer = ends.filter(F.col("_k").between(F.col("k"), F.col("exit_k"))).select("symbol", "k", "v")
    return inner.union(outer).groupBy("symbol", "k").agg(best("v").alias("_peak"))


def trades(bars: DataFrame, stop: float | None = 0.05, target: float | None = 0.1, longest: int | None = 24, trailing: float | None = None, short: bool = False) -> DataFrame:
    """(symbol, entry_ts, exit_ts, entry, exit, reason) of successive trades; needs columns enter and leave.

    A trade opens on the bar after a signal and none is taken while it is open: each signal's exit is found by itself,
    points to the first signal from its exit on, and the chain from the first signal is followed by doubling.
    """
    rows = numbered(bars.select("symbol", "ts", "open", "high", "low", "close", F.coalesce("enter", F.lit(False)).alias("enter"), F.coalesce("leave", F.lit(False)).alias("leave")))
    rows = rows.withColumn("_last", F.max("k").over(Window.partitionBy("symbol")))
    signal = F.col("enter") & (F.col("k") < F.col("_last"))
    rows = cut(rows.withColumn("_next", next_where(signal, F.col("k") + 1)))
    entries = rows.filter(signal).select("symbol", (F.col("k") + 1).alias("k"))
    ended = cut(exits(rows, entries, stop, target, longest, trailing, F.col("leave"), short))
    onward = ended.join(rows.select("symbol", F.col("k").alias("exit_k"), F.col("_next").alias("next")), ["symbol", "exit_k"], "left")
    taken = reached(onward, entries.groupBy("symbol").agg(F.min("k").alias("k")))
    times = rows.select("symbol", "k", F.col("ts").alias("entry_ts"))
    found = ended.join(taken, ["symbol", "k"], "left_semi").join(times, ["symbol", "k"])
    return found.join(times.select("symbol", F.col("k").alias("exit_k"), F.col("entry_ts").alias("exit_ts")), ["symbol", "exit_k"]).select("symbol", "entry_ts", "exit_ts", "entry", "exit", "reason")


def zigzag(df: DataFrame, x: str = "close", percent: float = 5.0) -> DataFrame:
    """Bars with pivot (the price where a swing ends, else NULL) and kind: first, high, low, or `open` for the last, which may still move.

    A swing ends where the price has turned by `percent` from its extreme. Whether a bar extends an upswing or
    turns it depends on the bar only that holds the extreme, so each bar has two states (top or bottom of the
    swing so far) and each state one successor: the first bar beyond it, or the first that turns. Prices are
    above 0; rows without one are skipped.
    """
    if percent <= 0:
        raise ValueError("percent must be positive")
    share = percent / 100
    rows = cut(numbered(df.filter(F.col(x).isNotNull()).select("symbol", "ts", F.col(x).cast("double").alias("x"))))
    base = rows.select("symbol", F.col("k").alias("id"), (F.col("k") + 1).alias("start"), F.col("x").alias("level"))
    price = F.col("x")
    up = first_passage(base, rows, price, "_more", above=True, strict=True)
    up = first_passage(up.withColumn("level", F.col("level") * (1 - share)), rows, price, "_turn").select("symbol", "id", F.col("_more").alias("up_more"), F.col("_turn").alias("up_turn"))
    down = first_passage(base, rows, price, "_more", strict=True)
    down = first_passage(down.withColumn("level", F.col("level") * (1 + share)), rows, price, "_turn", above=True).select("symbol", "id", F.col("_more").alias("down_more"), F.col("_turn").alias("down_turn"))
    both = cut(up.join(down, ["symbol", "id"]))
    # states: 2k is the top of an upswing at bar k, 2k + 1 the bottom of a downswing
    state = lambda k, low: k * 2 + low
    after = lambda more, turn, low: F.when(F.coalesce(F.col(more) < F.col(turn), F.col(more).isNotNull()), state(F.col(more), low)).otherwise(state(F.col(turn), 1 - low))
    tops = both.select("symbol", state(F.col("id"), 0).alias("k"), after("up_more", "up_turn", 0).alias("next"))
    bottoms = both.select("symbol", state(F.col("id"), 1).alias("k"), after("down_more", "down_turn", 1).alias("next"))
    pointers = cut(tops.union(bottoms))
    fall, rise = F.col("up_turn"), F.col("down_turn")
    first = both.filter("id = 0").select("symbol", F.when(F.coalesce(rise < fall, rise.isNotNull()), state(rise, 0)).otherwise(state(fall, 1)).alias("k")).filter("k is not null")
    seen = reached(pointers, first)
    # an extreme is passed on within a swing, and stands where the next state turns or there is none
    stand = seen.join(pointers, ["symbol", "k"], "left").filter(F.col("next").isNull() | (F.col("next") % 2 != F.col("k") % 2))
    kind = F.when(F.col("next").isNull(), "open").when(F.col("k") % 2 == 0, "high").otherwise("low")
    ends = stand.select("symbol", F.floor(F.col("k") / 2).alias("k"), kind.alias("kind"))
    marks = ends.union(rows.filter("k = 0").select("symbol", "k", F.lit("first")))
    return rows.join(marks, ["symbol", "k"], "left").select("symbol", "ts", F.when(F.col("kind").isNotNull(), F.col("x")).alias("pivot"), "kind")


def order_blocks(df: DataFrame, n: int = 5) -> DataFrame:
    """(symbol, ts, direction, block_ts, top, bottom, touched_ts): the last opposite bar before each break of a level, and how long it holds.

    A level is the last confirmed pivot; a close beyond it breaks it, once, until the next pivot is confirmed. The block is the
    last bar against the break since the level was confirmed; breaks without one give none. A bar that breaks
    upwards does not break downwards too. The block is born with the break and ends when a later bar first reaches into it
    (`touched_ts`, NULL while it stands).
    """
    from tidemill.functions.structure import pivots

    rows = numbered(pivots(df, n))
    back = lambda c: F.lag(c, n).over(series())
    rows = rows.withColumns({"_high": back(F.when(F.col("pivot_high"), F.col("high"))), "_low": back(F.when(F.col("pivot_low"), F.col("low")))})
    so_far = Window.partitionBy("symbol").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({"_red": F.last(F.when(F.col("close") < F.col("open"), F.col("k")), True).over(so_far), "_green": F.last(F.when(F.col("close") > F.col("open"), F.col("k")), True).over(so_far)})
    rows = cut(rows.select("symbol", "ts", "k", "high", "low", "close", "_high", "_low", "_red", "_green"))
    order = Window.partitionBy("symbol").orderBy("start")

    def broken(bars: DataFrame, level: str, above: bool) -> DataFrame:
        """Levels with the bar that breaks them before the next level takes their place."""
        levels = rows.filter(F.col(level).isNotNull()).select("symbol", F.col("k").alias("id"), F.col("k").alias("start"), F.col(level).alias("level")).withColumn("_until", F.lead("start").over(order))
        found = first_passage(levels, bars, F.col("close"), "k", above=above, strict=True)
        return found.filter(F.col("k").isNotNull() & F.coalesce(F.col("k") < F.col("_until"), F.lit(True)))

    ups = cut(broken(rows, "_high", True))
    free = rows.join(ups.select("symbol", "k", F.lit(True).alias("_broke")), ["symbol", "k"], "left").withColumn("close", F.when(F.col("_broke").isNull(), F.col("close")))
    downs = broken(free, "_low", False)

    def blocks(found: DataFrame, opposite: str, direction: str, above: bool) -> DataFrame:
        at = found.join(rows.select("symbol", "k", "ts", opposite), ["symbol", "k"]).filter(F.col(opposite) > F.col("start"))
        bar = rows.select("symbol", F.col("k").alias(opposite), F.col("ts").alias("block_ts"), F.col("high").alias("top"), F.col("low").alias("bottom"))
        born = at.join(bar, ["symbol", opposite]).select("symbol", F.col("k").alias("id"), (F.col("k") + 1).alias("start"), "ts", "block_ts", "top", "bottom", F.col("bottom" if above else "top").alias("level"))
        ended = first_passage(cut(born), rows, F.col("high" if above else "low"), "_touch", above=above)
        return ended.select("symbol", "ts", F.lit(direction).alias("direction"), "block_ts", "top", "bottom", F.col("_touch"))

    every = blocks(ups, "_red", "up", False).union(blocks(downs, "_green", "down", True))
    touched = rows.select("symbol", F.col("k").alias("_touch"), F.col("ts").alias("touched_ts"))
    return every.join(touched, ["symbol", "_touch"], "left").select("symbol", "ts", "direction", "block_ts", "top", "bottom", "touched_ts")
