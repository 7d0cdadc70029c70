"""First passages, trades, swings and order blocks against plain walks, with groups of few bars so that trees are deep."""

import random

import pytest
from pyspark.sql import functions as F

from tidemill.operators import passage

BARS = "symbol string, ts timestamp, open double, high double, low double, close double, enter boolean, leave boolean"


def made(seed, n, symbols=("A", "B")):
    """Bars of unlike numbers for each symbol, with ties of prices and clusters of signals."""
    rng, out = random.Random(seed), {}
    for s, many in zip(symbols, (n, n // 3), strict=True):
        price, rows = 100.0, []
        for k in range(many):
            o = price
            c = round(max(1.0, o * (1 + rng.gauss(0, 0.03))), 1)
            rows.append((s, k * 3600, o, round(max(o, c) * (1 + rng.random() * 0.02), 1), round(min(o, c) * (1 - rng.random() * 0.02), 1), c, rng.random() < 0.25, rng.random() < 0.05))
            price = c
        out[s] = rows
    return out


def frame(spark, bars):
    rows = [r for own in bars.values() for r in own]
    return spark.createDataFrame(rows, BARS.replace("ts timestamp", "ts long")).withColumn("ts", F.timestamp_seconds("ts")).repartition(3)


@pytest.fixture(autouse=True)
def small_groups(monkeypatch):
    monkeypatch.setattr(passage, "FAN", 4)
    for name in ("first_passage", "_peaks"):
        monkeypatch.setattr(getattr(passage, name), "__defaults__", tuple(4 if d == 64 else d for d in getattr(passage, name).__defaults__))


@pytest.mark.parametrize(("above", "strict"), [(False, False), (True, False), (False, True), (True, True)])
def test_first_passage(spark, above, strict):
    rng = random.Random(4)
    values = {"A": [rng.choice([None, *range(12)]) for _ in range(70)], "B": [5], "C": [None, None]}
    bars = spark.createDataFrame([(s, k, None if v is None else float(v)) for s, own in values.items() for k, v in enumerate(own)], "symbol string, k long, v double")
    starts = [(s, i, rng.randint(0, 75), float(rng.randint(-1, 13))) for s in values for i in range(60)] + [("A", 99, None, 1.0), ("A", 98, 3, None), ("none", 0, 0, 5.0)]
    got = {(r.symbol, r.id): r.hit for r in passage.first_passage(spark.createDataFrame(starts, "symbol string, id long, start long, level double"), bars, F.col("v"), "hit", above=above, strict=strict).collect()}
    beyond = lambda v, x: (v > x if strict else v >= x) if above else (v < x if strict else v <= x)
    for s, i, start, level in starts:
        own = values.get(s, [])
        want = None if start is None or level is None else next((k for k in range(start, len(own)) if own[k] is not None and beyond(own[k], level)), None)
        assert got[s, i] == want
    assert len(got) == len(starts)


def walked(rows, stop, target, longest, trailing, short):
    """Trades of one symbol, bar by bar."""
    out, k, up = [], 0, -1 if short else 1
    while k < len(rows) - 1:
        if not rows[k][6]:
            k += 1
            continue
        at = k + 1
        price = best = rows[at][2]
        for j in range(at, len(rows)):
            _, ts, o, h, low, c, _, _ = rows[j]
            good, bad = (low, h) if short else (h, low)
            best = min(best, good) if short else max(best, good)
            level = lambda p, share: p * (1 - up * share)
            passed = lambda x, y: x >= y if short else x <= y
            worse, better = (max, min) if short else (min, max)
            if j > at and rows[j - 1][7]:
                got, why = o, "signal"
            elif longest is not None and j - at >= longest:
                got, why = o, "time"
            elif stop is not None and passed(bad, level(price, stop)):
                got, why = worse(o, level(price, stop)), "stop"
            elif trailing is not None and passed(bad, level(best, trailing)):
                got, why = worse(o, level(best, trailing)), "trailing"
            elif target is not None and passed(price * (1 + up * target), good):
                got, why = better(o, price * (1 + up * target)), "target"
            elif j == len(rows) - 1:
                got, why = c, "end"
            else:
                continue
            out.append((rows[at][0], rows[at][1], ts, round(price, 6), round(got, 6), why))
            break
        k = j
    return out


@pytest.mark.parametrize(("stop", "target", "longest", "trailing", "short"), [(0.05, 0.1, 24, None, False), (0.08, None, None, 0.07, False), (0.06, 0.09, 30, 0.08, True)])
def test_trades_equal_a_walk(spark, stop, target, longest, trailing, short):
    bars = made(7, 200)
    got = passage.trades(frame(spark, bars), stop, target, longest, trailing, short).collect()
    want = [t for rows in bars.values() for t in walked(rows, stop, target, longest, trailing, short)]
    assert sorted((r.symbol, int(r.entry_ts.timestamp()), int(r.exit_ts.timestamp()), round(r.entry, 6), round(r.exit, 6), r.reason) for r in got) == sorted(want)
    reasons = {t[5] for t in want}
    assert {n for n, v in (("stop", stop), ("target", target), ("trailing", trailing)) if v} <= reasons


def test_trades_of_odd_bars(spark):
    bars = {"A": [("A", 0, 1.0, 1.0, 1.0, 1.0, True, None)], "B": [("B", 0, 1.0, 1.0, 1.0, 1.0, None, None), ("B", 3600, 1.0, 1.0, 1.0, 1.0, True, True)]}
    assert passage.trades(frame(spark, bars)).count() == 0 and passage.trades(frame(spark, {})).count() == 0


def swings(prices, percent):
    """(kind by place) of a plain walk."""
    marks, place, price, way = {0: "first"}, 0, prices[0], 0
    for k, x in enumerate(prices[1:], 1):
        if way >= 0 and x <= price * (1 - percent / 100):
            if way:
                marks[place] = "high"
            place, price, way = k, x, -1
        elif way <= 0 and x >= price * (1 + percent / 100):
            if way:
                marks[place] = "low"
            place, price, way = k, x, 1
        elif way * (x - price) > 0:
            place, price = k, x
    if way:
        marks[place] = "open"
    return marks


@pytest.mark.parametrize("percent", [8.0, 90.0])
def test_zigzag_equals_a_walk(spark, percent):
    bars = made(3, 200)
    got = passage.zigzag(frame(spark, bars), "close", percent).collect()
    for s, rows in bars.items():
        own = sorted((r for r in got if r.symbol == s), key=lambda r: r.ts)
        want = swings([r[5] for r in rows], percent)
        assert {k: r.kind for k, r in enumerate(own) if r.kind} == want
        assert all((r.pivot is None) == (r.kind is None) and r.pivot in (None, rows[k][5]) for k, r in enumerate(own))


def walked_blocks(rows, n):
    high, low = [r[3] for r in rows], [r[4] for r in rows]
    tops = {k + n: high[k] for k in range(n, len(rows) - n) if high[k] > max(high[k - n : k]) and high[k] >= max(high[k + 1 : k + n + 1])}
    bottoms = {k + n: low[k] for k in range(n, len(rows) - n) if low[k] < min(low[k - n : k]) and low[k] <= min(low[k + 1 : k + n + 1])}
    out, up, down = [], None, None
    for k, r in enumerate(rows):
        up, down = (k, tops[k]) if k in tops else up, (k, bottoms[k]) if k in bottoms else down
        for way, level, against, reaches in (("up", up, lambda x: x[5] < x[2], lambda x, b: x[4] <= b[3]), ("down", down, lambda x: x[5] > x[2], lambda x, b: x[3] >= b[4])):
            if level and (r[5] > level[1] if way == "up" else r[5] < level[1]):
                block = next((rows[j] for j in range(k - 1, level[0], -1) if against(rows[j])), None)
                if block:
                    out.append((r[0], r[1], way, block[1], block[3], block[4], next((x[1] for x in rows[k + 1 :] if reaches(x, block)), None)))
                up, down = (None, down) if way == "up" else (up, None)
                break
    return out


def test_order_blocks_equal_a_walk(spark):
    bars = made(12, 260)
    at = lambda t: None if t is None else int(t.timestamp())
    got = [(r.symbol, at(r.ts), r.direction, at(r.block_ts), r.top, r.bottom, at(r.touched_ts)) for r in passage.order_blocks(frame(spark, bars), 2).collect()]
    want = [b for rows in bars.values() for b in walked_blocks(rows, 2)]
    assert sorted(got, key=str) == sorted(want, key=str) and len(want) > 10 and {b[2] for b in want} == {"up", "down"}
