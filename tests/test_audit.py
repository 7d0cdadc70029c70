"""Intervals, look-ahead probes and the choice of unlike factors against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from tidemill.functions import indicators, windows
from tidemill.operators import factors, intervals, probe, unlike
from tidemill.sources.bars import bars, panel


def at(c):
    return F.timestamp_micros(F.col(c)).alias(c)


def spans(spark, seed=1):
    rng = random.Random(seed)
    points = [(rng.choice("abc"), rng.randint(-50, 400) * 1_000_000) for _ in range(120)] + [("a", None), (None, 5)]
    points += points[:3]
    held = []
    for _ in range(60):
        s = rng.randint(-60, 400) * 1_000_000
        held.append((rng.choice("ab"), s, s + rng.choice([0, 1, 3, 10, 300]) * 1_000_000))
    held += [("c", -10**12, 10**12), ("a", 10, None), ("b", None, -20_000_000), (None, 0, 10**9), ("a", None, None)][: 3 + seed]
    p = spark.createDataFrame(points, "symbol string, ts long").select("symbol", at("ts"), F.col("ts").alias("t"))
    i = spark.createDataFrame(held, "symbol string, start long, end long").select("symbol", at("start"), at("end"), F.col("start").alias("s"), F.col("end").alias("e"))
    return points, held, p, i


@pytest.mark.parametrize("piece", [7.0, 1e6])
def test_inside_equals_a_loop(spark, piece):
    points, held, p, i = spans(spark)
    for bar in (0.0, 4.0):
        def yes(key, t, width=int(bar * 1e6)):
            return key is not None and t is not None and any(k == key and (s is None or s <= t) and (e is None or (t + width <= e if width else t < e)) for k, s, e in held)

        got = sorted(((r.symbol, r.t, r.inside) for r in intervals.inside(p, i, bar=bar, piece=piece).collect()), key=str)
        assert got == sorted(((k, t, yes(k, t)) for k, t in points), key=str)
    assert intervals.inside(p, i.limit(0)).filter("inside").isEmpty() and intervals.inside(p.limit(0), i).count() == 0


@pytest.mark.parametrize("piece", [1.0, 30.0])
def test_pairs_equal_a_loop(spark, piece):
    """An interval of years among short ones, empty ones and ones that end where they begin."""
    points, held, p, i = spans(spark, seed=0)
    held = [h for h in held if None not in h]
    got = sorted((r.symbol, r.t, r.s, r.e) for r in intervals.interval_join(p, i, piece=piece).filter("e is not null").collect())
    want = sorted((k, t, s, e) for k, t in points for o, s, e in held if k is not None and t is not None and k == o and s <= t < e)
    assert got == want and len(want) > 100
    assert intervals.interval_join(p, i.limit(0)).count() == 0


def test_cells(spark):
    grid = spark.createDataFrame([("a", k * 10 * 1_000_000) for k in range(4)], "symbol string, ts long").select("symbol", at("ts"))
    events = spark.createDataFrame([("a", 1_000_000, 2.0), ("a", 9_000_000, 3.0), ("a", 25_000_000, None), ("b", 1_000_000, 9.0)], "symbol string, ts long, x double").select("symbol", at("ts"), "x")
    covered = spark.createDataFrame([("a", 0, 30_000_000)], "symbol string, start long, end long").select("symbol", at("start"), at("end"))
    assert [r.total for r in intervals.cells(grid, events, covered, "x", 10).orderBy("ts").collect()] == [5.0, 0.0, None, None]


def test_probe_catches_what_looks_ahead(spark, small_dir):
    df = bars(spark, small_dir, "4h").select("symbol", F.col("ts").cast("timestamp").alias("ts"), "open", "high", "low", "close", "volume").cache()
    w, mean = windows.series(), F.avg("close")
    plans = {
        "ahead": F.lead("close").over(w), "whole": mean.over(w.rowsBetween(-10**6, 10**6)), "centred": mean.over(w.rowsBetween(-1, 1)),
        "back": F.lag("close").over(w), "mean": mean.over(w.rowsBetween(-4, 0)),
    }
    found = {r.column: r for r in probe.prefix_invariance(df, lambda d: d.withColumns(plans), list(plans)).collect()}
    assert {k for k, r in found.items() if r.same} == {"back", "mean"} and all(r.compared > 100 for r in found.values())
    assert found["ahead"].first_cut is not None and found["back"].first_cut is None


def test_indicators_keep_their_past(spark, small_dir):
    """Means, bands, recurrences and ranks across symbols: no shorter input changes a past value."""
    df = bars(spark, small_dir, "4h").select("symbol", F.col("ts").cast("timestamp").alias("ts"), "open", "high", "low", "close", "volume")

    def plan(d):
        d = indicators.aroon(d).withColumns({"sma": indicators.sma("close", 5), "williams": indicators.williams(), "change": windows.change("close", 3)})
        return d

    columns = ["aroon_up", "aroon_down", "sma", "williams", "change"]
    assert probe.prefix_invariance(df, plan, columns).filter("not same").isEmpty()
    across = panel(spark, small_dir).select("symbol", "ts", "close", "volume")
    ranks = lambda d: d.withColumns({"rank": factors.pct_rank("close"), "z": factors.standardised("volume")})
    found = probe.prefix_invariance(across, ranks, ["rank", "z"], across=True).collect()
    assert all(r.same and r.compared > 100 for r in found)
    with pytest.raises(ValueError):
        probe.prefix_invariance(df.limit(0), plan, columns)


def test_cuts_leave_no_shuffles_and_take_turns(spark, small_dir):
    """However many cuts run at once, the same is found, and no shuffle outlives its turn."""
    import os

    def held():
        return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(spark.conf.get("spark.local.dir")) for f in names if f.startswith("shuffle_") and f.endswith(".data"))

    df = bars(spark, small_dir, "4h").select("symbol", F.col("ts").cast("timestamp").alias("ts"), "close").localCheckpoint()
    plan = lambda d: d.withColumns({"ahead": F.lead("close", 3).over(windows.series()), "mean": windows.mean("close", 5)})
    cuts, runs, left, before = probe.cut_points(df), [], [], held()

    def noted(d):
        left.append(held() - before)
        runs.append(d)
        return plan(d)

    one, two, all_ = (sorted(map(tuple, probe.prefix_invariance(df, noted, ["ahead", "mean"], cuts, at_once=n).collect()), key=str) for n in (1, 2, len(cuts)))
    assert one == two == all_ and [r[4] for r in one] == [False, True] and one[0][3] == cuts[0]
    assert len(runs) == len(cuts) + -(-len(cuts) // 2) + 1 and max(left) <= 0
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_unlike_choice_equals_the_greedy_loop(spark):
    rng = random.Random(5)
    for most in (0.3, 0.6, 0.9):
        names = [f"f{k}" for k in range(14)]
        corr = {(a, b): rng.choice([None, rng.uniform(-1, 1)]) for i, a in enumerate(names) for b in names[:i]}
        strength = {n: rng.choice([None, 0.1, rng.uniform(-0.2, 0.2)]) for n in names}
        order = sorted(names, key=lambda n: (-abs(strength[n] or 0.0), names.index(n)))
        kept, why = [], {}
        for n in order:
            clash = next((k for k in kept if abs(corr.get((n, k), corr.get((k, n))) or 0) > most), None)
            if clash:
                why[n] = clash
            else:
                kept.append(n)
        table = spark.createDataFrame([(a, b, c) for (x, y), c in corr.items() for a, b in ((x, y), (y, x))], "a string, b string, corr double")
        got = {r.factor: (r.kept, r.clash) for r in unlike.choose_unlike(table, strength, most).collect()}
        assert got == {n: (n in kept, why.get(n)) for n in names}
    assert [tuple(r) for r in unlike.choose_unlike(table, {"f0": 0.1}).collect()] == [("f0", True, None, None)]
