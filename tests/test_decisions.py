"""Conditions, evaluation and limits against plain Python, and what they do with odd inputs."""

import math
from statistics import NormalDist

import pytest
from pyspark.sql import functions as F

from tidemill.functions import states
from tidemill.operators import combine, evaluation, risk


@pytest.fixture(scope="module")
def ledger(spark):
    import random

    random.seed(3)
    rows = [(f"t{k}", t, None if random.random() < 0.02 else random.gauss(0.0005 * k, 0.01)) for k in range(6) for t in range(170)]
    return spark.createDataFrame(rows, "trial string, ts long, ret double").cache()


def test_votes_are_no_directions(spark):
    df = spark.createDataFrame([(1, True), (0, True), (None, True), (1, None)], "a int, b boolean")
    assert [r.x for r in df.select(states.aligned("a", "b").alias("x")).collect()] == [True, False, False, False]
    with pytest.raises(Exception, match="not a direction"):
        spark.createDataFrame([(-1, True)], "a int, b boolean").select(states.aligned("a", "b")).collect()
    with pytest.raises(Exception, match="plain ratio"):
        spark.createDataFrame([(5.0,)], "f double").select(states.funding_state("f")).collect()


def test_run_length(spark):
    flags = [True, True, None, True, False, True, True, True]
    df = spark.createDataFrame([("s", k, f) for k, f in enumerate(flags)], "symbol string, ts int, up boolean")
    assert [r.run for r in states.run_length(df, F.col("up")).orderBy("ts").collect()] == [1, 2, 0, 1, 0, 1, 2, 3]


def test_verdicts_of_nothing(spark):
    none = F.array().cast("array<struct<name:string,direction:string,strength:double,value:double>>")
    row = spark.range(1).select(combine.added(none).alias("a"), combine.majority(none).alias("m"), combine.in_sequence(none, 1).alias("s"), combine.capped(F.lit(9.0), [F.lit(None).cast("boolean")]).alias("v"), combine.classified(F.lit(-1.0)).alias("w")).first()
    assert tuple(row) == (0.0, 0.0, 0.0, "WATCHLIST", "AVOID")


def test_limits_without_a_balance(spark):
    row = spark.range(1).select(
        risk.exposure(F.lit(1.0), F.lit(1.0), F.lit(0.0)).alias("e"), risk.daily_loss(F.lit(-5.0), F.lit(0.0), most=4.0).alias("l"), risk.liquidation(F.lit(0.0), F.lit(1.0), F.lit(True), F.lit(2)).alias("q"),
        risk.trailing_stop(F.lit(100.0), F.lit(True), 5.0, F.lit(0.0)).alias("t"), risk.trailing_stop(F.lit(100.0), F.lit(False), 5.0, F.lit(101.0)).alias("u"),
    ).first()
    assert (row.e.percent, row.e.allowed, row.l.breached, row.q.price, row.q.danger, row.t, row.u) == (None, False, True, None, False, 95.0, 101.0)


def test_bars_stop(spark):
    df = spark.createDataFrame([("s", t, 10.0 + t, 5.0 - t) for t in range(4)], "symbol string, ts int, high double, low double")
    got = df.select("ts", risk.bars_stop(F.lit(True), 3, F.lit(0.0)).alias("long"), risk.bars_stop(F.lit(False), 3, F.lit(12.5)).alias("short")).orderBy("ts").collect()
    assert [(r.long, r.short) for r in got] == [(0.0, 12.5), (0.0, 12.5), (3.0, 12.0), (2.0, 12.5)]


def plain_sharpe(values):
    values = [v for v in values if v is not None]
    if len(values) < 30:
        return None
    m = sum(values) / len(values)
    s = math.sqrt(sum((v - m) ** 2 for v in values) / (len(values) - 1))
    return m / s * math.sqrt(365) if s > 0 else None


def test_splits_equal_a_plain_search(ledger):
    from itertools import combinations

    by = {}
    for r in ledger.orderBy("ts").collect():
        by.setdefault(r.trial, []).append(r.ret)
    size, more = divmod(170, 4)
    ends = [0]
    for b in range(4):
        ends.append(ends[-1] + size + (b < more))
    want = {}
    for own in combinations(range(4), 2):
        pick = lambda rows, blocks: [v for b in blocks for v in rows[ends[b] : ends[b + 1]]]
        rest = [b for b in range(4) if b not in own]
        inside, outside = ({t: plain_sharpe(pick(rows, x)) for t, rows in by.items()} for x in (own, rest))
        best = max(sorted(inside), key=lambda t: inside[t])
        want[sum(1 << b for b in own)] = (best, sum(v <= outside[best] for v in outside.values()) / 7)
    got = {r.split: (r.trial, round(r.share, 9)) for r in evaluation.splits_of(ledger, 4).collect()}
    assert got == {k: (t, round(s, 9)) for k, (t, s) in want.items()}
    with pytest.raises(ValueError, match="even"):
        evaluation.splits_of(ledger, 3)


def test_deflated_probability(ledger):
    for r in evaluation.deflated(ledger, 6, 0.02).collect():
        assert abs(r.probability - NormalDist().cdf(r.z)) < 1e-12
    assert evaluation.best_of_luck(1, 1.0) == evaluation.best_of_luck(2, 1.0) < evaluation.best_of_luck(100, 1.0)


def test_scores_of_too_few_days(spark):
    short = spark.createDataFrame([("a", k, 0.01 * k) for k in range(5)], "trial string, ts long, ret double")
    row = evaluation.trial_scores(short).first()
    assert (row.n, row.sharpe, row.yearly, row.calmar) == (5, None, None, None)
    assert evaluation.deflated(short, 5, 0.1).first().z is None
    with pytest.raises(ValueError, match="two whole blocks"):
        evaluation.bootstrap_mean(short, "ret", length=3)


def test_bootstrap_repeats_itself(spark):
    days = spark.createDataFrame([(k, None if k % 9 == 0 else float(k % 7)) for k in range(60)], "ts long, x double")
    one, two = (evaluation.bootstrap_mean(days, "x", 50, seed=4).first() for _ in range(2))
    assert one == two and one.low <= one.mean <= one.high and (one.n, one.draws) == (53, 50)


def test_walked_forward_covers_what_follows(ledger):
    got = evaluation.walked_forward(ledger, 60, 30, embargo=0).orderBy("window").collect()
    instants = ledger.select("ts").distinct().count()
    assert [r.window for r in got] == list(range((instants - 90) // 30 + 1)) and all(r.n <= 30 for r in got)  # whole windows only
    by = {}
    for r in ledger.orderBy("ts").collect():
        by.setdefault(r.trial, []).append(r.ret)
    best = max(sorted(by), key=lambda t: plain_sharpe(by[t][30:90]))
    rest = [v for v in by[best][90:120] if v is not None]
    assert got[1].trial == best and abs(got[1].total - sum(rest)) < 1e-9
    later = evaluation.walked_forward(ledger, 60, 30, embargo=7).filter("window = 1").first()
    rest = [v for v in by[best][97:127] if v is not None]
    assert later.trial == best and later.n == len(rest) and abs(later.total - sum(rest)) < 1e-9


def test_grid_puts_left_out_instants_back(spark):
    series = spark.sql("SELECT timestamp_seconds(k * 10) AS ts, x FROM VALUES (0, 1.0D), (1, NULL), (4, 5.0D) AS t(k, x)")
    assert [(int(r.ts.timestamp()), r.x) for r in evaluation.on_grid(series, 10).orderBy("ts").collect()] == [(0, 1.0), (10, None), (20, None), (30, None), (40, 5.0)]
    assert evaluation.on_grid(series.limit(0), 10).count() == 0
    found = evaluation.bootstrap_mean(series, "x", 40, 2, step=10).first()
    assert found.n == 2 and found.mean == 3.0 and 1.0 <= found.low <= found.high <= 5.0


def test_pooled_interval_holds_the_relation(spark):
    rows = [(f"S{k}", t, float((k * 7 + t * 3) % 11), float((k * 7 + t * 3) % 11) * 2 + (k + t) % 5) for t in range(30) for k in range(6)]
    df = spark.createDataFrame(rows + [("S9", 30, None, 1.0)], "symbol string, t long, x double, y double").selectExpr("symbol", "timestamp_seconds(t * 86400) AS ts", "x", "y")
    r = evaluation.pooled_interval(df, "x", "y", 60, 4, step=86400).first()
    plain = evaluation.pooled_relation(df, "x", "y").first()
    assert (r.corr, r.slope, r.n_instants, r.n_pairs) == (plain.corr, plain.slope, 30, 180)
    assert r.corr_low <= r.corr <= r.corr_high and r.slope_low < r.slope < r.slope_high and abs(r.slope - 2) < 0.3


def test_plateau_rule_of_overfitting(ledger):
    """Trials in a row: with plateaus, a split takes a trial whose neighbours are good too."""
    names = sorted(r.trial for r in ledger.select("trial").distinct().collect())
    points = ledger.sparkSession.createDataFrame([(n, [k]) for k, n in enumerate(names)], "trial string, place array<int>")
    plain = {r.split: r.trial for r in evaluation.splits_of(ledger, 4).collect()}
    smooth = {r.split: r.trial for r in evaluation.splits_of(ledger, 4, points, 1).collect()}
    assert set(plain) == set(smooth) and evaluation.overfitting(ledger, 4, points, 1).first().n_splits == len(smooth)
    with pytest.raises(ValueError, match="16"):
        evaluation.splits_of(ledger, 18)
