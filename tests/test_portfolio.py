"""Weights, coefficients, trials: properties and numpy versions."""

import numpy as np
import pytest

from tidemill.operators import evaluation, portfolio


def book(spark, rows, **more):
    df = spark.createDataFrame([(f"S{k}", 0, v) for k, v in enumerate(rows)], "symbol string, ts int, x double")
    return {r.symbol: r.weight for r in portfolio.capped_weights(df, "x", **more).collect()}


@pytest.mark.parametrize("cap", [0.1, 0.35])
def test_weights_meet_cap_gross_and_neutrality(spark, cap):
    rng = np.random.default_rng(int(cap * 100))
    for n in (5, 30):
        scores = rng.standard_t(2, n)
        found = book(spark, scores.tolist(), cap=cap)
        w = np.array([found[f"S{k}"] for k in range(n)])
        side = scores - scores.mean()
        reach = min(0.5, *[cap * (side * s > 1e-12).sum() for s in (1, -1)])
        assert abs(w.sum()) < 1e-9 and np.abs(w).max() <= cap + 1e-9 and abs(np.abs(w).sum() - 2 * reach) < 1e-9
        assert (w * side >= 0).all()
        ups = np.sort(w[w > 0])[::-1]
        assert np.allclose(np.argsort(-side[side > 0], kind="stable"), np.argsort(-w[side > 0], kind="stable")) or ups[0] == pytest.approx(cap)


def test_weights_of_odd_instants(spark):
    assert book(spark, [1.0, 2.0, None, 3.0, 4.0]) == {f"S{k}": 0.0 for k in range(5)}  # four scored names are too few
    assert set(book(spark, [2.0] * 6).values()) == {0.0}
    long_only = book(spark, [1.0, 1.0, 2.0, -4.0, 0.0], neutral=False, cap=None)
    assert long_only == {"S0": 0.125, "S1": 0.125, "S2": 0.25, "S3": -0.5, "S4": 0.0}
    with pytest.raises(ValueError):
        book(spark, [1.0], cap=0.0)


def test_neutralised_equals_least_squares(spark):
    """Also with a regressor that is a sum of others, a constant one, missing values and too few rows."""
    rng = np.random.default_rng(3)
    rows = []
    for ts, n in enumerate((40, 12, 6, 5, 3)):
        a, b = rng.normal(size=n), rng.normal(size=n)
        y = 2 * a - b + rng.normal(size=n)
        y[1], b[2] = np.nan, np.nan
        rows += [(f"S{k}", ts, None if np.isnan(y[k]) else float(y[k]), float(a[k]), None if np.isnan(b[k]) else float(b[k]), float(a[k] + b[k]) if not np.isnan(b[k]) else None, 7.0) for k in range(n)]
    df = spark.createDataFrame(rows, "symbol string, ts int, y double, a double, b double, ab double, one double")
    for xs in (["a"], ["a", "b"], ["a", "b", "ab", "one"], ["one", "ab", "a"]):
        got = {(r.symbol, r.ts): r.residual for r in portfolio.neutralised(df, "y", xs).collect()}
        for ts in range(5):
            own = [r for r in rows if r[1] == ts]
            table = np.array([[np.nan if r[2] is None else r[2], *[np.nan if v is None else v for v in ({"a": r[3], "b": r[4], "ab": r[5], "one": r[6]}[x] for x in xs)]] for r in own], float)
            ok = ~np.isnan(table).any(1)
            if ok.sum() < 5 or ok.sum() <= len(xs) + 1:
                assert all(got[r[0], ts] is None for r in own)
                continue
            A = np.column_stack([np.ones(ok.sum()), table[ok, 1:]])
            left = table[ok, 0] - A @ np.linalg.lstsq(A, table[ok, 0], rcond=None)[0]
            assert np.allclose([got[r[0], ts] for r, k in zip(own, ok, strict=True) if k], left, atol=1e-9)
            assert all(got[r[0], ts] is None for r, k in zip(own, ok, strict=True) if not k)


def test_ridge_equals_numpy(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(20, 15, 3))
    y = x @ [0.5, -0.2, 0.0] + rng.normal(size=(20, 15))
    df = spark.createDataFrame([(f"S{k}", t, *map(float, x[t, k]), float(y[t, k])) for t in range(20) for k in range(15)], "symbol string, ts int, a double, b double, c double, y double")
    z = ((x - x.mean(1, keepdims=True)) / x.std(1, ddof=1, keepdims=True)).reshape(-1, 3)
    want = np.linalg.solve(z.T @ z + np.eye(3), z.T @ y.reshape(-1))
    got = portfolio.pooled_ridge(df, ["a", "b", "c"], "y")
    assert np.allclose([got[k] for k in "abc"], want)
    betas = portfolio.fit_betas(df, ["a", "b", "c"], "y", "ridge", 0.5)
    assert sum(map(abs, betas.values())) == pytest.approx(1) and betas["a"] > 0 > betas["b"]


def ledger(spark, returns):
    rows = [(f"T{k}", t, float(v)) for k, own in enumerate(returns) for t, v in enumerate(own) if v is not None]
    return spark.createDataFrame(rows, "trial string, t long, ret double").selectExpr("trial", "timestamp_seconds(t * 86400) AS ts", "ret")


def test_effective_trials(spark):
    """Copies count once; blocks and chunks of any size give the participation ratio of the eigenvalues."""
    rng = np.random.default_rng(7)
    own = rng.normal(size=(6, 50))
    returns = np.concatenate([own, own[:1], own[:1] * 2 + 1, own[1:2] + 0.5 * own[2:3], np.full((1, 50), 0.3)])
    corr = np.nan_to_num(np.corrcoef(returns[:-1]))
    lam = np.linalg.eigvalsh(corr)
    want = lam.sum() ** 2 / (lam**2).sum()
    for block, chunk in ((256, 512), (3, 7)):
        got = evaluation.effective_trials(ledger(spark, returns), block, chunk).first()
        assert got.n_trials == 10 and got.effective == pytest.approx(want)
    one = evaluation.effective_trials(ledger(spark, np.repeat(own[:1], 5, 0))).first()
    assert one.n_trials == 5 and one.effective == pytest.approx(1)


def test_effective_trials_by_pairs_of_instants(spark):
    """More trials than instants: missing returns, constants and trials so faint that only some correlations count; blocks of any size."""
    rng = np.random.default_rng(8)
    own = rng.normal(size=(40, 23)) * 0.02 + rng.normal(size=(1, 23)) * 0.01
    own[3, 5:9] = own[4, ::2] = np.nan
    own[:, 11] = np.nan  # an instant without a return
    own[6], own[7] = own[5], 0.0
    own[8], own[9] = own[0] * 3e-12, own[1] * 1e-7  # far from both borders
    own[10] *= 1e4
    dense = np.nan_to_num(own)
    m = dense - dense.mean(1, keepdims=True)
    d = np.sqrt((m * m).sum(1))
    scale = np.outer(d, d)
    corr = np.divide(m @ m.T, scale, out=np.zeros_like(scale), where=scale > 1e-14)
    want = (d > 1e-14).sum() ** 2 / (corr**2).sum()
    rows = [[None if np.isnan(v) else v for v in r] for r in own]
    table = ledger(spark, rows).union(spark.sql("SELECT 'T0', timestamp_seconds(11 * 86400), CAST(NULL AS double)"))
    for instants in (512, 7):
        got = evaluation.effective_trials(table, 6, 5, instants).first()
        assert got.n_trials == 40 and got.effective == pytest.approx(want)


def test_trials_are_not_sent_once_for_each_block(spark):
    """What leaves the trials is sums by instants, however many trials there are."""
    returns = np.random.default_rng(9).normal(size=(70, 12))
    one, many = (evaluation.effective_trials(ledger(spark, returns), block)._jdf.queryExecution().executedPlan().toString() for block in (256, 2))
    assert "explode" not in many and one.count("Exchange") == many.count("Exchange")


def lattice_scores(spark, grid):
    rows = [(a * 10 + b, [a, b], None if np.isnan(v) else float(v)) for (a, b), v in np.ndenumerate(grid)]
    df = spark.createDataFrame(rows, "trial int, place array<int>, score double")
    return df.select("trial", "score"), df.select("trial", "place")


def test_plateau_demotes_a_lone_peak_and_corners(spark):
    grid = np.zeros((6, 6))
    grid[0, 0] = 5.0  # a peak in a corner
    grid[3:6, 3:6] = 2.0
    scores, points = lattice_scores(spark, grid)
    assert evaluation.best_trials(scores).first().trial == 0
    best = evaluation.best_trials(scores, 1, points, 2).first()
    assert best.trial == 44 and best.score == 2.0
    grid[1, 0] = grid[0, 1] = np.nan  # of three neighbours one is known: less than half
    found = {r.trial: r for r in evaluation.smoothed(*lattice_scores(spark, grid), 2).collect()}
    assert 0 not in found and found[55].neighbours == 3


def test_walk_forward_counts_whole_windows_and_leaves_the_embargo_out(spark):
    rng = np.random.default_rng(2)
    returns = rng.normal(0, 0.01, (3, 100))
    returns[0, :40] += 0.05
    returns[1, 40:] += 0.05
    got = evaluation.walked_forward(ledger(spark, returns), 40, 20, 10).orderBy("window").collect()
    assert [(r.window, r.trial, r.n) for r in got] == [(0, "T0", 20), (1, "T0", 20)][: len(got)] and len(got) == 2
    assert got[0].total == pytest.approx(returns[0, 50:70].sum()) and got[0].score is None  # 20 instants are too few for a score
    two = evaluation.walked_forward(ledger(spark, returns), 40, 20, 10, top=2).orderBy("window").collect()
    assert two[0].n_picked == 2
    assert evaluation.walked_forward(ledger(spark, returns[:, :60]), 40, 20, 10).count() == 0
