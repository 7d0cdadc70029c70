"""How far results can be trusted: robust panels, pooled relations, block bootstrap, trial selection and overfitting.

A ledger of trials is a long table (trial, ts, ret). All work on trials goes by sums for each trial and
block of time, so that a ledger is read once however many splits are looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from tidemill.functions.windows import div

#: Days of a year and least number of days for a score. Fixed values.
YEAR, LEAST_DAYS = 365.0, 30
EULER = 0.5772156649015329


def clipped_by_deviation(df: DataFrame, x: str, scale: float = 3.0, out: str | None = None, by: str = "ts") -> DataFrame:
    """Values held within `scale` median absolute deviations of the median of their instant."""
    middle = df.groupBy(F.col(by).alias("_by")).agg(F.median(x).alias("_middle"))
    placed = df.join(middle, F.col(by).eqNullSafe(F.col("_by"))).drop("_by")  # an unknown instant is one too
    spread = placed.groupBy(F.col(by).alias("_by")).agg(F.median(F.abs(F.col(x) - F.col("_middle"))).alias("_spread"))
    low, high = F.col("_middle") - scale * F.col("_spread"), F.col("_middle") + scale * F.col("_spread")
    held = F.when(F.col(x).isNotNull(), F.greatest(low, F.least(F.col(x), high)))
    return placed.join(spread, F.col(by).eqNullSafe(F.col("_by"))).withColumn(out or x, held).drop("_by", "_middle", "_spread")


def moments_of(x: Column, y: Column) -> list[Column]:
    """Means of an instant over its pairs, and their number; NULL without a pair."""
    both = x.isNotNull() & y.isNotNull()
    mean = lambda v, name: F.avg(F.when(both, v)).alias(name)
    return [mean(x, "x"), mean(y, "y"), mean(x * x, "xx"), mean(y * y, "yy"), mean(x * y, "xy"), F.count_if(both).alias("n")]


def pooled() -> tuple[Column, Column]:
    """Correlation and slope from mean moments x, y, xx, yy, xy."""
    cov = F.col("xy") - F.col("x") * F.col("y")
    vx, vy = F.col("xx") - F.col("x") * F.col("x"), F.col("yy") - F.col("y") * F.col("y")
    return F.when((vx > 0) & (vy > 0), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cov / F.sqrt(vx * vy)))), F.when(vx > 0, div(cov, vx))


def pooled_relation(df: DataFrame, signal: str, target: str, by: str = "ts") -> DataFrame:
    """One row: correlation and slope over all pairs, each instant counting once, and the numbers of instants and pairs."""
    moments = df.groupBy(by).agg(*moments_of(F.col(signal), F.col(target))).filter("n > 0")
    m = moments.agg(*[F.avg(k).alias(k) for k in ("x", "y", "xx", "yy", "xy")], F.count("*").alias("n_instants"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_pairs"))
    corr, slope = pooled()
    return m.select(corr.alias("corr"), slope.alias("slope"), "n_instants", "n_pairs")


def on_grid(series: DataFrame, step: float, ts: str = "ts") -> DataFrame:
    """A series (one row per instant) with the instants of a regular grid that it leaves out, as rows of NULLs."""
    size = int(step * 1_000_000)
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    ends = series.agg(F.min(at).alias("a"), F.max(at).alias("b")).filter("a is not null")
    grid = ends.select(F.explode(F.sequence("a", "b", F.lit(size))).alias("_at"))
    joined = grid.join(series.withColumn("_own", at), F.col("_at") == F.col("_own"), "left")
    return joined.select(*[F.timestamp_micros("_at").alias(c) if c == ts else F.col(f"`{c}`") for c in series.columns])


def _draws(series: DataFrame, columns: tuple[str, ...], draws: int, length: int | None, start, seed: int, ts: str) -> tuple[DataFrame, DataFrame]:
    """The numbered series, and (draw, columns...): the mean of each column over the instants of each draw.

    Draws take moving blocks of successive instants, shared by all columns; instants without a value keep their place.
    """
    numbered = series.select(ts, *columns).withColumn("k", F.row_number().over(Window.orderBy(ts)) - 1).drop(ts)  # one row per instant
    n = series.count()
    length = length or max(1, round(-(-(max(n, 1) ** (1 / 3)) // 1)))
    blocks, choices = -(-n // length), n - length + 1
    if n < 2 * length:
        raise ValueError("a bootstrap needs at least two whole blocks")
    pick = start or (lambda d, b, m: F.pmod(F.xxhash64(d, b, F.lit(seed)), m))
    drawn = (
        series.sparkSession.range(draws).select(F.col("id").alias("draw"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
        .withColumn("first", pick(F.col("draw"), F.col("block").cast("long"), F.lit(choices)))
        .select("draw", "block", F.explode(F.sequence(F.lit(0), F.lit(length - 1))).alias("step"), "first")
        .filter(F.col("block") * length + F.col("step") < n).select("draw", (F.col("first") + F.col("step")).alias("k"))
    )
    return numbered, drawn.join(numbered, "k").groupBy("draw").agg(*[F.avg(c).alias(c) for c in columns])


def _interval(x: str, confidence: float, low: str = "low", high: str = "high") -> list[Column]:
    tail = (1 - confidence) / 2
    return [F.percentile(x, F.lit(tail)).alias(low), F.percentile(x, F.lit(1 - tail)).alias(high)]


def bootstrap_mean(series: DataFrame, x: str, draws: int = 200, length: int | None = None, start=None, seed: int = 0, confidence: float = 0.95, ts: str = "ts", step: float | None = None) -> DataFrame:
    """One row: mean, its interval by moving blocks of successive instants, and the numbers used.

    The series has one row per instant; with `step`, instants of a grid of so many seconds that it leaves out are put back first.
    `start(draw, block, choices)` picks the first instant of a block; a hash does so by default.
    """
    series = on_grid(series, step, ts) if step else series
    numbered, means = _draws(series.select(ts, F.col(x).alias("x")), ("x",), draws, length, start, seed, ts)
    ends = means.agg(*_interval("x", confidence), F.count("x").alias("draws"))
    whole = numbered.agg(F.lit(1).alias("_one"), F.avg("x").alias("mean"), F.count("x").alias("n"))
    return whole.join(ends.withColumn("_one", F.lit(1)), "_one").drop("_one")


def pooled_interval(df: DataFrame, signal: str, target: str, draws: int = 200, length: int | None = None, start=None, seed: int = 0, confidence: float = 0.95, step: float | None = None, ts: str = "ts") -> DataFrame:
    """One row: `pooled_relation` with intervals of correlation and slope, by the same blocks of instants for all moments.

    Instants without a pair keep their place in the blocks; with `step`, left-out ones are put back.
    """
    moments = df.groupBy(ts).agg(*moments_of(F.col(signal), F.col(target)))
    moments = on_grid(moments, step, ts) if step else moments
    names = ("x", "y", "xx", "yy", "xy")
    _, means = _draws(moments, names, draws, length, start, seed, ts)
    corr, slope = pooled()
    ends = means.select(corr.alias("c"), slope.alias("s")).agg(*_interval("c", confidence, "corr_low", "corr_high"), *_interval("s", confidence, "slope_low", "slope_high"))
    return pooled_relation(df, signal, target, ts).withColumn("_one", F.lit(1)).join(ends.withColumn("_one", F.lit(1)), "_one").drop("_one")


def sharpe(n: Column, total: Column, squares: Column) -> Column:
    """Yearly Sharpe ratio from the number, sum and sum of squares of daily returns; NULL with too few or without spread."""
    spread = F.sqrt(F.greatest(F.lit(0.0), (squares - total * total / n) / (n - 1)))
    return F.when((n >= LEAST_DAYS) & (spread > 0), total / n / spread * YEAR**0.5)


def trial_scores(ledger: DataFrame) -> DataFrame:
    """Per trial: days, Sharpe ratio, yearly return, deepest fall and their ratio."""
    along = Window.partitionBy("trial").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    grown = ledger.filter("ret is not null").withColumn("_e", F.exp(F.sum(F.log1p("ret")).over(along)))
    fallen = grown.withColumn("_fall", F.col("_e") / F.max("_e").over(along) - 1)
    by = fallen.groupBy("trial").agg(
        F.count("*").alias("n"), F.sum("ret").alias("_s"), F.sum(F.col("ret") * F.col("ret")).alias("_q"), F.exp(F.sum(F.log1p("ret"))).alias("_total"), F.min("_fall").alias("deepest")
    )
    enough = F.col("n") >= LEAST_DAYS
    yearly = F.when(enough, F.pow("_total", YEAR / F.col("n")) - 1)
    return by.select("trial", "n", sharpe(F.col("n"), F.col("_s"), F.col("_q")).alias("sharpe"), yearly.alias("yearly"), "deepest", F.when(F.col("deepest") < 0, div(yearly, F.abs("deepest"))).alias("calmar"))


def best_of_luck(trials: float, spread: float) -> float:
    """The Sharpe ratio that the best of so many trials without skill is expected to have."""
    n, inverse = max(float(trials), 2.0), NormalDist().inv_cdf
    return spread * ((1 - EULER) * inverse(1 - 1 / n) + EULER * inverse(1 - 1 / (n * 2.718281828459045)))


@F.pandas_udf(DoubleType())
def normal_share(z: pd.Series) -> pd.Series:
    """Distribution function of the standard normal; rows are trials, not days."""
    return z.map(lambda v: None if pd.isna(v) else NormalDist().cdf(v)).astype(float)


def deflated(ledger: DataFrame, trials: float, spread: float) -> DataFrame:
    """Per trial: z and probability that its daily Sharpe ratio beats the best of luck, corrected for skew and tails."""
    r = F.col("ret")
    m = ledger.groupBy("trial").agg(F.count(r).alias("n"), F.avg(r).alias("m"), F.stddev_samp(r).alias("s"), F.skewness(r).alias("skew"), (F.kurtosis(r) + 3).alias("tails"))
    ratio = F.when((F.col("n") >= LEAST_DAYS) & (F.col("s") > 0), F.col("m") / F.col("s"))
    base = 1 - F.col("skew") * ratio + (F.col("tails") - 1) / 4 * ratio * ratio
    z = F.when(base > 0, (ratio - best_of_luck(trials, spread)) * F.sqrt(F.col("n") - 1) / F.sqrt(base))
    return m.select("trial", (ratio * YEAR**0.5).alias("sharpe"), z.alias("z")).withColumn("probability", normal_share("z"))


def sums_by_block(ledger: DataFrame, blocks: int) -> DataFrame:
    """(trial, block, n, s, q) over blocks of time with equal numbers of instants; the first ones take what is left over."""
    instants = ledger.select("ts").distinct()
    n = instants.count()
    size, more = divmod(n, blocks)
    place = F.row_number().over(Window.orderBy("ts")) - 1  # instants only, not trials
    late = F.floor((F.col("place") - more * (size + 1)) / max(size, 1)) + more
    dealt = instants.withColumn("place", place).select("ts", F.when(F.col("place") < more * (size + 1), F.floor(F.col("place") / (size + 1))).otherwise(late).cast("int").alias("block"))
    return ledger.filter("ret is not null").join(dealt, "ts").groupBy("trial", "block").agg(F.count("*").alias("n"), F.sum("ret").alias("s"), F.sum(F.col("ret") * F.col("ret")).alias("q"))


def splits_of(ledger: DataFrame, blocks: int = 10, points: DataFrame | None = None, axes: int = 0) -> DataFrame:
    """(split, trial, share): for every half of the blocks the trial that is best there, and its rank share in the other half.

    With `points` (trial, place) the best is that of the best plateau on the lattice. Splits double with each block: 16 blocks at most.
    """
    if blocks % 2 or blocks > 16:
        raise ValueError("the number of blocks must be even and 16 at most")
    halves = ledger.sparkSession.range(1 << blocks).filter(F.bit_count("id") == blocks // 2).select(F.col("id").cast("int").alias("split"))
    sums = sums_by_block(ledger, blocks)
    sides = halves.select("split", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")).withColumn("inside", F.getbit(F.col("split"), F.col("block")) == 1)
    part = lambda c, own: F.sum(F.when(F.col("inside") == own, F.col(c)))
    both = (
        sums.join(F.broadcast(sides), "block")  # at most blocks * 2 ** blocks rows
        .groupBy("split", "trial")
        .agg(sharpe(*[part(x, True) for x in "nsq"]).alias("own"), sharpe(*[part(x, False) for x in "nsq"]).alias("other"))
    )
    if points is None:
        picked = both.filter("own is not null").groupBy("split").agg(F.min_by("trial", F.struct(-F.col("own"), F.col("trial"))).alias("trial"))
    else:
        picked = best_trials(both.select("split", "trial", F.col("own").alias("score")), 1, points, axes, ("split",)).select("split", "trial")
    chosen = picked.join(both.select("split", "trial", F.col("other").alias("mine")), ["split", "trial"]).filter("mine is not null")
    ranked = both.filter("other is not null").join(chosen, "split").groupBy("split", chosen["trial"]).agg(
        F.count("*").alias("n"), F.count_if(F.col("other") < F.col("mine")).alias("less"), F.count_if(F.col("other") == F.col("mine")).alias("same")
    )
    share = (F.col("less") + (F.col("same") + 1) / 2) / (F.col("n") + 1)
    return ranked.filter("n >= 2").select("split", "trial", F.least(F.lit(1 - 1e-6), F.greatest(F.lit(1e-6), share)).alias("share"))


def overfitting(ledger: DataFrame, blocks: int = 10, points: DataFrame | None = None, axes: int = 0) -> DataFrame:
    """One row: the share of splits in which the trial chosen in one half (the best, or with `points` that of the best plateau) is no better than the median of the other."""
    return splits_of(ledger, blocks, points, axes).agg(F.avg((F.col("share") <= 0.5).cast("int")).alias("pbo"), F.count("*").alias("n_splits"), F.median("share").alias("median_share"))


def smoothed(scores: DataFrame, points: DataFrame, axes: int, by: tuple[str, ...] = (), least: float = 0.5) -> DataFrame:
    """(by..., trial, score, mean, spread, neighbours): scores averaged over a trial's neighbours on the lattice of parameters.

    `points` (trial, place) gives each trial its coordinates, an array of `axes` whole numbers. Neighbours are one step
    away along one axis, the trial itself included; every trial gives its score to its neighbours' places, so
    that neighbours meet by equality. Trials of which less than `least` of the neighbours have a score get none, so
    that corners are not favoured for having few. An isolated peak is drawn down by what is around it.
    """
    step = lambda axis, by_: F.transform("place", lambda x, i: x + F.when(i == axis, by_).otherwise(0))
    around = F.explode(F.array(F.col("place"), *[step(k, d) for k in range(axes) for d in (-1, 1)]))
    given = points.select("trial", around.alias("place"))
    sizes = given.groupBy("place").agg(F.count("*").alias("size"))
    known = points.join(sizes, "place")
    got = scores.filter("score is not null").join(given, "trial").groupBy(*by, "place").agg(F.avg("score").alias("mean"), F.stddev_pop("score").alias("spread"), F.count("*").alias("neighbours"))
    found = got.join(known, "place").filter(F.col("neighbours") >= F.greatest(F.lit(1), F.ceil(least * F.col("size"))))
    own = scores.select(*by, "trial", "score")
    return found.join(own, [*by, "trial"], "left").select(*by, "trial", "score", "mean", "spread", "neighbours")


def best_trials(scores: DataFrame, top: int = 1, points: DataFrame | None = None, axes: int = 0, by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., trial, score, place): the `top` trials by score, or with `points` by the score of their plateau; ties go to the smaller trial."""
    if points is not None:
        ranked = smoothed(scores, points, axes, by).withColumn("_by", F.col("mean"))
    else:
        ranked = scores.filter("score is not null").withColumn("_by", F.col("score"))
    order = Window.partitionBy(*by).orderBy(F.desc("_by"), "trial")
    return ranked.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= top).select(*by, "trial", "score", "place")


def walked_forward(ledger: DataFrame, train: int, test: int, embargo: int = 10, top: int = 1, points: DataFrame | None = None, axes: int = 0) -> DataFrame:
    """(window, trial, n_picked, own_score, n, mean, total, score): trials chosen in each training window, held in the test window.

    Windows count instants. `embargo` instants between training and test are left out, since signals and
    entries reach over the border. The next window starts `test` later, and only whole windows count. The `top` trials by
    Sharpe ratio (with `points`, by their plateau) are held in equal parts; `trial` is the first of them.
    """
    instants = ledger.select("ts").distinct().withColumn("k", F.row_number().over(Window.orderBy("ts")) - 1)  # one row per instant
    instants = instants.withColumn("count", F.count("*").over(Window.partitionBy()))
    span = train + embargo + test
    last = F.floor((F.col("count") - span) / test)
    first = F.greatest(F.lit(0), F.ceil((F.col("k") - span + 1) / test))
    latest = F.least(last, F.floor(F.col("k") / test))
    dealt = ledger.filter("ret is not null").join(instants, "ts").filter(first <= latest)
    dealt = dealt.withColumn("window", F.explode(F.sequence(first.cast("int"), latest.cast("int"))))
    inside = F.col("k") - F.col("window") * test
    learned, held = dealt.filter(inside < train), dealt.filter(inside >= train + embargo)
    sums = (F.count("*").alias("n"), F.sum("ret").alias("s"), F.sum(F.col("ret") * F.col("ret")).alias("q"))
    score = sharpe(F.col("n"), F.col("s"), F.col("q"))
    scores = learned.groupBy("window", "trial").agg(*sums).select("window", "trial", score.alias("score"))
    picks = best_trials(scores, top, points, axes, ("window",))
    book = held.join(picks.select("window", "trial"), ["window", "trial"]).groupBy("window", "ts").agg(F.avg("ret").alias("ret")).groupBy("window").agg(*sums)
    chosen = picks.groupBy("window").agg(F.min_by("trial", "place").alias("trial"), F.count("*").alias("n_picked"), F.min_by("score", "place").alias("own_score"))
    return book.join(chosen, "window").select("window", "trial", "n_picked", "own_score", "n", (F.col("s") / F.col("n")).alias("mean"), F.col("s").alias("total"), score.alias("score"))


#: Trials of a block and instants of a chunk in the matrix of all correlations.
TRIAL_BLOCK, CHUNK = 256, 512


def _squares_of_tiles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(trace, squares) of each tile: its block of the correlation matrix is built up chunk by chunk; rows come sorted."""
    key, sides, chunk, rows, total = None, None, None, [], 0

    def close_chunk() -> None:
        if not rows:
            return
        present = {t: k for k, t in enumerate(sorted({t for r in rows for t in r[2]}))}
        dense = [np.zeros((len(s["names"]), len(present))) for s in sides]
        for side, k, at, values in rows:
            dense[side][k, [present[t] for t in at]] = values
        for s, d in zip(sides, dense, strict=True):
            grown = np.zeros((2, len(d)))
            grown[:, : s["sums"].shape[1]] = s["sums"]
            s["sums"] = grown + np.array([d.sum(1), (d * d).sum(1)])
        product = dense[0] @ dense[1].T
        product[: sides[0]["dots"].shape[0], : sides[0]["dots"].shape[1]] += sides[0]["dots"]
        sides[0]["dots"] = product
        rows.clear()

    def result() -> pd.DataFrame:
        close_chunk()
        (s, q), (u, v) = sides[0]["sums"], sides[1]["sums"]
        norm = lambda a, b: np.sqrt(np.maximum(b - a * a / total, 0))
        a, b = norm(s, q), norm(u, v)
        scale = np.outer(a, b)
        corr = np.divide(sides[0]["dots"] - np.outer(s, u) / total, scale, out=np.zeros_like(scale), where=scale > 1e-14)
        same = key[0] == key[1]
        return pd.DataFrame({"trace": [float((a > 1e-14).sum()) if same else 0.0], "squares": [float((corr**2).sum()) * (1 if same else 2)]})

    for batch in batches:
        for row in batch.itertuples(index=False):
            if (row.first, row.second) != key:
                if key is not None:
                    yield result()
                key, chunk, total = (row.first, row.second), None, row.total
                sides = [{"names": {}, "sums": np.zeros((2, 0)), "dots": np.zeros((0, 0))} for _ in range(2)]
            if row.chunk != chunk:
                close_chunk()
                chunk = row.chunk
            for side in (0, 1) if row.first == row.second else (0,) if row.block == row.first else (1,):
                names = sides[side]["names"]
                rows.append((side, names.setdefault(row.trial, len(names)), row.at, row.ret))
    if key is not None:
        yield result()


#: Instants of a block, and rows of a strip, in the matrix of sums over trials. Trials whose norm is no larger than FAINT may correlate with some trials and not with others.
INSTANT_BLOCK, STRIP, FAINT, NOTHING = 512, 64, 1e-7, 1e-14


def _sums_over_trials(batches: Iterator[pd.DataFrame], block: int, total: int) -> Iterator[pd.DataFrame]:
    """(first, second, strip, sums) of each tile of two blocks of instants: sums over the trials of a task; rows come sorted by tile."""
    key, sums = None, None

    def side(rows: pd.DataFrame, which: int) -> np.ndarray:
        start = which * block
        out = np.repeat(-(rows["mean"] / rows["norm"]).to_numpy()[:, None], min(block, total - start), axis=1)
        for k, (at, values, norm) in enumerate(zip(rows["at"], rows["ret"], rows["norm"], strict=True)):
            at = np.asarray(at) - start
            here = (at >= 0) & (at < out.shape[1])
            out[k, at[here]] += np.asarray(values)[here] / norm
        return out

    def strips() -> Iterator[pd.DataFrame]:
        for k in range(0, len(sums), STRIP):
            yield pd.DataFrame({"first": [key[0]], "second": [key[1]], "strip": [k // STRIP], "sums": [sums[k : k + STRIP].tobytes()]})

    for batch in batches:
        for own, rows in batch.groupby(["first", "second"], sort=True):
            if own != key:
                if key is not None:
                    yield from strips()
                key, sums = own, 0.0
            for k in range(0, len(rows), 1024):
                part = rows.iloc[k : k + 1024]
                left = side(part, own[0])
                sums = sums + left.T @ (left if own[0] == own[1] else side(part, own[1]))
    if key is not None:
        yield from strips()


def _squares_of_strips(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Squares of the sums of each strip over all tasks; rows come sorted by strip."""
    key, sums = None, None
    square = lambda: pd.DataFrame({"squares": [float((sums * sums).sum()) * (1 if key[0] == key[1] else 2)]})
    for batch in batches:
        for row in batch.itertuples(index=False):
            own = (row.first, row.second, row.strip)
            if own != key:
                if key is not None:
                    yield square()
                key, sums = own, 0.0
            sums = sums + np.frombuffer(row.sums)
    if key is not None:
        yield square()


def _squares_by_instants(trials: DataFrame, total: int, block: int) -> DataFrame:
    """(squares) of the correlations of trials (trial, at, ret, mean, norm) that are not faint.

    The squares of Z Z' and of Z' Z have the same sum, so that pairs of instants do for pairs of trials.
    """
    blocks = -(-total // block)
    rows = trials.select("at", "ret", "mean", "norm")
    if blocks == 1:
        rows = rows.withColumns({"first": F.lit(0), "second": F.lit(0)})
    else:
        pairs = F.array(*[F.struct(F.lit(i).alias("first"), F.lit(j).alias("second")) for i in range(blocks) for j in range(i, blocks)])
        # a trial goes to each tile with its returns there; a tile is dealt out to several tasks
        both = F.arrays_zip("at", "ret")
        rows = trials.select(F.explode(pairs).alias("p"), both.alias("v"), "mean", "norm", F.pmod(F.xxhash64("trial"), F.lit(64)).alias("slice"))
        here = F.filter("v", lambda x: F.floor(x["at"] / block).isin(F.col("p.first"), F.col("p.second")))
        rows = rows.select("p.first", "p.second", "slice", here.alias("v"), "mean", "norm").repartition("first", "second", "slice").sortWithinPartitions("first", "second")
        rows = rows.select("first", "second", F.col("v.at").alias("at"), F.col("v.ret").alias("ret"), "mean", "norm")
    strips = rows.mapInPandas(lambda x: _sums_over_trials(x, block, total), "first int, second int, strip int, sums binary")
    return strips.repartition("first", "second", "strip").sortWithinPartitions("first", "second", "strip").mapInPandas(_squares_of_strips, "squares double")


def _tiles(vectors: DataFrame, total: int) -> DataFrame:
    """(trace, squares) of tiles of two blocks, from vectors (trial, chunk, at, ret, block, other)."""
    tiles = vectors.withColumns({"first": F.least("block", "other"), "second": F.greatest("block", "other"), "total": F.lit(total)}).drop("other")
    return tiles.repartition("first", "second").sortWithinPartitions("first", "second", "chunk", "trial").mapInPandas(_squares_of_tiles, "trace double, squares double")


def effective_trials(ledger: DataFrame, block: int = TRIAL_BLOCK, chunk: int = CHUNK, instants: int = INSTANT_BLOCK) -> DataFrame:
    """One row: the number of trials and how many independent bets they hold, by the participation ratio of their correlations.

    (sum of eigenvalues)^2 / (sum of their squares) is trace^2 over the sum of squared correlations, so that no
    eigenvalues are needed. Where trials are more than instants, sums over trials for pairs of instants give the
    squares. Else trials are dealt into blocks; each tile of two blocks takes up the returns of
    successive chunks of time and gives two numbers. A return that is missing counts as 0; trials without any
    return are left out, those without spread correlate with none.
    """
    known = ledger.filter("ret is not null and ts is not null").withColumn("ret", F.col("ret").cast("double"))
    times = ledger.select("ts").filter("ts is not null").distinct()
    total = times.count()
    s, q = F.sum("ret"), F.sum(F.col("ret") * F.col("ret"))
    norms = known.groupBy("trial").agg(F.sqrt(F.greatest(F.lit(0.0), q - s * s / total)).alias("norm"))
    n, trace, faint = norms.agg(F.count("*"), F.count_if(F.col("norm") > NOTHING), F.count_if((F.col("norm") > 0) & (F.col("norm") <= FAINT))).first()
    if n <= 1:
        return norms.agg(F.count("*").alias("n_trials"), F.count("*").cast("double").alias("effective"))
    chunks, blocks = max(1, -(-total // chunk)), max(1, -(-n // block))

    def vectors(rows: DataFrame) -> DataFrame:
        got = rows.withColumn("chunk", F.pmod(F.xxhash64("ts"), F.lit(chunks)).cast("int")).groupBy("trial", "chunk").agg(F.collect_list(F.struct(F.unix_micros("ts").alias("t"), F.col("ret").alias("r"))).alias("v"))
        return got.select("trial", "chunk", F.col("v.t").alias("at"), F.col("v.r").alias("ret"), F.pmod(F.xxhash64("trial"), F.lit(blocks)).cast("int").alias("block"))

    if n <= total:
        parts = _tiles(vectors(known).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))), total)
    else:
        numbered = times.withColumn("at", F.row_number().over(Window.orderBy("ts")) - 1)  # one row per instant, fewer than trials
        own = known.join(numbered, "ts").groupBy("trial").agg(F.collect_list(F.struct("at", "ret")).alias("v"), (s / total).alias("mean"), F.sqrt(F.greatest(F.lit(0.0), q - s * s / total)).alias("norm"))
        own = own.filter(F.col("norm") > FAINT).select("trial", F.col("v.at").alias("at"), F.col("v.ret").alias("ret"), "mean", "norm")
        parts = _squares_by_instants(own, total, instants).select(F.lit(0.0).alias("trace"), "squares")
        if faint:  # two faint trials never correlate; one with another as far as the product of their norms goes
            rows = vectors(known.join(norms.filter("norm > 0"), "trial").withColumn("trial", F.struct((F.col("norm") <= FAINT).alias("faint"), "trial")))
            more = -(-faint // block)
            deal = lambda m: F.sequence(F.lit(0), F.lit(m - 1))
            is_faint = F.col("trial.faint")
            rows = rows.withColumn("block", F.when(is_faint, F.lit(blocks) + F.pmod(F.xxhash64("trial"), F.lit(more))).otherwise(F.col("block")).cast("int"))
            rows = rows.withColumn("other", F.explode(F.when(is_faint, deal(blocks)).otherwise(F.transform(deal(more), lambda k: k + blocks)))).withColumn("trial", F.col("trial.trial").cast("string"))
            parts = parts.unionByName(_tiles(rows, total))
    sums = parts.agg((F.coalesce(F.sum("trace"), F.lit(0.0)) if n <= total else F.lit(float(trace))).alias("trace"), F.sum("squares").alias("squares"))
    return sums.select(F.lit(n).cast("bigint").alias("n_trials"), F.coalesce(F.try_divide(F.col("trace") * F.col("trace"), "squares"), F.lit(1.0)).alias("effective"))
