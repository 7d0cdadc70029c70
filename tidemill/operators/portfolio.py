"""From scores to weights: forecasts from fitted coefficients, neutralisation, and books with caps.

All work is by instant: windows over the symbols of an instant, or one aggregation. Coefficients are
fitted from sums (ranks, Gram matrices), of which one row per factor pair leaves the cluster.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.functions import windows as W
from tidemill.operators.factors import pct_rank, rank_ic, standardised

#: Pivots below this share of a regressor's variance count as none: it depends on those before it.
SINGULAR = 1e-10


def instant(by: str = "ts"):
    return Window.partitionBy(by)


def ranked(df: DataFrame, x: str, out: str) -> DataFrame:
    """Rank shares of an instant, centred and scaled to a deviation of one."""
    return df.withColumn("_share", pct_rank(x)).withColumn(out, standardised("_share")).drop("_share")


def realised_vol(df: DataFrame, window: int = 20, least: int | None = None, out: str = "vol") -> DataFrame:
    """Deviation of log returns of the `window` rows before this one; NULL with fewer than `least` returns.

    The row's own return is left out, since it is not settled when the row is decided on.
    """
    least = max(5, window // 2) if least is None else least
    back = F.when(F.lag("close").over(W.series()) > 0, F.ln(F.when(F.col("close") > 0, F.col("close")) / F.lag("close").over(W.series())))
    over = W.trailing(window, 1)
    known = df.withColumn("_r", back)
    return known.withColumn(out, F.when(F.count("_r").over(over) >= least, F.stddev_samp("_r").over(over))).drop("_r")


def capped_weights(df: DataFrame, score: str, cap: float | None = 0.35, gross: float = 1.0, neutral: bool = True, least: int = 5, out: str = "weight", by: str = "ts", name: str = "symbol") -> DataFrame:
    """Weights in proportion to a score that meet gross exposure, cap and neutrality at once where they can.

    Neutral books centre the scores and give each side half of `gross`. No weight exceeds `cap * gross`: names over
    it are held there and the rest of their side is raised to one common level, found by sorting and
    running sums, not by clipping again and again. Where a side can't hold its half, the other one
    shrinks to what it holds, so that the book stays neutral and is less than `gross`. Unscored names weigh
    0, and all do where fewer than `least` are scored, so that no position is held on by accident.
    """
    if gross <= 0 or (cap is not None and not 0 < cap <= 1):
        raise ValueError("gross must be positive and cap in (0, 1]")
    v = F.col(score).cast("double")
    v = v - F.avg(v).over(instant(by)) if neutral else v
    size = F.when(F.abs("_v") > 1e-12, F.abs("_v"))
    target, most = F.lit(gross / 2 if neutral else gross), F.lit(float("inf") if cap is None else cap * gross)
    rows = df.withColumn("_v", v).withColumns({"_m": size, "_side": F.signum("_v") if neutral else F.lit(1.0)})
    side = Window.partitionBy(by, "_side")
    down, up = side.orderBy(F.col("_m").desc_nulls_last(), name), side.orderBy(F.col("_m").asc_nulls_first(), F.desc(name))
    # a name is capped if it would exceed the cap with all larger ones held at it
    ahead = F.row_number().over(down) - 1
    behind = F.sum("_m").over(up.rowsBetween(Window.unboundedPreceding, 0))  # the same order backwards: each row adds one value
    rows = rows.withColumn("_capped", F.coalesce((target - ahead * most) * F.col("_m") >= most * behind, F.lit(False)) if cap is not None else F.lit(False))
    free = F.sum(F.when(~F.col("_capped"), F.col("_m"))).over(side)
    level = (target - F.count_if("_capped").over(side) * (most if cap is not None else F.lit(0.0))) / free
    rows = rows.withColumn("_w", F.when(F.col("_m").isNotNull(), F.when(F.col("_capped"), most).otherwise(level * F.col("_m"))))
    if neutral:
        total = lambda sign: F.coalesce(F.sum(F.when(F.col("_side") == sign, F.col("_w"))).over(instant(by)), F.lit(0.0))
        held = F.sum("_w").over(side)
        rows = rows.withColumn("_w", F.col("_w") * F.least(F.lit(1.0), F.least(total(1.0), total(-1.0)) / held))
    enough = F.count(score).over(instant(by)) >= least
    return rows.withColumn(out, F.when(enough, F.coalesce(F.signum("_v") * F.col("_w"), F.lit(0.0))).otherwise(0.0)).drop("_v", "_m", "_side", "_capped", "_w")


def rebalanced(df: DataFrame, every: int = 3, ts: str = "ts") -> DataFrame:
    """Rows of every `every`-th instant, from the first on; between them positions are held."""
    instants = df.select(ts).distinct().withColumn("_k", F.row_number().over(Window.orderBy(ts)) - 1)  # one row per instant
    return df.join(instants.filter(F.col("_k") % every == 0).select(ts), ts)


def target_weights(df: DataFrame, score: str, sizing: str = "equal_notional", vol_window: int = 20, cap: float = 0.35, gross: float = 1.0, neutral: bool = True, least: int = 5, every: int = 3, vol_floor: float = 1e-4) -> DataFrame:
    """(symbol, ts, weight) on rebalancing instants: ranks of a score, by equal value or by equal risk (`risk_scaled`)."""
    if sizing not in ("equal_notional", "risk_scaled"):
        raise ValueError("sizing is equal_notional or risk_scaled")
    rows = ranked(df, score, "_z")
    if sizing == "risk_scaled":
        rows = realised_vol(rows, vol_window, out="_vol").withColumn("_z", F.col("_z") / F.greatest("_vol", F.lit(vol_floor)))
        rows = rows.withColumn("_z", F.when(F.col("_vol").isNotNull(), F.col("_z")))
    return rebalanced(capped_weights(rows, "_z", cap, gross, neutral, least), every).select("symbol", "ts", "weight")


def sign_weights(df: DataFrame, score: str, gross: float = 1.0, least: int = 5) -> DataFrame:
    """Equal weights by the sign of a score."""
    return capped_weights(df.withColumn("_sign", F.signum(score)), "_sign", None, gross, True, least).drop("_sign")


def quantile_weights(df: DataFrame, score: str, share: float = 0.3, gross: float = 1.0, least: int = 5) -> DataFrame:
    """The top share of an instant against the bottom share, equal weights in each."""
    place = pct_rank(score)
    rows = df.withColumn("_share", place).withColumn("_pick", F.when(F.col("_share") >= 1 - share, 1.0).when(F.col("_share") <= share, -1.0).when(F.col("_share").isNotNull(), 0.0))
    return capped_weights(rows, "_pick", None, gross, True, least).drop("_share", "_pick")


def turnover(weights: DataFrame) -> DataFrame:
    """(ts, gross, net, names, turnover): exposure of each rebalancing and half of what changes from the one before.

    A name without a row has weight 0 there.
    """
    instants = weights.select("ts").distinct().withColumn("_k", F.row_number().over(Window.orderBy("ts")))
    placed = weights.join(instants, "ts")
    ahead = placed.select("symbol", (F.col("_k") + 1).alias("_k"), F.lit(0.0).alias("weight"), F.col("weight").alias("_before"))
    moves = placed.select("symbol", "_k", "weight", F.lit(0.0).alias("_before")).union(ahead).groupBy("symbol", "_k").agg(F.sum("weight").alias("w"), F.sum("_before").alias("b"))
    by = moves.groupBy("_k").agg(F.sum(F.abs("w")).alias("gross"), F.sum("w").alias("net"), F.count_if(F.col("w") != 0).alias("names"), (F.sum(F.abs(F.col("w") - F.col("b"))) / 2).alias("turnover"))
    return by.join(instants, "_k").select("ts", "gross", "net", "names", "turnover")


def neutralised(df: DataFrame, y: str, xs: Sequence[str], out: str = "residual", least: int = 5, by: str = "ts") -> DataFrame:
    """What a regression on several columns and a constant leaves of y, instant by instant.

    Moments of an instant come from windows over it; the normal equations are solved by elimination in
    columns. A regressor that depends on those before it takes no part. NULL with fewer than `least` complete rows,
    or no more than regressors and two.
    """
    names, k = list(xs), len(xs)
    if not names:
        raise ValueError("at least one regressor is needed")
    whole = F.lit(True)
    for x in (y, *names):
        whole &= F.col(x).isNotNull()
    over = instant(by)
    rows = df.withColumn("_ok", whole)
    rows = rows.withColumns({f"_x{i}": F.when(F.col("_ok"), F.col(x).cast("double")) for i, x in enumerate((*names, y))})
    rows = rows.withColumns({"_n": F.count_if("_ok").over(over)} | {f"_x{i}": F.col(f"_x{i}") - F.avg(f"_x{i}").over(over) for i in range(k + 1)})
    # Gram matrix of centred columns, the target as the last
    rows = rows.withColumns({f"_g{i}_{j}": F.sum(F.col(f"_x{i}") * F.col(f"_x{j}")).over(over) for i in range(k) for j in range(i, k + 1)})
    rows = rows.withColumns({f"_d{i}": F.col(f"_g{i}_{i}") for i in range(k)})
    for p in range(k):
        # factors below the pivot; none where the pivot is nothing of the regressor's own variance
        known = F.col(f"_g{p}_{p}") > SINGULAR * F.col(f"_d{p}")
        rows = rows.withColumns({f"_f{p}_{i}": F.when(known, F.col(f"_g{p}_{i}") / F.col(f"_g{p}_{p}")).otherwise(0.0) for i in range(p + 1, k + 1)})
        rows = rows.withColumns({f"_g{i}_{j}": F.col(f"_g{i}_{j}") - F.col(f"_f{p}_{i}") * F.col(f"_g{p}_{j}") for i in range(p + 1, k) for j in range(i, k + 1)})
    for p in reversed(range(k)):
        rest = sum((F.col(f"_f{p}_{j}") * F.col(f"_b{j}") for j in range(p + 1, k)), F.lit(0.0))
        rows = rows.withColumn(f"_b{p}", F.col(f"_f{p}_{k}") - rest)
    left = F.col(f"_x{k}") - sum((F.col(f"_b{i}") * F.col(f"_x{i}") for i in range(k)), F.lit(0.0))
    enough = (F.col("_n") >= least) & (F.col("_n") > k + 1)
    return rows.withColumn(out, F.when(F.col("_ok") & enough, left)).select(*df.columns, out)


def mean_ic(df: DataFrame, factors: Sequence[str], target: str, least: int = 5) -> dict[str, float]:
    """Mean rank correlation of each factor with the target over the instants."""
    found = None
    for name in factors:
        part = rank_ic(df, name, target, least).agg(F.lit(name).alias("factor"), F.avg("ic").alias("ic"))
        found = part if found is None else found.union(part)
    return {r["factor"]: r["ic"] for r in found.collect()}  # a number for each factor


def pooled_ridge(df: DataFrame, factors: Sequence[str], target: str, alpha: float = 1.0, least: int = 5) -> dict[str, float]:
    """Coefficients of standardised factors on the target, pooled over instants with `least` complete rows.

    One aggregation makes the Gram matrix; the driver solves as many equations as there are factors.
    """
    names = list(factors)
    rows = df.withColumns({f"_z{i}": standardised(x) for i, x in enumerate(names)})
    whole = F.col(target).isNotNull()
    for i in range(len(names)):
        whole &= F.col(f"_z{i}").isNotNull()
    rows = rows.filter(whole).withColumn("_n", F.count("*").over(instant())).filter(F.col("_n") >= least)
    columns = [*[F.col(f"_z{i}") for i in range(len(names))], F.col(target)]
    got = rows.agg(*[F.sum(columns[i] * columns[j]) for i in range(len(names)) for j in range(i, len(names) + 1)]).first()
    gram, at = np.zeros((len(names) + 1, len(names) + 1)), iter(got)
    for i in range(len(names)):
        for j in range(i, len(names) + 1):
            value = next(at)
            if value is None:
                raise ValueError("no instant has enough complete rows")
            gram[i, j] = gram[j, i] = value
    return dict(zip(names, np.linalg.solve(gram[:-1, :-1] + alpha * np.eye(len(names)), gram[:-1, -1]).tolist(), strict=True))


def fit_betas(df: DataFrame, factors: Sequence[str], target: str, method: str = "ic", shrink: float = 0.0, least: int = 5) -> dict[str, float]:
    """Coefficients of a forecast, absolute values adding up to 1.

    `ic`: mean rank correlation. `equal`: its sign. `ridge`: a pooled regression. `shrink` moves them towards equal
    ones of the same signs. Fit on one span of time and use on later ones.
    """
    if method not in ("ic", "equal", "ridge") or not 0 <= shrink <= 1:
        raise ValueError("method is ic, equal or ridge; shrink is in [0, 1]")
    if method == "ridge":
        fitted = pooled_ridge(df, factors, target, least=least)
    else:
        known = mean_ic(df, factors, target, least)
        fitted = {k: v or 0.0 for k, v in known.items()} if method == "ic" else {k: 1.0 if v is not None and v >= 0 else -1.0 for k, v in known.items()}
    scale = sum(map(abs, fitted.values()))
    if scale <= 0:
        raise ValueError("all coefficients are 0")
    return {k: (1 - shrink) * v / scale + shrink * (1.0 if v >= 0 else -1.0) / len(fitted) for k, v in fitted.items()}


def forecast(df: DataFrame, betas: Mapping[str, float], standardise: str = "rank", out: str = "forecast") -> DataFrame:
    """Weighted sum of factors on one scale; a factor without a value has no vote, the others count for the whole."""
    rows, votes, shares = df, [], []
    for i, (name, beta) in enumerate(betas.items()):
        if beta == 0:
            continue
        if standardise == "rank":
            rows = ranked(rows, name, f"_z{i}")
        else:
            rows = rows.withColumn(f"_z{i}", standardised(name) if standardise == "zscore" else F.col(name))
        votes.append(F.coalesce(F.col(f"_z{i}") * beta, F.lit(0.0)))
        shares.append(F.when(F.col(f"_z{i}").isNotNull(), abs(beta)).otherwise(0.0))
    if not votes:
        raise ValueError("all coefficients are 0")
    total: Column = sum(votes[1:], votes[0]) / F.nullif(sum(shares[1:], shares[0]), F.lit(0.0))
    return rows.withColumn(out, total).select(*df.columns, out)
